"""Column expressions for identifiers, literal values and wiki text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
INTEGER, FLOAT, STRING = "xsd:integer", "xsd:float", "xsd:string"

#: Colour names that are no concepts.
COLOURS = [
    "red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "black", "white", "gray", "cyan", "magenta", "lime",
    "navy", "teal", "olive", "maroon", "aqua", "silver", "gold", "beige", "tan", "khaki", "ivory", "coral", "salmon", "peach",
    "lavender", "plum", "violet", "indigo", "turquoise", "mint", "emerald", "jade", "forest", "sage", "chartreuse", "crimson",
    "scarlet", "burgundy", "ruby", "rose", "fuchsia", "mauve", "periwinkle", "azure", "cobalt", "sapphire", "amber", "bronze",
    "copper", "cream", "pearl", "slate",
]
#: Date formats, each with the shape it must have.
DATE_FORMATS = {
    "y-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d/M/y": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d-M-y": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "y/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "d.M.y": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "M/d/y": r"^\d{1,2}/\d{1,2}/\d{4}$",
}
DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"(?i)^\s*[+-]?(?:(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})(?:e[+-]?{DIGITS})?|nan|inf|infinity)\s*$"
WHOLE = rf"^\s*[+-]?{DIGITS}\s*$"
#: Characters and parts that no concept value holds.
SPECIAL = [":", ";", "/", ",", "~", "〜", "|", "%", '"', "!", "®", "（", "）", "«", "»", "#", "+", "*", "="]
LOCAL_PARTS = [":00", "ES:", "NL:", "DE:", "FR:", "FI:", "IT:", "US:"]


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def once(c: Column, f) -> Column:
    """f(c), c being worked out once however often f looks at it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end. A run of white space is tried once, from its first character."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


def camel(c: Column) -> Column:
    """Each run of cased letters capitalised, underscores dropped: addr:street is Addr:Street, 3d is 3D."""
    runs = F.regexp_extract_all(c, F.lit(f"({CASED}+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+)"), F.lit(1))
    return F.replace(F.array_join(F.transform(runs, F.initcap), ""), F.lit("_"), F.lit(""))


def natural(c: Column, capital: bool = False) -> Column:
    words = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2)))) if capital else words


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<!^)(\p{Lu})", "_$1"))


def is_snake(c: Column) -> Column:
    return (c == F.lower(c)) & c.rlike(r"(?U)^\w+$") & c.rlike(CASED)


def is_camel(c: Column) -> Column:
    return c.rlike(r"(?s)^\p{Lu}[^_]*\z")


def is_number(c: Column) -> Column:
    return c.rlike("(?U)" + NUMBER)


def is_colour(c: Column) -> Column:
    return c.rlike(r"^#(?:[A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$") | c.isin(COLOURS)


def is_date(c: Column) -> Column:
    return any_of([c.rlike(shape) & F.coalesce(F.try_to_date(c, form).isNotNull(), F.lit(False)) for form, shape in DATE_FORMATS.items()])


def is_email(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def typed(c: Column, fixed: bool = False) -> Column:
    """A value as struct (value, datatype, num). yes and no are true and false, of datatype integer unless fixed asks for boolean."""
    low = F.lower(c)
    bare = F.regexp_replace(c, r"(?U)[\s_+]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")
    boolean = F.lit("xsd:boolean" if fixed else INTEGER)
    none = F.lit(None).cast("double")
    cases = [
        (low.isin("true", "yes"), F.lit("true"), boolean, F.lit(1.0)),
        (low.isin("false", "no"), F.lit("false"), boolean, F.lit(0.0)),
        (c.rlike("(?U)" + WHOLE), whole, F.lit(INTEGER), whole.try_cast("double")),
        (is_number(c), bare.try_cast("double").cast("string"), F.lit(FLOAT), bare.try_cast("double")),
    ]
    out = F.when(F.lit(False), F.struct(c.alias("value"), F.lit(STRING).alias("datatype"), none.alias("num")))
    for test, value, datatype, num in cases:
        out = out.when(test, F.struct(value.alias("value"), datatype.alias("datatype"), num.alias("num")))
    return out.otherwise(F.struct(c.alias("value"), F.lit(STRING).alias("datatype"), none.alias("num")))


def reject_reason(c: Column) -> Column:
    """Why a tag value is no concept, by the first rule that tells; null for a concept."""
    holds = lambda parts: any_of([c.contains(p) for p in parts])
    low = F.lower(c)
    yes_no = low.contains("yes") | low.contains("no")
    rules = [
        ("yes or no", yes_no & ~low.contains("openinghours")),
        ("local or hour", ~yes_no & holds(LOCAL_PARTS)),
        ("number", ~yes_no & is_number(F.split_part(c, F.lit("_"), F.lit(1)))),
        ("ordinal", ~yes_no & any_of([c.startswith(x) for x in ("1st", "2nd", "3rd")])),
        ("link", ~yes_no & c.startswith("http")),
        ("colour", ~yes_no & is_colour(c)),
        ("date", ~yes_no & is_date(c)),
        ("e-mail", ~yes_no & is_email(c)),
        ("many words", ~yes_no & ((F.size(F.split(c, "_")) > 2) | (F.size(F.split(c, " ")) > 3))),
        ("special character", ~yes_no & holds(SPECIAL)),
    ]
    out = F.when(c.isNull(), "null")
    for name, test in rules:
        out = out.when(test, name)
    return out


def concept_value(c: Column) -> Column:
    """The value as vocabularies spell it: no apostrophe, dots as underscores; null if it is no concept."""
    low = F.lower(c)
    spelled = F.replace(F.replace(c, F.lit("'"), F.lit("")), F.lit("."), F.lit("_"))
    return F.when(reject_reason(c).isNull(), F.when((low.contains("yes") | low.contains("no")) & low.contains("openinghours"), "OpeningHours").otherwise(spelled))


def normal_key(c: Column) -> Column:
    return stripped(F.replace(c, F.lit(" "), F.lit("_")))


def clean_wikitext(c: Column) -> Column:
    """Plain text: comments, references, link targets, quotes and tags go."""
    #: What goes, in this order.
    for pattern, by in (
        (r"(?s)<!--.*?-->", " "),
        (r"(?iU)<ref[^>/]*/\s*>", " "),
        (r"(?is)<ref[^>]*>.*?</ref>", " "),
        (r"(?U)\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"),
        (r"(?U)\[https?://[^\s\]]+\]", ""),
        (r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"),
        (r"\[\[([^\]]+)\]\]", "$1"),
        (r"'''|''", ""),
        (r"</?[^>]+>", " "),
        (r"(?U)\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, by)
    return stripped(c)


def without_sentences(c: Column, pattern: str) -> Column:
    """A text without the sentences, up to a full stop, in which the pattern is found; what follows the last full stop stays. The text is cut once, so the cost is in proportion to its length."""
    kept = lambda parts: F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: ~x.rlike(pattern))
    return once(F.split(c, r"\."), lambda parts: F.array_join(F.concat(kept(parts), F.array(F.element_at(parts, -1))), "."))


def clean_description(c: Column) -> Column:
    """A description without brackets, page references and templates."""
    #: The parts, sentences and templates that are taken out, in this order.
    for part, by in (("[[", ""), ("]]", ""), ("'''", "'"), ("<br>", "")):
        c = F.replace(c, F.lit(part), F.lit(by))
    c = without_sentences(stripped(c), r"(?iU)\bsee\s+(?:the\s+)?page\b|\bsee\s+also\b")
    for pattern, by in (
        (r"(?iu)\{\{Tag\|([^|}]+)\|([^}]+)\}\}", "$1=$2"),
        (r"(?iu)\{\{tag\|([^}]+)\}\}", "$1"),
        (r"(?iu)\{\{wikiIcon\|[^|}]+\|([^}]+)\}\}", "$1"),
        (r"(?iU)\{\{main\|[^}]+\}\}\s*", ""),
        (r"\{\{Prefix\|([^}]+)\}\}", "$1"),
    ):
        c = F.regexp_replace(c, pattern, by)
    for part, by in (("  ", " "), ("Tag:", ""), ("|", "")):
        c = F.replace(c, F.lit(part), F.lit(by))
    return c


def extracted(c: Column, pattern: str) -> Column:
    """Group 1 of the first match; null, not empty, without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def template_block(c: Column, name: str) -> Column:
    """The inside of the first template of that name: up to a line that begins with its end, or else to the first end."""
    head = r"\{\{\s*" + name + r"\b"
    # What follows the first head, looked for once; a text without one is not looked at again.
    rest = extracted(c, rf"(?isU){head}(.*)")
    inside = lambda x: F.when(x.contains("\n}}"), F.substring_index(x, "\n}}", 1)).when(x.contains("}}"), F.substring_index(x, "}}", 1))
    return once(rest, inside)


def template_parameter(block: Column, name: str) -> Column:
    """A parameter's value, over several lines, up to the next parameter's line or the end."""
    rest = extracted(block, rf"(?isU)\|\s*{name}\s*=\s*(.*)")
    return stripped(F.get(F.split(rest, r"(?U)\n(?=\|\s*[A-Za-z0-9_]+\s*=|\}\})", 2), F.lit(0)))


def parameter_text(block: Column, name: str) -> Column:
    """What stands after a parameter's equals sign, blanks included, up to the next parameter's line or the end. Of a parameter that is left empty it is empty, where template_parameter() goes on to what follows."""
    rest = extracted(block, rf"(?isU)\|\s*{name}\s*=(.*)")
    return F.get(F.split(rest, r"(?U)\n(?=\|\s*[A-Za-z0-9_]+\s*=|\}\})", 2), F.lit(0))


def truthy(c: Column) -> Column:
    low = F.lower(stripped(c))
    return F.coalesce(low.isin("yes", "true", "1", "recommended") | low.startswith("yes"), F.lit(False))


def element_kinds(block: Column) -> Column:
    kinds = (("onNode", "SpatialPoint"), ("onWay", "SpatialSegment"), ("onArea", "SpatialRegion"))
    return F.array_compact(F.array(*[F.when(truthy(template_parameter(block, p)), kind) for p, kind in kinds]))


def template_tags(c: Column) -> Column:
    """key=value or key of each Tag template, then of each Key template, each once."""
    inside = lambda name: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?isU)\{{\{{\s*{name}\s*\|\s*([^}}]+?)\s*\}}\}}"), F.lit(1))
    parts = F.transform(inside("Tag"), lambda x: F.filter(F.transform(F.split(x, r"\|"), stripped), lambda p: (p != "") & ~p.contains("=")))
    tags = F.transform(F.filter(parts, lambda p: F.size(p) > 0), lambda p: F.array_join(F.slice(p, 1, 2), "="))
    keys = F.filter(F.transform(inside("Key"), stripped), lambda k: ~k.contains("="))
    return F.array_distinct(F.concat(tags, keys))


def combination_keys(wikitext: Column) -> Column:
    """Keys used in combination: of the template's parameter, then of the section of that name, each once."""
    listed = template_parameter(template_block(wikitext, "ValueDescription"), "combination")
    rest = extracted(wikitext, r"(?isU)==\s*Tags used in combination\s*==\s*(.*)")
    section = F.get(F.split(rest, r"\n==(?=[^=])", 2), F.lit(0))
    return combined_keys(listed, section)


def combined_keys(listed: Column, section: Column) -> Column:
    """The keys of the tags in the template's parameter, then of those in the section, each once."""
    both = F.array_distinct(F.concat(template_tags(listed), template_tags(section)))
    keys = F.transform(both, lambda t: stripped(F.split_part(F.replace(stripped(t), F.lit(" "), F.lit("_")), F.lit("="), F.lit(1))))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))
