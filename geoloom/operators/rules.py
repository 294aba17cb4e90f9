"""Quality rules over graphs: rule, n_bad, n_total, passed, level.

A graph is read once: each subject becomes one row of facts, links to other
subjects bring the facts of their objects, and the rules of all kinds of
subjects are one vector of counts over those rows, unpivoted at the end. The
number of rules changes the number of columns of one aggregation, not the number
of scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.triples import PREFIXES, RDF_TYPE
from .match import match

SKOS, RDFS, OWL, SAREF = (PREFIXES[x] for x in ("skos", "rdfs", "owl", "saref"))
FEATURE, NODE_TYPE = PREFIXES["geo"] + "Feature", PREFIXES["osm"] + "node"
#: The types that rules look at, by the name of their fact.
TYPES = {
    "concept": SKOS + "Concept", "scheme": SKOS + "ConceptScheme", "class_": OWL + "Class", "object_property": OWL + "ObjectProperty", "datatype_property": OWL + "DatatypeProperty",
    "property_value": SAREF + "hasPropertyValue", "property_link": SAREF + "hasProperty",
}


@dataclass(frozen=True)
class Rule:
    """A rule on the rows of a kind. bad: what a row must not be; null counts as bad. least: fewer rows than that fail it too. weight: how many times a row counts."""

    name: str
    kind: Column
    bad: Column
    level: str = "failure"
    least: int = 0
    weight: Column | None = None

    def counts(self) -> tuple[Column, Column]:
        kind = F.coalesce(self.kind, F.lit(False))
        bad = kind & F.coalesce(self.bad, F.lit(True))
        if self.weight is None:
            return F.count_if(bad), F.count_if(kind)
        total = lambda test: F.coalesce(F.sum(F.when(test, self.weight)), F.lit(0)).cast("long")
        return total(bad), total(kind)


def counted(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row for each rule, all from one aggregation over rows."""
    pairs = [rule.counts() for rule in rules]
    vector = rows.agg(*[c.alias(f"{name}{i}") for i, pair in enumerate(pairs) for name, c in zip(("bad", "all"), pair, strict=True)])
    made = []
    for i, rule in enumerate(rules):
        bad, total = F.col(f"bad{i}"), F.col(f"all{i}")
        made.append(F.struct(F.lit(rule.name).alias("rule"), bad.alias("n_bad"), total.alias("n_total"), ((bad == 0) & (total >= rule.least)).alias("passed"), F.lit(rule.level).alias("level")))
    return vector.select(F.inline(F.array(*made)))


def report(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verdict(reported: DataFrame) -> DataFrame:
    """One row: whether all rules but warnings passed."""
    return reported.agg(F.coalesce(F.bool_and(F.col("passed") | (F.col("level") == "warning")), F.lit(True)).alias("passed"), F.count("*").alias("n_rules"))


def namespaces(triples: DataFrame) -> DataFrame:
    """How often IRIs of each namespace occur."""
    terms = F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "iri", F.col("o")))
    return triples.select(F.explode(F.array_compact(terms)).alias("iri")).groupBy(F.regexp_extract("iri", r"^(.*[#/])", 1).alias("namespace")).agg(F.count("*").alias("n"))


def expected_namespaces(triples: DataFrame, expected: list[str]) -> DataFrame:
    """(namespace, found, expected, n): the namespaces that occur or are expected; those that are missing or unexpected have one flag alone."""
    wanted = triples.sparkSession.createDataFrame([(x, True) for x in sorted(set(expected))], "namespace string, expected boolean")
    both = namespaces(triples).join(wanted, "namespace", "full")
    return both.select("namespace", F.col("n").isNotNull().alias("found"), F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n"))


def subject_facts(triples: DataFrame, domain: str | None = None) -> DataFrame:
    """A row for each subject: its types as flags, whether it has the domain, and how many labels and texts it has."""
    p, o = F.col("p"), F.col("o")
    any_ = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    lang = lambda predicate, x: F.count_if((p == predicate) & (F.col("lang") == x))
    return triples.groupBy("s").agg(
        *[any_((p == RDF_TYPE) & (o == type_)).alias(name) for name, type_ in TYPES.items()], any_((p == RDFS + "domain") & (o == F.lit(domain))).alias("placed"),
        F.count_if(p == SKOS + "hiddenLabel").alias("n_hidden"), lang(SKOS + "prefLabel", "en").alias("n_pref_en"), F.count_if(p == SKOS + "definition").alias("n_definition"),
        lang(SKOS + "definition", "en").alias("n_definition_en"), *[lang(RDFS + x, l).alias(f"n_{x}_{l}") for x in ("label", "comment") for l in ("en", "fr")],
    )


def local_name(iri: str) -> Column:
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def linked_facts(triples: DataFrame, facts: DataFrame, relation: str, space: str, concept_space: str, related: str = "datatype_property") -> DataFrame:
    """facts with what the subjects' links tell: real (all its schemes are schemes), named (after all its schemes), related (all its related terms are typed and named; null without any), defined (by a scheme of the concepts' namespace)."""
    scheme, by = F.col("p") == SKOS + "inScheme", F.col("p") == RDFS + "isDefinedBy"
    links = triples.filter(F.col("p").isin(SKOS + "inScheme", RDFS + "isDefinedBy", relation)).select("s", "p", "o")
    ends = facts.select(F.col("s").alias("o"), F.col("scheme").alias("is_scheme"), F.col(related).alias("is_related"))
    links = links.join(ends, "o", "left").withColumns({"is_scheme": F.coalesce("is_scheme", F.lit(False)), "is_related": F.coalesce("is_related", F.lit(False))})
    named = F.col("s").startswith(F.col("o")) & text.is_camel(local_name("o")) & ~local_name("o").rlike(r"\d")
    term = F.col("is_related") & F.col("o").startswith(space) & local_name("o").rlike(r"^has\p{Lu}[^_]*$") & F.col("s").startswith(concept_space)
    told = links.groupBy("s").agg(
        F.bool_and(F.when(scheme, F.col("is_scheme"))).alias("real"), F.bool_and(F.when(scheme, named)).alias("named"), F.bool_and(F.when(F.col("p") == relation, term)).alias("related"),
        F.bool_or(by & F.col("is_scheme") & F.col("o").startswith(concept_space)).alias("defined"),
    )
    return facts.join(told, "s", "left")


def glossary_facts(triples: DataFrame, space: str, concept_space: str, relation: str, domain: str | None = None) -> DataFrame:
    """The facts that the rules on concepts, schemes and properties look at. triples is scanned by subject and for its links; a written graph is best."""
    return linked_facts(triples, subject_facts(triples, domain), relation, space, concept_space)


def described_rules(what: str, kind: Column) -> list[Rule]:
    """What concepts, sub-concepts and schemes have in common."""
    return [Rule(f"{what} has a hidden label", kind, F.col("n_hidden") == 0, "warning" if what != "sub-concept" else "failure"), Rule(f"{what} has a definition", kind, F.col("n_definition") == 0, "warning")]


def concept_rules(space: str) -> list[Rule]:
    kind = F.col("concept")
    return [
        Rule("concepts exist", kind, F.lit(False), least=1),
        Rule("concept is in the namespace", kind, ~F.col("s").startswith(space)),
        Rule("concept is a class", kind, ~F.col("class_"), "warning"),
        Rule("concept has a preferred label in en", kind, F.col("n_pref_en") == 0),
        Rule("concept is in real schemes", kind, ~F.col("real")),
        Rule("concept is named after its scheme", kind, ~F.col("named")),
        Rule("definition of concept is in en", kind & (F.col("n_definition") > 0), F.col("n_definition_en") < F.col("n_definition")),
        *described_rules("concept", kind),
    ]


def related_rules() -> list[Rule]:
    """Terms related to concepts exist, have the type, and are named in camel case in their namespace."""
    return [Rule("related terms are real, typed and named", F.col("related").isNotNull(), ~F.col("related"))]


def sub_concept_rules(space: str) -> list[Rule]:
    """Rules on the concepts that are values of properties."""
    kind = F.col("concept") & F.col("property_value")
    return [
        Rule("sub-concept is an object property", kind, ~F.col("object_property")),
        Rule("sub-concept is in the namespace", kind, ~F.col("s").startswith(space)),
        Rule("definition of sub-concept is in en", kind & (F.col("n_definition") > 0), F.col("n_definition_en") < F.col("n_definition")),
        *described_rules("sub-concept", kind),
    ]


def scheme_rules(space: str) -> list[Rule]:
    kind = F.col("scheme")
    return [
        Rule("schemes exist", kind, F.lit(False), least=1),
        Rule("scheme is in the namespace", kind, ~F.col("s").startswith(space)),
        Rule("scheme is a class", kind, ~F.col("class_"), "warning"),
        Rule("scheme has a preferred label in en", kind, F.col("n_pref_en") == 0),
        *described_rules("scheme", kind),
    ]


def property_rules(space: str) -> list[Rule]:
    """Optional rules on the own properties: name, type, domain, label, comment, and the scheme that defines them."""
    kind = (F.col("object_property") | F.col("datatype_property")) & F.col("s").startswith(space)
    return [
        Rule("property is named has and a camel word", kind, ~local_name("s").rlike(r"^has\p{Lu}[^_]*$")),
        Rule("property links to property instances", kind, ~F.col("property_link")),
        Rule("property has its domain", kind, ~F.col("placed")),
        Rule("property has a label in en", kind, F.col("n_label_en") == 0),
        Rule("property has a comment in en", kind, F.col("n_comment_en") == 0),
        Rule("property is defined by a scheme", kind, ~F.col("defined")),
    ]


def glossary_rules(concept_space: str) -> list[Rule]:
    return [*concept_rules(concept_space), *related_rules(), *sub_concept_rules(concept_space), *scheme_rules(concept_space)]


def class_checks(triples: DataFrame, expected: DataFrame, own: DataFrame, space: str) -> DataFrame:
    """Named classes exist, have the given super-classes, and one label and comment in each language; the own classes are just those of own. expected: s, wanted (the super-classes); own: s."""
    none = lambda type_: F.lit(None).cast(type_)
    rows = triples.select("s", "p", "o", "lang", none("array<string>").alias("wanted"), F.lit(False).alias("listed"))
    rows = rows.unionByName(expected.select("s", "wanted", F.lit(False).alias("listed")), allowMissingColumns=True).unionByName(own.select("s", F.lit(True).alias("listed")), allowMissingColumns=True)
    p = F.col("p")
    text_ = lambda predicate, x: F.count_if((p == RDFS + predicate) & (F.col("lang") == x)) == 1
    texts = text_("label", "en") & text_("label", "fr") & text_("comment", "en") & text_("comment", "fr")
    facts = rows.groupBy("s").agg(
        F.coalesce(F.bool_or((p == RDF_TYPE) & (F.col("o") == OWL + "Class")), F.lit(False)).alias("class_"), F.collect_set(F.when(p == RDFS + "subClassOf", F.col("o"))).alias("parents"),
        F.first("wanted", ignorenulls=True).alias("wanted"), F.bool_or("listed").alias("listed"), texts.alias("texts"),
    )
    named, found = F.col("wanted").isNotNull(), F.col("class_") & F.col("s").startswith(space)
    return counted(facts, [
        Rule("class exists", named, ~F.col("class_")),
        Rule("class has its super-classes", named, F.size(F.array_except("wanted", "parents")) > 0),
        Rule("class has one label and comment in en and fr", named, ~F.col("texts")),
        Rule("own classes are the expected", found | F.col("listed"), ~(found & F.col("listed"))),
    ])


def term_usage(schema: DataFrame, triples: DataFrame, space: str) -> DataFrame:
    """(kind, term, declared, n_used): the schema's own classes and properties, those of either type in one list, and how often triples use them, declared or not."""
    kind = F.when(F.col("o") == OWL + "Class", "class").when(F.col("o").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty"), "property")
    own = match(schema, p=RDF_TYPE).filter(F.col("s").startswith(space)).select(kind.alias("kind"), F.col("s").alias("term")).filter("kind is not null").distinct()
    classes = match(triples, p=RDF_TYPE).select(F.lit("class").alias("kind"), F.col("o").alias("term"))
    used = classes.unionByName(triples.select(F.lit("property").alias("kind"), F.col("p").alias("term"))).filter(F.col("term").startswith(space))
    used = used.groupBy("kind", "term").agg(F.count("*").alias("n_used"))
    both = own.withColumn("declared", F.lit(True)).join(used, ["kind", "term"], "full")
    return both.select("kind", F.substr("term", F.lit(len(space) + 1)).alias("term"), F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"))


def instance_facts(points: DataFrame, geometries: DataFrame, properties: DataFrame, types: DataFrame | None = None, segments: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """A row for each entity of the data: entity_id and how many points, shapes, properties, types and ends it has, from one aggregation over all tables together.

    points: entity_id; geometries: entity_id, wkt; properties: entity_id,
    type_name; types: entity_id, type; segments: entity_id, class; found: way_id,
    node_id of the extremities.
    """
    parts = [
        points.select("entity_id", F.lit(1).alias("point")), geometries.select("entity_id", "wkt", F.lit(1).alias("shape")), properties.select("entity_id", F.lit(1).alias("property"), F.when(F.col("type_name").isNull(), 1).alias("untyped")),
        *([] if types is None else [types.select("entity_id", (F.col("type") == FEATURE).alias("feature"), (F.col("type") == NODE_TYPE).alias("node"))]),
        *([] if segments is None else [segments.filter("class = 'TraversableSegment'").select("entity_id", F.lit(1).alias("segment"))]),
        *([] if found is None else [found.select(F.col("way_id").alias("entity_id"), "node_id")]),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    held = set(rows.columns)
    total = lambda c: (F.coalesce(F.sum(c), F.lit(0)) if c in held else F.lit(0)).cast("long").alias("n_" + c)
    flag = lambda c: (F.coalesce(F.bool_or(c), F.lit(False)) if c in held else F.lit(False)).alias(c)
    ends = F.array_size(F.collect_set("node_id")) if "node_id" in held else F.lit(0)
    return rows.groupBy("entity_id").agg(*map(total, ("point", "shape", "property", "untyped", "segment")), flag("feature"), flag("node"), F.min("wkt").alias("wkt"), ends.alias("n_ends"))


def point_rules(digits: int | None = None, typed: bool = True) -> list[Rule]:
    """Rules on points and the properties of entities; digits: how many an id has."""
    point, n = F.col("n_point") > 0, F.col("n_point")
    number = F.regexp_extract("entity_id", r"([^/]*)$", 1)
    rules = [
        Rule("points exist", point, F.lit(False), least=1, weight=n),
        Rule("point is in the node namespace", point, ~F.col("entity_id").startswith(PREFIXES["osmnode"]), weight=n),
        Rule("id is a number", point, ~number.rlike(r"^\d+$" if digits is None else rf"^\d{{{digits}}}$"), weight=n),
        Rule("point has one geometry, two coordinates", point, (F.col("n_shape") != 1) | ~F.col("wkt").rlike(r"^POINT ?\(\S+ \S+\)$"), weight=n),
    ]
    types = [Rule("point is a feature", point, ~F.col("feature"), weight=n), Rule("point is a node", point, ~F.col("node"), weight=n)]
    return rules + (types if typed else [])


def extremity_rules() -> list[Rule]:
    """Each traversable segment has two distinct extremities."""
    return [Rule("segment has two extremities", F.col("n_segment") > 0, F.col("n_ends") != 2, weight=F.col("n_segment"))]


class _PropertyTyped(Rule):
    """Properties are rows of an entity's: its untyped ones are bad, all count."""

    def counts(self) -> tuple[Column, Column]:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return total("n_untyped"), total("n_property")


def instance_rules(digits: int | None = None, typed: bool = True, segments: bool = True) -> list[Rule]:
    return [*point_rules(digits, typed), _PropertyTyped("property is typed", F.lit(True), F.lit(False)), *(extremity_rules() if segments else [])]
