"""From wiki pages and tag usage to a glossary of schemes, concepts and combination properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.pages import key_pages, key_usage, tag_pages
from ..sources.triples import PREFIXES, RDF_TYPE, emitted, link, literal, written

ANY = "any"
#: Beginnings of keys that are left out, in lower case.
EXCLUDED_BEGINNINGS = [
    "3d", "advertising", "contact", "cuisine", "editor", "properties", "abutters", "annotation", "kneipp water cure", "line",
    "oslostandarden", "post box design", "references", "repair", "restrictions", "site type", "source:taxon", "tours",
    "traffic calming", "accessories", "archaeological site", "megalith type", "man made", "memorial", "rental", "recycling",
    "vending", "historic", "military", "telecom",
]
#: Keys that are left out, in lower case.
EXCLUDED_KEYS = [
    "addr extra", "airmark", "hazard type", "hazard typology", "place", "name", "geological", "healthcare=blood donation", "addr",
    "cycleway", "door", "healthcare", "leisure", "smoothness", "public transport", "shop", "tracktype", "theatre", "trees", "bus stop",
]


def excluded_key(c: Column) -> Column:
    """Keys of documentation pages, of a language or a niche; judged before blanks become underscores."""
    low = F.lower(c)
    begins = reduce(Column.__or__, [low.startswith(x) for x in EXCLUDED_BEGINNINGS])
    return c.rlike(r"(?iu)(?:examples|tagkeylink|tagvaluelink|/doc\n?\z)") | c.contains(":") | begins | low.isin(EXCLUDED_KEYS)


def relevant_keys(keys: DataFrame, usage: DataFrame, least: int = 100_000) -> DataFrame:
    """(key, n) of the keys that are not excluded and are used more than least times. keys: key, as the wiki spells it."""
    kept = keys.filter(~excluded_key(F.col("key"))).select(text.normal_key(F.col("key")).alias("key")).distinct()
    return kept.join(key_usage(usage).filter(F.col("n") > least), "key")


def frequent_values(usage: DataFrame, least: int = 10_000) -> DataFrame:
    """(key, value) used more than least times, each spelling counted for itself, then trimmed."""
    rows = usage.filter(F.col("n") > least).select("key", F.replace(text.stripped(F.col("value")), F.lit(" "), F.lit("_")).alias("value"))
    return rows.filter("value <> ''").distinct()


def classified_values(values: DataFrame) -> DataFrame:
    return values.withColumns({"reason": text.reject_reason(F.col("value")), "concept_value": text.concept_value(F.col("value"))})


def with_redirects(keys: DataFrame, moved: DataFrame) -> DataFrame:
    """(key): the keys asked for, and those that their pages were returned under. moved: asked, returned."""
    returned = keys.select("key").join(moved, F.col("key") == F.col("asked")).select(F.col("returned").alias("key"))
    return keys.select("key").unionByName(returned).distinct()


def key_data(keys: DataFrame, pages: DataFrame, usage: DataFrame, least: int = 10_000) -> DataFrame:
    """key, description, elements and values of each key."""
    block = text.template_block(F.col("wikitext"), "KeyDescription")
    described = key_pages(pages).groupBy("key").agg(F.min("wikitext").alias("wikitext"))
    raw = F.coalesce(text.stripped(text.parameter_text(block, "description")), F.lit(""))
    described = described.select("key", text.clean_description(text.clean_wikitext(raw)).alias("description"), text.element_kinds(block).alias("elements"))
    values = classified_values(frequent_values(usage, least)).filter("reason is null").groupBy("key").agg(F.array_sort(F.collect_set("concept_value")).alias("values"))
    none = F.array().cast("array<string>")
    out = keys.select("key").join(described, "key", "left").join(values, "key", "left")
    return out.select("key", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("elements", none).alias("elements"), F.coalesce("values", none).alias("values"))


def wanted_tags(keys: DataFrame) -> DataFrame:
    """(key, value) of key_data(); a key without a value has the value any."""
    return keys.select("key", F.explode_outer("values").alias("value")).withColumn("value", F.coalesce("value", F.lit(ANY)))


def value_data(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """key, value, described (there is a page), description and combinations of each wanted tag; without a page the last two are empty."""
    found = tag_pages(pages).join(wanted, ["key", "value"], "left_semi").groupBy("key", "value").agg(F.min("wikitext").alias("wikitext"))
    block = text.template_block(F.col("wikitext"), "ValueDescription")
    description = text.clean_description(text.clean_wikitext(F.coalesce(text.stripped(text.parameter_text(block, "description")), F.lit(""))))
    keys = F.filter(F.transform(text.combination_keys(F.col("wikitext")), text.concept_value), lambda k: k.isNotNull())
    found = found.select("key", "value", F.lit(True).alias("described"), description.alias("description"), keys.alias("combinations"))
    out = wanted.select("key", "value").distinct().join(found, ["key", "value"], "left")
    return out.select("key", "value", F.coalesce("described", F.lit(False)).alias("described"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("combinations", F.array().cast("array<string>")).alias("combinations"))


def coverage(keys: DataFrame, values: DataFrame) -> DataFrame:
    """One row: how many keys have a description, elements and values, and how many tags a description."""
    a = keys.agg(F.count("*").alias("n_keys"), F.count_if(F.col("description") != "").alias("described"), F.count_if(F.size("elements") > 0).alias("with_elements"), F.count_if(F.size("values") > 0).alias("with_values"))
    b = values.agg(F.count("*").alias("n_tags"), F.count_if(F.col("description") != "").alias("described_tags"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def schemes(keys: DataFrame) -> DataFrame:
    key = F.col("key")
    return keys.select(text.camel(key).alias("iri"), key.alias("osm_key"), F.concat(text.natural(key, True), F.lit(", types")).alias("label"), F.col("description").alias("definition"))


def concepts(values: DataFrame) -> DataFrame:
    key, value = text.camel(F.col("key")), F.col("value")
    return values.filter(value != ANY).select(F.concat(key, text.camel(value)).alias("iri"), key.alias("scheme"), value.alias("osm_value"), text.natural(value, True).alias("label"), F.col("description").alias("definition"))


def combination_properties(values: DataFrame) -> DataFrame:
    rows = values.filter(F.col("value") != ANY).select("key", "value", F.explode("combinations").alias("osm_id"))
    value, own = text.camel(F.col("value")), text.camel(F.col("osm_id"))
    name = F.concat(F.lit("has"), value, F.when(own == value, "Type").otherwise(own))
    return rows.select(name.alias("property"), F.concat(text.camel(F.col("key")), value).alias("concept"), "osm_id", text.natural(F.col("osm_id"), True).alias("label"))


def glossary(pages: DataFrame, usage: DataFrame, least_key: int = 100_000, least_value: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole job: schemes, concepts, combination properties."""
    # Each is read by what follows more than once.
    usage = written(usage)
    keys = written(key_data(relevant_keys(key_pages(pages).select("key"), usage, least_key), pages, usage, least_value))
    values = written(value_data(wanted_tags(keys), pages))
    return schemes(keys), concepts(values), combination_properties(values)


def iri_collisions(values: DataFrame) -> DataFrame:
    """IRIs that several tags would get, with how many."""
    iri = F.concat(text.camel(F.col("key")), text.camel(F.col("value")))
    return values.groupBy(iri.alias("iri")).agg(F.countDistinct("key", "value").alias("n")).filter("n > 1")


def lost_names(names: DataFrame) -> DataFrame:
    """(name, camel, back): the names, each once, that do not come back from their camel form. names: name."""
    rows = names.select("name").distinct().withColumn("camel", text.camel(F.col("name")))
    return rows.withColumn("back", text.snake(F.col("camel"))).filter("back <> name")


def scheme_triples(rows: DataFrame) -> DataFrame:
    iri = F.concat(F.lit(PREFIXES["voc"]), F.col("iri"))
    skos = PREFIXES["skos"]
    return emitted(
        rows, link(iri, RDF_TYPE, F.lit(skos + "ConceptScheme")), literal(iri, skos + "prefLabel", F.col("label"), lang="en"),
        literal(iri, skos + "definition", F.col("definition"), lang="en"), literal(iri, PREFIXES["core"] + "osmId", F.col("osm_key")),
    )


def concept_triples(rows: DataFrame) -> DataFrame:
    iri = F.concat(F.lit(PREFIXES["voc"]), F.col("iri"))
    skos = PREFIXES["skos"]
    return emitted(
        rows, link(iri, RDF_TYPE, F.lit(skos + "Concept")), link(iri, PREFIXES["rdfs"] + "subClassOf", F.lit(PREFIXES["core"] + "OsmEntity")),
        literal(iri, skos + "prefLabel", F.col("label"), lang="en"), literal(iri, skos + "definition", F.col("definition"), lang="en"),
        link(iri, skos + "inScheme", F.concat(F.lit(PREFIXES["voc"]), F.col("scheme"))), literal(iri, PREFIXES["core"] + "osmId", F.col("osm_value")),
    )


def property_triples(rows: DataFrame) -> DataFrame:
    core, rdfs = PREFIXES["core"], PREFIXES["rdfs"]
    iri, concept = F.concat(F.lit(core), F.col("property")), F.concat(F.lit(PREFIXES["voc"]), F.col("concept"))
    return emitted(
        rows, link(iri, RDF_TYPE, F.lit(PREFIXES["owl"] + "DatatypeProperty")), link(iri, rdfs + "subPropertyOf", F.lit(PREFIXES["saref"] + "hasValue")),
        literal(iri, rdfs + "label", F.col("label"), lang="en"), link(iri, rdfs + "domain", F.lit(PREFIXES["saref"] + "Property")), link(iri, rdfs + "range", F.lit(rdfs + "Literal")),
        literal(iri, core + "osmId", F.col("osm_id")), link(iri, core + "isOsmTagRelatedTo", concept), link(concept, core + "hasRelatedOsmTag", iri),
    ).distinct()
