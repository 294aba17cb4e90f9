"""From tagged entities to typed ones with contextual properties.

tags: entity_id, key, value, ord. schemes: iri, osm_key. concepts: iri, scheme,
osm_value. tuics: property, concept, osm_id. The vocabulary is small and left
to be broadcast by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.match import at_most, last_values, only_one

ATTR = "struct<name:string,local:string,value:string,datatype:string>"
PROPERTY = f"struct<ord:int,key:string,type_name:string,kind:string,value:string,datatype:string,attrs:array<{ATTR}>,alive:boolean>"


def classified(tags: DataFrame) -> DataFrame:
    """tags with scheme_name, concept_name and whether the value is one to be a concept."""
    literal = F.col("value").contains(" ") | text.reject_reason(F.col("value")).isNotNull()
    return tags.withColumns({
        "scheme_name": text.camel(F.col("key")), "concept_name": F.concat(text.camel(F.col("key")), text.camel(F.col("value"))), "conceptual": ~literal,
    })


def literal_contexts(tags: DataFrame, schemes: DataFrame) -> DataFrame:
    """Values kept as they are, typed, of the keys that are schemes."""
    rows = classified(tags).filter(~F.col("conceptual")).join(schemes.select(F.col("iri").alias("scheme_name")).distinct(), "scheme_name")
    return rows.withColumn("typed_", text.typed(F.col("value"))).select("entity_id", "ord", "key", F.col("scheme_name").alias("type_name"), "typed_.value", "typed_.datatype", "typed_.num")


def concept_contexts(tags: DataFrame, concepts: DataFrame) -> DataFrame:
    rows = classified(tags).filter("conceptual").join(concepts.select(F.col("iri").alias("concept_name")).distinct(), "concept_name")
    return rows.select("entity_id", "ord", "key", "value", F.col("concept_name").alias("type_name"))


def unknown_concepts(tags: DataFrame, concepts: DataFrame) -> DataFrame:
    """How often each concept that the vocabulary lacks was asked for."""
    rows = classified(tags).filter("conceptual").join(concepts.select(F.col("iri").alias("concept_name")), "concept_name", "left_anti")
    return rows.groupBy(F.col("concept_name").alias("concept")).agg(F.count("*").alias("n"))


def first_ids(tuics: DataFrame) -> DataFrame:
    """The tag of each combination property of a concept; of several the smallest."""
    ids = tuics.groupBy("property").agg(F.min("osm_id").alias("osm_id"))
    return tuics.select("property", "concept").distinct().join(ids, "property")


def combined(tags: DataFrame, concepts: DataFrame, tuics: DataFrame) -> DataFrame:
    """Attributes of each concept context: entity_id, ord, and the tag used in combination with its predicate name and typed value."""
    owners = concept_contexts(tags, concepts).withColumnRenamed("value", "owner_value").withColumnRenamed("key", "owner_key")
    known = first_ids(tuics).select(F.col("concept").alias("type_name"), F.col("osm_id").alias("key")).distinct()
    rows = owners.join(known, "type_name").join(last_values(tags), ["entity_id", "key"])
    local = F.when(F.col("key") == F.col("owner_value"), "Type").otherwise(text.camel(F.col("key")))
    name = F.concat(F.lit("has"), text.camel(F.col("owner_key")), text.camel(F.col("owner_value")), local)
    return rows.withColumn("typed_", text.typed(F.col("value"))).select("entity_id", "ord", "type_name", local.alias("local"), name.alias("name"), "typed_.value", "typed_.datatype", "typed_.num")


def _step(done: Column, x: Column, canonical: bool) -> Column:
    suppressed = (x["kind"] == "concept") & F.exists(done, lambda p: p["alive"] & F.exists(p["attrs"], lambda a: F.endswith(a["name"], text.camel(x["key"]))))
    alive = lambda p: p["alive"] & ~F.exists(x["attrs"], lambda a: a["local"] == p["type_name"])
    fields = ("ord", "key", "type_name", "kind", "value", "datatype", "attrs")
    added = F.transform(F.concat(done, F.array(x)), lambda p: F.struct(*[p[c].alias(c) for c in fields], alive(p).alias("alive")))
    return F.when(suppressed, done).otherwise(added)


def contexts(tags: DataFrame, schemes: DataFrame, concepts: DataFrame, tuics: DataFrame, canonical: bool = False) -> DataFrame:
    """The properties of each entity: entity_id, prop_id, ord, key, type_name, kind, value, datatype, attrs.

    The tags of an entity are read in their order. A concept is left out if an
    attribute of an earlier property already tells it; a concept's attribute
    takes away the properties of its name that came before. canonical makes this
    independent of the order: concepts come first, by name.
    """
    none = F.array().cast(f"array<{ATTR}>")
    attrs = combined(tags, concepts, tuics).groupBy("entity_id", "ord", "type_name")
    attrs = attrs.agg(F.array_sort(F.collect_list(F.struct("name", "local", "value", "datatype"))).alias("attrs"))
    owners = concept_contexts(tags, concepts).join(attrs, ["entity_id", "ord", "type_name"], "left")
    nothing = F.lit(None).cast("string")
    rows = owners.select("entity_id", F.struct("ord", "key", "type_name", F.lit("concept").alias("kind"), nothing.alias("value"), nothing.alias("datatype"), F.coalesce("attrs", none).alias("attrs"), F.lit(True).alias("alive")).cast(PROPERTY).alias("p"))
    plain = literal_contexts(tags, schemes)
    rows = rows.unionByName(plain.select("entity_id", F.struct("ord", "key", "type_name", F.lit("literal").alias("kind"), "value", "datatype", none.alias("attrs"), F.lit(True).alias("alive")).cast(PROPERTY).alias("p")))
    place = F.struct(-F.size("p.attrs"), F.col("p.kind"), F.col("p.type_name")) if canonical else F.struct(F.col("p.ord"), F.col("p.kind"), F.col("p.type_name"))
    listed = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "p"))).alias("l")).select("entity_id", F.transform("l", lambda x: x["p"]).alias("l"))
    if canonical:  # an attribute takes away the literal of its name, wherever it stands
        taken = F.flatten(F.transform("l", lambda p: F.transform(p["attrs"], lambda a: a["local"])))
        listed = listed.withColumn("l", F.filter("l", lambda p: (p["kind"] != "literal") | ~F.array_contains(taken, p["type_name"])))
    folded = F.aggregate("l", F.array().cast(f"array<{PROPERTY}>"), lambda done, x: _step(done, x, canonical).cast(f"array<{PROPERTY}>"))
    out = listed.select("entity_id", F.explode(F.filter(folded, lambda p: p["alive"])).alias("p"))
    return out.select("entity_id", F.sha2(F.concat_ws("|", "entity_id", "p.ord", "p.type_name"), 256).alias("prop_id"), "p.ord", "p.key", "p.type_name", "p.kind", "p.value", "p.datatype", "p.attrs")


def attributes(properties: DataFrame) -> DataFrame:
    return properties.select("entity_id", "prop_id", "type_name", F.explode("attrs").alias("a")).select("entity_id", "prop_id", "type_name", "a.name", "a.value", "a.datatype")


def geometries(raw: DataFrame) -> DataFrame:
    """(geometry, wkt) of the geometries that have exactly one WKT."""
    return only_one(raw, "geometry", "wkt")


def points(nodes: DataFrame) -> DataFrame:
    return nodes.select("entity_id", F.lit("SpatialPoint").alias("class"), "wkt")


def segment_class(wkt: Column) -> Column:
    return F.when(wkt.contains("POLYGON"), "TopologicalSegment").when(wkt.contains("LINESTRING"), "TraversableSegment").otherwise("SpatialSegment")


def segments(ways: DataFrame) -> DataFrame:
    return ways.select("entity_id", segment_class(F.col("wkt")).alias("class"), "wkt")


def extremities(way_nodes: DataFrame, ways: DataFrame, nodes: DataFrame, exact_text: bool = True) -> DataFrame:
    """(way_id, node_id, ord) of the at most two nodes of a line whose coordinates are its first or last.

    Coordinates are compared as text, blanks included; exact_text=False compares
    them trimmed.
    """
    inner = lambda c, word: F.regexp_replace(F.replace(c, F.lit(word), F.lit("")), r"[()]", "")
    spell = (lambda c: c) if exact_text else (lambda c: F.regexp_replace(F.trim(c), r"\s+", " "))
    ends = F.split(inner(F.col("wkt"), "LINESTRING"), ",")
    lines = ways.filter(F.col("wkt").contains("LINESTRING") & ~F.col("wkt").contains("POLYGON")).select(F.col("entity_id").alias("way_id"), spell(F.element_at(ends, 1)).alias("head"), spell(F.element_at(ends, -1)).alias("tail"))
    own = nodes.select(F.col("entity_id").alias("node_id"), spell(inner(F.col("wkt"), "POINT")).alias("at"))
    hits = way_nodes.join(lines, "way_id").join(own, "node_id").filter((F.col("at") == F.col("head")) | (F.col("at") == F.col("tail")))
    once = hits.groupBy("way_id", "node_id").agg(F.min("ord").alias("ord"))
    return at_most(once, 2, ["way_id"], ["ord", "node_id"])


def extremity_of(way_nodes: DataFrame, found: DataFrame, mode: str = "reference") -> DataFrame:
    """(node_id, way_id): every node of a way, or with inverse_only the inverse of its extremities."""
    return (way_nodes if mode == "reference" else found).select("node_id", "way_id").distinct()
