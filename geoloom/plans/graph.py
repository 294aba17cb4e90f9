"""The instance graph as triples, kept in buckets of entities and grown from its earlier state.

Each triple has the entity that it was made for as its owner. A graph's table is
partitioned by a hash of the owner; a later run with changed or new entities
reads and writes the buckets of those alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.triples import COLUMNS, PREFIXES, RDF_TYPE, XSD, written

CORE, GEO, OSM, SAREF, VOC = (PREFIXES[x] for x in ("core", "geo", "osm", "saref", "voc"))
OWNED = ["owner", *COLUMNS]


def _triple(s: Column, p: Column | str, o: Column, s_kind: str = "iri", o_kind: str = "iri", datatype: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), p.alias("p"), o.alias("o"), F.lit(o_kind).alias("o_kind"), (none if datatype is None else datatype).alias("datatype"), none.alias("lang"))


def _owned(rows: DataFrame, owner: str, items: Column) -> DataFrame:
    return rows.select(F.col(owner).alias("owner"), F.explode(F.array_compact(items)).alias("t")).select("owner", "t.*")


def entity_triples(entities: DataFrame, osm_type: str) -> DataFrame:
    """Types and geometry of entities. entities: entity_id, class, wkt; wkt is null for an entity without exactly one geometry. Geometries of points alone are typed, as those of ways are typed by inference."""
    e, shape, wkt = F.col("entity_id"), F.sha2(F.concat_ws("|", "entity_id", F.lit("geometry")), 256), F.col("wkt")
    shaped = lambda t: F.when(wkt.isNotNull(), t)
    items = [
        _triple(e, RDF_TYPE, F.concat(F.lit(CORE), "class")), _triple(e, RDF_TYPE, F.lit(OSM + osm_type)), shaped(_triple(e, GEO + "hasGeometry", shape, o_kind="blank")),
        shaped(_triple(shape, GEO + "asWKT", wkt, "blank", "literal", F.lit(GEO + "wktLiteral"))),
    ]
    if osm_type == "node":
        items.append(shaped(_triple(shape, RDF_TYPE, F.lit(GEO + "Geometry"), "blank")))
    return _owned(entities, "entity_id", F.array(*items))


def property_triples(properties: DataFrame) -> DataFrame:
    """The contextual properties of entities, as plans.instances.contexts() makes them: their type, typed value and attributes."""
    full = lambda datatype: F.replace(datatype, F.lit("xsd:"), F.lit(XSD))
    e, id_ = F.col("entity_id"), F.col("prop_id")
    own = F.array(
        _triple(e, SAREF + "hasProperty", id_, o_kind="blank"), _triple(id_, RDF_TYPE, F.concat(F.lit(VOC), "type_name"), "blank"),
        F.when(F.col("kind") == "literal", _triple(id_, SAREF + "hasValue", F.col("value"), "blank", "literal", full(F.col("datatype")))),
    )
    attributes = F.transform("attrs", lambda a: _triple(id_, F.concat(F.lit(CORE), a["name"]), a["value"], "blank", "literal", full(a["datatype"])))
    return _owned(properties, "entity_id", F.concat(own, attributes))


def extremity_triples(found: DataFrame, contained: DataFrame) -> DataFrame:
    """Links of ways to their extremities (found: way_id, node_id) and back from every node of theirs (contained: node_id, way_id), owned by the way."""
    a = _owned(found, "way_id", F.array(_triple(F.col("way_id"), CORE + "hasExtremity", F.col("node_id"))))
    return a.unionByName(_owned(contained, "way_id", F.array(_triple(F.col("node_id"), CORE + "isExtremityOf", F.col("way_id")))))


def bucketed(rows: DataFrame, n: int) -> DataFrame:
    return rows.select(*OWNED, F.pmod(F.xxhash64("owner"), F.lit(n)).cast("int").alias("bucket"))


def write_graph(rows: DataFrame, path: str, n: int = 64) -> None:
    """A new graph of n buckets. rows: owner and a triple's columns; repeated triples are dropped."""
    bucketed(rows.dropDuplicates(), n).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in OWNED) + ", bucket int").parquet(path)


def grow(spark: SparkSession, path: str, changed: DataFrame, rows: DataFrame, n: int = 64) -> list[int]:
    """The graph with all triples of the changed owners replaced by rows; the buckets that were rewritten. changed: owner, which includes those of rows; owners without rows leave the graph.

    Nothing but the buckets of changed owners is read or written. Their new state
    is written apart first, so that a run that fails leaves the graph as it was
    until each bucket is replaced.
    """
    owners = written(changed.select("owner").distinct().withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(n)).cast("int")))
    touched = sorted(r[0] for r in owners.select("bucket").distinct().collect())  # n at most
    if not touched:
        return []
    before = read_graph(spark, path).filter(F.col("bucket").isin(touched)).join(owners.select("owner"), "owner", "left_anti")
    now = written(before.select(*OWNED, "bucket").unionByName(bucketed(rows.join(owners.select("owner"), "owner", "left_semi").dropDuplicates(), n)))
    full = {r[0] for r in now.select("bucket").distinct().collect()}
    now.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for bucket in set(touched) - full:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return touched
