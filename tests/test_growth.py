"""The graph in buckets: what a second run reads, writes and leaves alone."""

from pathlib import Path

from geoloom.plans import graph
from geoloom.sources import triples as T
from pyspark.sql import functions as F


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_second_run(spark):
    """Of 3,000 entities 1 % change, one leaves, one is new: their buckets alone are rewritten, and an emptied bucket goes."""
    path = T.shared_folder(spark).removeprefix("file://")
    base = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.lit("SpatialPoint").alias("class"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("POINT(0 "), "id", F.lit(")"))).alias("wkt"))
    graph.write_graph(graph.entity_triples(base, "node"), path, n=500)
    before, old = files(path), {tuple(r) for r in graph.read_graph(spark, path).select(*graph.OWNED).collect()}
    assert len(old) == 3000 * 2 + 2400 * 3
    changed = base.filter("cast(substring(entity_id, 2) as int) % 100 = 7").withColumn("wkt", F.lit("POINT(9 9)"))
    new = spark.createDataFrame([("n1", "SpatialPoint", "POINT(1 1)")], "entity_id string, class string, wkt string")
    alone = graph.read_graph(spark, path).groupBy("bucket").agg(F.countDistinct("owner").alias("n"), F.min("owner").alias("owner")).filter("n = 1").orderBy("bucket").first()
    rows = graph.entity_triples(changed.unionByName(new), "node").filter(F.col("owner") != alone.owner)
    owners = rows.select("owner").unionByName(spark.createDataFrame([(alone.owner,)], "owner string"))
    touched = graph.grow(spark, path, owners, rows, n=500)
    after = files(path)
    bucket_of = lambda name: int(name.split("/")[0].removeprefix("bucket="))
    assert len(touched) <= 32 and {bucket_of(f) for f in before.keys() ^ after.keys()} <= set(touched) and all(before[f] == after[f] for f in before.keys() & after.keys())
    assert not Path(f"{path}/bucket={alone.bucket}").exists()
    got, gone = {tuple(r) for r in graph.read_graph(spark, path).select(*graph.OWNED).collect()}, {r.owner for r in owners.collect()}
    assert got == {t for t in old if t[0] not in gone} | {tuple(r) for r in rows.collect()}
    assert graph.grow(spark, path, owners.limit(0), rows, n=500) == []
