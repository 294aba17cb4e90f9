"""Graphs as tables of triples, and their line-oriented text form.

Columns: s, s_kind, p, o, o_kind (iri, blank or literal), datatype, lang. A
graph is a set: merging drops repeated triples.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "datatype", "lang"]
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Prefixes and their namespaces.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": XSD,
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "saref": "https://saref.etsi.org/core/",
    "core": "https://geoloom.example/core#",
    "voc": "https://geoloom.example/vocabulary#",
    "osm": "https://www.openstreetmap.org/",
    "osmnode": "https://www.openstreetmap.org/node/",
    "osmway": "https://www.openstreetmap.org/way/",
}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all machines share, named by spark.checkpoint.dir. Where none is named, as in tests, a temporary one; on a cluster no machine's own folder will do."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read back; the table goes when the application ends."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    rows.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)


def merged(*graphs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, graphs).dropDuplicates()


def lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line for each triple."""
    escaped = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    term = lambda value, kind: F.when(kind == "blank", F.concat(F.lit("_:"), value)).otherwise(F.concat(F.lit("<"), value, F.lit(">")))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), tail)
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(term(F.col("o"), F.col("o_kind")))
    return triples.select(F.concat_ws(" ", term(F.col("s"), F.col("s_kind")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), o, F.lit(".")).alias("value"))


def write_triples(triples: DataFrame, path: str, form: str = "parquet") -> None:
    """As Parquet by predicate, or as N-Triples text."""
    if form == "text":
        lines(triples).write.text(path)
    else:
        triples.select(*COLUMNS).write.partitionBy("p").parquet(path)


def read_triples(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Lines that are no triple (comments, blank lines) are left out."""
    if form == "parquet":
        return spark.read.parquet(path).select(*COLUMNS)
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    s, p, o = part(1), part(2), part(3)
    bare = lambda x: F.when(x.startswith("_:"), F.substr(x, F.lit(3))).otherwise(F.regexp_extract(x, r"^<([^>]*)>$", 1))
    kind = lambda x: F.when(x.startswith("_:"), "blank").when(x.startswith('"'), "literal").otherwise("iri")
    text = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    text = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    found = lambda pattern: F.nullif(F.regexp_extract(o, pattern, 1), F.lit(""))
    literal = kind(o) == "literal"
    return rows.select(
        bare(s).alias("s"),
        kind(s).alias("s_kind"),
        p.alias("p"),
        F.when(literal, text).otherwise(bare(o)).alias("o"),
        kind(o).alias("o_kind"),
        F.when(literal, found(r'"\^\^<([^>]*)>$')).alias("datatype"),
        F.when(literal, found(r'"@([A-Za-z0-9-]+)$')).alias("lang"),
    )


def compact(iri: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """prefix:rest by the longest namespace that fits; other IRIs as they are."""
    out = F.when(F.lit(False), iri)
    for prefix, space in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        out = out.when(iri.startswith(space), F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(space) + 1))))
    return out.otherwise(iri)


def expand(name: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    out = F.when(F.lit(False), name)
    for prefix, space in prefixes.items():
        out = out.when(name.startswith(prefix + ":"), F.concat(F.lit(space), F.substr(name, F.lit(len(prefix) + 2))))
    return out.otherwise(name)


def literal(s: Column, p: str, o: Column, datatype: str | Column | None = None, lang: str | None = None, blank: bool = False) -> Column:
    return F.struct(
        s.alias("s"), F.lit("blank" if blank else "iri").alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"),
        (datatype if isinstance(datatype, Column) else F.lit(datatype).cast("string")).alias("datatype"), F.lit(lang).cast("string").alias("lang"),
    )


def link(s: Column, p: str, o: Column, s_blank: bool = False, o_blank: bool = False) -> Column:
    kinds = {True: "blank", False: "iri"}
    none = F.lit(None).cast("string")
    return F.struct(s.alias("s"), F.lit(kinds[s_blank]).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kinds[o_blank]).alias("o_kind"), none.alias("datatype"), none.alias("lang"))


def emitted(rows: DataFrame, *items: Column) -> DataFrame:
    """The triples of each row; items that are null are left out."""
    return rows.select(F.explode(F.array_compact(F.array(*items))).alias("t")).select("t.*")
