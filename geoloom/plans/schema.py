"""What a schema's axioms add to a graph, and how one schema follows from another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import match, removed
from ..sources.triples import COLUMNS, PREFIXES, RDF_TYPE, merged, written

RDFS = PREFIXES["rdfs"]


#: The upper schema: each class with the class above it, a label and a comment in English and in French.
CLASSES = {
    "SpatialEntity": (None, ("spatial entity", "Anything with a place."), ("entité spatiale", "Ce qui a un lieu.")),
    "SpatialPoint": ("SpatialEntity", ("spatial point", "An entity at one position."), ("point spatial", "Une entité en une position.")),
    "SpatialSegment": ("SpatialEntity", ("spatial segment", "An entity along a way."), ("segment spatial", "Une entité le long d'une voie.")),
    "TraversableSegment": ("SpatialSegment", ("traversable segment", "A segment that leads from one end to another."), ("segment traversable", "Un segment qui mène d'un bout à l'autre.")),
    "TopologicalSegment": ("SpatialSegment", ("topological segment", "A segment that encloses an area."), ("segment topologique", "Un segment qui entoure une surface.")),
    "OsmEntity": (None, ("map entity", "Anything that a tag tells of."), ("entité de la carte", "Ce qu'une balise décrit.")),
}
#: Its properties, with their type, and the domain and range of those that have them.
PROPERTIES = {
    "hasExtremity": ("ObjectProperty", "SpatialSegment", "SpatialPoint"), "isExtremityOf": ("ObjectProperty", None, None), "hasRelatedOsmTag": ("ObjectProperty", None, None),
    "isOsmTagRelatedTo": ("ObjectProperty", None, None), "osmId": ("DatatypeProperty", None, None),
}
INVERSES = [("hasExtremity", "isExtremityOf"), ("hasRelatedOsmTag", "isOsmTagRelatedTo")]


def upper(spark: SparkSession) -> DataFrame:
    """The upper schema as triples."""
    core, owl = PREFIXES["core"], PREFIXES["owl"]
    links, texts = [], []
    for name, (above, *told) in CLASSES.items():
        links += [(name, RDF_TYPE, owl + "Class")] + ([(name, RDFS + "subClassOf", core + above)] if above else [])
        texts += [(name, RDFS + part, value, lang) for lang, both in zip(("en", "fr"), told, strict=True) for part, value in zip(("label", "comment"), both, strict=True)]
    for name, (type_, domain, range_) in PROPERTIES.items():
        links += [(name, RDF_TYPE, owl + type_)] + [(name, RDFS + p, core + o) for p, o in (("domain", domain), ("range", range_)) if o]
    links += [(a, owl + "inverseOf", core + b) for a, b in INVERSES]
    rows = [(core + s, "iri", p, o, "iri", None, None) for s, p, o in links] + [(core + s, "iri", p, o, "literal", None, lang) for s, p, o, lang in texts]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def closure(pairs: DataFrame) -> DataFrame:
    """(low, high) of all pairs reached by one step or more, however many; cycles end when nothing is new. pairs: low, high.

    A round joins what the last one added with all that is reached, on either
    side, so the length of the paths that are known doubles and no pair is made
    from old ones again. Each round is written: plans and lineage stay short.
    """
    new = written(pairs.select("low", "high").filter("low is not null and high is not null").distinct())
    parts = [new]
    while not new.isEmpty():
        reached = reduce(DataFrame.unionByName, parts)
        ahead = new.alias("a").join(reached.alias("b"), F.col("a.high") == F.col("b.low")).select("a.low", "b.high")
        behind = reached.alias("a").join(new.alias("b"), F.col("a.high") == F.col("b.low")).select("a.low", "b.high")
        new = written(ahead.unionByName(behind).distinct().join(reached, ["low", "high"], "left_anti"))
        parts.append(new)
    return reduce(DataFrame.unionByName, parts)


def axioms(triples: DataFrame, predicate: str) -> DataFrame:
    return match(triples, p=predicate).select(F.col("s").alias("low"), F.col("o").alias("high"))


def propagated_types(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """triples and the types that sub-classes give."""
    up = closure(axioms(schema, RDFS + "subClassOf"))
    types = match(triples, p=RDF_TYPE)
    more = types.join(up, types.o == up.low).withColumn("o", F.col("high")).select(*COLUMNS)
    return merged(triples.select(*COLUMNS), more)


def propagated_predicates(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """triples and those that super-properties give."""
    up = closure(axioms(schema, RDFS + "subPropertyOf"))
    more = triples.join(up, triples.p == up.low).withColumn("p", F.col("high")).select(*COLUMNS)
    return merged(triples.select(*COLUMNS), more)


def inverses(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """triples and the links that inverse predicates give, either way."""
    pairs = axioms(schema, PREFIXES["owl"] + "inverseOf")
    pairs = pairs.unionByName(pairs.select(F.col("high").alias("low"), F.col("low").alias("high"))).distinct()
    more = triples.filter("o_kind <> 'literal'").join(pairs, triples.p == pairs.low)
    none = F.lit(None).cast("string")
    more = more.select(F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), F.col("high").alias("p"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    return merged(triples.select(*COLUMNS), more)


def domains_and_ranges(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """triples and the types that domains give to subjects and ranges to objects that are no literals."""
    none = F.lit(None).cast("string")
    typed = lambda rows, s, kind: rows.select(F.col(s).alias("s"), F.col(kind).alias("s_kind"), F.lit(RDF_TYPE).alias("p"), F.col("high").alias("o"), F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    domain, range_ = axioms(schema, RDFS + "domain"), axioms(schema, RDFS + "range")
    a = typed(triples.join(domain, triples.p == domain.low), "s", "s_kind")
    b = typed(triples.filter("o_kind <> 'literal'").join(range_, triples.p == range_.low), "o", "o_kind")
    return merged(triples.select(*COLUMNS), a, b)


def evolved(schema: DataFrame, added: DataFrame, taken: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """The next schema: what matches a pattern of taken goes, then added comes."""
    return merged(removed(schema, taken).select(*COLUMNS), added.select(*COLUMNS))
