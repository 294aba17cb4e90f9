"""The ordered reading of an entity's tags against a sequential model."""

import random

from geoloom.plans import instances

SCHEMES = ["Amenity", "Capacity", "Cuisine", "Name", "Fee", "Level"]
CONCEPTS = {"AmenityCafe": ["cuisine", "fee"], "AmenityBench": ["capacity"], "CuisinePizza": ["name"], "FeeDonation": [], "BuildingHall": ["name", "level"]}
VALUES = ["cafe", "bench", "pizza", "donation", "hall", "yes", "12", "two words", "drinks"]


def camel(s):
    return "".join(w.title() for w in s.split("_"))


def model(tags):
    """tags: (key, value) in order, keys distinct."""
    kept = []
    for key, value in tags:
        if " " in value or value in ("yes", "12"):
            if camel(key) in SCHEMES:
                kept.append({"type": camel(key), "attrs": []})
            continue
        name = camel(key) + camel(value)
        if name not in CONCEPTS or any(a.endswith(camel(key)) for p in kept for a in p["attrs"]):
            continue
        found = [k for k, _ in tags if k in CONCEPTS[name]]
        local = {k: "Type" if k == value else camel(k) for k in found}
        kept.append({"type": name, "attrs": ["has" + name + local[k] for k in found]})
        kept = [p for p in kept if p["type"] not in local.values()]
    return sorted(p["type"] for p in kept)


def test_fold(spark):
    rng = random.Random(7)
    keys = ["amenity", "capacity", "cuisine", "name", "fee", "level", "building"]
    entities = {f"e{i}": [(k, rng.choice(VALUES)) for k in rng.sample(keys, rng.randint(1, 6))] for i in range(300)}
    rows = [(e, k, v, i) for e, tags in entities.items() for i, (k, v) in enumerate(tags)]
    tags = spark.createDataFrame(rows, "entity_id string, key string, value string, ord int")
    schemes = spark.createDataFrame([(s, s.lower()) for s in SCHEMES], "iri string, osm_key string")
    concepts = spark.createDataFrame([(c, "", "") for c in CONCEPTS], "iri string, scheme string, osm_value string")
    tuics = spark.createDataFrame([(f"has{c}{camel(k)}", c, k) for c, ks in CONCEPTS.items() for k in ks], "property string, concept string, osm_id string")
    got = {e: [] for e in entities}
    for r in instances.contexts(tags, schemes, concepts, tuics).collect():
        got[r.entity_id].append(r.type_name)
    assert {e: sorted(v) for e, v in got.items()} == {e: model(t) for e, t in entities.items()}


def test_canonical_does_not_depend_on_order(spark):
    schemes = spark.createDataFrame([("Capacity", "capacity")], "iri string, osm_key string")
    concepts = spark.createDataFrame([("AmenityBench", "", "")], "iri string, scheme string, osm_value string")
    tuics = spark.createDataFrame([("p", "AmenityBench", "capacity")], "property string, concept string, osm_id string")
    rows = [("a", "capacity", "12", 1), ("a", "amenity", "bench", 2), ("b", "amenity", "bench", 1), ("b", "capacity", "12", 2)]
    tags = spark.createDataFrame(rows, "entity_id string, key string, value string, ord int")
    read = lambda **how: {(r.entity_id, r.type_name) for r in instances.contexts(tags, schemes, concepts, tuics, **how).collect()}
    assert read() == {("a", "AmenityBench"), ("b", "AmenityBench"), ("b", "Capacity")}
    assert read(canonical=True) == {("a", "AmenityBench"), ("b", "AmenityBench")}


def test_extremities(spark):
    nodes = spark.createDataFrame([("n1", "POINT(1 2)"), ("n2", "POINT(3 4)"), ("n3", "POINT(5 6)")], "entity_id string, wkt string")
    ways = spark.createDataFrame([("w1", "LINESTRING(1 2,5 6,3 4)"), ("w2", "LINESTRING(1 2, 3 4)"), ("w3", "POLYGON((1 2,3 4,5 6,1 2))"), ("w4", "LINESTRING(1 2,3 4,1 2)")], "entity_id string, wkt string")
    held = spark.createDataFrame([(w, n, i) for w in ("w1", "w2", "w3", "w4") for i, n in enumerate(("n1", "n2", "n3"))], "way_id string, node_id string, ord int")
    got = lambda **how: {(r.way_id, r.node_id) for r in instances.extremities(held, ways, nodes, **how).collect()}
    assert got() == {("w1", "n1"), ("w1", "n2"), ("w2", "n1"), ("w4", "n1")}
    assert got(exact_text=False) == got() | {("w2", "n2")}
