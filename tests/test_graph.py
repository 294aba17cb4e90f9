import random
from types import SimpleNamespace

import pytest
from geoloom.operators import match, rules
from geoloom.plans import questions, schema
from geoloom.sources import pages
from geoloom.sources import triples as T
from pyspark.sql import functions as F

RDFS = T.PREFIXES["rdfs"]


def graph(spark, rows):
    return spark.createDataFrame([(s, "iri", p, o, "iri", None, None) for s, p, o in rows], ", ".join(f"{c} string" for c in T.COLUMNS))


def test_text_round_trip(spark):
    rows = [("http://a/x", "iri", "http://p/1", 'say "hi"\n\\ \t é', "literal", None, "en"), ("b1", "blank", "http://p/2", "5", "literal", T.XSD + "integer", None), ("http://a/x", "iri", "http://p/3", "b1", "blank", None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in T.COLUMNS))
    for form in ("text", "parquet"):
        path = T.shared_folder(spark)
        T.write_triples(df, path, form)
        assert set(map(tuple, T.read_triples(spark, path, form).collect())) == set(rows)


def test_patterns(spark):
    g = graph(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "q", "c"), ("b", "q", "d")])
    assert {tuple(r) for r in match.matched(g, [("?x", "p", "?y"), ("?y", "q", "?z")]).select("x", "y", "z").collect()} == {("a", "b", "d"), ("b", "c", "c")}
    assert [r.x for r in match.matched(g, [("?x", "q", "?x")]).collect()] == ["c"]
    assert match.match(g, p="p").count() == 2 and match.match(g).count() == 4
    assert match.removed(g, [("b", None, None), (None, "q", "c")]).count() == 1
    assert match.asked(match.match(g, o="x")).first().answer is False


def test_stars(spark):
    """Against all ways to choose a triple for each pattern; subjects with several objects, variables that stand twice."""
    rng = random.Random(3)
    rows = sorted({(f"n{rng.randrange(25)}", rng.choice("pqr"), f"n{rng.randrange(6)}") for _ in range(140)})
    g = graph(spark, [*rows, rows[0]]).unionByName(graph(spark, [(None, "p", "n1"), ("n1", "p", None), ("m", "p", "n1"), ("m", "q", "n2")]))

    def brute(patterns):
        ways = [{}]
        for pattern in patterns:
            nexts = []
            for way in ways:
                for triple in [*rows, ("m", "p", "n1"), ("m", "q", "n2")]:
                    own = dict(way)
                    if all(own.setdefault(t, v) == v if t.startswith("?") else t == v for t, v in zip(pattern, triple)):
                        nexts.append(own)
            ways = nexts
        return sorted({tuple(sorted(x.items())) for x in ways})

    for patterns in (
        [("?s", "p", "?a"), ("?s", "q", "?b")],
        [("?s", "p", "?a"), ("?s", "q", "?b"), ("?s", "r", "n1")],
        [("?s", "p", "?a"), ("?s", "q", "?a")],
        [("?s", "p", "?s"), ("?s", "q", "?b")],
        [("?s", "p", "n1"), ("?s", "q", "n2")],
        [("?s", "p", "?t"), ("?t", "q", "?u"), ("?s", "r", "?v"), ("?t", "p", "n2")],
    ):
        got = [tuple(sorted((f"?{k}", v) for k, v in r.asDict().items())) for r in match.matched(g, patterns).collect()]
        assert sorted(got) == brute(patterns), patterns
    assert match.matched(g.limit(0), [("?s", "p", "?a"), ("?s", "q", "?b")]).count() == 0
    with pytest.raises(ValueError):
        match.matched(g, [("?s", "p", "?a"), ("?x", "q", "?y")])


def test_star_plan(spark):
    """One exchange, and of the table by predicate the files of three predicates alone."""
    path = T.shared_folder(spark)
    T.write_triples(graph(spark, [(f"n{i}", f"p{i % 8}", "o") for i in range(64)]), path)
    stored = T.read_triples(spark, path)
    plan = match.star(stored, [("?s", "p1", "o"), ("?s", "p2", "o"), ("?s", "p3", "o")])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1 and "PartitionFilters: [p#" in plan


def test_closures(spark):
    g = graph(spark, [("A", RDFS + "subClassOf", "B"), ("B", RDFS + "subClassOf", "C"), ("C", RDFS + "subClassOf", "A"), ("p", RDFS + "domain", "D"), ("p", RDFS + "range", "R"), ("p", T.PREFIXES["owl"] + "inverseOf", "q")])
    data = graph(spark, [("x", T.RDF_TYPE, "A"), ("x", "p", "y")])
    types = {(r.s, r.o) for r in match.match(schema.propagated_types(data, g), p=T.RDF_TYPE).collect()}
    assert types == {("x", "A"), ("x", "B"), ("x", "C")}
    assert {(r.s, r.o) for r in match.match(schema.domains_and_ranges(data, g), p=T.RDF_TYPE).collect()} == {("x", "A"), ("x", "D"), ("y", "R")}
    assert {(r.s, r.p, r.o) for r in schema.inverses(data, g).collect()} == {("x", T.RDF_TYPE, "A"), ("x", "p", "y"), ("y", "q", "x")}


def test_long_closure(spark):
    """A chain of 200 classes is complete, and so is a cycle of 30 that a chain leads to."""
    got = {tuple(r) for r in schema.closure(spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(200)], "low string, high string")).collect()}
    assert got == {(f"c{i:03}", f"c{j:03}") for i in range(201) for j in range(i + 1, 201)}
    ring = [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)] + [("a", "b"), ("b", "r0"), ("a", "b"), (None, "a")]
    got = schema.closure(spark.createDataFrame(ring, "low string, high string"))
    assert got.count() == got.distinct().count() == 30 * 30 + 30 + 31
    assert schema.closure(spark.createDataFrame([], "low string, high string")).count() == 0


def test_super_properties(spark):
    g = graph(spark, [("p", RDFS + "subPropertyOf", "q"), ("q", RDFS + "subPropertyOf", "r")])
    assert {(r.s, r.p) for r in schema.propagated_predicates(graph(spark, [("x", "p", "y"), ("z", "r", "y")]), g).collect()} == {("x", "p"), ("x", "q"), ("x", "r"), ("z", "r")}


def test_redirects(spark):
    """A chain of 40, a loop that a chain leads into, a page that leads to itself, a missing target, several spellings; without redirects there is nothing."""
    rows = [(f"p{i}", f"#REDIRECT [[p{i + 1}]]") for i in range(40)] + [("p40", "text"), ("a", "#redirect [[b]]"), ("b", "#Redirect [[c|x]]"), ("c", " #REDIRECT: [[ b ]]"), ("self", "#REDIRECT [[self]]"), ("lost", "#REDIRECT [[nowhere#part]]"), ("plain", "see #REDIRECT [[p1]]"), (None, "x"), ("null", None)]
    frame = spark.createDataFrame(rows, "title string, wikitext string")
    got = {r.title: (r.target, r.steps, r.outcome) for r in pages.resolved(frame).collect()}
    assert got == {f"p{i}": ("p40", 40 - i, "page") for i in range(40)} | {x: (None, None, "loop") for x in ("a", "b", "c", "self")} | {"lost": ("nowhere", 1, "missing")}
    assert pages.resolved(frame.limit(0)).count() == 0


def test_rules(spark):
    points = spark.createDataFrame([(T.PREFIXES["osmnode"] + "12", "SpatialPoint"), ("http://x/y", "SpatialPoint")], "entity_id string, class string")
    shapes = spark.createDataFrame([(T.PREFIXES["osmnode"] + "12", "POINT(1 2)")], "entity_id string, wkt string")
    facts = rules.instance_facts(points, shapes, points.select("entity_id", F.lit("T").alias("type_name")))
    got = {r.rule: r.n_bad for r in rules.counted(facts, rules.instance_rules(typed=False, segments=False)).collect()}
    assert got == {"points exist": 0, "point is in the node namespace": 1, "id is a number": 1, "point has one geometry, two coordinates": 1, "property is typed": 0}
    spaces = {(r.namespace, r.found, r.expected) for r in rules.expected_namespaces(graph(spark, [("http://a/x", "http://p#y", "http://a/z")]), ["http://a/", "http://b/"]).collect()}
    assert spaces == {("http://a/", True, True), ("http://p#", True, False), ("http://b/", False, True)}


def test_long_route(spark):
    """A chain of 20 segments, a shorter walk of the same ends by one segment, and a part that nothing leads to."""
    ends = [(f"w{i:02}", f"n{i}", f"n{i + 1}") for i in range(20)] + [("short", "n3", "n1"), ("away", "x", "y")]
    found = spark.createDataFrame([(w, n) for w, *ns in ends for n in ns], "way_id string, node_id string")
    steps = lambda *at: [r.way_id for r in questions.route(found, *at).orderBy("step").collect()]
    assert steps("n0", "n20", "n19") == ["w00", "short"] + [f"w{i:02}" for i in range(3, 20)] + ["w19"]
    assert steps("n0", "y", "n1") == [] and steps("n2", "n2", "n2") == []


def test_many_routes(spark):
    """A thousand requests over a random network, some of them in parts that nothing joins, against a search for each."""
    rng = random.Random(8)
    ends = [(f"w{i:03}", *rng.sample([f"n{k}" for k in range(60 * part, 60 * part + 60)], 2)) for part in (0, 1) for i in range(90 * part, 90 * part + 90)]
    found = spark.createDataFrame([(w, n) for w, *ns in ends for n in ns], "way_id string, node_id string")
    asked = [(i, *(f"n{rng.randrange(60) + 60 * (rng.random() < 0.3)}" for _ in range(3))) for i in range(1000)]

    def walk(start, goal):
        by, front = {start: None}, [start]
        while front and goal not in by:
            new = {}
            for n in front:
                for w, a, b in ends:
                    for x, y in ((a, b), (b, a)):
                        if x == n and y not in by:
                            new[y] = min(new.get(y, (w, n)), (w, n))
            by |= new
            front = list(new)
        if goal not in by:
            return None
        out = []
        while by[goal]:
            out.append(by[goal][0])
            goal = by[goal][1]
        return out[::-1]

    known = {}
    want = {}
    for i, *at in asked:
        legs = [known.setdefault(pair, walk(*pair)) for pair in (tuple(at[:2]), tuple(at[1:]))]
        if None not in legs and legs[0] + legs[1]:
            want[i] = legs[0] + legs[1]
    got = {}
    for r in questions.routes(found, spark.createDataFrame(asked, "request long, start string, via string, goal string")).orderBy("request", "step").collect():
        got.setdefault(r.request, []).append(r.way_id)
        assert r.step == len(got[r.request])
    assert got == want and 300 < len(want) < 1000


def test_shared_folder():
    """Where no shared folder is named: a temporary one on one machine, an error on a cluster."""
    held = {}
    conf = SimpleNamespace(get=lambda name, default: held.get(name, default), set=held.__setitem__)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        T.shared_folder(session("spark://host:7077"))
    first, second = (T.shared_folder(session("local[2]")) for _ in range(2))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0] == held["spark.checkpoint.dir"]
