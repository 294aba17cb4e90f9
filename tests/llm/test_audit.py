import re
from collections import Counter
from itertools import permutations

from geoloom.llm import audit

from .fixtures import rows, split


def brute(docs, labels):
    quality, toxic = {}, {}
    for i, q, t in labels:
        quality[i], toxic[i] = max(quality.get(i, 0), q or 0), max(toxic.get(i, 0), t or 0)
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out, shapley = {}, Counter()
    fails = []
    for i, text, source in docs:
        x, words = text or "", split(text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), "D": bool(re.search("[#$%&*|]", x)), "E": i is not None and least[x] < i}
        fails.append((source or "", {k for k, v in f.items() if v}, i is not None and quality.get(i) == 1, i is not None and toxic.get(i) == 1))
    for part in {f[0] for f in fails}:
        own = [f[1:] for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [f for f in own if x in f[0] and not f[0] & before]
                shapley[part, x] += len(removed)
                out[part, "".join(order), k + 1] = (
                    sum(not f[0] & {*before, x} for f in own), len(removed), sum(x in f[0] and bool(f[0] & before) for f in own), sum(f[0] == {x} for f in own), sum(f[1] for f in removed), sum(f[2] for f in removed),
                )
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def check(spark, docs, labels):
    frame = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    plain = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audited(frame, told).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got} == brute(plain, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in plain})


def test_fixture(spark, docs):
    labels = [(r[0], i % 2, i % 3 // 2) for i, r in enumerate(rows()) if r[0] is not None and i % 4] + [(7, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]
    check(spark, docs, labels)


def test_copies(spark):
    """Copies across parts, of null and empty texts, without an id, repeated rows, and a text of which most rows are copies."""
    docs = [(1, None, None), (2, "", "a"), (3, "", "a"), (3, "", "a"), (None, "", "a"), (4, "A B C", "b"), (9, "A B C", "a"), (4, "A B C", "b"), (None, "x # y", ""), (None, "x # y", "")]
    docs += [(100 + i, "hot " * 300, f"s{i % 3}") for i in range(400)] + [(50, "w" + " w".join(map(str, range(400))), "b"), (51, "w" + " w".join(map(str, range(400))), "b")]
    check(spark, docs, [(i, i % 2, (i + 1) % 2) for i in range(500)])


def test_empty(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(empty, none).count() == 0
    one = spark.createDataFrame([(1, "a", "s", 5, 6, 7)], "doc_id long, text string, source string, mask int, part int, good int")
    assert {r.kept for r in audit.audited(one, none).collect()} == {0, 1}


def test_potentials(spark):
    """Shapley values of a game that is no sum of its players: the first two filters fail one document together, the third is idle."""
    counts = spark.createDataFrame([("p", 3, 1, 0, 0), ("p", 1, 2, 0, 0), ("p", 0, 5, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {r.filter_order[r.step - 1]: r.shapley for r in audit.interactions(counts, "ABC").collect()}
    assert got == {"A": 6 * 2 + 3, "B": 3, "C": 0}


def test_sql(spark):
    """The query against its SQL, with both tables that the SQL reads."""
    import duckdb

    from geoloom.llm import queries

    sf, name, oracle = "/root/testdata/sf0.001", "op12_filter_audit", duckdb.connect()
    for table in ("documents", "labels"):
        oracle.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = oracle.execute(queries.oracle_sql()[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names) and want
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr(list(r)) for r in want)
