"""How often redirects are joined, and how often the tables behind them are read."""

from geoloom.plans.queries import QUERIES
from geoloom.sources import pages


def test_rounds(spark, monkeypatch):
    """600 pages in loops do not make more rounds than the longest chain, of 9, asks for."""
    real, seen = pages.written, []
    monkeypatch.setattr(pages, "written", lambda rows: seen.append(1) or real(rows))
    to = lambda t: f"#REDIRECT [[{t}]]"
    rows = [(f"l{i}", to(f"l{i // 3 * 3 + (i + 1) % 3}")) for i in range(600)] + [("in", to("l5")), ("in2", to("in"))]
    rows += [(f"c{i}", to(f"c{i + 1}")) for i in range(9)] + [("c9", "the end"), ("d", to("nothing"))]
    got = {r.title: (r.target, r.steps, r.outcome) for r in pages.resolved(spark.createDataFrame(rows, "title string, wikitext string")).collect()}
    want = {t: (None, None, "loop") for t, _ in rows if t[0] in "li"} | {f"c{i}": ("c9", 9 - i, "page") for i in range(9)} | {"d": ("nothing", 1, "missing")}
    assert got == want and len(seen) <= 6


def test_usage_read_once(spark):
    rows = QUERIES["redirected_keys"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 3 and "lineitem" not in rows._jdf.queryExecution().toString()
