"""Edge cases of the expressions, with expected values spelled out."""

import time

import pytest
from pyspark.sql import functions as F

from geoloom.functions import text


def applied(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_camel(spark):
    values = ["addr:street", "3d", "2nd_floor", "o'neil", "a__b", "sadales_tīkls", "森a", ""]
    assert applied(spark, text.camel, values) == ["Addr:Street", "3D", "2NdFloor", "O'Neil", "AB", "SadalesTīkls", "森A", ""]
    assert applied(spark, text.camel, values)[:6] == ["".join(w.title() for w in v.split("_")) for v in values[:6]]


def test_names(spark):
    assert applied(spark, lambda c: text.natural(c, True), ["bus_STOP", "a"]) == ["Bus stop", "A"]
    assert applied(spark, text.natural, ["bus_STOP"]) == ["bus STOP"]
    assert applied(spark, text.snake, ["BusStop", "A"]) == ["bus_stop", "a"]
    assert applied(spark, text.is_camel, ["BusStop", "busStop", "Bus_stop"]) == [True, False, False]
    assert applied(spark, text.is_snake, ["bus_stop", "Bus", "a b"]) == [True, False, False]


def test_numbers_dates_colours_mails(spark):
    values = ["12", "1e5", "nan", "inf", "1_000", " 3 ", "1d", "", "1;2", "."]

    def number(v):
        try:
            float(v)
            return True
        except ValueError:
            return False

    assert applied(spark, text.is_number, values) == [number(v) for v in values]
    assert applied(spark, text.is_date, ["2024-1-5", "31.12.2024", "12/31/2024", "24-1-5", "2024-13-01", "x"]) == [True, True, True, False, False, False]
    assert applied(spark, text.is_colour, ["#FFF", "#12ab3", "red", "Red"]) == [True, False, True, False]
    assert applied(spark, text.is_email, ["a@b.org", "a@b"]) == [True, False]


def test_typed(spark):
    got = applied(spark, text.typed, ["yes", "NO", "1", "1.5", "[1,2]", "1;2", " +007 "])
    assert [(r.value, r.datatype) for r in got] == [
        ("true", "xsd:integer"), ("false", "xsd:integer"), ("1", "xsd:integer"), ("1.5", "xsd:float"), ("[1,2]", "xsd:string"), ("1;2", "xsd:string"), ("7", "xsd:integer"),
    ]
    assert applied(spark, lambda c: text.typed(c, fixed=True), ["yes"])[0].datatype == "xsd:boolean"


@pytest.mark.parametrize(
    ("value", "reason", "spelled"),
    [
        ("casino", "yes or no", None), ("12_a", "number", None), ("a_b_c", "many words", None), ("red", "colour", None), ("1st_x", "ordinal", None), ("a;b", "special character", None),
        ("vending_machine", None, "vending_machine"), ("mcdonald's", None, "mcdonalds"), ("a.b", None, "a_b"), ("8:00", "local or hour", None), ("httpx", "link", None), ("no openinghours", None, "OpeningHours"),
    ],
)
def test_concepts(spark, value, reason, spelled):
    assert applied(spark, text.reject_reason, [value]) == [reason]
    assert applied(spark, text.concept_value, [value]) == [spelled]


def test_wiki(spark):
    page = "x {{ValueDescription\n|description=A <!-- c --> [[Key:a|b]] ''it'' <ref>r</ref>\nmore\n|combination={{Tag|capacity}} {{tag|fee|yes}} {{Key|level}}\n}}\n== Tags used in combination ==\n* {{Tag|opening hours|x}} {{Tag|fee}}\n== Other ==\n{{Tag|no}}"
    block = lambda c: text.template_block(c, "ValueDescription")
    assert applied(spark, lambda c: text.clean_wikitext(text.template_parameter(block(c), "description")), [page]) == ["A b it more"]
    assert applied(spark, text.combination_keys, [page, "", None]) == [["capacity", "fee", "level", "opening_hours"], [], []]
    assert applied(spark, lambda c: text.template_parameter(block(c), "combination"), ["{{ValueDescription|a=b|combination=last\n}}"]) == ["last"]
    assert applied(spark, block, ["none", None]) == [None, None]
    assert applied(spark, text.clean_description, ["See also x. {{Tag|a|b}} and {{tag|c}} {{Prefix|p}}"]) == [" a=b and c p"]
    assert applied(spark, text.element_kinds, ["|onNode=yes\n|onWay=no\n|onArea=recommended\n"]) == [["SpatialPoint", "SpatialRegion"]]


def test_long_page(spark):
    """A page of 100,000 words without a full stop, one with a full stop after each word, and one with as many blanks, in time in proportion to their length."""
    words = " ".join(f"w{i}" for i in range(100_000))
    texts = [words, words + " see also this", words + " see also this. After", words.replace(" ", ". ") + ". See the page x. End", "a" + " " * 200_000 + "b. See page y. c"]
    pages = [("{{ValueDescription\n|description=" + t + "\n|combination={{Tag|fee}}\n}}", t) for t in texts]
    block = text.template_block(F.col("page"), "ValueDescription")
    began = time.time()
    rows = spark.createDataFrame(pages, "page string, t string").select(text.clean_description(text.clean_wikitext(text.template_parameter(block, "description"))).alias("d"), text.combination_keys(F.col("page")).alias("k")).collect()
    assert time.time() - began < 30
    assert [r.d for r in rows] == [words, words + " see also this", " After", words.replace(" ", ". ") + ". End", "a b. c"]
    assert all(r.k == ["fee"] for r in rows)


def test_parameters(spark):
    """What a parameter ends with: the next one's line, the template's end, the text's end; one in the same line goes on."""
    cases = [
        ("{{KeyDescription\n|description=a\nb\n| key = c\n}} d", "a\nb", "c"), ("{{KeyDescription|description=x|key=y}} z }}", "x|key=y", "y"), ("{{KeyDescription\n|description=\n|key=k\n}}", "|key=k", "k"),
        ("no template", None, None), ("{{KeyDescription", None, None), ("{{keydescription |DESCRIPTION = v {{Tag|a|b=c}}\n}}", "v {{Tag|a|b=c}}", None), ("{{KeyDescription\n}}", None, None),
    ]
    block = text.template_block(F.col("page"), "KeyDescription")
    got = spark.createDataFrame([(c[0],) for c in cases], "page string").select("page", text.template_parameter(block, "description").alias("d"), text.template_parameter(block, "key").alias("k")).collect()
    assert {r.page: (r.d, r.k) for r in got} == {c[0]: c[1:] for c in cases}
