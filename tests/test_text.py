import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_search_key(spark):
    script = tx.script_map(spark, "Hans-Hant")
    for raw in ("莲华，色！", "Ａｂ（c）", "", "「为」缘"):
        assert one(spark, raw, lambda c: tx.search_key(c, script)) == tx.search_key_text(raw, script)
    assert tx.search_key_text("为，缘", script) == "為緣"
    assert tx.search_key_text("Ａ？b-c", {}) == "Ab-c"
    assert tx.search_key_text("x&G1;y", {}, {"&G1;": "字"}) == "x字y"
    assert tx.resolve_gaiji({}, "CB1") == "□"


@pytest.mark.parametrize(("text", "n", "out"), [("abcd", 1, list("abcd")), ("abcd", 2, ["ab", "bc", "cd"]), ("abcd", 3, ["abc", "bcd"]), ("a", 2, []), ("", 1, []), ("月a河", 2, ["月a", "a河"])])
def test_grams(spark, text, n, out):
    assert one(spark, text, lambda c: tx.grams(c, n)) == out


def test_grams_of_quote():
    assert tx.grams_of("ab", 3) == ["ab"] and tx.grams_of("", 2) == [] and tx.grams_of("aaa", 2) == ["aa", "aa"]


@pytest.mark.parametrize(
    ("line_id", "tag", "out"),
    [
        ("A12n0345_p0268b21", "2026R2", "(L 2026.R2, A12, no. 0345, p. 268, b21)"),
        ("A12n0345_p0000a01", "2026", "(L 2026, A12, no. 0345, p. 0, a01)"),
        ("A12n0345", "R2", "(L R2, A12n0345)"),
        ("A12n0345_p0268", "2026R2", "(L 2026.R2, A12n0345_p0268)"),
        ("plain_p0268b21", "2026R2", "(L 2026.R2, plai, no. , p. 268, b21)"),
        ("pla_p0268b21", "2026R2", "(L 2026.R2, pla_p0268b21)"),
    ],
)
def test_citation(spark, line_id, tag, out):
    assert one(spark, line_id, lambda c: tx.citation(c, F.lit(tag), "L")) == out


def test_ids(spark):
    for xml_id, work in (("T30n1578", "T1578"), ("X01n0001a", "X0001a"), ("abc", "abc"), ("GA009n0008", "GA0008")):
        assert tx.work_of_text(xml_id) == work
        assert one(spark, xml_id, tx.work_of) == work
    assert one(spark, "GA0008", tx.canon_of) == "GA"


def test_occurrences_overlap(spark):
    assert one(spark, "aaaa", lambda c: tx.occurrences(c, "aa")) == 3
    assert one(spark, "a.b a.b", lambda c: tx.occurrences(c, "a.b")) == 2
    assert one(spark, "aaaa", lambda c: tx.starts(c, "aa")) == [0, 1, 2]


def test_small_functions(spark):
    assert one(spark, "kitten", lambda c: F.round(tx.similarity(c, F.lit("sitting")), 6)) == round(1 - 3 / 7, 6)
    assert one(spark, "abc", lambda c: tx.highlighted(c, ["z", "b"])) == "a[b]c"
    assert one(spark, "2026R10", lambda c: tx.release_order(c)["revision"]) == 10
    assert one(spark, "x", lambda c: tx.utc_text(F.lit(0))) == "1970-01-01T00:00:00Z"
    assert one(spark, "x", lambda c: tx.covering_span(F.lit(2), F.lit(4), F.lit(7), F.lit(9))) == 7
