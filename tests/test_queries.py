"""Every registered query of the line engine against its SQL, on the smallest tables."""

import pytest

from quire import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, same_rows, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL)


def test_tei_round_trip(spark):
    from quire.sources import testbed

    parsed = {r["line_id"]: (r["text_raw"].strip(), r["juan"], r["work_id"]) for r in queries.QUERIES["tei_parse"](spark, SMALL).collect()}
    lines = {r["line_id"]: (r["text_raw"].strip(), r["juan"], r["work_id"]) for r in testbed.lines(spark, SMALL).collect()}
    assert parsed == lines


def test_script_map(spark):
    rows = {r["text"]: r for r in queries.QUERIES["display_script"](spark, SMALL).collect()}
    assert rows["缘起性空"]["traditional"] == "緣起性空" and rows["缘起性空"]["simplified"] == "缘起性空"


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_pushes_down(spark):
    """Filters sit below the limit, and the scan reads the columns it needs."""
    plan = queries.QUERIES["filter_canon"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "n_chars" not in plan.split("ReadSchema")[-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_verify_similar_is_over_all_lines(spark, tmp_path):
    quote = queries.norm(queries.QUOTE)
    texts = [quote.replace("o", "ö", k) for k in range(1, 4)] + ["Été à la plage, nd of the", "The end of honest was added to the only", "rien", "The nd ñandú reonly"]
    rows = [(i, t, "fr", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(r["line_id"], r["text_norm"]) for r in queries.testbed.lines(spark, str(tmp_path)).collect()]
    want = sorted((-round(1 - distance(t, quote) / max(len(t), len(quote)), 9), i) for i, t in lines)[:5]
    got = [(-r["score"], r["line_id"]) for r in queries.verify_similar(spark, str(tmp_path)).collect()]
    assert got == want and sum("ö" in dict(lines)[i] for _, i in got) == 3
