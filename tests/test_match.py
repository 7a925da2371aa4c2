"""Predicates against a plain restatement on character places."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.plans import dsl, match


def places(text, term):
    return [(i, i + len(term)) for i in range(len(text) - len(term) + 1) if text[i : i + len(term)] == term]


def chain(text, terms, window):
    def go(k, first, last):
        if k == len(terms):
            return last - first <= window
        return any(go(k + 1, s if first is None else first, e) for s, e in places(text, terms[k]) if first is None or s >= last)

    return go(0, None, None)


def expected(p, text):
    if any(t in text for t in p.excluded):
        return False
    if p.mode in ("near", "before"):
        terms = list(p.terms)
        if len(terms) == 1:
            return terms[0] in text
        if p.ordered:
            return chain(text, terms, p.window)
        if len(terms) == 2:
            return any(max(a[1], b[1]) - min(a[0], b[0]) <= p.window for a in places(text, terms[0]) for b in places(text, terms[1]))
        return any(chain(text, list(o), p.window) for o in permutations(terms))
    if p.mode == "boolean":
        return (any if p.bool_op == "or" else all)(t in text for t in p.terms)
    return all(t in text for t in p.terms) and bool(p.terms[0])


TEXTS = ["", "abab", "aba", "xxabxxxxbaxx", "ab" + "x" * 5 + "cd", "cd" + "x" * 5 + "ab", "ab" + "x" * 20 + "cd", "aaa", "ab\ncd", "abcd", "abcdef ab cd ef", "ef..cd..ab", "a.b(c)d", "月光abc河", "cdabcd", "ab x cd y ef", "ab cd ab ef cd"]
QUERIES = ["ab", "ab+cd", "ab+ba", "ab+ab", "aa+aa", "ab*cd", "ab*cd*ef", "ab+cd+ef", "ef+ab+cd", "ab NEAR/4 cd", "ab NEAR/9 cd", "ab BEFORE/9 cd", "ab NEAR/3 ba", "ab NEAR/2 ab", "ab NEAR/1 ab", "ab&cd", "ab,ef", "ab-cd", "ab NOT ef", "ab NEAR/9 cd NOT ef", "a.b", "b(c", "a?b", "+", "光+河", "ab+", "cd BEFORE/5 ab", "ab BEFORE/8 cd-ef"]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(f"l{i:02}", t, 3 * len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "line_id string, text_norm string, dl int").cache()


@pytest.mark.parametrize("query", QUERIES)
def test_predicate(lines, query):
    norm = (lambda t: t) if query in ("a.b", "b(c") else tx.strip_punct_text
    p = match.plan(dsl.parse(query), norm)
    got = {r["line_id"] for r in lines.where(match.predicate(p, F.col("text_norm"))).collect()}
    assert got == {f"l{i:02}" for i, t in enumerate(TEXTS) if expected(p, t)}


def test_extended_wildcard(lines):
    p = match.plan(dsl.parse("a?c"), tx.strip_punct_text, extended=True)
    assert {r["text_norm"] for r in lines.where(match.predicate(p, F.col("text_norm"))).collect()} == {t for t in TEXTS if any(t[i] == "a" and t[i + 2] == "c" for i in range(len(t) - 2))}


def test_seven_unordered(spark):
    rows = spark.createDataFrame([("gfedcba",), ("g.f.e.d.c.b.a",), ("abcdef",), ("a.......bcdefg",)], "t string")
    found = rows.where(match.within(F.col("t"), list("abcdefg"), 13, False)).collect()
    assert {r["t"] for r in found} == {"gfedcba", "g.f.e.d.c.b.a"}


def test_overlaps():
    assert match.overlaps("aba", "bab", 4) == ["abab", "baba"]
    assert match.overlaps("abc", "b", 9) == ["abc"]
    assert match.overlaps("ab", "ab", 2) == ["ab"] and match.overlaps("ab", "ab", 1) == []


def test_scores_rank_by_rarity_and_length(spark):
    from quire.operators.search import search

    rows = [("a", "moon river", 27), ("b", "moon", 9), ("c", "sun" * 9, 78), ("d", "moon moon", 24)]
    full = spark.createDataFrame(rows, "line_id string, text_norm string, dl int")
    for name in ("work_id", "title", "author", "text_raw", "citation", "tag", "canon"):
        full = full.withColumn(name, F.lit(""))
    hits = search(full.withColumn("juan", F.lit(1)), dsl.parse("moon"), lambda t: t).collect()
    assert [h["line_id"] for h in hits][:2] == ["d", "b"] and hits[-1]["line_id"] == "a"
    assert all(h["score"] > 0 for h in hits)


def test_any_order_of_many_terms():
    """The sets' earliest ends against every order of the terms' places."""
    from itertools import permutations, product

    import numpy as np

    from quire.plans.match import fits

    def slow(text, terms, window):
        places = [[i for i in range(len(text)) if text.startswith(t, i)] for t in terms]
        for order in permutations(range(len(terms))):
            for at in product(*(places[k] for k in order)):
                ends = [a + len(terms[k]) for a, k in zip(at, order, strict=True)]
                if all(e <= b for e, b in zip(ends, at[1:], strict=False)) and ends[-1] - at[0] <= window:
                    return True
        return False

    rng = np.random.default_rng(2)
    seen = set()
    for _ in range(300):
        text = "".join(rng.choice(list("abc"), 12))
        terms = ["".join(rng.choice(list("abc"), rng.integers(1, 3))) for _ in range(4)]
        window = int(rng.integers(3, 10))
        seen.add(slow(text, terms, window))
        assert fits(text, terms, window) == slow(text, terms, window), (text, terms, window)
    assert seen == {True, False}
