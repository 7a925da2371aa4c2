"""Operators against brute force, and what each does with odd input."""

import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import language_model, line_dedup, mixing, nearest, ngram_join, packing, personal, quotation, toxicity, vector_dedup, words
from quire.llm.common import components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the same words again and again and again here\nshort\nshort", "en", "s1", 3), (1, "the same words again and again and again here\nshort\nshort", "en", "s1", 3),
    (2, None, None, None, None), (3, "", "en", "s2", 0), (4, " \t\n ", "en", "s2", 4), (None, "no id here\nat all", "fr", None, 1), (5, "word " * 30_000, "en", "s1", 5),
    (6, "x" * 100_000, "de", "s3", 6), (7, "the same words again and again and again here now", "en", "s1", 3), (8, "a@b.c 1.2.3.4 émoji 🙂", "en", "s1", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("size", F.lit(1)).withColumn("key", F.lit("k"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def groups(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- shared ---------------------------------------------------------------------


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (30, 30)] + [(i, i + 1) for i in range(100, 140)]
    ids = sorted({i for e in links for i in e} | {50})
    found = components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component_id"] for r in found.collect()} == groups(links, ids)
    assert components(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "a long, b long")).collect()[0]["component_id"] == 1


def test_words():
    import pyarrow as pa

    column = pa.array(["Ab cd\tab", None, "", "  AB  ", "é ab\x0bcd", "abcd"])
    first, end, data, offsets = next(words.chunks(column))
    hashes, start, stop, rows = words.hashed(data, offsets)
    named = [bytes(data[a:b]).lower() for a, b in zip(start, stop, strict=True)]
    assert named == [b"ab", b"cd", b"ab", b"ab", "é".encode(), b"ab", b"cd", b"abcd"] and rows.tolist() == [0, 3, 3, 3, 4, 7, 8]
    assert len({(n, h) for n, h in zip(named, hashes.tolist(), strict=True)}) == len(set(named)) == len(set(hashes.tolist()))
    index = words.Index(np.sort(np.unique(hashes)))
    assert (index.keys[index.find(hashes)] == hashes).all() and index.find(np.array([5], np.uint64))[0] == -1
    assert sum(e - f for f, e, _, _ in words.chunks(pa.array(["x" * 900] * 9), 2000)) == 9


# -- 1 line dedup -----------------------------------------------------------------


def lines_kept(rows, percent=80):
    seen, out = [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in text.split("\n"):
            tokens = frozenset(x for x in line.split(" ") if x)
            if tokens:
                again = any(100 * len(tokens & s) >= percent * len(tokens | s) for s in seen if len(s) * 100 >= percent * len(tokens) and len(tokens) * 100 >= percent * len(s))
                seen.append(tokens)
                if again:
                    continue
            kept.append(line)
        out[key] = "\n".join(kept)
    return out


def test_line_dedup(docs, texts):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs.select("doc_id", "text")).collect()}
    assert got == lines_kept(texts.items())


def test_line_dedup_near_lines(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(120):
        line = list(base)
        for j in rng.choice(24, rng.integers(0, 6), replace=False):
            line[j] = f"n{rng.integers(0, 12)}"
        rows.append((i, " ".join(line[: rng.integers(1, 25)])))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_kept(rows)


def test_line_dedup_odd(odd, none):
    rows = line_dedup.dedup(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(rows) == len(ODD) and [r["text"] for r in by[1]] == ["the same words again and again and again here\nshort"] * 2
    assert by[2][0]["text"] is None and by[2][0]["n_lines"] == 0 and by[3][0]["text"] == "" and by[4][0]["n_removed"] == 0
    assert by[7][0]["text"] == "" and by[None][0]["n_lines"] == 2 and rows[0]["key"] == "k"
    assert line_dedup.dedup(none).count() == 0


# -- 2 mixing ---------------------------------------------------------------------


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 700, "e": 0, None: 50}
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2, 3, 1, 2], strict=True))
    want, left, total = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while True:  # share, cap, share the excess again
        rest = total - sum(2 * sizes[s] for s in sizes if s not in left)
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            break
        left -= over
    want = {s: share[s] if s in left else 2.0 * sizes[s] for s in sizes}
    assert found.keys() == want.keys() and all(math.isclose(found[s], want[s], abs_tol=1e-6) for s in want)


def test_mixing_sql(spark, same_rows):
    same_rows(mixing.query(spark, SMALL), mixing.SQL, SMALL)


def test_mixing_odd(odd, none):
    rows = mixing.mix(odd).collect()
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert len(rows) == len(ODD) and sizes[2] == sizes[3] == sizes[4] == 0 and sizes[None] == 5 and sizes[5] == 30_000
    assert all(0 <= r["copies"] <= 2 for r in rows) and len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.emit(odd).count() == sum(r["copies"] for r in rows) and mixing.emit(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


# -- 3 personal data --------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("x a.b@c.d-e.f, y", ["email:2:13"]), ("a@b", []), ("a@b.c.@d.e", ["email:0:5", "email:5:10"]), ("@a.b c@d.e", ["email:5:10"]), ("é a@b.c", ["email:2:7"]),
        ("1.2.3.4 256.1.1.1 01.002.3.4", ["ip:0:7", "ip:18:28"]), ("1.2.3.4.5.6.7.8", ["ip:0:7", "ip:8:15"]), ("9" * 5000 + ".1.1.1", []),
        ("4111 1111 1111 1111", ["card:0:19"]), ("4111-1111-1111-1112", []), ("4111111111111111 2", []),
        ("+1 (202) 555-0101.", ["phone:0:17"]), ("+12", []), ("+1 2", []), ("+44 20 7946 0958 +", ["phone:0:16"]), ("", []),
    ],
)
def test_base_spans(text, spans):
    assert [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in personal.base_spans(text)] == spans


def test_base_spans_are_the_patterns(texts):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for text in [*texts.values(), "a@b.c@d.e@f", "x..@y.z-@-.q@r.s", "1.2.3.4.5@6.7"]:
        found = personal.base_spans(text)
        assert [(s, e) for s, k, e in found if k == 0] == [m.span() for m in email.finditer(text)]
        assert [(s, e) for s, k, e in found if k == 1] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_personal(spark, texts, odd, none):
    rows = personal.query(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = personal.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == personal.digest(base) and [r[f"n_{k}"] for k in personal.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert {f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(r["spans"].split(",")) | {""} or not base
    found = {r["doc_id"]: r["spans"] for r in personal.find(odd).collect()}
    assert [s["kind"] for s in found[8]] == ["email", "ip"] and found[2] == found[3] == [] and personal.find(none).count() == 0


def test_reliabilities_tell_good_labelers():
    rng = np.random.default_rng(1)
    rows = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.6
        vote = [(1 if (truth == (rng.random() < a)) else -1) if a else 0 for a in (0.95, 0.9, 0.85, 0.6, 0.5, 0, 0)]
        rows[tuple(vote)] += 1
    prior, table = personal.reliabilities([(0, list(v), n) for v, n in rows.items()])[0]
    assert abs(prior - 0.6) < 0.06 and table[0, 1, 2] > 0.9 and abs(table[4, 1, 2] - 0.5) < 0.1


# -- 4 nearest --------------------------------------------------------------------


def exact_nearest(rows, query, k):
    own = dict(rows)[query]
    return sorted(((i, float(np.dot(v, own))) for i, v in rows if i != query), key=lambda x: (-x[1], x[0]))[:k]


def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(60)]  # equal vectors tie by id
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    found = defaultdict(list)
    for r in nearest.search(vectors, vectors.where("vec_id % 20 = 0"), block=300).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    hits = 0
    for q, got in found.items():
        want = exact_nearest(rows, q, 20)
        assert [r for _, _, r in got] == list(range(1, 21)) and all(math.isclose(s, float(np.dot(dict(rows)[i], dict(rows)[q])), rel_tol=1e-12, abs_tol=1e-12) for i, s, _ in got)
        hits += len({i for i, _, _ in got} & {i for i, _ in want})
    assert len(found) == 48 and hits >= 0.95 * 20 * len(found)
    assert [i for i, _, _ in found[0]] == list(range(900, 920))


def test_nearest_recall_where_the_share_cuts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in nearest.search(vectors, vectors.where("vec_id % 20 = 0"), least=20, block=900).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got & {i for i, _ in exact_nearest(rows, q, 20)}) for q, got in found.items())
    print("recall", hits / 20 / len(found))
    assert len(found) == 45 and hits >= 0.9 * 20 * len(found)


def test_footrule():
    rng = np.random.default_rng(2)
    orders = np.stack([rng.permutation(12)[:5] for _ in range(40)]).astype(np.int16)
    place = lambda o: {p: i for i, p in enumerate(o)}
    for q in orders[:5]:
        got = nearest.Files(orders, 12).footrule(q)
        for o, d in zip(orders, got, strict=True):
            a, b = place(q), place(o)
            assert d == sum(abs(a.get(p, 5) - b.get(p, 5)) for p in range(12)) + 0 * len(a)


def test_footrule_of_a_block_costs_less_than_posting_by_posting():
    rng = np.random.default_rng(3)
    orders = np.argsort(rng.random((8192, 256)), axis=1)[:, :64].astype(np.int16)
    files = nearest.Files(orders, 256)
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    bounds, vector, place = np.searchsorted(flat[by], np.arange(257)), by // 64, by % 64

    def posted(order):
        out = np.full(8192, 64 * 65, np.int32)
        for at, pivot in enumerate(order.tolist()):
            lo, hi = bounds[pivot], bounds[pivot + 1]
            out[vector[lo:hi]] -= 2 * (64 - np.maximum(place[lo:hi], at))
        return out

    took = {posted: [], files.footrule: []}
    for order in orders[:30]:
        assert (posted(order) == files.footrule(order)).all()
        for run, times in took.items():
            began = time.process_time()
            run(order)
            times.append(time.process_time() - began)
    assert 2 * np.median(took[files.footrule]) < np.median(took[posted])


def test_nearest_top_ties_by_id():
    rng = np.random.default_rng(4)
    for k in (1, 7, 39, 40, 50):
        score, ids = rng.integers(0, 5, 40).astype(float), rng.permutation(40)
        want = sorted(range(40), key=lambda j: (-score[j], ids[j]))[:k]
        assert nearest.top(score, ids, k).tolist() == want


def test_nearest_takes_one_vector_of_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 0.2]), (3, [0.1, 1.0]), (4, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.search(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == [(20, 1, 3, 1.0), (20, 2, 4, 0.5)]


def test_nearest_odd(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.5]), (40, []), (6, [1.0, 2.0, 3.0]), (7, [float("inf"), 0.0]), (21, [1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.search(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(20, 1, 21, 1.25), (20, 2, 1, 1.0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nearest.search(empty, empty).count() == 0


# -- 5 quotation ------------------------------------------------------------------


def test_quotation_sql(spark, same_rows):
    same_rows(quotation.query(spark, SMALL), quotation.SQL, SMALL)


def test_quotation(spark):
    rows = [
        (1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "> Hello  THERE\nfine"), (1, 2, "u", "> > hello there\n> fine\nwhat?\n\npara two"), (1, 3, "a", ">what?\nnothing\n> Hello there\n> second line\nend"),
        (2, 0, "u", "> para two\nelsewhere"), (2, 1, "a", None), (2, None, "a", ""), (None, 1, "u", "> > >"), (None, 1, "u", "> > >"), (None, 2, "u", "> fine"), (1, 9, "u", "> Hello there\n> second line"),
    ]
    found = {(r["conv_id"], r["pos"]): r for r in quotation.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(found) == len(rows)
    assert [found[1, p]["text"] for p in (2, 3, 4)] == ["fine", "what?\n\npara two", "nothing\nend"]
    assert [found[1, p]["parent"] for p in (1, 2, 3, 4, 5)] == [0, 1, 2, 3, 1] and [found[1, p]["depth"] for p in (1, 2, 3, 4, 5)] == [0, 1, 2, 3, 1]
    assert [found[1, p]["n_linked"] for p in (2, 3, 4)] == [1, 2, 2] and [found[1, p]["reply_order"] for p in (1, 2, 5, 3, 4)] == [1, 2, 3, 4, 5]
    assert found[2, 1]["n_linked"] == 1 and found[2, 1]["parent"] == 0 and found[2, 2]["text"] is None and found[None, 3]["n_linked"] == 1 and found[None, 1]["n_quotes"] == 0
    assert quotation.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotation_of_several_lines(spark):
    long = "a one\na two\n\nb one\nb two\nb three\n\nc one"
    rows = [
        (1, 0, "u", long), (1, 1, "a", "unrelated"), (1, 2, "u", "> b one\n> B  two\nyes"), (1, 3, "a", "> a two\n>\n> b one\n> b two\n> b three\nno"), (1, 4, "u", "> b one\n> b three"),
        (1, 5, "u", "> b three\n> c one\n> more"), (2, 0, "u", "> b one\n> b two"), (2, 1, "a", "said later"), (3, 0, "u", "> said first"), (3, 1, "u", "said first"), (4, 0, "u", "said first"),
    ]
    columns = "conv_id long, turn long, role string, text string"
    found = {(r["conv_id"], r["turn"]): r for r in quotation.link(spark.createDataFrame(rows, columns)).collect()}
    assert [found[1, t]["parent"] for t in range(6)] == [0, 1, 1, 1, 4, 5] and [found[1, t]["n_linked"] for t in range(2, 6)] == [1, 1, 0, 0]
    assert found[2, 0]["n_linked"] == 0 and found[3, 0]["n_linked"] == 1 and found[3, 0]["parent"] == 0


# -- 6 n-gram join ----------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def joined(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return groups(links, [i for i, _ in rows]), {i: len(s) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, texts, k, percent):
    root, size = joined(list(texts.items()), k, percent)
    got = {r["doc_id"]: r for r in ngram_join.join(docs, k, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == root and {i: r["n_shingles"] for i, r in got.items()} == size


def test_ngram_join_near_copies(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(60):
            w = list(base)
            for j in rng.choice(60, rng.integers(0, 4), replace=False):
                w[j] = f"x{rng.integers(0, 5)}"
            rows.append((g * 100 + i, " ".join(w)))
    rows += [(900 + i, "one two three") for i in range(3)] + [(910, "one"), (911, "ONE"), (912, "")]
    root, size = joined(rows, 4, 85)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_ngram_join_odd(odd, none):
    rows = ngram_join.join(odd).collect()
    size = {r["doc_id"]: r["n_shingles"] for r in rows}
    assert len(rows) == len(ODD) and size[2] == size[3] == size[4] == 0 and size[5] == 1 and size[6] == 1 and size[None] == 2
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5, 6, 8))
    assert ngram_join.join(none).count() == 0


def test_trie_walk():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(120)]
    for probe in sets[:40]:
        got = sorted(ngram_join.traverse(probe, sets, 60))
        assert got == [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 60 * len(np.union1d(probe, s))]


# -- 7 packing --------------------------------------------------------------------


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.query(spark, SMALL).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert by.keys() == texts.keys()
    for doc_id, own in by.items():
        ids = np.array([*whole.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) > 0.97 * 2048 * len(sequences)


def test_packing_odd(odd, none):
    rows = packing.pack(odd, group=3).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD} and sum(r["doc_id"] == 1 for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1] and packing.pack(none).count() == 0


def test_special_strings_are_as_the_file_says():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "plain é🙂\n\n  x", "", "'s 12 ab"):
        assert packing.tokenizer("byte_bpe_50k.json")(text) == whole.encode(text, add_special_tokens=False).ids


def test_first_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 257):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        where, offset = packing.first_fit(sizes, 100)
        room = []
        for s, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
            fit = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [100] * (fit == len(room))
            assert (w, o) == (fit, 100 - room[fit])
            room[fit] -= s


# -- 8 language model -------------------------------------------------------------


def test_language_model(spark, texts):
    rows = language_model.query(spark, SMALL).collect()
    said = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in said.items() if language_model.fold_of(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = said[r["doc_id"]]
        assert r["held_out"] == (language_model.fold_of(r["doc_id"]) == 0) and r["train_tokens"] == total
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rows = language_model.query(spark, SMALL.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("model")).first()
    assert rows["model"] > 0.95 * rows["base"]


def test_language_model_odd(odd, none):
    rows = {r["doc_id"]: r for r in language_model.score(odd).collect()}
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == 1 and rows[2]["bits_per_byte"] is None and rows[None]["held_out"] and rows[5]["n_tokens"] == 30_001
    assert language_model.score(none).count() == 0


def test_language_model_learns_from_every_training_text(spark, docs, monkeypatch):
    seen = Counter()
    count = lambda name, f: lambda *a, **k: (seen.update({name: [x for x in a if hasattr(x, "count") and hasattr(x, "columns")][0].count()}), f(*a, **k))[1]
    for name in ("gather", "learn_mixing", "themes"):
        monkeypatch.setattr(language_model, name, count(name, getattr(language_model, name)))
    many = docs.select("doc_id", "text").crossJoin(spark.range(90).withColumnRenamed("id", "k")).select((F.col("doc_id") * 90 + F.col("k")).alias("doc_id"), F.substring("text", 1, 60).alias("text"))
    rows = language_model.score(many).collect()
    folds = Counter(language_model.fold_of(r["doc_id"]) for r in rows)
    assert folds[language_model.MIXER_FOLD] > 1500 and seen["learn_mixing"] == seen["themes"] == folds[language_model.MIXER_FOLD]
    assert seen["gather"] + seen["learn_mixing"] == len(rows) - folds[0]


def test_mixing_ignores_how_texts_are_dealt(docs):
    few = docs.select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in language_model.score(few.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def test_model_grows_with_the_training_words(spark, docs, monkeypatch):
    small, large = language_model.sizes(10**6), language_model.sizes(10**11)
    assert all(a < b for a, b in zip(small, large, strict=True))
    held = docs.select(F.col("text"))
    learned = held.mapInArrow(language_model._count_words, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    monkeypatch.setattr(language_model, "sizes", lambda tokens: (1 << 18, 1 << 22, 1024, 24))
    voc = language_model.vocabulary(learned, 1 << 10, 1 << 10)
    assert (voc.slots, voc.classes, voc.themes) == (1 << 22, 1024, 24) and len(voc.code) > 1 << 10
    sent = spark.sparkContext.broadcast(voc)
    whole, seen = ({r["segment"]: r["entries"] for r in language_model.gather(held, sent, dense).collect()} for dense in (1 << 22, 0))
    assert whole == seen and max(whole) >= language_model.ORDERS * language_model.SLOTS // language_model.SEGMENT


def test_filter_of_few_values_passes_few_others(spark):
    cells = line_dedup._members(spark.range(10))
    assert spark.range(10).where(line_dedup._maybe(cells, F.col("id"))).count() == 10
    assert spark.range(1000, 11000).where(line_dedup._maybe(cells, F.col("id"))).count() < 100


def test_long_lists_and_halved_sketches_lose_nothing(docs, monkeypatch):
    few = docs.select("doc_id", "text")
    rows = lambda: sorted(map(tuple, line_dedup.dedup(few).collect()))
    usual = rows()
    monkeypatch.setattr(line_dedup, "LEADERS", 2)
    for halved in (4, 40):
        monkeypatch.setattr(line_dedup, "HALVED", halved)
        assert rows() == usual


def test_long_lists_within_a_document(spark, monkeypatch):
    """Of lines of one document, the later of two goes even if the earlier one is gone already, whatever their ids."""
    rng = np.random.default_rng(5)
    said = [[f"w{i}" if rng.random() > 0.12 else f"n{rng.integers(0, 12)}" for i in range(24)] for _ in range(150)]
    rows = [(1, "\n".join(map(" ".join, said)))]
    monkeypatch.setattr(line_dedup, "LEADERS", 2)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == lines_kept(rows)


def test_large_models_count_little_to_send(spark, docs, monkeypatch):
    """With more slots than DENSE, tasks send less than a byte a slot and bit, however often one is met, and count right."""
    text = docs.select(F.col("text")).limit(400)
    often = spark.createDataFrame([("often " * 3000 + "again",)] * 3, "text string")
    held = text.unionByName(often).repartition(6)
    learned = held.mapInArrow(language_model._count_words, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    monkeypatch.setattr(language_model, "sizes", lambda tokens: (1 << 18, 1 << 16, 512, 12))
    voc = language_model.vocabulary(learned, 1 << 10, 1 << 10)
    sent = spark.sparkContext.broadcast(voc)
    whole, small = ({r["segment"]: r["entries"] for r in language_model.gather(held, sent, dense).collect()} for dense in (1 << 16, 0))
    assert whole == small

    class Task:
        select = coalesce = groupBy = applyInArrow = lambda self, *_: self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    task = language_model.gather(Task(), sent, 0)
    batch = pa.RecordBatch.from_pylist([{"text": r["text"]} for r in held.collect()])
    out = list(task.run(iter([batch] * 12)))
    assert any(x.column("at").null_count < x.num_rows for x in out)
    assert sum(x.nbytes for x in out) < 2 * language_model.ORDERS * voc.slots


def test_groups_of_bits():
    """Groups, inner nodes and bits of codes as a walk from bit to bit finds them."""
    rng = np.random.default_rng(0)
    length = np.append(rng.integers(1, 63, 300), [1, 4, 5, 62])
    code = np.array([int(rng.integers(0, 1 << min(n, 62))) for n in length.tolist()], np.uint64)
    groups, node, size, inner, bit = language_model._bits(code, length)
    told = [format(c, f"0{n}b") for c, n in zip(code.tolist(), length.tolist(), strict=True)]
    assert "".join(map(str, bit.tolist())) == "".join(told) and groups.tolist() == [-(-n // 4) for n in length.tolist()]
    assert node.tolist() == [int("1" + t[:i], 2) for t in told for i in range(0, len(t), 4)]
    assert size.tolist() == [min(4, len(t) - i) for t in told for i in range(0, len(t), 4)]
    assert inner.tolist() == [int("1" + t[i - i % 4 : i], 2) for t in told for i in range(len(t))]


def test_words_and_spelled_bytes_are_encoded_together(monkeypatch):
    """Slots and bits of known and spelled words are those of a walk from bit to bit, cut into bits in one go."""
    m, u = language_model, 1 << 64
    known = [b"ab", b"cd", b"efg"]
    keys = np.array([words.hashed(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in known], np.uint64)
    keys = np.sort(keys)
    code, length = m.huffman(np.array([60, 17, 9, 3, 2]))
    byte_code, byte_length = m.huffman(np.arange(1, 258))
    voc = m.Vocabulary(keys, np.array([60, 17, 9]), np.arange(3), np.array([1, 2, 3, 0, 0]), code, length, np.array([0, 1, 2, 1] + [0] * (m.CLASSES - 3)), byte_code, byte_length, 91, 4, 2)
    calls, bits = [], m._bits
    monkeypatch.setattr(m, "_bits", lambda *x: calls.append(1) or bits(*x))
    texts = [b"ab zz cd", b"", b"efg Qrst ab", b"ab cd"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    c = m.encode(voc, data, offsets)
    assert len(calls) == 1
    told, spelled, zero = [], [], []
    for row, text in enumerate(texts):
        for word in [*text.lower().split(), None]:
            at = np.flatnonzero(keys == words.hashed(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0]) if word else []
            symbol = 4 if word is None else int(at[0]) if len(at) else 3
            told += [(row, 0, 0, x) for x in [format(int(code[symbol]), f"0{length[symbol]}b")]]
            before = [0, 0]
            for b in [*word, 256] if symbol == 3 else []:
                spelled.append((row, 1, before[-1] * 512 + before[-2], format(int(byte_code[b]), f"0{byte_length[b]}b")))
                before.append(b + 1)
    for row, kind, context, x in told + spelled:
        for i, b in enumerate(x):
            base = int("1" + x[: i - i % 4], 2) + (kind << 40)
            h = ((base * 0x9E3779B97F4A7C15) % u ^ context * 0x9FB21C651E98DF25 % u) * 0xD6E8FEB86659FD93 % u >> 65 - voc.slots.bit_length()
            zero.append((row, kind, h ^ int("1" + x[i - i % 4 : i], 2), int(b)))
    assert list(zip(c.row.tolist(), c.spelled.tolist(), c.slots[0].tolist(), c.bits.tolist(), strict=True)) == zero


def test_probabilities_sum_to_one():
    """Over all continuations a code of bits, each with complementary costs, spends exactly the whole."""
    codes, lengths = language_model.huffman(np.array([9, 5, 3, 1, 1, 1]))
    assert sum(2.0 ** -int(n) for n in lengths) == 1.0
    assert len({(int(c), int(n)) for c, n in zip(codes, lengths, strict=True)}) == 6
    cost = language_model._COST
    assert np.allclose(10.0 ** -cost.astype(float) + 10.0 ** -cost[::-1].astype(float), 1, atol=1e-5)


# -- 9 toxicity -------------------------------------------------------------------


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(toxicity.fold_of(r["doc_id"]) == 0, truth.get(r["doc_id"]), r["score"] >= 0.5) for r in toxicity.score(docs, model).select("row.doc_id", "score").collect()]
    held = [(t, p) for h, t, p in rows if h and t is not None]
    hits, bad, said = sum(t and p for t, p in held), sum(t for t, _ in held), sum(p for _, p in held)
    assert hits >= 0.8 * bad and hits >= 0.9 * said and len(held) > 300


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (7, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["row"]["key"] == "k" for r in rows)
    empty = toxicity.train(none, labels.where("false"))
    assert toxicity.score(none, empty).count() == 0 and len(toxicity.score(odd, empty).collect()) == len(ODD)
    assert toxicity.score(odd.select("text"), empty).count() == len(ODD)


# -- 10 vector dedup --------------------------------------------------------------


def test_vector_dedup(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in (0, 1):
        for g in range(30):
            center = rng.normal(size=24)
            rows += [(len(rows) + i, (center + rng.normal(size=24) * rng.choice([0.02, 0.2, 0.3])).tolist(), label) for i in range(rng.integers(1, 20))]
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(40)]
    got = {r["vec_id"]: r for r in vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([x for _, _, x in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.98 * near.sum()
    root = groups(list(zip(*map(lambda x: x.tolist(), np.nonzero(near)), strict=True)), range(len(rows)))
    assert np.mean([got[i]["component_id"] == root[i] for i in root]) > 0.98 and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def linked_nodes(spark, seed=8):
    """A group of 60 near copies and 30 isolated pairs as nodes, and each node's number of links."""
    rng = np.random.default_rng(seed)
    start = [rng.normal(size=24)] * 60 + [v for v in rng.normal(size=(30, 24)) for _ in range(2)]
    unit = np.array([v + 0.03 * rng.normal(size=24) for v in start])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= vector_dedup.LEAST).sum(axis=1) - 1
    nodes = spark.createDataFrame([(i, "a", v.tolist(), 1) for i, v in enumerate(unit)], "cid long, label string, v array<double>, copies long")
    return nodes, dict(enumerate(near.tolist()))


def test_vector_dedup_audit_sees_lost_pairs(spark):
    nodes, want = linked_nodes(spark)
    frame = lambda some: spark.createDataFrame(some, "cid long, n long")
    assert vector_dedup.audit(nodes, frame(list(want.items())), vector_dedup.LEAST) == 1
    assert vector_dedup.audit(nodes, frame([(i, n) for i, n in want.items() if n > 10]), vector_dedup.LEAST) == 0


def test_vector_dedup_counts_no_link_twice(spark):
    nodes, want = linked_nodes(spark)
    for overlap, shard, block in ((3, 6, 4), (2, 10, 3), (1, 1000, 16)):
        got = {r["cid"]: r["n"] for r in vector_dedup.links(nodes, vector_dedup.LEAST, overlap, shard, block)[0].collect()}
        assert all(n <= want[i] for i, n in got.items())


def test_vector_dedup_over_shards_and_blocks(spark):
    """Overlapping shards, united lists and blocks that meet: counts and components against brute force."""
    rng = np.random.default_rng(5)
    start = [rng.normal(size=16)] * 300 + [v for v in rng.normal(size=(60, 16)) for _ in range(5)] + list(rng.normal(size=(200, 16)))
    unit = np.array([v + 0.1 * rng.normal(size=16) for v in start])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    copies = rng.integers(1, 4, len(unit))
    near = unit @ unit.T >= vector_dedup.LEAST
    np.fill_diagonal(near, False)
    nodes = spark.createDataFrame([(i, "a", v.tolist(), int(c)) for i, (v, c) in enumerate(zip(unit, copies, strict=True))], "cid long, label string, v array<double>, copies long")
    for overlap, shard, block in ((4, 50, 64), (8, 100, 32)):
        counted, edges = vector_dedup.links(nodes, vector_dedup.LEAST, overlap, shard, block)
        got, want = {r["cid"]: r["n"] for r in counted.collect()}, near @ copies
        assert all(n <= want[i] for i, n in got.items()) and sum(got.values()) >= 0.95 * want.sum()
        pairs = [(r["a"], r["b"]) for r in edges.collect()]
        assert all(near[a, b] for a, b in pairs) and len(pairs) < 12 * overlap * len(unit)
        found, true = groups(pairs, range(len(unit))), groups(list(zip(*map(lambda x: x.tolist(), np.nonzero(near)), strict=True)), range(len(unit)))
        assert np.mean([found[i] == true[i] for i in true]) > 0.95


def test_vector_forest():
    rng = np.random.default_rng(1)
    for density in (0, 0.01, 0.03, 0.3):
        linked = rng.random((60, 80)) < density
        a, b = vector_dedup.forest(linked)
        assert linked[a, b].all() and len(a) < 140
        pairs = lambda x, y: [(int(i), 1000 + int(j)) for i, j in zip(x, y, strict=True)]
        ids = [*range(60), *range(1000, 1080)]
        assert groups(pairs(a, b), ids) == groups(pairs(*np.nonzero(linked)), ids)


def test_vector_dedup_is_exact_if_the_audit_fails(spark, monkeypatch):
    nodes, want = linked_nodes(spark)
    got = {r["cid"]: r["n"] for r in vector_dedup.exact(nodes, vector_dedup.LEAST, 16)[0].collect()}
    assert got == {i: n for i, n in want.items() if n}
    lost = lambda *a: (spark.createDataFrame([], "cid long, n long"), spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(vector_dedup, "links", lost)
    rows = vector_dedup.dedup(nodes.select(F.col("cid").alias("vec_id"), F.col("v").alias("embedding"), "label"), overlap=32).collect()
    assert {r["vec_id"]: r["n_links"] for r in rows} == want and {r["component_id"] for r in rows} == {0, *range(60, 120, 2)}


def test_vector_dedup_odd(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], None), (8, [None, 1.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[1] == got[2] == got[9] == (2, 1) and all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 10)) and got[None] == (0, None)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert vector_dedup.dedup(empty).count() == 0


# -- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline
    from quire.llm import stages
    from quire.llm.common import cut

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "source_mixing", "packing"]
    clean = cut(stages.clean(spark, docs, SMALL))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} <= texts.keys()
    lines = cut(stages.unrepeated_lines(spark, clean, SMALL))
    rows = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    want = {i: t for i, t in lines_kept(rows).items() if t.strip() or t == dict(rows)[i]}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    one = cut(stages.distinct_documents(spark, lines, SMALL))
    root, _ = joined([(r["doc_id"], r["text"]) for r in lines.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(root.values()))
    taken = stages.mixed(spark, one, SMALL)
    copies = Counter(r["doc_id"] for r in taken.collect())
    assert taken.columns == docs.columns and max(copies.values()) <= 2 and copies.keys() <= set(root.values())
    assert stages.packed(spark, cut(taken), SMALL).select("doc_id").distinct().count() == len(copies)


def test_pipeline_odd(spark, odd):
    from quire.llm import stages

    rows = stages.distinct_documents(spark, odd, SMALL).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    again = odd.unionByName(odd)
    assert len(stages.distinct_documents(spark, again, SMALL).collect()) == 9
    assert {r["doc_id"] for r in stages.unrepeated_lines(spark, odd, SMALL).collect()} == {1, 2, 3, 4, None, 5, 6, 8}


CLASHES = [
    "score", "_text", "size", "source_size", "target", "copies", "_id", "_copy", "n_lines", "n_removed", "_d", "_h", "_keep", "key", "component_id",
    "row", "id", "d", "h", "kept", "mask", "place", "own", "drawn", "toxic", "line", "a.b", "sequence_id", "doc_tokens",
]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(f"mine {i}"))
    return docs


@pytest.mark.parametrize("stage", ["clean", "unrepeated_lines", "distinct_documents", "mixed"])
def test_stages_keep_columns_that_clash(spark, clashing, stage):
    from quire.llm import stages

    out = getattr(stages, stage)(spark, clashing, SMALL)
    rows = out.collect()
    assert out.columns == clashing.columns and rows
    assert all(r[name] == f"mine {i}" for r in rows for i, name in enumerate(CLASHES))


def test_operators_read_past_columns_that_clash(spark, clashing):
    plain = spark.createDataFrame(ODD, DOCS)
    same = lambda f, *names: sorted(map(repr, f(clashing).select(*names).collect())) == sorted(map(repr, f(plain).select(*names).collect()))
    assert same(line_dedup.dedup, "doc_id", "text", "n_lines", "n_removed")
    assert same(mixing.mix, "doc_id", "size", "source_size", "target", "copies")
    assert same(ngram_join.join, "doc_id", "n_shingles", "component_id")
    assert same(packing.pack, "doc_id", "start", "length", "ids_crc32", "doc_tokens")


def test_pipeline_runs_on_odd_and_empty_tables(spark, clashing, none, tmp_path):
    import corpus_pipeline

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, docs, labelled in (("odd", clashing, labels), ("none", none, labels.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labelled.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (name == "odd") == bool(rows) and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
