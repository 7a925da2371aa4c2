"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Labels are learned from at most ``SAMPLE`` labelled documents outside the held-out
fold.  Lexicons of words and word heads are read off that sample; each of the
strongest entries, groups of the weaker ones and several text patterns are voters.
A label model with class-conditional means (the voters' accuracies) and one shared
covariance (their correlations) is fitted by EM with the given label as one more
noisy voter; a logistic classifier on hashed words is trained on its posteriors and
scores every whole text in one vectorised pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm import words
from quire.llm.common import carried, cut, quoted, table

#: Labelled documents that the models are fitted to at most (those of smallest hash).
SAMPLE = 20_000
#: Hashed features that the classifier reads.
FEATURES = 3000
SINGLE = 40
GROUPS = 8
FOLDS = 5
#: Rows of a batch that go back to Spark at once.
SLICE = 1000
HEADS = (4, 5, 6)
PATTERNS = 4


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # of those, then of the patterns, then the bias


def fold(doc_id, folds: int = FOLDS):
    """0 for the held-out fold; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct word and word head of each row."""
    found = words.hashed(data, offsets, words.PLAIN, HEADS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(found[3]))
    rows, keys = [row], [found[0]]
    for head in found[4:]:
        own = head != 0
        rows.append(row[own])
        keys.append(head[own])
    return np.concatenate(rows), np.concatenate(keys)


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row whether symbols, capitals, repeated marks or digits are many."""
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper = (data >= 65) & (data <= 90)
    mark = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65))
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == data[:-1]) & mark[1:]
    digit = (data >= 48) & (data <= 57)
    letters = np.maximum(sums(letter), 1)
    return np.stack([sums(mark) > 0.15 * size, sums(upper) > 0.4 * letters, sums(again) > 0.02 * size, sums(digit) > 0.1 * size], axis=1)


def _hits(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in keys) of the distinct hits, in order."""
    row, key = _features(data, offsets)
    if not len(keys) or not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    own = keys[at] == key
    both = np.unique(row[own] * len(keys) + at[own])
    return both // len(keys), both % len(keys)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, documents with it, toxic ones among them) of each batch; feature 0 is the batch itself."""
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        for first, end, data, offsets in words.chunks(batch.column(0)):
            row, key = _features(data, offsets)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            row, key = row[keep], key[keep]
            keys, back = np.unique(key, return_inverse=True)
            own = toxic[first:end]
            n = np.bincount(back, minlength=len(keys))
            bad = np.bincount(back, weights=own[row], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(n, end - first)), pa.array(np.append(bad, own.sum()))],
                ["feature", "n", "bad"],
            )


def lexicon(sample: DataFrame, limit: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes, log odds, support) of the ``limit`` features that tell most, strongest first."""
    counts = sample.select("text", "toxic").mapInArrow(_counted, "feature long, n long, bad long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = counts.where("feature = 0").first()
    if whole is None or not 0 < whole["bad"] < whole["n"]:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    clean, bad = float(whole["n"] - whole["bad"]), float(whole["bad"])
    p1, p0 = (F.col("bad") + 0.05) / (bad + 0.1), (F.col("n") - F.col("bad") + 0.05) / (clean + 0.1)
    odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
    told = F.col("bad") * F.log(p1 / p0) + (F.col("n") - F.col("bad")) * F.log(p0 / p1) * 0.25
    rows = (
        counts.where("feature <> 0 and n >= 3")
        .select("feature", odds.alias("odds"), told.alias("told"), "n")
        .orderBy(F.desc("told"), "feature")
        .limit(limit)
        .collect()
    )
    return np.array([r["feature"] for r in rows], np.int64).view(np.uint64), np.array([r["odds"] for r in rows]), np.array([r["n"] for r in rows])


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior of class 1 per row: EM for two Gaussian-scored classes with a shared covariance.

    ``votes`` [row, voter] are 0 or 1; ``given`` (0 or 1) is one more voter, whose
    error rates are estimated with the rest.
    """
    x = votes.astype(float)
    post = np.where(given == 1, 0.9, 0.1).astype(float)
    error = np.array([0.1, 0.1])
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        m1, m0 = (post @ x) / max(post.sum(), 1e-9), ((1 - post) @ x) / max((1 - post).sum(), 1e-9)
        d1, d0 = x - m1, x - m0
        within = ((d1 * post[:, None]).T @ d1 + (d0 * (1 - post)[:, None]).T @ d0) / len(x) + 0.02 * np.eye(x.shape[1])
        w = np.linalg.solve(within, m1 - m0)
        error[0] = np.clip(((1 - post) * given).sum() / max((1 - post).sum(), 1e-9), 0.005, 0.4)
        error[1] = np.clip((post * (1 - given)).sum() / max(post.sum(), 1e-9), 0.005, 0.4)
        odds = np.log(prior / (1 - prior)) + np.clip((x - (m1 + m0) / 2) @ w, -12, 12)
        odds += np.where(given == 1, np.log((1 - error[1]) / error[0]), np.log(error[1] / (1 - error[0])))
        post = 1 / (1 + np.exp(-odds))
    return post


def _fit(rows: list[np.ndarray], n: int, target: np.ndarray, start: np.ndarray, ridge: float = 1e-4, rounds: int = 500) -> np.ndarray:
    """Weights (bias last) of a logistic regression on sparse 0/1 rows, by Adagrad on whole passes."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.append(start, -1.0)
    sums = np.full(n + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows)) + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(flat, weights=gap[owner], minlength=n), gap.sum()) / len(rows) + ridge * np.append(w[:-1], 0)
        sums += grad * grad
        w -= 0.8 * grad / np.sqrt(sums)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = FEATURES) -> Model:
    """The classifier; documents with several labels count as toxic if one says so, null labels are unknown.

    Rows that repeat an id are one document of the sample, with the smallest of their texts.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most SAMPLE rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    keys, odds, support = lexicon(texts, limit)
    if not len(keys):
        share = texts.agg(F.avg("toxic")).first()[0] or 0.0
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(0, np.uint64), np.append(np.zeros(PATTERNS), np.log(p / (1 - p))))
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))  # by strength, to the place among sorted keys
    ranked = keys[order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in words.chunks(batch.column(0)):
                row, at = _hits(data, offsets, ranked)
                pattern = _patterns(data, offsets)
                hits = np.split(at, np.searchsorted(row, np.arange(1, end - first)))
                full = [np.concatenate([h, len(ranked) + np.flatnonzero(p)]).astype(np.int32) for h, p in zip(hits, pattern, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.list_(pa.int32())), batch.column(1).slice(first, end - first)], ["hits", "toxic"])

    found = texts.mapInArrow(rows, "hits array<int>, toxic long").toPandas()
    # Any order of the rows gives the same model but for rounding; sorting fixes that too.
    hits = sorted(zip([tuple(h) for h in found["hits"]], found["toxic"], strict=True))
    given = np.array([t for _, t in hits])
    lists = [np.array(h, np.int64) for h, _ in hits]
    n = len(ranked) + PATTERNS
    voter = np.full(n, -1)
    strong = [i for i in range(len(keys)) if odds[i] > 3]
    for rank, i in enumerate(strong):
        voter[place[i]] = rank if rank < SINGLE else SINGLE + rank % GROUPS
    voter[len(ranked) :] = SINGLE + GROUPS + np.arange(PATTERNS)
    votes = np.zeros((len(lists), SINGLE + GROUPS + PATTERNS + 1), np.int8)
    for i, h in enumerate(lists):
        own = voter[h]
        votes[i, own[own >= 0]] = 1
    votes[:, -1] = ~votes[:, : SINGLE + GROUPS].any(axis=1)
    post = label_model(votes, given)
    start = np.zeros(n)
    start[place] = np.clip(odds, -2, 4) * np.minimum(1, support / 20) * (odds > 3)
    return Model(ranked, _fit(lists, n, post, start))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, text, score): the text of ``docs``, the score that is read off it, and all other columns as one struct.

    A null text is scored as an empty one and stays null.  Every row has its own score,
    which depends on its text alone: ties and repeated rows are scored alike, an empty
    table gives an empty one, and no column's name matters but that of the text.
    """
    keys, weights = model.keys, model.weights
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select((carried(docs.select(*quoted(others))) if others else F.struct(F.lit(0))).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                out = [np.zeros(0)]
                for first, end, data, offsets in words.chunks(some.column(1)):
                    row, at = _hits(data, offsets, keys)
                    z = np.bincount(row, weights=weights[at], minlength=end - first) if len(keys) else np.zeros(end - first)
                    z = z + _patterns(data, offsets) @ weights[len(keys) : len(keys) + PATTERNS] + weights[-1]
                    out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.concatenate(out))], ["row", "text", "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fold_of(doc_id: int | None, folds: int = FOLDS) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
