"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

One pass finds, for each whole text, the base spans (fixed patterns, always kept)
and further candidates with a vote of every labeler (regex shape, gazetteer,
context; 1 for, -1 against, 0 silent) and a few hashed features.  How often each
pattern of votes occurs is counted over the whole corpus; the number of patterns
is bounded by the labelers, and expectation-maximisation over these counts gives
each labeler's reliability per kind.  A logistic classifier is then fitted to the
posteriors of at most ``SAMPLE`` candidates, and decides on the added spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, table

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the classifier is fitted to at most (those of smallest hash).
SAMPLE = 20_000
ACCEPT = 0.8
HASHED = 64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from every later one, so the
# look-behind changes no match; it only keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

MORE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.-])|\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})+)"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2,3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
CUES = {
    "email": frozenset("email e-mail mail contact write correo courriel".split()),
    "ip": frozenset("ip address host server addr client from login".split()),
    "card": frozenset("card visa mastercard credit debit payment karte tarjeta carte".split()),
    "phone": frozenset("call phone tel telephone mobile fax cell telefon telefono".split()),
}
AGAINST = frozenset("version section chapter page isbn license build release figure table order invoice part no".split())
DOMAINS = frozenset("com org net edu gov io de fr es uk info example".split())
_WORD = re.compile(r"[^\W_]+")
LABELERS = 7


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order, in code points: leftmost non-overlapping matches of each kind that pass its test."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m.group().split(".")) and all(int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans; none overlaps one of those or an earlier candidate."""
    if "@" not in text and "at" not in text and not _DIGIT.search(text):
        return []
    taken = [(s, e) for s, _, e in base]
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text and "[at]" not in text and "(at)" not in text:
            continue
        if kind != "email" and not _DIGIT.search(text):
            continue
        out += [(m.start(), k, m.end()) for m in MORE[kind].finditer(text)]
    kept: list[tuple[int, int, int]] = []
    busy = sorted(taken)
    i, last = 0, 0
    for s, k, e in sorted(out):
        while i < len(busy) and busy[i][1] <= s:
            i += 1
        if s >= last and not (i < len(busy) and busy[i][0] < e):
            kept.append((s, k, e))
            last = e
    return kept


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """Of each labeler: base shape, tight shape, gazetteer, cue before, cue after, word against, neighbours."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    name = KINDS[kind]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])[-4:]]
    after = [w.lower() for w in _WORD.findall(text[end : end + 32])[:3]]
    tight = {"email": "@" in span, "ip": span.count(".") == 3, "card": digits in (15, 16), "phone": digits in (10, 11, 12)}[name]
    if name == "email":
        known = 1 if span.rsplit(".", 1)[-1].lower() in DOMAINS else -1
    elif name == "card":
        known = 1 if span[0] in "3456" and _luhn("".join(c for c in span if c in "0123456789")) else -1
    elif name == "ip":
        parts = span.split(".")
        known = 1 if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) and parts[0] != "0" else -1
    else:
        known = 1 if span.lstrip("+1 (")[:1] in set("23456789") else -1
    glued = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "$#=_/")) or (end < len(text) and (text[end : end + 1].isalnum() or text[end] in "%_/="))
    return [
        1 if base else -1,
        1 if tight else -1,
        known,
        1 if CUES[name].intersection(before) else 0,
        1 if CUES[name].intersection(after) else 0,
        -1 if AGAINST.intersection(before) else 0,
        -1 if glued else 0,
    ]


def _hashed(text: str, start: int, end: int) -> list[int]:
    """Buckets of the span's shape and the words beside it."""
    shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", text[start:end]))[:24]
    near = [w.lower() for w in _WORD.findall(text[max(0, start - 24) : start])[-1:] + _WORD.findall(text[end : end + 24])[:1]]
    return sorted({zlib.crc32(x.encode()) % HASHED for x in [shape, f"n{min(20, end - start)}", *near]})


SPAN = "struct<start:long,kind:int,stop:long,base:boolean,votes:array<int>,hashed:array<int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of all ``docs``, one row each; a null text is empty."""
    kind = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("hashed", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                found = [(*x, True) for x in base] + [(*x, False) for x in more_spans(text, base)]
                spans.append([{"start": s, "kind": k, "stop": e, "base": b, "votes": votes(text, s, k, e, b), "hashed": _hashed(text, s, e)} for s, k, e, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def reliabilities(patterns: list[tuple[int, list[int], int]], rounds: int = 50) -> dict[int, tuple[float, np.ndarray]]:
    """Per kind the prior and P(vote | class) [labeler, class, vote + 1] by EM over (kind, votes, count)."""
    out = {}
    for kind in range(len(KINDS)):
        own = [(v, n) for k, v, n in patterns if k == kind]
        prior, table_ = 0.5, np.full((LABELERS, 2, 3), 1 / 3)
        table_[:, 0], table_[:, 1] = (0.5, 0.3, 0.2), (0.2, 0.3, 0.5)
        if own:
            seen, count = np.array([v for v, _ in own]) + 1, np.array([n for _, n in own], float)
            for _ in range(rounds):
                post = _posterior(seen, prior, table_)
                prior = float(np.clip((post @ count + 1) / (count.sum() + 2), 0.02, 0.98))
                for j in range(LABELERS):
                    for v in range(3):
                        hit = (seen[:, j] == v) * count
                        table_[j, 1, v], table_[j, 0, v] = post @ hit + 0.5 + (v == 2), (1 - post) @ hit + 0.5 + (v == 0)
                table_ /= table_.sum(axis=2, keepdims=True)
        out[kind] = (prior, table_)
    return out


def _posterior(seen: np.ndarray, prior: float, table_: np.ndarray) -> np.ndarray:
    odds = np.full(len(seen), np.log(prior / (1 - prior)))
    for j in range(LABELERS):
        odds += np.log(table_[j, 1, seen[:, j]] / table_[j, 0, seen[:, j]])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def features(kind: np.ndarray, votes_: np.ndarray, hashed: list[list[int]]) -> np.ndarray:
    n = len(kind)
    x = np.zeros((n, 1 + len(KINDS) + 3 * LABELERS + HASHED), np.float32)
    x[:, 0] = 1
    x[np.arange(n), 1 + kind] = 1
    for j in range(LABELERS):
        x[np.arange(n), 1 + len(KINDS) + 3 * j + votes_[:, j] + 1] = 1
    for i, h in enumerate(hashed):
        x[i, [1 + len(KINDS) + 3 * LABELERS + b for b in h]] = 1
    return x


def classifier(sample: list[tuple[int, list[int], list[int]]], model: dict) -> np.ndarray:
    """Weights of a logistic regression on the label model's posteriors."""
    if not sample:
        return np.zeros(1 + len(KINDS) + 3 * LABELERS + HASHED, np.float32)
    kind, seen = np.array([k for k, _, _ in sample]), np.array([v for _, v, _ in sample])
    target = np.zeros(len(sample))
    for k, (prior, table_) in model.items():
        own = kind == k
        target[own] = _posterior(seen[own] + 1, prior, table_)
    x = features(kind, seen, [h for _, _, h in sample]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - target) + w)
    return w.astype(np.float32)


def find(docs: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, spans) with ``score`` in each kept span: all base spans and the added ones.

    Null and empty texts have no span; repeated rows give equal rows; an empty
    table gives an empty one.  A text is searched whole, in code points.
    """
    found = cut(candidates(docs))
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counted = each.groupBy("kind", "votes").count()  # at most 4 * 3**7 rows
    model = reliabilities(sorted((r[0], list(r[1]), r[2]) for r in counted.collect()))
    order = F.xxhash64("doc_id", "start", "kind", "stop")
    rows = each.orderBy(order, "doc_id", "start").limit(sample).select("kind", "votes", "hashed").collect()
    weights = classifier([(r[0], list(r[1]), list(r[2])) for r in rows], model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                kept = []
                if spans:
                    x = features(np.array([s["kind"] for s in spans]), np.array([s["votes"] for s in spans]), [s["hashed"] for s in spans])
                    score = 1 / (1 + np.exp(-(x @ weights).astype(float)))
                    for s, p in zip(spans, score.tolist(), strict=True):
                        if s["base"] or p >= accept:
                            kept.append({"kind": KINDS[s["kind"]], "start": s["start"], "stop": s["stop"], "base": s["base"], "score": p})
                out.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,stop:long,base:boolean,score:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
