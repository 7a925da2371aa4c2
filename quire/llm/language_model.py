"""Scoring texts by logistic context mixing over the bits of their words.

A text is its lower-cased words and an end.  Each frequent word has a Huffman code;
any other is an escape and its bytes, which have a code of their own.  Every bit is
predicted by hashed-context predictors: order 0, two that see the themes of the latest
frequent words, one that sees the word before and one that sees the two before; in a
spelled word, the two, three or five bytes before, all of them, and those after the
word before.  Their stretched probabilities are mixed with weights that
a gate picks by how well the last two contexts are known, and the result is refined by an
adaptive map of (gate, prediction).  Weights, map and themes are learned from one
whole fold of the training texts, by passes in which each task adds up sums of fixed
size.

What the predictors know are bit counts gathered from all other training texts: each task
adds up its counts, and they are summed segment by segment.  Slots, contexts and coded
words grow with the training words, and so does the memory of the model in each task.
Word counts for the base score are exact: frequent words are looked up in a table, the
others are joined.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import cut, table

#: The least of what is sent to every task, which grows with the training words (``sizes``): coded words, words with counts, slots per predictor.
CODED = 1 << 18
COUNTED = 1 << 20
SLOTS = 1 << 21
#: Slots up to which a task counts in whole numbers; beyond, in bytes.
DENSE = 1 << 21
SEGMENT = 1 << 13
ORDERS = 5
CLASSES = 512
#: Themes at CLASSES, in proportion above: groups of frequent words that come together, in effect languages and registers.
THEMES = 12
#: Training texts of the mixer's fold teach themes, mixing weights and map, all others the predictors.
FOLDS = 10
MIXER_FOLD = 9
CHUNK = 1 << 18
U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GATES = 32
_STEP, _REACH = 64, 12


def sizes(tokens: int) -> tuple[int, int, int, int]:
    """(coded words, slots, classes, themes) for so many training words: a slot for 64 to 128 words and a coded word for 1,024, classes by their root."""
    slots = max(SLOTS, 1 << (tokens >> 7).bit_length())
    classes = max(CLASSES, 1 << (math.isqrt(tokens) >> 4).bit_length() - 1 if tokens >= 256 else 0)
    return max(CODED, tokens >> 10), slots, classes, THEMES * classes // CLASSES


def fold(doc_id):
    """0 for held-out texts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol; counts are raised so that no code is longer than 62 bits."""
    n = len(counts)
    if n == 1:
        return np.zeros(1, U), np.ones(1, np.int64)
    least = max(1, int(counts.sum()) >> 36)
    heap = [(max(int(c), least), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for new in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = new
        heapq.heappush(heap, (a[0] + b[0], new))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    length = depth[:n]
    order = np.lexsort((np.arange(n), length))
    codes = np.zeros(n, U)
    code, last = 0, int(length[order[0]])
    for i in order.tolist():
        code <<= int(length[i]) - last
        last = int(length[i])
        codes[i] = code
        code += 1
    return codes, length


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes of the counted words
    counts: np.ndarray
    symbol: np.ndarray  # of each counted word, -1 if it is spelled
    rank: np.ndarray  # class of each symbol: 0 for a rare one; then the escape and the end
    code: np.ndarray  # of each symbol, then the escape and the end
    length: np.ndarray
    theme: np.ndarray  # of each class
    byte_code: np.ndarray  # of each byte and the end of a word
    byte_length: np.ndarray
    tokens: int
    distinct: int
    ends: int
    slots: int = SLOTS
    classes: int = CLASSES
    themes: int = THEMES

    def __post_init__(self):
        self.index = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = words.Index(self.keys)
        return self.index.find(hashes)


def _bits(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of up to four bits of a run of codes: (groups of each code, node, bits of each group), and each bit's node within its group and value.

    A node is the bits before, led by a 1.
    """
    groups = (length + 3) >> 2
    place = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups)
    left = np.repeat(length, groups) - 4 * place  # bits to come, the group's included
    size = np.minimum(left, 4)
    code = np.repeat(code | (U(1) << length.astype(U)), groups)
    node = code >> left.astype(U)
    own = (code >> (left - size).astype(U)).astype(np.int64) & ((1 << size) - 1) | (1 << size)
    total = int(size.sum())
    own = np.repeat(own.astype(np.int8), size)
    narrow = np.int32 if total < 1 << 31 else np.int64
    left = np.repeat(np.cumsum(size, dtype=narrow), size)
    left -= np.arange(total, dtype=narrow)
    left = left.astype(np.int8)
    return groups, node, size, own >> left, own >> (left - np.int8(1)) & np.int8(1)


def _slot(v: Vocabulary, node: np.ndarray, context: np.ndarray, order: int) -> np.ndarray:
    out = node + U(order * 0x51ED270B)
    out *= U(0x9E3779B97F4A7C15)
    out ^= context
    out *= U(0xD6E8FEB86659FD93)
    out >>= U(65 - v.slots.bit_length())
    return out.view(np.int64)


@dataclass
class Coded:
    """The bits of a run of texts: predictor slots, bits, whether a bit spells, and the text of each."""

    slots: list[np.ndarray]
    bits: np.ndarray
    spelled: np.ndarray
    row: np.ndarray
    place: np.ndarray  # of each word among the counted ones, -1 if none
    hashes: np.ndarray
    rows: np.ndarray  # first word of each text, and the end


def encode(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Coded:
    hashes, start, end, rows = words.hashed(data, offsets)
    place = v.find(hashes)
    symbol = np.where(place >= 0, v.symbol[place] if len(v.symbol) else -1, -1)
    escape, stop = len(v.code) - 2, len(v.code) - 1
    n, texts = len(hashes), len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(rows))
    tokens = np.full(n + texts, stop, np.int64)
    tokens[np.arange(n) + owner] = np.where(symbol >= 0, symbol, escape)
    row = np.repeat(np.arange(texts), np.diff(rows) + 1)
    first = (rows[:-1] + np.arange(texts))[row]
    # The latest frequent word before each token, the one before that, and whether the first stands right before.
    rank = v.rank[tokens]
    at = np.arange(len(tokens))
    latest = np.concatenate([[-1], np.maximum.accumulate(np.where(rank > 0, at, -1))[:-1]])
    second = np.where(latest >= 0, latest[latest], -1)
    one = np.where(latest >= first, rank[latest], 0)
    two = np.where(second >= first, rank[second], 0)
    near = np.where(latest == at - 1, one, 0)
    theme = v.theme[one] * (v.themes + 1) + v.theme[two]
    # The words themselves, whether frequent or not: the one before, and the two before.
    said = np.ones(len(tokens), U)
    said[np.arange(n) + owner] = hashes
    before = np.where(at > first, np.roll(said, 1), U(2))
    further = np.where(at > first + 1, np.roll(said, 2), U(2))
    context1 = (theme + 1).astype(U) * U(0xC2B2AE3D27D4EB4F)
    context2 = (theme * max(4096, v.classes + 1) + near).astype(U) * U(0x165667B19E3779F9)
    context3 = before * U(0xA0761D6478BD642F)
    context4 = (context3 ^ further) * U(0xE7037ED1A0B428DB)
    code, length, of = v.code[tokens], v.length[tokens], row
    contexts = [U(0), context1, context2, context3, context4]
    words_ = len(tokens)
    rare = np.flatnonzero(symbol < 0)
    if len(rare):
        size = end[rare] - start[rare] + 1
        total = np.cumsum(size)
        word = np.repeat(np.arange(len(rare)), size)
        offset = np.arange(total[-1]) - (total - size)[word]
        byte = np.where(offset < size[word] - 1, _LOWER[data[np.minimum(start[rare][word] + offset, len(data) - 1)]], 0).astype(np.int64)
        byte[total - 1] = 256
        back = lambda k: np.where(offset >= k, np.concatenate([np.zeros(k, np.int64), byte[:-k]]) + 1, 0)
        c0 = back(1) * 512 + back(2)
        c1 = c0 * 512 + back(3)
        c2 = (c1 * 512 + back(4)) * 512 + back(5)
        # All the bytes before, alone and with the word before.
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, U))[offset]
        sums = np.cumsum((byte + 1).astype(U) * power)
        c3 = np.concatenate([np.zeros(1, U), sums[:-1]])
        c3 -= c3[total - size][word]
        c4 = (c3 ^ before[rare + owner[rare]][word]) * U(0xE7037ED1A0B428DB)
        code, length, of = (np.concatenate(both) for both in ((code, v.byte_code[byte]), (length, v.byte_length[byte]), (row, owner[rare][word])))
        contexts[0] = np.zeros(words_, U)
        contexts = [np.concatenate([one, c.astype(U) * U(0x9FB21C651E98DF25)]) for one, c in zip(contexts, (c0, c1, c2, c3, c4), strict=True)]
    # Words and spelled bytes together, so that what there is for every bit is made once.
    groups, node, size, inner, bit = _bits(code, length)
    node[int(groups[:words_].sum()) :] += U(1 << 40)
    inner = inner.astype(np.int64)
    of_group, of_bit = np.repeat(np.arange(len(code)), groups), np.repeat(np.arange(len(node)), size)
    slots = [np.take(_slot(v, node, np.take(c, of_group, mode="clip") if c.ndim else c, k), of_bit, mode="clip") for k, c in enumerate(contexts)]
    for one in slots:
        one ^= inner  # the bits of a group share a hash and lie side by side
    spelled = np.zeros(len(bit), np.int8)
    spelled[int(length[:words_].sum()) :] = 1
    return Coded(slots, bit, spelled, np.repeat(of, length), place, hashes, rows)


@dataclass
class Predictors:
    table: np.ndarray  # [order, slot]: stretched probability in steps of 1/512, times 4, and how well it is known, 0 to 3
    weights: np.ndarray  # [gate, order + 1]
    refined: np.ndarray  # [gate, bucket]


def entries(pair: np.ndarray) -> np.ndarray:
    """Table entries of slots with counts [slot, bit]."""
    stretch = np.log((pair[:, 1] + 0.4) / (pair[:, 0] + 0.4)).clip(-10, 10)
    return (np.rint(stretch * 512) * 4 + np.digitize(pair.sum(axis=1), [1, 8, 100])).astype(np.int16)


def gate_and_inputs(p: Predictors, c: Coded) -> tuple[np.ndarray, np.ndarray]:
    x = np.empty((ORDERS + 1, len(c.bits)), np.float32)
    gate = c.spelled * np.int8(4)
    for k in range(ORDERS):
        entry = np.take(p.table[k], c.slots[k], mode="clip")
        np.multiply(entry >> 2, np.float32(1 / 512), out=x[k])
        if k >= ORDERS - 2:
            gate = (gate + (entry & 3).astype(np.int8)) * np.int8(4 if k == ORDERS - 2 else 1)
    x[ORDERS] = 0.3
    return gate, x


def mixed(p: Predictors, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    weights, place = np.ascontiguousarray(p.weights.T), gate.astype(np.intp)
    out = np.take(weights[0], place, mode="clip") * x[0]
    for k in range(1, ORDERS + 1):
        part = np.take(weights[k], place, mode="clip")
        part *= x[k]
        out += part
    return np.clip(out, -_REACH + 0.05, _REACH - 0.05, out=out)


def bucket(z: np.ndarray) -> np.ndarray:
    return np.rint(z * 2).astype(np.int8) + np.int8(2 * _REACH)


_COST = np.log10(1 + np.exp(-np.arange(-_REACH * _STEP, _REACH * _STEP + 1) / _STEP)).astype(np.float32)


def costs(p: Predictors, c: Coded) -> np.ndarray:
    """-log10 of the probability of each bit."""
    gate, x = gate_and_inputs(p, c)
    z = mixed(p, gate, x)
    cell = gate.astype(np.intp) * (4 * _REACH + 1) + bucket(z)
    z += np.take(p.refined.ravel(), cell, mode="clip")
    z *= np.float32(_STEP / 2)
    z *= (c.bits * np.int8(2) - np.int8(1)).astype(np.float32)
    return np.take(_COST, np.rint(z).astype(np.intp) + _REACH * _STEP, mode="clip")


def _mixing_sums(v, p):
    """Each task's sums over its texts: per gate the loss, gradient and curvature of the weights, then the map's counts and ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pred, key = p.value, TaskContext.get().partitionId()
        loss, slope, curve = np.zeros(_GATES), np.zeros((_GATES, ORDERS + 1)), np.zeros((_GATES, ORDERS + 1, ORDERS + 1))
        all_, ones = np.zeros(pred.refined.shape), np.zeros(pred.refined.shape)
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0), CHUNK):
                c = encode(v.value, data, offsets)
                gate, x = gate_and_inputs(pred, c)
                z = mixed(pred, gate, x)
                at = gate.astype(np.int64) * pred.refined.shape[1] + bucket(z)
                all_ += np.bincount(at, minlength=all_.size).reshape(all_.shape)
                ones += np.bincount(at, weights=c.bits, minlength=all_.size).reshape(all_.shape)
                sign = c.bits * np.int8(2) - np.int8(1)
                share = 1 / (1 + np.exp((-z * sign).astype(float)))  # of the bit that came
                miss = 1 - share
                loss -= np.bincount(gate, weights=np.log(share), minlength=_GATES)
                order = np.argsort(gate, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=_GATES))])
                error, spread, by = (miss * sign)[order], (share * miss)[order], np.empty(x.shape)
                for k, one in enumerate(x):  # a row at a time: along an axis numpy takes element by element
                    by[k] = np.take(one, order, mode="clip")
                for g in np.flatnonzero(np.diff(ends)):
                    part = by[:, ends[g] : ends[g + 1]]
                    slope[g] += part @ error[ends[g] : ends[g + 1]]
                    curve[g] += part * spread[ends[g] : ends[g + 1]] @ part.T
        sums = np.concatenate([part.ravel() for part in (loss, slope, curve, all_, ones)])
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["task", "sums"])

    return run


def learn_mixing(p: Predictors, v, texts: DataFrame, rounds: int = 12) -> Predictors:
    """Newton passes over all ``texts`` for each gate's weights, then the adaptive map at the weights of the least loss.

    A pass adds up sums of fixed size in every task; a gate whose loss rose goes back by half.
    """
    grid = (np.arange(4 * _REACH + 1) - 2 * _REACH) / 2
    p.weights[:] = start = np.array([0.2, 0.15, 0.25, 0.25, 0.25, 0.0], np.float32)
    p.refined[:] = grid.astype(np.float32)
    best, least, counts = p.weights.astype(float), np.full(_GATES, np.inf), np.zeros((2, *p.refined.shape))
    step, gain = np.zeros(best.shape), np.zeros(_GATES)
    for _ in range(rounds):
        sent = texts.sparkSession.sparkContext.broadcast(p)
        rows = texts.mapInArrow(_mixing_sums(v, sent), "task long, sums binary").collect()
        sent.destroy()
        sums = np.zeros(_GATES * (1 + (ORDERS + 1) * (ORDERS + 2)) + 2 * p.refined.size)
        for row in sorted(rows, key=lambda r: r["task"]):
            sums += np.frombuffer(row["sums"])
        loss, slope, curve, seen = np.split(sums, np.cumsum([_GATES, _GATES * (ORDERS + 1), _GATES * (ORDERS + 1) ** 2]))
        slope, curve, seen = slope.reshape(best.shape), curve.reshape(_GATES, ORDERS + 1, ORDERS + 1), seen.reshape(counts.shape)
        curve = curve + np.eye(ORDERS + 1)
        loss = loss + 0.5 * ((p.weights - start) ** 2).sum(axis=1)
        better = loss < least
        least[better], best[better], counts[:, better] = loss[better], p.weights[better], seen[:, better]
        pull = slope - (p.weights - start)
        newton = np.linalg.solve(curve, pull[:, :, None])[:, :, 0]
        gain[better] = 0.5 * (pull * newton).sum(axis=1)[better]  # what the next step promises
        step = np.where(better[:, None], newton, step / 2)
        if not rows or float(gain.sum()) <= 1e-4 * float(least.sum()):
            break
        p.weights[:] = best + step
    p.weights[:] = best
    all_, ones = counts
    prior = 1 / (1 + np.exp(-grid))
    share = (ones + 30 * prior) / (all_ + 30)
    p.refined[:] = np.clip(np.log(share / (1 - share)), -_REACH, _REACH).astype(np.float32)
    return p


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts to (kind, key, n): words (0), bytes in words and their ends (1), texts (2)."""
    tally, byte, ends = words.Tally(), np.zeros(257, np.int64), 0

    def out(keys: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

    for batch in batches:
        ends += batch.num_rows
        for _, _, data, offsets in words.chunks(batch.column(0)):
            hashes = words.hashed(data, offsets)[0]
            byte[:256] += np.bincount(_LOWER[data], minlength=256)
            byte[256] += len(hashes)
            tally.add(hashes)
            if tally.full():
                yield out(*tally.take(), 0)
    yield out(*tally.take(), 0)
    byte[[9, 10, 11, 12, 13, 32]] = 0
    yield out(np.arange(257, dtype=np.int64), byte, 1)
    yield out(np.zeros(1, np.int64), np.array([ends], np.int64), 2)


def _cutoff(most: int, histogram: list) -> int:
    """The least count that at most ``most`` words reach."""
    total, least = 0, 1 << 62
    for n, k in histogram:
        if total + k > most:
            return least
        total, least = total + k, n
    return least if histogram else 1


def vocabulary(counts: DataFrame, coded: int, counted: int) -> Vocabulary:
    named = counts.where("kind = 0")
    # One row for each value that a count takes: about the square root of the corpus at most.
    histogram = sorted(((r["n"], r["k"]) for r in named.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    distinct, tokens = sum(k for _, k in histogram), sum(n * k for n, k in histogram)
    grown, slots, classes, groups = sizes(tokens)
    coded, counted = max(coded, grown), max(counted, grown)
    few = {r["key"]: r["n"] for r in counts.where("kind = 1").collect()}
    ends = sum(r["n"] for r in counts.where("kind = 2").collect())
    rows = named.where(F.col("n") >= _cutoff(counted, histogram)).select("key", "n").toArrow()
    keys, n = rows.column("key").to_numpy().view(U), rows.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    # A word seen once stands for those not seen at all: it is spelled, so that escapes are learned.
    own = n >= max(2, _cutoff(coded, histogram))
    symbol = np.where(own, np.cumsum(own) - 1, -1)
    rare = max(1, tokens - int(n[own].sum()))
    code, length = huffman(np.concatenate([n[own], [rare, max(1, ends)]]))
    rank = np.zeros(len(code), np.int64)
    top = np.lexsort((keys[own], -n[own]))[:classes]
    rank[top] = np.arange(1, len(top) + 1)
    rank[-1] = 0
    byte_code, byte_length = huffman(np.array([few.get(b, 0) + 1 for b in range(257)]))
    return Vocabulary(keys, n, symbol, rank, code, length, np.zeros(classes + 1, np.int64), byte_code, byte_length, tokens + ends, distinct + (ends > 0), ends, slots, classes, groups)


def _together(v):
    """Each task's sums of products of the classes' counts per text, in whole steps so that their order does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = v.value.classes
        total = np.zeros((classes, classes))
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0), CHUNK):
                hashes, _, _, rows = words.hashed(data, offsets)
                place = v.value.find(hashes)
                symbol = np.where(place >= 0, v.value.symbol[place] if len(v.value.symbol) else -1, -1)
                rank = np.where(symbol >= 0, v.value.rank[symbol], 0)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                seen = np.bincount(row * (classes + 1) + rank, minlength=(len(rows) - 1) * (classes + 1)).reshape(-1, classes + 1)
                x = np.rint(np.log1p(seen[:, 1:]) * 256)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sums"])

    return run


def themes(v, texts: DataFrame, rounds: int = 20) -> np.ndarray:
    """A theme (0: none) of each class of frequent words, by clustering their counts per text.

    The clusters need only the products of the classes' counts, added up over all ``texts``.
    """
    total = np.zeros((v.value.classes, v.value.classes))
    for row in texts.mapInArrow(_together(v), "sums binary").toLocalIterator():
        total += np.frombuffer(zlib.decompress(row["sums"])).reshape(total.shape)
    out = np.zeros(v.value.classes + 1, np.int64)
    used = np.flatnonzero(total.diagonal())
    if not len(used):
        return out
    norm = np.sqrt(total.diagonal()[used])
    near = total[np.ix_(used, used)] / norm / norm[:, None]  # cosines
    centers = [0]
    while len(centers) < min(v.value.themes, len(used)):  # the word least like any center so far
        centers.append(int(np.argmin(near[:, centers].max(axis=1))))
    likeness = near[:, centers]
    for _ in range(rounds):
        group = np.argmax(likeness, axis=1)
        for k in range(len(centers)):
            own = group == k
            if own.any():
                likeness[:, k] = near[:, own].sum(axis=1) / np.sqrt(near[np.ix_(own, own)].sum())
    out[used + 1] = group + 1
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Compressed counts; of bytes, which are small numbers in no order, by their frequencies alone."""
    if counts.dtype != np.uint8:
        return zlib.compress(counts.tobytes(), 1)
    by = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return by.compress(counts.tobytes()) + by.flush()


def _counting(v, whole: bool):
    """Each task's counts of the bits of its texts: (segment, at, counts); ``gather`` says how."""
    slots = v.value.slots
    schema = ["segment", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ORDERS, 2 * slots), np.int32 if whole else np.uint8)
        over = words.Tally()  # by cells of all orders, in steps of 256

        def beyond() -> Iterator[pa.RecordBatch]:
            keys, n = over.take()
            keys, n = keys.astype(np.int64), n << 8
            part = keys // (2 * SEGMENT)
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.zeros(0, np.int64)
            ends = np.append(edge[1:], len(keys))
            at, n = (keys % (2 * SEGMENT)).astype(np.uint16), n.astype(np.int32)
            for lo in range(0, len(edge), 256):
                own = list(zip(edge[lo : lo + 256].tolist(), ends[lo : lo + 256].tolist(), strict=True))
                packed = [pa.array([zlib.compress(x[i:j].tobytes(), 1) for i, j in own], pa.binary()) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([pa.array(part[edge[lo : lo + 256]].astype(np.int32)), *packed], schema)

        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0), CHUNK):
                c = encode(v.value, data, offsets)
                for k in range(ORDERS):
                    at = c.slots[k] << 1
                    at |= c.bits
                    if whole:
                        np.add.at(counts[k], at, np.int32(1))
                        continue
                    at = np.sort(at.astype(np.int32))
                    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                    cells, n = at[first], np.diff(np.append(first, len(at)))
                    n += counts[k][cells]
                    counts[k][cells] = n & 255
                    high = np.flatnonzero(n > 255)
                    over.add((cells[high] + 2 * slots * k).astype(U), n[high] >> 8)
                if over.full():
                    over.add(*over.take())
        parts = counts.reshape(-1, 2 * SEGMENT)
        used = np.flatnonzero(parts.any(axis=1))
        for lo in range(0, len(used), 16):
            own = used[lo : lo + 16]
            packed = [_packed(parts[i] if not whole else parts[i].astype(np.int32 if parts[i].max() > 65535 else np.uint16)) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.nulls(len(own), pa.binary()), pa.array(packed, pa.binary())], schema)
        yield from beyond()

    return run


def gather(docs: DataFrame, v, dense: int = DENSE) -> DataFrame:
    """Table entries of all ``docs``: (segment, entries), one row a segment; the counts in between are sent compressed.

    Up to ``dense`` slots a task counts in arrays of whole numbers.  With more it counts in a byte a slot and bit, which
    is as much as the model itself takes, and holds what goes beyond 255 apart (``at``).  Each task then reads as many
    words as there are slots, as far as its partitions go, so all tasks together send in proportion to the words.
    """
    slots = v.value.slots
    whole = slots <= dense

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SEGMENT, np.int64)
        for part in parts:
            for at, one in zip(part.column("at"), part.column("counts"), strict=True):
                raw = zlib.decompress(one.as_py())
                if at.is_valid:
                    total[np.frombuffer(zlib.decompress(at.as_py()), np.uint16)] += np.frombuffer(raw, np.int32)
                else:
                    total += np.frombuffer(raw, {2: np.uint8, 4: np.uint16, 8: np.int32}[len(raw) // SEGMENT])
        pair = total.reshape(-1, 2).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([entries(pair).tobytes()], pa.binary())], ["segment", "entries"])

    texts = docs.select(F.col("text").cast("string"))
    if not whole:
        texts = texts.coalesce(max(1, v.value.tokens // slots))
    each = texts.mapInArrow(_counting(v, whole), "segment int, at binary, counts binary")
    return each.groupBy("segment").applyInArrow(add, "segment int, entries binary")


def _score(v, p):
    counted = pa.struct([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, pred = v.value, p.value
        base = 0.1 * (voc.distinct + 1) + voc.tokens
        log_count = np.log10((voc.counts + 0.1) / base)
        log_end = np.log10((voc.ends + 0.1) / base)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, data, offsets in words.chunks(batch.column(1), CHUNK):
                c = encode(voc, data, offsets)
                n, texts = np.diff(c.rows), end - first
                owner = np.repeat(np.arange(texts), n)
                own = c.place >= 0
                known = np.bincount(owner[own], minlength=texts) + (voc.ends > 0)
                total = np.bincount(owner[own], weights=log_count[c.place[own]], minlength=texts) + log_end
                score = -np.bincount(c.row, weights=costs(pred, c), minlength=texts)
                rest, who = c.hashes[~own], owner[~own]
                order = np.lexsort((rest, who))
                rest, who = rest[order], who[order]
                new = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (who[1:] != who[:-1]))) if len(rest) else np.zeros(0, np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(rest[new].view(np.int64)), pa.array(np.diff(np.append(new, len(rest))))], fields=list(counted))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who[new], np.arange(texts + 1)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(texts)), batch.column(0).slice(first, texts), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(total), pa.array(score), pa.array(np.diff(offsets)), lists],
                    ["key", "doc_id", "n_tokens", "known", "total", "score", "bytes", "rest"],
                )
                key += texts

    return run


def score(docs: DataFrame, coded: int = CODED, counted: int = COUNTED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the base and the model's score.

    A null or empty text is its end alone; repeated rows are scored each; a null id
    is held out; with no training text every bit costs one bit.  An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = fold(F.col("doc_id"))
    learned = docs.where(part != 0).select("text").mapInArrow(_count_words, "kind int, key long, n long")
    counts = cut(learned.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0"))
    voc = vocabulary(counts, coded, counted)
    mixer = cut(docs.where(part == MIXER_FOLD).select("text"))
    sent = spark.sparkContext.broadcast(voc)
    voc.theme = themes(sent, mixer)
    voc.index = None
    sent = spark.sparkContext.broadcast(voc)
    predictors = Predictors(
        np.zeros((ORDERS, voc.slots), np.int16), np.zeros((_GATES, ORDERS + 1), np.float32), np.zeros((_GATES, 4 * _REACH + 1), np.float32)
    )
    for row in gather(docs.where((part != 0) & (part != MIXER_FOLD)), sent).toLocalIterator():
        at = row["segment"] * SEGMENT
        predictors.table.reshape(-1)[at : at + SEGMENT] = np.frombuffer(row["entries"], np.int16)
    predictors = learn_mixing(predictors, sent, mixer)
    model = spark.sparkContext.broadcast(predictors)
    schema = "key long, doc_id long, n_tokens long, known long, total double, score double, bytes long, rest array<struct<h:long,n:long>>"
    scored = cut(docs.mapInArrow(_score(sent, model), schema))
    base = 0.1 * (voc.distinct + 1) + voc.tokens
    rest = scored.select("key", F.explode("rest").alias("w")).select("key", "w.h", "w.n")
    seen = counts.where("kind = 0").select(F.col("key").alias("h"), F.col("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    looked = rest.join(seen, "h", "left").groupBy("key").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(base))).alias("more_total")
    )
    joined = scored.drop("rest").join(looked, "key", "left")
    return joined.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("more_total", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") / (F.log10(F.lit(2.0)) * F.col("bytes"))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
