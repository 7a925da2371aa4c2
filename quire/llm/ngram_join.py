"""N-gram Jaccard join by prefix trees.

Texts become sets of word n-grams under one global order: an n-gram's token leads
with the class of its frequency (exact for the most frequent, a table of bounded
size), so that sorted tokens go from rare to frequent.  Equal sets are one class.

* Each class posts the tokens of its prefix; two sets that are similar enough share
  one.  Posting lists are read as one sorted stream, and only lists that two classes
  share are kept.
* First every class is compared with the first class of its size in the lists
  they share.  That settles groups of near copies in linear work.
* Then all pairs in a list whose classes are not yet connected are candidates, by
  size, by place and by the number of prefix tokens shared, sent on as a class and a
  cluster it meets.  A pair inside a component could not change it, so no link
  between components is lost.
* Candidates are verified block by block: the ordered sets of a block form a trie
  (sorted sequences, a node for each shared beginning); one traversal carries the
  overlap with the probe down the shared paths and leaves a subtree when the elements
  left cannot reach the bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import words
from quire.llm.common import components, cut, release, table

WORDS = 4
PERCENT = 85
#: N-grams whose frequency is known to all tasks, at most.
FREQUENT = 1 << 20
#: A task reports n-grams that at least so many of its texts have.
SEEN = 2
#: Lists of at least so many classes of one size have several leaders.
LONG, LEADERS = 8, 8
#: Bits of a token's hash; the rest is its frequency class.
HASH = 57
BITMAP = 1 << 21
MEMBERS = 256
PROBES = 512
U = np.uint64
_MASK = U((1 << HASH) - 1)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int, top: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of all rows, each row's from rare to frequent, and the rows' bounds."""
    hashes, _, _, rows = words.hashed(data, offsets)
    tokens, bounds = words.shingles(hashes, rows, k)
    if not len(tokens):
        return tokens, bounds
    tokens &= _MASK
    if top is not None:
        index, classes = top
        place = index.find(tokens)
        tokens |= np.where(place >= 0, classes[place], U(0))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tokens[lo:hi].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[bounds[:-1][bounds[:-1] < len(tokens)]] = True
    return tokens[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def classes_of(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, whatever the classes of its tokens."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(words.mix((tokens & _MASK) + U(0x632BE59BD9B4E019)), dtype=U)])
    return words.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (np.diff(bounds).astype(U) * U(0x9E3779B97F4A7C15))).view(np.int64)


def least_overlap(a, b, percent: int):
    """The overlap from which sets of these sizes are similar enough."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-(percent * n) // 100) + 1


def _sign(k: int):
    """(kind 0, doc_id, n, class) of each row, and (kind 1, token, count) of tokens that several texts of a task share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = words.Tally()
        names = ["kind", "doc_id", "n", "cid"]

        def shared() -> pa.RecordBatch:
            token, n = tally.take()
            own = n >= SEEN
            size = int(own.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(size, np.int32)), pa.nulls(size, pa.int64()), pa.array(n[own]), pa.array(token[own].view(np.int64))], names)

        for batch in batches:
            for first, end, data, offsets in words.chunks(batch.column(1)):
                tokens, bounds = _sets(data, offsets, k, None)
                n = np.diff(bounds)
                cid = pa.array(classes_of(tokens, bounds), mask=n == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(end - first, np.int32)), batch.column(0).slice(first, end - first), pa.array(n), cid], names)
                tally.add(tokens)
                if tally.full():
                    yield shared()
        yield shared()

    return run


class Lookup:
    """The frequent tokens' classes, indexed once a process."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray):
        self.keys, self.classes, self.built = keys, classes, None

    def get(self) -> tuple:
        if self.built is None:
            self.built = (words.Index(self.keys << U(64 - HASH)), self.classes)
        return self.built

    def __getstate__(self):
        return {"keys": self.keys, "classes": self.classes, "built": None}


class _Shifted:
    def __init__(self, index: words.Index):
        self.index = index

    def find(self, tokens: np.ndarray) -> np.ndarray:
        return self.index.find(tokens << U(64 - HASH))


def _top(sent) -> tuple:
    index, classes = sent.value.get()
    return _Shifted(index), classes


def _post(k: int, percent: int, sent):
    """(token, bucket, cid, n, place) of each set's prefix; the bucket is that of the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _top(sent)
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0)):
                tokens, bounds = _sets(data, offsets, k, top)
                size = np.diff(bounds)
                count = np.where(size > 0, prefix_length(size, percent), 0)
                n = np.repeat(size, count)
                if not len(n):
                    continue
                place = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
                prefix = tokens[np.repeat(bounds[:-1], count) + place]
                cid = np.repeat(classes_of(tokens, bounds), count)
                bucket = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix.view(np.int64)), pa.array(bucket), pa.array(cid), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))],
                    ["token", "bucket", "cid", "n", "place"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token, bucket and class, those of tokens that several classes have, with their list's first class of the bucket."""
    names = ["token", "bucket", "cid", "n", "place"]
    held: list[np.ndarray] | None = None  # the last row so far
    lead_held, before_held = 0, False
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        same = (cols[0][1:] == cols[0][:-1]) & (cols[2][1:] == cols[2][:-1])
        keep = np.append(True, ~same)
        cols = [c[keep] for c in cols]
        token, bucket, cid = cols[0], cols[1], cols[2]
        linked = token[1:] == token[:-1]
        before = np.append(before_held if held is not None else False, linked)
        first = np.append(True, ~linked | (bucket[1:] != bucket[:-1]))
        lead = cid[np.maximum.accumulate(np.where(first, np.arange(len(cid)), 0))]
        if held is not None:
            started = np.cumsum(first) == 1
            lead = np.where(started, lead_held, lead)
        live = before.copy()
        live[:-1] |= linked
        out = np.flatnonzero(live[:-1])
        yield pa.RecordBatch.from_arrays([*[pa.array(c[out]) for c in cols], pa.array(lead[out])], [*names, "lead"])
        held, lead_held, before_held = [c[-1:] for c in cols], lead[-1], bool(before[-1])
    if held is not None and before_held:
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in held], pa.array(np.array([lead_held], np.int64))], [*names, "lead"])


def _across(percent: int):
    """(x, cluster, spare) for each list in which x meets a class of another component in that cluster.

    A pair is emitted from the side of the smaller cluster.  ``spare`` is the least
    number of shared prefix tokens that one of the classes met would need.  Input is
    sorted by token and size.
    """

    def relations(run: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        cid, n, place, label, cluster = run
        n, place = n.astype(np.int64), place.astype(np.int64)
        suffix = -(-(percent * n) // 100) - 1
        for i in range(len(cid)):
            lo, hi = np.searchsorted(n, [-(-(percent * n[i]) // 100), 100 * n[i] // percent + 1])
            other = np.flatnonzero((label[lo:hi] != label[i]) & (cluster[lo:hi] >= cluster[i])) + lo
            if not len(other):
                continue
            need = least_overlap(n[i], n[other], percent)
            # At most all places before are shared as well; a bound that holds at every shared token, as they are counted.
            fits = np.minimum(place[i], place[other]) + np.minimum(n[i] - place[i], n[other] - place[other]) >= need
            other, need = other[fits], need[fits]
            if len(other):
                spare = need - np.maximum(suffix[i], suffix[other])
                order = np.argsort(cluster[other], kind="stable")
                name = cluster[other][order]
                first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
                yield [np.full(len(first), cid[i]), name[first], np.minimum.reduceat(spare[order], first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        out: list[list[np.ndarray]] = []
        waiting = 0
        token_held = None

        def close() -> int:
            new = []
            if held:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)] if len(held) > 1 else held[0]
                if len(cols[0]) > 1 and (cols[3] != cols[3][0]).any():
                    new = list(relations(cols))
                    out.extend(new)
                held.clear()
            return sum(len(x[0]) for x in new)

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["x", "cluster", "spare"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            token = cols[0]
            if not len(token):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if token_held is None or token[lo] != token_held:
                    waiting += close()
                    token_held = token[lo]
                held.append([c[lo:hi] for c in cols[1:]])
                if waiting > 100_000:
                    waiting = 0
                    yield flush()
        close()
        if out:
            yield flush()

    return run


def walk_order(members: list[np.ndarray]) -> list[int]:
    """The members in the order in which a walk over their trie comes to them."""
    return sorted(range(len(members)), key=lambda i: members[i][::-1].tobytes())


def traverse(probe: np.ndarray, members: list[np.ndarray], percent: int, order: list[int] | None = None, wanted: Callable[[int], bool] | None = None) -> Iterator[int]:
    """The members similar enough to the probe, by one walk over the trie of the members' ordered sets.

    Sets are walked from frequent to rare tokens, which near copies share longest.
    Neighbours in sorted order share the trie's path of their common beginning, and
    with it the overlap counted there; a subtree is left at the first token after
    which the tokens to come cannot make up what is missing.  A member that is not
    ``wanted`` when the walk comes to it is passed over.
    """
    path, carried, dead = np.zeros(0, U), np.zeros(1, np.int64), None
    for i in walk_order(members) if order is None else order:
        if wanted is not None and not wanted(i):
            continue
        member = members[i][::-1]
        size = min(len(path), len(member))
        apart = np.flatnonzero(path[:size] != member[:size])
        common = int(apart[0]) if len(apart) else size
        need = int(least_overlap(len(probe), len(member), percent))
        if dead is not None and common >= dead[0] and need - len(member) >= dead[1]:
            continue  # in the subtree that was left, with no more tokens to come for what is missing
        rest = member[common:]
        at = np.minimum(np.searchsorted(probe, rest), len(probe) - 1)
        carried = np.concatenate([carried[: common + 1], carried[common] + np.cumsum(probe[at] == rest)])
        path = member
        left = len(member) - np.arange(len(member) + 1)
        lost = np.flatnonzero(carried + left < need)
        if len(lost):
            dead = (int(lost[0]), need - len(member))
        else:
            dead = None
            yield i


def _verify(percent: int):
    def run(key: tuple, members: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(probes):
            return pd.DataFrame({"a": [], "b": []})
        probe = np.frombuffer(probes["set"].iloc[0], U)
        found = list(traverse(probe, [np.frombuffer(x, U) for x in members["tokens"]], percent))
        return pd.DataFrame({"a": np.full(len(found), key[0], np.int64), "b": members["b"].to_numpy()[found]})

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar ones of the distinct pairs (a, b); ``a`` probes the trie of its partners, in blocks of them."""
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.count("*").over(_by("a")) / MEMBERS)))
    members = dealt.join(sets.select(F.col("cid").alias("b"), "tokens"), "b")
    asked = dealt.select(F.col("a").alias("probe"), F.col("block").alias("part")).distinct()
    probes = asked.join(sets.select(F.col("cid").alias("probe"), F.col("tokens").alias("set")), "probe")
    return members.groupBy("a", "block").cogroup(probes.groupBy("probe", "part")).applyInPandas(_verify(percent), "a long, b long")


def _connect(percent: int):
    def run(key: tuple, members: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        """Links between components, as few as connect what is similar enough here."""
        out: list[tuple[int, int]] = []
        if len(members) and len(probes):
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            sets = [np.frombuffer(x, U) for x in members["tokens"]]
            labels, ids = members["label"].tolist(), members["cid"].tolist()
            order = walk_order(sets)
            for x, label, tokens in zip(probes["x"].tolist(), probes["own"].tolist(), probes["set"], strict=True):
                for i in traverse(np.frombuffer(tokens, U), sets, percent, order, lambda i: find(labels[i]) != find(label)):  # noqa: B023
                    a, b = find(labels[i]), find(label)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((x, ids[i]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def connect(met: DataFrame, marked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found between the classes x of ``met`` (x, cluster) and the members of those clusters.

    A cluster's members come in blocks, each a trie, and so do the classes that walk
    it; what is connected already is not compared again.  ``marked``: cid, label, cluster.
    """
    size = marked.join(met.select("cluster").distinct(), "cluster").groupBy("cluster").agg(F.ceil(F.count("*") / MEMBERS).cast("long").alias("blocks"))
    walkers = met.groupBy("cluster").agg(F.ceil(F.count("*") / PROBES).cast("long").alias("parts"))
    shape = size.join(walkers, "cluster")
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    members = marked.join(shape, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).join(sets, "cid").withColumn("part", each("parts"))
    probes = met.join(shape, "cluster").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")))
    probes = probes.join(marked.select(F.col("cid").alias("x"), F.col("label").alias("own")), "x").join(sets.select(F.col("cid").alias("x"), F.col("tokens").alias("set")), "x")
    probes = probes.withColumn("block", each("blocks")).select(F.col("cluster").alias("c"), F.col("block").alias("k"), F.col("part").alias("p"), "x", "own", "set")
    return members.groupBy("cluster", "block", "part").cogroup(probes.groupBy("c", "k", "p")).applyInPandas(_connect(percent), "a long, b long")


def _by(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def _kept_sets(k: int, sent, bitmap):
    """(cid, tokens) of the sets whose class may be wanted, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, wanted, given = _top(sent), np.unpackbits(np.frombuffer(bitmap.value, np.uint8)), set()
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0)):
                tokens, bounds = _sets(data, offsets, k, top)
                found, first = np.unique(classes_of(tokens, bounds), return_index=True)
                own = [(cid, i) for cid, i in zip(found[wanted[found & (BITMAP - 1)] == 1].tolist(), first[wanted[found & (BITMAP - 1)] == 1].tolist(), strict=True) if cid not in given]
                if len(given) < 1_000_000:
                    given.update(cid for cid, _ in own)
                sets = [tokens[bounds[i] : bounds[i + 1]].tobytes() for _, i in own]
                yield pa.RecordBatch.from_arrays([pa.array([cid for cid, _ in own], pa.int64()), pa.array(sets, pa.binary())], ["cid", "tokens"])

    return run


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs`` (doc_id, text).

    A null, empty or wordless text has no set and is linked with nothing; rows with
    equal sets, repeated rows among them, are in one class and so linked.  The
    component is named by its smallest id that is not null.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    text = docs.select("text")
    signed = cut(docs.mapInArrow(_sign(k), "kind int, doc_id long, n long, cid long"))
    rows = signed.where("kind = 0").select("doc_id", "n", "cid")
    frequent = signed.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n"))
    histogram = sorted(((r["n"], r["k"]) for r in frequent.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for n, count in histogram:
        if total + count > FREQUENT:
            break
        total, least = total + count, n
    known = frequent.where(F.col("n") >= least).select("cid", "n").toArrow()
    keys, n = known.column("cid").to_numpy().view(U), known.column("n").to_numpy()
    order = np.argsort(keys)
    classes = np.clip(np.log2(np.maximum(n[order], 1)) * 2, 1, 127).astype(U) << U(HASH)
    sent = spark.sparkContext.broadcast(Lookup(keys[order], classes))

    posted = text.mapInArrow(_post(k, percent, sent), "token long, bucket int, cid long, n int, place int")
    sorted_ = posted.repartition("token").sortWithinPartitions("token", "bucket", "cid")
    live = cut(sorted_.mapInArrow(_shared, "token long, bucket int, cid long, n int, place int, lead long"))
    release(spark)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the classes in ``pairs``, read off the texts again; a bitmap of fixed size keeps most others out."""
        one = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
        one = one.select(F.pmod(F.col("cid"), F.lit(BITMAP)).alias("bit")).distinct()
        bits = np.zeros(BITMAP, np.uint8)
        bits[one.toArrow().column(0).to_numpy()] = 1  # BITMAP rows at most
        bitmap = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
        kept = text.mapInArrow(_kept_sets(k, sent, bitmap), "cid long, tokens binary")
        sets = cut(kept.groupBy("cid").agg(F.first("tokens").alias("tokens")))
        release(spark)
        return sets

    wanted = live.select("cid").distinct()
    # The first class leads a list, and of a long one also the first by several hashes.
    hashed = [F.min_by("cid", F.xxhash64("cid", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    long_ = live.groupBy("token", "bucket").agg(F.count("*").alias("size"), *hashed).where(F.col("size") >= LONG)
    long_ = long_.select("token", "bucket", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("leads"))
    led = live.join(long_, ["token", "bucket"], "left").select("cid", "n", F.explode(F.coalesce("leads", F.array("lead"))).alias("lead"))
    led = led.where("lead <> cid").groupBy("cid", "lead").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    rank = F.row_number().over(_by("cid").orderBy(F.desc("shared"), "lead"))
    led = led.where("shared >= 1 + n * 0.02").withColumn("rank", rank).where(F.col("rank") <= LEADERS)
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    led = cut(led.select(F.col("lead").alias("a"), F.col("cid").alias("b"), "rank", "shared", length.alias("length")))
    near = cut(verify(led.select("a", "b"), sets_of(led), percent))
    nodes = cut(wanted.select(F.col("cid").alias("id")))
    first = cut(components(nodes, near))

    # Classes with a common leader that many of their tokens share are one cluster of candidates.
    close = led.where("rank = 1 and shared >= 0.3 * length").select(F.col("b").alias("cid"), F.col("a").alias("cluster"))
    marked = first.select(F.col("id").alias("cid"), F.col("component_id").alias("label")).join(close, "cid", "left")
    marked = cut(marked.withColumn("cluster", F.coalesce("cluster", "cid")))
    listed = live.join(marked, "cid")
    several = listed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    listed = listed.join(several, "token").select("token", "cid", "n", "place", "label", "cluster")
    listed = listed.repartition("token").sortWithinPartitions("token", "n", "cid")
    across = listed.mapInArrow(_across(percent), "x long, cluster long, spare long")
    met = across.groupBy("x", "cluster").agg(F.count("*").alias("shared"), F.min("spare").alias("spare"))
    met = cut(met.where("shared >= spare").select("x", "cluster"))
    release(spark)
    meeting = marked.join(met.select("cluster").distinct(), "cluster").select(F.col("cid").alias("a")).unionByName(met.select(F.col("x").alias("a")))
    more = cut(connect(met, marked, sets_of(meeting.withColumn("b", F.col("a"))), percent))
    release(spark)

    final = components(first.select(F.col("component_id").alias("id")).distinct(), _between(more, first))
    of = first.join(final.select(F.col("id").alias("component_id"), F.col("component_id").alias("root")), "component_id")
    classed = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    classed = classed.join(of.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(classed.select("cid", "root").join(named, "root").select("cid", "component_id"))
    out = rows.join(told, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _between(links: DataFrame, first: DataFrame) -> DataFrame:
    """Links of classes as links of their first components."""
    a = first.select(F.col("id").alias("a"), F.col("component_id").alias("ca"))
    b = first.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
    return links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
