"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors are one node.  Nodes go to the shards of their nearest centroids of the
same label (the first is their home), shards above a bounded size are split into
blocks, and each block builds a graph whose edges are robustly pruned.  The adjacency
lists of a node from all its shards are united.  Every node is then searched for in
the graph of its home, greedily from the medoid with a beam and then outwards over
all nodes in range; each link is verified by its cosine in double precision.  A link
that could be found from the homes of both its nodes belongs to one of them, the
smaller, and one between blocks of a home to the turn of the smaller block; so every
task counts the links it owns and sends on a count a node and a forest that connects
them, and no pair is ever a row.  A sample of nodes is compared with all others to audit the recall per node, of
those with few links and with many, and the overlap is doubled if it is too low.  If
an overlap of 32 is not enough, all blocks of a label are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import components, cut, free, table
from quire.llm.vectors import matrix, usable

LEAST = 0.93
SHARD = 1000
CENTROIDS = 4096
BLOCK = 2048
OVERLAP = 4
DEGREE = 24
BEAM = 16
ALPHA = 1.2
AUDITED = 2000
#: Pairs of vectors that are gathered at once.
GATHER = 1 << 14
#: Links up to which a node is audited apart from those of large groups.
FEW = 10
RECALL = 0.95


def robust_prune(unit: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> list[np.ndarray]:
    """Neighbours of each row: the nearest stay unless a kept one is closer to them by the factor ``alpha``."""
    n = len(unit)
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    pool = min(pool, n - 1)
    out = []
    for i in range(n):
        some = np.argpartition(-near[i], pool - 1)[:pool] if pool < n - 1 else np.delete(np.arange(n), i)
        some = some[np.argsort(-near[i, some], kind="stable")]
        far = np.sqrt(np.maximum(0, 2 - 2 * near[i, some]))
        between = np.sqrt(np.maximum(0, 2 - 2 * near[np.ix_(some, some)]))
        alive = np.ones(len(some), bool)
        kept: list[int] = []
        for j in range(len(some)):
            if alive[j] or len(kept) < 4:
                kept.append(j)
                if len(kept) == degree:
                    break
                alive &= alpha * between[j] > far
        out.append(some[kept])
    return out


def padded(lists: list[np.ndarray], n: int, back: int = DEGREE) -> np.ndarray:
    """Adjacency as rows of equal length, with up to ``back`` edges the other way each; n stands for none."""
    degree = np.array([len(x) for x in lists], np.int64)
    rows, cols = np.repeat(np.arange(n), degree), np.concatenate(lists).astype(np.int64)
    order = np.argsort(cols, kind="stable")
    into = np.bincount(cols, minlength=n)
    turn = np.arange(len(cols)) - np.repeat(np.cumsum(into) - into, into)
    kept = order[turn < back]
    rows, cols = np.concatenate([rows, cols[kept]]), np.concatenate([cols, rows[kept]])
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    degree = np.bincount(rows, minlength=n)
    out = np.full((n, max(1, int(degree.max(initial=0)))), n, np.int32)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(degree) - degree, degree)] = cols
    return out


def range_search(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Whether [query, node] was found in range: a greedy beam from the medoid, then outwards over nodes in range.

    ``own`` is each query's own node, or -1; its neighbours are seen as well.
    """
    n = len(unit)
    found = np.zeros((len(queries), n), bool)
    medoid = int(np.argmax(unit @ unit.mean(axis=0)))
    ext = np.vstack([unit, np.zeros((1, unit.shape[1]))])
    step = max(16, (1 << 17) // (n + 1))
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        count = len(q)
        score = np.full((count, n + 1), -3.0)
        score[:, medoid] = q @ unit[medoid]
        seen = np.zeros((count, n + 1), bool)
        seen[:, [n, medoid]] = True
        done = np.zeros((count, n + 1), bool)
        done[:, n] = True
        pool = np.full((count, beam), n)
        pool[:, 0] = medoid
        active = np.arange(count)
        while len(active):
            todo = np.where(done[active[:, None], pool[active]], -4.0, score[active[:, None], pool[active]])
            best = pool[active, np.argmax(todo, axis=1)]
            going = todo.max(axis=1) > -3.5
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            new = graph[best]
            fresh = ~seen[active[:, None], new]
            value = np.einsum("ijk,ik->ij", ext[new], q[active])
            r, c = np.nonzero(fresh)
            score[active[r], new[r, c]] = value[r, c]
            seen[active[r], new[r, c]] = True
            both = np.concatenate([pool[active], np.where(fresh, new, n)], axis=1)
            order = np.argpartition(-score[active[:, None], both], beam - 1, axis=1)[:, :beam]
            pool[active] = np.take_along_axis(both, order, axis=1)
        mine = own[lo : lo + step]
        with_own = np.flatnonzero(mine >= 0)
        seen[with_own, mine[with_own]] = True
        score[with_own, mine[with_own]] = np.einsum("ij,ij->i", q[with_own], unit[mine[with_own]])
        hits = found[lo : lo + step]
        hits[:] = score[:, :n] >= least
        fr, fv = np.nonzero(hits)
        while len(fr):
            next_r, next_v = [], []
            for at in range(0, len(fr), 4096):
                near = graph[fv[at : at + 4096]]
                r, v = np.repeat(fr[at : at + 4096], near.shape[1]), near.ravel()
                fresh = ~seen[r, v]
                key = np.unique(r[fresh] * (n + 1) + v[fresh])
                r, v = key // (n + 1), key % (n + 1)
                seen[r, v] = True
                hit = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", q[r[k : k + GATHER]], ext[v[k : k + GATHER]]) >= least for k in range(0, len(r), GATHER))])
                hits[r[hit], v[hit]] = True
                next_r.append(r[hit])
                next_v.append(v[hit])
            fr, fv = np.concatenate(next_r), np.concatenate(next_v)
    return found


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of edges that connect the rows and columns of a relation as it does, fewer than there are of both."""
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    a, b = [], []
    while rows.any():
        front = np.array([int(np.argmax(rows))])
        rows[front] = False
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & cols)
            cols[new] = False
            a.append(front[np.argmax(linked[np.ix_(front, new)], axis=0)])
            b.append(new)
            front = np.flatnonzero(linked[:, new].any(axis=1) & rows)
            rows[front] = False
            a.append(front)
            b.append(new[np.argmax(linked[np.ix_(front, new)], axis=1)] if len(front) else new[:0])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _assign(centroids: dict[str, np.ndarray], overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.array(batch.column(1).to_pylist(), object)
            vectors = batch.column(2).to_pylist()
            rows, cells, homes, lists = [], [], [], []
            for name in set(label.tolist()):
                own = np.flatnonzero(label == name)
                points = centroids.get(name)
                for i in own:
                    v = np.array(vectors[i])
                    usable_ = points[len(v)] if points and len(v) in points else None
                    near = np.array([-1]) if usable_ is None else np.argsort(-(usable_[1] @ (v / np.linalg.norm(v))), kind="stable")[:overlap]
                    ids = near if usable_ is None else usable_[0][near]
                    rows += [i] * len(ids)
                    cells += ids.tolist()
                    homes += [True] + [False] * (len(ids) - 1)
                    lists += [ids.tolist()] * len(ids)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int64()), pa.array(homes), pa.array(lists, pa.list_(pa.int64()))], ["cid", "label", "v", "cell", "home", "cells"])

    return run


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    cid = rows["cid"].to_numpy()
    if len(cid) < 2:
        return pd.DataFrame({"cid": cid, "near": [[] for _ in cid]})
    unit = np.stack(rows["v"].to_numpy())
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return pd.DataFrame({"cid": cid, "near": [cid[x].tolist() for x in robust_prune(unit)]})


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component of a symmetric relation."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            reached = np.zeros(len(linked), bool)
            reached[i] = True
            front = reached
            while front.any():
                front = linked[front].any(axis=0) & ~reached
                reached |= front
            root[reached] = i
    return root


def _search(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows (x, y, n): links of x owned here (y null), or an edge of a forest of them (n null)."""
        nodes, asked = rows[rows["node"]], rows[~rows["node"]]
        own_turn = key[3] == key[4]
        empty = pd.DataFrame({"x": np.zeros(0, np.int64), "y": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if not len(nodes) or not (own_turn or len(asked)):
            return empty
        nodes = nodes.iloc[np.argsort(nodes["cid"].to_numpy())]
        cid, home, copies = nodes["cid"].to_numpy(), nodes["home"].to_numpy(), nodes["copies"].to_numpy()
        unit = np.stack(nodes["v"].to_numpy())
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        lists = []
        for near in nodes["near"]:
            near = np.array(near if near is not None else [], np.int64)
            at = np.minimum(np.searchsorted(cid, near), len(cid) - 1)
            lists.append(at[cid[at] == near] if len(near) else np.zeros(0, np.int64))
        graph = padded(lists, len(cid))
        if own_turn:
            at = np.flatnonzero(home)
            if not len(at):
                return empty
            some = nodes.iloc[at]
            hits = range_search(unit, graph, unit[at], at, least)
            hits[:, at] |= hits[:, at].T
            hits[np.arange(len(at)), at] = False
        else:  # homes of another block of this cell
            some, q = asked, np.stack(asked["v"].to_numpy())
            hits = range_search(unit, graph, q / np.linalg.norm(q, axis=1, keepdims=True), np.full(len(q), -1), least)
            if key[4] > key[3]:
                hits[:, home] = False
        # The link to a node of another home is that home's, if it is the smaller and meets this node too.
        away = np.array([c[0] for c in nodes["cells"]], np.int64)
        there = np.array([list(c) for c in some["cells"]], np.int64)
        smaller = away < key[2]
        for column in there.T:
            hits &= ~(smaller & (column[:, None] == away))
        who, own = some["cid"].to_numpy(), some["copies"].to_numpy()
        n = hits @ copies
        back = own @ hits
        if own_turn:
            back[home] = 0  # both directions are in the rows
        x, y = np.flatnonzero(n), np.flatnonzero(back)
        a, b = forest(hits)
        none = lambda k: [None] * k
        return pd.DataFrame({
            "x": np.concatenate([who[x], cid[y], who[a]]), "y": pd.array(none(len(x) + len(y)) + cid[b].tolist(), "Int64"),
            "n": pd.array(n[x].tolist() + back[y].tolist() + none(len(a)), "Int64"),
        })

    return run


def links(nodes: DataFrame, least: float, overlap: int, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(cid, n) links of each node and (a, b) edges that connect the same nodes; ``nodes`` has cid, label, v, copies."""
    n = nodes.count()
    wanted = min(CENTROIDS, n // shard)
    chosen = nodes.orderBy(F.xxhash64("cid", F.lit(7)), "cid").limit(wanted).select("label", "v").collect() if wanted else []
    centroids: dict = {}
    for i, row in enumerate(chosen):
        v = np.array(row["v"])
        centroids.setdefault(row["label"], {}).setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
    centroids = {k: {d: (np.array([i for i, _ in x]), np.stack([v for _, v in x])) for d, x in by.items()} for k, by in centroids.items()}
    placed = nodes.select("cid", "label", "v").mapInArrow(_assign(centroids, overlap), "cid long, label string, v array<double>, cell long, home boolean, cells array<long>")
    placed = placed.withColumn("dims", F.size("v"))
    cell = ["label", "dims", "cell"]
    sizes = placed.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    placed = cut(placed.join(sizes, cell).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks"))).join(nodes.select("cid", "copies"), "cid"))
    built = placed.groupBy(*cell, "i").applyInPandas(_build, "cid long, near array<long>")
    graph = built.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    joined = placed.join(graph, "cid").withColumn("j", every).withColumn("node", F.lit(True))
    asked = placed.where("home and blocks > 1").withColumn("near", F.lit(None).cast("array<long>")).withColumn("j", F.col("i")).drop("i").withColumn("i", every)
    asked = asked.where("i <> j").withColumn("node", F.lit(False)).select(*joined.columns)
    found = cut(joined.unionByName(asked).groupBy(*cell, "i", "j").applyInPandas(_search(least), "x long, y long, n long"))
    free(placed)
    total = found.where("y is null").groupBy(F.col("x").alias("cid")).agg(F.sum("n").alias("n"))
    return total, found.where("n is null").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _exact(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows (x, y, n) as of ``_search`` of all links between two blocks, or inside one."""
        rows = rows.sort_values(["i", "cid"])
        cid, copies, left = rows["cid"].to_numpy(), rows["copies"].to_numpy(), rows["i"].to_numpy() == key[2]
        unit = np.stack(rows["v"].to_numpy())
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        near = unit @ unit.T >= least
        near |= near.T
        if key[2] != key[3]:
            near &= left[:, None] != left
        np.fill_diagonal(near, False)
        n, root = near @ copies, _roots(near)
        linked, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(cid)))
        return pd.DataFrame({
            "x": np.concatenate([cid[linked], cid[moved]]), "y": pd.array([None] * len(linked) + cid[root[moved]].tolist(), "Int64"),
            "n": np.concatenate([n[linked], np.full(len(moved), -1)]),
        })

    return run


def exact(nodes: DataFrame, least: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``links`` returns, by comparing every block of a label with every other."""
    kind = ["label", "dims"]
    placed = nodes.select("cid", "label", "v", "copies").withColumn("dims", F.size("v"))
    sizes = placed.groupBy(*kind).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    placed = placed.join(sizes, kind).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumn("a", F.least("i", "k")).withColumn("b", F.greatest("i", "k"))
    found = cut(placed.groupBy(*kind, "a", "b").applyInPandas(_exact(least), "x long, y long, n long"))
    total = found.where("y is null").groupBy(F.col("x").alias("cid")).agg(F.sum("n").alias("n"))
    return total, found.where("n = -1").select(F.col("x").alias("a"), F.col("y").alias("b"))


def audit(nodes: DataFrame, found: DataFrame, least: float, sample: int = AUDITED) -> float:
    """Share of its links that a node of a bounded sample has found, on average: the lower one of nodes with few links and with many."""
    rows = nodes.orderBy(F.xxhash64("cid", F.lit(11)), "cid").limit(sample).select("cid", "label", "v").collect()
    if not rows:
        return 1.0
    by: dict = {}
    for r in rows:
        v = np.array(r["v"])
        by.setdefault((r["label"], len(v)), []).append((r["cid"], v / np.linalg.norm(v)))
    by = {k: (np.array([c for c, _ in x]), np.stack([u for _, u in x])) for k, x in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label, vectors, copies = (c.to_pylist() for c in batch.columns)
            groups: dict = {}
            for i, v in enumerate(vectors):
                groups.setdefault((label[i], len(v)), []).append(i)
            total: dict[int, int] = {}
            for kind in groups.keys() & by.keys():
                own = groups[kind]
                v = np.array([vectors[i] for i in own])
                ids, unit = by[kind]
                near = unit @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T >= least
                near &= ids[:, None] != np.array([cid[i] for i in own])
                for other, n in zip(ids.tolist(), (near @ np.array([copies[i] for i in own])).tolist(), strict=True):
                    if n:
                        total[other] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cid", "n"])

    truth = {r["cid"]: r["n"] for r in nodes.select("cid", "label", "v", "copies").mapInArrow(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n")).collect()}
    got = {r["cid"]: r["n"] for r in found.where(F.col("cid").isin([r["cid"] for r in rows])).collect()}
    share = [(n, min(n, got.get(cid, 0)) / n) for cid, n in truth.items()]
    parts = [[x for n, x in share if (n <= FEW) == few] for few in (True, False)]
    return min((sum(x) / len(x) for x in parts if x), default=1.0)


def dedup(vectors: DataFrame, least: float = LEAST, overlap: int = OVERLAP, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all ``vectors`` (vec_id, embedding, label).

    Vectors that are null, zero or hold null or non-finite components, and those with
    a null label or id, link with nothing; rows that repeat an id come once, with
    their smallest usable vector.  Equal vectors of a label are links of each other.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string"))
    ids = rows.select("vec_id").distinct()
    good = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    good = cut(good.withColumn("h", F.xxhash64("v")))
    nodes = cut(good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")))
    while True:
        counted, edges = links(nodes, least, overlap)
        counted = cut(counted)
        if audit(nodes, counted, least) >= recall:
            break
        if overlap >= 32:
            counted, edges = exact(nodes, least)
            counted = cut(counted)
            break
        overlap *= 2
    roots = components(nodes.select(F.col("cid").alias("id")), edges)
    told = nodes.join(counted, "cid", "left").join(roots.withColumnRenamed("id", "cid"), "cid")
    told = told.select("label", "h", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    member = good.join(told, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    out = ids.join(member, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
