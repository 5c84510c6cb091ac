"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


@dataclass(frozen=True)
class HnswConfig:
    """links: of a node on the upper levels; twice as many on the lowest. ef_build,
    ef_search: nodes that a search keeps. shard: distinct vectors per graph, about.
    queries: distinct query vectors that a task searches a shard for, about; a graph is copied once for
    so many, and so is small beside them."""

    links: int = 16
    ef_build: int = 64
    ef_search: int = 96
    shard: int = 10_000
    queries: int = 65_536
    batch: int = 512
    expand: int = 4
    seed: int = 5


def augmented(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one component more, so that all have the same norm: among such,
    the largest inner product is the smallest distance. A query has 0 there. The vectors are scaled
    so that their largest component is about 1."""
    scaled = unit(vectors)
    square = (scaled**2).sum(axis=1)
    return np.concatenate([scaled, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """vectors by a power of two, which loses nothing, so that the largest component lies below 1."""
    return np.ldexp(vectors, -int(np.frexp(np.abs(vectors).max())[1])) if vectors.size else vectors


def _search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, ef: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """For all queries in step, the ef best nodes that best-first search meets, best first; -1: none.

    entries has a row of start nodes for each query, -1 for none.
    """
    n = len(q)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the padding
    ids = np.full((n, ef), -1)
    sims = np.full((n, ef), -np.inf, np.float32)
    opened = np.ones((n, ef), bool)
    active, new = np.arange(n), entries
    while len(active):
        fresh = (new >= 0) & ~seen[active[:, None], new]
        if new.shape[1] > 1:  # a node that several expanded nodes link to counts once
            order = np.sort(np.where(fresh, new, -1), axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            new, fresh = order, order >= 0
        seen[active[:, None], np.where(fresh, new, len(x))] = True
        s = np.where(fresh, np.einsum("bkd,bd->bk", x[new], q[active]), -np.inf)
        both, all_ids = np.concatenate([sims[active], s], axis=1), np.concatenate([ids[active], np.where(fresh, new, -1)], axis=1)
        all_open = np.concatenate([opened[active], ~fresh], axis=1)
        top = np.argpartition(-both, ef - 1, axis=1)[:, :ef] if both.shape[1] > ef else np.argsort(-both, axis=1)[:, :ef]
        sims[active], ids[active], opened[active] = np.take_along_axis(both, top, 1), np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_open, top, 1)
        todo = np.where(opened[active], -np.inf, sims[active])
        best = np.argpartition(-todo, expand - 1, axis=1)[:, :expand]
        some = np.take_along_axis(todo, best, 1) > -np.inf
        going = some.any(axis=1)
        active, best, some = active[going], best[going], some[going]
        if not len(active):
            break
        chosen = np.where(some, ids[active[:, None], best], -1)
        rows, cols = np.nonzero(some)
        opened[active[rows], best[rows, cols]] = True
        new = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """For each node of own up to m of its candidates, best first: those nearer to the node than
    to any chosen before, then the best of the others."""
    b, c = candidates.shape
    y = x[candidates]
    among = np.matmul(y, y.transpose(0, 2, 1))
    valid = candidates >= 0
    chosen = np.zeros((b, c), bool)
    count = np.zeros(b, np.int64)
    for i in range(c):
        nearer = ~(chosen & (among[:, i, :] > sims[:, i, None])).any(axis=1)
        take = valid[:, i] & nearer & (count < m)
        chosen[:, i] = take
        count += take
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(np.where(valid, candidates, -1), order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> None:
    """The links of nodes are made mutual; a list that is then too long is chosen anew."""
    m = links.shape[1]
    source, target = np.repeat(nodes, m), links[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, begins, counts = np.unique(target, return_index=True, return_counts=True)
    for part in np.array_split(np.arange(len(touched)), max(1, len(touched) // 512)):
        if not len(part):
            continue
        width = int(counts[part].max())
        extra = np.full((len(part), width), -1)
        col = np.arange(width)
        mask = col < counts[part][:, None]
        extra[mask] = source[np.concatenate([np.arange(begins[i], begins[i] + counts[i]) for i in part])]
        both = np.sort(np.concatenate([links[touched[part]], extra], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.where(both >= 0, np.einsum("bkd,bd->bk", x[both], x[touched[part]]), -np.inf)
        top = np.argsort(-sims, axis=1)[:, : 2 * m]
        links[touched[part]] = _diverse(x, touched[part], np.take_along_axis(both, top, 1), np.take_along_axis(sims, top, 1), m)


def _insert(x: np.ndarray, order: np.ndarray, m: int, entry_of, cfg: HnswConfig) -> np.ndarray:
    """A level's links: its nodes go in by growing batches, each linked with what a search
    of the graph so far finds and with its own batch."""
    links = np.full((len(x), m), -1, np.int64)
    done = 0
    while done < len(order):
        batch = order[done : done + max(64, min(cfg.batch, done))]
        near = x[batch] @ x[batch].T
        np.fill_diagonal(near, -np.inf)
        top = np.argsort(-near, axis=1)[:, : cfg.ef_build // 2]
        ids, sims = batch[top], np.take_along_axis(near, top, 1)
        if done:
            start = entry_of(batch, order[:done])
            found, s = _search(x, links, start, x[batch], cfg.ef_build, cfg.expand)
            ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, s], axis=1)
        ids = np.where(np.isfinite(sims), ids, -1)
        best = np.argsort(-sims, axis=1)[:, : cfg.ef_build]
        links[batch] = _diverse(x, batch, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1), m)
        _link_back(x, links, batch)
        done += len(batch)
    return links


@dataclass
class Graph:
    """nodes: of each level from the top, as numbers of vectors. links: per level a flat
    array of as many numbers for each of its nodes; -1 pads."""

    nodes: list[np.ndarray]
    links: list[np.ndarray]

    def entries(self, x: np.ndarray, q: np.ndarray, expand: int) -> np.ndarray:
        """The best start nodes on the lowest level, from the top down."""
        start = np.zeros((len(q), 1), np.int64)
        for nodes, below, links in zip(self.nodes[:-1], self.nodes[1:], self.links[:-1], strict=True):
            found, _ = _search(x[nodes], links, start, q, 8, expand)
            real = np.where(found[:, :4] >= 0, nodes[found[:, :4]], nodes[found[:, :1]])
            start = np.searchsorted(below, real)
        return start


def build(x: np.ndarray, cfg: HnswConfig = HnswConfig()) -> Graph:
    """A graph of the rows of x, which have equal norms. Each level has one in cfg.links of the nodes below it."""
    rng = np.random.default_rng(cfg.seed)
    levels = [np.arange(len(x))]
    while len(levels[-1]) > 4 * cfg.links:
        levels.append(np.sort(rng.choice(levels[-1], len(levels[-1]) // cfg.links, replace=False)))
    graph = Graph([], [])
    for level, nodes in enumerate(reversed(levels)):
        lowest = level == len(levels) - 1
        own = x[nodes]
        order = rng.permutation(len(nodes))
        if graph.nodes:
            upper = np.searchsorted(nodes, graph.nodes[-1])  # first, so that descents end on linked nodes
            order = np.concatenate([upper[rng.permutation(len(upper))], order[~np.isin(order, upper)]])

        def entry_of(batch: np.ndarray, present: np.ndarray, own=own, nodes=nodes) -> np.ndarray:
            if not graph.nodes or len(present) < len(graph.nodes[-1]):
                return np.repeat(present[: min(4, len(present))][None, :], len(batch), axis=0)
            return Graph([*graph.nodes, nodes], [*graph.links, np.zeros((0, 1))]).entries(x, own[batch], cfg.expand)

        links = _insert(own, order, cfg.links * (2 if lowest else 1), entry_of, cfg)
        graph.nodes.append(nodes)
        graph.links.append(links)
    return graph


_INDEX = "dim int, shard int, n int, vectors binary, ids binary, id_counts binary, level_sizes array<int>, nodes binary, links binary"


def _index(cfg: HnswConfig):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        table = table.sort_by("cid")
        vectors = table.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        graph = build(augmented(vectors), cfg)
        lists = table.column("ids").combine_chunks()
        row = {"dim": dim, "shard": shard, "n": len(vectors), "vectors": vectors.tobytes(), "ids": lists.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "id_counts": np.diff(lists.offsets.to_numpy()).astype("<i4").tobytes(), "level_sizes": [len(v) for v in graph.nodes], "nodes": np.concatenate(graph.nodes).astype("<i4").tobytes(), "links": np.concatenate([v.ravel() for v in graph.links]).astype("<i4").tobytes()}
        types = {"dim": pa.int32(), "shard": pa.int32(), "n": pa.int32(), "level_sizes": pa.list_(pa.int32())}
        return pa.table({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})

    return run


def _load(row: dict, links: int) -> Graph:
    nodes = np.split(np.frombuffer(row["nodes"], "<i4").astype(np.int64), np.cumsum(row["level_sizes"])[:-1])
    widths = [links] * (len(nodes) - 1) + [2 * links]
    flat, at, out = np.frombuffer(row["links"], "<i4").astype(np.int64), 0, []
    for own, w in zip(nodes, widths, strict=True):
        out.append(flat[at : at + len(own) * w].reshape(-1, w))
        at += len(own) * w
    return Graph(nodes, out)


def _answers(cfg: HnswConfig, k: int):
    """For one shard and some queries, the k best ids of each: cid, vec_id, score."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and queries.num_rows:
            row = index.to_pylist()[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
            x, graph = augmented(vectors), _load(row, cfg.links)
            counts = np.frombuffer(row["id_counts"], "<i4").astype(np.int64)
            ids, first = np.frombuffer(row["ids"], "<i8"), np.concatenate([[0], np.cumsum(counts)])
            cids = queries.column("cid").to_numpy()
            q = queries.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(cids), -1)
            near = np.concatenate([np.array([unit(v) for v in q]).reshape(q.shape).astype(np.float32), np.zeros((len(q), 1), np.float32)], axis=1)
            for lo in range(0, len(q), cfg.batch):
                plus = near[lo : lo + cfg.batch]
                found, _ = _search(x, graph.links[-1], graph.entries(x, plus, cfg.expand), plus, max(cfg.ef_search, k), cfg.expand)
                for i, own in enumerate(found):
                    own = own[own >= 0]
                    score = np.array([np.dot(vectors[j], q[lo + i]) for j in own], np.float64)
                    every = np.concatenate([ids[first[j] : first[j + 1]] for j in own]) if len(own) else np.zeros(0, np.int64)
                    scores = np.repeat(score, counts[own])
                    best = np.lexsort((every, -scores))[:k]
                    out.append((np.full(len(best), cids[lo + i]), every[best], scores[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"cid": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", cfg: HnswConfig = HnswConfig()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries its k nearest rows of vectors
    but itself, by the largest inner product in double precision, ties to the smaller id.

    Equal vectors are one node of a graph, which keeps their k + 1 smallest ids:
    no answer needs more of them. Nodes are dealt into shards of about cfg.shard by
    a hash; each shard's graph is one row of flat arrays. Distinct query vectors
    meet each shard in groups of about cfg.queries, and the shards' answers are
    merged. That is every query against every shard, in blocks; a task holds one
    graph and one group. Graphs are built and searched in single precision, on scaled
    vectors; scores are of the vectors as given, in double precision.

    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do rows with a null id. Vectors of different lengths aren't compared.
    Fewer than k candidates are all returned. Queries are rows of vectors too: of
    rows that repeat an id each counts as a candidate. Empty tables give an empty
    result; extra columns aren't read.
    """

    def valid(df: DataFrame) -> DataFrame:
        finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        return df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda v: v != 0))

    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = valid(vectors).withColumn("place", place).where(f"place <= {k + 1}")
    nodes = materialize(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("vector", "ids", F.col("ids")[0].alias("cid"), F.size("vector").alias("dim")), "nodes")
    shards = max(1, -(-nodes.count() // cfg.shard))
    own_shard = F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard")
    index = materialize(nodes.select("dim", own_shard, "cid", "vector", "ids").groupBy("dim", "shard").applyInArrow(_index(cfg), _INDEX), "index")

    asked = materialize(valid(queries).join(nodes.select("vector", "cid"), "vector").select(F.col("vec_id").alias("query_id"), "cid"), "asked")
    distinct = materialize(nodes.join(asked.select("cid").distinct(), "cid").select("dim", "cid", "vector"), "query-vectors")
    groups = max(1, -(-distinct.count() // cfg.queries))
    group = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(groups)).cast("int").alias("group")
    key = ["dim", "shard", "group"]
    asking = distinct.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), group, "cid", "vector")
    asked_of = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    answers = asked_of.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(_answers(cfg, k + 1), "cid long, vec_id long, score double")

    order = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    merged = answers.withColumn("place", F.row_number().over(order)).where(f"place <= {k + 1}")
    merged = materialize(merged.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")), "merged")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(merged, "cid").select("query_id", F.posexplode(others).alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
