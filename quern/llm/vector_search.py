"""Approximate nearest neighbours (operator 12): a hierarchical navigable small-world graph per shard.

Equal vectors are one node that knows its smallest ids, found behind a limit per group that works before the shuffle,
so a vector that a third of all rows hold is a few rows. Nodes are dealt to shards of bounded bytes by a hash of the
vector. Each shard is one task's graph: nodes are ordered by level, so layer l is the first n_l nodes, and its links
are one flat array of n_l times CAP node numbers. Layers are built from the top, nodes in batches whose searches run
together in numpy. A shard is one row of the index table: vectors, ids, layer sizes and links as bytes.

A search packs queries into blocks and sends each block to every shard; a task holds one shard and streams the blocks
past it. Each shard gives its nearest ids with distances in double precision on the original vectors, and the lists
are merged by a limit per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import mix64, partitions, small_batches, staged, trim

#: Links chosen for a new node; links that a node holds at most, and keeps when it had more.
LINKS, CAP, PRUNED = 16, 32, 24
#: Beam while building and while searching; nodes of a beam that are expanded together; searches that run together.
BUILD_BEAM, SEARCH_BEAM, EXPAND, TOGETHER = 64, 128, 4, 256
#: Bytes of a shard's vectors as doubles; nodes of a shard at least, where there are partitions to fill; queries of a block.
SHARD_BYTES, SHARD_LEAST, QUERIES = 4 << 20, 1024, 4096


def _distances(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q's rows to the rows of x named by at's rows."""
    d = x[at] - q[:, None, :]
    return np.einsum("akd,akd->ak", d, d)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances (nearest first, -1 and inf where there are fewer) of the beam nodes found per query."""
    n, rows = len(q), np.arange(len(q))
    found, dist = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(links)), bool)
    found[:, 0], dist[:, 0], done[:, 0] = entry, _distances(x, entry[:, None], q)[:, 0], False
    seen[rows, entry] = True
    live = rows
    while live.size:
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argsort(open_, axis=1, kind="stable")[:, :EXPAND]
        some = np.isfinite(np.take_along_axis(open_, pick, 1))
        go = some.any(1)
        live, pick, some = live[go], pick[go], some[go]
        if not live.size:
            break
        r, c = np.nonzero(some)
        done[live[r], pick[r, c]] = True
        near = np.where(some[:, :, None], links[np.where(some, found[live[:, None], pick], 0)], -1).reshape(live.size, -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        width = int(new.sum(1).max(initial=0))
        if not width:
            continue
        near = np.take_along_axis(near, np.argsort(~new, axis=1, kind="stable")[:, :width], 1)
        new = np.take_along_axis(new, np.argsort(~new, axis=1, kind="stable")[:, :width], 1)
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        d = np.where(new, _distances(x, np.maximum(near, 0), q[live]), np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        found[live] = np.take_along_axis(np.concatenate([found[live], np.where(new, near, -1)], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), order, 1)
    return found, dist


def _chosen(x: np.ndarray, at: np.ndarray, dist: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Which candidates (rows of at, nearest first, -1 for none) become links: each one nearer to the node than to any
    link before it, at most most; with fill the nearest others take the places left."""
    p = x[np.maximum(at, 0)]
    gram = p @ p.transpose(0, 2, 1)
    norm = np.einsum("akk->ak", gram)
    pair = norm[:, :, None] + norm[:, None, :] - 2 * gram
    picked, there, count = np.zeros(at.shape, bool), at >= 0, np.zeros(len(at), int)
    for j in range(at.shape[1]):
        ok = there[:, j] & (count < most) & ~((pair[:, j, :] <= dist[:, j, None]) & picked).any(1)
        picked[:, j] = ok
        count += ok
    if fill:
        rest = there & ~picked
        picked |= rest & (np.cumsum(rest, 1) <= (most - count)[:, None])
    return picked


class Graph:
    """The layers of one shard; vectors in the order of the nodes' levels, the highest first."""

    def __init__(self, x: np.ndarray, sizes: list[int], links: list[np.ndarray] | None = None) -> None:
        self.x, self.sizes, self.links = x, sizes, links or []

    @staticmethod
    def levels(ids: np.ndarray) -> np.ndarray:
        """A node's level: geometric with ratio 1 / LINKS, by a hash of its smallest id."""
        u = (mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)
        return np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(int)

    @classmethod
    def build(cls, x: np.ndarray, level: np.ndarray) -> Graph:
        """x in the order of falling levels."""
        graph = cls(x, [int((level >= top).sum()) for top in range(int(level[0]), -1, -1)])
        for size in graph.sizes:
            graph._layer(size)
        return graph

    def _layer(self, size: int) -> None:
        links, degree = np.full((size, CAP), -1, np.int32), np.zeros(size, int)
        done = 0
        while done < size:
            new = np.arange(done, min(size, done + TOGETHER))
            q = self.x[new]
            d = self._pairs(q)
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, axis=1, kind="stable")[:, : LINKS if done else BUILD_BEAM]
            at, dist = (near + done).astype(np.int32), np.take_along_axis(d, near, 1)
            at[~np.isfinite(dist)] = -1
            if done:
                entry = self._descend(q)
                found, fd = beam_search(self.x, links[:done], q, np.where(entry < done, entry, 0), BUILD_BEAM)
                dist = np.concatenate([fd, dist], 1)
                order = np.argsort(dist, axis=1, kind="stable")[:, :BUILD_BEAM]
                at, dist = np.take_along_axis(np.concatenate([found, at], 1), order, 1), np.take_along_axis(dist, order, 1)
            picked = _chosen(self.x, at, dist, LINKS, True)
            r, c = np.nonzero(picked)
            self._link(links, degree, new[r], at[r, c])
            self._link(links, degree, at[r, c], new[r])
            done += new.size
        self.links.append(links)

    @staticmethod
    def _pairs(q: np.ndarray) -> np.ndarray:
        norm = np.einsum("kd,kd->k", q, q)
        return np.maximum(norm[:, None] + norm[None, :] - 2 * q @ q.T, 0)

    def _link(self, links: np.ndarray, degree: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        """Add links src -> dst; a node with more than CAP of them keeps PRUNED chosen ones."""
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(src, return_index=True, return_counts=True)
        room = degree[nodes] + count <= CAP
        rows = np.repeat(room, count)
        slot = np.arange(src.size) - np.repeat(first, count) + degree[src]
        links[src[rows], slot[rows]] = dst[rows]
        degree[nodes[room]] += count[room]
        full = np.flatnonzero(~room)
        for some in np.array_split(full, max(1, -(-full.size // 32))) if full.size else []:
            width = CAP + int(count[some].max())
            at = np.full((some.size, width), -1, np.int32)
            at[:, :CAP] = links[nodes[some]]
            for k, i in enumerate(some):
                at[k, CAP : CAP + count[i]] = dst[first[i] : first[i] + count[i]]
            at = np.sort(at, axis=1)
            at[:, 1:][at[:, 1:] == at[:, :-1]] = -1
            dist = np.where(at >= 0, _distances(self.x, np.maximum(at, 0), self.x[nodes[some]]), np.inf)
            order = np.argsort(dist, axis=1, kind="stable")
            at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
            keep = _chosen(self.x, at, dist, PRUNED, True)
            for k, i in enumerate(some):
                kept = at[k, keep[k]]
                links[nodes[i]], degree[nodes[i]] = -1, kept.size
                links[nodes[i], : kept.size] = kept

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """The nearest node that a greedy walk through the finished layers above finds for each query."""
        at = np.zeros(len(q), np.int32)
        for links in self.links:
            at = beam_search(self.x, links, q, at, 1)[0][:, 0]
        return at

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Node numbers of the beam nearest found for each query, nearest first, -1 where there are fewer."""
        out = []
        for i in range(0, len(q), TOGETHER):
            some = q[i : i + TOGETHER]
            base, self.links = self.links[-1], self.links[:-1]
            entry = self._descend(some)
            self.links = [*self.links, base]
            out.append(beam_search(self.x, base, some, entry, beam)[0])
        return np.concatenate(out) if out else np.empty((0, beam), np.int32)


def taking_part(v: Column) -> Column:
    """Vectors that are not null or zero and hold no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: one vector for each id that takes part; of several the least."""
    v = df[vector_col] if df.schema[vector_col].dataType.elementType.typeName() in ("float", "double") else df[vector_col].cast("array<double>")
    rows = df.select(df[id_col].cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & taking_part(F.col("v")))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


_COLUMNS = "dim int, shard long, kind int, vectors binary, ids array<long>, firsts array<int>, sizes array<int>, links binary"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_ARROW = pa.schema(list(zip(_NAMES, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()], strict=True)))


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _row(dim: int, shard: int | None, kind: int, vectors: np.ndarray, ids, firsts, sizes, links: bytes) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_NAMES, (dim, shard, kind, np.ascontiguousarray(vectors).tobytes(), ids, firsts, sizes, links), strict=True))], schema=_ARROW)


def _build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    ids = t.column("ids").to_pylist()
    level = Graph.levels(np.array([i[0] for i in ids], np.int64))
    order = np.lexsort((np.array([i[0] for i in ids]), -level))
    v = _matrix(t.column("v"), dim)[order]
    graph = Graph.build(v.astype(np.float64), level[order])
    ids = [ids[i] for i in order]
    out = _row(dim, shard, 0, v, sum(ids, []), np.cumsum([0, *map(len, ids)]).tolist(), graph.sizes, b"".join(x.tobytes() for x in graph.links))
    trim()
    return out


def build_index(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index: one row per dimension and shard, for searches of up to k neighbours.

    Every vector that takes part is found in it (null, zero and non-finite ones and rows without an id take none; an
    id has one vector, the least of its). Equal vectors are one node with its k + 1 smallest ids, of which k are not
    the query's own. An empty table gives an empty index.
    """
    rows = _vectors(df, id_col, vector_col).withColumn("h", F.xxhash64("v"))
    order = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    nodes = rows.withColumn("_r", order).filter(F.col("_r") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = staged(nodes.select("v", "ids", F.size("v").alias("dim")), "nodes")
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    p = partitions(df.sparkSession)
    shards = max(1, -(-facts.n * (facts.dim or 1) * 8 // SHARD_BYTES), min(p, facts.n // SHARD_LEAST))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(12), "v"), F.lit(shards)))
    return staged(dealt.groupBy("dim", "shard").applyInArrow(_build, _COLUMNS), "index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each query vector, without its own id.

    score is the Euclidean distance in double precision, summed in the order of the components; ties go to smaller
    ids. Queries take part like rows of the index and meet vectors of their dimension; where fewer than k others
    exist all found are given. k is at most the index's. An empty index or query table gives an empty result.
    """
    spark = queries.sparkSession
    small_batches(spark, 100)
    found = staged(_vectors(queries, id_col, vector_col), "queries")
    single = found.schema["v"].dataType.elementType.typeName() == "float"
    blocks = -(-found.count() // QUERIES)

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return _row(key[0].as_py(), None, 1, _matrix(t.column("v"), key[0].as_py()).astype(np.float64), t.column("id").to_pylist(), [], [], b"")

    block = F.pmod(F.xxhash64("id"), F.lit(max(1, blocks)))
    packed = found.withColumns({"dim": F.size("v"), "block": block}).groupBy("dim", "block").applyInArrow(pack, _COLUMNS)
    last, step = F.lit(index.agg(F.max("shard")).first()[0] or 0).cast("long"), F.lit(1000).cast("long")
    sent = packed.drop("shard").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, step)))
    sent = sent.withColumn("shard", F.explode(F.sequence("_from", F.least(F.col("_from") + step - 1, last)))).select(*_NAMES)
    both = index.select(*_NAMES).unionByName(sent).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    near = both.mapInArrow(lambda b: _near(b, k, beam, np.float32 if single else np.float64), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(batches: Iterator[pa.RecordBatch], k: int, beam: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Each query block's k nearest in the shard before it."""
    at_shard, graph, ids, firsts = None, None, [], []
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(j)[i] for j, c in enumerate(_NAMES)}
            dim = row["dim"].as_py()
            if row["kind"].as_py() == 0:
                x = np.frombuffer(row["vectors"].as_py(), kind).reshape(-1, dim).astype(np.float64)
                sizes, links = row["sizes"].as_py(), np.frombuffer(row["links"].as_py(), np.int32)
                cuts = np.cumsum([0, *(s * CAP for s in sizes)])
                graph = Graph(x, sizes, [links[a:z].reshape(-1, CAP) for a, z in zip(cuts, cuts[1:], strict=False)])
                ids, firsts, at_shard = row["ids"].values.to_numpy(), row["firsts"].values.to_numpy(), (dim, row["shard"].as_py())
                continue
            if at_shard != (dim, row["shard"].as_py()):
                continue  # no vectors of this dimension in this shard
            q, own = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim), row["ids"].as_py()
            at = graph.search(q, max(beam, k + 1))[:, : k + 1]
            total = np.zeros(at.shape)
            for j in range(dim):
                total += (graph.x[np.maximum(at, 0), j] - q[:, j, None]) ** 2
            out = []
            for a, d, me in zip(at.tolist(), np.sqrt(total).tolist(), own, strict=True):
                hits = sorted((s, v) for n, s in zip(a, d, strict=True) if n >= 0 for v in ids[firsts[n] : firsts[n + 1]].tolist() if v != me)
                out += [(me, v, s) for s, v in hits[:k]]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])
    trim()
