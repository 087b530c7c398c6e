"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Vectors are dealt to shards by a hash of their components, so equal vectors meet and become one node with their smallest ids;
no more than k + 1 of a node's ids can stand in a result of k, the rest is dropped without loss. A shard's graph grows in
batches: a greedy search proposes each new node's neighbours, pruning keeps a neighbour unless one kept before is nearer to
it by the factor ``ALPHA``, and edges back are added and pruned in the same way. A query searches every shard's graph with a
beam; distances of what it found are computed in double precision on the original components.

Every valid row is indexed. Defined results: null, zero and non-finite vectors and null ids take no part; vectors of other
lengths are never compared; rows with the query's own id are not its candidates; of rows with one id the least vector is the
query; repeated rows count once (same id); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts, unpack, written

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, WIDTH = 32, 64, 192, 1.2, 4
SHARD_ROWS = 8192
QUERY_BLOCK = 16384


def _distances(x, norms, rows, targets):
    """Squared distances of vectors ``targets`` (q, d) to nodes ``rows`` (q, c)."""
    return norms[rows] - 2 * np.einsum("qcd,qd->qc", x[rows], targets, optimize=False)


def beam_search(x, norms, graph, start, targets, beam, width=WIDTH):
    """The ``beam`` nearest nodes found for each target, nearest first; -1 where there are fewer."""
    q, n = len(targets), len(x)
    found = np.full((q, beam), -1, np.int32)
    near = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    found[:, 0], done[:, 0], seen[:, start] = start, False, True
    near[:, 0] = _distances(x, norms, np.full((q, 1), start), targets)[:, 0]
    active = np.arange(q)
    while len(active):
        # the nearest nodes that weren't expanded yet
        masked = np.where(done[active], np.inf, near[active])
        pick = np.argpartition(masked, width - 1, axis=1)[:, :width] if beam > width else np.argsort(masked, axis=1)
        open_ = np.take_along_axis(masked, pick, 1) < np.inf
        some = open_.any(1)
        active, pick, open_ = active[some], pick[some], open_[some]
        if not len(active):
            break
        nodes = np.where(open_, np.take_along_axis(found[active], pick, 1), -1)
        flags = done[active]
        np.put_along_axis(flags, pick, True, 1)
        done[active] = flags
        next_ = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(active), -1)
        next_ = np.sort(next_, axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
        rows = np.arange(len(active))[:, None]
        fresh = (next_ >= 0) & ~seen[active[:, None], next_]
        next_ = np.where(fresh, next_, -1)
        r, c = np.nonzero(fresh)
        seen[active[r], next_[r, c]] = True
        distance = np.where(fresh, _distances(x, norms, np.maximum(next_, 0), targets[active]), np.inf).astype(np.float32)
        all_near = np.concatenate([near[active], distance], 1)
        best = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        near[active] = all_near[rows, best]
        found[active] = np.concatenate([found[active], next_], 1)[rows, best]
        done[active] = np.concatenate([flags, ~fresh], 1)[rows, best]
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1)


def robust_prune(x, points, candidates, degree=DEGREE, alpha=ALPHA):
    """Neighbours kept for each point of ``candidates`` (-1: none): nearest first, unless a kept one is nearer by ``alpha``."""
    c = np.where(candidates == points[:, None], -1, candidates)
    v = x[np.maximum(c, 0)]
    own = ((v - x[points][:, None]) ** 2).sum(2)
    own[c < 0] = np.inf
    squares = (v**2).sum(2)
    between = squares[:, :, None] + squares[:, None] - 2 * (v @ v.transpose(0, 2, 1))
    kept = np.full((len(points), degree), -1, np.int32)
    rows, alive = np.arange(len(points)), own.copy()
    for k in range(degree):
        best = alive.argmin(1)
        good = alive[rows, best] < np.inf
        if not good.any():
            break
        kept[good, k] = c[rows[good], best[good]]
        alive[alpha * alpha * between[rows, best] <= own] = np.inf
        alive[rows, best] = np.inf
    return kept


def build(x: np.ndarray, degree=DEGREE, beam=BUILD_BEAM, alpha=ALPHA, batch=512) -> tuple[np.ndarray, int]:
    """Graph (n, degree; -1: none) and start node of vectors ``x``."""
    n = len(x)
    norms = (x**2).sum(1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        close = beam_search(x, norms, graph, start, x[new], beam)
        graph[new] = robust_prune(x, new, close, degree, alpha)
        source, target = np.repeat(new, degree), graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (graph[nodes] >= 0).sum(1)
        for few in (True, False):
            pick = np.flatnonzero((held + count <= degree) == few)
            for a in range(0, len(pick), 256):
                some = pick[a : a + 256]
                wide = np.full((len(some), int(count[some].max())), -1, np.int32)
                for i, j in enumerate(some):
                    wide[i, : count[j]] = source[first[j] : first[j] + count[j]]
                joined = np.concatenate([graph[nodes[some]], wide], 1)
                if few:
                    graph[nodes[some]] = -np.sort(-joined, axis=1)[:, :degree]
                else:
                    graph[nodes[some]] = robust_prune(x, nodes[some], joined, degree, alpha)
        at += len(new)
        size = min(batch, at)
    return graph, start


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))


def _matrix(column, dim):
    return unpack(column.combine_chunks().flatten().to_numpy().tobytes() if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().tobytes(), np.float64).reshape(-1, dim)


def index(rows: DataFrame, k: int, shards: int) -> DataFrame:
    """One row per shard: dim, shard, n, vectors, ids (k + 1 each, ascending, then -1 as missing marks by ``counts``), graph, start."""
    keep = k + 1

    def deal(stream):
        for batch in stream:
            nodes: dict[bytes, list[int]] = {}
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
                blob = (np.asarray(v.values.to_numpy()) + 0.0).tobytes()
                ids = nodes.setdefault(blob, [])
                ids.append(vec_id)
                if len(ids) > 4 * keep:
                    ids[:] = heapq.nsmallest(keep, set(ids))
            where = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little") % shards for b in nodes]
            yield pa.record_batch({
                "dim": pa.array([len(b) // 8 for b in nodes], pa.int32()), "shard": pa.array(where, pa.int32()), "vector": pa.array(list(nodes), pa.binary()),
                "ids": pa.array([heapq.nsmallest(keep, set(x)) for x in nodes.values()], pa.list_(pa.int64())),
            })

    def make(key, table):
        nodes: dict[bytes, set] = {}
        for blob, ids in zip(table.column("vector").to_pylist(), table.column("ids").to_pylist(), strict=True):
            nodes.setdefault(blob, set()).update(ids)
        blobs = sorted(nodes)
        x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
        graph, start = build(x.astype(np.float32))
        ids = [heapq.nsmallest(keep, nodes[b]) for b in blobs]
        flat = np.full((len(ids), keep), np.iinfo(np.int64).max)
        for i, own in enumerate(ids):
            flat[i, : len(own)] = own
        return pa.table({
            "dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "n": pa.array([len(blobs)], pa.int64()), "vectors": pa.array([x.tobytes()], pa.binary()),
            "ids": pa.array([flat.tobytes()], pa.binary()), "graph": pa.array([graph.tobytes()], pa.binary()), "start": pa.array([start], pa.int64()),
        })

    dealt = rows.mapInArrow(deal, "dim int, shard int, vector binary, ids array<long>")
    return dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, n long, vectors binary, ids binary, graph binary, start long")


def search_shard(x, ids, graph, start, query_ids, queries, k, beam=SEARCH_BEAM, batch=256):
    """(query, id, distance) rows: the k nearest found of one shard for each query."""
    single = x.astype(np.float32)
    norms, none = (single**2).sum(1), np.iinfo(np.int64).max
    out = []
    for a in range(0, len(queries), batch):
        q, own = queries[a : a + batch], query_ids[a : a + batch]
        found = beam_search(single, norms, graph, start, q.astype(np.float32), min(max(beam, k + 1), len(x)) if len(x) > 1 else 1)
        distance = np.sqrt(((x[np.maximum(found, 0)] - q[:, None]) ** 2).sum(2))
        distance[found < 0] = np.inf
        all_ids = np.where(found[:, :, None] >= 0, ids[np.maximum(found, 0)], none).reshape(len(q), -1)
        far = np.repeat(distance, ids.shape[1], axis=1)
        far[(all_ids == none) | (all_ids == own[:, None])] = np.inf
        order = np.lexsort((all_ids, far))[:, :k]
        rows = np.arange(len(q))[:, None]
        good = far[rows, order] < np.inf
        out.append((np.broadcast_to(own[:, None], good.shape)[good], all_ids[rows, order][good], far[rows, order][good]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k nearest found among ``vectors``."""
    rows = written(valid(vectors), "ann-rows")
    shards = parts(rows.count(), shard_rows)
    graphs = written(index(rows, k, shards), "ann-index")
    asked = valid(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = parts(queries.count(), QUERY_BLOCK)

    def gather(key, table):
        v = table.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"dim": table.column("dim")[:1], "asked_ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "asked": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())})

    packed = asked.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks))}).groupBy("dim", "block").applyInArrow(gather, "dim int, asked_ids binary, asked binary")
    dealt = written(packed, "ann-queries").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # a block of queries goes to every shard

    def search(stream):
        for batch in stream:
            for r in batch.to_pylist():
                x = unpack(r["vectors"], np.float64).reshape(r["n"], -1)
                ids, graph = unpack(r["ids"], np.int64).reshape(r["n"], -1), unpack(r["graph"], np.int32).reshape(r["n"], -1)
                q, i, s = search_shard(x, ids, graph, r["start"], unpack(r["asked_ids"], np.int64), unpack(r["asked"], np.float64).reshape(-1, x.shape[1]), k, beam)
                yield pa.record_batch({"query_id": pa.array(q), "vec_id": pa.array(i), "score": pa.array(s)})

    found = graphs.join(dealt, ["dim", "shard"]).repartition(shards * blocks, "dim", "shard").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: rows whose id is divisible by 100 against all ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
