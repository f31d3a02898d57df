"""Exact top-k inner-product search with a KD-tree in every shard.

Rows are dealt to shards of bounded size by a hash.  In each shard one KD-tree of
median splits with tight bounding boxes is built and kept as a row.  A query walks
a tree best-first by the largest inner product a box can hold, and stops when that
can't beat its k-th best.  Queries first meet one shard each (an even deal); the
k-th score and id found there are propagated: each query is held against the boxes
of all shards' roots, and only goes on to shards whose box can beat its bound.

Queries are dealt in blocks, so a task holds one tree and one block of queries.
Scores are exact integers of any size, so ties are exact and go to the smaller id;
boxes carry their smallest id, so large groups of equal vectors are cut off as well.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm._common import durable

#: Components of a shard, components and rows of a block of queries, points of a leaf.
SHARD, BLOCK, BLOCK_ROWS, LEAF = 1 << 19, 1 << 18, 4096, 128
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_WIDE = 320  # bytes that hold a shifted score of finite doubles
_HUGE = 2.0**44


@dataclass
class Tree:
    points: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    least_id: np.ndarray


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, leaf: int | None = None) -> Tree:
    """A tree over rows of points; node i's children are child[i] and child[i] + 1, or it is a leaf at -1."""
    leaf = leaf or LEAF
    rows = ids if rows is None else rows
    order = np.lexsort((rows, ids))
    begin, end, child = [0], [len(ids)], [-1]
    i = 0
    while i < len(begin):
        a, z = begin[i], end[i]
        if z - a > leaf:
            here = points[order[a:z]]
            spread = here.max(axis=0) - here.min(axis=0)
            mid = (z - a) // 2
            if len(spread) and (axis := int(np.argmax(spread)), spread[axis])[1] > 0:
                order[a:z] = order[a:z][np.argpartition(here[:, axis], mid, kind="introselect")]
            child[i] = len(begin)
            begin += [a, a + mid]
            end += [a + mid, z]
            child += [-1, -1]
        i += 1
    points, ids, rows = points[order], ids[order], rows[order]
    boxes = [(points[a:z].min(axis=0), points[a:z].max(axis=0), ids[a:z].min()) for a, z in zip(begin, end, strict=True)]
    low, high, least = (np.array(x) for x in zip(*boxes, strict=True))
    return Tree(points, ids, rows, low, high, np.array(begin), np.array(end), np.array(child), least)


def _top(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    return heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1], x[2]))


def search(tree: Tree, query: np.ndarray, own: int, k: int, bounds: np.ndarray, limit: tuple[int, int] | None) -> list[tuple[int, int, int]]:
    """(score, id, row) of the best k rows but row own; limit is a (score, id) that k other rows reach."""
    found: list[tuple[int, int, int]] = []
    least = limit
    heap = [(-int(bounds[0]), 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if least is not None and -bound < least[0]:
            break
        if least is not None and -bound == least[0] and tree.least_id[node] > least[1]:
            continue
        if (c := int(tree.child[node])) >= 0:
            for x in (c, c + 1):
                if least is None or bounds[x] >= least[0]:
                    heapq.heappush(heap, (-int(bounds[x]), x))
            continue
        a, z = tree.begin[node], tree.end[node]
        got = tree.points[a:z] @ query
        ok = tree.rows[a:z] != own
        if least is not None:
            ok &= got >= least[0]
        at = np.flatnonzero(ok)
        if len(at) > k:
            # a leaf's best k by (score, id)
            cut = np.partition(got[at], len(at) - k)[len(at) - k]
            at = at[got[at] >= cut]
        found = _top(found + [(int(got[i]), int(tree.ids[a + i]), int(tree.rows[a + i])) for i in at], k)
        if len(found) == k:
            mine = found[-1][:2]
            if least is None or (mine[0], -mine[1]) > (least[0], -least[1]):
                least = mine
    return found


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles: as 64-bit integers if they fit well, else as Python integers."""
    if not x.size or float(np.abs(x).max()) < _HUGE:
        return np.floor(256 * x).astype(np.int64)
    flat = [256 * int(v) if abs(v) >= _HUGE else math.floor(256 * v) for v in x.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """Arrays of a type in which their inner products are exact: doubles, 64-bit or Python integers."""
    dims = arrays[0].shape[1]
    tops = [int(np.abs(a).max()) if a.size else 0 for a in arrays]
    most = math.prod(max(t, 1) for t in tops) * max(dims, 1)
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def _rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and the flat values of a list column."""
    whole = column.combine_chunks()
    begin = whole.offsets.to_numpy()
    return np.diff(begin), whole.values.to_numpy()[begin[0] : begin[-1]]


_TREE = (
    "shard int, dims int, least_id long, points array<double>, ids array<long>, rows array<long>, low array<double>, high array<double>, "
    "begins array<int>, ends array<int>, child array<int>, least array<long>"
)


def _grow(key: tuple, rows: pa.Table) -> pa.Table:
    """One tree for each vector length in the shard, as rows."""
    sizes, flat = _rows_of(rows.column("v"))
    starts = np.cumsum(sizes) - sizes
    ids, numbers, out = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), []
    for d in np.unique(sizes):
        of = np.flatnonzero(sizes == d)
        points = flat[(starts[of][:, None] + np.arange(d)).ravel()].reshape(len(of), d)
        t = build(points, ids[of], numbers[of])
        out.append((key[0].as_py(), int(d), int(t.least_id[0]), t.points.ravel(), t.ids, t.rows, t.low.ravel(), t.high.ravel(), t.begin, t.end, t.child, t.least_id))
    kinds = [pa.int32(), pa.int32(), pa.int64(), *(pa.list_(x) for x in (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
    names = [x.split()[0] for x in _TREE.split(", ")]
    return pa.table({n: pa.array([x[i] for x in out], kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))})


def _tree_of(trees: pa.Table, at: int, dims: int) -> Tree:
    flat = lambda c: trees.column(c)[at].values.to_numpy()
    whole = {c: flat(c) for c in ("ids", "rows", "begins", "ends", "child", "least")}
    points, low, high = (integers(flat(c).reshape(len(whole[n]), dims)) for c, n in (("points", "ids"), ("low", "child"), ("high", "child")))
    return Tree(points, whole["ids"], whole["rows"], low, high, whole["begins"], whole["ends"], whole["child"], whole["least"])


def _queries(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length the numbers of the queries and their integers."""
    sizes, flat = _rows_of(table.column("v"))
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        of = np.flatnonzero(sizes == d)
        yield int(d), of, integers(flat[(starts[of][:, None] + np.arange(d)).ravel()].reshape(len(of), d))


def _reach(asks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with each box."""
    zero = asks * 0
    return np.maximum(asks, zero) @ high.T + np.minimum(asks, zero) @ low.T


_FOUND = "query_row long, query_id long, vec_id long, row long, score long, wide binary"


def _searcher(k: int):
    def run(key: tuple, trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if trees.num_rows and queries.num_rows:
            q_rows, q_ids = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
            limits = list(zip(queries.column("low").to_pylist(), queries.column("low_id").to_pylist(), strict=True))
            by_dims = {d: i for i, d in enumerate(trees.column("dims").to_pylist())}
            for d, of, asks in _queries(queries):
                if d not in by_dims:
                    continue
                tree = _tree_of(trees, by_dims[d], d)
                tree.points, tree.low, tree.high, asks = _typed(tree, asks)
                bounds = _reach(asks, tree.low, tree.high)
                for n, q in enumerate(of):
                    low, low_id = limits[q]
                    for score, i, row in search(tree, asks[n], int(q_rows[q]), k, bounds[n], None if low is None else (low, low_id)):
                        out.append((int(q_rows[q]), int(q_ids[q]), i, row, *shown(score)))
        kinds = [pa.int64()] * 5 + [pa.binary()]
        names = [x.split()[0] for x in _FOUND.split(", ")]
        return pa.table({n: pa.array([x[i] for x in out], kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return run


def _typed(tree: Tree, asks: np.ndarray) -> list[np.ndarray]:
    points, own = _exact(tree.points, asks)
    low, high = (x.astype(points.dtype) for x in (tree.low, tree.high))
    return [points, low, high, own]


def shown(score: int) -> tuple[int, bytes | None]:
    """A score within 64 bits, and bytes in the order of the true scores where it doesn't lie between these bounds."""
    if LEAST < score < MOST:
        return score, None
    return max(min(score, MOST), LEAST), (score + (1 << 8 * _WIDE - 1)).to_bytes(_WIDE, "big")


def _worthwhile(key: tuple, boxes: pa.Table, queries: pa.Table) -> pa.Table:
    """(row, shard) of queries and other shards whose root box can beat the query's bound."""
    out_rows, out_shards = [], []
    if boxes.num_rows and queries.num_rows:
        rows, homes = queries.column("row").to_numpy(), queries.column("home").to_numpy()
        limits = list(zip(queries.column("low").to_pylist(), queries.column("low_id").to_pylist(), strict=True))
        dims, shards, least = (boxes.column(c).to_numpy() for c in ("dims", "shard", "least_id"))
        low, high = (boxes.column(c).to_pylist() for c in ("low", "high"))
        for d, of, asks in _queries(queries):
            here = np.flatnonzero(dims == d)
            if not len(here):
                continue
            sides = [integers(np.array([x[i][:d] for i in here], np.float64).reshape(len(here), d)) for x in (low, high)]
            both, typed = _exact(np.concatenate(sides), asks)
            reach = _reach(typed, both[: len(here)], both[len(here) :])
            for n, q in enumerate(of):
                bound, bound_id = limits[q]
                ok = shards[here] != homes[q]
                if bound is not None:
                    ok &= (reach[n] > bound) | ((reach[n] == bound) & (least[here] <= bound_id))
                out_shards += shards[here[np.flatnonzero(ok)]].tolist()
                out_rows += [int(rows[q])] * int(ok.sum())
    return pa.table({"row": pa.array(out_rows, pa.int64()), "shard": pa.array(out_shards, pa.int32())})


def usable(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): numbered rows; those with null ids, null vectors or null or non-finite components are left out."""
    x = F.transform("embedding", lambda y: y.cast("double"))
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("wide"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _parts(vectors: DataFrame) -> tuple[int, int]:
    """Rows and components in all."""
    got = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)).alias("m")).first()
    return got.n, got.n + got.m


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(256 * x) of each query row.

    embeddings has vec_id and embedding; is_query selects queries by vec_id.  A
    query's own row is no candidate, every other row of its vector's length is;
    rows that share a vec_id are rows of their own.  Fewer than k candidates give
    fewer rows; empty vectors score 0 with one another.  Scores are compared
    exactly, whatever their size; one beyond 64 bits is shown as the nearest
    64-bit number.  See usable() for rows left out.  Other columns are ignored; an
    empty table gives an empty result.
    """
    vectors = durable(usable(embeddings))
    queries = durable(vectors.where(is_query))
    shards = max(1, -(-_parts(vectors)[1] // SHARD))
    number, held = _parts(queries)
    blocks = max(1, -(-held // BLOCK), -(-number // BLOCK_ROWS))
    of = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    trees = durable(vectors.select(of(0, shards).alias("shard"), "row", "vec_id", "v").groupBy("shard").applyInArrow(_grow, _TREE))
    asked = queries.select(of(2, shards).alias("home"), of(1, blocks).alias("block"), "row", "vec_id", "v")

    def wave(these: DataFrame) -> DataFrame:
        met = these.select(F.col("shard").alias("shard"), F.col("block").alias("block")).distinct()
        dealt = trees.join(met, "shard").groupBy("shard", "block")
        return durable(dealt.cogroup(these.groupBy("shard", "block")).applyInArrow(_searcher(k), _FOUND))

    none = [F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("low_id")]
    found = wave(asked.select(F.col("home").alias("shard"), "block", "row", "vec_id", "v", *none))
    if shards > 1:
        # a bound below 64 bits isn't known exactly, so it is left out
        kth = _ranked(found, k).where((F.col("rank") == k) & (F.col("score") > LEAST)).select(
            F.col("query_row").alias("row"), F.col("score").alias("low"), F.col("vec_id").alias("low_id")
        )
        bounded = durable(asked.join(kth, "row", "left"))
        chunks = F.pmod(F.col("shard"), F.lit(-(-shards // BLOCK_ROWS)))
        boxes = trees.select("shard", "dims", "least_id", F.slice("low", F.lit(1), F.col("dims")).alias("low"), F.slice("high", F.lit(1), F.col("dims")).alias("high"), chunks.alias("chunk"))
        every_block = boxes.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        every_chunk = bounded.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-shards // BLOCK_ROWS) - 1))).alias("chunk"))
        pairs = every_block.groupBy("block", "chunk").cogroup(every_chunk.groupBy("block", "chunk")).applyInArrow(_worthwhile, "row long, shard int")
        found = found.unionByName(wave(durable(pairs).join(bounded.drop("home"), "row")))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
