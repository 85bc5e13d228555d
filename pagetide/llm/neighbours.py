"""Approximate nearest neighbours by a forest of random-projection trees.

A bounded sample fits the trees: a node splits at the median of its sample's projections on the direction
between two of its random members. Every row is indexed: it goes to its leaf in each tree. A query walks all trees at once with one
priority queue, nearest margins first, until the leaves it has opened hold enough rows; their rows are then
ranked by exact distances. Rows are dealt by hash in parts and queries in blocks, so what meets in one group is bounded on
either side: a row goes once to each block and a query, with the leaves that it has opened as bits, once to each part,
however many leaves these are. In a group queries take turns in chunks: the leaves say which rows a query may see, dot
products with a bound on their error which of these may be among its nearest, and exact distances rank those.

Sizes: the forest has at most 2 ** MAX_DEPTH leaves a tree whatever the number of rows, so it may be sent to all tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ODD, mix, stored

TREES, MIN_DEPTH, MAX_DEPTH, LEAF_ROWS = 8, 6, 10, 1000
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000  # the sample has at most so many rows, and numbers in them
#: Rows in the leaves that a query opens (a row counts in each tree), as a share of all rows. Vectors without clusters, as
#: those of the test tables, need this much for a recall of 0.94; clustered ones far less.
SHARE = 1.0
PART_ROWS, BLOCK_QUERIES, GROUP_NUMBERS = 20_000, 20_000, 2_000_000  # rows, and queries, that meet in one group (about; both are dealt by hash), and numbers in either
LEAST_PARTS = 32  # so that small tables keep all cores busy
CHUNK = 64  # queries that are worked on at once, each a bit of a number


class Tree:
    """A complete binary tree of planes; leaf numbers count from 0."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        self.planes = np.zeros((2**depth - 1, sample.shape[1]))
        self.cuts = np.zeros(2**depth - 1)
        rows = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            own = rows.pop(node)
            v = rng.normal(size=sample.shape[1])
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                if (sample[a] != sample[b]).any():
                    v = sample[a] - sample[b]
            v = v / np.linalg.norm(v)
            at = sample[own] @ v
            cut = np.median(at) if len(own) else 0.0
            self.planes[node], self.cuts[node] = v, cut
            rows[2 * node + 1], rows[2 * node + 2] = own[at <= cut], own[at > cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.planes[node]) > self.cuts[node])
        return node - (2**self.depth - 1)


def opened_leaves(query: np.ndarray, forest: list[Tree], sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order in which one queue over all trees opens them, until they hold `wanted` rows."""
    inner = 2 ** forest[0].depth - 1
    margins = [t.planes @ query - t.cuts for t in forest]
    queue = [(-1.0, k, 0) for k in range(len(forest))]
    out, rows = [], 0
    while queue and rows < wanted:
        far, k, node = heapq.heappop(queue)
        while node < inner:
            m = margins[k][node]
            heapq.heappush(queue, (max(far, abs(m)), k, 2 * node + (1 if m > 0 else 2)))
            node = 2 * node + (2 if m > 0 else 1)
        leaf = node - inner
        if sizes[k, leaf]:
            out.append((k, leaf))
            rows += sizes[k, leaf]
    return out


def seen(opened: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, with its leaf in each tree, the queries that have opened one of these, as bits. opened: queries, trees, leaves."""
    bits = np.zeros((*opened.shape[1:], CHUNK), np.uint8)
    bits[:, :, : len(opened)] = opened.transpose(1, 2, 0)
    by_leaf = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    out = np.zeros(len(at), np.uint64)
    for t, leaves in enumerate(by_leaf):
        out |= leaves[at[:, t]]
    return out


def contenders(q: np.ndarray, x: np.ndarray, xx: np.ndarray, may: np.ndarray, k: int) -> np.ndarray:
    """Of the rows that each query may see, those that can be among its k nearest; all of them where numbers overflow.
    xx: the rows' squared lengths. Squared distances by dot products are off by less than the slack."""
    if x.shape[0] <= k:
        return may
    with np.errstate(over="ignore", invalid="ignore"):
        qq = (q * q).sum(1)
        slack = (8 * x.shape[1] + 32) * np.finfo(float).eps * (xx.max() + qq) + x.shape[1] * 1e-300
        near = q @ x.T
        near *= -2
        near += xx
        near += qq[:, None]
        near[~may] = np.inf
        most = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack
        return may & ((near <= most[:, None]) | ~np.isfinite(4 * (xx.max() + qq))[:, None])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows that take part. Of several sizes of vectors, the most frequent one does (the smallest on ties)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0.0))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    return rows.filter(F.size("v") == (size[0]["s"] if size else 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found rows of vectors(vec_id, embedding, ...).

    score: Euclidean distance in double precision; ties go to the smaller vec_id. queries: of the same columns; by
    default the rows whose vec_id is divisible by 100. A query's own vec_id is no candidate. Null ids, and vectors that are
    null, zero or hold null or non-finite numbers take no part. Rows that repeat an id are one candidate, at its
    nearest; a query id that repeats is one query, with the first of its vectors in order. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = stored((rows.filter("pmod(vec_id, 100) = 0") if queries is None else usable(queries)).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")))
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = rows.limit(1).collect()
    if not first:
        return empty
    dim = len(first[0]["v"])
    part_rows, block_queries = (max(1, min(size, GROUP_NUMBERS // dim)) for size in (PART_ROWS, BLOCK_QUERIES))
    parts, blocks = max(LEAST_PARTS, -(-n // part_rows)), max(1, -(-asked.count() // block_queries))
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    kind = np.float32 if single else np.float64  # as stored and sent; either holds the vectors' own numbers
    most = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("v").toLocalIterator()])
    depth = int(np.clip(np.ceil(np.log2(max(1, n / LEAF_ROWS))), MIN_DEPTH, MAX_DEPTH))
    rng = np.random.default_rng(42)
    forest = [Tree(sample, depth, rng) for _ in range(trees)]

    def vectors_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors_of(b.column(1))
            at = np.stack([t.leaves(x) for t in forest], 1).astype(np.int16)
            ids = b.column(0).to_numpy()
            dealt = mix(ids.astype(np.uint64) * ODD + np.arange(len(ids), dtype=np.uint64)) % np.uint64(parts)  # rows of one id spread as well
            yield pa.record_batch([b.column(0), pa.array(dealt.astype(np.int32)), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in at], pa.binary())], ["vec_id", "part", "v", "leaves"])

    placed = stored(rows.mapInArrow(index, "vec_id long, part int, v binary, leaves binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((trees, 2**depth), np.int64)
        for b in batches:
            at = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int16).reshape(-1, trees)
            for t in range(trees):
                got[t] += np.bincount(at[:, t], minlength=2**depth)
        t, leaf = np.nonzero(got)
        yield pa.record_batch([pa.array(t, pa.int32()), pa.array(leaf, pa.int32()), pa.array(got[t, leaf], pa.int64())], ["tree", "leaf", "n"])

    sizes = np.zeros((trees, 2**depth), np.int64)
    for r in placed.select("leaves").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["tree"], r["leaf"]] = r["n"]
    wanted = max(share * n, trees * (k + 2))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, opened = (mix(b.column(0).to_numpy().astype(np.uint64)) % np.uint64(blocks)).astype(np.int32), []
            qs = vectors_of(b.column(1))
            for q in qs:
                mask = np.zeros((trees, 2**depth), np.uint8)
                for t, leaf in opened_leaves(q, forest, sizes, wanted):
                    mask[t, leaf] = 1
                opened.append(np.packbits(mask, axis=1).tobytes())
            yield pa.record_batch([pa.array(block), b.column(0), pa.array([q.tobytes() for q in qs], pa.binary()), pa.array(opened, pa.binary())], ["block", "query_id", "q", "opened"])

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    visits = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id").mapInArrow(search, "block int, query_id long, q binary, opened binary").withColumn("part", every(parts))
    members = placed.withColumn("block", every(blocks))

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            x = np.frombuffer(b"".join(right.column("v").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            at = np.frombuffer(b"".join(right.column("leaves").to_pylist()), np.int16).reshape(-1, trees)
            with np.errstate(over="ignore"):
                xx = (x * x).sum(1)
            most = k * int(np.unique(ids, return_counts=True)[1].max())  # rows among which k have different ids
            left = left.sort_by("opened")  # those that open the same leaves together
            for a in range(0, left.num_rows, CHUNK):
                chunk = left.slice(a, CHUNK)
                qids = chunk.column("query_id").to_numpy()
                qs = np.frombuffer(b"".join(chunk.column("q").to_pylist()), np.float64).reshape(-1, dim)
                opened = np.unpackbits(np.frombuffer(b"".join(chunk.column("opened").to_pylist()), np.uint8).reshape(len(qids), trees, -1), axis=2)
                by_row = seen(opened, at)
                rows = np.flatnonzero(by_row)
                may = np.unpackbits(by_row[rows].view(np.uint8).reshape(-1, CHUNK // 8), axis=1, bitorder="little")[:, : len(qids)].T.astype(bool)
                may &= ids[rows] != qids[:, None]
                near = contenders(qs, x[rows], xx[rows], may, most) if len(rows) else may
                for qid, q, own in zip(qids.tolist(), qs, near, strict=True):
                    own = rows[own]
                    d = np.sqrt(((x[own] - q) ** 2).sum(1))
                    best = np.lexsort((ids[own], d))
                    _, once = np.unique(ids[own][best], return_index=True)
                    best = best[np.sort(once)][:k]
                    out[0].extend([qid] * len(best))
                    out[1].extend(ids[own][best].tolist())
                    out[2].extend(d[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = visits.groupBy("part", "block").cogroup(members.groupBy("part", "block")).applyInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth row of the whole embeddings table."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
