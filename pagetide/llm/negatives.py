"""Hard negatives by coordinate pruning over length buckets.

Rows are dealt by length into spans, longest first, and a span into buckets of similar length; a bucket holds, for each coordinate, its
rows in the order of that coordinate of their directions. A row whose score with an anchor reaches a threshold lies
within an angle of the anchor's direction, and therefore within a range of each coordinate. The ranges of the anchor's
largest (focus) coordinates are looked up in the sorted lists; rows in all of them are candidates, and only their scores are
worked out, in whole numbers. Thresholds rise as better rows are found; a bucket too short for a threshold is skipped.

Anchors (a stated share of all rows) meet the rows in blocks: chunks of anchors with spans of rows. Nothing is held
whole by one task or by the driver, and each block gives a bounded number of rows for each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # a negative's score in hundredths of the positive's
SPAN_ROWS, BUCKET_ROWS = 8192, 2048
CHUNK_ANCHORS, TOGETHER = 8192, 64  # anchors of a block, and those that are worked on at once
FOCUS = 4  # focus coordinates
EXACT = 1 << 53


def usable(vectors: DataFrame, relabel: Column) -> DataFrame:
    """vec_id, label, v (whole numbers, floor(256 * x)) of the rows that take part; one row for each vec_id."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    whole = F.expr("vec_id is not null and label is not null and embedding is not null") & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(whole, F.lit(False))).select("vec_id", relabel.cast("long").alias("label"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Bucket:
    """Rows of similar length with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v.astype(np.float64)
        lengths = np.sqrt((self.v**2).sum(1))
        self.longest, self.shortest = float(lengths.max()), float(lengths.min())
        self.lengths = np.where(lengths > 0, lengths, 1.0)
        unit = self.v / self.lengths[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")  # of each coordinate
        self.lists = np.take_along_axis(unit, self.order, 0)

    def ranges(self, coordinate: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where values of low to high lie in the sorted lists of coordinates: bisection of all at once."""
        ends = []
        for want, strict in ((low, False), (high, True)):
            a, b = np.zeros(len(want), np.int64), np.full(len(want), len(self.ids))
            while (a < b).any():
                mid = (a + b) // 2
                value = self.lists[np.minimum(mid, len(self.ids) - 1), coordinate]
                on = (a < b) & ((value <= want) if strict else (value < want))
                a, b = np.where(on, mid + 1, a), np.where(on | (a >= b), b, mid)
            ends.append(a)
        return ends[0], ends[1]

    def candidates(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) pairs that hold all rows whose scores with anchors q reach `least`."""
        norms = np.sqrt((q**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(least > 0, least / (norms * self.longest), least / (norms * self.shortest))
        cosine = np.nan_to_num(cosine - 1e-9, nan=-1.0, posinf=2.0, neginf=-1.0)
        live = np.flatnonzero(cosine <= 1)
        if not len(live):
            return live, live
        reach = np.arccos(np.clip(cosine[live], -1, 1))
        focus = np.argsort(-np.abs(q[live]), axis=1, kind="stable")[:, :FOCUS]
        at = np.arccos(np.clip(np.take_along_axis(q[live], focus, 1) / np.where(norms[live] > 0, norms[live], 1.0)[:, None], -1, 1))
        low = np.cos(np.minimum(np.pi, at + reach[:, None])) - 1e-9
        high = np.cos(np.maximum(0, at - reach[:, None])) + 1e-9
        if self.shortest == 0:  # no direction, any range must take it
            low, high = np.minimum(low, 0), np.maximum(high, 0)
        a, b = self.ranges(focus.ravel(), low.ravel(), high.ravel())
        a, b = a.reshape(focus.shape), b.reshape(focus.shape)
        best = np.argmin(b - a, axis=1)
        pick = np.arange(len(live)), best
        sizes = (b - a)[pick]
        who = np.repeat(np.arange(len(live)), sizes)
        place = np.repeat(a[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        row = self.order[place, np.repeat(focus[pick], sizes)]
        ok = np.ones(len(row), bool)
        for k in range(focus.shape[1]):
            value = self.v[row, focus[who, k]] / self.lengths[row]
            ok &= (value >= low[who, k]) & (value <= high[who, k])
        return live[who[ok]], row[ok]


def best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each anchor: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, who))
    first = np.append(True, who[order][1:] != who[order][:-1]) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < k]


def search(buckets: list[Bucket], q: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, band, row id, score) of the k best rows of each anchor and band, from low to high, of its own label
    (without its own row) or of others. low and high: a row for each anchor, a column for each band."""
    bands = low.shape[1]
    held = [np.zeros(0, np.int64) for _ in range(3)]  # anchor * bands + band, row id, score
    floor = low.astype(np.float64)  # rises to the k-th best so far
    for b in buckets:
        who, row = b.candidates(q, floor.min(1))
        other = (b.labels[row] == labels[who]) == same
        other &= b.ids[row] != ids[who]
        who, row = who[other], row[other]
        score = np.concatenate([np.einsum("ij,ij->i", q[who[x]], b.v[row[x]]) for x in np.array_split(np.arange(len(who)), len(who) // 100_000 + 1)]).astype(np.int64)
        slot, found, got = [held[0]], [held[1]], [held[2]]
        for j in range(bands):
            ok = np.flatnonzero((score >= floor[who, j]) & (score >= low[who, j]) & (score <= high[who, j]))
            slot.append(who[ok] * bands + j), found.append(b.ids[row[ok]]), got.append(score[ok])
        held = [np.concatenate(x) for x in (slot, found, got)]
        top = best(held[0], held[2], held[1], k)
        held = [x[top] for x in held]
        full = np.bincount(held[0], minlength=floor.size) >= k
        last = np.full(floor.size, np.inf)
        np.minimum.at(last, held[0], held[2])
        floor = np.where(full, last, floor.ravel()).reshape(floor.shape)
    return held[0] // bands, held[0] % bands, held[1], held[2]


def search_wide(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, q: np.ndarray, q_labels: np.ndarray, q_ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[tuple[int, int, int, int]]:
    """The same for numbers too large for 53 bits: all rows, in whole numbers of any size."""
    out = []
    rows = v.astype(object)
    for a in range(len(q)):
        score = rows @ q[a].astype(object)
        own = np.flatnonzero(((labels == q_labels[a]) == same) & (ids != q_ids[a]))
        for j in range(low.shape[1]):
            ok = sorted((-score[r], int(ids[r])) for r in own if low[a, j] <= score[r] <= high[a, j])
            out += [(a, j, i, -s) for s, i in ok[:k]]
    return out


def band_of(scores: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers s with least * p <= 100 * s <= most * p."""
    return -((-least * scores) // 100), (most * scores) // 100


def matched(anchors: DataFrame, spans: DataFrame, dim: int, k: int, bands: bool, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, band, vec_id, score: the k best of each block. Without bands the rows of the anchor's own label are
    searched, with them those of other labels, between shares of the anchor's positive scores."""
    spark, n_spans = anchors.sparkSession, (spans.agg(F.max("span")).first()[0] or 0) + 1
    chunks = -(-anchors.count() // CHUNK_ANCHORS)
    left = anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, chunks)))).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(n_spans - 1))))
    right = spans.withColumn("chunk", F.explode(F.expr(f"sequence(0L, {max(0, chunks - 1)}L)")))

    def block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, labels, v = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), matrix(right.column("v"), dim)
            a_ids, a_labels, a = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), matrix(left.column("v"), dim)
            order = np.lexsort((ids, -(v.astype(float) ** 2).sum(1)))
            ids, labels, v = ids[order], labels[order], v[order]
            any_score = dim * int(max(abs(int(x)) for m in (a, v) for x in (m.min(), m.max()))) ** 2
            wide = any_score >= EXACT
            if bands:
                scores = left.column("scores").to_pylist()
                width = max(map(len, scores))
                pairs = [[band_of(s, least, most) for s in own] + [(1, 0)] * (width - len(own)) for own in scores]
                low, high = (np.array([[p[x] for p in own] for own in pairs], object) for x in (0, 1))
            else:
                low, high = np.full((len(a), 1), -any_score, object), np.full((len(a), 1), any_score, object)
            buckets = [] if wide else [Bucket(ids[x : x + BUCKET_ROWS], labels[x : x + BUCKET_ROWS], v[x : x + BUCKET_ROWS]) for x in range(0, len(ids), BUCKET_ROWS)]
            for x in range(0, len(a), TOGETHER):
                y = slice(x, x + TOGETHER)
                if wide:
                    rows = search_wide(ids, labels, v, a[y], a_labels[y], a_ids[y], low[y], high[y], k, not bands)
                    got = [[r[c] for r in rows] for c in range(4)]
                    got[3] = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in got[3]]
                else:
                    got = [g.tolist() for g in search(buckets, a[y].astype(np.float64), a_labels[y], a_ids[y], low[y].astype(np.int64), high[y].astype(np.int64), k, not bands)]
                cols[0] += a_ids[y][got[0]].tolist() if len(got[0]) else []
                for c in (1, 2, 3):
                    cols[c] += got[c]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "band", "vec_id", "score"), cols, strict=True)})

    return left.groupBy("span", "chunk").cogroup(right.groupBy("span", "chunk")).applyInArrow(block, "anchor_id long, band long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchor: Column, relabel: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors(vec_id, label, embedding, ...): rows with a null in one of them, or a null or non-finite component, take no
    part; of rows that repeat a vec_id the first by label and vector does. Components of a shorter vector that are not
    there are 0. 256 * x beyond 64 bits, and a score beyond them, are taken as the largest number of 64 bits. An anchor with
    no other row of its label, and a positive without negatives, have no rows. Empty tables give none.
    """
    rows = stored(usable(vectors, relabel))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    spans = rows.withColumn("_l", -length).repartitionByRange(max(1, -(-n // SPAN_ROWS)), "_l", F.xxhash64("vec_id")).drop("_l").withColumn("span", F.spark_partition_id())
    spans = stored(spans)
    asked = rows.filter(anchor)
    dim = max(1, dim)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = matched(asked, spans, dim, positives, False).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    lists = stored(lists.select(F.col("anchor_id").alias("vec_id"), F.col("p.vec_id").alias("positives"), F.col("p.score").alias("scores")))
    against = stored(asked.join(lists.filter("exists(scores, s -> s >= 0)"), "vec_id"))
    within = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    picked = matched(against.select("vec_id", "label", "v", "scores"), spans, dim, negatives, True, least, most).withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= negatives)
    named = picked.join(lists.withColumnRenamed("vec_id", "anchor_id"), "anchor_id")
    at = F.col("band").cast("int")
    return named.select("anchor_id", F.get("positives", at).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.get("scores", at).alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of the whole embeddings table, with the labels of every seventh row off by one."""
    moved = F.expr("case when pmod(vec_id, 7) = 0 then (label + 1) % 10 else label end")
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.expr("pmod(vec_id, 100) = 0"), moved)


OP13_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""
