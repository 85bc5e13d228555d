"""MinHash near-duplicates by fast similarity sketches, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Fast similarity sketching
fills the t coordinates of its sketch in rounds: in round i every element hashes to one bin with a value
i + fraction, and a bin keeps its smallest value; after t rounds, round t + j drops every element into bin j,
so that every coordinate fills for certain. Equal coordinates estimate the Jaccard similarity with
concentration bounds, as coordinates come from one nearly without-replacement sample.

Bands of r coordinates bring together documents, and links are confirmed on full sets. All pairs of a bucket
are never emitted: documents with one set are one node; a bucket first links its members to its leader; only members
of different components meet further, first through one representative of each, then all that could still join
two components: a set that shares too little with other components can link with none; the others meet block by
block, and only links that join components are emitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, Scratch, WordHashes, documents, lower_words_of, mix, release

WORDS, COORDS, BAND_ROWS = 5, 128, 4
#: Of the last round: shingles of a group's sets (8 bytes each), rows that meet at once, columns of a product.
BLOCK, TILE, COLUMNS = 2_000_000, 1000, 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
FRACTION = np.uint64(54)  # bits of the fraction; the round stands above it


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text is one shingle; no words, no shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = len(h)
    if n < k:
        acc = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in h:
                acc = acc * ODD + x
        return mix(np.array([acc], np.uint64))
    acc = h[: n - k + 1].copy()
    for j in range(1, k):
        acc *= ODD
        acc += h[j : n - k + 1 + j]
    return np.unique(mix(acc))


def sketch(elements: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: t values, comparable coordinate by coordinate."""
    n, shift = len(elements), np.uint64(64 - int(t).bit_length() + 1)
    low = np.uint64((1 << int(FRACTION)) - 1)
    out, i = np.full(t, FULL), 0
    at_once = max(1, min(t, int(1.5 * t * np.log(t) / n)))
    while i < t:
        rounds = np.arange(i, min(t, i + at_once), dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * ODD)
        np.minimum.at(out, (h >> shift).ravel(), ((rounds[:, None] << FRACTION) | (h & low)).ravel())
        i += len(rounds)
        if not (out == FULL).any():
            return out
    for j in np.flatnonzero(out == FULL):  # round t + j
        h = mix(elements + np.full(1, t + j + 1, np.uint64) * ODD)
        out[j] = (np.uint64(t + int(j)) << FRACTION) | (h & low).min()
    return out


def band_keys(values: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates."""
    grid = values.reshape(-1, rows)
    acc = np.arange(1, len(grid) + 1, dtype=np.uint64) * ODD
    for j in range(rows):
        acc = mix(acc + grid[:, j]) * ODD
    return mix(acc)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    hashes = WordHashes()
    for b in batches:
        texts, size, key, bands = b.column(1), [], [], []
        for text in texts:
            s = shingle_set(lower_words_of(text.as_py()), hashes)
            size.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(band_keys(sketch(s)).view(np.int64) if len(s) else None)
        yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        sets = [shingle_set(lower_words_of(x.as_py()), hashes).tobytes() for x in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([np.frombuffer(x.as_py(), np.int64) for x in b.column(2)], pa.list_(pa.int64()))], ["node", "part", "shingle"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every end of an edge (a, b); component: the smallest node reachable.

    Every node's label falls to its neighbours' smallest, then to that label's own label, until nothing changes. Each
    round's labels are a table of their own: plans, and what the optimizer derives from them, stay as small as one round.
    """
    both = scratch.put("edges", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.put("labels", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = scratch.put("labels", step.join(jump, "component", "left").select("node", "old", F.coalesce("further", "component").alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            scratch.drop("edges")
            return labels


def merged(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """parts(node, part) after links (a, b) between nodes: only parts that they join are gone through."""
    of = [parts.select(F.col("node").alias(x), F.col("part").alias(f"p{x}")) for x in "ab"]
    across = links.join(of[0], "a").join(of[1], "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    joined = components(across, scratch).withColumnRenamed("node", "part")
    return scratch.put("parts", parts.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("part")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    ab = a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return ab.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long").distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one part."""
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("bucket")
    return placed.join(mixed, "bucket")


def _able(placed: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of buckets that may still have a link to another part, with their count of shingles that other parts share.

    A link needs 7 * |a and b| >= 3 * (|a| + |b|), and what sets of two parts share is among the shingles that stand
    in more than one part. So a copy whose edits, with those of its own part, are too many can link with nothing.
    """
    nodes = placed.select("node", "part").distinct()
    each = sets.join(nodes, "node").select("node", "part", "shingles").mapInArrow(_numbers, "node long, part long, shingle array<long>").select("node", "part", F.explode("shingle").alias("shingle"))
    wide = scratch.put("wide", each.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("shingle"))
    shared = scratch.put("shared", each.join(wide, "shingle").groupBy("node").agg(F.count("*").alias("shared")))
    rows = scratch.put("able", placed.join(shared, "node"))
    least = rows.groupBy("bucket").agg(F.min("n").alias("least"))
    rows = rows.join(least, "bucket").filter("28 * shared >= 3 * (4 * n + greatest(4 * least, 3 * n))").drop("least")
    able = scratch.put("mixed", _mixed(rows))
    scratch.drop("wide", "shared", "able")
    return able


class Forest:
    """Parts that links join, within one task."""

    def __init__(self, parts: np.ndarray):
        _, self.of = np.unique(parts, return_inverse=True)
        self.label = np.arange(self.of.max() + 1 if len(parts) else 0)

    def apart(self, row: int, others: np.ndarray) -> list[int]:
        """Of rows that link with `row`, one for each part that is not yet joined to its; joins them."""
        out = []
        roots = self.label[self.of[others]]
        own = self.label[self.of[row]]
        found, first = np.unique(roots, return_index=True)
        for root, k in zip(found, first, strict=True):
            if root != own:
                out.append(int(others[k]))
                self.label[self.label == root] = own
        return out


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of blocks of columns."""
    at = np.repeat(np.arange(len(left)), [len(x) for x in left])
    to = np.repeat(np.arange(len(right)), [len(x) for x in right])
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def columns(sets: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        col = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        ok = vocabulary[col] == flat
        order = np.argsort(col[ok], kind="stable")
        return rows[ok][order], col[ok][order]

    if not len(vocabulary):
        return out
    (at, a), (to, b) = columns(left, at), columns(right, to)
    for low in range(0, len(vocabulary), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for m, rows, cols in ((x, at, a), (y, to, b)):
            lo, hi = np.searchsorted(cols, (low, low + COLUMNS))
            m[rows[lo:hi], cols[lo:hi] - low] = 1
        out += x @ y.T
    return out


def _cross(key, table):
    """Of one block of a cluster against another: links that join parts, as few as join them all."""
    _, i, j = (k.as_py() for k in key)
    cluster, node, part, blk = (table.column(c).to_numpy() for c in ("cluster", "node", "part", "blk"))
    order = np.lexsort((part, blk, cluster))
    cuts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0, True])
    shingles, links = table.column("shingles"), []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[low:high]
        if (part[own] == part[own[0]]).all():
            continue
        forest = Forest(part[own])
        sets = [np.frombuffer(shingles[int(k)].as_py(), np.uint64) for k in own]
        n = np.array([len(x) for x in sets])
        left, right = (np.flatnonzero(blk[own] == b) for b in (i, j))
        for p in range(0, len(left), TILE):
            for q in range(p if i == j else 0, len(right), TILE):
                x, y = left[p : p + TILE], right[q : q + TILE]
                if len(np.unique(forest.label[forest.of[np.r_[x, y]]])) == 1:
                    continue
                both = _counts([sets[k] for k in x], [sets[k] for k in y])
                link = 100 * both >= 75 * (n[x][:, None] + n[y][None, :] - both)
                for k in np.flatnonzero(link.any(1)):
                    links += [(int(node[own[x[k]]]), int(node[own[c]])) for c in forest.apart(x[k], y[link[k]])]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _cross_links(able: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between the parts of able(bucket, node, n, part), exactly: nodes that buckets hold together are a cluster, and
    a cluster's nodes meet each other once, however many buckets they share. A cluster is cut into blocks of bounded
    size, which meet in pairs, each pair a group of its own; small clusters are dealt into groups of that size.
    Pairs of nodes are counted within a group, and only links that join parts leave it."""
    lowest = able.groupBy("bucket").agg(F.min("node").alias("a"))
    clusters = scratch.put("clusters", components(able.join(lowest, "bucket").select("a", F.col("node").alias("b")), scratch))
    members = able.select("node", "n", "part").distinct().join(clusters, "node").withColumnRenamed("component", "cluster")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = scratch.put("members", members.join(sizes, "cluster"))
    deals = max(1, -(-(members.agg(F.sum("n").alias("n")).first()["n"] or 0) // BLOCK))
    rows = members.withColumn("blk", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(deals))).otherwise(F.col("cluster"))
    rows = rows.select("cluster", "node", "part", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.struct(F.col("blocks") == 1, deal).alias("deal"))
    return rows.join(sets, "node").groupBy("deal", "i", "j").applyInArrow(_cross, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text, ...).

    Null or blank texts have no shingles and link with nothing. Rows that repeat a doc_id are one document:
    each keeps its own n_shingles, they share a component. A row without doc_id links with nothing: its
    component_id is null, and it is kept. Other columns, whatever their names, play no part.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketched = scratch.put("sketched", docs.mapInArrow(_sketches, "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    named = sketched.filter("doc_id is not null and set_key is not null")
    classes = scratch.put("classes", named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")))
    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    leaders = scratch.put("leaders", rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("other")).filter("leader <> other"))
    buckets = scratch.put("buckets", rows.join(leaders.select("bucket", "leader"), "bucket").select("bucket", "node", "n", "leader"))
    # every document's class; classes that share a document are linked by it
    sizes = scratch.put("sizes", sketched.select("doc_id", "n_shingles"))
    of = scratch.put("of", named.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node").distinct())
    scratch.drop("sketched", "classes", "leaders")

    wanted = buckets.select("node").distinct()
    sets = scratch.put("sets", docs.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets, "node long, shingles binary"))
    parts = scratch.put("parts", of.select("node", F.col("node").alias("part")).distinct())
    twice = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    links = of.join(twice.select("doc_id", "a"), "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))
    first = buckets.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.put("links", links.union(_verified(first, sets)))
    parts = merged(parts, links, scratch)

    def still_mixed() -> DataFrame:
        return scratch.put("placed", _mixed(buckets.join(parts, "node").select("bucket", "node", "n", "part")))

    placed = still_mixed()
    if not placed.isEmpty():
        # each part of a bucket is spoken for by the member that shares most with other parts; an original whose copies
        # differ from each other is such a one, and speaks for the bucket
        able = _able(placed, sets, scratch)
        most = F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), "node", "n"))
        reps = scratch.put("reps", able.groupBy("bucket", "part").agg(most.alias("r")).select("bucket", "part", "r.share", "r.node", "r.n"))
        one = reps.groupBy("bucket").agg(F.max(F.struct("share", "node", "part", "n")).alias("r")).select("bucket", F.col("r.part").alias("q"), F.col("r.node").alias("other"), F.col("r.n").alias("m"))
        pairs = reps.join(one, "bucket").filter("part <> q and 4 * least(n, m) >= 3 * greatest(n, m)")
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        parts = merged(parts, scratch.put("links", _verified(pairs, sets)), scratch)
        placed = still_mixed()
    if not placed.isEmpty():
        able = _able(placed, sets, scratch)
        if not able.isEmpty():
            parts = merged(parts, scratch.put("links", _cross_links(able, sets, scratch)), scratch)
    label = scratch.put("label", of.join(parts, "node").groupBy("doc_id").agg(F.min("part").alias("component")))
    scratch.keep_only("sizes", "label")
    out = sizes.join(label, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of the whole documents table."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


#: The same by joining whole shingles: for small tables.
OP1_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i : i + 4], ' ') end as shingle
        from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from w where len(ws) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
    e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 75 * (a.n + b.n - common)),
    l as (select x, y from e union all select y, x from e),
    r(doc_id, other) as (select distinct doc_id, doc_id from documents union select r.doc_id, l.y from r join l on l.x = r.other),
    c as (select doc_id, min(other) as component_id from r group by 1)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d left join n using (doc_id) join c using (doc_id)"""
