"""Repeated strings of 400 bytes, or of 51 words, by prefix-free parsing.

A text is a sequence of symbols, its bytes or its words. A rolling hash over k symbols sets triggers where it is
smallest among W = length - k + 1 neighbours, so that every string of that length holds a trigger, and equal strings
hold it at the same place. Triggers cut texts into phrases; the dictionary is the set of distinct phrase beginnings
(k symbols), the parse is where texts have them. Only phrases that the parse has twice can lie in a repeated string, and
all else is left out at once. Of the corpus order of
suffixes, just one thing is asked: which suffixes share their first `length` symbols with a neighbour. So no order of
the dictionary's suffixes is built, which would take eight bytes for each byte; classes of equal strings stand for it:
first the longest context of a trigger, all of whose strings repeat if it does, then single strings at the edges:
those around triggers without such a context, and, where their phrase has any of those elsewhere, those around one
trigger that speaks for all of its context.

Hashes travel as sorted blocks, each distinct hash of a unit of texts once, so a passage that many texts
share is not gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, Scratch, documents, mix, release, trim


@dataclass(frozen=True)
class Unit:
    """What strings are made of: how many symbols a repeated one has, how many a trigger has, and whether those are
    words `[^\\x20\\x09-\\x0D]+` or bytes."""

    length: int
    gram: int
    words: bool = False

    @property
    def least(self) -> int:
        """Bytes that a string takes at least: words have one each, and one between them."""
        return 2 * self.length - 1 if self.words else self.length


BYTES, PASSAGES = Unit(400, 256), Unit(51, 24, words=True)
UNIT_ROWS, UNIT_BYTES = 2000, 8_000_000  # texts, and bytes of them, that send their hashes together
SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
BASE = 0xD1342543DE82EF95
CHUNK = 1 << 20  # a long text is hashed piece by piece, so tables of powers stay small


class Powers:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * len(cls.up), 1 << 14)
            inverse = np.uint64(pow(BASE, -1, 1 << 64))
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(BASE))])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse)])
        return cls.up, cls.down


def rolling(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the strings of `size` symbols at the given places (in order)."""
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(text), CHUNK):
        a, b = np.searchsorted(starts, (low, low + CHUNK))
        if a == b:
            continue
        piece = text[low : low + CHUNK + size]
        up, down = Powers.to(len(piece))
        values = piece if piece.dtype == np.uint64 else BYTE[piece]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values * down[: len(piece)], out=sums[1:])
        at = starts[a:b] - low
        out[a:b] = mix((sums[at + size] - sums[at]) * up[at])
    return out


def words_in(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words."""
    return spans_of(~SPACE[text])


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each word of a text, from running sums over its bytes; a few words of a long text at a time."""
    starts, ends = words_in(text)
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        at = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, at + CHUNK, "right")))
        piece, a, b = text[at : ends[high - 1]], starts[low:high] - at, ends[low:high] - at
        up, down = Powers.to(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE[piece] * down[: len(piece)], out=sums[1:])
        out[low:high] = mix((sums[b] - sums[a]) * up[a])
        low = high
    return out


def sliding(values: np.ndarray, width: int, of: np.ufunc, fill: int) -> np.ndarray:
    """Smallest or largest of every `width` neighbours."""
    n = len(values)
    grid = np.full(n + -n % width, fill, np.uint64)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = of.accumulate(grid, 1).ravel()
    behind = of.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return of(behind[: n - width + 1], ahead[width - 1 : n])


def symbols(raw: bytes, unit: Unit) -> np.ndarray:
    text = np.frombuffer(raw, np.uint8)
    return word_hashes(text) if unit.words else text


def triggers(text: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's triggers; none in a text shorter than the unit's strings."""
    if len(text) < unit.length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = unit.length - unit.gram + 1
    h = rolling(text, np.arange(len(text) - unit.gram + 1), unit.gram)
    least = sliding(h, width, np.minimum, 2**64 - 1)
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(h == sliding(around, width, np.maximum, 0))
    return at, h[at]


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.zeros(len(flags) + 2, bool)
    edge[1:-1] = flags
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    return edges[::2], edges[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """n flags, true in any of the spans."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


class Text:
    """A candidate: its symbols and its repeated triggers."""

    def __init__(self, text: str, places: list[int], unit: Unit):
        self.raw, self.unit = text.encode("utf-8", "replace"), unit
        self.symbols = symbols(self.raw, unit)
        self.length, self.gram, self.reach = unit.length, unit.gram, unit.length - unit.gram
        self.at = np.sort(np.array(places, np.int64))
        self.last = len(self.symbols) - unit.length + 1

    def bytes_of(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of symbols as spans of bytes."""
        if not self.unit.words:
            return starts, ends
        first, last = words_in(np.frombuffer(self.raw, np.uint8))
        return first[starts], last[ends - 1]

    def contexts(self) -> np.ndarray:
        """Hash of each trigger's longest context: all strings that hold it; 0 where the text ends before."""
        whole = (self.at >= self.reach) & (self.at + self.length <= len(self.symbols))
        out = np.zeros(len(self.at), np.uint64)
        out[whole] = rolling(self.symbols, self.at[whole] - self.reach, self.length + self.reach) | np.uint64(1)
        return out

    def grams(self) -> np.ndarray:
        return rolling(self.symbols, self.at, self.gram)

    def around(self, chosen: np.ndarray) -> np.ndarray:
        """Flags of the starts of strings that hold a chosen trigger."""
        at = self.at[chosen]
        return covered(self.last, np.maximum(at - self.reach, 0), np.minimum(at + 1, self.last))


def sent(unit: str, keys: np.ndarray, marks: np.ndarray, shards: int) -> pa.RecordBatch:
    """The unit's distinct hashes with the marks (bits) that any of them has, one row for each shard."""
    order = np.lexsort((keys, keys % np.uint64(shards)))
    keys, marks = keys[order], marks[order].astype(np.uint8)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    many = np.diff(np.r_[first, len(keys)]) > 1
    marks = (np.bitwise_or.reduceat(marks, first) if len(first) else marks) | (many * MANY).astype(np.uint8)
    keys = keys[first]
    shard = (keys % np.uint64(shards)).astype(np.int32)
    bounds = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.zeros(1, int)
    cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
    return pa.record_batch([pa.array([shard[a] for a, _ in cuts], pa.int32()), pa.array([unit] * len(cuts), pa.string()), pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([marks[a:b].tobytes() for a, b in cuts], pa.binary())], ["shard", "unit", "keys", "marks"])


MANY, OPEN, LEAD = 1, 2, 4  # marks: more than once in the unit; with a context that is not known to repeat; speaking for a context
SENT, ANSWER = "shard int, unit string, keys binary, marks binary", "unit string, kind string, keys binary"


def _met(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The rows' keys; all of them, their marks, and the number of each among the distinct ones."""
    trim()  # what the group before has left
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    marks = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("marks")])
    keys = np.concatenate(lists)
    return lists, keys, marks, np.unique(keys, return_inverse=True)[1]


def _answers(table: pa.Table, lists: list[np.ndarray], **kinds: np.ndarray) -> pa.Table:
    ends, units, rows = np.cumsum([len(k) for k in lists]), table.column("unit").to_pylist(), []
    for kind, flags in kinds.items():
        for unit, k, e in zip(units, lists, ends, strict=True):
            if len(own := k[flags[e - len(k) : e]]):
                rows.append((unit, kind, own.tobytes()))
    return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate((("unit", pa.string()), ("kind", pa.string()), ("keys", pa.binary())))})


def repeated(rows: DataFrame, kind: str, lead: str | None = None) -> DataFrame:
    """Answers to each unit: its hashes that stand at least twice in all units; and, of those, the ones that it is the first to send."""

    def meet(_, table):
        lists, keys, marks, at = _met(table)
        twice = (np.bincount(at) > 1)[at]
        twice |= np.isin(at, at[(marks & MANY) > 0])
        first = np.zeros(len(at), bool)
        first[np.unique(at, return_index=True)[1]] = True
        return _answers(table, lists, **{kind: twice} | ({lead: twice & first} if lead else {}))

    return rows.groupBy("shard").applyInArrow(meet, ANSWER)


def opened(rows: DataFrame, kind: str) -> DataFrame:
    """Answers to units that speak for a context: their hashes that are open in any unit."""

    def meet(_, table):
        lists, keys, marks, at = _met(table)
        return _answers(table, lists, **{kind: np.isin(at, at[(marks & OPEN) > 0]) & ((marks & LEAD) > 0)})

    return rows.groupBy("shard").applyInArrow(meet, ANSWER)


def keys_of(table: pa.Table, kind: str) -> np.ndarray:
    got = [np.frombuffer(k.as_py(), np.uint64) for x, k in zip(table.column("kind").to_pylist(), table.column("keys"), strict=True) if x == kind]
    return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _anchors(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        rows, grams, places = [], [], []
        for k, x in enumerate(b.column(1)):
            at, h = triggers(symbols((x.as_py() or "").encode("utf-8", "replace"), unit), unit)
            if len(at):
                rows.append(k)
                grams.append(h.view(np.int64))
                places.append(at.astype(np.int32))
        own = b.take(pa.array(rows, pa.int64()))
        trim()
        yield pa.record_batch([own.column(0), own.column(2), own.column(3), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "tid", "size", "gram", "at"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in units of bounded rows and bytes; a longer text is a unit of its own."""
    part = TaskContext.get().partitionId()
    for k, b in enumerate(batches):
        low, held = 0, 0
        sizes = b.column(1).to_pylist()
        for j, size in enumerate([*sizes, None]):
            if j > low and (size is None or j - low == UNIT_ROWS or held + size > UNIT_BYTES):
                piece = b.slice(low, j - low)
                yield pa.record_batch([pa.array([f"{part}.{k}.{low}"] * piece.num_rows, pa.string()), *piece.columns], ["unit", *b.schema.names])
                low, held = j, 0
            held += size or 0


def _by_unit(b: pa.RecordBatch) -> Iterator[tuple[str, list[int]]]:
    rows: dict[str, list[int]] = {}
    for k, unit in enumerate(b.column(0).to_pylist()):
        rows.setdefault(unit, []).append(k)
    # a unit cut by a batch sends twice; what both parts have stands in different texts, and rightly counts twice
    yield from rows.items()


def found_spans(docs: DataFrame, unit: Unit, with_text: bool, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text, tid, size): (tid, size, copies) of texts with a string's length, and (tid, size, gone, spans, sha,
    kept) of those of them that hold a repeated string."""
    shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    long = docs.filter(F.col("size") >= unit.least)
    anchors = scratch.put("anchors", long.select("doc_id", "text", "tid", "size").mapInArrow(lambda batches: _anchors(batches, unit), "doc_id long, tid long, size int, gram array<long>, at array<int>"))
    copies = scratch.put(f"{name}copies", anchors.groupBy("tid", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))

    parse = anchors.select("tid", "size", F.inline(F.arrays_zip("gram", "at")))
    place = F.xxhash64("tid", "size", "at")
    twice = parse.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("gram")
    twice = scratch.put("twice", twice)  # so that both sides of the join are dealt by key, and a frequent phrase's rows can be split
    places = scratch.put("places", parse.join(twice, "gram").groupBy("tid", "size").agg(F.collect_set("at").alias("places")))
    scratch.drop("anchors", "twice")
    wanted = places.join(copies, ["tid", "size"])
    same = (docs["tid"] == wanted["tid"]) & (docs["size"] == wanted["size"]) & docs["doc_id"].eqNullSafe(wanted["first"])
    found = docs.join(wanted, same).select(docs["tid"], docs["size"], "text", "places")
    candidates = scratch.put("candidates", found.mapInArrow(_units, "unit string, tid long, size int, text string, places array<int>"))
    scratch.drop("places")

    def list_triggers(batches):
        for b in batches:
            trim()
            for key, rows in _by_unit(b):
                got = [Text(b.column(3)[k].as_py(), b.column(4)[k].as_py(), unit) for k in rows]
                yield pa.record_batch([pa.array([key], pa.string()), pa.array([np.concatenate([t.grams() for t in got]).tobytes()], pa.binary()), pa.array([np.concatenate([t.contexts() for t in got]).tobytes()], pa.binary())], ["unit", "grams", "contexts"])

    def ask_contexts(batches):
        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = np.frombuffer(x.as_py(), np.uint64)
                yield sent(key, c[c > 0], np.zeros((c > 0).sum(), np.uint8), shards)

    def ask_grams(key, left, right):
        grams, contexts = (np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in left.column(c)]) for c in ("grams", "contexts"))
        marks = np.where(among(contexts, keys_of(right, "context")), np.where(among(contexts, keys_of(right, "lead")), LEAD, 0), OPEN)
        return pa.Table.from_batches([sent(key[0].as_py(), grams[marks > 0], marks[marks > 0], shards)])

    def texts(left, right):
        trim()
        contexts, lead, grams = (keys_of(right, k) for k in ("context", "lead", "gram"))
        for x, p in zip(left.column("text"), left.column("places"), strict=True):
            t = Text(x.as_py(), p.as_py(), unit)
            c = t.contexts()
            known = among(c, contexts)
            ask = np.flatnonzero(t.around(~known | among(c, lead) & among(t.grams(), grams)))
            yield t, known, ask, rolling(t.symbols, ask, unit.length)

    def ask_strings(key, left, right):
        got = [np.empty(0, np.uint64)] + [h for _, _, _, h in texts(left, right)]
        h = np.concatenate(got)
        return pa.Table.from_batches([sent(key[0].as_py(), h, np.zeros(len(h), np.uint8), shards)])

    def cut(_, left, right):
        strings, out = keys_of(right, "string"), []
        for t, known, ask, h in texts(left, right):
            again = t.around(known)
            again[ask[among(h, strings)]] = True
            starts, ends = spans_of(again)
            starts, ends = spans_of(covered(len(t.symbols), starts, ends + unit.length - 1))
            starts, ends = t.bytes_of(starts, ends)
            kept = np.frombuffer(t.raw, np.uint8)[~covered(len(t.raw), starts, ends)].tobytes()
            out.append((int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        n, s, sha, kept = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table({"tid": left.column("tid"), "size": left.column("size"), "gone": pa.array(n, pa.int64()), "spans": pa.array(s, pa.int64()), "sha": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    found_triggers = scratch.put("triggers", candidates.mapInArrow(list_triggers, "unit string, grams binary, contexts binary"))
    contexts = scratch.put("contexts", repeated(found_triggers.select("unit", "contexts").mapInArrow(ask_contexts, SENT), "context", "lead"))
    asked = found_triggers.groupBy("unit").cogroup(contexts.groupBy("unit")).applyInArrow(ask_grams, SENT)
    answers = scratch.put("answers", contexts.unionByName(opened(asked, "gram")))
    scratch.drop("triggers", "contexts")
    units = candidates.groupBy("unit")
    strings = scratch.put("strings", repeated(units.cogroup(answers.groupBy("unit")).applyInArrow(ask_strings, SENT), "string"))
    result = units.cogroup(answers.unionByName(strings).groupBy("unit")).applyInArrow(cut, "tid long, size int, gone long, spans long, sha string, kept string")
    result = scratch.put(f"{name}result", result.filter("gone > 0").dropDuplicates(["tid", "size"]))
    scratch.drop("candidates", "answers", "strings")
    return copies.select("tid", "size", "copies"), result


def numbered(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, text (null: empty), the carried columns as own_..., tid and size of every row."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), *[F.col(c).alias(f"own_{c}") for c in carry])
    return docs.withColumns({"tid": F.xxhash64("text"), "size": F.octet_length("text").cast("int")})


def repeated_spans(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), unit: Unit = BYTES, passages: Unit | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text, ...); with_text: and kept_text;
    carry: other columns of docs that come along.

    Every symbol of a string of the unit's length that also starts anywhere else is removed; between removed words, what
    parts them goes too. A null text counts as empty. Rows that repeat are copies of each other, so a text of that
    length that stands there twice goes whole, whatever its doc_ids. Texts are known by a 64-bit hash and their size.
    kept_text: what is left, without characters that a cut has broken. passages: another unit, whose repeated strings are
    counted beside: n_passages, and n_passage_bytes in them.
    """
    scratch = Scratch(docs.sparkSession)
    docs = numbered(docs, carry)
    copies, result = found_spans(docs, unit, with_text, scratch, "")
    joined = docs.withColumn("own_sha", F.sha2(F.col("text").cast("binary"), 256))
    if not with_text:
        joined = joined.drop("text")
    joined = joined.join(copies, ["tid", "size"], "left").join(result, ["tid", "size"], "left")
    size = F.col("size").cast("long")

    def counts(copies: str, gone: str, spans: str) -> tuple:
        whole = F.coalesce(F.col(copies) > 1, F.lit(False))
        return whole, F.when(whole, size).otherwise(F.coalesce(gone, F.lit(0))).cast("long"), F.when(whole, 1).otherwise(F.coalesce(spans, F.lit(0))).cast("long")

    whole, gone, spans = counts("copies", "gone", "spans")
    cols = [F.col("doc_id"), size.alias("n_bytes"), gone.alias("n_removed"), spans.alias("n_spans")]
    cols.append(F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"))
    cols += [F.col(f"own_{c}").alias(c) for c in carry]
    if with_text:
        cols.append(F.when(whole, "").otherwise(F.coalesce("kept", "text")).alias("kept_text"))
    if passages:
        more, there = found_spans(docs, passages, False, scratch, "passage_")
        joined = joined.join(more.withColumnRenamed("copies", "p_copies"), ["tid", "size"], "left")
        joined = joined.join(there.select("tid", "size", F.col("gone").alias("p_gone"), F.col("spans").alias("p_spans")), ["tid", "size"], "left")
        _, gone, spans = counts("p_copies", "p_gone", "p_spans")
        cols += [spans.alias("n_passages"), gone.alias("n_passage_bytes")]
    return joined.select(*cols)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of the whole documents table; beside them, its repeated passages of over 50 words."""
    return repeated_spans(documents(spark, sf_dir, "doc_id", "text"), passages=PASSAGES)
