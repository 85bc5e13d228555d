"""Collocations: phrases of two to five words whose parts meet far more often than by chance.

Words that are frequent in their language get numbers; a text becomes its numbers, with 0 for what no frequent phrase can
hold (a rare word, the end of a piece). A phrase of k words can be frequent only if both its parts of k - 1 words are, so
frequent phrases of k - 1 words are compiled into double-array tries in slices of bounded size: tasks compile one each and put
it into the shared folder, from where all workers map it, so the driver has no more of them than their names. numpy
moves the states of all positions of a block one level down at once, and what no longer lies in any accepting state is
squeezed out of the block. Two accepting states one word apart are a candidate; a block sums its candidates, and Spark
sums those of all blocks. Candidates come from the text and not from a join of phrases with each other, which would make
all pairs of phrases around a common word.

Scores need the counts of all first and last parts of a phrase: each level is joined to the one before by the states of its
two parts, so counts are handed down, two equi-joins a level.
"""

from __future__ import annotations

import os
import shutil
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, mix, mounted_folder, release

LEAST, LONGEST, TOP = 100, 5, 2000
SLICE_ARCS = 1 << 17  # arcs of a slice of a trie (more only where one state has more)
GROUP_SLICES = 256  # slices that a task maps at once; further ones are further passes over the blocks
CROWDED = 64  # arcs of a state for which a place is looked for everywhere
FILE_WORDS = 1_000_000  # frequent words whose numbers lie in one file (about)
BLOCK_WORDS = 1_000_000  # positions of a block
ROW_WORDS = 8192  # positions of a row of the table of blocks; Parquet holds and compresses some hundred rows at once
SHARD_WORDS = 2_000_000  # positions whose candidates a shard holds
CACHE_WORDS = 100_000  # words of a language whose numbers a task remembers
PART_BYTES = 2_000_000  # of a text whose words are lists at the same time
COUNTED = 300_000  # distinct words that a task counts before it hands them on
UNDETERMINED = "und"
END = b"."  # stands for any character that ends a piece; none of them is in a word
#: What ends a piece, and what parts words inside one.
TO_WORDS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz.......... ")


def tokens_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Words with A-Z in lower case, and END where a piece ends; of a very long text in several lists."""
    text = (text or b"").translate(TO_WORDS)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + PART_BYTES)
        to = len(text) if to < 0 else to
        yield [w for w in text[at:to].replace(END, b" . ").split(b" ") if w]
        at = to


def word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, crc32(lang.encode()))


def first_fit(taken: np.ndarray, own: np.ndarray) -> int:
    """The first place from which a state's words all meet free ones; -1 for none. Takes memory for the places alone."""
    fits = np.arange(len(taken) - int(own.max()))
    for w in own:
        fits = fits[~taken[fits + w]]
    return int(fits[0]) if len(fits) else -1


class Slice:
    """A double-array over some parents: the arc of a parent by a word lies at base[parent] + word, if check says so there.
    States with many arcs that find no place in it (a window of nearly all words would go to each) keep theirs as codes in order."""

    def __init__(self, parent: np.ndarray, word: np.ndarray, value: np.ndarray):
        """Arcs in the order of (parent, word); values count from 1."""
        self.first, self.last = int(parent[0]), int(parent[-1])
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        sizes = np.diff(np.append(starts, len(parent)))
        room = 1 << max(6, (3 * len(parent)).bit_length())
        taken = np.zeros(room + int(word.max()) + 1, bool)
        base = np.full(len(starts), -1, np.int64)
        rng = np.random.default_rng(1)
        # states with most arcs first; those of one size try places together, the first at a place keeps it
        for size in np.unique(sizes)[::-1]:
            todo = np.flatnonzero(sizes == size)
            labels = word[starts[todo][:, None] + np.arange(size)]
            for _ in range(40 if size > 1 else 1000):
                tried = rng.integers(0, room, len(todo))
                slots = tried[:, None] + labels
                free = ~taken[slots].any(1)
                # of those that meet each other the first stays
                flat, owner = slots[free].ravel(), np.repeat(np.arange(int(free.sum())), size)
                order = np.argsort(flat, kind="stable")
                clash = flat[order][1:] == flat[order][:-1]
                lost = np.zeros(int(free.sum()), bool)
                lost[owner[order][1:][clash]] = True
                done = np.flatnonzero(free)[~lost]
                base[todo[done]] = tried[done]
                taken[slots[done].ravel()] = True
                left = np.ones(len(todo), bool)
                left[done] = False
                todo, labels = todo[left], labels[left]
                if not len(todo):
                    break
            if size > CROWDED:
                continue
            for k, own in zip(todo, labels, strict=True):  # the first place that fits; behind all others one always does
                base[k] = first_fit(taken, own)
                if base[k] < 0:
                    base[k] = len(taken)
                    taken = np.append(taken, np.zeros(max(len(taken), int(own.max()) + 1), bool))
                taken[base[k] + own] = True
        self.base = np.zeros(self.last - self.first + 1, np.int32)
        self.base[parent[starts] - self.first] = base
        base = np.repeat(base, sizes)
        rest = base < 0
        self.codes, self.behind = parent[rest] << 32 | word[rest], value[rest].astype(np.int32)
        at = (base + word)[~rest]
        length = int(at.max(initial=0)) + 2  # the last place stays free
        self.check, self.value = np.full(length, -1, np.int32), np.zeros(length, np.int32)
        self.check[at], self.value[at] = parent[~rest], value[~rest]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states behind arcs; 0 for none. States must be between first and last."""
        base = self.base[state - self.first]
        at = np.minimum(base + word, len(self.check) - 1)
        out = np.where(self.check[at] == state, self.value[at], 0)
        if len(self.codes):
            own = np.flatnonzero(base < 0)
            codes = state[own] << 32 | word[own]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            out[own] = np.where(self.codes[at] == codes, self.behind[at], 0)
        return out


@dataclass
class Stored:
    """A file of numbers in the shared folder: a slice of a trie, or numbers of words. Such files have disjoint ranges."""

    path: str
    first: int
    last: int
    sizes: tuple[int, int]

    def slice(self) -> Slice:
        """The slice that the file holds, mapped."""
        s = Slice.__new__(Slice)
        raw = np.memmap(self.path, np.int32, "r").view(np.ndarray)
        s.first, s.last, (n, states) = self.first, self.last, self.sizes
        codes, s.base, s.behind, rest = np.split(raw, np.cumsum([2 * n, states, n]))
        s.codes, (s.check, s.value) = codes.view(np.int64), np.split(rest, 2)
        return s

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and the numbers of their words."""
        return np.memmap(self.path, np.int64, "r", 0, self.sizes[0]).view(np.ndarray), np.memmap(self.path, np.int32, "r", 8 * self.sizes[0], self.sizes[1]).view(np.ndarray)


def kept_files(files: DataFrame, folder: str) -> list[Stored]:
    return [Stored(f"{folder}/{r['name']}", r["first"], r["last"], (r["a"], r["b"])) for r in sorted(files.collect(), key=lambda r: r["first"])]


def remove(files: list[Stored]) -> None:
    for f in files:
        os.unlink(f.path)


def put_file(folder: str, first: int, last: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Writes arrays behind each other; the row that says where."""
    name = uuid.uuid4().hex
    with open(f"{folder}/{name}", "wb") as f:
        for x in arrays:
            x.tofile(f)
    row = (name, first, last, len(arrays[0]), len(arrays[1]))
    return pa.record_batch([pa.array([x]) for x in row], FILE_COLUMNS)


FILE_COLUMNS = ["name", "first", "last", "a", "b"]
FILE = "name string, first long, last long, a long, b long"


def places(slices: list[Slice], state: np.ndarray) -> np.ndarray:
    """For each state the slice whose range it lies in; -1 for none. Slices in order."""
    k = np.searchsorted(np.array([s.first for s in slices], np.int64), state, "right") - 1
    k[state > np.array([s.last for s in slices], np.int64)[k]] = -1
    return k


def advance(slices: list[Slice], state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """All positions one level down, each in the slice that has its state; 0 where there is none."""
    out = np.zeros(len(state), np.int32)
    at = np.flatnonzero((state > 0) & (word > 0))
    k = places(slices, state[at])
    order = np.argsort(k, kind="stable")
    at, bounds = at[order], np.searchsorted(k[order], np.arange(len(slices) + 1))
    for s, a, b in zip(slices, bounds, bounds[1:], strict=False):
        own = at[a:b]
        out[own] = s.step(state[own].astype(np.int64), word[own].astype(np.int64))
    return out


def squeezed(words: np.ndarray, state: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the words that lie in no phrase of `depth` words with a state; one 0 stands for those between others."""
    keep = np.zeros(len(words), bool)
    for d in range(depth):
        keep[d:] |= state[: len(state) - d] > 0
    at = np.flatnonzero(keep)
    to = np.arange(len(at)) + np.cumsum(np.diff(at, prepend=-1) > 1)
    out = np.zeros(int(to[-1]) + 2 if len(to) else 0, np.int32), np.zeros(int(to[-1]) + 2 if len(to) else 0, np.int32)
    out[0][to], out[1][to] = words[at], state[at]
    return out


def numbered(scratch: Scratch, name: str, df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df, stored, with id from 1 in the order of columns that tell rows apart; and how many rows. Parts by ranges are
    sorted each for itself; only their sizes come to the driver."""
    part = F.shiftright("_at", 33)
    t = scratch.put(name, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["count"] for r in t.groupBy(part.alias("p")).count().collect()}
    offset, total = [], 1
    for p in sorted(sizes):
        offset += [F.lit(p), F.lit(total)]
        total += sizes[p]
    if not sizes:
        return t.drop("_at").withColumn("id", F.lit(0).cast("long")), 0
    at = F.create_map(*offset)[part] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return t.withColumn("id", at.cast("long")).drop("_at"), total - 1


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n: all words of all pieces, summed in each task before they are shuffled, in order (which packs well)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(END, None)
                if c:
                    words = sorted(c)
                    yield pa.record_batch([pa.array([lang] * len(c)), pa.array(words, pa.binary()).cast(pa.string()), pa.array([c[w] for w in words], pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                for words in tokens_of(text.as_py()):
                    counts.setdefault(lang, Counter()).update(words)
                if sum(map(len, counts.values())) > COUNTED:
                    yield from rows()
        yield from rows()
        release()

    return docs.mapInArrow(run, "lang string, word string, n long").repartition("lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def block_rows(words: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    """Rows of some ROW_WORDS positions, each cut behind a 0."""
    ends = np.flatnonzero(words == 0)
    near = np.searchsorted(ends, np.arange(ROW_WORDS, len(words), ROW_WORDS))
    cuts = np.unique(np.append(ends[near[near < len(ends)]] + 1, len(words)))
    rows = [[x.astype(np.int32)[a:b].tobytes() for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)] for x in (words, state)]
    return pa.record_batch([pa.array(r, pa.binary()) for r in rows], ["words", "states"])


def arrays_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and states of blocks, small ones together."""
    held, size = ([], []), 0
    for b in batches:
        for row in zip(b.column(0), b.column(1), strict=True):
            words, state = (np.frombuffer(x.as_py(), np.int32) for x in row)
            state = state if len(state) else words  # of single words
            if size and size + len(words) > BLOCK_WORDS:
                yield np.concatenate(held[0]), np.concatenate(held[1])
                held, size = ([], []), 0
            held[0].append(words), held[1].append(state)
            size += len(words)
    if size:
        yield np.concatenate(held[0]), np.concatenate(held[1])


def stored_words(words: DataFrame, count: int, folder: str) -> list[Stored]:
    """Keys and numbers of words(lang, word, id) in files by ranges of keys."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [word_key(lang, w.as_py()) for lang, w in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True)]
            yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), b.column(2)], ["key", "id"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            keys, ids = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            yield put_file(folder, int(keys[0]), int(keys[-1]), [keys, ids.astype(np.int32)])

    by_key = words.select("lang", "word", "id").mapInArrow(keyed, "key long, id long").repartitionByRange(max(8, -(-count // FILE_WORDS)), "key")
    return kept_files(by_key.sortWithinPartitions("key").mapInArrow(write, FILE), folder)


def encoded(docs: DataFrame, files: list[Stored]) -> DataFrame:
    """words, states: texts in numbers of frequent words, in blocks; the states of single words are their numbers.
    files: of stored_words()."""
    firsts = [f.first for f in files]

    class Numbers(dict):
        def __init__(self, lang: str, tables: list):
            super().__init__({END: 0})
            self.lang, self.tables = lang, tables

        def __missing__(self, word: bytes) -> int:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self[END] = 0
            key = np.uint64(word_key(self.lang, word)).view(np.int64)
            out, k = 0, bisect_right(firsts, key) - 1
            if k >= 0:
                keys, ids = self.tables[k]
                at = int(np.searchsorted(keys, key))
                out = int(ids[at]) if at < len(keys) and keys[at] == key else 0
            self[word] = out
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        tables = [f.numbers() for f in files]
        held, size = [], 0

        def block() -> pa.RecordBatch:
            words = np.concatenate(held)
            rows = block_rows(*squeezed(words, words, 1))
            return rows.set_column(1, "states", pa.array([b""] * len(rows), pa.binary()))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                numbers = known.setdefault(lang, Numbers(lang, tables)).__getitem__
                for words in tokens_of(text.as_py()):
                    held.append(np.fromiter(map(numbers, words), np.int32, len(words)))
                    size += len(words)
                held.append(np.zeros(1, np.int32))
                if size > BLOCK_WORDS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()
        release()

    return docs.mapInArrow(run, "words binary, states binary")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as their differences, 64 bits each, compressed: those of a sorted list take two or three bytes."""
    return pa.compress(np.diff(numbers, prepend=0).astype(np.int64).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(raw, 8 * size, "zstd"), np.int64))


def count_candidates(blocks: DataFrame, least: int) -> DataFrame:
    """left, right, n of two states that stand one word apart at least so often. A block sums its own and sends them in
    packed lists by shard; a shard holds some SHARD_WORDS positions' worth of them, whatever the size of the corpus, as even
    those of one left state are dealt out."""
    shards = -(-blocks.count() * ROW_WORDS // SHARD_WORDS) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, state in arrays_of(batches):
            at = np.flatnonzero((state[:-1] > 0) & (state[1:] > 0))
            codes = state[at].astype(np.int64) << 32 | state[at + 1]
            codes.sort()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else at
            codes, n = codes[first], np.diff(np.append(first, len(codes)))
            shard = (mix((codes >> 10).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            codes, n, shard = codes[order], n[order], shard[order]
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else shard, len(shard)).tolist()
            parts = list(zip(cuts, cuts[1:], strict=False))
            cols = [shard[cuts[:-1]], [packed(codes[a:b]) for a, b in parts], [packed(n[a:b]) for a, b in parts], [b - a for a, b in parts]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["shard", "codes", "counts", "size"])
        release()

    def merge(key, table):
        sizes = table.column("size").to_pylist()
        codes, n = (np.concatenate([unpacked(x.as_py(), size) for x, size in zip(table.column(c), sizes, strict=True)]) for c in ("codes", "counts"))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        codes, n = codes[first], np.add.reduceat(n, first)
        codes, n = codes[n >= least], n[n >= least]
        return pa.table({"left": pa.array(codes >> 32), "right": pa.array(codes & 0xFFFFFFFF), "n": pa.array(n, pa.int64())})

    return blocks.mapInArrow(run, "shard long, codes binary, counts binary, size long").groupBy("shard").applyInArrow(merge, "left long, right long, n long")


def slices_of(arcs: DataFrame, count: int, folder: str) -> list[Stored]:
    """Tries of arcs(left, word, id) in slices, in files; a task compiles those of a range of states."""
    most = SLICE_ARCS

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            arcs = [np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in range(3)]
            starts = np.flatnonzero(np.append(True, arcs[0][1:] != arcs[0][:-1]))
            near = np.searchsorted(starts, np.arange(most, len(arcs[0]), most))
            cuts = np.unique(np.append(starts[near[near < len(starts)]], len(arcs[0]))).tolist()
            for a, b in zip([0, *cuts], cuts, strict=False):
                s = Slice(*(x[a:b] for x in arcs))
                yield put_file(folder, s.first, s.last, [s.codes, s.base, s.behind, s.check, s.value])
        release()

    ranges = arcs.select("left", "word", "id").repartitionByRange(-(-count // most), "left").sortWithinPartitions("left", "word")
    return kept_files(ranges.mapInArrow(compiled, FILE), folder)


def moved(blocks: DataFrame, group: list[Stored], depth: int, last: bool) -> DataFrame:
    """Blocks with states one level down, of phrases of `depth` words, as far as the group's slices have them. Between
    groups a state that was moved is negative; after the last group those that no slice has moved go, and what they held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [s.slice() for s in group]
        for words, state in arrays_of(batches):
            after = np.zeros(len(words), np.int32)
            after[: len(words) - depth + 1] = words[depth - 1 :]
            out = np.where(state < 0, state, 0)  # moved before
            new = advance(slices, np.maximum(state, 0), after)
            own = (state > 0) & (places(slices, state) >= 0)
            out = np.where(own, -new, np.where(state < 0, out, state))
            yield block_rows(*squeezed(words, np.maximum(-out, 0), depth)) if last else block_rows(words, out)

    return blocks.mapInArrow(run, "words binary, states binary")


def grouped(slices: list[Stored], size: int = GROUP_SLICES) -> Iterator[tuple[list[Stored], bool]]:
    """Groups of slices, and whether one is the last."""
    held: list[Stored] = []
    for s in slices:
        if len(held) == size:
            yield held, False
            held = []
        held.append(s)
    yield held, True


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to `longest` words that occur `least` times in their language, and lang, n of all words.

    docs(text, lang, ...): null texts are empty, a null lang is `und`; rows that repeat count each. Phrases: lang,
    phrase, words, a, first and last (counts of its first and last 1, 2, ... words, itself included), maximal (no longer
    frequent phrase around it occurs as often).
    """
    spark = docs.sparkSession
    scratch, ids = Scratch(spark), Scratch(spark)
    docs = docs.select(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), "text")
    counts = ids.put("counts", count_words(docs))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words, size = numbered(ids, "words", counts.filter(F.col("n") >= least), "lang", "word")
    known = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.col("id").alias("word"), F.lit(1).alias("words"), F.col("n").alias("a"), F.array("n").alias("first"), F.array("n").alias("last"))
    folder = mounted_folder(spark, "phrases")
    files = stored_words(words, size, folder)
    blocks = scratch.put("blocks", encoded(docs, files))
    remove(files)
    found: list[DataFrame] = []
    for k in range(2, longest + 1):
        level, size = numbered(ids, f"level{k}", count_candidates(blocks, least), "left", "right")
        left = known.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("first").alias("firsts"))
        right = known.select(F.col("id").alias("right"), "tail", "word", F.col("last").alias("lasts"))
        joined = level.join(left, "left").join(right, "right")
        n = F.col("n")
        new = joined.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "tail", "word", F.lit(k).alias("words"), n.alias("a"), F.concat("firsts", F.array(n)).alias("first"), F.concat("lasts", F.array(n)).alias("last"), "left", "right")
        new = ids.put(f"phrases{k}", new)
        if found:
            inside = new.select(F.explode(F.array("left", "right")).alias("id"), "a").distinct().withColumn("around", F.lit(True))
            found[-1] = found[-1].join(inside, ["id", "a"], "left").withColumn("maximal", F.col("around").isNull())
        found.append(new)
        known = new
        if k == longest or not size:
            break
        files = slices_of(new, size, folder)
        for group, last in grouped(files):
            blocks = scratch.put("blocks", moved(blocks, group, k, last))
        remove(files)
    shutil.rmtree(folder, ignore_errors=True)
    scratch.drop("blocks")
    found[-1] = found[-1].withColumn("maximal", F.lit(True))
    cols = ["lang", "phrase", "words", "a", "first", "last", "maximal"]
    out = found[0].select(*cols)
    for f in found[1:]:
        out = out.unionByName(f.select(*cols))
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all frequent phrases that no longer one around them matches in count.
    The lowest score of all cuts counts, of equal ones that behind the fewest words. Decimals of 38 digits hold all products."""
    phrases, totals = frequent_phrases(docs, least, longest)
    whole = "cast({} as decimal(20, 0))"
    ratio = f"cast(cast(1000 * {whole.format('a')} as decimal(24, 0)) * {whole.format('n')} as decimal(38, 0)) div cast({whole.format('l')} * {whole.format('r')} as decimal(38, 0))"
    cuts = F.expr("transform(sequence(1, words - 1), k -> named_struct('k', k, 'l', element_at(first, k), 'r', element_at(last, words - k)))")
    cut = phrases.filter("maximal").join(totals, "lang").withColumn("cuts", cuts)
    scored = cut.withColumn("best", F.expr(f"array_min(transform(cuts, c -> named_struct('score', {ratio.replace('cast(l ', 'cast(c.l ').replace('cast(r ', 'cast(c.r ')}, 'k', c.k, 'l', c.l, 'r', c.r)))"))
    return scored.select("lang", "phrase", "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best collocations of the whole documents table."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = collocations(documents(spark, sf_dir, "text", "lang")).withColumn("rank", rank).filter(F.col("rank") <= TOP)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) as piece
  from documents where text is not null),
split as (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from pieces),
totals as (select lang, cast(sum(len(ws)) as bigint) as n from split group by lang),
grams as (
  select lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from split, (select unnest(range(1, 6)) as k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 100),
inside as (
  select distinct g.lang, g.a, s.phrase
  from f g, (select unnest([0, 1]) as side) x, lateral (select case when side = 0 then regexp_replace(g.phrase, ' [^ ]*$', '') else regexp_replace(g.phrase, '^[^ ]* ', '') end as phrase) s
  where g.k >= 3),
kept as (select * from f where k >= 2 and not exists (select 1 from inside i where i.lang = f.lang and i.a = f.a and i.phrase = f.phrase)),
cuts as (
  select kept.*, c, array_to_string(list_slice(string_split(phrase, ' '), 1, c), ' ') as head, array_to_string(list_slice(string_split(phrase, ' '), c + 1, k), ' ') as tail
  from kept, (select unnest(range(1, 5)) as c) where c < k),
scored as (
  select cuts.lang, cuts.phrase, cuts.a, l.a as l, r.a as r, t.n, cast((1000::hugeint * cuts.a * t.n) // (l.a::hugeint * r.a) as bigint) as score, c
  from cuts join totals t on t.lang = cuts.lang join f l on l.lang = cuts.lang and l.phrase = head join f r on r.lang = cuts.lang and r.phrase = tail),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) where rank <= 2000
"""
