"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark.

The model is a folder of sorted arrays in the shared folder, which workers map into memory:
  vocabulary, by ranges of the words' 64-bit hashes: sorted hashes, counts; a word's id is its place in them all
  pairs, by shards: sorted keys (id of the context << 32 | id of the word), counts
  by id: in how many contexts a word stands; how many words follow it once, twice, more often

Tasks count on their side and send one block of sorted keys and counts to each range or shard, so a frequent word
or pair weighs no more than a rare one. Pairs go to shards by their context, so that a shard knows all that
follows it; contexts with more than a share of all tokens are dealt out by pair, and their sums meet by id.
Files are written beside their place and renamed, so a task that runs again changes nothing.

Scoring looks up each distinct pair of a block of documents once.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, lower_words_of, mix, mounted_folder

END = b"\n"  # no word; after each text, and the context of its first word
TASK_WORDS, TASK_PAIRS = 400_000, 2_500_000  # what a task counts before it sends
BLOCK = "part int, keys binary, counts binary"


@dataclass
class Folder:
    """Arrays under a path; opened in each process when first asked for."""

    path: str
    shards: int
    offsets: np.ndarray | None = None  # ids before each range
    total: int = 0  # training tokens
    hot: np.ndarray | None = None  # ids of contexts that are dealt out by pair
    ranges: frozenset = frozenset()  # of words; and shards of pairs, that hold any
    pairs: frozenset = frozenset()
    discounts: dict = field(default_factory=dict)
    opened: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def write(self, name: str, values: np.ndarray) -> None:
        at = f"{self.path}/{name}"
        values.tofile(beside := f"{at}.{uuid.uuid4().hex}")
        os.replace(beside, at)

    def read(self, name: str, dtype) -> np.ndarray:
        """An array; empty where nothing was written. A file that was written and is not to be seen is an error."""
        if name not in self.opened:
            part = int(re.search(r"-([0-9]+)", name)[1])
            there = part in (self.pairs if name.startswith("pairs") else self.ranges)
            self.opened[name] = np.memmap(f"{self.path}/{name}", dtype, "r") if there else np.empty(0, dtype)
        return self.opened[name]

    @property
    def types(self) -> int:
        return int(self.offsets[-1])

    def range_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        by = mix(context)
        if len(self.hot):
            split = np.isin(context, self.hot)
            by[split] = mix(keys[split])
        return by % np.uint64(self.shards)

    def find(self, wanted: np.ndarray, part: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of values in the arrays name-<part>, and whether they are there."""
        at, there = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        order = np.lexsort((wanted, part))
        bounds = np.searchsorted(part[order], np.arange(self.shards + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[p] : bounds[p + 1]]
            keys = self.read(f"{name}-{p}.keys", np.uint64)
            if len(keys):
                k = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
                at[own], there[own] = k, keys[k] == wanted[own]
        return at, there

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words; `types` for words that are unknown."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        part = self.range_of(h).astype(np.int64)
        at, there = self.find(h, part, "vocab")
        return np.where(there, self.offsets[part] + at, self.types)

    def by_id(self, name: str, dtype, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of known ids from the ranges' arrays; 0 for unknown ones. ids: sorted. width: numbers of each."""
        out = np.zeros((len(ids), width) if width > 1 else len(ids), dtype)
        bounds = np.searchsorted(ids, self.offsets)
        for r in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[r], bounds[r + 1])
            out[own] = (self.read(name.format(r), dtype).reshape(-1, width) if width > 1 else self.read(name.format(r), dtype))[ids[own] - self.offsets[r]]
        return out


class Ids(dict):
    """word -> id, remembered within a task; the unknown ones of a block are looked up together."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def of(self, words: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            if len(self) > TASK_WORDS:
                self.clear()
            new = list({words[k] for k in missing.tolist()})
            found = dict(zip(new, self.folder.ids(new).tolist(), strict=True))
            self.update(found)
            got[missing] = [found[words[k]] for k in missing.tolist()]
        return got


def reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def blocks(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each part, of its keys in order."""
    order = np.lexsort((keys, part))
    part, keys, counts = part[order], keys[order].astype(np.uint64), counts[order].astype(np.uint32)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, int)
    ends = [*first[1:], len(part)] if len(part) else []
    spans = list(zip(first, ends, strict=True))
    return pa.record_batch([pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], ["part", "keys", "counts"])


def opened(table: pa.Table, keys: str = "keys", counts: str = "counts", width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column(keys)] or [np.empty(0, np.uint64)])
    c = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column(counts)] or [np.empty(0, np.uint32)])
    return k, c.astype(np.int64) if width == 1 else c.reshape(-1, width).astype(np.int64)


def texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[bytes]]:
    for b in batches:
        for x in b.column(at):
            yield lower_words_of(x.as_py())


def count_words(train: DataFrame, folder: Folder) -> list:
    def count(batches):
        seen: Counter = Counter()

        def send():
            h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
            c = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return blocks(folder.range_of(h), h, c)

        for words in texts(batches, 0):
            seen.update(words)
            seen[END] += 1
            if len(seen) > TASK_WORDS:
                yield send()
        yield send()

    def merge(key, table):
        part = key[0].as_py()
        keys, counts = reduced(*opened(table))
        folder.write(f"vocab-{part}.keys", keys)
        folder.write(f"vocab-{part}.counts", counts.astype(np.uint32 if counts.max() < 2**32 else np.uint64))
        return pa.table({"part": pa.array([part], pa.int32()), "types": [len(keys)], "tokens": [int(counts.sum())], "wide": [bool(counts.max() >= 2**32)]})

    return train.mapInArrow(count, BLOCK).groupBy("part").applyInArrow(merge, "part int, types long, tokens long, wide boolean").collect()


def hot_words(spark: SparkSession, folder: Folder) -> np.ndarray:
    """Ids whose count is over a quarter of a shard's share of all tokens: at most four for each shard."""
    least = folder.total / (4 * folder.shards)

    def scan(batches):
        for b in batches:
            for r in b.column(0).to_pylist():
                at = np.flatnonzero(np.asarray(folder.read(f"vocab-{r}.counts", np.uint32)) > least) + folder.offsets[r]
                yield pa.record_batch([pa.array(at, pa.int64())], ["id"])

    rows = spark.range(0, folder.shards, 1, min(folder.shards, 64)).mapInArrow(scan, "id long").collect()
    return np.array(sorted(r["id"] for r in rows), np.uint64)


def count_pairs(train: DataFrame, folder: Folder) -> list:
    """Writes the pairs' arrays and the arrays by id; counts of counts of both."""

    def count(batches):
        ids = Ids(folder)
        held, size = [], 0

        def send():
            words = ids.of(held).astype(np.uint64)
            keys, c = np.unique(np.r_[end, words[:-1]] << np.uint64(32) | words, return_counts=True)
            held.clear()
            return blocks(folder.shard_of(keys), keys, c)

        end = ids.of([END]).astype(np.uint64)
        for words in texts(batches, 0):
            held += words
            held.append(END)  # which is the next text's first context, too
            if len(held) > TASK_PAIRS:
                yield send()
        if held:
            yield send()

    def merge(key, table):
        part = key[0].as_py()
        keys, counts = reduced(*opened(table))
        folder.write(f"pairs-{part}.keys", keys)
        folder.write(f"pairs-{part}.counts", counts.astype(np.uint32))
        context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        out = [pa.table({"kind": ["cc"], "part": pa.array([0], pa.int32()), "keys": pa.array([np.array([part], np.uint64).tobytes()], pa.binary()), "counts": pa.array([np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.uint64).tobytes()], pa.binary())})]
        words, n = np.unique(word, return_counts=True)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        follow = np.stack([np.add.reduceat(test.astype(np.int64), first) for test in (counts == 1, counts == 2, counts >= 3)], 1)
        for kind, ids, values in (("word", words, n), ("context", context[first], follow)):
            to = np.searchsorted(folder.offsets, ids, "right") - 1
            bounds = np.searchsorted(to, np.arange(folder.shards + 1))
            for r in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[r], bounds[r + 1])
                out.append(pa.table({"kind": [kind], "part": pa.array([r], pa.int32()), "keys": pa.array([ids[own].tobytes()], pa.binary()), "counts": pa.array([values[own].astype(np.uint32).tobytes()], pa.binary())}))
        return pa.concat_tables(out)

    def by_id(key, table):
        r, kinds = key[0].as_py(), table.column("kind").to_pylist()
        low, high = int(folder.offsets[r]), int(folder.offsets[r + 1])
        left, follow = np.zeros(high - low, np.int64), np.zeros((high - low, 3), np.int64)
        for kind, k, c in zip(kinds, table.column("keys"), table.column("counts"), strict=True):
            if kind == "cc":
                continue
            at = np.frombuffer(k.as_py(), np.uint64).astype(np.int64) - low
            if kind == "word":
                left[at] += np.frombuffer(c.as_py(), np.uint32)
            else:
                follow[at] += np.frombuffer(c.as_py(), np.uint32).reshape(-1, 3)
        folder.write(f"left-{r}", left.astype(np.uint32))
        folder.write(f"follow-{r}", follow.astype(np.uint32))
        shards = [int(np.frombuffer(k.as_py(), np.uint64)[0]) for kind, k in zip(kinds, table.column("keys"), strict=True) if kind == "cc"]
        pairs = np.sum([np.frombuffer(c.as_py(), np.uint64) for kind, c in zip(kinds, table.column("counts"), strict=True) if kind == "cc"] or [np.zeros(4)], axis=0)
        return pa.table({"shards": pa.array([shards], pa.list_(pa.int64())), "pairs": pa.array([[int(x) for x in pairs]], pa.list_(pa.int64())), "left": pa.array([[int((left == k).sum()) for k in (1, 2, 3, 4)] + [int((left > 4).sum()), int(left.sum())]], pa.list_(pa.int64()))})

    merged = train.mapInArrow(count, BLOCK).groupBy("part").applyInArrow(merge, "kind string, part int, keys binary, counts binary")
    return merged.groupBy("part").applyInArrow(by_id, "shards array<long>, pairs array<long>, left array<long>").collect()


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from how many keys have counts 1 to 4; where those are missing, what a middling corpus gives."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def trained(train: DataFrame) -> Folder:
    """The model of train(text). Null texts count as empty. Without rows, the model knows no word."""
    spark = train.sparkSession
    folder = Folder(mounted_folder(spark, "ngram"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = {r["part"]: r for r in count_words(train, folder)}
    if any(r["wide"] for r in parts.values()):
        raise ValueError("a word occurs over 2 ** 32 times: its counts need wider arrays")
    sizes = [parts[p]["types"] if p in parts else 0 for p in range(folder.shards)]
    folder.offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    folder.total = sum(r["tokens"] for r in parts.values())
    folder.hot, folder.ranges = np.empty(0, np.uint64), frozenset(parts)
    if folder.types >= 2**32:
        raise ValueError("a pair's key has 32 bits for each word: over 2 ** 32 words need wider keys")
    if folder.types:
        folder.hot = hot_words(spark, folder)
        rows = count_pairs(train, folder)
        folder.pairs = frozenset(p for r in rows for p in r["shards"])
        pairs, left = ([sum(x) for x in zip(*(r[k] for r in rows), strict=True)] for k in ("pairs", "left"))
        folder.discounts = {"pairs": discounts(pairs), "left": discounts(left), "distinct": left[5]}
        d = folder.discounts["left"]
        folder.discounts["rest"] = (d[0] * left[0] + d[1] * left[1] + d[2] * (left[2] + left[3] + left[4])) / left[5]
    return folder


def scored(docs: DataFrame, folder: Folder) -> DataFrame:
    """docs(doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def logs(words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the base and of the model, of tokens that follow each other; the first stands after an end."""
        types, total, d = folder.types, folder.total, folder.discounts
        distinct, at = np.unique(words, return_inverse=True)
        c = folder.by_id("vocab-{}.counts", np.uint32, distinct).astype(float) if types else np.zeros(len(distinct))
        base = np.log10((c + 0.1) / (total + 0.1 * (types + 1)))[at]
        if not types:
            return base, np.zeros(len(words))
        left = folder.by_id("left-{}", np.uint32, distinct).astype(np.int64)
        d1 = np.r_[0.0, d["left"]]
        one = (np.maximum(left - d1[np.minimum(left, 3)], 0) / d["distinct"] + d["rest"] / (types + 1))[at]
        follow = folder.by_id("follow-{}", np.uint32, distinct, 3)
        back = np.divide(follow @ np.array(d["pairs"]), c, out=np.ones(len(c)), where=c > 0)
        keys, pair_at = np.unique(np.r_[np.uint64(end), words[:-1].astype(np.uint64)] << np.uint64(32) | words.astype(np.uint64), return_inverse=True)
        shard = folder.shard_of(keys).astype(np.int64)
        place, there = folder.find(keys, shard, "pairs")
        n = np.zeros(len(keys), np.int64)
        for s in np.unique(shard[there]):
            own = there & (shard == s)
            n[own] = folder.read(f"pairs-{s}.counts", np.uint32)[place[own]]
        context = np.searchsorted(distinct, np.r_[end, words[:-1]])
        context = np.minimum(context, len(distinct) - 1)
        cc, bb = c[context], back[context]
        d2 = np.r_[0.0, d["pairs"]]
        top = np.maximum(n - d2[np.minimum(n, 3)], 0)[pair_at]
        two = np.where(cc > 0, top / np.maximum(cc, 1) + bb * one, one)
        return base, np.log10(two)

    def run(batches):
        ids = Ids(folder) if folder.types else None
        end = int(ids.of([END])[0]) if ids is not None else 0
        for b in batches:
            lists = [lower_words_of(x.as_py()) for x in b.column(1)]
            at, out = 0, [[], [], [], []]
            while at < len(lists):
                stop, size = at, 0
                while stop < len(lists) and (stop == at or size < 1_000_000):
                    size += len(lists[stop]) + 1
                    stop += 1
                flat: list[bytes] = []
                for k in range(at, stop):
                    flat += lists[k]
                    flat.append(END)
                    lists[k], n = None, len(lists[k]) + 1
                    out[0].append(n)
                words = ids.of(flat) if ids is not None else np.zeros(len(flat), np.int64)
                known = words < folder.types
                base, two = logs(words, end)
                first = np.r_[0, np.cumsum(out[0][at:stop])[:-1]].astype(np.int64)
                for o, v in zip(out[1:], (known.astype(np.int64), base, two), strict=True):
                    o.extend(np.add.reduceat(v, first).tolist())
                at = stop
            n, known, base, two = out
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([folder.total] * b.num_rows, pa.int64()), pa.array(base, pa.float64()), pa.array(two, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexities(docs: DataFrame) -> DataFrame:
    """Scores of every row of docs(doc_id, text, ...) by a model of those whose crc32(doc_id as text) mod 10 is not 0.

    A null text counts as empty: one token, the end. Rows that repeat are trained on and scored as often. A row
    without doc_id is not trained on, and its held_out is true. If nothing is trained on, a token's base score is
    log10(0.1 / 0.1) = 0, as is its score.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(True)))
    return scored(docs, trained(docs.filter("not held_out").select("text")))


def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table."""
    return perplexities(documents(spark, sf_dir, "doc_id", "text"))
