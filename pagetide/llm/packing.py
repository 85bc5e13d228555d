"""Packing by shortest-pack-first over the length histogram.

Documents become pieces: full sequences as often as they fill one, and a rest. Only the histogram of piece
lengths comes to the driver, one row for each length up to the sequence length. There lengths are placed longest
first, each into the shortest packs (with the most room) if it fits there, else into new packs; what is kept are
patterns (which lengths lie in a sequence, and where) with counts. Pieces then find their pattern by length and
by rank among the pieces of their length. Ranks come from counts by (length, chunk), so no length is ordered
in one task.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextIds, tokenizer_path
from .common import documents, stored

LENGTH, END_ID = 2048, 1


def pieces_of(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and end_id, cut after every `length`."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TextIds.of(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, values in zip(b.column(0).to_pylist(), known.blocks(b.column(1)), strict=True):
                ids = values.astype("<u4").tobytes() + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    piece = ids[4 * at : 4 * (at + length)]
                    for c, v in zip(cols, (doc_id, at, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(piece length, pieces of it in each), ...]) that hold every piece of the histogram."""
    rooms: list[int] = []  # the different rooms left, in order
    packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, count: int, pattern: list[tuple[int, int]]) -> None:
        if not count:
            return
        if room:
            if not packs[room]:
                bisect.insort(rooms, room)
            packs[room].append((count, pattern))
        else:
            done.append((count, pattern))

    def add(pattern: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        last, times = pattern[-1]
        return [*pattern[:-1], (size, times + 1)] if last == size else [*pattern, (size, 1)]

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n and rooms and rooms[-1] >= size:
            room = rooms[-1]
            count, pattern = packs[room].pop()
            if not packs[room]:
                rooms.pop()
            take = min(n, count)
            put(room - size, take, add(pattern, size))
            put(room, count - take, pattern)
            n -= take
        fit = length // size
        put(length - fit * size, n // fit, [(size, fit)])
        if n % fit:
            put(length - n % fit * size, 1, [(size, n % fit)])
    return done + [p for room in rooms for p in packs[room]]


def slots_of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(piece length, first rank, end rank, first sequence, offset, pieces of it in each) of every place in a pattern."""
    out, taken, sequence = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for size, times in pattern:
            out.append((size, taken[size], taken[size] + count * times, sequence, offset, times))
            taken[size] += count * times
            offset += size * times
        sequence += count
    return out


def packed(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs(doc_id, text, ...).

    Every document has at least its end id; a null text counts as empty. Rows that repeat, and rows without
    doc_id, are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunk = F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int")
    pieces = stored(pieces_of(docs, path, length, end_id)).withColumn("chunk", chunk)
    by_chunk = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    # at most `length` rows come here
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(pack_histogram(counts, length))
    # as an Arrow table: rows of Python objects would start workers of their own on the executors
    names, columns = ["length", "lo", "hi", "base", "at", "times"], np.array(slots, np.int64).reshape(-1, 6).T
    table = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("k", F.row_number().over(own) - 1).join(first, ["length", "chunk"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("rank"))
    # the table has a few places for each length, whatever the number of documents
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1)).drop(table["length"])
    nth = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("at") + nth % F.col("times") * F.col("length")).alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the whole documents table and their places."""
    return packed(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
