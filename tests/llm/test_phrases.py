"""Collocations against SQL on tables and against plain counting on small texts."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest

from pagetide.llm import phrases

SCHEMA = "doc_id long, text string, lang string, word string, n long"


def brute(rows, least):
    """Phrases, scores and totals in plain Python."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {k: v for k, v in f.items() if v >= least}
    inside = {(lang, p[i : i + k], v) for (lang, p), v in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)}
    out = set()
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p, a) not in inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.add((lang, " ".join(p), len(p), a, left, right, n[lang], score))
    return out


def texts(seed, count):
    rng = random.Random(seed)
    stock = ["new york city", "a b c d e f", "the", "The", "of", "x", "É é", "in the end", "b b b b b b", "\0 q"]
    for i in range(count):
        parts = [rng.choice(stock) for _ in range(rng.randrange(0, 40))]
        yield "".join(p + rng.choice([" ", "  ", "\t", ". ", "\n", ",", " ", " "]) for p in parts), rng.choice(["en", "en", "de", None])


@pytest.mark.parametrize("least", [2, 20])
def test_equals_plain_counting(spark, least, monkeypatch):
    rows = [*texts(1, 300), (None, "en"), ("", None), ("...", "fr"), ("one two", "fr"), ("one two", "fr")]
    df = spark.createDataFrame([(i, t, lang, "clash", 7) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in phrases.collocations(df, least).collect()} == brute(rows, least)


def test_small_blocks_slices_and_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_ARCS", 3)
    monkeypatch.setattr(phrases.grouped, "__defaults__", (2,))
    rows = list(texts(2, 80))
    df = spark.createDataFrame([(i, t, lang, "", 0) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert {tuple(r) for r in phrases.collocations(df, 3).collect()} == brute(rows, 3)


def test_empty_tables_and_shorter_phrases(spark):
    df = spark.createDataFrame([(1, "a b c a b d " * 9, "en", "", 0)], SCHEMA)
    assert phrases.collocations(df.limit(0), 2).collect() == []
    assert phrases.collocations(df, 50).collect() == []
    assert {r["words"] for r in phrases.collocations(df, 2, 3).collect()} == {2, 3}


def test_double_array_finds_what_was_put_in():
    rng = np.random.default_rng(5)
    arcs = {(int(p), int(w)) for p, w in zip(rng.zipf(1.3, 20000) % 3000 + 5, rng.zipf(1.2, 20000) % 5000 + 1, strict=True)}
    parent, word = np.array(sorted(arcs), np.int64).T
    s = phrases.Slice(parent, word, np.arange(1, len(parent) + 1))
    assert np.array_equal(s.step(parent, word), np.arange(1, len(parent) + 1))
    p, w = rng.integers(parent[0], parent[-1] + 1, 50000), rng.integers(1, 6000, 50000)
    known = {a: k for k, a in enumerate(zip(parent.tolist(), word.tolist(), strict=True), 1)}
    assert s.step(p, w).tolist() == [known.get(a, 0) for a in zip(p.tolist(), w.tolist(), strict=True)]


def test_states_with_many_arcs_take_little_memory():
    """Random words of a common word's state find no place beside those of another; the search took memory for places times words."""
    rng = np.random.default_rng(6)
    sizes = [*[4000] * 8, *[20] * 300, 1]
    parent = np.repeat(np.arange(3, 3 + len(sizes)), sizes)
    word = np.concatenate([np.sort(rng.choice(40000, n, replace=False)) + 1 for n in sizes])
    tracemalloc.start()
    s = phrases.Slice(parent, word, np.arange(1, len(parent) + 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert np.array_equal(s.step(parent, word), np.arange(1, len(parent) + 1))
    known = {a: k for k, a in enumerate(zip(parent.tolist(), word.tolist(), strict=True), 1)}
    p, w = rng.integers(parent[0], parent[-1] + 1, 50000), rng.integers(1, 50000, 50000)
    assert s.step(p, w).tolist() == [known.get(a, 0) for a in zip(p.tolist(), w.tolist(), strict=True)]


def test_the_driver_compiles_no_slice(spark, monkeypatch):
    monkeypatch.setattr(phrases.Slice, "__init__", None)  # in the driver; workers have their own
    rows = list(texts(4, 60))
    df = spark.createDataFrame([(i, t, lang, "", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in phrases.collocations(df, 3).collect()} == brute(rows, 3)


def test_squeezing_keeps_phrases_apart():
    words, state = np.array([1, 2, 0, 3, 4, 5, 6, 0, 7], np.int32), np.array([9, 0, 0, 0, 8, 0, 0, 0, 0], np.int32)
    assert [x.tolist() for x in phrases.squeezed(words, state, 2)] == [[1, 2, 0, 4, 5, 0], [9, 0, 0, 8, 0, 0]]
    assert [len(x) for x in phrases.squeezed(words, np.zeros(9, np.int32), 2)] == [0, 0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    want = duck.execute(phrases.OP12_SQL).fetchall()
    assert sorted(tuple(r) for r in phrases.op12_collocations(spark, f"/root/testdata/{sf}").collect()) == sorted(want)
