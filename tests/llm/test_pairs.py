"""Near duplicates and repeated strings against brute force, with edge cases."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pagetide.llm import neardup, repeats

DOCS = "doc_id long, text string, set_key string, node string, tid string, size int, bucket int"


def frame(spark, rows):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, None) for i, t in rows], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, "é" * 5000), (8, " ".join(words(rng, 20000)))]
    base = words(rng, 150)
    for k in range(150):  # one group of copies with 0 to 40 % of edits: many near the threshold
        w = list(base)
        for p in rng.sample(range(150), rng.randrange(0, 12)):
            w[p] = f"e{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    for k in range(40):
        rows.append((400 + k, " ".join(words(rng, rng.randrange(1, 60)))))
        if k % 4 == 0:
            rows.append((500 + k, rows[-1][1]))
    rows += [(400, rows[20][1]), (None, rows[20][1]), (600, rows[20][1]), (600, rows[20][1])]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_many_texts_around_the_threshold(spark):
    """One text with three words replaced at random places by one of five words: each shares much with all others. Rounds of
    labels stay small plans."""
    rng = random.Random(3)
    base, rows = words(rng, 150), []
    for k in range(500):
        w = list(base)
        for p in rng.sample(range(150), 3):
            w[p] = f"e{rng.randrange(5)}"
        rows.append((k, " ".join(w)))
    began = time.time()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert time.time() - began < 120
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_copies_that_link_with_nothing_but_their_original(spark):
    """Copies of one text with edits of their own: two of them differ too much, but all link with the original."""
    rng = random.Random(5)
    base = words(rng, 150)
    rows = [(500, " ".join(base))]
    for k in range(400):
        w = list(base)
        for p in rng.sample(range(150), 3):
            w[p] = f"own{k}.{p}"
        rows.append((k, " ".join(w)))
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_exact_round_in_blocks(spark, monkeypatch):
    """Clusters cut into several blocks give the same components."""
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    monkeypatch.setattr(neardup, "TILE", 7)
    rows = corpus()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert repeats.repeated_spans(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 100, 5000])
def test_sketches_fill_and_estimate(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**63, n).astype(np.uint64)
    s = neardup.sketch(x)
    assert (s != neardup.FULL).all() and (s == neardup.sketch(x[::-1].copy())).all()
    half = np.concatenate([x[: n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)])
    if n >= 100:
        assert abs((s == neardup.sketch(half)).mean() - 1 / 3) < 0.17


def repeated(rows, length=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(3)
    p = "".join(rng.choice("abcdé ") for _ in range(900))
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 400), (5, "a" * 401), (6, "b" * 900), (7, "ab" * 700), (8, p), (9, "x" + p[100:520] + "y"), (10, "q" * 50 + p[300:690])]
    rows += [(11, p), (11, p), (None, "zz" + p[:450]), (12, p[:450] + p[500:]), (13, "xyz\n" * 120), (14, "0" * 3 + p[450:850]), (15, "1" * 3 + p[450:849] + "z")]
    long = "".join(rng.choice("etaoin shrdlu") for _ in range(30000))
    rows += [(20, long), (21, long[1000:1800] + "#" * 30 + long[1799:2600]), (22, "-" + long[5000:5399] + "+"), (23, "-" + long[7000:7400] + "+")]
    for k in range(40):
        cut = rng.randrange(20000)
        rows.append((30 + k, "".join(rng.choice("etaoin ") for _ in range(rng.randrange(300))) + long[cut : cut + rng.randrange(350, 900)] + str(k) * 20))
    return rows


def test_repeated_strings_equal_brute_force(spark):
    rows = passages()
    got = sorted((tuple(r) for r in repeats.repeated_spans(frame(spark, rows)).collect()), key=str)
    assert got == repeated(rows)


def test_kept_text(spark):
    rows = [(1, "start " + "x1 y2 z3 " * 60 + "end"), (2, "other " + "x1 y2 z3 " * 60 + "tail")]
    got = {r["doc_id"]: r for r in repeats.repeated_spans(frame(spark, rows), with_text=True, carry=("size",)).collect()}
    assert (got[1]["kept_text"], got[2]["kept_text"], got[1]["size"]) == ("startend", "othertail", 1)


def test_repeated_strings_of_other_lengths_equal_brute_force(spark):
    rows = passages()
    got = sorted((tuple(r) for r in repeats.repeated_spans(frame(spark, rows), unit=repeats.Unit(101, 32)).collect()), key=str)
    assert got == repeated(rows, 101)


def repeated_words(rows, length):
    """Bytes of each text that a run of so many words covers which also starts anywhere else, copies whole."""
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for _, t in rows]
    words_ = [[(t or "").encode()[a:b] for a, b in spans] for (_, t), spans in zip(rows, split, strict=True)]
    seen = Counter(tuple(w[p : p + length]) for w in words_ for p in range(len(w) - length + 1))
    copies = Counter(t for _, t in rows)
    out = []
    for (i, t), spans, w in zip(rows, split, words_, strict=True):
        raw = (t or "").encode()
        gone, at = bytearray(len(w)), []
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        for k, g in enumerate(gone):
            if g and k and gone[k - 1]:
                at[-1][1] = spans[k][1]
            elif g:
                at.append([*spans[k]])
        if len(w) >= length and copies[t] > 1:
            at = [[0, len(raw)]]
        left = bytes(x for k, x in enumerate(raw) if not any(a <= k < b for a, b in at))
        out.append((i, len(raw), sum(b - a for a, b in at), len(at), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_words_have_hashes_of_their_own_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 16)  # words of many bytes, and many words, in more pieces than one
    rng = random.Random(4)
    some = [b"a", b"aa", b"ab", b"ba", b"b", "é".encode(), b"x" * 40, b"x" * 41, b"\x1c", b"\x00", b"\x00\x00"]
    words = [rng.choice(some) for _ in range(300)]
    gaps = [rng.choice([b" ", b"\t\n", b"\x0b \x0c\r"]) for _ in words]
    for head, tail in ((b"", b""), (b" ", b"\n")):
        text = np.frombuffer(head + b"".join(w + g for w, g in zip(words, gaps, strict=True)).rstrip() + tail, np.uint8)
        got = repeats.word_hashes(text)
        assert len(got) == 300 and len(set(zip(words, got.tolist(), strict=True))) == len(set(got.tolist())) == len(set(words))
    assert [len(repeats.word_hashes(np.frombuffer(t, np.uint8))) for t in (b"", b" \n", b"a")] == [0, 0, 1]


def test_repeated_words_equal_brute_force(spark):
    rows = passages()
    for size in (40, 51, 60, 3000):
        rows.append((100 + size, "\t ".join(f"w{k}" for k in range(size)) + " "))
        rows.append((200 + size, f"own{size} \n" + " ".join(f"w{k}" for k in range(7, size))))
    rows += [(300, "same " * 50), (301, "same " * 51), (302, " same" * 60), (303, "x " * 200), (304, "x " * 200)]
    got = sorted((tuple(r) for r in repeats.repeated_spans(frame(spark, rows), unit=repeats.PASSAGES).collect()), key=str)
    assert got == repeated_words(rows, 51)
    both = repeats.repeated_spans(frame(spark, rows), passages=repeats.PASSAGES).collect()
    assert sorted((tuple(r)[:5] for r in both), key=str) == repeated(rows)
    assert sorted(((r["doc_id"], r["n_passage_bytes"], r["n_passages"]) for r in both), key=str) == sorted(((i, g, s) for i, _, g, s, _ in repeated_words(rows, 51)), key=str)
