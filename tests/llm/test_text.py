"""Tokens, packing, the n-gram model, languages, quality and personal data."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from pagetide.llm import bpe, langid, ngram, packing, pii, quality

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n", "Hello, World! it's 1234 don't", "ΑΣ ΟΔΟΣ İx é é \x1c x", "a<|endoftext|>B <|startoftext|>", "日本語 テキスト 😀", "aaaa" * 3000, "x" * 20000, "tab\tvt\x0bff\x0c"]


def frame(spark, rows):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", "x", 1.5, True) for i, t in rows], "doc_id long, text string, lang string, source string, chunk string, score double, held_out boolean")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(bpe.tokenizer_path())


@given(st.one_of(st.text("abehinrst", max_size=30), st.text(st.characters(max_codepoint=0x24FF, categories=("L", "N", "P", "S", "Z")), max_size=30), st.text("mab!1 '", max_size=30)))
@settings(max_examples=400, deadline=None)
def test_automaton_equals_the_library(text):
    from tokenizers import Tokenizer

    lib = test_automaton_equals_the_library.__dict__.setdefault("lib", None) or Tokenizer.from_file(bpe.tokenizer_path())
    own = test_automaton_equals_the_library.__dict__.setdefault("own", None) or bpe.Automaton(bpe.tokenizer_path())
    test_automaton_equals_the_library.lib, test_automaton_equals_the_library.own = lib, own
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_words_that_go_together_take_the_paths_of_each_alone(automaton):
    rng = random.Random(9)
    some = ["".join(rng.choice("abehinrstéß'1") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["x" * 200, "日本語", "é" * 40]
    assert [x.tolist() for x in bpe.cut(*automaton.encode_words(some))] == [automaton.encode_word(w) for w in some]
    assert [x.tolist() for x in automaton.encode_words([])] == [[], []]


def test_runs_are_remembered_in_two_generations(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_RUNS", 20)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_ARCS", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 60)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of.", f"w{rng.randrange(40)}", "in<|endoftext|>the", "ΑΣ"]) for _ in range(12)) for _ in range(60)] + [None, ""]
    runs = bpe.Runs(automaton, lambda ids, ends: bpe.cut(ids.tolist(), ends), lambda parts: [i for p in parts for i in p])
    assert [[i for v in values for i in v] for values in runs.blocks(pa.array(texts, pa.string()))] == [automaton.encode(t) for t in texts]


@pytest.mark.parametrize("limits", [(20, 60), (300_000, 4_000_000)])
def test_ids_of_whole_texts_in_blocks(automaton, library, monkeypatch, limits):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", limits[0])
    monkeypatch.setattr(bpe, "BLOCK_BYTES", limits[1])
    rng = random.Random(7)
    some = ["the", "The.", "of,.", ".", "...", ";", "\u037e", "a\u037e", "don't", "'s,", "12.", "in<|endoftext|>the", "<|startoftext|>", "<|", "a<|b.", "ΑΣ", "ΑΣ.", "e\u0301.", "\u0301", "İx", "日本.", "x\x1cy", "x\x85y", "x\xa0y", "w" * 90]
    texts = [rng.choice(["", " ", "\n\n"]) + rng.choice([" ", "\t ", "\x0b", "\r\n"]).join(rng.choice([*some, f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30))) + rng.choice(["", "  ", "\x0c"]) for _ in range(120)]
    for these in (texts + TEXTS, [], [None, "", None], [" "]):
        known = bpe.TextIds(automaton)
        got = [x.tolist() for x in known.blocks(pa.array(these, pa.string()))]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in these]
        assert len(known.start) == len(known.uses) == len(known.letters) + len(known.others) <= limits[0] + 60  # and the words of a block
    again = known.blocks(pa.array([None, *texts], pa.string()).slice(1))
    assert [x.tolist() for x in again] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_lets_go_of_what_other_operators_keep(monkeypatch, automaton):
    calls = []
    monkeypatch.setattr(bpe, "Automaton", lambda path: automaton)
    monkeypatch.setattr(bpe, "trim", lambda: calls.append("trim"))
    monkeypatch.setattr(bpe.TextIds, "kept", {})
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 10)
    bpe.Runs.kept["left", "over"] = None
    known = bpe.TextIds.of(bpe.tokenizer_path())
    assert ("left", "over") not in bpe.Runs.kept and bpe.TextIds.of(bpe.tokenizer_path()) is known
    assert len(list(known.blocks(pa.array(["some words"] * 3)))) == len(calls) == 3  # memory goes back after each block


def test_memory_of_a_block_does_not_follow_its_runs(automaton, library):
    texts = [" ".join(random.Random(k).choices(["some", "words", "again.", "it's"], k=20_000)) for k in range(40)]
    known = bpe.TextIds(automaton)
    tracemalloc.start()
    try:
        sizes = [len(x) for x in known.blocks(pa.array(texts))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert peak < 35_000_000  # 54 MB when the ids of all of a block's runs were taken at once


def test_words_are_encoded_in_slices(automaton, monkeypatch):
    words = [f"w{'abcdefghij'[k % 10] * (k % 80)}{k}" for k in range(300)]
    flat, ends = automaton.encode_words(words)
    assert flat.tolist() == [i for w in words for i in automaton.encode_word(w)]
    monkeypatch.setattr(bpe, "SLICE_WORDS", 7)
    again = automaton.encode_words(words)
    assert (flat.tolist(), ends.tolist()) == tuple(x.tolist() for x in again)


def test_packing_starts_no_workers_for_its_places(spark, monkeypatch):
    made, create = [], type(spark).createDataFrame
    docs = frame(spark, [*enumerate(TEXTS)])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: made.append(create(*a, **k)) or made[-1])
    assert packing.packed(docs, bpe.tokenizer_path()).count() >= len(TEXTS)
    assert made and not any("PythonRDD" in df._jdf.rdd().toDebugString() for df in made)


def test_encoding_and_decoding(spark, library, automaton):
    rows = [*enumerate(TEXTS), (0, "again"), (None, "no id")]
    got = [tuple(r) for r in bpe.encoded(frame(spark, rows), bpe.tokenizer_path()).collect()]
    for (i, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r[0], None))), strict=False):
        assert len(r) == 4
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) in by[i]
    assert bpe.encoded(frame(spark, []), bpe.tokenizer_path()).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
@settings(max_examples=200, deadline=None)
def test_patterns_hold_every_piece_once(counts):
    slots = packing.slots_of(packing.pack_histogram(counts, 64))
    by, used = defaultdict(list), defaultdict(list)
    for size, lo, hi, base, at, times in slots:
        by[size].append((lo, hi))
        for n in range(hi - lo):
            used[base + n // times].append((at + n % times * size, size))
    for size, n in counts.items():
        spans = sorted(by[size])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for places in used.values():
        end = 0
        for at, size in sorted(places):
            assert at == end
            end += size
        assert end <= 64
    assert sorted(used) == list(range(len(used)))


def test_shortest_pack_takes_the_next_piece():
    assert sorted(packing.pack_histogram({40: 1, 34: 1, 20: 1}, 64)) == [(1, [(34, 1), (20, 1)]), (1, [(40, 1)])]
    assert sorted(packing.pack_histogram({40: 2, 10: 3}, 64)) == [(1, [(40, 1), (10, 1)]), (1, [(40, 1), (10, 2)])]


def test_packing_is_gapless_and_tight(spark, library):
    rows = [*enumerate(TEXTS), (0, "again"), (None, "no id"), (50, "many words here " * 3000)]
    got = [r.asDict() for r in packing.packed(frame(spark, rows), bpe.tokenizer_path()).collect()]
    tokens = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == tokens
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 2048
    assert len(by) == -(-tokens // 2048)
    ids = library.encode("many words here " * 3000, add_special_tokens=False).ids + [1]
    for r in got:
        if r["doc_id"] == 50:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
    assert packing.packed(frame(spark, []), bpe.tokenizer_path()).collect() == []


def brute_kneser_ney(rows):
    docs = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c, p = Counter(), Counter()
    for i, w in docs:
        if not held(i):
            c.update(w)
            p.update(zip([b"\n", *w[:-1]], w, strict=True))
    total, types, left = sum(c.values()), len(c), Counter(w for _, w in p)
    follow = defaultdict(lambda: [0, 0, 0])
    for (u, _), k in p.items():
        follow[u][min(k, 3) - 1] += 1
    count = lambda v: ngram.discounts([sum(x == k for x in v) for k in (1, 2, 3, 4)])
    d2, d1 = count(p.values()), count(left.values())
    rest = sum(d1[min(k, 3) - 1] for k in left.values()) / len(p)
    one = lambda w: max(left[w] - d1[min(left[w], 3) - 1], 0) / len(p) * (left[w] > 0) + rest / (types + 1)

    def two(u, w):
        if not c[u]:
            return one(w)
        k = p[u, w]
        return (max(k - d2[min(k, 3) - 1], 0) * (k > 0) + sum(a * b for a, b in zip(follow[u], d2, strict=True)) * one(w)) / c[u]

    out = []
    for i, w in docs:
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), total, base, sum(math.log10(two(u, x)) for u, x in zip([b"\n", *w[:-1]], w, strict=True))))
    return out, two, c


def test_kneser_ney_equals_brute_force_and_sums_to_one(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "of", f"w{rng.randrange(50)}", f"x{rng.randrange(900)}"]) for _ in range(rng.randrange(40)))) for k in range(150)]
    rows += [(None, "the of"), (3, "the end"), (7, "the end"), (200, None), (201, ""), (202, "the " * 20000)]
    expected, two, c = brute_kneser_ney(rows)
    got = sorted(map(tuple, ngram.perplexities(frame(spark, rows)).collect()), key=str)
    for a, b in zip(got, sorted(expected, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for u in (b"the", b"w1", b"\n"):
        assert sum(two(u, w) for w in c) + two(u, b"never") == pytest.approx(1)
    assert ngram.perplexities(frame(spark, [])).collect() == []
    nothing = ngram.perplexities(frame(spark, [(None, "a b")])).collect()[0]
    assert (nothing["n_tokens"], nothing["n_known"], nothing["train_tokens"], nothing["score"]) == (3, 0, 0, 0.0)


def test_a_model_file_that_is_not_seen_is_an_error(spark):
    rows = [(k, f"the w{k} of") for k in range(30)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "false as held_out")
    for kind in ("vocab", "pairs"):
        folder = ngram.trained(docs.select("text"))
        gone = next(f for f in sorted(os.listdir(folder.path)) if f.startswith(kind) and f.endswith(".keys") and os.path.getsize(f"{folder.path}/{f}"))
        os.remove(f"{folder.path}/{gone}")
        with pytest.raises(PythonException, match="No such file"):
            ngram.scored(docs, folder).collect()


def test_kernel_equals_brute_force():
    texts = ["The cat, and the dog!", "Der Hund und die Katze", "the the the", "été", "a", "und " * 3000]
    model = langid.Model.fit(texts[:4], ["en", "de", "en", "fr"], n_landmarks=4)

    def sets(text):
        clean = " " + re.sub(r"[^a-zé]+", " ", text.lower()).strip() + " "
        return {clean[k : k + n] for n in (1, 2, 3, 4) for k in range(len(clean) - n + 1)}

    marks = [texts[k] for k in (1, 0, 3, 2)]  # in turn from de, en, fr
    want = [[len(sets(x) & sets(y)) / math.sqrt(len(sets(x)) * len(sets(y))) for y in marks] for x in texts]
    assert model.kernels([langid.grams(t) for t in texts]) == pytest.approx(np.array(want), abs=1e-6)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(docs).filter("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(k, ["the cat and the dog", "der hund und die katze"][k % 2]) for k in range(40)]
    df = frame(spark, rows).drop("lang", "score").selectExpr("*", "if(doc_id % 2 = 0, 'en', 'de') as lang", "'x' as lang_pred")
    model = langid.Model.fit(*langid.sample_of(df))
    odd = frame(spark, [(1, None), (2, ""), (3, "123 ..."), (4, "und die"), (None, "and the"), (5, "und " * 30000)])
    got = [(r["lang_pred"], r["score"]) for r in langid.identified(odd, model).collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "de", "en", "de"] and got[0][1] == 0
    assert {r["lang_pred"] for r in langid.identified(frame(spark, [(1, "x y")]).withColumnRenamed("lang", "l").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}
    assert langid.identified(frame(spark, [])).collect() == []


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["é", "b#", "c", "d\n", "\x0bx", " y"]) for _ in range(rng.randrange(120)))) for k in range(80)] + [*enumerate(TEXTS, 100), (None, "a"), (1, "b")]
    got = quality.judged(frame(spark, rows)).collect()
    expected = Counter((i, *brute_quality(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == expected
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.judged(frame(spark, [])).collect() == []


def test_quality_thresholds_drop_junk_and_keep_prose(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    rows = [(k, " ".join(word() + ("###" if k % 10 == 0 else "") for _ in range(120))) for k in range(400)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(frame(spark, rows)).collect()}
    assert all(v == (k % 10 != 0) for k, v in kept.items())


def brute_kept(rows):
    """Verdicts by exact quantiles of each group; sketches are 1 % off, so those near a fence may differ."""
    docs = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, again = brute_quality(t)
        lines = len([x for x in (t or "").split("\n") if x.strip()])
        docs.append((i, lang, source, n < 50 or 100 * again > 50 * n, [(symbols, n), (dup, lines), (again, n), (chars, n)]))
    good = [d for d in docs if not d[3]]
    out = {}
    for i, lang, source, failed, counts in docs:
        pool = [d for d in good if d[1:3] == (lang, source)]
        if len(pool) < quality.ENOUGH:
            pool = [d for d in good if d[1] == lang]
        if len(pool) < quality.ENOUGH:
            pool = good
        ok, near = True, False
        for k, (c, n) in enumerate(counts):
            if failed:
                break
            v = sorted((d[4][k][0] + 0.5) / (d[4][k][1] + 1) for d in pool)
            low, mid, high = (v[max(0, math.ceil(p * len(v) - 1e-9) - 1)] for p in (1 - quality.TAIL, 0.5, quality.TAIL))
            for fence, sign in ((high + quality.REACH * (high - mid), 1), (max(0, low - quality.REACH * (mid - low)) if k == 3 else 0, -1)):
                room = fence * n + sign * quality.ERRORS * math.sqrt(fence * n) - c
                ok &= sign * room >= 0
                near |= fence > 0 and abs(room) <= 0.1 * max(fence * n, c)  # no count is below a fence of 0
        out[i] = (ok and not failed, near)
    return out


def test_quality_verdicts_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("etaoinshrdlu") for _ in range(k))
    rows = []
    for k in range(900):
        lang, source = ("en", "a") if k < 300 else ("en", f"s{k % 3}") if k < 560 else ("de", "b") if k < 840 else ("fr", None)
        size = rng.randrange(60, 200)
        ws = [word(rng.randrange(2, 9) + (k % 17 == 0) * 9) + ("#" * rng.randrange(1, 4) if k % 13 == 0 or (source == "b" and rng.random() < 0.1) else "") for _ in range(size)]
        if k % 19 == 0:
            ws += ["same odd line\n"] * rng.randrange(2, 30)
        rows.append((k, " ".join(ws), lang, source))
    rows += [(1000, None, "en", "a"), (1001, "", None, None), (1002, "one " * 10, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(df).collect()}
    want = brute_kept(rows)
    sure = [i for i, (_, near) in want.items() if not near]
    assert len(sure) > 800 and 20 < sum(not want[i][0] for i in sure) < 400
    assert [i for i in sure if got[i] != want[i][0]] == []


def test_quality_fences_are_never_zero(spark):
    """No symbol, repeated line or repeated word in any text: fences come from the texts' sizes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 9)))
    rows = [(k, "\n".join(" ".join(word() for _ in range(9)) for _ in range(rng.randrange(6, 60)))) for k in range(300)]
    got = quality.fences(quality.sketches(quality.measured(frame(spark, rows))), "lang", "source").collect()
    assert [g["total"] for g in got] == [300] and all(0 < got[0][f"{k}_high"] < 1 for k in ("symbols", "dup_lines", "repeats"))


def test_sketches_merge(spark):
    df = quality.measured(frame(spark, [(k, "a b c " * (k % 9 + 1)) for k in range(90)]))
    whole, a, b = quality.sketches(df), quality.sketches(df.filter("doc_id < 30")), quality.sketches(df.filter("doc_id >= 30"))
    assert quality.merged(a.unionByName(b), "lang", "source").exceptAll(quality.merged(whole, "lang", "source")).isEmpty()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x * 2 - 9 if x * 2 > 9 else x * 2) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_personal(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or (k == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (k == "card" and 16 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 8 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["a.b", "@", "c-d", ".com", " ", "1.2.3.4", "256", ".", "4111 1111-1111 1111", "+1 (132) 555-1352", "+", "7", "-", "é", "😀", "(", "0"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(300)]
    rows += [(1000, None), (1001, "a." * 5000 + "@x.y"), (1002, "1" * 20000), (1003, "4 " * 9000), (1004, "+" * 3000 + "1 2 3"), (None, "q@w.e"), (5, "q@w.e")]
    got = Counter((r["doc_id"], tuple((x["kind"], x["start"], x["end"]) for x in r["base"])) for r in pii.personal_spans(frame(spark, rows)).collect())
    assert got == Counter((i, tuple(brute_personal(t))) for i, t in rows)
    assert pii.personal_spans(frame(spark, [])).collect() == []


def test_added_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in pii.personal_spans(docs, carry=("text",)).filter("size(spans) > size(base)").collect():
        base = {tuple(x) for x in r["base"]}
        assert base <= {tuple(x) for x in r["spans"]}
        for x in r["spans"]:
            if tuple(x) not in base:
                assert all(x["end"] <= b[1] or b[2] <= x["start"] for b in base)
                assert x["kind"] != "secret" or re.fullmatch("[0-9a-f]{32,}", r["text"][x["start"] : x["end"]])


def test_dense_texts_take_seconds(spark):
    texts = ["12," * 300000, "a@b.com é " * 5000, "+1 234 567 890;" * 5000, "1.2.3.4 " * 5000]
    rows = list(enumerate(texts))
    began = time.time()
    got = pii.personal_spans(frame(spark, rows), carry=("text",)).withColumn("masked", F.expr(pii.masked())).collect()
    assert time.time() - began < 120
    for r in got:
        assert [tuple(x) for x in r["base"]] == brute_personal(texts[r["doc_id"]])
        want = texts[r["doc_id"]].replace("a@b.com", "[EMAIL]").replace("+1 234 567 890", "[PHONE]").replace("1.2.3.4", "[IP]")
        assert r["masked"] == want


def test_spans_that_overlap_are_masked_once(spark):
    df = spark.sql("select 'abcdefghij' as text, array(named_struct('kind', 'ip', 'start', 2, 'end', 5), named_struct('kind', 'card', 'start', 4, 'end', 7), named_struct('kind', 'email', 'start', 6, 'end', 8), named_struct('kind', 'phone', 'start', 8, 'end', 10)) as spans union all select null, array()")
    assert {r[0] for r in df.select(F.expr(pii.masked())).collect()} == {"ab[IP][PHONE]", None}


def test_reliabilities_tell_good_labelers_from_bad():
    rng = random.Random(6)
    patterns, truth = Counter(), Counter()
    for _ in range(5000):
        y = rng.random() < 0.4
        vote = lambda good: (1 if y else -1) if rng.random() < good else (-1 if y else 1)
        p = (vote(0.95), vote(0.9), vote(0.9), rng.choice((-1, 0, 1)))
        patterns[p] += 1
        truth[p] += y
    post = pii.reliabilities(patterns)
    assert sum((post[p] > 0.5) * truth[p] + (post[p] <= 0.5) * (n - truth[p]) for p, n in patterns.items()) / 5000 > 0.93
