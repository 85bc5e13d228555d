"""Every stage on its own input, by what its operator says of it."""

import hashlib
import struct
import zlib
from collections import defaultdict

from test_pairs import components, repeated_words
from tokenizers import Tokenizer

import corpus_pipeline as c
from pagetide.llm.langid import identified
from pagetide.llm.neardup import near_duplicates
from pagetide.llm.pii import personal_spans
from pagetide.llm.repeats import PASSAGES, repeated_spans

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = c.documents(spark, SF, *c.COLUMNS)
    for name, stage in c.STAGES[:-1]:
        out = c.stored(stage(spark, docs, SF))
        assert out.columns == c.COLUMNS
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        assert ids(out) <= ids(docs)
        if name == "language":
            assert ids(out) == ids(identified(docs).filter("lang_pred <> 'und'"))
        if name == "near_duplicates":
            assert ids(out) == ids(near_duplicates(docs).filter("kept"))
            assert near_duplicates(out).filter("not kept").isEmpty()
            assert {r[2] for r in components([(r["doc_id"], r["text"]) for r in docs.collect()])} == ids(out)
        if name == "repeated_passages":
            want = {r[0]: r[4] for r in repeated_words([(r["doc_id"], r["text"]) for r in docs.collect()], 51)}
            got = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in out.collect()}
            assert got.items() <= want.items() and ids(docs) - set(got) <= {r["doc_id"] for r in repeated_spans(docs, with_text=True, unit=PASSAGES).collect() if not r["kept_text"].strip()}
        if name == "personal_data":
            want = {r["doc_id"]: masked(r["text"], r["spans"]) for r in personal_spans(docs, carry=("text",)).collect()}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == want and want != {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = out
    library = Tokenizer.from_file(c.tokenizer_path())
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in c.STAGES[-1][1](spark, docs, SF).orderBy("doc_id", "start").collect():
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]))
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for places in sequences.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def masked(text, spans):
    out, at = "", 0
    for x in sorted(spans, key=lambda x: (x["start"], x["end"], x["kind"])):
        if x["start"] >= at:
            out += text[at : x["start"]] + f"[{x['kind'].upper()}]"
        at = max(at, x["end"])
    return out + text[at:]


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the words of a text without an id", "en", "s", 1), (3, "a@b.com and 1.2.3.4 the", "en", None, 1), (3, "another text the", None, "s", 1), (4, "x " * 3000, "en", "s", 6000), (4, "x " * 3000, "en", "s", 6000)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    for _, stage in c.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.count() >= 0


def test_repeated_passages_of_over_50_words_go_and_shorter_ones_stay(spark):
    words = lambda n, k, size: " ".join("".join("abcdefghijklmnopqrstuvwxyz"[(k * 7919 + i * i * 31 + j * 17 + i * j) % 26] for j in range(size)) for i in range(n))
    own = lambda k: " ".join(f"{k}own{k * 1000 + i}" for i in range(60))
    long, brief, dense, twin = words(51, 1, 5), words(45, 2, 5), words(51, 3, 1), words(40, 4, 3)
    texts = [f"{own(k)} {p} {own(k + 1)}" for k, p in ((10, long), (20, long), (30, brief), (40, brief), (50, dense), (60, dense))] + [twin, twin]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in c.repeated_passages(spark, docs, SF).collect()}
    assert len(long) < 400 and 2 * 51 - 1 == len(dense)
    assert not any(p in got[k] for k, p in ((0, long), (1, long), (4, dense), (5, dense)))
    assert all("own" in got[k] and len(got[k]) > 900 for k in range(6))
    assert [got[k] for k in (2, 3, 6, 7)] == [texts[k] for k in (2, 3, 6, 7)]
