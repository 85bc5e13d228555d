"""Language identification by string kernels.

Blended-spectrum presence kernel: a text is the set of its 1- to 4-grams of characters (letters in lower case,
runs of all else as one blank), and k(x, y) = |x and y| / sqrt(|x| |y|). A bounded, documented sample of labelled
documents fits the model: some of them are the Nystroem landmarks, whose kernel matrix gives the features, and
one-versus-rest kernel ridge regression in these features gives one weight vector for each language. n-grams are known
by 64-bit hashes, so the kernel is exact but for their collisions. Scoring is a product of
the presence matrix of a batch of documents with the landmarks' presence matrix, then one with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import M1, ODD, crc_mod, documents, mix, release, stored

ORDERS = 4
#: The bounds of the sample: documents in all, documents of one language, characters of them all.
SAMPLE, PER_LANG, SAMPLE_CHARS = 3000, 400, 30_000_000
LANDMARKS, RIDGE = 192, 0.05
UNDETERMINED, BATCH = "und", 64
LETTER, OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def grams(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct n-grams; none without letters."""
    clean = OTHER.sub(" ", text.lower()).strip()
    if not clean:
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    acc, found = np.zeros(len(c), np.uint64), []
    for k in range(min(ORDERS, len(c))):
        acc = acc[: len(c) - k] * ODD + c[k:]
        found.append(acc + M1 * np.full(1, k, np.uint64))
    h = np.sort(mix(np.concatenate(found)))
    return h[np.r_[True, h[1:] != h[:-1]]]


class Model:
    """languages, the landmarks' normalised presence matrix, and weights from landmark kernels to languages."""

    def __init__(self, languages: list[str], used: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.used, self.landmarks, self.weights = languages, used, landmarks, weights

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
        sets = [grams(t) for t in texts]
        rows = [k for k, s in enumerate(sets) if len(s)]
        if not rows:
            return None
        languages = sorted({langs[k] for k in rows})
        chosen: list[int] = []  # in turn from each language, in the sample's order
        left = [[k for k in rows if langs[k] == lang] for lang in languages]
        while len(chosen) < min(n_landmarks, len(rows)):
            chosen += [x.pop(0) for x in left if x]
        chosen = chosen[:n_landmarks]
        used = np.unique(np.concatenate([sets[k] for k in chosen]))
        marks = np.zeros((len(used), len(chosen)), np.float32)
        for m, k in enumerate(chosen):
            marks[np.searchsorted(used, sets[k]), m] = 1 / np.sqrt(len(sets[k]))
        model = cls(languages, used, marks, np.zeros((len(chosen), len(languages))))
        kernel = model.kernels([sets[k] for k in rows]).astype(float)
        among = model.kernels([sets[k] for k in chosen]).astype(float)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        good = values > 1e-6 * values.max()
        half = vectors[:, good] / np.sqrt(values[good])  # Nystroem: features = kernel @ half
        x = kernel @ half
        y = np.array([[1.0 if langs[k] == lang else 0.0 for lang in languages] for k in rows])
        w = np.linalg.solve(x.T @ x + ridge * len(rows) / max(1, x.shape[1]) * np.eye(x.shape[1]), x.T @ y)
        model.weights = half @ w
        return model

    def kernels(self, sets: list[np.ndarray]) -> np.ndarray:
        """k(x, y) of each set x with each landmark y."""
        x = np.zeros((len(sets), len(self.used)), np.float32)
        for k, s in enumerate(sets):
            at = np.minimum(np.searchsorted(self.used, s), len(self.used) - 1)
            x[k, at[self.used[at] == s]] = 1 / np.sqrt(max(1, len(s)))
        return x @ self.landmarks

    def predict(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its share of the positive scores, 0 to 1) of non-empty sets."""
        raw = np.clip(self.kernels(sets) @ self.weights, 0, 1)
        best = raw.argmax(1)
        total = raw.sum(1)
        return best, np.where(total > 0, raw.max(1) / np.maximum(total, 1e-12), 0.0)


def sample_of(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts and languages of at most SAMPLE labelled documents outside the fold, those with the smallest hashes of doc_id."""
    labelled = docs.filter("lang is not null and doc_id is not null and text is not null").filter(crc_mod("doc_id", 5) != 0)
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    most = max(1, min(PER_LANG, SAMPLE // max(1, counts.count())))
    # a language's documents with hashes under 3 * most / n, about three times as many as wanted; then at most `most`
    h = F.xxhash64("doc_id")
    near = labelled.select("doc_id", "lang").join(counts, "lang").filter((h.cast("double") / 2.0**64 + 0.5) * F.col("n") < 3.0 * most).select("doc_id", "lang", h.alias("h")).distinct()
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("k") <= most)
    chosen = stored(first.orderBy("k", "lang").limit(SAMPLE))  # at most SAMPLE rows, without texts
    first = labelled.join(F.broadcast(chosen), ["doc_id", "lang"])
    texts, langs, room = [], [], SAMPLE_CHARS
    for r in first.orderBy("k", "lang", "text").limit(SAMPLE).select("text", "lang").toLocalIterator():
        if (room := room - len(r["text"])) < 0:
            break
        texts.append(r["text"])
        langs.append(r["lang"])
    return texts, langs


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row of docs(doc_id, text, lang, ...), with all its columns, and held_out, lang_pred and score.

    Learns from rows with text, doc_id and lang whose crc32(doc_id as text) mod 5 is not 0; predictions see the text alone.
    A null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn
    from. Rows that repeat stay rows. held_out of a null doc_id is null. Columns of docs named as a new one are replaced.
    """
    model = model or Model.fit(*sample_of(docs))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "held_out")]
    base = docs.select(*keep)
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            pred, score, todo, sets = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows, [], []

            def flush() -> None:
                if sets:
                    best, share = model.predict(sets)
                    for k, lang, s in zip(todo, best, share, strict=True):
                        pred[k], score[k] = model.languages[lang], float(s)
                todo.clear()
                sets.clear()

            for k, x in enumerate(b.column(at)):
                text = x.as_py()
                if model is not None and text and LETTER.search(text):
                    todo.append(k)
                    sets.append(grams(text))
                    if len(sets) == BATCH:
                        flush()
            flush()
            yield pa.record_batch([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = base.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return base.mapInArrow(run, schema).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole documents table."""
    return identified(documents(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
