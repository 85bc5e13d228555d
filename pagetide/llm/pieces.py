"""SentencePiece BPE by vectorised merge rounds, and its decoding.

A text gets one space in front and is cut between two characters wherever no piece of the vocabulary holds them side by
side, so no merge can reach over a cut. All new words of a block of texts then lie in one flat array of symbols. A round
takes the minimum of the pair ranks of each word (a segmented minimum), merges the leftmost pair of that rank in every word
at once, and closes the gaps; words without a pair leave. Where no piece that has the merged one as a part ranks as high
(the usual case), all pairs of that rank in the word merge in one round, from the left, which gives the same result.
Words of over LONG characters go along a queue of their pairs instead, as their rounds would take the square of their length.

Characters without a piece become their UTF-8 bytes. Decoding joins pieces, turns byte pieces to text and drops one space.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Table, cut
from .common import KEPT, documents

#: Words of a generation that a worker keeps; only memory and time depend on it.
CACHE_WORDS = 150_000
BLOCK_CHARS = 1_000_000  # characters of texts that are encoded together
LONG = 2000  # characters of a word from which on it goes along a queue
NONE = 1 << 40  # the rank of a pair that does not merge
GONE = -(1 << 30)  # a place whose symbol has become part of the one before it
PAIR_BITS = 22  # of the hashed set of neighbours; pairs that fall together are not cut, which changes no result
SPACE = "▁"


def one_byte(error: UnicodeError) -> tuple[str, int]:
    """Each byte that is no part of a character becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("pagetide.one_byte", one_byte)


class Pieces:
    """The vocabulary of a BPE model as tables. Symbols are ids of pieces; characters that stand only inside of pieces
    are numbered behind them, and all others are -1 - code point."""

    kept: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  Ａ  ") != f"{SPACE * 2}a {SPACE}Ａ{SPACE * 2}" or not model.is_byte(model.piece_to_id("<0x00>")):
            raise ValueError(f"{path}: only models with a space in front, texts as they are and bytes for unknown characters are known here")
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: pieces that are not in use are not known here")
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.bytes_at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(self.bytes_at.tolist()):
            self.raw[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                self.raw[i] = b""
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        # what decoding looks at besides: whether a piece is plain, and whether it begins with a space
        self.spaced = [i for p, i in plain.items() if p.startswith(SPACE)]
        self.spaced_set, self.silent = frozenset(self.spaced), frozenset(i for i in range(n) if model.is_control(i))
        symbols = dict(plain)
        for c in sorted({c for p in plain for c in p} - set(plain)):
            symbols[c] = len(pieces) + len(symbols) - len(plain)
        self.n = n
        # ranks: equal scores have equal ranks
        scores = np.array([-model.get_score(plain[p]) for p in plain], np.float64)
        _, dense = np.unique(scores, return_inverse=True)
        rank = dict(zip(plain, dense.tolist(), strict=True))
        left, right, whole, ranks, calm = [], [], [], [], np.ones(n, bool)
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i), ranks.append(rank[p])
                    for part in (p[:k], p[k:]):
                        if rank.get(part, -1) >= rank[p]:
                            calm[plain[part]] = False
        self.calm = calm
        self.pairs = Table(np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(ranks, np.int64) << 32 | np.array(whole, np.int64))
        chars = np.array([ord(c) for c in symbols if len(c) == 1], np.int64)
        self.of_char = np.full(0x110000, GONE, np.int32)
        self.of_char[:] = -1 - np.arange(0x110000)
        self.of_char[chars] = [symbols[chr(c)] for c in chars.tolist()]
        self.of_char[32] = symbols[SPACE]
        self.char_of = {s: ord(c) for c, s in symbols.items() if s >= n}
        self.beside = np.zeros(1 << PAIR_BITS, bool)
        a, b = (np.array([ord(x[k]) for p in plain for x in zip(p, p[1:], strict=False)], np.uint32) for k in (0, 1))
        self.beside[self.pair_slot(a, b)] = True

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    @staticmethod
    def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_BITS)

    def words_of(self, texts: list[str]) -> Iterator[list[str]]:
        """The words of each text, with the space in front; none of an empty text."""
        texts = [" " + t if t else "" for t in texts]
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        chars = np.where(chars == 32, np.uint32(ord(SPACE)), chars)
        begins = np.ones(len(chars), bool)
        begins[1:] = ~self.beside[self.pair_slot(chars[:-1], chars[1:])]
        ends = np.cumsum([len(t) for t in texts])
        begins[ends[ends < len(chars)]] = True
        at = np.flatnonzero(begins)
        to = np.searchsorted(at, ends).tolist()
        at = [*at.tolist(), len(chars)]
        words = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
        return (words[a:b] for a, b in zip([0, *to], to, strict=False))

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols and what they become."""
        found = np.full(len(left), -1, np.int64)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        found[known] = self.pairs.get(left[known] << 32 | right[known])
        return np.where(found < 0, NONE, found >> 32), found & 0xFFFFFFFF

    def rounds(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbols of words, each from its start on; afterwards those that became part of another are GONE."""
        out = np.full(len(sym), GONE, np.int64)
        place, word = np.arange(len(sym)), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sym))))
        last = np.append(word[1:] != word[:-1], True)
        rank, whole = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], whole[inner] = self.ranked(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            best = np.repeat(least, sizes)
            # words without a pair leave
            on = best < NONE
            if not on.all():
                out[place[~on]] = sym[~on]
                sym, place, word, rank, whole, best = sym[on], place[on], word[on], rank[on], whole[on], best[on]
                continue
            hit = np.flatnonzero(rank == best)
            # of each word the leftmost; in a calm word every second of those that touch, from the left
            new_word = np.append(True, word[hit[1:]] != word[hit[:-1]])
            calm = self.calm[whole[hit]]
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | new_word[1:])
            order = np.arange(len(hit))
            within = order - np.maximum.accumulate(np.where(run, order, 0))
            hit = hit[new_word | calm & (within % 2 == 0)]
            sym[hit] = whole[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            mended = hit - np.arange(len(hit))  # where they stand once the gaps are closed
            sym, place, word, rank, whole = sym[stay], place[stay], word[stay], rank[stay], whole[stay]
            ask = np.unique(np.concatenate([mended, mended[mended > 0] - 1]))
            pair = ask[ask + 1 < len(sym)]
            same = word[pair] == word[pair + 1]
            rank[ask] = NONE
            pair = pair[same]
            rank[pair], whole[pair] = self.ranked(sym[pair], sym[pair + 1])
        return out

    def queued(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word: the best pair, then the leftmost, from a queue."""
        out, n = sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, whole = self.ranked(sym[:-1], sym[1:])
        at = np.flatnonzero(rank < NONE)
        queue = list(zip(rank[at].tolist(), at.tolist(), sym[at].tolist(), sym[at + 1].tolist(), whole[at].tolist(), strict=True))
        heapq.heapify(queue)
        known: dict[tuple[int, int], int] = {}
        while queue:
            _, a, x, y, z = heapq.heappop(queue)
            b = after[a]
            if out[a] != x or b >= n or out[b] != y:
                continue
            out[a], out[b] = z, GONE
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            for u, v in ((before[a], a), (a, after[a])):
                if u < 0 or v >= n or out[u] < 0 or out[v] < 0:
                    continue
                pair = (out[u], out[v])
                if pair not in known:
                    known[pair] = int(self.pairs.get(np.array([pair[0] << 32 | pair[1]]))[0])
                if (found := known[pair]) >= 0:
                    heapq.heappush(queue, (found >> 32, u, *pair, found & 0xFFFFFFFF))
        return np.array(out, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, and where each word's end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(sizes):
            return np.empty(0, np.int64), sizes
        ends = np.cumsum(sizes)
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        out, brief = np.empty(len(sym), np.int64), np.repeat(sizes <= LONG, sizes)
        starts = np.cumsum(sizes[sizes <= LONG]) - sizes[sizes <= LONG]
        out[brief] = self.rounds(sym[brief], starts)
        for k in np.flatnonzero(sizes > LONG):
            out[ends[k] - sizes[k] : ends[k]] = self.queued(sym[ends[k] - sizes[k] : ends[k]])
        kept = out != GONE
        ids, count = out[kept], np.ones(int(kept.sum()), np.int64)
        odd = np.flatnonzero((ids < 0) | (ids >= self.n))
        if len(odd):
            chars, which = np.unique(ids[odd], return_inverse=True)
            spelt = [chr(-1 - c if c < 0 else self.char_of[c]).encode() for c in chars.tolist()]
            count[odd] = np.array([len(b) for b in spelt])[which]
            first = np.cumsum(count) - count
            wide = np.repeat(ids, count)
            for k in range(4):
                have = np.array([b[k] if len(b) > k else -1 for b in spelt])[which]
                wide[first[odd[have >= 0]] + k] = self.bytes_at[have[have >= 0]]
            ids = wide
        upto = np.zeros(len(out) + 1, np.int64)
        upto[1:][kept] = count
        return ids, np.cumsum(upto)[ends]

    def encode(self, text: str | None) -> list[int]:
        (words,) = self.words_of([text or ""])
        return self.encode_words(words)[0].tolist()

    def text_of(self, ids: list[int]) -> str:
        """Pieces side by side, the space in front included."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "pagetide.one_byte")

    def decode(self, ids: list[int] | None) -> str:
        """The text of any ids. The first piece that is not silent loses one space in front, if it has one."""
        ids = [i for i in ids or () if i not in self.silent]
        text = self.text_of(ids)
        return text[1:] if ids and ids[0] in self.spaced_set else text


KEPT.append(Pieces.kept)


class Words:
    """word -> what `make` says of its ids; a worker keeps them for its next tasks, in two generations: what is asked for
    again moves to the younger one, and the older goes when that is full."""

    kept: dict[str, Words] = {}

    def __init__(self, path: str):
        self.pieces, self.now, self.older = Pieces.of(path), {}, {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def learn(self, words: set[str]) -> None:
        if len(self.now) > CACHE_WORDS:
            self.now, self.older = {}, self.now
        new = []
        for w in words.difference(self.now):
            if (value := self.older.get(w)) is None:
                new.append(w)
            else:
                self.now[w] = value
        ids = cut(*(lambda flat, ends: (flat.tolist(), ends))(*self.pieces.encode_words(new)))
        self.now.update({w: (",".join(map(str, i)), self.pieces.text_of(i)) for w, i in zip(new, ids, strict=True)})

    def texts(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Ids in decimals and decoded text of each text."""
        split = list(self.pieces.words_of(texts))
        self.learn(set().union(*split))
        now = self.now
        for words in split:
            got = [now[w] for w in words]
            yield ",".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]  # the first piece begins with the space in front


KEPT.append(Words.kept)


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in blocks of some BLOCK_CHARS characters."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of the ids of each whole text; a null or empty text has none. Rows that repeat stay rows."""

    @F.pandas_udf("array<int>")
    def run(column):
        pieces, out = Pieces.of(path), []
        for block in blocks(column.tolist()):
            words = list(pieces.words_of(block))
            flat, ends = pieces.encode_words([w for ws in words for w in ws])
            ends = np.append(0, ends)
            upto = np.append(0, np.cumsum([len(ws) for ws in words]))
            out += [flat[ends[a] : ends[b]].astype(np.int32) for a, b in zip(upto, upto[1:], strict=False)]
        return type(column)(out)

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with a column of the text of ids; null or no ids give the empty text. Ids must be of the vocabulary."""

    @F.pandas_udf("string")
    def run(column):
        pieces = Pieces.of(path)
        return type(column)([pieces.decode(None if x is None else [int(i) for i in x]) for x in column])

    return docs.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text, ...), words encoded once a task.

    A null text counts as empty: no tokens, and the hashes of the empty string. Rows that repeat stay rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for block in blocks(b.column(1).to_pylist()):
                for ids, text in words.texts(block):
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the whole documents table, as hashes."""
    return digests(documents(spark, sf_dir, "doc_id", "text"), model_path())
