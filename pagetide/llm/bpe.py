"""BPE by a deterministic automaton over tokens.

compile_merges() goes through the merges in order and applies one gadget for each. For a merge (a, b): the
arcs labelled a lead to a state s; they are led to a copy s' of s that lacks the arc b, and every state with an
arc a gets an arc ab to where b led. A path of the automaton then spells a word's tokens exactly if they are
the tokens that BPE gives. All arcs of one label enter one state, so the state after label a at time T is the
pair (a, T), a gadget is the note that (a, b) was taken away at its time, and has_arc() follows a state back
through its copies. All arcs together would be the square of the vocabulary; those that were asked for stay in a table.

A word has exactly one path. It is found from left to right, longest tokens first; as the path to a place is unique, no
place is tried twice. encode_words() lets all new words of a block of texts go along at once, each step a look-up in
the tables of labels and arcs. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import KEPT, ODD, documents, release, trim

WORD_END = "</w>"
END = "\0"  # stands for it within a word
#: Entries of a generation of the runs and words that a worker keeps, and arcs; only memory and time depend on it.
CACHE_RUNS, CACHE_WORDS, CACHE_ARCS = 200_000, 150_000, 400_000
BLOCK_CHARS = 2_000_000  # characters of texts that are encoded together
CACHE_ENTRIES, BLOCK_BYTES = 150_000, 4_000_000  # the same where only ids are wanted
SLICE_RUNS, SLICE_WORDS = 50_000, 20_000  # runs of a block whose ids are taken, and new words that are encoded, at once
LONG = 64  # bytes of a word that goes its way alone
STOP = 256  # the word end among bytes
#: The split pattern of the tokenizer's file. Its white space only parts words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


MARKS = frozenset(".,!?;:")


def lowered(text: str) -> str:
    """One character at a time: a final sigma gets no form of its own."""
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


def normal(lines: bytes) -> str:
    """Many runs at once: normalised and in lower case."""
    text = lines.decode()
    return lowered(text if text.isascii() else unicodedata.normalize("NFC", text))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that are visible
    Latin-1 stand for themselves, the others are numbered from U+0100 in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}
    return [chr(other.get(b, b)) for b in range(256)]


class Table:
    """int64 key -> value, -1 for none, for whole arrays: open addressing, the next place on a collision. Keys that fit are
    kept in 32 bits, values in the type that they have. dense: as few places as look-ups of known keys allow."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, dense: bool = False):
        bits = max(4, ((2 if dense else 4) * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int32 if keys.max(initial=0) < 1 << 31 else np.int64)
        self.values = np.full((1 << bits) + 64, -1, values.dtype)
        todo, at = np.arange(len(keys)), self.place(keys)
        while len(todo):
            if at.max(initial=0) >= len(self.keys) - 1:
                self.keys, self.values = (np.append(x, np.full(64, -1, x.dtype)) for x in (self.keys, self.values))
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.keys[slots], self.values[slots] = keys[todo[own]], values[todo[own]]
            left = np.ones(len(todo), bool)
            left[own] = False
            todo, at = todo[left], at[left] + 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * ODD >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        live = np.flatnonzero((found != keys) & (found != -1))
        while len(live):
            at[live] += 1
            found = self.keys[at[live]]
            hit = found == keys[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit & (found != -1)]
        return out

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        there = self.keys >= 0
        return self.keys[there].astype(np.int64), self.values[there]


class Automaton:
    """The compiled merges of a tokenizer file (BPE with word ends, byte-level characters)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.compile_merges([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges])
        self._index()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.bytes = byte_chars()
        self.arcs: dict[int, int] = {}  # those that are not in the table yet
        self.arc_table, self.arcs_settled = Table(np.empty(0, np.int64), np.empty(0, np.int8)), 0
        del spec, merges
        trim()

    @functools.cached_property
    def labels(self) -> dict[int, str]:
        """For decoding."""
        return {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}

    @functools.cached_property
    def trie(self) -> dict[str, int]:
        """For words that go alone."""
        return self.beginnings()

    def compile_merges(self, merges: list[tuple[int, int, int]]) -> None:
        """One gadget for each merge, in order. born: -1 for base symbols."""
        n = len(self.ids)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.taken: dict[tuple[int, int], int] = {}
        self.never: set[int] = set()  # labels of merges whose parts can no longer meet
        for time, (a, b, ab) in enumerate(merges):
            self.left[ab], self.right[ab], self.born[ab] = a, b, time
            if a in self.never or b in self.never or not self.has_arc(a, b):
                self.never.add(ab)
            self.taken[a, b] = time

    def has_arc(self, state: int, label: int, until: int = 1 << 40) -> bool:
        """Whether the state after `state` (-1: the first) has the arc `label` once all gadgets to that time are in place."""
        if state < 0:
            return True
        born, taken = self.born, self.taken
        while True:
            time = taken.get((state, label), -1)
            if 0 <= time <= until:
                return False
            s, t = born[state], born[label]
            if t > s:  # the label came later: where its left part's arc was, this one was laid
                label, until = self.left[label], t
            elif s > t:  # the state came later: it is what its right part led to just before
                state, until = self.right[state], s - 1
            elif s < 0:
                return True
            else:  # one label after itself: both of the above
                state, label, until = self.right[state], self.left[label], s - 1

    def beginnings(self) -> dict[str, int]:
        """Every beginning of a label -> the longest label that it begins with. Sets size, and shorter: a label's next shorter one."""
        spelled = {(s.removesuffix(WORD_END) + END if s.endswith(WORD_END) else s): i for s, i in self.ids.items() if i not in self.never}
        trie: dict[str, int] = {}
        self.size, self.shorter = [0] * len(self.ids), [-1] * len(self.ids)
        for s, i in sorted(spelled.items(), key=lambda x: len(x[0])):
            self.size[i] = len(s)
            last = -1
            for k in range(1, len(s)):
                last = spelled.get(s[:k], last)
                if last >= 0:
                    trie.setdefault(s[:k], last)
            self.shorter[i] = last
            trie[s] = i
        return trie

    def _index(self) -> None:
        """The beginnings by numbers: (node, byte) -> node in order, and each node's longest label."""
        trie = self.beginnings()
        byte = {c: k for k, c in enumerate(byte_chars())} | {END: STOP}
        nodes = {"": 0} | {s: k + 1 for k, s in enumerate(p for p in trie if set(p) <= byte.keys())}
        steps = sorted((nodes[p[:-1]] * 512 + byte[p[-1]], k, trie[p]) for p, k in nodes.items() if p and p[:-1] in nodes)
        keys, to = (np.array([x[j] for x in steps], np.int64) for j in (0, 1))
        self.steps = Table(keys, to.astype(np.int32))
        self.node_label = np.full(len(nodes), -1, np.int64)
        self.node_label[to] = [x[2] for x in steps]
        # the first two steps at once: both bytes -> node after them, else after the first; how many were taken
        one = self.steps.get(np.arange(512))
        two = np.where(one[:, None] >= 0, self.steps.get((np.maximum(one, 0)[:, None] * 512 + np.arange(512)).ravel()).reshape(512, 512), -1)
        self.second, self.began = two.ravel(), np.where(one >= 0, self.node_label[np.maximum(one, 0)], -1)
        self.sizes, self.shorters = np.array([*self.size, 0], np.int64), np.array([*self.shorter, -1], np.int64)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        chars = (word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode("utf-8", "replace")])) + END
        n, trie, arcs, shorter, size = len(chars), self.trie.get, self.arcs, self.shorter, self.size
        path, at, state, label = [], 0, -1, -2
        dead = {n - 1}  # no label is an end alone
        while at < n:
            if label == -2:  # the longest label from here; most places have beginnings of three characters
                k = at + 3
                label = trie(chars[at:k], -1)
                if label < 0:
                    label = trie(chars[at : at + 2], -1)
                    if label < 0:
                        label = trie(chars[at], -1)
                else:
                    while k < n:
                        k += 1
                        node = trie(chars[at:k])
                        if node is None:
                            break
                        label = node
            while label >= 0:
                to = at + size[label]
                if to not in dead:
                    if state < 0:
                        break
                    key = state << 20 | label
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = int(self.has_arc(state, label))
                    if ok:
                        break
                label = shorter[label]
            if label >= 0:
                path.append(label)
                at, state, label = to, label, -2
            else:
                dead.add(at)
                label = path.pop()
                at -= size[label]
                state = path[-1] if path else -1
                label = shorter[label]
        return path

    def longest(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest label that begins at each of the places; -1 for none. chars: with a few places behind the end."""
        out = self.began[chars[at]]
        node = self.second[chars[at] * 512 + chars[at + 1]]
        live, deep = np.flatnonzero(node >= 0), 2
        at, node = at[live], node[live]
        while len(live):
            label = self.node_label[node]
            out[live] = np.where(label >= 0, label, out[live])
            node = self.steps.get(node * 512 + chars[at + deep])
            on = node >= 0
            live, at, node = live[on], at[on], node[on]
            deep += 1
        return out

    def have_arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """has_arc() of many: from the table of arcs, or the few that were added since it was made; what both lack is added."""
        keys = states << 20 | labels
        got = self.arc_table.get(keys)
        lack = np.flatnonzero(got < 0)
        if len(lack):
            new = np.unique(keys[lack])
            added = [self.arcs.get(k, -1) for k in new.tolist()]
            for j, k in enumerate(new.tolist()):
                if added[j] < 0:
                    added[j] = self.arcs[k] = int(self.has_arc(k >> 20, k & 0xFFFFF))
            got[lack] = np.array(added)[np.searchsorted(new, keys[lack])]
        return got > 0

    def settle(self) -> None:
        """Moves arcs to the table when many were added, or empties it when it is full."""
        if self.arcs_settled + len(self.arcs) > CACHE_ARCS:
            self.arcs, self.arc_table, self.arcs_settled = {}, Table(np.empty(0, np.int64), np.empty(0, np.int8)), 0
        if len(self.arcs) > 0.05 * self.arcs_settled:
            keys, values = (np.fromiter(x, t, len(self.arcs)) for x, t in ((self.arcs.keys(), np.int64), (self.arcs.values(), np.int8)))
            new = self.arc_table.get(keys) < 0  # a word that goes alone may have added one again
            before = self.arc_table.items()
            keys, values = np.r_[before[0], keys[new]], np.r_[before[1], values[new]]
            self.arcs, self.arc_table, self.arcs_settled = {}, Table(keys, values, dense=True), len(keys)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-split words, and where each word's end. All words stand one behind the other; a word's walker is at `at`, has come by the label
        `state` and tries `label`; out and before hold its path, dead the places from which no path goes on."""
        if len(words) > SLICE_WORDS:
            parts = [self.encode_words(words[k : k + SLICE_WORDS]) for k in range(0, len(words), SLICE_WORDS)]
            before = np.cumsum([0, *(len(flat) for flat, _ in parts)])
            return np.concatenate([flat for flat, _ in parts]), np.concatenate([ends + n for (_, ends), n in zip(parts, before[:-1], strict=True)])
        raw = [w.encode("utf-8", "replace") for w in words]
        if any(len(w) > LONG for w in raw):
            flat, ends = self.encode_words([w for w, b in zip(words, raw, strict=True) if len(b) <= LONG])
            brief = iter(np.split(flat, ends[:-1]))
            parts = [next(brief) if len(b) <= LONG else np.array(self.encode_word(w), np.int64) for w, b in zip(words, raw, strict=True)]
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        if not raw:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        self.settle()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        ends = np.cumsum(sizes)
        chars = np.full(ends[-1] + 2, STOP, np.int64)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        chars[:-2][inner] = np.frombuffer(b"".join(raw), np.uint8)
        out, before, dead = np.full(len(chars) + 1, -1, np.int64), np.zeros(len(chars) + 1, np.int64), np.zeros(len(chars) + 1, bool)
        dead[ends - 1] = True  # no label is an end alone
        start, stop = ends - sizes, ends
        at, state, label = start.copy(), np.full(len(raw), -1, np.int64), self.longest(chars, start)
        while len(at):
            to = at + self.sizes[label]
            ok = (label >= 0) & ~dead[to]
            ask = np.flatnonzero(ok & (state >= 0))
            ok[ask] = self.have_arcs(state[ask], label[ask])
            back, less = label < 0, self.shorters[label]
            out[at[ok]], before[to[ok]] = label[ok], at[ok]
            next_at, next_state = np.where(ok, to, at), np.where(ok, label, state)
            if back.any():
                dead[at[back]] = True
                gone = before[at[back]]
                less[back] = self.shorters[out[gone]]
                out[gone] = -1
                next_at[back] = gone
                next_state[back] = np.where(gone > start[back], out[before[gone]], -1)
            on = next_at < stop
            at, state, start, stop = next_at[on], next_state[on], start[on], stop[on]
            label, new = less[on], np.flatnonzero(ok[on])
            label[new] = self.longest(chars, at[new])
        return out[out >= 0], np.cumsum(out[:-1] >= 0)[ends - 1]

    def split_run(self, run: str) -> list[str]:
        """Pre-split words of text without ASCII white space and special tokens: normalised, split."""
        if not run.isascii():
            run = unicodedata.normalize("NFC", run)
        return self.words_of(lowered(run))

    def words_of(self, run: str) -> list[str]:
        # letters, and letters with one mark behind them, need no pattern
        if run.isalpha():
            return [run]
        if run[-1:] in MARKS and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.split.findall(run)

    def split_runs(self, runs: list[bytes]) -> list[list[str]]:
        """Words of many runs without special tokens."""
        return [[run] if run.isalpha() else self.words_of(run) for run in normal(b"\n".join(runs)).split("\n")] if runs else []

    def encode_run(self, run: str) -> list[int]:
        """Ids of text without ASCII white space, special tokens included."""
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(run) if self.split_special else (run,)):
            if k % 2:
                out.append(self.special[part])
            else:
                out += [i for w in self.split_run(part) for i in self.encode_word(w)]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Nothing reaches over white space: normal forms, letters and splits are those of each run."""
        return [i for run in (text or "").encode("utf-8", "replace").split() for i in self.encode_run(run.decode())]

    def decode(self, ids) -> str:
        """Labels along the path; the file names no decoder, so one space parts them."""
        return " ".join([self.labels[i] for i in ids])


class Runs:
    """run of a text without white space -> the values of its words, joined; a worker keeps them for its next tasks.
    make(ids, ends) gives the values of words from their ids, all in one array, and where each word's end.

    Runs and words are remembered in two generations: when the younger is full it becomes the older, and what is asked
    for again moves to the new one, so that frequent ones stay while rare ones go."""

    kept: dict[tuple[str, str], Runs] = {}

    def __init__(self, automaton: Automaton, make: Callable, join: Callable):
        self.automaton, self.make, self.join = automaton, make, join
        self.runs: list[dict] = [{}, {}]
        self.words: list[dict] = [{}, {}]

    @classmethod
    def of(cls, path: str, kind: str, make: Callable[[Automaton], Callable], join: Callable) -> Runs:
        if (path, kind) not in cls.kept:
            automaton = Automaton(path)
            cls.kept[path, kind] = cls(automaton, make(automaton), join)
        return cls.kept[path, kind]

    @staticmethod
    def lacking(held: list[dict], most: int, keys: set) -> list:
        """Keys that neither generation has; those of the older one come to the younger."""
        if len(held[0]) > most:
            held[:] = [{}, held[0]]
        now, older = held
        lacking = []
        for key in keys.difference(now):
            if (value := older.get(key)) is None:
                lacking.append(key)
            else:
                now[key] = value
        return lacking

    def blocks(self, texts: pa.Array) -> Iterator[list]:
        """For each text of an Arrow column, the list of its runs' values."""
        block, size = [], 0
        for x in texts.cast(pa.binary()):
            text = x.as_py() or b""
            block.append(text.split())
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self.values(block)
                block, size = [], 0
        yield from self.values(block)

    def values(self, block: list[list[bytes]]) -> Iterator[list]:
        get, found, holes, missing = self.runs[0].get, [], [], set()
        for runs in block:
            got = list(map(get, runs))
            if None in got:
                at = [k for k, v in enumerate(got) if v is None]
                holes.append((runs, got, at))
                missing.update([runs[k] for k in at])
            found.append(got)
        self.learn(missing)
        known = self.runs[0]
        for runs, got, at in holes:
            for k in at:
                got[k] = known[runs[k]]
        return iter(found)

    def learn(self, runs: set[bytes]) -> None:
        """Encodes new runs. Many small objects are made, none in cycles: looking for cycles would take a tenth of the time."""
        gc.disable()
        try:
            self._learn(self.lacking(self.runs, CACHE_RUNS, runs))
        finally:
            gc.enable()

    def _learn(self, runs: list[bytes]) -> None:
        a, known = self.automaton, self.runs[0]
        special = [r for r in runs if b"<|" in r]
        if special:
            runs = [r for r in runs if b"<|" not in r]
        if runs:
            split = a.split_runs(runs)
            new = self.lacking(self.words, CACHE_WORDS, set(chain.from_iterable(split)))
            words = self.words[0]
            words.update(zip(new, self.make(*a.encode_words(new)), strict=True))
            join = self.join
            known.update(zip(runs, [words[ws[0]] if len(ws) == 1 else join([words[w] for w in ws]) for ws in split], strict=True))
        for r in special:
            ids = np.array(a.encode_run(r.decode()), np.int64)
            (known[r],) = self.make(ids, np.array([len(ids)]))


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of values, one behind the other, and where each one's end."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0], ends
    some = size > 0
    start, size, last = start[some], size[some], ends[some][:-1]
    at = np.ones(ends[-1], np.int32)  # steps from each place to the next
    at[0] = start[0]
    at[last] = start[1:] - start[:-1] - size[:-1] + 1
    return values[np.cumsum(at, out=at)], ends


class TextIds:
    """Ids of whole texts. Arrow splits a block of texts into runs and numbers the different ones; only those are split into
    words, and all ids of the block are taken at once from one array of the ids of known words.

    A word is known by its number, which has a place in that array and a count of its uses. When there are too many, those
    used more often than most stay, with half of their uses."""

    kept: dict[str, TextIds] = {}

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.letters: dict[str, int] = {}  # words of letters alone
        self.others: dict[str, int] = {}  # words of all other runs
        self.ids = np.empty(0, np.uint32)
        self.start, self.size, self.uses = (np.empty(0, np.int64) for _ in range(3))
        marks = sorted(MARKS)
        self.add(self.others, marks, *automaton.encode_words(marks))
        self.mark = np.full(256, -1)
        self.mark[[ord(m) for m in marks]] = np.arange(len(marks))

    @classmethod
    def of(cls, path: str) -> TextIds:
        if path not in cls.kept:
            release()
            cls.kept[path] = cls(Automaton(path))
        return cls.kept[path]

    def add(self, known: dict[str, int], words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """New words, whose ids stand one behind the other."""
        first, begin = len(self.start), len(self.ids)
        self.ids = np.r_[self.ids, ids.astype(np.uint32)]
        self.start, self.size = np.r_[self.start, begin + np.r_[0, ends][:-1]], np.r_[self.size, np.diff(ends, prepend=0)]
        self.uses = np.r_[self.uses, np.zeros(len(ends), np.int64)]
        known.update(zip(words, range(first, len(self.start)), strict=True))

    def forget(self) -> None:
        if len(self.start) <= CACHE_ENTRIES:
            return
        stay = self.uses > np.median(self.uses)
        stay[: len(MARKS)] = True  # the first, whose numbers do not change
        moved = np.where(stay, np.cumsum(stay) - 1, -1).tolist()
        self.letters, self.others = ({w: n for w, k in known.items() if (n := moved[k]) >= 0} for known in (self.letters, self.others))
        self.ids, ends = gathered(self.ids, self.start[stay], self.size[stay])
        self.size, self.uses = self.size[stay], self.uses[stay] // 2
        self.start = ends - self.size

    def words(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the runs' words, one run behind the other, and how many each run has."""
        letters = self.letters
        lines = np.frombuffer(pc.binary_join(pa.LargeListArray.from_arrays([0, len(runs)], runs), pa.scalar(b"\n", runs.type))[0].as_py() + b"\n", np.uint8)
        ends = np.flatnonzero(lines == 10)
        last = self.mark[lines[ends - 1]]
        # letters, and letters with one mark behind them, need no pattern
        marked = last >= 0
        kept = np.ones(len(lines), bool)
        kept[ends[marked] - 1] = False
        stems = normal(lines[kept].tobytes()).split("\n")[:-1]
        numbers = [letters.get(w, -1) for w in stems]
        lack = [k for k, n in enumerate(numbers) if n < 0]
        new = list({w for k in lack if (w := stems[k]).isalpha()})
        self.add(letters, new, *self.automaton.encode_words(new))
        for k in lack:
            numbers[k] = letters.get(stems[k], -1)
        numbers = np.fromiter(numbers, np.int64, len(numbers))
        plain = numbers >= 0
        counts = 1 + marked
        flat, counts[~plain] = self.odd_words(runs.filter(pa.array(~plain)).to_pylist())
        out, first = np.empty(counts.sum(), np.int64), np.cumsum(counts) - counts
        out[first[plain]] = numbers[plain]
        out[first[plain & marked] + 1] = last[plain & marked]
        out[np.repeat(~plain, counts)] = flat
        return out, counts

    def odd_words(self, runs: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The same of runs that need the pattern; those that may hold special tokens count as one word."""
        a, others = self.automaton, self.others
        split = iter(a.split_runs([r for r in runs if b"<|" not in r]))
        words = [[r.decode()] if b"<|" in r else next(split) for r in runs]
        new = set(chain.from_iterable(words)).difference(others)
        special = [w for w in new if "<|" in w]
        new = list(new.difference(special))
        self.add(others, new, *a.encode_words(new))
        for w in special:
            ids = np.array(a.encode_run(w), np.int64)
            self.add(others, [w], ids, np.array([len(ids)]))
        counts = list(map(len, words))
        return np.fromiter(map(others.__getitem__, chain.from_iterable(words)), np.int64, sum(counts)), counts

    def blocks(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text of an Arrow column, its ids."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES, "right")))
            yield from self.block(pc.fill_null(texts.slice(low, high - low).cast(pa.large_string()), ""))
            low = high
            trim()

    def block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        self.forget()
        split = pc.ascii_split_whitespace(texts)  # with an empty run before white space at the start and after that at the end
        coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
        at = coded.indices.to_numpy()
        gc.disable()  # many small objects are made, none in cycles
        try:
            flat, counts = self.words(coded.dictionary)
        finally:
            gc.enable()
        np.add.at(self.uses, flat, np.repeat(np.bincount(at, minlength=len(counts)), counts))
        stops = np.cumsum(pc.list_value_length(split).to_numpy())
        del split, coded
        ids, ends = gathered(self.ids, self.start[flat], self.size[flat])
        ends = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        start, size = ends[:-1], np.diff(ends)
        # the ids of all runs, some texts at a time
        low = first = 0
        while low < len(stops):
            high = max(low + 1, int(np.searchsorted(stops, first + SLICE_RUNS, "right")))
            some = at[first : stops[high - 1]]
            values, ends = gathered(ids, start[some], size[some])
            yield from np.split(values, np.r_[0, ends][stops[low : high - 1] - first])
            low, first = high, stops[high - 1]


KEPT += [Runs.kept, TextIds.kept]


def cut(values, ends: np.ndarray) -> list:
    """Slices of values, each up to the next end."""
    ends = ends.tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def texts_of(automaton: Automaton) -> Callable:
    """Words' ids in decimals, and their decoded text."""

    def make(ids: np.ndarray, ends: np.ndarray) -> list[tuple[str, str]]:
        ids = ids.tolist()
        texts = ([*map(str, ids)], [automaton.labels[i] for i in ids])
        return [(" ".join(a), " ".join(b)) for a, b in zip(*(cut(t, ends) for t in texts), strict=True)]

    return make


def joined_texts(parts: list[tuple[str, str]]) -> tuple[str, str]:
    return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text, ...).

    A null text counts as empty: no tokens, and the hashes of the empty string. Rows that repeat stay rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs.of(path, "text", texts_of, joined_texts)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for values in runs.blocks(b.column(1)):
                parts = [p for p in values if p[0]]
                ids = " ".join([p[0] for p in parts])
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the whole documents table, as hashes."""
    return encoded(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
