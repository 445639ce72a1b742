"""Subword ids of texts by a public tokenizer, with each distinct chunk of a text encoded once.

A chunk is what ASCII white space separates. The byte-pair tokenizers in use split there too and
carry nothing across, so a text's ids are those of its chunks in order. Known chunks come from a
dictionary of bounded size, kept by a Python worker from task to task. Of the others, those in
ASCII and Latin-1 letters are split like the tokenizer does and merged side by side in numpy,
which applies the tokenizer's own merge list; the rest go through the tokenizer itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import islice, repeat

import numpy as np

#: Chunks that a worker remembers before it forgets all but the first, which tend to be the frequent ones.
KNOWN, KEPT = 400_000, 100_000
#: Bytes of the longest piece that is merged in numpy.
LONGEST = 48

#: What str.split takes for white space beside the six of ASCII.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Chunks whose form is unchanged by composition, and whose letters lower-case one to one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: How the two kinds of tokenizers split plain chunks; chunks are told apart by a line feed.
_SPLIT = {
    True: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+|\n"),
    False: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\n"),
}


def chunks(text: str) -> list[str]:
    """The text's chunks; str.split also cuts at other white space, so it serves only texts without that."""
    return _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()


def _spread(ids: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbered stretches of ``ids`` one after the other, and the length of each."""
    size = first[numbers + 1] - first[numbers]
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[numbers] - (ends - size), size)
    return ids[place], size


class Merges:
    """The merge list of a byte-pair tokenizer, applied to many short pieces at once."""

    NONE = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.byte = np.array([vocabulary[as_char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[as_char[b] + suffix] for b in range(256)], np.int32)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        bits = 19
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.key[slot] not in (-1, key):
                slot = slot + 1 & self.mask
            if self.key[slot] == -1:
                self.key[slot], self.rank[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``NONE`` if it is never merged."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.rank[slot], self.NONE)
        open_ = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            found = self.key[slot[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.rank[slot[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return out

    def same_length(self, raw: np.ndarray) -> np.ndarray:
        """Ids of the pieces in the rows of ``raw`` (bytes), -1 behind the last. Each round merges the
        leftmost pair of lowest rank in every row that still has one."""
        ids = self.byte[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        n, width = ids.shape
        if width == 1:
            return ids
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        ids = np.concatenate([ids, np.full((n, 2), -1, np.int32)], axis=1)
        rank = np.concatenate([rank, np.full((n, 2), self.NONE, np.int32)], axis=1)
        rows = np.arange(n)
        while True:
            best = rank[rows].argmin(axis=1)
            lowest = rank[rows, best]
            more = lowest < self.NONE
            rows, best, lowest = rows[more], best[more], lowest[more]
            if not len(rows):
                return ids[:, :width]
            own, own_rank = ids[rows], rank[rows]
            at = np.arange(width + 1)
            own[:, :-1] = np.take_along_axis(own, at + (at > best[:, None]), axis=1)
            at = np.arange(width)
            own_rank[:, :-1] = np.take_along_axis(own_rank, at + (at >= best[:, None]), axis=1)
            each = np.arange(len(rows))
            own[each, best] = self.made[lowest]
            own_rank[each, best] = self.ranks(own[each, best], own[each, best + 1])
            inner = np.flatnonzero(best)
            own_rank[inner, best[inner] - 1] = self.ranks(own[inner, best[inner] - 1], own[inner, best[inner]])
            ids[rows], rank[rows] = own, own_rank

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (of 1 to ``LONGEST`` bytes) and where each piece's begin."""
        data = [p.encode() for p in pieces]
        size = np.array([len(d) for d in data], np.int64)
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(data), np.uint8)
        found, count = np.full((len(data), int(size.max(initial=1))), -1, np.int32), np.zeros(len(data), np.int64)
        for width in np.unique(size):
            rows = np.flatnonzero(size == width)
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                ids = self.same_length(raw[begin[part][:, None] + np.arange(width)])
                found[part, :width], count[part] = ids, (ids >= 0).sum(axis=1)
        return found[found >= 0], np.concatenate([[0], np.cumsum(count)])


class Subwords:
    """Ids by a tokenizer file, as flat arrays. ``before`` is put in front of each chunk."""

    def __init__(self, path: str, before: str = "", known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.merges = Merges(model)
        self.words = bool(model.get("end_of_word_suffix"))  # lower-cased words with an end, or bytes as they are
        self.before, self.known = before, known
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.first = np.zeros(1, np.int64)
        self.source, self.values = None, np.empty(0, np.int64)

    def _encode_plain(self, fresh: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks that can be merged here, their ids, and where each chunk's begin."""
        done = [c for c in fresh if len(c) * 2 <= LONGEST and _PLAIN.fullmatch(c)]
        if not done:
            return [], np.empty(0, np.int32), np.zeros(1, np.int64)
        text = f"\n{self.before}".join(["", *done])
        split = _SPLIT[self.words].findall(text.lower() if self.words else text)
        pieces = {piece: i for i, piece in enumerate(dict.fromkeys(split))}  # the first is the line feed in front of each chunk
        ids, first = self.merges.encode(list(pieces)[1:])
        numbers = np.fromiter(map(pieces.__getitem__, split), np.int64, len(split))
        first = np.concatenate([[0], first])  # the line feed has no ids
        flat, size = _spread(ids, first, numbers)
        return done, flat, np.append((np.cumsum(size) - size)[numbers == 0], len(flat))

    def numbers(self, words: Iterable[str]) -> np.ndarray:
        """The number of each chunk in ``first`` and ``ids``, valid until the next call of ``room``."""
        number, words = self.number, list(words)
        found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            lacking = [words[i] for i in missing]
            fresh = list(dict.fromkeys(lacking))
            done, flat, first = self._encode_plain(fresh)
            self._add(done, flat, first)
            rest = [w for w in fresh if w not in number]
            if rest:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast([self.before + w for w in rest], add_special_tokens=False)]
                self._add(rest, np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
            found[missing] = np.fromiter(map(number.__getitem__, lacking), np.int64, len(lacking))
        return found

    def _add(self, done: list[str], flat: np.ndarray, first: np.ndarray) -> None:
        at, used = len(self.first) - 1, int(self.first[-1])
        self.number.update(zip(done, range(at, at + len(done))))
        while len(self.ids) < used + len(flat):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.int32)])
        self.ids[used:used + len(flat)] = flat
        self.first = np.concatenate([self.first, used + first[1:]])

    def room(self) -> None:
        """Forget the later chunks if the dictionary is full."""
        if len(self.number) > self.known:
            self.number = dict(islice(self.number.items(), KEPT))
            self.first, self.values = self.first[:KEPT + 1].copy(), self.values[:KEPT]
            self.ids = self.ids[:max(1 << 16, int(self.first[-1]))].copy()

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered chunks one after the other, and how many each has."""
        return _spread(self.ids, self.first, numbers)

    def texts(self, words: list[list[str]], looked_up: dict[str, int] | None = None) -> tuple[list[np.ndarray], ...]:
        """The ids of texts given as their chunks, how many ids each chunk of a text has, and what
        ``looked_up`` has for it (0 if nothing). Each chunk is looked up once while it is remembered."""
        self.room()
        numbers = self.numbers([w for own in words for w in own])
        ids, size = self.spread(numbers)
        cuts = np.cumsum([len(own) for own in words])
        upto = np.concatenate([[0], np.cumsum(size)])
        if not words:
            return [], [], []
        values = np.zeros(len(size), np.int64)
        if looked_up is not None:
            if self.source is not looked_up:
                self.source, self.values = looked_up, np.empty(0, np.int64)
            new = islice(self.number, len(self.values), None)
            self.values = np.concatenate([self.values, np.fromiter(map(looked_up.get, new, repeat(0)), np.int64)])
            values = self.values[numbers]
        return np.split(ids, upto[cuts[:-1]]), np.split(size, cuts[:-1]), np.split(values, cuts[:-1])


_loaded: dict[tuple[str, str], Subwords] = {}


def loaded(path: str, before: str = "") -> Subwords:
    """One for each Python worker. A bare file name is one of the installed public tokenizers."""
    if (path, before) not in _loaded:
        place = path
        if "/" not in path:
            import public_tokenizers

            place = public_tokenizers.path(path)
        _loaded[path, before] = Subwords(place, before)
    return _loaded[path, before]


def forget() -> None:
    """Free what ``loaded`` keeps, in tasks that read stored ids."""
    _loaded.clear()
