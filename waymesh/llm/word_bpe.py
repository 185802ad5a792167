"""Ids of many texts at once, by a public byte-level BPE vocabulary with word ends.

Latin-1 texts are cut into words with numpy and the merges are applied to all new words of a run
together; every other text goes through the ``tokenizers`` library as it is.  Both give the same ids.
"""

from __future__ import annotations

import json
import zlib
from itertools import repeat

import numpy as np

from . import textbuf

#: Words whose ids a Python worker remembers.
REMEMBERED = 200_000
#: Longer words go through the library.
LONGEST = 64

_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each Latin-1 character, its class in the vocabulary's pattern, and its lower case."""
    kind = np.full(256, _OTHER, np.int8)
    lower = np.arange(256, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isalpha():
            kind[i] = _LETTER
        elif c.isnumeric():
            kind[i] = _NUMBER
        elif c.isspace() and not 0x1C <= i <= 0x1F:
            kind[i] = _SPACE
        lower[i] = ord(c.lower())
    return kind, lower


def process_state(name: str) -> dict:
    """A dictionary that lives as long as this Python process, so that a reused worker keeps what it knows."""
    import sys
    import types

    return vars(sys.modules.setdefault("_waymesh_state", types.ModuleType("_waymesh_state"))).setdefault(name, {})


class _Merges:
    """The vocabulary's merges as sorted arrays."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab = model["vocab"]
        # byte-level vocabularies show each byte as a printable character: itself, or one from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocab[as_char[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[as_char[b] + model["end_of_word_suffix"]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.order[at], _NONE).astype(np.int32)

    def apply(self, codes: np.ndarray) -> np.ndarray:
        """Merges each row (ids, then -1) to the end, always the lowest rank and of equals the leftmost."""
        out = np.full(codes.shape, -1, np.int32)
        rows, s = np.arange(len(codes)), codes
        r = self.rank(s[:, :-1], s[:, 1:])
        while len(rows):
            j = r.argmin(1)
            best = r[np.arange(len(rows)), j]
            on = best < _NONE
            if not on.all():
                out[rows[~on], : s.shape[1]] = s[~on]
                rows, s, r, j, best = rows[on], s[on], r[on], j[on], best[on]
                if not len(rows):
                    break
            n, width = s.shape
            line, at = np.arange(n), np.arange(width - 1)
            moved = np.take_along_axis(s, at + (at > j[:, None]), 1)
            moved[line, j] = self.made[best]
            s = moved
            if width == 2:
                out[rows, :1] = s
                break
            at = np.arange(width - 2)
            r = np.take_along_axis(r, at + (at >= j[:, None]), 1)
            left = j > 0
            r[line[left], j[left] - 1] = self.rank(s[line[left], j[left] - 1], s[line[left], j[left]])
            right = j < width - 2
            r[line[right], j[right]] = self.rank(s[line[right], j[right]], s[line[right], j[right] + 1])
        return out


class Coder:
    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.state = process_state(f"word bpe {zlib.crc32(spec.encode())}")
        if not self.state:
            self.state |= {"tokenizer": Tokenizer.from_str(spec), "merges": _Merges(spec)}
            self._forget()
        self.tokenizer, self.merges = self.state["tokenizer"], self.state["merges"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.lower = _classes()
        self.ranges = textbuf.Ranges(404)

    def _forget(self) -> None:
        self.state |= {"known": {}, "start": np.zeros(1 << 16, np.int64), "length": np.zeros(1 << 16, np.int32), "ids": np.zeros(1 << 18, np.uint32), "used": 0}

    def library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, where = [], []
        for i, t in enumerate(texts):
            try:
                raw = t.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            # contractions are words of their own, and added tokens aren't cut: both are rare
            if raw is None or "'" in t or any(s in t for s in self.special):
                out[i] = self.library(t)
            else:
                plain.append(raw)
                where.append(i)
        if plain:
            at = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
            for i, ids in zip(where, self._plain(np.frombuffer(b"".join(plain), np.uint8), at), strict=True):
                out[i] = ids
        return out

    def _plain(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        data = self.lower[data]
        kind = self.kind[data]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        begins[at[at < len(data)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        word = kind[start] != _SPACE
        start, end = start[word], end[word]
        h, first, back = np.unique(self.ranges.over(data).hash(start, end), return_index=True, return_inverse=True)
        state = self.state
        if len(state["known"]) > REMEMBERED:
            self._forget()
        known = state["known"]
        number = np.fromiter(map(known.get, h.tolist(), repeat(-1)), np.int64, len(h))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn(h[new], data, start[first[new]], end[first[new]])
        number = number[back]
        length = state["length"][number].astype(np.int64)
        stop = np.cumsum(length)
        source = np.repeat(state["start"][number] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)
        ids = state["ids"][source]
        edge = np.concatenate([[0], stop])[np.searchsorted(start, at)]
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _learn(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Adds new words, and gives their numbers."""
        # Latin-1 to UTF-8: a character from 0x80 on takes two bytes
        high = data >= 0x80
        pos = np.concatenate([[0], np.cumsum(1 + high)])
        utf = np.zeros(pos[-1], np.uint8)
        utf[pos[:-1]] = np.where(high, 0xC0 | data >> 6, data)
        utf[pos[:-1][high] + 1] = 0x80 | data[high] & 0x3F
        a, n = pos[start], pos[end] - pos[start]
        ids: list[np.ndarray] = [None] * len(h)  # type: ignore[list-item]
        for low, top in ((0, 8), (8, 12), (12, 18), (18, 30), (30, LONGEST)):
            some = np.flatnonzero((n > low) & (n <= top))
            if len(some):
                grid = np.arange(max(top, 2))
                inside = grid < n[some][:, None]
                raw = utf[np.minimum(a[some][:, None] + grid, len(utf) - 1)]
                codes = np.where(inside, self.merges.inner[raw], -1)
                ends = n[some] - 1
                codes[np.arange(len(some)), ends] = self.merges.final[raw[np.arange(len(some)), ends]]
                made = self.merges.apply(codes.astype(np.int32))
                for i, k, row in zip(some.tolist(), (made >= 0).sum(1).tolist(), made, strict=True):
                    ids[i] = row[:k]
        for i in np.flatnonzero(n > LONGEST).tolist():
            ids[i] = self.library(data[start[i] : end[i]].tobytes().decode("latin-1"))
        state, base = self.state, len(self.state["known"])
        length = np.array([len(x) for x in ids], np.int32)
        flat = np.concatenate(ids).astype(np.uint32)
        for name, values, room in (("length", length, base), ("start", state["used"] + np.cumsum(length) - length, base), ("ids", flat, state["used"])):
            store = state[name]
            if room + len(values) > len(store):
                store = np.concatenate([store, np.zeros(max(len(store), room + len(values) - len(store)), store.dtype)])
                state[name] = store
            store[room : room + len(values)] = values
        state["used"] += len(flat)
        numbers = np.arange(base, base + len(h))
        state["known"].update(zip(h.tolist(), numbers.tolist(), strict=True))
        return numbers
