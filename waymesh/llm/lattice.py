"""Sums over all segmentations of words into the pieces of a fixed public vocabulary.

A word is a space and its bytes; a piece that begins a word has the space too.  Any single byte is a
piece as well, so that every word has a segmentation.  The pieces that lie in many words are found
together, by walking a trie from every byte of all words at once; the recursion then goes from one place
in the words to the next, again for all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import textbuf

U64 = np.uint64
#: Sums of words up to so many bytes are kept as they are, scaled; those of longer ones as logarithms.
SHORT = 48
#: Sums are kept multiplied by this to the power of the bytes covered.
SCALE = 16.0
#: Bytes of words that are handled together; a longer word is handled alone.
TOGETHER = 1 << 15
#: Words whose sums are remembered at once.
REMEMBERED = 150_000


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces without capitals, and their probabilities by the vocabulary's own scores.

    The scores of the file are negative ranks; a rank r stands for a frequency of 1 / (r + 10) (Zipf's law).
    Control, unknown and byte pieces and runs of spaces aren't used.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.get_score(i) < -1e8:
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if raw and b" " not in raw[1:] and raw == raw.lower():
            pieces.append(raw)
            ranks.append(-model.get_score(i))
    weight = 1 / (np.array(ranks) + 10)
    return pieces, weight / weight.sum()


class Lattice:
    """Pieces by number: the given ones in order, then the 256 single bytes."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces) + 256
        self.length = np.array([*(len(p) for p in pieces), *[1] * 256])
        child: dict[int, int] = {}  # of a node and a byte
        ends = [-1]
        for n, p in enumerate(pieces):
            at = 0
            for b in p:
                key = at << 8 | b
                at = child.get(key, 0)
                if not at:
                    at = child[key] = len(ends)
                    ends.append(-1)
            ends[at] = n
        #: The piece that ends at each node, or -1.
        self.ends = np.array(ends, np.int32)
        # direct tables of edges: what doesn't find its slot free in one goes to the next
        keys, to = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child))
        bits = max(8, len(child).bit_length() + 2)
        self.shift, self.tables = U64(64 - bits), []
        while len(keys):
            table = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            slot, first = np.unique(self._slot(keys, len(self.tables)), return_index=True)
            table[0][slot], table[1][slot] = keys[first], to[first]
            self.tables.append(table)
            keys, to = np.delete(keys, first), np.delete(to, first)

    def _slot(self, key: np.ndarray, table: int) -> np.ndarray:
        odd = (0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4E * table) % 2**64
        return ((key.view(U64) * U64(odd)) >> self.shift).astype(np.int64)

    def arcs(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, ends and numbers of all pieces in *data*, the single bytes first; none goes beyond the *limit* of its first place."""
        place, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        found = [(place, place + 1, self.size - 256 + data.astype(np.int64))]
        depth = 0
        while len(place):
            key = node << 8 | data[place + depth]
            node = np.zeros(len(place), np.int64)
            missing = np.arange(len(place))
            for n, (keys, to) in enumerate(self.tables):
                slot = self._slot(key[missing], n)
                there = keys[slot]
                hit = there == key[missing]
                node[missing[hit]] = to[slot[hit]]
                missing = missing[~hit & (there >= 0)]  # an edge would have taken a free slot
            depth += 1
            on = node > 0
            place, node = place[on], node[on]
            piece = self.ends[node]
            whole = piece >= 0
            found.append((place[whole], place[whole] + depth, piece[whole].astype(np.int64)))
            more = place + depth < limit[place]
            place, node = place[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def scaled(self, probability: np.ndarray) -> np.ndarray:
        """Rows for the recursion, from one row for each piece."""
        p = np.asarray(probability, float).reshape(self.size, -1)
        return p * (SCALE ** self.length)[:, None]

    def _batches(self, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """Words by number that are handled together, and whether they are long."""
        n = end - start
        for long in (False, True):
            some = np.flatnonzero((n > SHORT) == long)
            some = some[np.argsort(n[some], kind="stable")]
            total = np.cumsum(n[some])
            at = 0
            while at < len(some):
                done = total[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(total, done + TOGETHER, "right")))
                yield some[at:stop], long
                at = stop

    def _laid(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Words end to end: nodes before and after each, then arcs between nodes, their pieces and words, in the order of their first place's offset, and the slices of each offset."""
        n = end - start
        stop = np.cumsum(n)
        begin = stop - n
        owner = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(owner)) - begin[owner]
        a, b, piece = self.arcs(data[start[owner] + offset], stop[owner])
        order = np.argsort(offset[a], kind="stable")
        a, b, piece = a[order], b[order], piece[order]
        word = owner[a]
        longest = int(n.max(initial=0))
        cuts = np.searchsorted(offset[a], np.arange(longest + 1))
        # of one place, single bytes come first, and all other pieces have different ends
        middle = cuts[:-1] + np.bincount(offset, minlength=longest)
        steps = list(zip(cuts[:-1].tolist(), middle.tolist(), cuts[1:].tolist(), strict=True))
        # nodes: a place and the number of words before it
        return begin + np.arange(len(n)), stop + np.arange(len(n)), a + word, b + word, piece, word, steps

    def forward(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Natural logarithms of the sums for words ``data[start:end]`` (with their spaces), for each column of scaled *weights*."""
        out = np.zeros((len(start), weights.shape[1]))
        log = None
        for some, long in self._batches(start, end):
            n = (end - start)[some]
            if long:
                with np.errstate(divide="ignore"):
                    log = np.log(weights) if log is None else log
                out[some] = self._logs(data, start[some], end[some], log)
            else:
                first, last, a, b, piece, _, steps = self._laid(data, start[some], end[some])
                sums = np.zeros((int(n.sum()) + len(n), weights.shape[1]))
                sums[first] = 1
                for step in steps:
                    for lo, hi in zip(step, step[1:], strict=False):
                        sums[b[lo:hi]] += sums[a[lo:hi]] * weights[piece[lo:hi]]
                out[some] = np.log(sums[last])
            out[some] -= (n * np.log(SCALE))[:, None]
        return out

    def log_forward(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """The same by a recursion over logarithms, from logarithms of unscaled probabilities, one for each piece."""
        out = np.zeros(len(start))
        for some, _ in self._batches(start, end):
            out[some] = self._logs(data, start[some], end[some], log_p[:, None])[:, 0]
        return out

    def _logs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, log: np.ndarray) -> np.ndarray:
        first, last, a, b, piece, _, steps = self._laid(data, start, end)
        sums = np.full((int((end - start).sum()) + len(start), log.shape[1]), -np.inf)
        sums[first] = 0
        for step in steps:
            for lo, hi in zip(step, step[1:], strict=False):
                sums[b[lo:hi]] = np.logaddexp(sums[b[lo:hi]], sums[a[lo:hi]] + log[piece[lo:hi]])
        return sums[last]

    def expected(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur *count* times, under one column of scaled weights."""
        uses = np.zeros(self.size)
        w = weights[:, 0]
        with np.errstate(divide="ignore"):
            log = np.log(w)
        for some, long in self._batches(start, end):
            if not (end - start)[some].any():
                continue
            first, last, a, b, piece, word, steps = self._laid(data, start[some], end[some])
            nodes = int((end - start)[some].sum()) + len(some)
            if long:
                alpha, beta = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
                alpha[first] = beta[last] = 0
                for step in steps:
                    for lo, hi in zip(step, step[1:], strict=False):
                        alpha[b[lo:hi]] = np.logaddexp(alpha[b[lo:hi]], alpha[a[lo:hi]] + log[piece[lo:hi]])
                for lo, _, hi in reversed(steps):
                    np.logaddexp.at(beta, a[lo:hi], beta[b[lo:hi]] + log[piece[lo:hi]])
                share = np.exp(alpha[a] + log[piece] + beta[b] - alpha[last][word])
            else:
                alpha, beta = np.zeros(nodes), np.zeros(nodes)
                alpha[first] = beta[last] = 1
                for step in steps:
                    for lo, hi in zip(step, step[1:], strict=False):
                        alpha[b[lo:hi]] += alpha[a[lo:hi]] * w[piece[lo:hi]]
                for lo, _, hi in reversed(steps):
                    np.add.at(beta, a[lo:hi], beta[b[lo:hi]] * w[piece[lo:hi]])
                share = alpha[a] * w[piece] * beta[b] / alpha[last][word]
            uses += np.bincount(piece, count[some][word] * share, minlength=self.size)
        return uses


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of *data* laid out anew, each after a space: the bytes, starts (at the space) and ends."""
    length = end - start + 1
    stop = np.cumsum(length)
    begin = stop - length
    out = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint8)
    place = np.arange(len(out)) - np.repeat(begin, length)
    inner = place > 0
    out[inner] = data[(np.repeat(start, length) + place - 1)[inner]]
    return out, begin, stop


class Memo:
    """Sums of words by their hash, so that a task computes a frequent word once."""

    def __init__(self, lattice: Lattice, weights: np.ndarray):
        self.lattice, self.weights = lattice, weights
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.store = np.zeros((1 << 14, self.weights.shape[1]))

    def sums(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        from itertools import repeat

        value, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        number = np.fromiter(map(self.known.get, value.tolist(), repeat(-1)), np.int64, len(value))
        new = np.flatnonzero(number < 0)
        if len(new):
            made = self.lattice.forward(*spaced(data, start[first[new]], end[first[new]]), self.weights)
            base = len(self.known)
            while base + len(new) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[base : base + len(new)] = made
            number[new] = np.arange(base, base + len(new))
            self.known.update(zip(value[new].tolist(), number[new].tolist(), strict=True))
        return self.store[number[back]]
