"""Byte-level BPE as a finite-state transducer, determinised while it runs, and UTF-8 as a state machine.

A byte string's BPE tokens are the only sequence of tokens in which every two neighbours stay apart when
they are merged alone: up to the first merge across a boundary, merges on either side run as they would
without the other.  So the merges compile into a transducer whose states are a token before and a node of
the trie of all tokens; a token may end where it stays apart from the one before.

This transducer guesses where tokens end.  A state of the determinised one is the set of guesses still
alive, and each byte emits the token that would end with it.  A token is final when all guesses alive go
back to it; a guess lives no longer than the longest token, and that is the lookahead.  States and steps are
made when a byte first asks for them.
"""

from __future__ import annotations

import numpy as np

#: Steps that are kept; beyond, all are forgotten and made anew.
STEPS = 400_000
#: Bytes between looks for final tokens.
BLOCK = 1 << 14

_NEVER = 1 << 62


class Merges:
    """Which tokens may stand side by side, from the ranks alone."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.piece = {i: t for t, i in ranks.items()}
        self.lives: dict[int, tuple | None] = {}
        self.known: dict[int, bool] = {}

    def merged(self, raw: bytes) -> tuple[list[bytes], list[int], list[tuple[bytes, bytes]]]:
        """The merges themselves, lowest rank and of equals the leftmost first: what is left, the ranks, and the first and last part after each."""
        parts, ranks, ends = [raw[i : i + 1] for i in range(len(raw))], [], []
        while len(parts) > 1:
            best, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ranks.append(best)
            ends.append((parts[0], parts[-1]))
        return parts, ranks, ends

    def ends_of(self, token: int) -> tuple | None:
        """The token's first and last parts on its way, each with the ranks at which they come and go; None if merges of its bytes don't make it.

        Ends are given only for tokens whose merges come in the order of their ranks; others have empty lists.
        """
        if token not in self.lives:
            raw = self.piece[token]
            parts, ranks, ends = self.merged(raw)
            if len(parts) > 1:
                self.lives[token] = None
            elif ranks != sorted(ranks):
                self.lives[token] = ([], [])
            else:
                both = []
                for side, begin in enumerate((raw[:1], raw[-1:])):
                    some, born = [], -1
                    for rank, pair in zip(ranks, ends, strict=True):
                        if pair[side] != begin:
                            some.append((begin, born, rank))
                            begin, born = pair[side], rank
                    both.append([*some, (begin, born, _NEVER)])
                self.lives[token] = tuple(both)
        return self.lives[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, one after the other, have just these two as their tokens."""
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > STEPS:
                self.known.clear()
            found = self.known[key] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        left, right = self.ends_of(a), self.ends_of(b)
        if right is None:
            return False
        if not left[1] or not right[0]:
            return self.merged(self.piece[a] + self.piece[b])[0] == [self.piece[a], self.piece[b]]
        for x, born, gone in left[1]:
            for y, from_, to in right[0]:
                # there at the same time; of equal ranks the leftmost merge comes first
                if born <= to and from_ < gone:
                    rank = self.ranks.get(x + y, _NEVER)
                    if rank < gone and rank <= to and rank < _NEVER:
                        return False
        return True


class Transducer:
    """Tokens of byte strings, byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.whole = ranks
        self.size = {i: len(t) for t, i in ranks.items()}
        child: dict[int, int] = {}
        token, depth, inner = [-1], [0], bytearray(1)
        for raw, i in ranks.items():
            node = 0
            for n, b in enumerate(raw, 1):
                inner[node] = 1
                node = child.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
                    depth.append(n)
                    inner.append(0)
            token[node] = i
        #: By node and byte: the next node, whether longer tokens go on from it, and the token that it is.
        self.arc = {key: (node, inner[node], token[node]) for key, node in child.items()}
        self.depth = depth
        #: The most bytes that a token waits for.
        self.lookahead = max(depth)
        self._forget()

    def _forget(self) -> None:
        # a state is a dictionary: by byte the next state and the token, under -1 its guesses
        self.states: dict[tuple, dict] = {}
        self.made = 0
        self.start = self._state(((0, -1),))

    def _state(self, guesses: tuple) -> dict:
        s = self.states.get(guesses)
        if s is None:
            s = self.states[guesses] = {-1: guesses}
        return s

    def _step(self, s: dict, b: int) -> tuple[dict, int]:
        """The state after a byte, and the token that ends with it."""
        merges, arc, alive, out = self.merges, self.arc, [], -1
        for node, before in s[-1]:
            to = arc.get(node << 8 | b)
            if to is not None:
                if to[1]:
                    alive.append((to[0], before))
                # of the guesses that end here, one alone holds
                if out < 0 and to[2] >= 0 and (merges.ends_of(to[2]) is not None if before < 0 else merges.apart(before, to[2])):
                    out = to[2]
        alive.append((0, out))
        self.made += 1
        found = s[b] = self._state(tuple(alive)), out
        return found

    def _back(self, ending: list[int], at: int) -> list[int]:
        """The tokens up to a boundary, each the one that ended where the next begins."""
        out = []
        while at > 0:
            out.append(ending[at - 1])
            at -= self.size[out[-1]]
        return out[::-1]

    def _final(self, ending: list[int], s: dict) -> int:
        """The last boundary to which all guesses alive go back."""
        begun = {len(ending) - self.depth[node] for node, _ in s[-1]}
        while len(begun) > 1:
            last = max(begun)
            begun.remove(last)
            begun.add(last - self.size[ending[last - 1]])
        return begun.pop()

    def encode(self, raw: bytes) -> list[int]:
        """The tokens of one match of the pattern; a match that is a token itself is that token."""
        if raw in self.whole:
            return [self.whole[raw]]
        if self.made > STEPS:
            self._forget()
        s, out, ending = self.start, [], []
        for at in range(0, len(raw), BLOCK):
            if at:
                final = self._final(ending, s)
                out += self._back(ending, final)
                del ending[:final]
                if self.made > STEPS:
                    alive = s[-1]
                    self._forget()
                    s = self._state(alive)
            for b in raw[at : at + BLOCK]:
                s, token = s.get(b) or self._step(s, b)
                ending.append(token)
        return out + self._back(ending, len(ending))


#: States of the UTF-8 machine: between characters; so many bytes to come (1, 2, 3); after E0, ED, F0, F4, whose next byte is bound; wrong.
WHOLE, WRONG = 0, 8


def utf8_machine() -> np.ndarray:
    """The next state by state and byte."""
    to = np.full((9, 256), WRONG, np.uint8)
    to[0, :0x80] = 0
    to[0, 0xC2:0xE0] = 1
    to[0, 0xE0:0xF0] = 2
    to[0, 0xF0:0xF5] = 3
    for lead, state in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
        to[0, lead] = state
    for state, low, high, then in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        to[state, low:high] = then
    return to


class Pieces:
    """Bytes of all tokens end to end, and what each token does to the UTF-8 machine."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        by_id: list[bytes] = [b""] * n
        for t, i in ranks.items():
            by_id[i] = t
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        machine = utf8_machine()
        to = np.tile(np.arange(9, dtype=np.uint8), (n, 1))
        for k in range(int(self.size.max())):
            some = np.flatnonzero(self.size > k)
            to[some] = machine[to[some], self.data[self.begin[some] + k][:, None]]
        self.to = to

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


class Decoder:
    """Bytes of a stream of ids, given out in whole characters: a character's first bytes wait for the others.

    Once the bytes can't be UTF-8 any more (``state`` is WRONG), they are given out as they come.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.state, self.waiting = pieces, WHOLE, b""

    def feed(self, ids: np.ndarray) -> bytes:
        """What is whole after these ids."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.pieces.size)) or not self.pieces.size[ids].all():
            raise ValueError("an id that the vocabulary doesn't have")
        to, state, i = self.pieces.to, self.state, 0
        odd = np.flatnonzero(to[ids, WHOLE] != WHOLE).tolist()  # all others leave a whole state whole
        k = 0
        while i < len(ids) and state != WRONG:
            if state == WHOLE:
                while k < len(odd) and odd[k] < i:
                    k += 1
                if k == len(odd):
                    break
                i = odd[k]
            state = int(to[ids[i], state])
            i += 1
        self.state = state
        data = self.waiting + self.pieces.bytes_of(ids).tobytes()
        cut = len(data)
        if state not in (WHOLE, WRONG):
            while data[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            cut -= 1  # the character's first byte
        self.waiting = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        """What was waiting; without a whole last character, the bytes aren't UTF-8."""
        rest, self.waiting = self.waiting, b""
        if self.state != WHOLE:
            self.state = WRONG
        return rest
