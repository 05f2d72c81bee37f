"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

A sequence of tokens is what the merges produce exactly if every two neighbours are what the merges produce of their bytes
together. So the encodings are the paths of a nondeterministic transducer whose states are a previous token and a place in
the trie of tokens. It is determinised while texts are read: a deterministic state is the set of hypotheses still possible,
each with the tokens it has not emitted yet; what all hypotheses agree on is emitted at once, so a token leaves after as many
bytes as it takes to rule out the others. States and steps are kept, up to a limit, and built again after that.

Null text is encoded like an empty one: no tokens. Texts of any length are read piece by piece; nothing depends on other rows.
"""

from __future__ import annotations

import base64
from array import array
from itertools import pairwise
from uuid import uuid4

import numpy as np
import regex
from pyspark.sql import DataFrame

from quern.llm.text import by_rows, held

#: Most states of the transducer, most remembered chunks of text, and the longest chunk that is remembered.
MOST_STATES, MOST_CHUNKS, LONGEST_CHUNK = 250_000, 200_000, 32
NEVER = 1 << 40
#: Marks that end a word and are pieces of their own.
ENDS = {".", ","}
#: Array type of 32-bit integers, least byte first.
UNSIGNED = "I"
assert array(UNSIGNED, [1]).tobytes() == b"\x01\0\0\0"
#: Tokens that the decoder takes at once.
BLOCK = 65_536
#: Keeps the machines of a Python worker.
OWNER = "bpe"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file with a base64 token and a rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges by their definition, lowest rank first and leftmost among equals; quadratic, for short inputs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in ranks]
        if not found:
            break
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def splits(ranks: dict[bytes, int]) -> dict[int, tuple[int, int] | None]:
    """For every token that the merges make: the two tokens that its last merge joins, None for a byte."""
    out: dict[int, tuple[int, int] | None] = {}
    for word, rank in ranks.items():
        if len(word) == 1:
            out[rank] = None
            continue
        ends = range(len(word) + 1)
        within = {w: ranks[w] for i in ends for j in ends[i + 1 :] if (w := word[i:j]) in ranks and w != word}
        parts = merged(word, within)
        if len(parts) == 2:
            out[rank] = ranks[parts[0]], ranks[parts[1]]
    return out


class Transducer:
    """Encodes one piece of text, bytes in and ranks out.

    A hypothesis is the token before, a place in the trie, and the tokens held back; a state is a tuple of hypotheses.
    """

    def __init__(self, ranks: dict[bytes, int], made: dict[int, tuple[int, int] | None] | None = None, most_states: int = MOST_STATES):
        self.ranks, self.most = ranks, most_states
        self.splits = splits(ranks) if made is None else made
        self.spelling = {v: k for k, v in ranks.items()}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}  # of a place in the trie
        above = [0]
        for rank in self.splits:
            at = 0
            for b in self.spelling[rank]:
                to = self.child.setdefault(at << 8 | b, len(above))
                if to == len(above):
                    above.append(at)
                at = to
            self.token[at] = rank
        self.front = self._fronts(above)
        self.emitted: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        self.alive: dict[int, bool] = {}
        self.reset()

    def _fronts(self, above: list[int]) -> list[tuple[list[int], int]]:
        """For each place in the trie, what its tokens have in common at the left end: the first tokens of their merges, and
        the lowest rank that any of them merges into next. Places are numbered from the root, so leaves come first here."""
        out: list[tuple[list[int], int]] = [([], NEVER)] * len(above)
        seen = [False] * len(above)

        def join(at: int, edge: list[int], then: int) -> None:
            if not seen[at]:
                out[at], seen[at] = (edge, then), True
                return
            known, low = out[at]
            n = 0
            for x, y in zip(known, edge, strict=False):
                if x != y:
                    break
                n += 1
            out[at] = known[:n], min(known[n] if n < len(known) else low, edge[n] if n < len(edge) else then)

        for at in range(len(above) - 1, 0, -1):
            if at in self.token:
                join(at, self._edge(self.token[at], 0), NEVER)
            if above[at]:
                join(above[at], *out[at])
        return out

    def reset(self) -> None:
        self.sets: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: dict[int, int] = {}  # twice the next state, and one more if tokens are emitted
        self.emit: dict[int, tuple[int, ...]] = {}
        self.last: dict[int, tuple[int, ...]] = {}
        self.emitted.clear()
        self.start = self._state(((-1, 0, ()),))

    def _state(self, hypotheses: tuple) -> int:
        n = self.number.setdefault(hypotheses, len(self.sets))
        if n == len(self.sets):
            self.sets.append(hypotheses)
        return n

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens at the left (0) or right (1) end of token, from its byte up to itself, in the order of their merges."""
        known = self.edges[side].get(token)
        if known is None:
            split = self.splits[token]
            known = self.edges[side][token] = [*(self._edge(split[side], side) if split else ()), token]
        return known

    def _meet(self, before: int, token: int) -> bool:
        """Whether a merge crosses from one token to the next, following both ends up in the order of ranks.

        While two end tokens stand next to each other, they merge if that comes before the next merge on either side; of
        equal ranks the left one is first. Ranks grow along an end, since a token ranks after its parts.
        """
        left, right, i, j = self._edge(before, 1), self._edge(token, 0), 0, 0
        while True:
            above = left[i + 1] if i + 1 < len(left) else NEVER
            beyond = right[j + 1] if j + 1 < len(right) else NEVER
            both = self.ranks.get(self.spelling[left[i]] + self.spelling[right[j]])
            if both is not None and both < above and both <= beyond:
                return True
            if above == beyond == NEVER:
                return False
            i, j = (i + 1, j) if above <= beyond else (i, j + 1)

    def _follows(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens apart, or the token stands at the start of a piece."""
        if len(self.fits) > self.most:
            self.fits.clear()
        known = self.fits[before << 32 | token] = before < 0 or not self._meet(before, token)
        return known

    def _lives(self, before: int, place: int) -> bool:
        """Whether the token before may be followed by a token that goes through the place; false only if none can be.

        The walk of _meet along what these tokens have in common.
        """
        if len(self.alive) > 2 * self.most:
            self.alive.clear()
        key = before << 32 | place
        left, (right, then), i, j = self._edge(before, 1), self.front[place], 0, 0
        while True:
            above = left[i + 1] if i + 1 < len(left) else NEVER
            beyond = right[j + 1] if j + 1 < len(right) else then
            both = self.ranks.get(self.spelling[left[i]] + self.spelling[right[j]])
            if both is not None and both < above and both <= beyond:
                self.alive[key] = False
                return False
            if above <= beyond and above != NEVER:
                i += 1
            elif above > beyond and j + 1 < len(right):
                j += 1
            else:
                self.alive[key] = True
                return True

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes a step: each hypothesis goes on with its token, or ends it before this byte, or both, or neither."""
        child, token, fits, alive = self.child.get, self.token.get, self.fits.get, self.alive.get
        again = child(byte)
        new, shared = [], 1 << 30
        for before, place, held in self.sets[state]:
            to = child(place << 8 | byte)
            if to is not None and (before < 0 or (self._lives(before, to) if (known := alive(before << 32 | to)) is None else known)):
                new.append((before, to, held))
                shared = min(shared, len(held))
            done = token(place)
            if done is not None:
                known = fits(before << 32 | done)
                if (self._follows(before, done) if known is None else known) and (self._lives(done, again) if (known := alive(done << 32 | again)) is None else known):
                    new.append((done, again, (*held, done)))
                    shared = min(shared, len(held) + 1)
        agreed, first = 0, new[0][2]
        while agreed < shared and all([h[2][agreed] == first[agreed] for h in new]):
            agreed += 1
        if agreed:
            new = [(b, p, h[agreed:]) for b, p, h in new]
        if full := len(self.sets) >= self.most:
            self.reset()
        to, out = self._state(tuple(new)), first[:agreed]
        if not full:
            key = state << 8 | byte
            self.step[key] = to << 1 | bool(out)
            if out:
                self.emit[key] = self.emitted.setdefault(out, out)
        return to, out

    def _end(self, state: int) -> tuple[int, ...]:
        for before, place, held in self.sets[state]:
            done = self.token.get(place)
            if done is not None and self._follows(before, done):
                self.last[state] = (*held, done)
                return self.last[state]
        raise ValueError("these ranks lack a byte")

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        state, out, step, emit = self.start, [], self.step, self.emit
        for byte in piece:
            key = state << 8 | byte
            found = step.get(key)
            if found is None:
                state, more = self._advance(state, byte)
                step, emit = self.step, self.emit
                out += more
            else:
                state = found >> 1
                if found & 1:
                    out += emit[key]
        out += self.last.get(state) or self._end(state)
        return out


class Chunks(dict):
    """Chunks of text and their packed ids; each starts with `lead`. Forgets all when it is full."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, chunk: str) -> bytes:
        tail = chunk[-1:]
        if tail in ENDS and (word := chunk[:-1]).isalpha():
            out = self[word] + self.encoder.ends[tail]
        elif chunk.isalpha():
            out = self.encoder.piece((self.lead + chunk).encode())
        else:
            out = self.encoder.pieces(self.lead + chunk)
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= MOST_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Encodes whole texts: the pattern cuts them into pieces, the transducer encodes each piece by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, made: dict[int, tuple[int, int] | None] | None = None):
        self.ranks, self.cut, self.machine = ranks, regex.compile(pattern).findall, Transducer(ranks, made)
        self.unclear = regex.compile(r" (?:[\s\x1c-\x1f\x85]|$)").search
        self.first, self.spaced = Chunks(self, ""), Chunks(self, " ")
        self.ends = {c: self.piece(c.encode()) for c in ENDS}
        # The short ways for words hold only for patterns that keep a word, with a blank before it, in one piece.
        if self.cut("aé aé,aé. aé") != ["aé", " aé", ",", "aé", ".", " aé"]:
            self.encode = lambda text: self.pieces(text or "")

    def piece(self, raw: bytes) -> bytes:
        """Packed ids of one piece. A piece that is a token is that token, whatever the merges say."""
        known = self.ranks.get(raw)
        return array(UNSIGNED, self.machine.encode(raw) if known is None else (known,)).tobytes()

    def pieces(self, text: str) -> bytes:
        """Packed ids of a stretch of text."""
        return b"".join([self.piece(x.encode()) for x in self.cut(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.unclear(text):
            return self.pieces(text)
        # A blank before anything but white space always begins a piece, so texts fall apart there.
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))


#: The UTF-8 state machine: 0 is between characters, 1 to 3 wait for so many continuation bytes, 4 to 7 for a restricted
#: second byte (after E0, ED, F0, F4), 8 is an error.
BETWEEN, ERROR = 0, 8


def _utf8_step(state: int, byte: int) -> int:
    if state == BETWEEN:
        if byte < 0x80:
            return BETWEEN
        special = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
        if byte in special:
            return special[byte]
        return 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 < byte < 0xF0 else 3 if 0xF0 < byte < 0xF4 else ERROR
    lo, hi, to = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2), ERROR: (1, 0, 0)}[state]
    return to if lo <= byte <= hi else ERROR


class Decoder:
    """Turns ids into bytes and text block by block; bytes of a character whose end has not come yet are held back."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.spelling: list[bytes] = [b""] * size
        for word, rank in ranks.items():
            self.spelling[rank] = word
        self.whole = np.array([self._run(BETWEEN, w)[0] == BETWEEN for w in self.spelling])
        self.restart()

    @staticmethod
    def _run(state: int, data: bytes) -> tuple[int, int]:
        """State after data, and how many of its last bytes belong to a character that is not complete."""
        held = 0
        for b in data:
            state = _utf8_step(state, b)
            held = 0 if state == BETWEEN else held + 1
            if state == ERROR:
                break
        return state, held

    def restart(self) -> None:
        self.state, self.held, self.valid = BETWEEN, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters that are complete by now. After an error (`valid` is false) bytes pass as they are."""
        data = b"".join(map(self.spelling.__getitem__, ids.tolist()))
        if not self.valid or (self.state == BETWEEN and self.whole[ids].all()):
            return data
        self.state, n = self._run(self.state, data)
        if self.state == ERROR:
            self.valid, out, self.held = False, self.held + data, b""
            return out
        if self.state != BETWEEN and n == len(data):
            self.held += data
            return b""
        out = self.held + data[: len(data) - n]
        self.held = data[len(data) - n :]
        return out

    def finish(self) -> bytes:
        """What is still held back; an incomplete character makes the result invalid."""
        out, self.held = self.held, b""
        self.valid &= self.state == BETWEEN
        return out

    def decode(self, packed: bytes) -> tuple[bytes, bool]:
        """The bytes of packed ids, and whether they are valid UTF-8."""
        self.restart()
        ids = np.frombuffer(packed, "<u4")
        parts = [self.feed(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
        parts.append(self.finish())
        return b"".join(parts), self.valid


def _machine(kind: type, sent, name: str, *more):
    """The machine of this Python worker for a broadcast vocabulary, made once; machines only remember what they would
    compute again."""
    machines: dict[type, tuple[str, object]] = held(OWNER)
    if kind not in machines or machines[kind][0] != name:
        ranks, made = sent.value
        machines[kind] = name, kind(ranks, *more, *([made] if kind is Encoder else []))
    return machines[kind][1]


def _sent(df: DataFrame, path: str, compiled: bool):
    """The vocabulary, read on the driver, with its compiled merges where they are needed, as a broadcast.

    It is a file of fixed size; its bound is proven before it is sent.
    """
    ranks = read_ranks(path)
    if len(ranks) > 1_000_000 or max(map(len, ranks)) > 1024:
        raise ValueError(f"{path} is too large to be broadcast")
    return df.sparkSession.sparkContext.broadcast((ranks, splits(ranks) if compiled else None))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in carry, `n_tokens` and `ids` (little-endian unsigned 32-bit integers) of every row."""
    sent, name = _sent(docs, path, True), uuid4().hex

    def work(texts: list[str | None]) -> list[list]:
        machine = _machine(Encoder, sent, name, pattern)
        packed = [machine.encode(t) for t in texts]
        return [[len(p) // 4 for p in packed], packed]

    return by_rows(docs, [text], [key, *carry], work, "n_tokens long, ids binary", OWNER)


def decode(tokens: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns in carry, `decoded` (bytes) and `valid` (whether they are UTF-8) of every row of packed ids."""
    sent, name = _sent(tokens, path, False), uuid4().hex

    def work(packed: list[bytes | None]) -> list[list]:
        machine = _machine(Decoder, sent, name)
        return list(map(list, zip(*(machine.decode(p or b"") for p in packed), strict=True)))

    return by_rows(tokens, [ids], list(carry), work, "decoded binary, valid boolean", OWNER)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """What encode() makes of every row and what decode() makes of that, in one pass of one Python worker."""
    sent, name = _sent(docs, path, True), uuid4().hex

    def work(texts: list[str | None]) -> list[list]:
        encoder, decoder = _machine(Encoder, sent, name, pattern), _machine(Decoder, sent, name)
        packed = [encoder.encode(t) for t in texts]
        decoded = [decoder.decode(p) for p in packed]
        return [[len(p) // 4 for p in packed], packed, [d for d, _ in decoded], [v for _, v in decoded]]

    return by_rows(docs, [text], [key, *carry], work, "n_tokens long, ids binary, decoded binary, valid boolean", OWNER)
