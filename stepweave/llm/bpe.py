"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 state machine.

The merges (pairs of tokens by rank) are compiled into a transducer that reads one byte at a time. Two facts make that
possible: a token sequence is the BPE encoding of its bytes just when each two neighbours alone are that of theirs; and so
the encoding of a prefix is that of a shorter prefix and one more token, which is the only one that goes with the token
before. A state holds the earlier prefixes from which a token may still be under way; what their encodings have in common is
certain whatever follows, so a token can be emitted after a bounded look ahead. States are made when a text first asks for
them, and kept, up to a bound.

Texts are first cut by the tokenizer's pattern, which no token crosses; for PATTERN that is done for many texts at once, by
the classes of their characters. Each different piece of a batch goes through the transducer once.

Defined cases: null text: null ids, no tokens. Empty text: no tokens. Very long texts: whole; a batch holds one at least, in
some 60 bytes a character. Repeated rows: each is encoded. Empty tables: no rows. Null or any ids of documents: they play no
part. Ties between merges: the one further left. Unknown ids in decoding: an error. Bytes that are no UTF-8: U+FFFD, once
for each maximal invalid part. Other columns stay; result columns replace those of the same name, in whatever case.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepweave.llm.common import TEXT, carried, column, kept, map_arrow, others, quoted, slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Steps of the transducer that a worker keeps; they are made again when asked for again.
KEPT_STEPS = 200_000
#: Pieces of more bytes go through the transducer alone, the others side by side.
SIDE_BY_SIDE = 64
#: Below a node of the trie with so many tokens, what may precede them is told apart only as far as it matters.
FEW_BELOW = 8
_CLASSES: dict[tuple[str, int], str] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _class(prop: str, limit: int) -> str:
    """The characters below limit of a Unicode property as the inside of a character class."""
    if (prop, limit) not in _CLASSES:
        every = "".join(map(chr, (i for i in range(limit) if not 0xD800 <= i < 0xE000)))
        _CLASSES[prop, limit] = "".join(f"\\U{ord(m.group()[0]):08x}-\\U{ord(m.group()[-1]):08x}" for m in regex.finditer(rf"\p{{{prop}}}+", every))
    return _CLASSES[prop, limit]


def compile_pattern(pattern: str, limit: int = sys.maxunicode + 1) -> re.Pattern:
    """The pattern for the standard library's engine, which is the faster one but lacks Unicode properties: they become ranges.

    Right for texts of characters below limit; few ranges are faster than many.
    """
    out, inside = [], False
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        prop = "White_Space" if token in ("\\s", "\\S") else token[3:-1] if token.startswith("\\p{") else None
        if prop:
            chars = _class(prop, limit)
            out.append(chars if inside else f"[{'^' * (token == chr(92) + 'S')}{chars}]")
        else:
            inside = token == "[" or inside and token != "]"
            out.append(token)
    return re.compile("".join(out))


def merge(piece: bytes, ranks: dict[bytes, int], most: int = 1) -> list[int]:
    """BPE as it is defined: again and again the first of the pairs of lowest rank. What the transducer must equal.

    most: it stops at so many tokens.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > most:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class _Steps:
    """The transducer's steps by state << 8 | byte, as a hash table with open addresses that many look-ups go through at once."""

    def __init__(self, bits: int = 19):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, or -1."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def add(self, keys: list[int], values: list[int]) -> None:
        """New keys, each once."""
        if 2 * (self.count + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, values = [*self.keys[old].tolist(), *keys], [*self.values[old].tolist(), *values]
            self.__init__(max(self.bits + 1, (2 * len(keys)).bit_length()))
        for key, value, at in zip(keys, values, self._slots(np.array(keys, np.int64)).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, value
        self.count += len(keys)


class Transducer:
    """States are numbers; next[state << 8 | byte] is the next state << 20 | the token that ends there.

    Each prefix of a piece ends with one token of its encoding, and before that token it is an earlier prefix's. So what is
    emitted at each byte is the token that ends there, and the piece's encoding follows from the last one backwards. A state
    has the places from which a longer token may still be under way: for each its node in the tokens' trie and the token
    before it. Tokens before a node that go with the same tokens below it count as the same one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("ranks must be below 2**20")
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        #: The tokens' trie: child[node << 8 | byte] is (node, the token's rank or -1, whether a longer token begins so).
        node_of, more = {b"": 0}, {t[:k] for t in ranks for k in range(1, len(t))}
        for x in sorted(more | ranks.keys(), key=len):
            node_of[x] = len(node_of)
        self.depth = [len(x) for x in node_of]
        self.child = {node_of[x[:-1]] << 8 | x[-1]: (k, ranks.get(x, -1), x in more) for x, k in node_of.items() if x}
        #: Tokens below a node, where they are few.
        below: dict[int, list[int]] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if len(found := below.setdefault(node_of[t[:k]], [])) <= FEW_BELOW:
                    found.append(i)
        self.below = {k: tuple(x) for k, x in below.items() if len(x) <= FEW_BELOW}
        self.reachable: dict[bytes, bool] = {}
        self.goes: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        self.goes.clear()
        self.states: list[tuple[tuple[int, int | None], ...]] = []
        self.known: dict[tuple, int] = {}
        self.next: dict[int, int] = {}
        self.steps = _Steps()
        self.alike: dict[tuple[int, int | None], int | None] = {}  # (node, token before it): a token that counts as the same, -1 if nothing can follow
        self.first_alike: dict[tuple, int | None] = {}
        self._state(((0, None),))

    def _state(self, key: tuple) -> int:
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def _like(self, node: int, before: int | None) -> int | None:
        if node not in self.below:
            return before
        key = (node, before)
        if key not in self.alike:
            fits = tuple(x for x in self.below[node] if self._together(before, x))
            self.alike[key] = self.first_alike.setdefault((node, fits), before) if fits else -1
        return self.alike[key]

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes the token; itself twice if it is a single byte."""
        if token not in self.parts:
            t = self.bytes[token]
            two = merge(t, self.ranks, 2)
            self.parts[token] = (two[0], two[1]) if len(two) == 2 else (token, token)
        return self.parts[token]

    def _together(self, a: int | None, b: int) -> bool:
        """Whether b may follow a; None: the piece's begin.

        Merges are undone from the last one, at the side where it was; the two stay apart unless the tokens that then meet
        would have merged before that.
        """
        if a is None:
            t = self.bytes[b]
            if t not in self.reachable:
                self.reachable[t] = merge(t, self.ranks) == [b]
            return self.reachable[t]
        key = (a, b)
        if (known := self.goes.get(key)) is not None:
            return known
        limit, fine = 1 << 62, True
        while True:
            joined = self.ranks.get(self.bytes[a] + self.bytes[b])
            if joined is not None and joined < limit:
                fine = False
                break
            left, right = self._parts(a)[1], self._parts(b)[0]
            if left == a and right == b:
                break
            # of equal ranks the merge further left comes first, so a's own is done before the one across
            if right == b or (left != a and a > b):
                a, limit = left, a
            else:
                b, limit = right, b + 1
        self.goes[key] = fine
        return fine

    def _make(self, state: int, byte: int) -> int:
        token, kept, child = -1, [], self.child
        for node, before in self.states[state]:
            found = child.get(node << 8 | byte)
            if found is None:
                continue  # no token can begin there any more
            to, rank, more = found
            if rank >= 0 and token < 0 and self._together(before, rank):  # the longest token first
                token = rank
            if more and (like := self._like(to, before)) != -1:
                kept.append((to, like))
        if token < 0:
            raise ValueError("the vocabulary lacks a token for some byte")
        kept.append((0, token))
        return self._state(tuple(kept)) << 20 | token

    def _walk(self, state: int, part: bytes) -> tuple[int, list[int]]:
        out, step_of = [], self.next
        for byte in part:
            step = step_of.get(state << 8 | byte)
            if step is None:
                step = step_of[state << 8 | byte] = self._make(state, byte)
            state = step >> 20
            out.append(step & 0xFFFFF)
        return state, out

    def _fresh(self) -> None:
        if len(self.next) + self.steps.count > KEPT_STEPS:
            self.reset()

    def encode(self, piece: bytes) -> list[int]:
        self._fresh()
        return self._back(self._walk(0, piece)[1], len(piece))

    def encode_many(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many pieces (in the bytes raw) one after the other, and how many each has: all take a step at a time."""
        self._fresh()
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        widest = int(size[0]) if len(size) else 0
        left = np.searchsorted(-size, -np.arange(widest), side="left")  # how many have a byte at each place
        state, ends = np.zeros(len(size), np.int64), np.zeros((widest, len(size)), np.int32)
        for i, n in enumerate(left.tolist()):
            keys = state[:n] << 8 | raw[begin[:n] + i]
            step = self.steps.find(keys)
            lost = step < 0
            if lost.any():
                new = np.unique(keys[lost]).tolist()
                self.steps.add(new, [self._make(k >> 8, k & 255) for k in new])
                step[lost] = self.steps.find(keys[lost])
            state[:n] = step >> 20
            ends[i, :n] = step & 0xFFFFF
        # backwards from each piece's last token
        rows, at, found = np.arange(len(size)), size.astype(np.int64), []
        while len(rows):
            token = ends[at - 1, rows]
            found.append((rows, token))
            at = at - self.lengths[token]
            rows, at = rows[at > 0], at[at > 0]
        many = np.zeros(len(size), np.int64)
        for rows, _ in found:
            many[rows] += 1
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        counts = many[place]
        upto = np.cumsum(counts)
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.int32)
        ending = upto[order]
        for k, (rows, token) in enumerate(found):
            out[ending[rows] - 1 - k] = token
        return out, counts

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that comes part by part, each as soon as it is certain whatever follows.

        That is where the encodings of all prefixes from which a token may still be under way agree.
        """
        self._fresh()
        state, ends = 0, []  # ends: since what has been emitted
        for part in parts:
            state, more = self._walk(state, part)
            ends += more
            live = {len(ends) - self.depth[node] for node, _ in self.states[state]}
            while len(live) > 1:
                live.add((at := max(live)) - len(self.bytes[ends[at - 1]]))
                live.remove(at)
            sure = live.pop()
            yield from self._back(ends, sure)
            del ends[:sure]
        yield from self._back(ends, len(ends))

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the prefix of so many bytes."""
        out = []
        while at:
            out.append(token := ends[at - 1])
            at -= len(self.bytes[token])
        return out[::-1]


_LETTER, _NUMBER, _SPACE = 1, 2, 3
_KINDS: list[np.ndarray] = []  # of this process: each code point's kind, 0 for others


def _kinds() -> np.ndarray:
    if not _KINDS:
        kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
        for kind, prop in ((_LETTER, "L"), (_NUMBER, "N"), (_SPACE, "White_Space")):
            for m in regex.finditer(rf"\p{{{prop}}}+", every):
                kinds[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = kind
        kinds[0xD800:0xE000] = 0
        _KINDS.append(kinds)
    return _KINDS[0]


def piece_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where PATTERN's pieces begin in the code points of texts that follow each other; first: whether a text begins there."""
    kind = _kinds()[cps]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    # of white space before something else the last character is apart, and a blank belongs to what follows
    after = np.flatnonzero(run[1:] & ~first[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    begin[after - 1] = True
    begin[after[cps[after - 1] == 0x20]] = False
    # an apostrophe alone and what it shortens
    mark = np.flatnonzero((cps == 0x27) & begin)
    mark = mark[mark + 1 < len(cps)]
    mark = mark[run[mark] & run[mark + 1] & ~first[mark + 1]]
    if len(mark):
        a = cps[mark + 1]
        beyond = np.minimum(mark + 2, len(cps) - 1)
        b = np.where((mark + 2 < len(cps)) & ~first[beyond], cps[beyond], 0)
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        hit = one | two
        begin[mark[hit] + 1] = False
        end = mark[hit] + np.where(two[hit], 3, 2)
        begin[end[end < len(cps)]] = True
    return begin


class Encoder:
    """Text to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.transducer = ranks, Transducer(ranks)
        self.source, self.patterns = pattern, {}
        self.tokens, self.ids = pa.array(list(ranks), pa.large_binary()), np.array(list(ranks.values()), np.int32)

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.transducer.encode(raw)

    def split(self, text: str) -> list[str]:
        limit = 0x80 if text.isascii() else next(x for x in (0x100, 0x10000, sys.maxunicode + 1) if ord(max(text)) < x)
        if limit not in self.patterns:
            self.patterns[limit] = compile_pattern(self.source, limit)
        return self.patterns[limit].findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.piece(x.encode("utf-8", "replace")) for x in self.split(text)))

    def stream(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes part by part, for PATTERN. What follows may change its last two pieces; they wait."""
        held = ""
        for part in parts:
            pieces = self.split(held + part)
            held = "".join(pieces[-2:])
            yield list(chain.from_iterable(self.piece(x.encode("utf-8", "replace")) for x in pieces[:-2]))
        yield self.encode(held)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many ids are before each one (and in all). Null is as empty."""
        if self.source != PATTERN:
            each = [np.array(self.encode(t or ""), np.int32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.cumsum([0, *map(len, each)])
        raw, bounds = raw_of(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        cps = np.frombuffer(bytes(raw).decode().encode("utf-32-le"), np.uint32)
        at = None if len(cps) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)  # each character's first byte
        begins = np.unique(bounds[:-1][bounds[:-1] < bounds[1:]])
        first = np.zeros(len(cps), bool)
        first[begins if at is None else np.searchsorted(at, begins)] = True
        starts = np.flatnonzero(piece_starts(cps, first))
        del cps, first
        starts = np.append(starts if at is None else at[starts], len(raw))
        del at
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        flat, lengths = self._different(pieces.dictionary)
        which = pieces.indices.to_numpy(zero_copy_only=False)
        many = lengths[which]
        upto = np.concatenate([[0], np.cumsum(many)])
        shift = (np.cumsum(lengths) - lengths)[which] - upto[:-1]
        return flat[np.repeat(shift, many) + np.arange(upto[-1])], upto[np.searchsorted(starts, bounds)]

    def _different(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, each once, one after the other, and how many each has."""
        offsets, raw = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1], np.frombuffer(pieces.buffers()[2], np.uint8)
        found = pc.index_in(pieces, value_set=self.tokens)
        whole = found.is_valid().to_numpy(zero_copy_only=False)
        size = np.diff(offsets)
        some, long = np.flatnonzero(~whole & (size <= SIDE_BY_SIDE)), np.flatnonzero(~whole & (size > SIDE_BY_SIDE))
        ids, counts = self.transducer.encode_many(raw, offsets[some], size[some])
        alone = [self.transducer.encode(raw[offsets[k] : offsets[k + 1]].tobytes()) for k in long.tolist()]
        lengths = np.ones(len(pieces), np.int64)
        lengths[some], lengths[long] = counts, [len(x) for x in alone]
        begin = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        flat[begin[whole]] = self.ids[found.drop_null().to_numpy(zero_copy_only=False)]
        flat[np.repeat(begin[some] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        for k, x in zip(long.tolist(), alone, strict=True):
            flat[begin[k] : begin[k] + len(x)] = x
        return flat, lengths


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends). Null is as empty."""
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Utf8Stream:
    """Text of bytes that come bit by bit; what a character lacks at a part's end is waited for.

    The state is how many bytes the character under way still lacks and in what range the next one must be.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def lacking(tail: bytes) -> int:
        """How many of the last bytes begin a character that isn't complete (0 to 3)."""
        for k in range(1, min(3, len(tail)) + 1):
            lead = tail[-k]
            if lead & 0xC0 == 0x80:
                continue
            length = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if length <= k:
                return 0
            if k > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= tail[-k + 1] <= high:
                    return 0
            return k
        return 0

    def feed(self, part: bytes) -> str:
        data = self.held + part
        k = self.lacking(data[-3:])
        self.held = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to text."""

    def __init__(self, ranks: dict[bytes, int]):
        table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            table[i] = t
        self.table, self.tokens = table, pa.array(table, pa.large_binary())

    def raw(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each one's begin (and the last ends)."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.table)):
            raise KeyError(f"no token has the id {int(ids.max()) if int(ids.max()) >= len(self.table) else int(ids.min())}")
        found = self.tokens.take(pa.array(ids))
        if found.null_count:
            raise KeyError(f"no token has the id {int(ids[found.is_null().to_numpy(zero_copy_only=False)][0])}")
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]
        return np.frombuffer(found.buffers()[2], np.uint8)[: offsets[-1]], offsets

    def stream(self, ids: Iterable[int], at_once: int = 4096) -> Iterator[str]:
        """The text, as soon as its characters are complete. The ids may come from anywhere, bit by bit."""
        utf8, ids = Utf8Stream(), iter(ids)
        while part := list(islice(ids, at_once)):
            yield utf8.feed(bytes(self.raw(np.array(part, np.int64))[0]))
        yield utf8.end()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


def _encoder(ranks_path: str, pattern: str, ranks) -> Encoder:
    coders = kept("bpe")  # tasks follow each other in a worker
    if (ranks_path, pattern) not in coders:
        coders.clear()
        coders[ranks_path, pattern] = Encoder(ranks.value, pattern)
    return coders[ranks_path, pattern]


def _same(texts: pa.Array, ids: np.ndarray, upto: np.ndarray, decoder: Decoder) -> list[bool]:
    """Whether the ids give each text's bytes again."""
    (raw, bounds), (back, at) = raw_of(texts), decoder.raw(ids)
    ends = at[upto]
    if len(raw) == len(back) and np.array_equal(bounds, ends) and np.array_equal(raw, back):
        return [True] * len(texts)
    return [np.array_equal(raw[a:b], back[c:d]) for a, b, c, d in zip(bounds[:-1], bounds[1:], ends[:-1], ends[1:], strict=True)]


def _run(ranks_path: str, rank_list, pattern: str, fields: list[tuple[str, str | None]], check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, rank_list)
        decoder = Decoder(rank_list.value) if check else None
        for b in slices(batches, TEXT):
            texts = column(b, TEXT)
            ids, upto = encoder.batch(texts)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(upto.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(upto.astype(np.int32))
            made = {"n_tokens": pa.array(np.diff(upto).astype(np.int32)), "token_ids": pa.ListArray.from_arrays(offsets, pa.array(ids))}
            if check:
                made["round_trip"] = pa.array([None if x else y for x, y in zip(null, _same(texts, ids, upto, decoder), strict=True)], pa.bool_())
            yield pa.record_batch([made[n] if c is None else column(b, c) for n, c in fields], names=[n for n, _ in fields])

    return run


def encode_documents(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN, text_col: str = "text", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The columns keep (all by default) with n_tokens and token_ids, and, with check, whether decoding gives the text back."""
    made = [T.StructField("n_tokens", T.IntegerType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))] + [T.StructField("round_trip", T.BooleanType())] * check
    stay = [docs.schema[n] for n in others(docs, [f.name for f in made]) if keep is None or n in keep]
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows, names = carried(docs, text_col, [f.name for f in stay])
    fields = [*((f.name, c) for f, c in zip(stay, names, strict=True)), *((f.name, None) for f in made)]
    return map_arrow(rows, _run(ranks_path, shared, pattern, fields, check), T.StructType(stay + made), "bpe")


def decode_documents(docs: DataFrame, ranks_path: str = RANKS, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """docs with the text of their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    stay = [docs.schema[n] for n in others(docs, [text_col])]
    rows = docs.select(quoted(ids_col).cast("array<int>").alias("ids"), *[quoted(f.name).alias(f"c{k}") for k, f in enumerate(stay)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            ids = column(b, "ids")
            raw, at = decoder.raw(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ends = at[upto]
            texts = [None if x else bytes(raw[i:j]).decode("utf-8", "replace") for x, i, j in zip(ids.is_null().to_pylist(), ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([*(column(b, f"c{k}") for k in range(len(stay))), pa.array(texts, pa.string())], names=[*(f.name for f in stay), text_col])

    return map_arrow(rows, run, T.StructType([*stay, T.StructField(text_col, T.StringType())]))
