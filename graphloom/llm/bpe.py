"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A merge order fixes, for every prefix of a word, the one token that ends there. A token ``t`` may follow ``u``
exactly if merging the bytes ``u + t`` gives back ``[u, t]``. The transducer keeps all places of the word at which a
longer token may still begin; such a place is the trie node of the bytes since it and the token that ends at it.
These place sets are the states, and a step says which token ends at its byte; both are made when they are first met
(``Transducer.expand``) and looked up afterwards. What the ways to all places of a state share is certain and is
emitted, so that output lags by a bounded number of bytes (``LAG``).

Defined results: null and empty texts give no ids; every id sequence decodes to the bytes that it was made from,
also where a token ends inside a UTF-8 character; the decoder yields U+FFFD for bytes that are no UTF-8.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from graphloom.llm.text import Memo, map_texts

#: Unicode's White_Space, which the pattern's ``\s`` means in the tokenizer libraries.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Transitions that are kept before the machine starts anew.
MOST_TRANSITIONS = 600_000
#: Bytes of one word after which tokens that are certain are put out.
LAG = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(data: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[int]:
    """The definition: join the adjacent pair of lowest rank, leftmost first, until none (or ``stop`` parts) is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth = [0]
        self.packed = {r: r.to_bytes(4, "little") for r in ranks.values()}
        for data, rank in ranks.items():
            node = 0
            for n, b in enumerate(data, 1):
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(-1)
                    self.depth.append(n)
            self.ends[node] = rank
        self.parts: Memo = Memo(self._parts, 1_000_000)
        self.follows: Memo = Memo(self._may_follow, 400_000)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self._state(((0, -1),))

    def _parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for a single byte, (-1, -1) for what merges never reach."""
        data = self.token[t]
        if len(data) == 1:
            return None
        parts = merged(data, self.ranks, stop=2)
        joined = len(parts) == 2 and self.ranks.get(self.token[parts[0]] + self.token[parts[1]]) == t
        return (parts[0], parts[1]) if joined else (-1, -1)

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both gives both back.

        Seen backwards in time, the later of the two tokens at the border comes apart first; the border is lost if
        what touches there has a rank below that of the merge that ends the contact (at equal rank the left goes first).
        """
        a, b = pair
        if self.parts[b] == (-1, -1):
            return False
        if a < 0:
            return True
        ranks, token, limit = self.ranks, self.token, 1 << 62
        while True:
            r = ranks.get(token[a] + token[b])
            if r is not None and r < limit:
                return False
            if a > b:
                if (parts := self.parts[a]) is None:
                    return True
                limit, a = a, parts[1]
            else:
                if (parts := self.parts[b]) is None:
                    return True
                limit, b = b + 1, parts[0]

    def _state(self, places: tuple) -> int:
        found = self.states.get(places)
        if found is None:
            found = self.states[places] = len(self.content)
            self.content.append(places)
        return found

    def expand(self, state: int, byte: int) -> tuple[int, int]:
        children, ends, here, moved = self.children, self.ends, -1, [(0, -1)]
        for place in self.content[state]:
            child = children[place[0]].get(byte)
            if child is not None:
                if children[child]:
                    moved.append((child, place[1]))
                if here < 0 and ends[child] >= 0 and self.follows[place[1], ends[child]]:
                    here = ends[child]
        if here < 0:
            raise ValueError("the ranks hold no token for a byte")
        moved[0] = (0, here)
        step = self.steps[state << 8 | byte] = self._state(tuple(moved)), here
        return step

    def encode_word(self, data: bytes) -> bytes:
        """Ids of one pretoken as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(data)
        if whole is not None:
            return self.packed[whole]
        if len(self.steps) > MOST_TRANSITIONS:
            self.reset()
        state, ending, out, steps = 0, [], [], self.steps
        for b in data:
            step = steps.get(state << 8 | b)
            if step is None:
                step = self.expand(state, b)
            state, t = step
            ending.append(t)
            if len(ending) >= LAG:
                self._emit(state, ending, out)
        self._back(ending, len(ending), out)
        return b"".join(out)

    def _back(self, ending: list[int], at: int, out: list[bytes]) -> None:
        """Put out the tokens on the way to place ``at``; ``ending`` has the token that ends after each byte."""
        way = []
        while at:
            t = ending[at - 1]
            way.append(self.packed[t])
            at -= len(self.token[t])
        out += reversed(way)

    def _emit(self, state: int, ending: list[int], out: list[bytes]) -> None:
        """Put out what the ways to all places share, and drop the bytes before."""
        places = {len(ending) - self.depth[node] for node, _ in self.content[state]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - len(self.token[ending[last - 1]]))
        sure = places.pop()
        self._back(ending, sure, out)
        del ending[:sure]


class Splitter:
    """Cuts a text into pieces that the pattern never joins, most of them by ``str.split``.

    A space that stands between two characters other than white space begins a new match, so ``" word"`` can be
    matched alone; a text with any other space next to white space or to an end goes through the pattern whole.
    """

    def __init__(self, pattern: str):
        exact = pattern.replace(r"[^\s\p", rf"[^{SPACES}\p").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.matches = regex.compile(exact).findall
        self.odd = regex.compile(rf"\x20[{SPACES}]|[{SPACES}]\x20|^\x20|\x20$").search

    def pieces(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces as they are, then pieces that stand for themselves after a space."""
        if self.odd(text):
            return self.matches(text), []
        first, *rest = text.split(" ")
        return [first] if first else [], rest


class Pieces:
    """Encodes texts piece by piece; ``encode(piece)`` is asked once for each piece that is remembered."""

    def __init__(self, pattern: str, encode: Callable[[str], bytes], limit: int):
        self.splitter = Splitter(pattern)
        self.plain = Memo(encode, limit // 4)
        self.spaced = Memo(lambda p: encode(" " + p), limit)

    def encode(self, text: str) -> bytes:
        plain, spaced = self.splitter.pieces(text)
        return b"".join([*map(self.plain.__getitem__, plain), *map(self.spaced.__getitem__, spaced)])


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        self.machine = Transducer(load_ranks(ranks_path))
        self.word = Memo(lambda w: self.machine.encode_word(w.encode()), 400_000)
        self.pieces = Pieces(pattern, lambda p: b"".join([self.word[w] for w in self.pieces.splitter.matches(p)]), 500_000)
        self.decoder = Decoder(self.machine.token)

    def encode(self, text: str) -> bytes:
        return self.pieces.encode(text)


class Decoder:
    """Streaming decoding: an incremental UTF-8 state machine that steps from token to token.

    The state is the unfinished character so far (three bytes at most). What a token adds in a state is found byte
    by byte once, then looked up.
    """

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.steps: Memo = Memo(self._step, 200_000)
        self.whole: Memo = Memo(self._whole, 200_000)

    @staticmethod
    def needs(head: bytes) -> tuple[int, int, int]:
        """How many bytes a character that begins so has, and the range of its next byte; 0: none begins so."""
        lead = head[0]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        low, high = 0x80, 0xBF
        if len(head) == 1:
            low, high = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low), {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
        return n, low, high

    def feed(self, pending: bytes, data: bytes) -> tuple[bytes, str]:
        out = []
        for b in data:
            if pending:
                n, low, high = self.needs(pending)
                if low <= b <= high:
                    pending += bytes([b])
                    if len(pending) == n:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            n, _, _ = self.needs(bytes([b]))
            if n == 1:
                out.append(chr(b))
            elif n:
                pending = bytes([b])
            else:
                out.append("�")
        return pending, "".join(out)

    def _step(self, key: tuple[bytes, int]) -> tuple[bytes, str]:
        return self.feed(key[0], self.token[key[1]])

    def stream(self, ids):
        """Text pieces, one for every id, and one more if the end cuts a character."""
        pending, steps = b"", self.steps
        for i in ids:
            pending, piece = steps[(pending, i)]
            yield piece
        if pending:
            yield "�"

    def _whole(self, i: int) -> str:
        pending, piece = self.steps[(b"", i)]
        if pending:
            raise UnfinishedCharacter(i)
        return piece

    def text(self, ids: list[int]) -> str:
        """All of the stream; where no token cuts a character, the machine rests in its first state throughout."""
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except UnfinishedCharacter:
            return "".join(self.stream(ids))


class UnfinishedCharacter(Exception):
    """A token that ends inside a character."""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process; its machine and caches outlive a task."""
    if (ranks_path, pattern) not in _codecs:
        gc.set_threshold(200_000, 50, 1000)  # the machine is many small objects that stay
        _codecs[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of the whole text."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        c = codec(ranks_path, pattern)
        return {"doc_id": ids, "ids": [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in texts]}

    return map_texts(docs, rows, "doc_id long, ids array<int>")


def roundtrip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode through the streaming decoder, and return counts and digests."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        c = codec(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        encoded = [c.encode(t) for t in texts]
        decoded = [c.decoder.text(np.frombuffer(e, "<u4").tolist()).encode() for e in encoded]
        return {"doc_id": ids, "n_tokens": [len(e) // 4 for e in encoded], "ids_sha256": [sha(e) for e in encoded], "decoded_sha256": [sha(d) for d in decoded]}

    return map_texts(docs, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
