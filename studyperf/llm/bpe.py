"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes to itself and each two neighbours,
joined, encode to these two; so each prefix has one last token. The nondeterministic machine guesses where a token begins and follows the
trie of tokens. The subset construction makes it deterministic, state by state as texts need it: a state is the set of places in the trie that are alive, and it gives the tokens that may end
here, of which the one that can follow the last token at its own beginning is right. Beginnings that are no longer alive can't matter any more: once all alive ones
go back to one boundary, the tokens before it are emitted. As none lives longer than the longest token, the lookahead is bounded.

Null texts encode as empty ones (no ids). Repeated rows and extra columns are of no effect on a row's result; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import weakref
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import doc_ids, identified, small_batches

#: Bounds of what a worker keeps: states of the machine and pairs of tokens, encoded pieces. Beyond them it starts afresh; results don't change.
STATES, PAIRS, PIECES = 100_000, 200_000, 200_000
#: Code points from which a text's pieces are found one by one, not listed.
LONG = 1 << 20
#: Bytes after which a long piece's agreed tokens are emitted, and ids that are decoded at once.
BLOCK = 65_536


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a line for each token, in base64, and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class _Node:
    """A place in the trie of tokens, and the token that ends there."""

    __slots__ = ("depth", "next", "token")

    def __init__(self, depth: int):
        self.next: dict[int, _Node] = {}
        self.token = -1
        self.depth = depth


class Transducer:
    """Encodes pieces of bytes by ranks."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks, self.most = ranks, states
        self.token = {rank: token for token, rank in ranks.items()}
        self.root = _Node(0)
        for token, rank in ranks.items():
            node = self.root
            for b in token:
                if (child := node.next.get(b)) is None:
                    child = node.next[b] = _Node(node.depth + 1)
                node = child
            node.token = rank
        self.fits: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int, bool] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.alive: list[tuple[_Node, ...]] = []
        self.ending: list[tuple[tuple[int, int], ...]] = []  # tokens that may end in a state, and their lengths, the longest first
        self.moves: dict[int, int] = {}  # (state, byte) to state
        self._state((self.root,))

    def _state(self, nodes: tuple) -> int:
        if (state := self.ids.get(nodes)) is None:
            state = self.ids[nodes] = len(self.alive)
            self.alive.append(nodes)
            self.ending.append(tuple((n.token, n.depth) for n in nodes if n.token >= 0 and self.split(n.token) is not None))
        return state

    def merged(self, text: bytes, made: list | None = None) -> list[int]:
        """The plain merges, for a token or two; made gets the pairs."""
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            if made is not None:
                made.append((self.ranks[parts[at]], self.ranks[parts[at + 1]]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int, bool] | None:
        """The last merge within token and whether ranks only rise towards it; None if token doesn't encode to itself."""
        if token not in self.splits:
            made: list[tuple[int, int]] = []
            if self.merged(self.token[token], made) != [token]:
                self.splits[token] = None
            elif not made:
                self.splits[token] = token, token, True
            else:
                left, right = made[-1]
                parts = [self.split(left), self.split(right)]
                self.splits[token] = left, right, max(left, right) < token and all(p is not None and p[2] for p in parts)
        return self.splits[token]

    def _parted(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary of two tokens: goes back in time, undoing the later merge of the two at the boundary.

        A pair there would have merged if its rank is below those of the merges that ended it; of equal ranks the left one goes first.
        """
        rank, token, splits = self.ranks, self.token, self.splits
        before_left, before_right = 1 << 60, 1 << 60
        while True:
            joined = rank.get(token[left] + token[right])
            if joined is not None and joined < before_left and joined <= before_right:
                return False
            inner_left, inner_right = len(token[left]) > 1, len(token[right]) > 1
            if inner_left and (left > right or not inner_right):
                before_left = left
                left = self.split(left)[1]
            elif inner_right:
                before_right = right
                right = self.split(right)[0]
            else:
                return True

    def follows(self, before: int, token: int) -> bool:
        """Whether token can stand after another (-1: at the start)."""
        key = (before + 1) << 32 | token
        if (fits := self.fits.get(key)) is None:
            own = self.split(token)
            if before < 0 or own is None:
                fits = own is not None
            elif own[2] and self.split(before)[2]:
                fits = self._parted(before, token)
            else:
                fits = self.merged(self.token[before] + self.token[token]) == [before, token]
            if len(self.fits) > PAIRS:
                self.fits.clear()
            self.fits[key] = fits
        return fits

    def _move(self, state: int, byte: int) -> int:
        """All places that the alive ones and a new beginning lead to."""
        to = [child for node in self.alive[state] if (child := node.next.get(byte)) is not None]
        out = self.moves[state << 8 | byte] = self._state((*to, self.root))
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.alive) > self.most:
            self._restart()
        out: list[int] = []
        moves, ending, fits = self.moves, self.ending, self.fits
        state, last, sizes = 0, [-1], [0]  # the last token of each prefix since the last boundary emitted, and its length
        for byte in piece:
            to = moves.get(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            for token, size in ending[state]:
                before = last[-size]
                fit = fits.get((before + 1) << 32 | token)
                if self.follows(before, token) if fit is None else fit:
                    last.append(token)
                    sizes.append(size)
                    break
            if len(last) > BLOCK:
                last, sizes = self._emit(out, last, sizes, [n.depth for n in self.alive[state]])
        self._emit(out, last, sizes, [0])
        return out

    @staticmethod
    def _emit(out: list[int], last: list[int], sizes: list[int], depths: list[int]) -> tuple[list[int], list[int]]:
        """Appends the tokens that all ways back from the alive beginnings share; returns what is left, from the boundary after them."""
        end = len(last) - 1
        starts = {end - d for d in depths}
        while len(starts) > 1:
            late = max(starts)
            starts.remove(late)
            starts.add(late - sizes[late])
        agreed = at = starts.pop()
        tokens = []
        while at > 0:
            tokens.append(last[at])
            at -= sizes[at]
        out += tokens[::-1]
        return last[agreed:], [0, *sizes[agreed + 1 :]]


class Utf8Machine:
    """Takes bytes as they come and gives the text that is complete so far; a wrong byte or a broken sequence gives U+FFFD."""

    #: First bytes, how many bytes follow, and the range of the next one (RFC 3629).
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self):
        self.leads = {b: rest for low, high, *rest in self.LEADS for b in range(low, high + 1)}
        self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need:
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        out = []
        for b in data:
            if self.need and self.low <= b <= self.high:
                self.held, self.need, self.low, self.high = self.held + bytes([b]), self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                continue
            if self.need:
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif b in self.leads:
                self.held, (self.need, self.low, self.high) = bytes([b]), self.leads[b]
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.need = "�" if self.need else "", 0
        return rest


class Codec:
    """Whole texts to ids, packed as little-endian unsigned 32-bit integers, and back."""

    class _Pieces(dict):
        def __init__(self, transducer: Transducer):
            self.transducer = transducer

        def __missing__(self, piece: str) -> bytes:
            packed = self[piece] = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
            return packed

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.token = self.transducer.token
        self.pattern = regex.compile(pattern)
        self.pieces = self._Pieces(self.transducer)

    def encode(self, text: str) -> bytes:
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        found = self.pattern.findall(text) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text))
        return b"".join(map(self.pieces.__getitem__, found))

    def decoded(self, packed: bytes) -> Iterator[bytes]:
        """The bytes of the ids, block by block."""
        ids = np.frombuffer(packed, "<u4")
        for at in range(0, len(ids), BLOCK):
            yield b"".join(map(self.token.__getitem__, ids[at : at + BLOCK].tolist()))

    def decode(self, packed: bytes) -> str:
        machine = Utf8Machine()
        return "".join(map(machine.feed, self.decoded(packed))) + machine.close()


_codecs: weakref.WeakValueDictionary = weakref.WeakValueDictionary()
_kept: list[Codec] = []


def _codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """One for each worker and vocabulary, so that its states and pieces serve later tasks too."""
    key = len(ranks), pattern, hashlib.sha256(b"".join(b"%d:%s," % (r, t) for t, r in ranks.items())).hexdigest()
    if (codec := _codecs.get(key)) is None:
        codec = _codecs[key] = Codec(ranks, pattern)
        _kept[:] = [codec]
        gc.set_threshold(200_000, 50, 1000)  # states are many small tuples without cycles
    return codec


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_chars_decoded of each document; with ids also the ids as an array.

    The vocabulary is broadcast; it is bounded, as vocabularies are (50,256 tokens: under 1 MB). Documents stay where they are.
    """
    small_batches(docs.sparkSession, 250)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(*shared.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                packed = codec.encode(text or "")
                digest, machine, chars = hashlib.sha256(), Utf8Machine(), 0
                for block in codec.decoded(packed):
                    digest.update(block)
                    chars += len(machine.feed(block))
                row = len(packed) // 4, hashlib.sha256(packed).hexdigest(), digest.hexdigest(), chars + len(machine.close())
                rows.append((*row, np.frombuffer(packed, "<u4").astype("<i4")) if ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded", "ids"][: 4 + ids]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", doc_ids(batch))
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long" + ", ids array<int>" * ids
    return identified(docs, "text").mapInPandas(encoded, schema)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and text of documents given as ids."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(*shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": doc_ids(batch), "text": [codec.decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in batch["ids"]]})

    return identified(encoded, "ids").mapInPandas(decoded, "doc_id long, text string")
