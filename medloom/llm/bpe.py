"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes if and only if each of its tokens
and each pair of neighbours encode to themselves. So every prefix of a piece has one
last token: the one that ends there, starts at a prefix whose own last token it may
follow, and is its own encoding.

The nondeterministic transducer starts a token at every byte, follows the bytes of all
tokens and may end one. A state of the determinised one is the set of starts from
which a token may still be under way, that is, the longest suffix read that begins a
token. It knows the tokens that end there; a window of last tokens, one for each live
start, says which of them may follow. States and transitions are made when they are
first met, at most one for each token prefix. Whatever all live starts have in common
is emitted, after a lookahead of at most the longest token unless they keep apart.

Decoding streams: tokens go through an incremental UTF-8 state machine that carries
at most three bytes from one token to the next.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import worker_cache

#: Pairs of tokens and distinct pieces that a Python worker remembers; beyond, they are worked out anew.
MAX_PAIRS, MAX_PIECES = 200_000, 200_000
#: Bytes of a piece after which the window is looked through for tokens to emit.
WINDOW = 1024
#: Documents in one Arrow batch of results.
OUT_ROWS = 1000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file. The vocabulary file bounds its size."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


_NEVER = 1 << 60


class _State:
    """The bytes of the earliest token under way, (size, token, what it may follow) of the tokens that end here, longest first, and the transitions met."""

    __slots__ = ("under_way", "ends", "next")

    def __init__(self, under_way: bytes, ends: tuple[tuple[int, int, dict[int, bool]], ...]):
        self.under_way, self.ends = under_way, ends
        self.next: dict[int, _State] = {}


class Transducer:
    """Encodes one piece at a time; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_pairs = ranks, max_pairs
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.whole: dict[int, bool] = {}
        #: Token -> last token, or -1 at the start of a piece -> whether it may follow; and how many pairs there are.
        self.follows: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.edges: dict[tuple[int, int], list | None] = {}
        self.start = _State(b"", ())
        self.states = {b"": self.start}

    def _merged(self, data: bytes) -> list[int]:
        """The merges one by one, for single tokens and pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """Parts at the left (0) or right (-1) edge of a token as its merges go on, each with the rank of the merge that ends it.

        None if the token is not its own encoding, or a merge has a lower rank than its parts.
        """
        key = (token, side)
        if key not in self.edges:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            edge, last = [], -1
            while len(parts) > 1:
                ranks = [self.ranks.get(parts[i] + parts[i + 1], _NEVER) for i in range(len(parts) - 1)]
                rank = min(ranks)
                if rank == _NEVER or rank < last:
                    break
                last, i = rank, ranks.index(rank)
                if i == (0 if side == 0 else len(parts) - 2):
                    edge.append((parts[side], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.edges[key] = [*edge, (parts[0], _NEVER)] if len(parts) == 1 else None
        return self.edges[key]

    def _merges_across(self, last: int, token: int) -> bool:
        """Whether a merge joins the end of ``last`` and the start of ``token`` before both are complete, or after."""
        left, right = self._edge(last, -1), self._edge(token, 0)
        if left is None or right is None:
            return self._merged(self.bytes_of[last] + self.bytes_of[token]) != [last, token]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.ranks.get(x + y, _NEVER)
            # Of equal ranks the leftmost merge comes first.
            if across < x_ends and across <= y_ends and across != _NEVER:
                return True
            if x_ends == y_ends == _NEVER:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _whole(self, token: int) -> bool:
        """Whether a token is its own encoding."""
        if token not in self.whole:
            self.whole[token] = self._merged(self.bytes_of[token]) == [token]
        return self.whole[token]

    def _learn(self, last: int, token: int) -> bool:
        """Whether the token may follow the one before it."""
        if self.n_pairs >= self.max_pairs:
            for known in self.follows.values():
                known.clear()
            self.edges.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        fits = self.follows[token][last] = last < 0 or not self._merges_across(last, token)
        return fits

    def _step(self, state: _State, byte: int) -> _State:
        """The state after one more byte, made if it is new."""
        under_way = state.under_way + bytes((byte,))
        while under_way not in self.prefixes:
            under_way = under_way[1:]
            if not under_way:
                raise ValueError(f"no token has the byte {byte}")
        after = self.states.get(under_way)
        if after is None:
            found = ((len(under_way) - k, self.ranks.get(under_way[k:])) for k in range(len(under_way)))
            ends = tuple((size, token, self.follows.setdefault(token, {})) for size, token in found if token is not None and self._whole(token))
            after = self.states[under_way] = _State(under_way, ends)
        state.next[byte] = after
        return after

    def _back(self, last: list[int], end: int) -> list[int]:
        """Tokens from the window's start to ``end``."""
        out = []
        while end:
            token = last[end]
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]

    def _settled(self, last: list[int], live: int) -> int:
        """The last place in the window at which a token ends whatever of the ``live`` last places comes to be used."""
        shared: set[int] | None = None
        for end in range(len(last) - 1, len(last) - 2 - live, -1):
            places = {end}
            while end:
                end -= len(self.bytes_of[last[end]])
                places.add(end)
            shared = places if shared is None else shared & places
        return max(shared or {0})

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece. A piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        # The window: for each place the last token of what is before it; -1 at the start of the piece.
        state, last, out = self.start, [-1], []
        for byte in data:
            state = state.next.get(byte) or self._step(state, byte)
            here = len(last)
            for size, token, known in state.ends:
                before = last[here - size]
                fits = known.get(before)
                if fits is None:
                    fits = self._learn(before, token)
                if fits:
                    last.append(token)
                    break
            if here % WINDOW == 0:
                place = self._settled(last, len(state.under_way))
                out += self._back(last, place)
                last = last[place:]
        return out + self._back(last, len(last) - 1)


class Encoder:
    """Splits texts by a pattern and encodes each piece on its own; remembers pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pairs: int = MAX_PAIRS, max_pieces: int = MAX_PIECES):
        import regex

        self.pieces = regex.compile(pattern).finditer
        self.transducer = Transducer(ranks, max_pairs)
        # Pieces met lately, and those met before them: what is met again moves up, the rest is forgotten.
        self.known: dict[str, array] = {}
        self.older: dict[str, array] = {}
        self.max_pieces = max_pieces // 2

    def encode(self, text: str | None) -> array:
        out, known = array("i"), self.known
        for match in self.pieces(text or ""):
            piece = match.group()
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = array("i", self.transducer.encode(piece.encode()))
                if len(piece) <= 64:
                    if len(known) >= self.max_pieces:
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = ids
            out.extend(ids)
        return out


class Utf8Machine:
    """Incremental UTF-8 decoder. State: bytes of an unfinished character and what may follow them.

    An ill-formed sequence becomes U+FFFD, one for each of its longest well-formed starts.
    """

    #: First byte -> (bytes to come, lowest and highest next byte).
    _FIRST = (
        {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
        | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}
        | {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}
        | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
    )

    def __init__(self) -> None:
        self.held, self.to_come, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.to_come:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.to_come, self.low, self.high = self.to_come - 1, 0x80, 0xBF
                    if not self.to_come:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                out.append("�")
                self.held, self.to_come = b"", 0
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self._FIRST:
                self.held, (self.to_come, self.low, self.high) = bytes((byte,)), self._FIRST[byte]
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.held, self.to_come = self.held, b"", 0
        return "�" if left else ""


class Decoder:
    """Streams token ids back to text. Tokens of whole characters skip the machine when it holds nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of: dict[int, str] = {}
        for rank, token in self.bytes_of.items():
            try:
                self.text_of[rank] = token.decode()
            except UnicodeDecodeError:
                pass

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete. Unknown ids are an error."""
        machine, text_of = Utf8Machine(), self.text_of
        for token in ids:
            text = text_of.get(token)
            yield text if text is not None and not machine.to_come else machine.feed(self.bytes_of[token])
        yield machine.end()


def _encoder(ranks, version: int, pattern: str) -> Encoder:
    """The worker's encoder, so that later tasks go on with the transducer of earlier ones."""
    cache, key = worker_cache("bpe"), (version, pattern)
    if key not in cache:
        cache.clear()
        cache[key] = Encoder(ranks.value, pattern)
    return cache[key]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array, drop: str | None) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in (name, drop)]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [values], names=[*names, name])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, OUT_ROWS):
            yield whole.slice(at, OUT_ROWS)


def _id_lists(all_ids: list[array]) -> pa.Array:
    flat, ends = array("i"), [0]
    for ids in all_ids:
        flat.extend(ids)
        ends.append(len(flat))
    values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _encode_batches(ranks, version: int, pattern: str, text_col: str, out_col: str, drop: str | None, decoded_col: str | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, version, pattern)
        decoder = Decoder(ranks.value) if decoded_col else None
        for batch in _slices(batches):
            ids = [encoder.encode(text.as_py()) for text in batch.column(text_col)]
            out = _with_column(batch, out_col, _id_lists(ids), drop)
            if decoder:
                out = _with_column(out, decoded_col, pa.array(["".join(decoder.decode(x)) for x in ids], pa.string()), None)
            yield out

    return run


def _decode_batches(ranks, ids_col: str, out_col: str, drop: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(ranks.value)
        for batch in _slices(batches):
            lists = (ids.values for ids in batch.column(ids_col))
            texts = [None if ids is None else "".join(decoder.decode(ids.to_pylist())) for ids in lists]
            yield _with_column(batch, out_col, pa.array(texts, pa.string()), drop)

    return run


def _shipped(df: DataFrame, path: str):
    """The broadcast ranks of a file, and a number that tells them from others."""
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast(ranks), hash(frozenset(ranks.items()))


def _schema(df: DataFrame, name: str, kind: T.DataType, drop: str | None) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in (name, drop)] + [T.StructField(name, kind)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", drop_text: bool = False) -> DataFrame:
    """``docs`` with the token ids of its texts in ``out_col`` (array of int), a row for each row.

    No special tokens: their strings are ordinary text. A null or empty text has no
    tokens. A column of the name ``out_col`` is replaced; the others stay, but for the
    text if ``drop_text``. The rank file is read by the driver and broadcast; its
    vocabulary bounds it.
    """
    ranks, version = _shipped(docs, ranks_path)
    drop = text_col if drop_text else None
    schema = _schema(docs, out_col, T.ArrayType(T.IntegerType()), drop)
    return docs.mapInArrow(_encode_batches(ranks, version, pattern, text_col, out_col, drop), schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "text", drop_ids: bool = False) -> DataFrame:
    """``encoded`` with the text of its token ids in ``out_col``. Null ids give a null text, no ids an empty one."""
    ranks, _ = _shipped(encoded, ranks_path)
    drop = ids_col if drop_ids else None
    return encoded.mapInArrow(_decode_batches(ranks, ids_col, out_col, drop), _schema(encoded, out_col, T.StringType(), drop))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass of the same Python worker; the text itself is dropped."""
    ranks, version = _shipped(docs, ranks_path)
    schema = _schema(docs, ids_col, T.ArrayType(T.IntegerType()), text_col).add(T.StructField(decoded_col, T.StringType()))
    return docs.mapInArrow(_encode_batches(ranks, version, pattern, text_col, ids_col, text_col, decoded_col), schema)
