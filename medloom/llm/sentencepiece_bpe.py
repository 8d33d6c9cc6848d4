"""SentencePiece models of the merge type: encoding by a score-ordered agenda, decoding.

A text is a chain of symbols, its characters at first. The agenda holds the pairs of
neighbours that make a piece, best score first, then leftmost. The best one is merged, and
the pairs that the new symbol makes with its neighbours are entered; pairs whose symbols
have changed meanwhile are passed over. What is no piece in the end is written in bytes.

Two characters that no piece has side by side are never merged across, so a text falls
into stretches that do not touch each other; equal stretches have equal ids. In each Arrow
batch the stretches that the agenda worked out are encoded and decoded by the sentencepiece
library too and compared, and so is one whole text; what is remembered was compared when
it was met first.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import USER, Scratch, packed, quoted, unpacked, worker_cache

#: Stretches that a Python worker remembers, and characters of one that is worth it; others are worked out anew.
MAX_STRETCHES, MAX_CHARS = 400_000, 100
#: Characters up to which the agenda is a plain list, of which the best entry is looked for; above, it is a heap.
SHORT = 40
_NEVER = float("inf")
#: Documents in one Arrow batch of results, and characters of a text that are cut into stretches at once.
OUT_ROWS, SPAN = 500, 1 << 20
#: What stands for a space in pieces.
MARK = "▁"
_PROBE = "  a b  \n\tÀ  "


class Mismatch(RuntimeError):
    """The agenda and the sentencepiece library differ on a text."""


class _Stretches(dict):
    """Stretch -> its packed ids, worked out when it is first asked for. ``new`` notes what was worked out since it was last emptied."""

    def __init__(self, work: Callable[[str], bytes], most: int, note: bool = True):
        super().__init__()
        self.work, self.most, self.note = work, most, note
        self.new: list[tuple[str, bytes]] = []

    def __missing__(self, stretch: str) -> bytes:
        ids = self.work(stretch)
        if self.note:
            self.new.append((stretch, ids))
        if len(self) < self.most and len(stretch) <= MAX_CHARS:
            self[stretch] = ids
        return ids


class PieceCodec:
    """Encoder and decoder of one model, given as its bytes.

    Models must be of the merge type with byte fallback, no normalisation, a dummy prefix and
    escaped spaces, and have no user-defined or unused pieces; others are an error.
    """

    def __init__(self, model: bytes, max_stretches: int = MAX_STRETCHES):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = {i: ("control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "piece") for i in range(sp.vocab_size())}
        pieces = {sp.id_to_piece(i): i for i, kind in kinds.items() if kind == "piece"}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i, kind in kinds.items() if kind == "byte"}
        if sp.normalize(_PROBE) != self._marked(_PROBE) or len(self.byte_ids) != 256 or any(sp.is_unused(i) for i in kinds):
            raise ValueError("only models with byte fallback, a dummy prefix and no other normalisation are supported")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        #: Piece -> id, and score with its sign turned.
        self.pieces = pieces
        self.scores = {piece: -sp.get_score(i) for piece, i in pieces.items()}
        self.pairs = {piece[k : k + 2] for piece in pieces for k in range(len(piece) - 1)}
        apart = not any(pair[1] == MARK and pair[0] != MARK for pair in self.pairs)
        #: Stretches that are cut before anything is looked up; the other cuts are found inside of them.
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else r"(?s:.+)")
        self.border = re.compile(f"(?<=[^{MARK}]){MARK}") if apart else None
        self.stretches, self.parts = _Stretches(self._stretch, max_stretches), _Stretches(self._part, max_stretches, note=False)
        self.bytes_of = {i: sp.id_to_piece(i).replace(MARK, " ").encode() for i in pieces.values()}
        self.bytes_of |= {i: bytes((b,)) for b, i in self.byte_ids.items()}
        self.bytes_of |= {i: b"" if kind == "control" else sp.decode([i]).encode() for i, kind in kinds.items() if kind in ("control", "unknown")}
        self.is_byte = frozenset(self.byte_ids.values())
        self.is_control = frozenset(i for i, kind in kinds.items() if kind == "control")
        self.starts_marked = frozenset(i for piece, i in pieces.items() if piece[0] == MARK)

    @staticmethod
    def _marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _stretch(self, stretch: str) -> bytes:
        """Packed ids of a stretch, cut again where no piece has the two characters. Its parts are remembered too: many stretches share them."""
        pairs, parts = self.pairs, self.parts
        cuts = [k for k in range(1, len(stretch)) if stretch[k - 1 : k + 1] not in pairs]
        if not cuts:
            return parts[stretch]
        return b"".join([parts[stretch[i:j]] for i, j in zip([0, *cuts], [*cuts, len(stretch)])])

    def _part(self, part: str) -> bytes:
        return array("I", self.merged_short(part) if len(part) <= SHORT else self.merged(part)).tobytes()

    def _ids(self, symbols: list[str]) -> list[int]:
        known, out = self.pieces.get, []
        for symbol in symbols:
            if (i := known(symbol)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in symbol.encode()]
        return out

    def merged_short(self, text: str) -> list[int]:
        """As ``merged``, with the agenda as the list of the scores of all neighbours."""
        symbols, score = list(text), self.scores.get
        agenda = [score(text[k : k + 2], _NEVER) for k in range(len(text) - 1)]
        while agenda and (best := min(agenda)) != _NEVER:
            k = agenda.index(best)
            symbols[k] = x = symbols[k] + symbols[k + 1]
            del symbols[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = score(x + symbols[k + 1], _NEVER)
            if k:
                agenda[k - 1] = score(symbols[k - 1] + x, _NEVER)
        return self._ids(symbols)

    def merged(self, text: str) -> list[int]:
        """Ids of one stretch by the agenda."""
        symbols, n, score = list(text), len(text), self.scores.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # (score, left symbol, right symbol, characters of both)
        agenda = [(s, k, k + 1, 2) for k in range(n - 1) if (s := score(text[k : k + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            x, y = symbols[left], symbols[right]
            # Passed over if either has been merged since.
            if not x or not y or len(x) + len(y) != size:
                continue
            symbols[left] = x = x + y
            symbols[right] = ""
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                if (s := score(x + symbols[beyond])) is not None:
                    heappush(agenda, (s, left, beyond, size + len(symbols[beyond])))
            if (above := before[left]) >= 0 and (s := score(symbols[above] + x)) is not None:
                heappush(agenda, (s, above, left, size + len(symbols[above])))
        return self._ids([x for x in symbols if x])

    def _spans(self, marked: str) -> Iterator[str]:
        """Parts of a long text that end where two stretches meet."""
        first = 0
        while len(marked) - first > SPAN and self.border and (at := self.border.search(marked, first + SPAN)):
            yield marked[first : at.start()]
            first = at.start()
        yield marked[first:]

    def encode(self, text: str) -> array:
        """Ids of a text between the begin and the end id."""
        out = array("I", (self.begin,))
        for span in self._spans(self._marked(text)):
            out.frombytes(b"".join(map(self.stretches.__getitem__, self.cut.findall(span))))
        out.append(self.end)
        return out

    def decode(self, ids) -> str:
        """Text of ids: control ids have none, and the dummy prefix goes. A byte that belongs to no character is U+FFFD."""
        first = next((k for k, i in enumerate(ids) if i not in self.is_control), len(ids))
        whole = b"".join(map(self.bytes_of.__getitem__, ids[first:]))
        if first < len(ids) and ids[first] in self.starts_marked:
            whole = whole[1:]
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids, first)

    def _decode_runs(self, ids, first: int) -> str:
        """As ``decode``, with each run of byte ids by itself."""
        out, run = [], b""
        for k, i in enumerate(ids):
            if i in self.is_byte:
                run += self.bytes_of[i]
                continue
            out.append(_characters(run))
            run, text = b"", self.bytes_of[i].decode()
            out.append(text[1:] if k == first and i in self.starts_marked else text)
        return "".join([*out, _characters(run)])

    def check_new(self) -> None:
        """Raise ``Mismatch`` unless the library gives the same ids for what was worked out since the last call, and the same texts for them."""
        new, self.stretches.new = self.stretches.new, []
        if not new:
            return
        # A text has a mark put before it, and each stretch begins with one.
        texts = [stretch[1:].replace(MARK, " ") if len(stretch) > 1 else " " for stretch, _ in new]
        theirs = self.library.encode(texts, num_threads=1)
        for (stretch, ids), text, other in zip(new, texts, theirs, strict=True):
            # A lone mark is not a text; the library writes two marks for a space.
            if array("I", other).tobytes() != (ids if len(stretch) > 1 else self._stretch(MARK * 2)):
                raise Mismatch(f"the stretch {stretch[:60]!r}")
        if self.library.decode(theirs) != texts:
            raise Mismatch("a decoded stretch differs")

    def check(self, texts: list[str], ids: list[array], decoded: list[str] | None = None) -> None:
        """Raise ``Mismatch`` unless the library gives the same ids, and the same texts for them."""
        theirs = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        for k, (a, b) in enumerate(zip(ids, theirs, strict=True)):
            if a != array("I", b):
                at = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                raise Mismatch(f"token {at} of a text that begins {texts[k][:60]!r}")
        if decoded is not None and self.library.decode(theirs) != decoded:
            raise Mismatch("decoded texts differ")


def _characters(data: bytes) -> str:
    """UTF-8 where it is valid; each other byte is U+FFFD."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[: bad.start].decode() + "�")
            data = data[bad.start + 1 :]
    return "".join(out)


def _codec(model, version: int) -> PieceCodec:
    """The worker's codec, so that later tasks go on with the stretches of earlier ones."""
    cache = worker_cache("pieces")
    if version not in cache:
        cache.clear()
        cache[version] = PieceCodec(model.value)
    return cache[version]


def _packed(ids: array) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _batches(model, version: int, out_col: str, decoded_col: str | None, check: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, version)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                texts = [text or "" for text in batch.column(1).to_pylist()]
                ids = [codec.encode(text) for text in texts]
                decoded = [codec.decode(x) for x in ids] if decoded_col else None
                if check:
                    codec.check_new()
                    codec.check(texts[:1], ids[:1], decoded and decoded[:1])
                else:
                    codec.stretches.new = []
                for text, again in zip(texts, decoded or []):
                    # No character is lost; a mark in the text comes back as a space.
                    if again != text and again != text.replace(MARK, " "):
                        raise Mismatch(f"the decoded text that begins {again[:60]!r}")
                columns = [batch.column(0), pa.array([_packed(x) for x in ids], pa.binary())]
                if decoded_col:
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[USER, out_col, *[decoded_col] * bool(decoded_col)])

    return run


def _shipped(df: DataFrame, path: str):
    """The broadcast model, a vocabulary file, and a number that tells it from others."""
    with open(path, "rb") as file:
        model = file.read()
    Scratch(df.sparkSession, "pieces")  # bounds Arrow batches in bytes
    return df.sparkSession.sparkContext.broadcast(model), hash(model)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, drop_text: bool = False, check: bool = True) -> DataFrame:
    """``docs`` with the ids of its texts in ``out_col``, packed as little-endian unsigned 32-bit integers, a row for each row.

    Begin and end ids stand around the ids of each text; a null or empty text has only
    these. With ``decoded_col`` the ids are decoded again into that column, and have to give
    the text. ``check`` holds the new stretches of each Arrow batch and its first text against
    the library and fails the job with ``Mismatch`` where they differ. Columns of the two names are replaced, others may have any name; an empty
    table gives an empty result. A text is encoded as a whole, whatever its length: it
    is cut only where no merge can reach across, and only a stretch without such a place
    is held as single symbols.
    """
    model, version = _shipped(docs, model_path)
    made = [out_col, *[decoded_col] * bool(decoded_col)]
    kept = [c for c in docs.columns if c not in made and not (drop_text and c == text_col)]
    # The user's columns travel in one struct; a row at least keeps it from being empty.
    rows = docs.select(F.struct(F.lit(0).alias("_row"), *[F.col(quoted(c)) for c in kept]).alias(USER), F.col(quoted(text_col)).cast("string").alias("text"))
    kinds = [T.StructField(name, kind) for name, kind in zip(made, (T.BinaryType(), T.StringType()))]
    out = rows.mapInArrow(_batches(model, version, out_col, decoded_col, check), T.StructType([rows.schema[USER], *kinds]))
    return unpacked(out, kept, *[F.col(quoted(c)) for c in made])


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its packed ids in ``out_col``. Null ids give a null text, no ids an empty one."""
    model, version = _shipped(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, version)
        for batch in batches:
            texts = [None if x is None else codec.decode(array("I", x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[USER, out_col])

    rows = packed(encoded, F.col(quoted(ids_col)).alias("ids"))
    out = rows.mapInArrow(run, T.StructType([rows.schema[USER], T.StructField(out_col, T.StringType())]))
    return unpacked(out, [c for c in encoded.columns if c != out_col], F.col(quoted(out_col)))
