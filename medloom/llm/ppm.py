"""Language-model scoring by prediction by partial matching.

A text is coded byte by byte: its words, each with the space after it, then one end. The
contexts of a byte are, longest first, the last ``ORDER`` bytes of the document, one less
and so on, and none; they run over token borders. A context that has not seen the byte
escapes to the next, and what the longer context has seen is excluded there. A byte never
seen is uniform. From three bytes on the probability of an escape is estimated by how often
a context of the same order, place in its token, count and number of symbols met something
new, each training byte left out in turn; in the shorter contexts it is that of method D.
All training texts share one model, which nothing else enters.

How it is distributed. Each chunk of documents sends its distinct (context, byte) pairs and
its distinct tokens with their training counts, not their occurrences. The pairs are dealt
into parts by ranges of their last three bytes of context, so every context of three bytes
or more is whole in one part; the tokens are dealt by their hash. A part merges the rows of
the chunks as they stream by, so that it holds its distinct pairs only. Counts of two-byte
contexts are a table of their own, of which each part gets the contexts that end its
pairs; what all tasks get is the 2^16 counts of pairs of bytes and an escape estimate for
each of ``CLASSES``. The scores of pairs and the counts of tokens then go back to the
chunks that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of the longest context.
ORDER = 5
#: Bytes of text in a chunk at most, but for one document, and for each part of the pairs and of the tokens.
CHUNK_BYTES, PART_BYTES = 1 << 23, 1 << 22
#: Texts, and characters of each, whose contexts balance the parts; nothing else depends on them.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 10_000
#: Pairs that a part gathers before it merges them.
MERGE_PAIRS = 1 << 20
#: The token that ends each text; no word can contain white space.
END = b"\n"
SPACE = 0x20

#: Kinds of rows: tokens, pairs, documents.
WORDS, PAIRS, DOCS = range(3)
#: What the parts say: their merged counts, the counts of two-byte contexts, tries and escapes of each class, distinct training tokens.
MERGED, LOW, TRIES, ESCAPES, KINDS = range(5)

ROWS = "chunk long, kind int, part int, ids array<long>, n array<long>, payload binary"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is held out of training; a null id counts as an empty text."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Values of 4 bytes, plane by plane, compressed."""
    return _pack(values.astype(kind).view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(raw: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(_unpack(raw), np.uint8).reshape(4, -1).T.copy().view(kind).ravel()


def _packed(values: np.ndarray) -> bytes:
    """Ascending values of up to 63 bits as steps, plane by plane, compressed."""
    return _pack(np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unpack(raw), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel())


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _bundle(*items: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in items)


def _items(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _tokens(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, then its end."""
    return [*(text or "").encode().lower().split(), END]


def _keys(stream: np.ndarray) -> np.ndarray:
    """(last byte, the one before, .., byte), most significant first, of each place after the first ``ORDER``."""
    out = stream[ORDER:].astype(np.int64)
    for k in range(1, ORDER + 1):
        out |= stream[ORDER - k : len(stream) - k].astype(np.int64) << 8 * (ORDER + 1 - k)
    return out


def _document_keys(words: list[bytes]) -> np.ndarray:
    """Pairs of a document, after a context of ends: its words end with a space, ``END`` with itself."""
    return _keys(np.frombuffer(END * ORDER + b" ".join(words), np.uint8))


def _three(keys: np.ndarray) -> np.ndarray:
    """The last three bytes of context."""
    return keys >> 8 * (ORDER - 2)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a batch as chunks of at most ``CHUNK_BYTES``, but for one document."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = text.as_buffer().size if text.is_valid else 0
        if i > first and held + size > CHUNK_BYTES:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def _chunk(ids: list, texts: pa.Array, splitters: np.ndarray, word_parts: int) -> Iterator[tuple]:
    """(kind, part, ids, n, payload) of one chunk: documents as token numbers, then tokens and pairs by part with their training counts."""
    numbers: dict[bytes, int] = {}
    docs, sizes, keys, trained = [], [], [], []
    for doc_id, text in zip(ids, texts):
        words = _tokens(text.as_py())
        docs.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
        sizes.append(len(words))
        held = held_out(doc_id)
        if not held:
            trained.append(docs[-1])
        keys.append(_document_keys(words) << 1 | (not held))
    yield DOCS, 0, ids, sizes, _planes(np.concatenate(docs))
    n = np.bincount(np.concatenate(trained), minlength=len(numbers)) if trained else np.zeros(len(numbers), np.int64)
    del docs, trained
    each = np.concatenate(keys)
    keys.clear()
    words = list(numbers)
    part_of = np.fromiter(map(crc32, words), np.uint32, len(words)) % word_parts
    order = np.argsort(part_of, kind="stable")
    cuts = np.searchsorted(part_of[order], np.arange(word_parts + 1))
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            mine = order[a:b]
            yield WORDS, part, None, None, _bundle(_pack(b" ".join([words[i] for i in mine])), _packed(mine), _planes(n[mine]))
    each.sort()
    first = np.flatnonzero(np.diff(each >> 1, prepend=-1))
    times, pairs = np.add.reduceat(each & 1, first), each[first] >> 1
    del each
    cuts = [0, *np.searchsorted(_three(pairs), splitters), len(pairs)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield PAIRS, part, None, None, _bundle(_packed(pairs[a:b]), _planes(times[a:b]))


def _chunks(splitters: np.ndarray, word_parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                rows = [(chunk, *row) for row in _chunk(batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo), splitters, word_parts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["chunk", "kind", "part", "ids", "n", "payload"])
                chunk += 1

    return run


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


class Lower:
    """The contexts of two bytes, one and none.

    From counts of (first << 16 | second << 8 | next), of the two-byte contexts that are asked for at
    least, and the counts [second, next] of all of them.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, one: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts, self.one = keys[order].astype(np.int64), counts[order].astype(float), one
        q, r, s = self.keys >> 8, self.keys >> 8 & 255, self.keys & 255
        self.zero = self.one.sum(axis=0)
        self.q, first = np.unique(q, return_index=True)
        if len(self.q):
            self.n2 = np.add.reduceat(self.counts, first)
            self.d2 = np.diff(np.append(first, len(q))).astype(float)
            seen_below = np.add.reduceat(self.one[r, s], first)
        else:
            self.n2 = self.d2 = seen_below = np.zeros(0)
        self.n1, self.d1 = self.one.sum(axis=1), (self.one > 0).sum(axis=1).astype(float)
        q_last = self.q & 255
        #: What is left of the shorter context after the longer one's symbols are excluded.
        self.n1_left, self.d1_left = self.n1[q_last] - seen_below, self.d1[q_last] - self.d2
        self.n0, self.d0 = self.zero.sum(), float((self.zero > 0).sum())
        self.n0_left, self.d0_left = self.n0 - (self.one > 0) @ self.zero, self.d0 - self.d1

    def at(self, q: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Counts of s after q."""
        return _lookup(self.keys, self.counts, q << 8 | s)

    def sizes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _lookup(self.q, self.n2, q), _lookup(self.q, self.d2, q)

    def log_p(self, q: np.ndarray, s: np.ndarray, n2: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Log probability of s from the two-byte context q down; n2, d2: what of q is not excluded."""
        out = np.zeros(len(q))
        r = q & 255
        known1 = self.n1[r] > 0
        at = np.minimum(np.searchsorted(self.q, q), max(0, len(self.q) - 1))
        known = self.q[at] == q if len(self.q) else np.zeros(len(q), bool)
        left = (lambda v: v[at]) if len(self.q) else (lambda v: np.zeros(len(q)))
        levels = [
            (self.at(q, s), n2, d2),
            (self.one[r, s], np.where(known, left(self.n1_left), self.n1[r]), np.where(known, left(self.d1_left), self.d1[r])),
            (self.zero[s], np.where(known1, self.n0_left[r], self.n0), np.where(known1, self.d0_left[r], self.d0)),
        ]
        todo = np.ones(len(q), bool)
        for c, n, d in levels:
            here = todo & (n > 0.25)
            found, missed = here & (c > 0), here & (c <= 0)
            out[found] += np.log((c[found] - 0.5) / n[found])
            out[missed] += np.log(0.5 * np.maximum(d[missed], 1) / n[missed])
            todo &= ~found
        out[todo] -= np.log(max(1.0, 256 - self.d0))
        return out


#: Contexts share an escape estimate by the order of their count, their symbols (up to 3), their length and how much of it lies in the token.
CLASSES = 21 * 64


def _class(n: np.ndarray, d: np.ndarray, slot: np.ndarray | int) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 20) * 64 + np.minimum(d, 3).astype(np.int64) * 16 + slot


def _slot(order: int, within: np.ndarray) -> np.ndarray:
    """A number under 16 for a context of ``order`` 3 to 5 of whose bytes ``within`` lie in the token."""
    return np.minimum(within, order) + sum(range(order + 2, ORDER + 2))


class Contexts:
    """Sorted distinct (context of ``ORDER`` bytes, byte) pairs and their counts: one part of the contexts of three bytes and more."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.c = keys, counts.astype(float)
        self.q, self.s = (self.keys >> 8 * (ORDER - 1) & 255) << 8 | self.keys >> 8 * ORDER, self.keys & 255
        #: Bytes of the context since the token began.
        self.within = np.zeros(len(keys), np.int64)
        inside = np.ones(len(keys), bool)
        for k in range(1, ORDER + 1):
            byte = self.keys >> 8 * (ORDER + 1 - k) & 255
            inside &= (byte != SPACE) & (byte != END[0])
            self.within += inside

    def _orders(self) -> Iterator[tuple]:
        """(order, pair of each key, a key of each pair, context of each pair, counts of pairs, totals and symbols of contexts), longest first."""
        for k in range(ORDER, 2, -1):
            pairs, some_key, pair = np.unique(self.keys >> 8 * (ORDER + 1 - k) << 8 | self.s, return_index=True, return_inverse=True)
            c = np.bincount(pair, self.c, len(pairs))
            context = np.cumsum(np.diff(pairs >> 8, prepend=-1) != 0) - 1
            yield k, pair, some_key, context, c, np.bincount(context, c), np.bincount(context, c > 0)

    def _class(self, n: np.ndarray, d: np.ndarray, k: int, key: np.ndarray) -> np.ndarray:
        return _class(n, d, _slot(k, self.within[key]))

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of (first << 16 | second << 8 | next), also of pairs that only texts held out have."""
        keys, back = np.unique(self.q << 8 | self.s, return_inverse=True)
        return keys, np.bincount(back, self.c, len(keys))

    def escapes(self) -> tuple[np.ndarray, np.ndarray]:
        """(tries, escapes) of each class of contexts, each training byte left out in turn."""
        tries, new = np.zeros(CLASSES), np.zeros(CLASSES)
        longer = None
        for k, pair, some_key, context, c, n, d in self._orders():
            if longer is None:
                # Bytes found again, then bytes that only they have put there.
                cases = [(np.flatnonzero(c > 1), 0), (np.flatnonzero(c == 1), 1)]
                for p, once in cases:
                    rest = n[context[p]] - 1
                    use = rest > 0
                    at = self._class(rest[use], d[context[p[use]]] - once, k, some_key[p[use]])
                    tries += np.bincount(at, c[p[use]], CLASSES)
                    new += np.bincount(at, minlength=CLASSES) * once
            else:
                # Those that the longer context had once only.
                key, above, gone, kinds = longer
                p = pair[key]
                seen = c[p]
                was = np.bincount(above[1], above[2] * c[pair[above[0]]])[gone]
                rest = n[context[p]] - 1 - (was - seen)
                left = d[context[p]] - (seen == 1) - (kinds - 1)
                use = rest > 0
                at = self._class(rest[use], left[use], k, key[use])
                tries += np.bincount(at, minlength=CLASSES)
                new += np.bincount(at, seen[use] == 1, CLASSES)
            key = np.flatnonzero((self.c == 1) & (c[pair] == 1))
            gone = context[pair[key]]
            longer = key, (some_key, context, c > 0), gone, d[gone]
        return tries, new

    def log_p(self, lower: Lower, escape: np.ndarray) -> np.ndarray:
        """Log probability of the byte of each key after its context."""
        out, todo = np.zeros(len(self.keys)), np.ones(len(self.keys), bool)
        above, kinds = None, np.zeros(len(self.keys))
        every = np.arange(len(self.keys))

        def gone(counts: np.ndarray) -> np.ndarray:
            """For each key, how much of the next context the longer one has seen; ``counts``: that context's, by key."""
            if above is None:
                return np.zeros(len(self.keys))
            some_key, context, seen, of_key = above
            return np.bincount(context, seen * counts[some_key])[of_key]

        for k, pair, some_key, context, c, n, d in self._orders():
            of_key = context[pair]
            left, symbols = n[of_key] - gone(c[pair]), d[of_key] - kinds
            goes = escape[self._class(np.maximum(left, 0), np.maximum(symbols, 0), k, every)]
            here = todo & (left > 0)
            found = here & (c[pair] > 0)
            missed = here & ~found
            out[found] += np.log((1 - goes[found]) * c[pair][found] / left[found])
            out[missed] += np.log(goes[missed])
            todo &= ~found
            above, kinds = (some_key, context, c > 0, of_key), d[of_key]
        n2, d2 = lower.sizes(self.q)
        n2, d2 = n2 - gone(lower.at(self.q, self.s)), d2 - kinds
        out[todo] += lower.log_p(self.q[todo], self.s[todo], n2[todo], d2[todo])
        return out


class _PairSums:
    """Merges the pairs of chunks; holds the distinct ones and at most ``MERGE_PAIRS`` or as many again."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, payload: bytes) -> None:
        keys, n = _items(payload)
        self.held.append((_unpacked(keys), _from_planes(n)))
        self.size += len(self.held[-1][0])
        if self.size > max(MERGE_PAIRS, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys, back = np.unique(np.concatenate([self.keys, *(k for k, _ in self.held)]), return_inverse=True)
        self.n = np.bincount(back, np.concatenate([self.n, *(n for _, n in self.held)]), len(keys))
        self.keys, self.held, self.size = keys, [], 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, part, payload) sorted by part -> (what, kind, part, key, n, payload): what each part has to say."""
    at, sums, counts = None, _PairSums(), {}

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal sums, counts
        if at is None:
            return
        kind, part = at
        if kind == WORDS:
            known = [w for w, n in counts.items() if n]
            payload = _bundle(_pack(b" ".join(known)), _pack(np.array([counts[w] for w in known], "<i8").tobytes()))
            said = [(KINDS, np.zeros(1, np.int64), np.array([len(known)]))]
            counts = {}
        else:
            sums.merge()
            model = Contexts(sums.keys, sums.n)
            tries, new = model.escapes()
            every = np.arange(CLASSES)
            said = [(LOW, *model.pair_counts()), (TRIES, every, tries), (ESCAPES, every, new)]
            said = [(what, k[(n > 0) | (what == LOW)], n[(n > 0) | (what == LOW)]) for what, k, n in said]
            payload = _bundle(_packed(sums.keys), _pack(sums.n.astype("<i8").tobytes()))
            sums = _PairSums()
        what = np.concatenate([[MERGED], *(np.full(len(k), w) for w, k, _ in said)])
        key = np.concatenate([[0], *(k for _, k, _ in said)])
        n = np.concatenate([[0], *(n for _, _, n in said)])
        payloads = pa.concat_arrays([pa.array([payload], pa.binary()), pa.nulls(len(what) - 1, pa.binary())])
        columns = [pa.array(what, pa.int32()), pa.array(np.full(len(what), kind), pa.int32()), pa.array(np.full(len(what), part), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(key, pa.int64()), pa.array(n.astype(np.int64)), payloads], names=["what", "kind", "part", "key", "n", "payload"])

    for batch in batches:
        kinds, parts = batch.column("kind").to_pylist(), batch.column("part").to_pylist()
        for kind, part, payload in zip(kinds, parts, batch.column("payload")):
            if (kind, part) != at:
                yield from close()
                at = (kind, part)
            if kind == PAIRS:
                sums.add(payload.as_py())
            else:
                words, _, n = _items(payload.as_py())
                for w, k in zip(_unpack(words).split(b" "), _from_planes(n).tolist()):
                    counts[w] = counts.get(w, 0) + k
    yield from close()


def _answers(one: np.ndarray, escape: np.ndarray) -> Callable:
    """Rows of a part: counts of its two-byte contexts (step 0), its merged counts (1), then rows of chunks (2), which are answered one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low, model = None, [], None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("kind", "part", "step", "chunk", "key", "n")]
            for (kind, part, step, chunk, key, n), payload in zip(zip(*columns), batch.column("payload")):
                if (kind, part) != at:
                    at, low, model = (kind, part), [], None
                if step == 0:
                    low.append((key, n))
                elif step == 1:
                    first, counts = _items(payload.as_py())
                    counts = np.frombuffer(_unpack(counts), "<i8")
                    if kind == PAIRS:
                        some = np.array(low, np.int64).reshape(-1, 2)
                        some = some[some[:, 1] > 0]
                        keys = _unpacked(first)
                        model = keys, Contexts(keys, counts).log_p(Lower(some[:, 0], some[:, 1], one), escape) / np.log(10)
                    else:
                        model = dict(zip(_unpack(first).split(b" "), counts.tolist()))
                elif kind == PAIRS:
                    keys = _items(payload.as_py())[0]
                    lp = model[1][np.searchsorted(model[0], _unpacked(keys))]
                    out.append((chunk, kind, part, _bundle(keys, _planes(lp, "<f4"))))
                else:
                    words, numbers, _ = _items(payload.as_py())
                    known = np.array([model.get(w, 0) for w in _unpack(words).split(b" ")], "<i8")
                    out.append((chunk, kind, part, _bundle(words, numbers, _pack(known.tobytes()))))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["chunk", "kind", "part", "payload"])

    return run


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, all of which are there; sorted with their places in one word, block by block."""
    out = np.empty(len(wanted))
    for a in range(0, len(wanted), 1 << 16):
        block = wanted[a : a + (1 << 16)].astype(np.uint64) << np.uint64(16)
        block |= np.arange(len(block), dtype=np.uint64)
        block.sort()
        key = (block >> np.uint64(16)).astype(np.int64)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        found = values[np.searchsorted(keys, key[first])]
        out[a + (block & np.uint64(0xFFFF)).astype(np.int64)] = np.repeat(found, np.diff(first, append=len(key)))
    return out


def _document_scores(docs: list[np.ndarray], words: list[bytes], keys: np.ndarray, lp: np.ndarray) -> Iterator[float]:
    """Log10 probability of each document, given as token numbers."""
    wanted: list[np.ndarray] = []
    for k, ids in enumerate(docs):
        wanted.append(_document_keys([words[i] for i in ids.tolist()]))
        if sum(map(len, wanted)) >= 1 << 19 or k == len(docs) - 1:
            each, starts = _looked_up(keys, lp, np.concatenate(wanted)), np.cumsum([0, *map(len, wanted[:-1])])
            yield from np.add.reduceat(each, starts).tolist()
            wanted = []


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk, sorted: its tokens, its pairs, its documents -> (doc_id, held_out, n_tokens, n_known, log_counts, score)."""
    chunk = None
    for batch in batches:
        out: list[tuple] = []
        for at, kind, ids, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "ids", "n")), batch.column("payload")):
            if at != chunk:
                chunk, words, numbers, known, keys, lps = at, [], [], [], [], []
            if kind == WORDS:
                some, places, counts = _items(payload.as_py())
                words += _unpack(some).split(b" ")
                numbers.append(_unpacked(places))
                known.append(np.frombuffer(_unpack(counts), "<i8"))
            elif kind == PAIRS:
                some, lp = _items(payload.as_py())
                keys.append(_unpacked(some))
                lps.append(_from_planes(lp, "<f4"))
            else:
                order = np.argsort(np.concatenate(numbers))
                words, c = [words[i] for i in order], np.concatenate(known)[order]
                docs = np.split(_from_planes(payload.as_py()), np.cumsum(sizes)[:-1])
                scores = _document_scores(docs, words, np.concatenate(keys), np.concatenate(lps))
                logs = np.log10(c + 1.0)
                for doc_id, n, tokens, score in zip(ids, sizes, docs, scores):
                    out.append((doc_id, held_out(doc_id), n, int((c[tokens] > 0).sum()), float(logs[tokens].sum()), score))
                words, numbers, known, keys, lps = [], [], [], [], []
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def _splitters(thin: DataFrame, n_parts: int, n_rows: int) -> np.ndarray:
    """Three-byte contexts that deal the distinct pairs of the texts into even parts, from a few of them."""
    if n_parts == 1:
        return np.zeros(0, np.int64)
    one_in = max(1, n_rows // SAMPLE_ROWS)
    texts = thin.where(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(one_in)) == 0).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_ROWS).collect()
    keys = [_document_keys(_tokens(r.text)) for r in texts]
    if not keys:
        return np.zeros(0, np.int64)
    of_three = _three(np.unique(np.concatenate(keys)))
    return np.unique(of_three[np.arange(1, n_parts) * len(of_three) // n_parts])


def escape_estimates(tries: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Probability of an escape in each class of contexts; one half without any try."""
    return np.clip((0.5 + escapes) / (1.0 + tries), 1e-9, 0.999)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    Tokens are the words of the text with A-Z lower-cased, then one end. Texts whose
    ``held_out`` is false are learnt from; the others change nothing. base_score is the
    add-one unigram score, score the model's log10 probability, to which the order of the
    words counts. A null text is empty: one token. A null id counts as an empty string
    for the split. A repeated row is learnt from again and scored alike. Without training
    texts every byte is uniform. An empty table gives an empty result; columns that are
    not named are not read. A document is held whole by one task, and so is a chunk.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = thin.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_parts = 1 + (size.bytes or 0) // PART_BYTES
    rows = scratch.keep(thin.mapInArrow(_chunks(_splitters(thin, n_parts, size.n), n_parts), ROWS))
    sent = rows.where(F.col("kind") != DOCS).select("kind", "part", "chunk", "payload")
    by_part = sent.repartition("kind", "part").sortWithinPartitions("kind", "part")
    said = scratch.keep(by_part.mapInArrow(_parts, "what int, kind int, part int, key long, n long, payload binary"))

    lows = said.where(F.col("what") == LOW)
    low = scratch.keep(lows.groupBy("key").agg(F.sum("n").alias("n")))
    one = np.zeros((256, 256))
    for r in low.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).where("n > 0").collect():
        one[r.key >> 8, r.key & 255] = r.n
    classes = np.zeros((2, CLASSES))
    for r in said.where(F.col("what").isin(TRIES, ESCAPES)).groupBy("what", "key").agg(F.sum("n").alias("n")).collect():
        classes[r.what - TRIES, r.key] = r.n
    kinds = said.where(F.col("what") == KINDS).agg(F.sum("n")).first()[0] or 0

    # The two-byte contexts that end a part's pairs, with all that follows them anywhere.
    ends = lows.select("part", F.shiftright("key", 8).alias("q")).distinct()
    of_part = ends.join(low.withColumn("q", F.shiftright("key", 8)), "q").select(F.lit(PAIRS).alias("kind"), "part", F.lit(0).alias("step"), "key", "n")
    merged = said.where(F.col("what") == MERGED).select("kind", "part", F.lit(1).alias("step"), "payload")
    asked = of_part.unionByName(merged, allowMissingColumns=True).unionByName(sent.withColumn("step", F.lit(2)), allowMissingColumns=True)
    asked = asked.repartition("kind", "part").sortWithinPartitions("kind", "part", "step")
    answers = asked.mapInArrow(_answers(one, escape_estimates(*classes)), "chunk long, kind int, part int, payload binary")

    texts = rows.where(F.col("kind") == DOCS)
    back = answers.unionByName(texts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind", "part")
    scored = back.mapInArrow(_scored, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    total = rows.where(F.col("kind") == DOCS).select(F.explode(F.arrays_zip("ids", "n")).alias("d"))
    held = F.pmod(F.crc32(F.coalesce(F.col("d.ids").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    total = total.where(~held).agg(F.sum("d.n")).first()[0] or 0
    base = F.col("log_counts") - F.col("n_tokens") * float(np.log10(total + kinds + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
