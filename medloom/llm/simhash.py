"""Near-dedup of SimHash fingerprints by covering locality-sensitive hashing.

For radius r, bit i of a fingerprint gets a nonzero vector phi(i) of r + 1 bits, and
there is one table for each nonzero vector v: its mask keeps the bits with an odd
<phi(i), v>. The phi of at most r differing bits lie in a proper subspace, so some v is
orthogonal to all of them, and its mask hides every difference: each pair within the
radius collides in some table, without exception.

Equal fingerprints are one node. A bucket yields a spanning tree of each of its
clusters, never its pairs. A bucket above ``MAX_BUCKET`` nodes is dealt again by
its hidden bits in r + 1 blocks, of which two near fingerprints share one, until
2^hidden nodes at most can be in it: exact, with bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import USER, Scratch, packed, quoted, spread_join, unpacked, worker_cache
from .graph import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Near copies that ``near_dedup`` drops: shingles of five words, and as many differing bits as its tables allow.
NEAR_RADIUS, NEAR_SHINGLE = 6, 5
MAX_BUCKET = 4096
#: Shingles whose bits are counted at a time, and rows in one Arrow batch of results.
BLOCK, OUT_ROWS = 1 << 14, 1000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 hashes of the word shingles of a text, repeats included; no words: 0."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = ends - sizes, ends[-n:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        some = zip(starts[k : min(k + BLOCK, n)].tolist(), stops[k : k + BLOCK].tolist())
        raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in some]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle: int, text_at: Callable) -> Callable:
    """Adds row (a number) and fp to the columns of a batch but its column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("simhash")
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                prints = [_signed(fingerprint(t.as_py(), shingle)) for t in text_at(batch)]
                names = [n for n in batch.schema.names if n != "text"]
                numbers = pa.array(range(row, row + batch.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), numbers, pa.array(prints, pa.int64())], names=[*names, "row", "fp"])
                row += batch.num_rows

    return run


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius + 1) - 1 masks, with phi(i) going round the nonzero vectors."""
    n = (1 << radius + 1) - 1
    phi = [1 + i % n for i in range(64)]
    return [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _finer(mask: int, radius: int) -> list[int]:
    """Masks that also show one of ``radius + 1`` blocks of the hidden bits."""
    hidden = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in hidden[k :: radius + 1]) for k in range(radius + 1)]


def _clusters(nodes: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Connected sets of two or more of the fingerprints, without a table of their pairs."""
    rest = nodes
    while len(rest) > 1:
        found, todo, rest = [rest[0]], [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                more = rest[near]
                found.extend(more)
                todo.extend(more)
                rest = rest[~near]
        if len(found) > 1:
            yield np.array(found)


def _bucket_links(radius: int, max_bucket: int) -> Callable:
    """Rows (mask, fp) sorted by bucket -> (a, b) tree edges, or (mask, fp) of a finer table with finer = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = [], [], []
        held: list[np.ndarray] = []
        at: tuple | None = None
        over = False

        def emit(a: np.ndarray, b: np.ndarray, finer: bool) -> None:
            out[0].append(np.asarray(a, np.int64))
            out[1].append(np.asarray(b, np.int64))
            out[2].append(np.full(len(a), finer))

        def deal(mask: int, nodes: np.ndarray) -> None:
            for m in _finer(mask & (1 << 64) - 1, radius):
                emit(np.full(len(nodes), _signed(m)), nodes, True)

        def close() -> None:
            nonlocal held, over
            if at is not None and not over and sum(map(len, held)) > 1:
                for cluster in _clusters(np.concatenate(held).view(np.uint64), radius):
                    tree = np.sort(cluster.view(np.int64))
                    k = np.arange(1, len(tree))
                    emit(tree[(k - 1) // 2], tree[k], False)
            held, over = [], False

        def flush() -> Iterator[pa.RecordBatch]:
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b", "finer"])
                for x in out:
                    x.clear()

        for batch in batches:
            masks, fps = (batch.column(c).to_numpy() for c in ("mask", "fp"))
            if not len(fps):
                continue
            keys = fps & masks
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (masks[1:] != masks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fps)]):
                here = (masks[a], keys[a])
                if here != at:
                    close()
                    at = here
                if over:
                    deal(int(masks[a]), fps[a:b])
                    continue
                held.append(fps[a:b])
                if sum(map(len, held)) > max_bucket:
                    over = True
                    for part in held:
                        deal(int(masks[a]), part)
                    held = []
            yield from flush()
        close()
        yield from flush()

    return run


def near_links(scratch: Scratch, prints: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) that connect whatever of the distinct fingerprints ``prints`` = (fp) is linked within the radius."""
    if max_bucket < 1 << radius:
        raise ValueError("max_bucket must be at least 2 ** radius")
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius)])
    tables, edges = prints.select(F.explode(masks).alias("mask"), "fp"), None
    while True:
        bucket = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = tables.repartition("mask", bucket).sortWithinPartitions("mask", bucket)
        links = scratch.keep(dealt.mapInArrow(_bucket_links(radius, max_bucket), "a long, b long, finer boolean"))
        found = links.where("not finer").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        finer = links.where("finer")
        if finer.isEmpty():
            return edges
        tables = finer.select(F.col("a").alias("mask"), F.col("b").alias("fp"))


def _rooted(scratch: Scratch, rows: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """(fp, root) of the fingerprints that are linked to another, for ``rows`` with fp."""
    roots = components(scratch, near_links(scratch, scratch.keep(rows.select("fp").distinct()), radius, max_bucket))
    return roots.withColumnRenamed("node", "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp (long), component_id of each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits
    reach. Texts of fewer words than a shingle are one shingle; null, empty and
    wordless texts have the fingerprint 0 and are linked like any other. Rows that
    repeat a doc_id are rows of their own; a component of null ids only is null. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    thin = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    rows = scratch.keep(thin.mapInArrow(_fingerprints(shingle, lambda batch: batch.column("text")), "doc_id long, row long, fp long").drop("row"))
    first = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = first.join(_rooted(scratch, first, radius, max_bucket), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = scratch.keep(linked)
    smallest = scratch.keep(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    of_print = scratch.keep(linked.join(smallest, "root").select("fp", "component_id"))
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = NEAR_RADIUS, shingle: int = NEAR_SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row of each component of ``docs``, with all its columns, whatever their names.

    It is the one with the smallest doc_id, null last, and of these the first that the
    scan meets. Nulls, empty and short texts are as in ``simhash_components``. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    key = F.col(quoted(id_col)).cast("long").alias("id")
    inside = dict(docs.dtypes)[text_col] == "string"
    thin = packed(docs, key, *([] if inside else [F.col(quoted(text_col)).cast("string").alias("text")]))
    text_at = (lambda batch: pc.struct_field(batch.column(USER), text_col)) if inside else (lambda batch: batch.column("text"))
    schema = T.StructType([f for f in thin.schema.fields if f.name != "text"]).add("row", T.LongType()).add("fp", T.LongType())
    rows = scratch.keep(thin.mapInArrow(_fingerprints(shingle, text_at), schema))
    # min() of this struct is the row that stays.
    best = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best")
    prints = scratch.keep(rows.groupBy("fp").agg(best, F.count(F.lit(1)).alias("n")))
    linked = prints.join(_rooted(scratch, prints, radius, max_bucket), "fp", "left").select("fp", "best", "n", F.coalesce("root", "fp").alias("root"))
    linked = scratch.keep(linked)
    stays = linked.groupBy("root").agg(F.min("best").alias("stays"), F.sum("n").alias("of_root")).where("of_root > 1")
    # Few prints have company, and few of their rows stay: only the numbers of those that go meet the texts.
    crowded = scratch.keep(linked.join(stays, "root").select("fp", F.col("stays.row").alias("stays"), "n"))
    gone = spread_join(rows.select("fp", "row"), crowded, ["fp"], "n", F.col("row")).where("found.stays <> row").select("row")
    return unpacked(rows.select("row", USER).join(scratch.keep(gone), "row", "left_anti"), docs.columns)
