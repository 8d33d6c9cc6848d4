"""URL filtering by rules and, where no rule fits, by a character language-model ratio.

Two variable-order Markov models over the bytes of host and path, one of URLs that the
rules allow and one of those that they block, are interpolated by Witten-Bell
smoothing from order ``ORDER`` down to a uniform one. A URL is judged by the
difference of its log-likelihoods divided by its length, against a threshold that is
calibrated on all labelled URLs that are held out from the fit; all others are learnt from.

The counts of grams stay a table. A byte's probability depends on the gram of it and the
bytes before it, so each distinct gram of the URLs in question is rated once, where it
meets the counts that end like it, and blocks of URLs get back the rates of their grams.
Only counts of single bytes and of pairs, 2^16 at most, are sent to all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, quoted

#: (verdict, rule); a rule is a host and the start of a path.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Longest context, and URLs whose scores are put together at a time.
ORDER, BLOCK = 5, 8192
#: One in so many labelled URLs is held out for the threshold; score bins of its search.
HELD_OUT, BINS = 5, 400


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _symbols(host: str, path: str) -> bytes:
    return b"\x01" + (host + path).encode() + b"\x00"


def _gram_keys(data: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each place of ``data``, and their number, as one long; of places after the ``begins`` of their URL."""
    out = np.full(len(data), size, np.int64)
    for back in range(size - 1, -1, -1):
        out <<= 8
        out[back:] |= data[: len(data) - back]
    return out[begins >= size - 1]


def _joined(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all URLs, place of each in its URL, first place of each URL)."""
    each = [_symbols(h, p) for h, p in zip(hosts, paths)]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    firsts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(each), np.uint8).astype(np.int64)
    return data, np.arange(len(data)) - np.repeat(firsts, sizes), firsts


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(verdict, gram, n): each byte after the first with each of its contexts, of length 0 to ORDER."""
    for batch in batches:
        verdicts = batch.column("verdict").to_pylist()
        for verdict in set(verdicts):
            pick = [k for k, v in enumerate(verdicts) if v == verdict]
            hosts, paths = (batch.column(c).take(pa.array(pick)).to_pylist() for c in ("host", "path"))
            data, at, _ = _joined(hosts, paths)
            keys = [_gram_keys(data, at, size) for size in range(1, ORDER + 2)]
            keys[0] = _gram_keys(data[at > 0], at[at > 0], 1)
            grams, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["verdict", "gram", "n"])


class MarkovModel:
    """Witten-Bell interpolation over the counts of byte grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order].astype(float)
        sizes = self.grams >> 8 * np.minimum(self._size(self.grams), ORDER + 1)
        # The gram without its last byte, marked by its own length.
        inner = self.grams - (sizes << 8 * sizes)
        contexts = (inner >> 8) + (sizes - 1 << 8 * (sizes - 1))
        self.contexts, back = np.unique(contexts, return_inverse=True)
        self.total, self.kinds = np.bincount(back, self.counts), np.bincount(back).astype(float)

    @staticmethod
    def _size(grams: np.ndarray) -> np.ndarray:
        """Bytes of each gram: its mark stands above them."""
        size = np.zeros(len(grams), np.int64)
        for k in range(1, ORDER + 2):
            size[grams >> 8 * k == k] = k
        return size

    def _interpolate(self, out: np.ndarray, open_: np.ndarray, here: np.ndarray, gram: np.ndarray, context: np.ndarray) -> None:
        """Mix what is known after ``context`` into ``out`` at ``here``; where nothing is, the place is closed to longer contexts."""
        k = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[k] == context
        open_[here[~known]] = False
        here, gram, k = here[known], gram[known], k[known]
        g = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        count = np.where(self.grams[g] == gram, self.counts[g], 0.0)
        out[here] = (count + self.kinds[k] * out[here]) / (self.total[k] + self.kinds[k])

    def p(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each byte of ``data`` after those before it in its URL."""
        out, open_ = np.full(len(data), 1 / 256), np.ones(len(data), bool)
        for n in range(ORDER + 1):
            open_ &= at >= n
            here = np.flatnonzero(open_)
            gram = np.full(len(here), n + 1, np.int64)
            context = np.full(len(here), n, np.int64)
            for back in range(n, -1, -1):
                gram = gram << 8 | data[here - back]
                if back:
                    context = context << 8 | data[here - back]
            self._interpolate(out, open_, here, gram, context)
        return out

    def pairs(self) -> np.ndarray:
        """Probability of each byte (column) after each single byte (row)."""
        data = np.stack([np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)], 1).ravel()
        return self.p(data, np.tile([0, 1], 1 << 16))[1::2].reshape(256, 256)

    def p_last(self, asked: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each gram after its others, by a model of grams of three bytes and more and by ``pairs``."""
        out, open_, size = pairs[asked >> 8 & 255, asked & 255], np.full(len(asked), len(self.grams) > 0), self._size(asked)
        for n in range(2, ORDER + 1):
            open_ &= size > n
            here = np.flatnonzero(open_)
            if len(here):
                inner = asked[here] & (1 << 8 * (n + 1)) - 1
                self._interpolate(out, open_, here, inner | n + 1 << 8 * (n + 1), inner >> 8 | n << 8 * n)
        return out


def _last_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The longest gram, of ``ORDER`` + 1 bytes at most, that ends at each place of ``data``, as ``_gram_keys`` has it."""
    size = np.minimum(at, ORDER) + 1
    out = size.copy()
    for back in range(ORDER, -1, -1):
        here = np.flatnonzero(size > back)
        out[here] = out[here] << 8 | data[here - back]
    return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram): the distinct longest grams of the URLs of each block in a batch."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks):
            pick = pa.array(np.flatnonzero(blocks == block))
            data, at, _ = _joined(*(batch.column(c).take(pick).to_pylist() for c in ("host", "path")))
            grams = np.unique(_last_grams(data, at)[at > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(grams)], names=["block", "gram"])


def _rates(pairs) -> Callable:
    """(gram, rate) of the grams in question and the counts with the same two bytes before the last: the log ratio of the two models."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        grams, verdicts = asked.column("gram").to_numpy(), np.array(known.column("verdict").to_pylist(), object)
        logs = []
        for verdict, table in pairs.value.items():
            pick = verdicts == verdict
            model = MarkovModel(*(known.column(c).to_numpy()[pick].astype(np.int64) for c in ("gram", "n")))
            logs.append(np.log(model.p_last(grams, table)))
        return pa.table({"gram": grams, "rate": logs[0] - logs[1]})

    return run


def _scores(urls: pa.Table, rates: pa.Table) -> pa.Table:
    """``urls`` of one block with llr, the mean rate of their grams."""
    if not urls.num_rows:
        return urls.append_column("llr", pa.array([], pa.float64()))
    data, at, firsts = _joined(*(urls.column(c).to_pylist() for c in ("host", "path")))
    grams = rates.column("gram").to_numpy()
    order = np.argsort(grams)
    found = rates.column("rate").to_numpy()[order][np.searchsorted(grams[order], _last_grams(data, at)[at > 0])]
    each = np.zeros(len(data))
    each[at > 0] = found
    llr = np.add.reduceat(each, firsts) / (np.diff(firsts, append=len(data)) - 1)
    return urls.append_column("llr", pa.array(llr))


def _threshold(held_out: DataFrame) -> float:
    """The score that splits held-out URLs with the least mean error of the two verdicts."""
    bin_of = F.floor(F.least(F.greatest(F.col("llr"), F.lit(-4.0)), F.lit(4.0)) * BINS / 8)
    counts = held_out.groupBy("verdict", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    per = {v: Counter({r.bin: r.n for r in counts if r.verdict == v}) for v in ("allow", "block")}
    n = {v: sum(c.values()) for v, c in per.items()}
    if not n["allow"] or not n["block"]:
        return 0.0
    best, below = (2.0, 0.0, 0), Counter()
    for cut in range(-BINS // 2, BINS // 2 + 2):
        error = below["allow"] / n["allow"] + 1 - below["block"] / n["block"]
        best = min(best, (error, abs(cut), cut))
        for v in per:
            below[v] += per[v][cut]
    return best[2] * 8 / BINS


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, llr of each row of ``pages``; llr is null where a rule decides.

    A null URL or one without ``://`` has an empty host and path and is judged by the
    models like any other. If the rules allow or block no URL, there is nothing to tell
    the two apart, and URLs without a rule are allowed. Repeated rows are judged alike;
    an empty table gives an empty result. Of ``pages`` only id and URL are read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = split_url(F.col(quoted(url_col)))
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_m", matched_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    # The number of a row's block is written with it, so that it is the same wherever it is read.
    block = F.floor(F.monotonically_increasing_id() / BLOCK)
    rows = scratch.keep(rows.select("page_id", "host", "path", F.col("_m.verdict").alias("verdict"), F.col("_m.rule").alias("rule"), block.alias("block")))

    held = F.pmod(F.shiftright(F.xxhash64("page_id", "host", "path"), 20), F.lit(HELD_OUT)) == 0
    # A repeated row is learnt from once.
    learnt = rows.where(F.col("verdict").isNotNull() & ~held).select("page_id", "verdict", "host", "path").distinct()
    counts = learnt.select("verdict", "host", "path").mapInArrow(_grams, "verdict string, gram long, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts)
    longer = F.col("gram") >= 3 << 24
    short = counts.where(~longer).toPandas()
    grams = {v: tuple(short.loc[short["verdict"] == v, c].to_numpy(np.int64) for c in ("gram", "n")) for v in ("allow", "block")}
    if not all(len(g) for g, _ in grams.values()):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"))
    pairs = spark.sparkContext.broadcast({v: MarkovModel(*g).pairs() for v, g in grams.items()})

    wanted = rows.where(F.col("verdict").isNull() | held)
    asked = scratch.keep(wanted.select("block", "host", "path").mapInArrow(_asked, "block long, gram long"))
    end = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("end")
    by_end = lambda df: df.withColumn("end", end).groupBy("end")
    rates = by_end(asked.select("gram").distinct()).cogroup(by_end(counts.where(longer))).applyInArrow(_rates(pairs), "gram long, rate double")
    rated = asked.join(rates, "gram").select("block", "gram", "rate")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    scored = scratch.keep(wanted.groupBy("block").cogroup(rated.groupBy("block")).applyInArrow(_scores, f"{schema}, llr double"))
    threshold = _threshold(scored.where("verdict IS NOT NULL"))
    judged = scored.where("verdict IS NULL").withColumn("verdict", F.when(F.col("llr") >= threshold, "allow").otherwise("block"))
    decided = rows.where("verdict IS NOT NULL").withColumn("llr", F.lit(None).cast("double"))
    columns = ["page_id", "host", "path", "rule", "verdict", "llr"]
    return decided.select(columns).unionByName(judged.select(columns))
