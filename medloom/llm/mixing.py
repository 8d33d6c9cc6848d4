"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``cap``: its odds ``rate / (cap - rate)`` are
tilted exponentially by its size, ``exp(dual * size / mean size)``, from a rate of 1.
That is the entropy-balancing solution under bounds; one dual per source makes the
expected words of the source equal its target. The duals of all sources are solved
together by distributed Newton iterations on grouped sums, over the counts of the
distinct (source, size) pairs. The rates are then rounded into copies with one hashed
threshold per source, found by a distributed histogram search. Rows that repeat a
document are numbered, so that each is rounded on its own.

DataFrame functions only. Every sum over documents is a partial aggregate, so one
source may hold any share of the rows. The per-source tables are broadcast only
below ``BROADCAST_SOURCES`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, USER, Scratch, packed, quoted, ranked, spread_join, unpacked

#: A per-source table is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000
#: Newton stops when no source misses its target by more than this share of it.
TOLERANCE, MAX_NEWTON = 1e-9, 60
#: A source that misses its target by more than this share after all steps is an error.
FAILED = 1e-6
#: Buckets of each round of the threshold search, and its rounds.
BUCKETS, ROUNDS = 1024, 3
#: Times that shorter documents fill what the rounding left of each source's target.
FILLS = 2
#: Newton steps in one job.
STEPS = 3
#: What tells documents apart.
KEY = ["doc_id", "source", "size", "nth"]


def n_words(text: F.Column) -> F.Column:
    """Number of runs of non-white-space characters; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE.replace("[", "[^") + "+")).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, docs, source_size, target) for ``sizes`` = (source, size, n).

    Sources in code-point order, null last, have the weights in turn. A target stops
    at ``cap`` times its source's size; what is above is shared by weight among the
    others, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    per = ranked(scratch, per, F.col("source").isNull(), F.col("source"))
    turn = (F.col("rank") % len(weights)).cast("int")
    per = scratch.keep(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)))
    limit = cap * F.col("source_size")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = limit <= F.lit(level) * F.col("weight")
        now = per.agg(
            F.count(F.when(above, 1)).alias("full"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if now.full == full or not now.weight:
            break
        full, level = now.full, (total - now.words) / now.weight
    return per.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def _rate(cap: int) -> F.Column:
    """Bounded exponential tilt of a rate of 1; the cap itself where the target is at the cap."""
    tilt = F.exp(F.least(F.greatest(-F.col("dual") * F.col("size") / F.col("mean"), F.lit(-700.0)), F.lit(700.0)))
    return F.when(F.col("full"), F.lit(float(cap))).when(F.col("mean") > 0, cap / (1 + (cap - 1) * tilt)).otherwise(F.lit(1.0))


def solve_duals(scratch: Scratch, sizes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``targets`` with the dual of each source that meets its target.

    Newton on the convex dual, all sources in one grouped job per step; a step that
    leaves the bracket of a source's dual is replaced by its bisection. Sources that are
    further than ``FAILED`` from their targets after ``MAX_NEWTON`` steps raise an error.
    """
    n_sources = targets.count()
    at = scratch.keep(
        targets.select(
            "source", "source_size", "target",
            (F.col("source_size") / F.col("docs")).alias("mean"),
            (F.col("target") >= cap * F.col("source_size")).alias("full"),
            F.lit(0.0).alias("dual"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"),
        )
    )
    key = F.col("source").eqNullSafe(F.col("_s"))

    def step(at: DataFrame) -> DataFrame:
        rate = _rate(cap)
        words = F.col("size") * F.col("n")
        sums = (
            sizes.withColumnRenamed("source", "_s").join(_small(at, n_sources), key)
            .groupBy("_s")
            .agg(
                F.sum(words * rate).alias("got"),
                F.sum(words * rate * (1 - rate / cap) * F.col("size") / F.col("mean")).alias("slope"),
            )
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - miss / F.col("slope")
        # A wide bracket is searched by steps that double from 1, not by its middle.
        middle = F.when(low == -1e4, F.least(2 * F.col("dual"), F.lit(-1.0))).when(high == 1e4, F.greatest(2 * F.col("dual"), F.lit(1.0))).otherwise((low + high) / 2)
        inside = (newton > low) & (newton < high) & (F.abs(newton - F.col("dual")) < 20)
        met = F.col("full") | (F.col("source_size") == 0) | (F.abs(miss) <= TOLERANCE * F.col("target"))
        return (
            at.join(_small(sums, n_sources), key)
            .withColumns({"met": met, "low2": low, "high2": high, "next": F.when(met, F.col("dual")).when(inside, newton).otherwise(middle)})
            .select("source", "source_size", "target", "mean", "full", F.col("next").alias("dual"), F.col("low2").alias("low"), F.col("high2").alias("high"), "met",
                    F.when(~F.col("met"), F.abs(miss) / F.col("target")).alias("off"))
        )

    for _ in range(MAX_NEWTON // STEPS):
        after = at
        for _ in range(STEPS):
            after = step(after.drop("met", "off"))
        after = scratch.keep(after)
        scratch.drop(at)
        at = after
        if at.where("not met").isEmpty():
            break
    else:
        failed = at.where(F.col("off") > FAILED).count()
        if failed:
            raise RuntimeError(f"{failed} of {n_sources} sources miss their targets after {MAX_NEWTON} steps")
    at = at.drop("met", "off")
    # Sums of doubles differ in their last digits from run to run; the rates must not.
    return at.withColumn("dual", F.round("dual", 9))


def _search(scratch: Scratch, steps: DataFrame, spans: DataFrame, n_sources: int) -> DataFrame:
    """(source, shift): the largest shift at which the words of a source are not above its target.

    ``steps`` = (_s, at, gain): a source gains words as the shift passes ``at`` in [-1, 1).
    ``spans`` = (source, target, below) with the words before all steps. Each round
    counts the gains in equal buckets of each source's interval and goes on in the bucket
    where the target is met, so all documents are counted, each time exactly.
    """
    key = F.col("source").eqNullSafe(F.col("_s"))
    spans = scratch.keep(spans.select("source", "target", "below", F.lit(-1.0).alias("low"), F.lit(2.0).alias("width")))
    for _ in range(ROUNDS):
        bucket = F.floor((F.col("at") - F.col("low")) / F.col("width") * BUCKETS)
        counts = (
            steps.join(_small(spans.where("width > 0"), n_sources), key).withColumn("bucket", bucket).where(F.col("bucket").between(0, BUCKETS - 1))
            .groupBy("source", "target", "below", "low", "width", "bucket").agg(F.sum("gain").alias("gain"))
        )
        upto = F.col("below") + F.sum("gain").over(Window.partitionBy("source").orderBy("bucket"))
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.col("bucket").desc())) == 1
        # The bucket that passes the target; if none does, all steps are taken.
        found = (
            counts.withColumns({"upto": upto, "last": last})
            .where((F.col("upto") - F.col("gain") <= F.col("target")) & ((F.col("upto") > F.col("target")) | F.col("last")))
            .withColumn("all", F.col("upto") <= F.col("target"))
            .select(
                F.col("source").alias("_s"), "all", (F.col("upto") - F.when(F.col("all"), 0).otherwise(F.col("gain"))).alias("below2"),
                (F.col("low") + F.when(F.col("all"), F.col("width")).otherwise(F.col("width") * F.col("bucket") / BUCKETS)).alias("low2"),
            )
        )
        narrowed = spans.join(_small(found, n_sources), key, "left").select(
            "source", "target", F.coalesce("below2", "below").alias("below"), F.coalesce("low2", "low").alias("low"),
            F.when(F.col("all"), 0.0).otherwise(F.col("width") / BUCKETS).alias("width"),
        )
        narrowed = scratch.keep(narrowed)
        scratch.drop(spans)
        spans = narrowed
    return spans.select(F.col("source").alias("_s"), F.col("low").alias("shift"))


def _uniform(seed: int) -> F.Column:
    """Uniform in [0, 1): 53 bits of a hash of the document, its source and its number among equal rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "nth"), 11) / F.lit(float(2**53))


def numbered(scratch: Scratch, thin: DataFrame) -> DataFrame:
    """``thin`` = (row, doc_id, source, size) with nth: the number from 0 of a row among those that repeat it in all but row, as a kept table.

    Only rows that have such company are ranked, in ranges that cut it.
    """
    key = F.struct("doc_id", "source", "size")
    hashed = thin.withColumn("h", F.xxhash64(key))
    shared = scratch.keep(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = scratch.keep(spread_join(hashed, shared, ["h"], "n", F.col("row")))
    alone = marked.where("found IS NULL").withColumn("nth", F.lit(0).cast("long"))
    crowd = ranked(scratch, marked.where("found IS NOT NULL"), key, F.col("row"))
    first = scratch.keep(crowd.groupBy("doc_id", "source", "size").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h")))
    first = first.select("h", F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "first", "n")
    # A hash that several keys share has several firsts: those of a row's own key count.
    firsts = scratch.keep(first.groupBy("h").agg(F.collect_list(F.struct("d", "s", "z", "first")).alias("firsts"), F.sum("n").alias("n")))
    found = spread_join(crowd.drop("found"), firsts, ["h"], "n", F.col("row"))
    own = F.filter(F.col("found.firsts"), lambda x: x["d"].eqNullSafe(F.col("doc_id")) & x["s"].eqNullSafe(F.col("source")) & (x["z"] == F.col("size")))
    nth = found.withColumn("nth", F.col("rank") - F.get(own, F.lit(0))["first"])
    columns = ["row", "doc_id", "source", "size", "nth"]
    return scratch.keep(alone.select(columns).unionByName(nth.select(columns)))


def _rounded(scratch: Scratch, rated: DataFrame, n_sources: int, cap: int) -> DataFrame:
    """``rated`` with copies: floor(rate + dither + shift), with one shift for each source.

    From -1 to 1 a document gains a copy at -frac(y) and at 1 - frac(y), for y = rate + dither.
    """
    y = F.col("rate") + _uniform(0)
    rows = rated.where("size > 0").select("source", "size", y.alias("y"))
    frac = F.col("y") - F.floor("y")
    gains = F.array(
        *[
            F.struct(at.alias("at"), F.when(got.between(1, cap), F.col("size")).otherwise(F.lit(0)).alias("gain"))
            for at, got in ((-frac, F.floor("y")), (1 - frac, F.floor("y") + 1))
        ]
    )
    steps = rows.select(F.col("source").alias("_s"), F.explode(gains).alias("g")).select("_s", "g.at", "g.gain").where("gain > 0")
    before = F.least(F.greatest(F.floor(F.col("y") - 1), F.lit(0)), F.lit(cap)) * F.col("size")
    spans = rows.groupBy("source").agg(F.sum(before).cast("double").alias("below"))
    targets = rated.groupBy(F.col("source").alias("_s")).agg(F.first("target").alias("target"))
    spans = spans.join(_small(targets, n_sources), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shifts = _search(scratch, steps, spans, n_sources)
    copies = F.least(F.greatest(F.floor(y + F.coalesce("shift", F.lit(0.0))), F.lit(0)), F.lit(cap))
    out = rated.join(_small(shifts, n_sources), F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(1)).cast("long")).drop("_s", "shift")


def _missing(rows: DataFrame) -> DataFrame:
    """(_s, miss): the words that each source is short of its target."""
    miss = F.first("target") - F.sum(F.col("copies") * F.col("size"))
    return rows.groupBy(F.col("source").alias("_s")).agg(miss.alias("miss"))


def _filled(scratch: Scratch, rows: DataFrame, n_sources: int, cap: int, seed: int) -> DataFrame:
    """One copy more of as many documents as go into what their source is short of, in hashed order.

    What the shift leaves is less than the document that it stopped at, which may be
    very long; shorter ones fill it.
    """
    key = F.col("source").eqNullSafe(F.col("_s"))
    misses = scratch.keep(_missing(rows))
    fits = (F.col("size") > 0) & (F.col("copies") < cap) & (F.col("size") <= F.col("miss"))
    short = rows.join(_small(misses, n_sources), key)
    steps = short.where(fits).select("_s", _uniform(seed).alias("at"), F.col("size").alias("gain"))
    spans = misses.where("miss > 0").select(F.col("_s").alias("source"), F.col("miss").alias("target"), F.lit(0.0).alias("below"))
    shifts = _search(scratch, steps, spans, n_sources).withColumnRenamed("_s", "_t")
    more = F.coalesce(fits & (_uniform(seed) < F.col("shift")), F.lit(False))
    out = short.join(_small(shifts, n_sources), F.col("source").eqNullSafe(F.col("_t")), "left")
    return out.withColumn("copies", F.col("copies") + more.cast("long")).drop("_s", "_t", "miss", "shift")


def _settled(rows: DataFrame, n_sources: int, cap: int) -> DataFrame:
    """One copy more or less of the one document in each source that brings its words nearest the target."""
    key = F.col("source").eqNullSafe(F.col("_s"))
    sign = F.signum("miss").cast("long")
    left = F.abs(F.col("miss") - sign * F.col("size"))
    fits = (F.col("copies") + sign).between(0, cap) & (F.col("size") > 0) & (left < F.abs("miss"))
    best = (
        rows.join(_small(_missing(rows), n_sources), key).where(fits)
        .groupBy("_s").agg(F.min_by(F.struct("doc_id", "size", "nth", sign.alias("sign")), F.struct(left, "doc_id", "nth")).alias("best"))
    )
    this = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("size") == F.col("best.size")) & (F.col("nth") == F.col("best.nth"))
    moved = F.when(F.col("best").isNotNull() & this, F.col("best.sign")).otherwise(F.lit(0))
    moved = F.least(F.greatest(F.col("copies") + moved, F.lit(0)), F.lit(cap)).cast("long")
    return rows.join(_small(best, n_sources), key, "left").withColumn("copies", moved).drop("_s", "best")


def _mixed(scratch: Scratch, thin: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``mix`` of the kept table ``thin`` = (row, doc_id, source, size), with its rows."""
    sizes = scratch.keep(thin.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = scratch.keep(source_targets(scratch, sizes, weights, cap))
    n_sources = targets.count()
    duals = scratch.keep(solve_duals(scratch, sizes, targets, cap))
    key = F.col("source").eqNullSafe(F.col("_s"))
    rated = numbered(scratch, thin).join(_small(duals.withColumnRenamed("source", "_s"), n_sources), key)
    rated = scratch.keep(rated.select("row", *KEY, "source_size", "target", _rate(cap).alias("rate")))
    rows = scratch.keep(_rounded(scratch, rated, n_sources, cap))
    for seed in range(1, 1 + FILLS):
        rows = scratch.keep(_filled(scratch, rows, n_sources, cap, seed))
    return _settled(rows, n_sources, cap).withColumn("taken", F.col("copies") * F.col("size"))


def _thin(id_col: str, text_col: str, source_col: str) -> list[F.Column]:
    named = (F.col(quoted(c)) for c in (id_col, source_col, text_col))
    return [F.monotonically_increasing_id().alias("row"), next(named).cast("long").alias("doc_id"), next(named).cast("string").alias("source"), n_words(next(named)).alias("size")]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """Copies of each document so that sources meet their shares of all words.

    Returns one row for each row of ``docs``: doc_id, source, size, source_size,
    target, rate, copies, taken = copies * size. Null text has size 0; a null source
    is a source, the last. Documents without words take no words (one copy). Rows that
    repeat each other are rounded each on its own. The copies depend on the rows alone,
    so reruns agree. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    out = _mixed(scratch, scratch.keep(docs.select(*_thin(id_col, text_col, source_col))), weights, cap)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (see ``mix``), with all their columns, whatever their names."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(packed(docs, *_thin(id_col, text_col, source_col)))
    copies = _mixed(scratch, rows.drop(USER), weights, cap).where("copies > 0").select("row", "copies")
    out = rows.select("row", USER).join(copies, "row").select(USER, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unpacked(out, docs.columns)
