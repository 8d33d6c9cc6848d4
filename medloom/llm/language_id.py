"""Language identification by Bayesian evidence fusion.

    P(language | all) ~ P(text | language)^t * P(declared | language) * P(language | host)

The text likelihood is naive Bayes over whole words, word endings and, in scripts without
spaces and long words, pairs of characters, tempered so that no text counts for more than
``EFFECTIVE`` independent features. Each language has its own share of the sample, so that
a large one does not displace a small one. The reliability of the declared language is
measured on rows that the classifier was not fitted on, and it and the host priors are
grouped aggregates over all of them: a host's counts are smoothed towards those of its
address suffix, and these towards those of the corpus. A row's own vote is taken out of
its prior.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import USER, Scratch, quoted, spread_join, unpacked, worker_cache

#: The classifier is fitted on about this many distinct texts with a declared language ...
SAMPLE_ROWS = 20_000
#: ... and keeps the features that it finds this often in a language. A longer name is not that of a language.
MIN_COUNT, LONGEST_NAME = 3, 100
#: Languages of a text that are this far below its best one, in nats, count as without any of its features.
MARGIN = 120.0
#: Features that a text counts for at most; pseudo-counts of the smoothing levels.
EFFECTIVE, ADD, HOST_STRENGTH, SUFFIX_STRENGTH = 60.0, 0.5, 20.0, 20.0
#: Rows, and right ones among them, that the declared language begins with.
TRUST_ROWS, TRUST_RIGHT = 10.0, 9.0
MIN_CONFIDENCE = 0.5
#: Rows in one Arrow batch of results.
OUT_ROWS = 1000


def features(text: str | None) -> Counter:
    """Lower-case words of up to 24 characters and the last three characters of each word; all characters and pairs of longer words and of words from Thai on in code-point order, as of scripts without spaces."""
    out: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        word = word.strip(".,;:!?\"'()|%&$#*")
        if word and not word.isdigit():
            if len(word) <= 24:
                out[word] += n
            out["~" + word[-3:]] += n
            if len(word) > 24 or not word.isascii() and max(word) >= "\u0e00":
                for i in range(len(word)):
                    out["_" + word[i]] += n
                    if i:
                        out["_" + word[i - 1 : i + 1]] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        per: dict[int, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            per.setdefault(lang, Counter()).update(features(text.as_py()))
        rows = [(f, lang, n) for lang, counts in per.items() for f, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
            names=["feature", "l", "n"],
        )


class Model:
    """Languages, and what each feature adds to the log-likelihood of the languages that have it.

    A feature that a language has not is equally likely in all of them, so only the others are kept.
    """

    def __init__(self, languages: list[str], features: list[str], ends: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.languages, self.at, self.ends, self.lang = languages, {f: k for k, f in enumerate(features)}, ends, lang
        sums = np.bincount(lang, n, minlength=len(languages))
        # What a language has not seen is as likely in a small one as in a large one.
        add = ADD * np.maximum(sums, 1) / max(1, sums.max(initial=0))
        self.gain = np.log1p(n / add[lang])

    def log_likelihoods(self, counts: Counter) -> tuple[np.ndarray, np.ndarray, float, int]:
        """(languages, their log-likelihoods, 0 at most, that of all others, occurrences of known features).

        Languages that are more than ``MARGIN`` below the best count among the others: what they
        would add to a posterior is beyond the digits of a double.
        """
        found = [(self.at[f], n) for f, n in counts.items() if f in self.at]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0), 0.0, 0
        rows, times = np.array(found).T
        starts, lens = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        at = np.arange(lens.sum()) + np.repeat(starts - (np.cumsum(lens) - lens), lens)
        each = np.bincount(self.lang[at], np.repeat(times, lens) * self.gain[at], minlength=len(self.languages)) * min(1.0, EFFECTIVE / times.sum())
        best = each.max()
        near = np.flatnonzero(each > max(0.0, best - MARGIN)).astype(np.int32)
        return near, each[near] - best, -best, int(times.sum())


def _hashed(lang: Column, text: Column) -> Column:
    """What decides whether a row is in the sample that the classifier is fitted on."""
    return F.xxhash64(lang, text)


def fit(rows: DataFrame, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS, min_count: int = MIN_COUNT, scratch: Scratch | None = None) -> tuple[Model, dict[str, int]]:
    """(model, language -> one in how many of its rows is drawn), on a hashed sample of the labelled rows of each language.

    Each language has an equal share of ``sample_rows``, of which it fills what it has. A
    text that rows repeat is drawn once. Names differ by more than case. At most
    ``sample_rows`` names are learnt, so that each has a row: the most frequent ones.
    """
    spark = rows.sparkSession
    labelled = rows.select(F.lower(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = labelled.where((F.col("lang") != "") & (F.char_length("lang") <= LONGEST_NAME))
    sizes = (scratch or Scratch(spark, "langid")).keep(labelled.groupBy("lang").count())
    found = {r["lang"]: r["count"] for r in sizes.orderBy(F.col("count").desc(), "lang").limit(sample_rows).collect()}
    langs = sorted(found)
    if not langs:
        return Model([], [], np.zeros(1, int), np.zeros(0, int), np.zeros(0)), {}
    quota = max(1, sample_rows // len(langs))
    one_in = {lang: -(-found[lang] // quota) for lang in langs}
    rates = spark.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "l": pa.array(range(len(langs)), pa.int32()), "one_in": pa.array([one_in[x] for x in langs], pa.int64())}))
    drawn = labelled.join(F.broadcast(rates), "lang").where(F.pmod(_hashed(F.col("lang"), F.col("text")), "one_in") == 0)
    sample = drawn.groupBy("l", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    counts = sample.select("l", "text").mapInArrow(_counted, "feature string, l int, n long").groupBy("feature", "l").agg(F.sum("n").alias("n"))
    per = counts.groupBy("feature").agg(F.collect_list("l").alias("l"), F.collect_list("n").alias("n"), F.max("n").alias("most")).where(F.col("most") >= min_count)
    top = per.select("feature", "l", "n").toArrow().combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(top["l"]).to_numpy())]).astype(np.int64)
    flat = lambda c: pc.list_flatten(top[c]).to_numpy()
    return Model(langs, top["feature"].to_pylist(), ends, flat("l").astype(np.int64), flat("n").astype(float)), one_in


#: What ``_scored`` adds: candidates of the text with their log-likelihoods, that of all other languages, the best candidate, the declared language by number, whether the row was learnt from (null: its language was not).
SCORED = "ll array<struct<l int, x double>>, base double, n_known long, has_words boolean, text_best int, said int, drawn boolean"


def _scored(shipped, text_col: str | None) -> Callable:
    """Adds ``SCORED`` to batches of (user, text, declared, hashed, ..); the text is that of ``user`` if ``text_col`` names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language_id")
        model, one_in = shipped.value
        number = {lang: k for k, lang in enumerate(model.languages)}
        for whole in batches:
            for start in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                texts = pc.struct_field(batch.column(USER), text_col) if text_col else batch.column("text")
                near, lls, out = [], [], []
                for text, name, h in zip(texts, batch.column("declared").to_pylist(), batch.column("hashed").to_pylist()):
                    each = features(text.as_py())
                    l, x, base, n = model.log_likelihoods(each)
                    near.append(l)
                    lls.append(x)
                    said = number.get(name)
                    best = int(l[np.argmax(np.round(x, 9))]) if n else None
                    out.append((base, n, bool(each), best, said, None if said is None else h % one_in[name] == 0))
                ends = np.concatenate([[0], np.cumsum([len(l) for l in near])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(near), pa.int32()), pa.array(np.concatenate(lls), pa.float64())], ["l", "x"])
                names = [n for n in batch.schema.names if n not in ("text", "declared", "hashed")]
                types = [pa.float64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
                found = [pa.ListArray.from_arrays(pa.array(ends), pairs), *(pa.array(c, t) for c, t in zip(zip(*out), types))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], names=[*names, "ll", "base", "n_known", "has_words", "text_best", "said", "drawn"])

    return run


def _listed(values: list, kind: str) -> Column:
    """An array of constants as one literal: thousands of literals would make a slow plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _top(scores: Column) -> Column:
    """The language of the best of (score, l), the first of equal ones; null if there are none."""
    return F.array_max(F.transform(scores, lambda e: F.struct(F.round(e["score"], 9).alias("score"), (-e["l"]).alias("less"), e["l"].alias("l"))))["l"]


def _suffix(host: Column) -> Column:
    """The last part of a host name; null for a name without a dot."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def _identified(
    docs: DataFrame, text_col: str, declared_col: str, host_col: str, suffix_col: str | None, carry: list[str], sample_rows: int, min_confidence: float, min_count: int
) -> DataFrame:
    """(user, language, confidence, known_features, accepted); ``user`` has the columns ``carry``."""
    scratch = Scratch(docs.sparkSession, "langid")
    model, one_in = fit(docs, text_col, declared_col, sample_rows, min_count, scratch)
    langs, k = model.languages, len(model.languages)
    declared, host, text = F.lower(F.col(declared_col).cast("string")), F.col(host_col).cast("string"), F.col(text_col).cast("string")
    suffix = F.col(suffix_col).cast("string") if suffix_col else _suffix(host)
    inside = text_col in carry and dict(docs.dtypes)[text_col] == "string"
    evidence = docs.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias(USER), *([] if inside else [text.alias("text")]), declared.alias("declared"),
        F.when(host != "", host).alias("host"), F.when(suffix != "", suffix).alias("suffix"), _hashed(declared, text).alias("hashed"),
    )
    schema = T.StructType([f for f in evidence.schema.fields if f.name not in ("text", "declared", "hashed")])
    schema = T.StructType(schema.fields + T.StructType.fromDDL(SCORED).fields)
    shipped = docs.sparkSession.sparkContext.broadcast((model, one_in))
    rows = scratch.keep(evidence.mapInArrow(_scored(shipped, text_col if inside else None), schema))
    shipped.destroy()
    if not k:
        return rows.select(USER, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.col("n_known").alias("known_features"), F.lit(False).alias("accepted"))

    # How often the declared language is that of the text, where the text was not learnt from.
    both = rows.where("NOT drawn AND text_best IS NOT NULL")
    both = both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("said") == F.col("text_best")).cast("long")).alias("same")).first()
    # A declared language that is right less often than by chance says nothing.
    trust = max(((both.same or 0) + TRUST_RIGHT) / (both.n + TRUST_ROWS), 1 / k)
    right, other = math.log(trust), math.log(max((1 - trust) / max(1, k - 1), 1e-9))
    of_declared = lambda l: F.when(F.col("said").isNull(), 0.0).when(l == F.col("said"), right).otherwise(other)
    named = F.when(F.col("said").isNull() | F.exists("ll", lambda e: e["l"] == F.col("said")), F.array()).otherwise(F.array(F.struct(F.col("said").alias("l"), F.col("base").alias("x"))))
    rows = rows.withColumn("near", F.concat("ll", named.cast("array<struct<l int, x double>>")))
    rows = rows.withColumn("vote", _top(F.transform("near", lambda e: F.struct((e["x"] + of_declared(e["l"])).alias("score"), e["l"].alias("l")))))

    # Host within suffix within corpus: votes, a row for each language that has some.
    votes = scratch.keep(rows.where("vote IS NOT NULL").groupBy("host", "suffix", F.col("vote").alias("l")).agg(F.count(F.lit(1)).alias("n")))
    corpus = np.zeros(k)
    for r in votes.groupBy("l").agg(F.sum("n").alias("n")).collect():
        corpus[r.l] = r.n
    share = _listed(((corpus + 1) / (corpus.sum() + k)).tolist(), "double")
    ranking = _listed(np.argsort(-corpus, kind="stable").tolist(), "int")

    def level(by: dict[str, Column], name: str) -> DataFrame:
        each = votes.where(F.col(name).isNotNull()).groupBy(*[c.alias(n) for n, c in by.items()], "l").agg(F.sum("n").alias("n"))
        return scratch.keep(each.groupBy(*by).agg(F.collect_list(F.struct("l", "n")).alias("per"), F.sum("n").alias("n")))

    at = F.coalesce("suffix", F.lit(""))
    suffixes, hosts = level({"suffix": F.col("suffix")}, "suffix"), level({"host": F.col("host"), "at": at}, "host")
    rows = rows.withColumns({"spread": F.monotonically_increasing_id(), "at": at})
    fused = spread_join(rows, suffixes, ["suffix"], "n", F.col("spread")).withColumnRenamed("found", "s")
    fused = spread_join(fused, hosts, ["host", "at"], "n", F.col("spread")).withColumnRenamed("found", "h")

    # The prior is a_h * n_host + b_h * (a_s * n_suffix + b_s * share of the corpus), each count without the row's own vote.
    own = F.col("vote").isNotNull().cast("double")
    weight = lambda c, strength: F.coalesce(1 / (F.col(f"{c}.n") - own + strength), F.lit(0.0))
    above = lambda c, strength: F.when(F.col(c).isNull(), 1.0).otherwise(F.col(f"a_{c}") * strength)
    fused = fused.withColumns({"a_h": weight("h", HOST_STRENGTH), "a_s": weight("s", SUFFIX_STRENGTH)})
    fused = fused.withColumns({"b_h": above("h", HOST_STRENGTH), "b_s": above("s", SUFFIX_STRENGTH)})
    entry = lambda l, gain, prior: F.struct(l.cast("int").alias("l"), gain.cast("double").alias("gain"), prior.cast("double").alias("prior"))
    zero, none = F.lit(0.0), F.array().cast("array<struct<l int, gain double, prior double>>")
    others = lambda e: e["n"] - F.coalesce((e["l"] == F.col("vote")).cast("double"), zero)
    of = lambda c, a: F.coalesce(F.transform(f"{c}.per", lambda e: entry(e["l"], zero, a * others(e))), none)
    parts = F.concat(F.transform("near", lambda e: entry(e["l"], e["x"] - F.col("base"), zero)), of("h", F.col("a_h")), of("s", F.col("b_h") * F.col("a_s")))
    fused = fused.withColumn("parts", parts).withColumn("ids", F.array_distinct(F.transform("parts", lambda e: e["l"])))
    # Of the languages that nothing names, the most frequent one stands for itself.
    fused = fused.withColumn("rest", F.get(F.array_except(F.slice(ranking, F.lit(1), F.size("ids") + 1), "ids"), F.lit(0)))
    fused = fused.withColumn("parts", F.array_sort(F.concat("parts", F.when(F.col("rest").isNull(), none).otherwise(F.array(entry(F.col("rest"), zero, zero))))))
    # A language has one part of each kind at most; they are neighbours now, and are summed at the first.
    mates = lambda e, i, name: sum((F.when(F.get("parts", i + j)["l"] == e["l"], F.get("parts", i + j)[name]).otherwise(zero) for j in (1, 2)), e[name])
    begins = lambda e, i: (i == 0) | (F.get("parts", i - 1)["l"] != e["l"])
    summed = F.transform("parts", lambda e, i: F.when(begins(e, i), entry(e["l"], mates(e, i, "gain"), mates(e, i, "prior") + F.col("b_h") * F.col("b_s") * F.get(share, e["l"]))))
    fused = fused.withColumn("each", F.filter(summed, lambda e: e.isNotNull()))
    scores = F.transform("each", lambda e: F.struct((F.col("base") + e["gain"] + of_declared(e["l"]) + F.log(F.greatest(e["prior"], F.lit(1e-30)))).alias("score"), e["l"].alias("l")))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    fused = fused.withColumn("scores", scores).withColumn("left", F.greatest(1 - add(F.transform("each", lambda e: e["prior"])), zero))
    unnamed = F.col("left") * F.exp(F.col("base") + F.when(F.col("said").isNull(), 0.0).otherwise(other))
    fused = fused.withColumn("total", unnamed + add(F.transform("scores", lambda e: F.exp(e["score"]))))
    confidence = F.exp(F.array_max(F.transform("scores", lambda e: e["score"]))) / F.col("total")
    evident = (F.col("n_known") > 0) | (F.col("has_words") & (F.col("said").isNotNull() | F.col("h").isNotNull()))
    return fused.select(
        USER, F.get(_listed(langs, "string"), _top(F.col("scores"))).alias("language"), confidence.alias("confidence"),
        F.col("n_known").alias("known_features"), (evident & (confidence >= min_confidence)).alias("accepted"),
    )


def identify(
    docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", suffix_col: str | None = None,
    carry: list[str] = ("doc_id",), sample_rows: int = SAMPLE_ROWS, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT,
) -> DataFrame:
    """A row for each row of ``docs``: the columns ``carry``, then language, confidence, known_features, accepted.

    Rejected are texts without any word (null, empty, digits), those without any known
    feature whose declared language and host say nothing either, and those whose best
    language has under ``min_confidence``. A null or empty declared language, host or
    suffix is no evidence of that kind, nor is a declared name that was not learnt (see ``fit``).
    Long texts count whole; memory holds the distinct features of one text. Without ``suffix_col`` the suffix is that of the
    host, if it has a dot. Without any labelled row every text is rejected, with a null
    language. Ties go to the first language in code-point order; a repeated row counts
    again in the priors. An empty table gives an empty result.
    """
    found = _identified(docs, text_col, declared_col, host_col, suffix_col, list(carry), sample_rows, min_confidence, min_count)
    return unpacked(found, list(carry), "language", "confidence", "known_features", "accepted")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, suffix of web pages = (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    return pages.select(
        "page_id", text.alias("text"), F.when(declared != "", declared).alias("declared"),
        F.when(host != "", host).alias("host"), F.when(host != "", F.substring_index(host, ".", -1)).alias("suffix"),
    )


def identify_pages(pages: DataFrame) -> DataFrame:
    """``identify`` for web pages, with the markup's language, the address suffix and the host."""
    return identify(page_evidence(pages), "text", "declared", "host", "suffix", ["page_id", "host", "suffix", "declared"])


def keep_known_languages(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose text is accepted (see ``identify``), with all their columns, whatever their names."""
    found = _identified(docs, text_col, declared_col, host_col, None, list(docs.columns), SAMPLE_ROWS, MIN_CONFIDENCE, MIN_COUNT)
    return unpacked(found.where("accepted"), docs.columns)
