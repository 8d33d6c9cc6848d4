"""Names of people in texts: the owner's own, however written, and those of a directory.

A text is cut into words and the gaps between them, so its parts put together are the
text again. Words are matched to names, matches next to each other are merged to one
span, and the text is rebuilt around the spans. The words of a user's names are joined to
the user's documents and looked up row by row; names of the directory are found by an
equi-join on pairs of neighbouring words, of which only the capitalised ones are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"
SEGMENT = WORD + r"|[^\p{L}\p{M}\p{N}]+"
#: A gap across which two words of names are one name.
BRIDGE = r"^[ \t\n\r]{0,4}[,.'’-]?[ \t\n\r]{0,4}$"
CAPITAL = r"^\p{Lu}"
#: Words below this many characters (initials, particles) are no name by themselves.
MIN_CHARS = 3
MASK = "[NAME]"
_SALTS = 1 << 16


def words_of(name: Column) -> Column:
    """The lower-cased words of a name."""
    return F.transform(F.regexp_extract_all(name, F.lit(WORD), F.lit(0)), F.lower)


def own_words(profiles: DataFrame) -> DataFrame:
    """user_id, own: the distinct words of all names that a user's profiles have, one row for each user."""
    words = profiles.where("user_id IS NOT NULL").select("user_id", F.explode(words_of(F.col("full_name"))).alias("word"))
    return words.groupBy("user_id").agg(F.collect_set("word").alias("own"))


def name_pairs(people: DataFrame) -> DataFrame:
    """a, b: distinct pairs of words of one person's name, in both orders, the first of them also as its initial. Each has a word of ``MIN_CHARS``."""
    words = people.select("full_name").distinct().select(words_of(F.col("full_name")).alias("w"))
    each = words.select("w", F.posexplode("w").alias("i", "x")).select("x", F.posexplode("w").alias("j", "y"), "i").where("i <> j")
    both = each.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.substring("x", 1, 1).alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.substring("y", 1, 1).alias("b")))).alias("p"))
    return both.select("p.*").where(F.greatest(F.char_length("a"), F.char_length("b")) >= MIN_CHARS).distinct()


def _row_key(text: Column) -> list[Column]:
    return [F.xxhash64("doc_id", text).alias("_r1"), F.xxhash64(F.lit(7), F.col("doc_id"), text).alias("_r2")]


def _directory_hits(cut: DataFrame, people: DataFrame) -> DataFrame:
    """_r1, _r2, _found: numbers of the segments that are names of ``people``."""
    seg = lambda k: F.get(F.col("_segs"), k)
    starts = F.filter(F.sequence(F.lit(0), F.size("_segs") - 1), lambda k: seg(k).rlike(CAPITAL) & F.coalesce(seg(k + 2).rlike(CAPITAL) & seg(k + 1).rlike(BRIDGE), F.lit(False)))
    pairs = F.transform(starts, lambda k: F.struct(k.alias("k"), F.lower(seg(k)).alias("a"), F.lower(seg(k + 2)).alias("b")))
    # The outer form: the other one is filtered first, which works out the pairs twice. Rows without pairs meet no name.
    asked = cut.select("_r1", "_r2", F.explode_outer(pairs).alias("p")).select("_r1", "_r2", "p.*")
    found = asked.join(name_pairs(people), ["a", "b"])
    return found.groupBy("_r1", "_r2").agg(F.array_distinct(F.flatten(F.collect_set(F.array(F.col("k"), F.col("k") + 2)))).alias("_found"))


def with_name_spans(docs: DataFrame, profiles: DataFrame, people: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, user_id, ..) with _segs, the segments of the text, and _spans, (first, last) of the segments of each name.

    Every word of the user's names counts, alone or in any order and case; shorter words
    only next to a longer one. A name of ``people`` (full_name) counts where two of its words,
    or one and an initial, are capitalised neighbours. Several profiles of one user and
    repeated names make no further rows. Null texts have no spans.
    """
    salt = F.when(F.col("user_id").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    own = own_words(profiles).withColumnRenamed("user_id", "_user").withColumn("_salt", F.lit(0).cast("long"))
    keyed = docs.withColumns({"_user": F.coalesce("user_id", F.lit(0).cast(docs.schema["user_id"].dataType)), "_salt": salt})
    # Rows without a user are dealt out: they meet no names, and no task gets them all.
    out = keyed.join(own, ["_user", "_salt"], "left").drop("_user", "_salt")
    out = out.withColumn("_segs", F.regexp_extract_all(F.col(text), F.lit(SEGMENT), F.lit(0)))
    seg = lambda k: F.get(F.col("_segs"), k)
    low = F.lower(F.col(text))
    some = F.exists("own", lambda w: F.contains(low, w))
    numbers = F.when(F.coalesce(some, F.lit(False)), F.filter(F.sequence(F.lit(0), F.size("_segs") - 1), lambda k: F.array_contains(F.col("own"), F.lower(seg(k)))))
    hits = F.coalesce(numbers, F.array().cast("array<int>"))
    if people is not None:
        keys = _row_key(F.col(text))
        cut = docs.select(*keys, F.regexp_extract_all(F.col(text), F.lit(SEGMENT), F.lit(0)).alias("_segs"))
        found = _directory_hits(cut, people)
        out = out.select("*", *keys).join(found, ["_r1", "_r2"], "left").drop("_r1", "_r2")
        hits = F.array_sort(F.array_union(hits, F.coalesce("_found", F.array().cast("array<int>"))))
    out = out.withColumn("_hits", hits)
    hit = lambda i: F.get(F.col("_hits"), i)
    linked = lambda a, b: F.coalesce((b - a == 2) & seg(a + 1).rlike(BRIDGE), F.lit(False))
    firsts = F.filter("_hits", lambda h, i: (i == 0) | ~linked(hit(i - 1), h))
    lasts = F.filter("_hits", lambda h, i: (i == F.size("_hits") - 1) | ~linked(h, hit(i + 1)))
    islands = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    long_enough = lambda x: F.exists(F.sequence(x["first"], x["last"], F.lit(2)), lambda k: F.char_length(seg(k)) >= MIN_CHARS)
    return out.withColumn("_spans", F.filter(islands, long_enough)).drop("own", "_hits", "_found")


def masked(text: Column, mask: str = MASK) -> Column:
    """The text of a row of ``with_name_spans`` with ``mask`` for each span."""
    segs, spans = F.col("_segs"), F.col("_spans")
    part = lambda first, n: F.array_join(F.slice(segs, first + 1, n), "")
    after = lambda i: F.coalesce(F.get(spans, i)["last"] + 1, F.lit(0))
    # What lies between the span before and this one, then the mask.
    pieces = F.transform(spans, lambda x, i: F.concat(part(after(i - 1), x["first"] - after(i - 1)), F.lit(mask)))
    tail = part(after(F.size(spans) - 1), F.size(segs) - after(F.size(spans) - 1))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def name_spans(docs: DataFrame, profiles: DataFrame, people: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, span, start, name: what ``redact_pii`` would mask, numbered in each document, with the place of its first character (from 0)."""
    spans = with_name_spans(docs, profiles, people, text)
    rows = spans.select("doc_id", "_segs", F.posexplode("_spans").alias("span", "x"))
    before = F.char_length(F.array_join(F.slice("_segs", F.lit(1), F.col("x.first")), ""))
    name = F.array_join(F.slice("_segs", F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + 1), "")
    return rows.select("doc_id", "span", before.alias("start"), name.alias("name"))
