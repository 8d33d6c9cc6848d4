"""Column expressions on texts and values. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks, trimmed space and the length of a short line.
NEWLINES = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"
LINE_SPACE = r"[\p{Zs}\t]"
SHORT_LINE = 30


def _trim(col: Column, space: str) -> Column:
    return F.regexp_replace(col, f"^{space}+|{space}+$", "")


def nonblank(col: Column) -> Column:
    """Text without white space and line breaks at both ends."""
    return _trim(col, r"[\s\p{Z}\x{85}]")


def normalize_ocr(col: Column) -> Column:
    """Merge the lines of an OCR text; null stays null.

    Lines are trimmed and empty ones dropped. A line of fewer than 30 characters that
    ends in ``:`` or ``-`` or has no digit goes on into the next line after a space.
    So each line is written with a space or a line break after it, and the last
    character goes. Characters are grapheme clusters, counted only where marks or
    joiners occur.
    """
    lines = F.filter(F.transform(F.split(col, NEWLINES), lambda x: _trim(x, LINE_SPACE)), lambda x: x != "")

    def ended(line: Column) -> Column:
        clusters = line.rlike(r"[\p{M}\x{200D}\x{FE0F}]") & (F.regexp_count(line, F.lit(r"\X")) < SHORT_LINE)
        short = (F.char_length(line) < SHORT_LINE) | clusters
        goes_on = short & (line.endswith(":") | line.endswith("-") | ~line.rlike(r"\p{N}"))
        return F.concat(line, F.when(goes_on, " ").otherwise("\n"))

    merged = F.array_join(F.transform(lines, ended), "")
    return F.substring(merged, F.lit(1), F.char_length(merged) - 1)


def name_tokens(col: Column) -> Column:
    """Lower-cased parts of a name between plain spaces, without empty ones."""
    return F.filter(F.split(F.lower(col), " "), lambda x: x != "")


def mentions(question: Column, name: Column) -> Column:
    """Whether the question, lower-cased already, contains a part of the name. A name without parts never matches."""
    return F.exists(name_tokens(name), lambda part: F.contains(question, part))


def fragment_key(test_name: Column, name: Column) -> Column:
    return F.concat(test_name, F.lit(" — "), name)


def fragment_value(value: Column, unit: Column, reference_range: Column) -> Column:
    """A null unit leaves two spaces, a null range is n/a."""
    return F.concat(value, F.lit(" "), F.coalesce(unit, F.lit("")), F.lit(" (ref: "), F.coalesce(reference_range, F.lit("n/a")), F.lit(")"))


def marker_identity(name: Column, unit: Column) -> Column:
    return F.concat(name, F.coalesce(unit, F.lit("")))


def parse_measure(col: Column) -> Column:
    """Text to double. Null unless the whole text is a plain decimal number."""
    return F.when(col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), col.try_cast("double"))


def flag_bucket(flag: Column) -> Column:
    """high, low, normal or other; null for a null or empty flag."""
    low = F.lower(flag)
    return F.when(flag.isNull() | (flag == ""), None).when(low.isin("high", "low", "normal"), low).otherwise("other")


def flag_colour(flag: Column) -> Column:
    bucket = flag_bucket(flag)
    return F.when(bucket == "high", "red").when(bucket == "low", "orange").when(bucket == "normal", "green").when(bucket == "other", "gray")


def reference_label(reference_range: Column) -> Column:
    return F.when(F.coalesce(reference_range, F.lit("")) != "", F.concat(F.lit("Reference: "), reference_range))


def chat_source_label(role: Column, source: Column, assistant: str = "Brain") -> Column:
    """Who said it: the user, or the assistant in the cloud or on the device."""
    return F.when(role == "user", "You").when((role == "assistant") & (source == "cloud"), f"{assistant} ☁️").when(role == "assistant", f"{assistant} 📱")


def display_day(col: Column) -> Column:
    return F.to_date(col)


def char_runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, one for each place; none for a shorter or null text.

    The text is cut into its characters once: taking a substring at each place would read it from its start each time.
    """

    def cut(chars: Column) -> Column:
        run = lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]) if size > 1 else F.get(chars, i)
        return F.when(F.size(chars) >= size, F.transform(F.sequence(F.lit(0), F.size(chars) - size), run)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.when(text != "", F.split(text, ""))), cut), F.lit(0))
