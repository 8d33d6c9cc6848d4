"""Questions, the stored markers that they are about, prompts and the chat log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medloom.functions import text as fx
from medloom.operators import extract

# The lines around the fragments of a prompt, and the disclaimer that every reply needs.
HEADER, FOOTER = "--- HEALTH PASSPORT FRAGMENTS ---", "--- END FRAGMENTS ---"
DISCLAIMER = "This is a data summary, not medical advice. Consult a licensed physician."
CONSULT_PROMPT = f'You organise health data. Use the fragments only, never diagnose, and always add: "{DISCLAIMER}"'
#: Words of a diagnosis or a prescription.
STOP_WORDS = ["diagnos", "you have", "prescri", "диагноз"]
#: Talk of causes, and the wording that it needs.
CAUSES, WORDINGS = ["cause", "причин"], ["possible cause", "возможные причины", "возможных причин", "возможная причина", "возможной причин"]


def nonblank_questions(questions: DataFrame) -> DataFrame:
    """Questions without white space at their ends; empty ones go."""
    return questions.withColumn("text", fx.nonblank(F.col("text"))).where("text <> ''")


def _age(prefer: str) -> F.Column:
    at = F.unix_micros(F.col("date").cast("timestamp"))
    return -at if prefer == "oldest" else at


def winning_markers(tests: DataFrame, markers: DataFrame, prefer: str = "oldest", users: DataFrame | None = None) -> DataFrame:
    """user_id, test_name, name, value, unit, reference_range, age, test_id, pos: the row that holds each user's key.

    Tests are gone through newest first and later ones replace earlier ones, so the
    oldest holds; ties go to the larger test_id, then the larger pos. A question picks
    by the name alone, so this is done once per user and before any question. Only the
    ``users`` (user_id) are looked at, if given.
    """
    own = tests.where("user_id IS NOT NULL").select("test_id", "user_id", "test_name", "date")
    if users is not None:
        own = own.join(users.select("user_id").distinct(), "user_id", "left_semi")
    rows = markers.select("test_id", "pos", "name", "value", "unit", "reference_range").join(own, "test_id")
    order = F.struct(_age(prefer).alias("age"), "test_id", "pos")
    last = F.max_by(F.struct("value", "unit", "reference_range", order.alias("order")), order)
    return rows.groupBy("user_id", "test_name", "name").agg(last.alias("m")).select("user_id", "test_name", "name", "m.value", "m.unit", "m.reference_range", "m.order.*")


def context_match(questions: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of a question and a row of ``named`` (user_id, name, ..) of its user that it mentions."""
    asked = questions.where("user_id IS NOT NULL").select("question_id", "user_id", F.lower("text").alias("question"))
    return asked.join(named, "user_id").where(fx.mentions(F.col("question"), F.col("name")))


#: Characters of a gram of the index; shorter parts of names are grams themselves.
GRAM = 3


def question_grams(questions: DataFrame) -> DataFrame:
    """question_id, user_id, gram: the distinct substrings of up to ``GRAM`` characters of each lower-cased question."""
    grams = F.array_distinct(F.concat(*[fx.char_runs(F.lower("text"), n) for n in range(1, GRAM + 1)]))
    return questions.where("user_id IS NOT NULL AND text <> ''").select("question_id", "user_id", F.explode(grams).alias("gram"))


def name_postings(named: DataFrame, grams: DataFrame) -> DataFrame:
    """user_id, name, part, gram: each part of a user's names under the gram of it that the fewest questions have. Parts with a gram that no question has are left out."""
    names = named.where("user_id IS NOT NULL").select("user_id", "name").distinct()
    parts = names.select("user_id", "name", F.explode(F.array_distinct(fx.name_tokens(F.col("name")))).alias("part"))
    long = F.char_length("part") > GRAM
    cut = F.when(long, fx.char_runs(F.col("part"), GRAM)).otherwise(F.array("part"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = parts.select("part").distinct().select("part", F.explode(F.array_distinct(cut)).alias("gram")).join(counts, "gram", "left")
    best = own.groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0")
    return parts.join(best.select("part", "best.gram"), "part").select("user_id", "name", "part", "gram")


def match_candidates(questions: DataFrame, named: DataFrame) -> DataFrame:
    """question_id, user_id, name, part, matched: pairs of a question and a part of a name of its user that share the part's rarest gram, and whether the part is there."""
    grams = question_grams(questions)
    met = grams.join(name_postings(named, grams), ["user_id", "gram"]).select("question_id", "user_id", "name", "part")
    asked = questions.select("question_id", F.lower("text").alias("_question")).groupBy("question_id").agg(F.min("_question").alias("_question"))
    return met.join(asked, "question_id").withColumn("matched", F.contains("_question", F.col("part"))).drop("_question")


def indexed_match(questions: DataFrame, named: DataFrame) -> DataFrame:
    """As ``context_match``, by an index of grams: rows of ``named`` with the question_id that mentions them.

    Questions and names meet on user and gram instead of the user alone, so an account
    that many people share, with many names and questions, is dealt out over many keys.
    What meets is verified. A question_id stands for one question.
    """
    hits = match_candidates(questions, named).where("matched").select("question_id", "user_id", "name").distinct()
    return hits.join(named, ["user_id", "name"])


def match_report(questions: DataFrame, named: DataFrame) -> DataFrame:
    """part, n_candidates, n_matches: how often each part of a name was met and found; short parts are found in most questions."""
    found = F.count_if("matched").alias("n_matches")
    return match_candidates(questions, named).groupBy("part").agg(F.count(F.lit(1)).alias("n_candidates"), found)


def context_fragments(questions: DataFrame, tests: DataFrame, markers: DataFrame, prefer: str = "oldest") -> DataFrame:
    """question_id, key, value: what each question's user has stored about it, one row for each key.

    Different pairs of a test and a marker can make the same key; the order of the tests
    decides between them as well. Null names and values count as empty.
    """
    hits = context_match(questions, winning_markers(tests, markers, prefer, questions.where("user_id IS NOT NULL")))
    named = [F.coalesce(c, F.lit("")) for c in ("test_name", "name", "value")]
    key, value = fx.fragment_key(*named[:2]), fx.fragment_value(named[2], F.col("unit"), F.col("reference_range"))
    last = F.max_by(value, F.struct("age", "test_id", "pos"))
    return hits.groupBy("question_id", key.alias("key")).agg(last.alias("value"))


def fragment_prompt(questions: DataFrame, fragments: DataFrame, system_prompt: str = CONSULT_PROMPT) -> DataFrame:
    """question_id, user_id, text, n_fragments, prompt. Lines are in the order of their keys.

    A question without fragments keeps the system prompt as it is.
    """
    line = F.concat(F.lit("• "), F.col("key"), F.lit(": "), F.col("value"))
    lines = fragments.groupBy("question_id").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    out = questions.join(lines, "question_id", "left")
    n = F.coalesce(F.size("_lines"), F.lit(0))
    block = F.concat(F.lit(f"{system_prompt}\n\n{HEADER}\n"), F.array_join("_lines", "\n"), F.lit(f"\n{FOOTER}"))
    prompt = F.when(n > 0, block).otherwise(F.lit(system_prompt))
    return out.select("question_id", "user_id", "text", n.alias("n_fragments"), prompt.alias("prompt"))


def consult_requests(prompts: DataFrame, model: str = "default", temperature: float = 0.2) -> DataFrame:
    """question_id, payload: the prompt and the question alone; earlier turns are not sent."""
    return prompts.select("question_id", extract.request_payload(model, F.col("prompt"), F.col("text"), temperature).alias("payload"))


def parse_reply(responses: DataFrame) -> DataFrame:
    """``responses`` with status, error_text and reply, the text of the first choice, which may be empty."""
    out = extract.answered(responses)
    return out.withColumn("reply", F.when(F.col("status") == "ok", F.col("content"))).drop("content")


def chat_log(questions: DataFrame, replies: DataFrame, welcome: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, source.

    ``questions`` and ``replies`` = (conv_id, turn, text); only calls that succeeded have a
    reply. A conversation of ``welcome`` = (conv_id, text) without turns starts with that text.
    """
    turn = lambda df, role, source: df.select("conv_id", "turn", F.lit(role).alias("role"), "text", F.lit(source).alias("source"))
    turns = turn(questions, "user", "local").unionByName(turn(replies, "assistant", "cloud"))
    empty = welcome.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").withColumn("turn", F.lit(0).cast(dict(questions.dtypes)["turn"]))
    return turns.unionByName(turn(empty, "assistant", "local"))


def reply_compliance(replies: DataFrame, stop_words: list[str] | None = None, disclaimer: str = DISCLAIMER, text: str = "text") -> DataFrame:
    """``replies`` with has_stop_word, has_disclaimer, careful and compliant.

    A reply is careful if it names no causes, or names them as possible ones each time that it
    does. It complies if it is careful, has the disclaimer and no stop word. A null reply
    has nothing and does not comply.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    times = lambda words: sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0))
    stops = F.exists(F.array(*[F.lit(w) for w in (stop_words or STOP_WORDS)]), lambda w: F.contains(low, w))
    has = F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(disclaimer))
    out = replies.withColumns({"has_stop_word": stops, "has_disclaimer": has, "careful": times(CAUSES) <= times(WORDINGS)})
    return out.withColumn("compliant", ~F.col("has_stop_word") & F.col("has_disclaimer") & F.col("careful"))
