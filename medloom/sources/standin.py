"""The health record tables as views of the generated test tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class StandIn:
    """Tables of one folder of test data. Each property is a new lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def lab_tests(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("test_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("date"),
            F.col("o_orderstatus").alias("provider"), F.col("o_orderpriority").alias("test_name"),
        )

    #: Order of the lines of a test, over all their columns: their natural key repeats.
    LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

    @staticmethod
    def _fields() -> list[Column]:
        return [
            F.col("l_quantity").cast("string").alias("value"),
            F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("unit"),
            F.when(F.col("l_returnflag") != "N", F.lit("1-50")).alias("reference_range"),
            F.when(F.col("l_returnflag") == "R", "High").when(F.col("l_returnflag") == "A", "LOW").alias("flag"),
        ]

    @property
    def lab_markers(self) -> DataFrame:
        """pos numbers the lines of an order."""
        lines = self.table("lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*self.LINE_ORDER)))
        rows = lines.join(self.table("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("l_orderkey").cast("string").alias("test_id"), "pos", F.col("p_name").alias("name"), *self._fields())

    @property
    def markers_by_test(self) -> DataFrame:
        """``lab_markers``, numbered after the join with their parts: the rows of a test lie together, and what is grouped or joined by test next moves none of them.

        A part is one row with all it says, so that each line is numbered once.
        """
        parts = self.table("part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_name", "p_type")).alias("parts"))
        lines = self.table("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("test_id", F.col("l_orderkey").cast("string"))
        numbered = lines.withColumn("pos", F.row_number().over(Window.partitionBy("test_id").orderBy(*self.LINE_ORDER)))
        rows = numbered.select("test_id", "pos", "l_quantity", "l_linestatus", "l_returnflag", F.explode("parts").alias("p")).select("*", "p.*")
        return rows.select("test_id", "pos", F.col("p_name").alias("name"), *self._fields())

    @property
    def nested_tests(self) -> DataFrame:
        fields = F.struct("pos", "name", "value", "unit", "reference_range", "flag")
        nested = self.lab_markers.groupBy("test_id").agg(F.array_sort(F.collect_list(fields)).alias("markers"))
        return self.lab_tests.join(nested, "test_id", "left")

    @property
    def profiles(self) -> DataFrame:
        key = F.col("c_custkey")
        third = F.pmod(key, F.lit(3))
        return self.table("customer").select(
            key.alias("user_id"), F.col("c_name").alias("full_name"), F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(key, F.lit(9000)).cast("int")).cast("timestamp_ntz").alias("birth_date"),
            F.when(third == 0, "Male").when(third == 1, "Female").otherwise("Unknown").alias("gender"),
            F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("blood_type"),
            F.when(key % 5 != 0, (key % 60 + 140).cast("double")).alias("height"), F.when(key % 7 != 0, (key % 70 + 40).cast("double")).alias("weight"),
            F.when(third == 0, "English").when(third == 1, "Русский").when(key % 2 == 0, "Deutsch").alias("preferred_language"),
        )

    @property
    def profile_edits(self) -> DataFrame:
        """Edits of a third of the users, and new users with ids above a million."""
        key = F.col("c_custkey")
        measure = F.when(key % 4 == 0, (key % 60 + 141).cast("string")).when(key % 4 == 1, F.concat((key % 60 + 141).cast("string"), F.lit(".5"))).when(key % 4 == 2, " 72").otherwise("72,5")
        user = F.when(key % 10 == 1, key + 1000000).otherwise(key)
        return self.table("customer").where("c_custkey % 3 = 0 OR c_custkey % 10 = 1").select(
            user.alias("user_id"), F.concat("c_name", F.lit(" II")).alias("full_name"), F.lit("1980-05-06").cast("timestamp_ntz").alias("birth_date"),
            F.lit("Other").alias("gender"), F.lit("").alias("blood_type"), measure.alias("height_text"), F.lit("1e2").alias("weight_text"), F.lit("Русский").alias("language"),
        )

    @property
    def questions(self) -> DataFrame:
        asked = self.table("conversations").where("role = 'user'")
        return asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("conv_id").alias("user_id"), "text")

    @property
    def ocr_pages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").alias("user_id"), F.col("turn").alias("page_index"),
            F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"), (F.col("turn") % 3 != 2).alias("readable"),
        )

    @property
    def ocr_candidates(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("string").alias("doc_id"), (F.col("event_id") % 2).alias("page_index"), F.col("event_type").alias("line_no"),
            F.col("event_id").alias("rank"), F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("text"), F.col("value").alias("confidence"),
        )

    @property
    def ocr_text(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 97).alias("user_id"), "text")

    @property
    def owners(self) -> DataFrame:
        """Whose document it is, with what the user entered for it."""
        return self.lab_tests.withColumnRenamed("test_id", "doc_id")

    @property
    def reports(self) -> DataFrame:
        """Documents with a line of a result in every third one, and whether they have it."""
        part = self.table("part").select("p_partkey", "p_name")
        docs = self.ocr_text.withColumn("k", F.col("doc_id").cast("long")).withColumn("p_partkey", F.col("k") % 150).join(part, "p_partkey")
        has = F.col("k") % 3 == 0
        return docs.select("doc_id", F.when(has, F.concat("text", F.lit("\n"), "p_name", F.lit(" 5.2 mmol/l"))).otherwise(F.col("text")).alias("text"), has.alias("is_target"))

    @property
    def patients(self) -> DataFrame:
        """Profiles with a name of two words; every tenth user has a second one under another name."""
        part = self.table("part").select("p_partkey", F.initcap("p_name").alias("full_name"))
        users = self.table("customer").select(F.col("c_custkey").alias("user_id"))
        second = users.where("user_id % 10 = 0").withColumn("p_partkey", F.col("user_id") + 1)
        return users.withColumn("p_partkey", F.col("user_id")).unionByName(second).join(part, "p_partkey").select("user_id", "full_name")

    @property
    def staff(self) -> DataFrame:
        """Names of people who are no users."""
        part = self.table("part").select((F.col("p_partkey") - 50).alias("s_suppkey"), F.initcap("p_name").alias("full_name"))
        return self.table("supplier").join(part, "s_suppkey").select("full_name")

    @property
    def letters(self) -> DataFrame:
        """Documents that end with a name of their user, written in one of several ways, or with one of the staff."""
        part = self.table("part").select("p_partkey", F.split(F.initcap("p_name"), " ").alias("w"))
        docs = self.ocr_text.withColumn("k", F.col("doc_id").cast("long"))
        key = F.when(F.col("k") % 7 > 4, 50 + F.col("k") % 10).otherwise(F.col("user_id"))
        docs = docs.withColumn("p_partkey", key).join(part, "p_partkey")
        first, last = F.get("w", F.lit(0)), F.get("w", F.lit(1))
        way = F.col("k") % 7
        tail = (
            F.when(way == 0, F.concat(first, F.lit(" "), last)).when(way == 1, F.concat(F.upper(last), F.lit(", "), first)).when(way == 2, F.lower(F.concat(first, F.lit("-"), last)))
            .when(way == 3, F.concat(F.lit("dear "), last, F.lit(":"))).when(way == 4, F.concat(last, F.lit(" writes. "), first)).when(way == 5, F.concat(F.lit("Dr. "), first, F.lit(" "), last))
            .otherwise(F.concat(F.substring(first, 1, 1), F.lit(". "), last))
        )
        return docs.select("doc_id", "user_id", F.concat("text", F.lit(" "), tail, F.lit(".")).alias("text"))

    @property
    def llm_responses(self) -> DataFrame:
        """One response for each test but every eleventh, damaged by its id."""
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        optional = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
        damage = F.col("test_id").cast("long") % 7
        name = F.when(damage == 4, F.lit("")).otherwise(F.concat(F.lit('"name":'), quoted(F.col("name")), F.lit(",")))
        value = F.when(damage == 2, F.col("value")).otherwise(quoted(F.col("value")))
        flag = F.when(F.col("flag").isNull(), F.lit("")).otherwise(F.concat(F.lit(',"flag":'), quoted(F.col("flag"))))
        item = F.concat(F.lit("{"), name, F.lit('"value":'), value, F.lit(',"unit":'), optional("unit"), F.lit(',"referenceRange":'), optional("reference_range"), flag, F.lit("}"))
        items = self.lab_markers.select("test_id", "pos", item.alias("item")).groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("items"))
        tests = self.lab_tests.where(F.col("test_id").cast("long") % 11 != 0).select("test_id").join(items, "test_id", "left")
        joined = F.coalesce(F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit(""))
        whole = F.concat(F.lit('{"markers":['), joined, F.lit("]}"))
        content = F.when(damage == 1, F.substring(whole, F.lit(1), F.length(whole) - 3)).when(damage == 3, F.concat(whole, F.lit(" Done."))).otherwise(whole)
        body = F.concat(F.lit('{"choices":[{"message":{"content":"'), F.replace(content, F.lit('"'), F.lit('\\"')), F.lit('"}}]}'))
        code = F.col("test_id").cast("long") % 20
        status = F.when(code == 0, 401).when(code == 1, 404).when(code == 2, 429).when(code == 3, 500).otherwise(200)
        return tests.select(
            F.concat(F.lit("r"), "test_id").alias("request_id"), F.col("test_id").alias("doc_id"), status.alias("http_status"),
            F.when(code == 4, "oops").when(code == 5, '{"choices":[]}').otherwise(body).alias("body"),
        )

    @property
    def corrections(self) -> DataFrame:
        pick = F.pmod(F.col("test_id").cast("long") + F.col("pos"), F.lit(9))
        rows = self.lab_markers.withColumn("pick", pick).where("pick < 3")
        action = F.when(F.col("pick") == 0, "edit").when(F.col("pick") == 1, "remove").otherwise("add")
        return rows.select(
            F.col("test_id").alias("doc_id"), F.when(F.col("pick") == 2, F.col("pos") + 1000).otherwise(F.col("pos")).alias("pos"), action.alias("action"),
            F.when(F.col("pick") == 0, F.concat("name", F.lit(" x"))).otherwise("").alias("name"), F.lit("").alias("value"), F.lit(None).cast("string").alias("unit"),
        )

    @property
    def confirmations(self) -> DataFrame:
        return self.lab_tests.where(F.col("test_id").cast("long") % 3 != 0).select(F.col("test_id").alias("doc_id"))

    @property
    def markers_by_doc(self) -> DataFrame:
        return self.lab_markers.withColumnRenamed("test_id", "doc_id")

    @property
    def deleted_ids(self) -> DataFrame:
        return self.lab_tests.where(F.col("test_id").cast("long") % 11 == 0).select("test_id")

    @property
    def loinc_dict(self) -> DataFrame:
        names = self.table("part").select(F.lower("p_name").alias("name_norm")).distinct()
        return names.where(F.length("name_norm") % 3 != 0).select("name_norm", F.concat(F.lit("L-"), F.upper(F.substring("name_norm", 1, 3)), F.length("name_norm").cast("string")).alias("loinc_code"))

    @property
    def spelt_markers(self) -> DataFrame:
        """Markers with their name as it is, in capitals, without its second letter, or with one too many."""
        way = F.col("pos") % 4
        spelt = F.when(way == 1, F.concat(F.upper("name"), F.lit(" "))).when(way == 2, F.concat(F.substring("name", 1, 1), F.substring("name", 3, 99))).when(way == 3, F.concat("name", F.lit("x")))
        return self.lab_markers.withColumn("name", spelt.otherwise(F.col("name")))

    @property
    def lab_alias(self) -> DataFrame:
        """The names of even length that each provider has reported."""
        reported = self.lab_markers.select("test_id", "name").where(F.length("name") % 2 == 0).join(self.lab_tests.select("test_id", "provider"), "test_id")
        return reported.select("provider", "name").distinct().withColumn("lab_standard_id", F.concat(F.lit("S-"), F.lower("name")))

    @property
    def sheets(self) -> DataFrame:
        """Result sheets of tests: entries on one, two or three lines."""
        lines = F.when(F.col("pos") % 3 == 1, F.concat("name", F.lit(": "), "value", F.coalesce(F.concat(F.lit(" "), "reference_range"), F.lit(""))))
        lines = lines.when(F.col("pos") % 3 == 2, F.concat("name", F.lit("\n"), "value")).otherwise(F.concat("name", F.lit("\n"), "value", F.lit("\n"), F.coalesce("reference_range", F.lit("no range, 1 of 2"))))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", lines.alias("t")))), lambda x: x["t"]), "\n")
        return self.markers_by_test.groupBy(F.col("test_id").alias("doc_id")).agg(F.concat(F.lit("Results of the laboratory, 2020\n"), whole).alias("text"))

    @property
    def code_claims(self) -> DataFrame:
        """Which code a laboratory gives a name, as some of the parts say."""
        some = self.table("part").where("p_partkey % 16 = 0")
        code = F.concat(F.lit("C"), (F.floor(F.col("p_partkey") / 16) % 60).cast("string"))
        return some.select(F.element_at(F.array(*map(F.lit, "OFP")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("provider"), F.col("p_name").alias("name"), code.alias("code"))

    @property
    def name_aliases(self) -> DataFrame:
        """Names of two laboratories that are the same."""
        some = self.table("part").where("p_partkey % 16 = 1")
        return some.select(F.lit("O").alias("provider"), F.col("p_name").alias("name"), F.lit("F").alias("other_provider"), F.concat(F.upper("p_name"), F.lit(" ")).alias("other_name"))

    @property
    def measured(self) -> DataFrame:
        """Markers of which some have a value that is far too high."""
        wrong = (F.col("test_id").cast("long") + F.col("pos")) % 97 == 0
        return self.lab_markers.withColumn("value", F.when(wrong, F.concat(F.lit("99"), "value")).otherwise(F.col("value"))).withColumn("unit", F.lit("u"))

    @property
    def chat_turns(self) -> DataFrame:
        return self.table("conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")
