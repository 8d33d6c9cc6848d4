"""Saved tests as two tables of files that change together.

A change is written to a hidden folder first. Then one small file, the commit, says which of its
files belong to the tables and which older ones go; it is created as a whole or not at all.
Last the files are moved into their years. A run that ends before its commit leaves
nothing that a reader sees; one that ends after it is completed by whoever comes next.
Files that a change does not touch keep their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("lab_tests", "lab_markers")


class Store:
    """The folder of both tables, ``lab_tests`` and ``lab_markers``, each by the year of the test."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}" if p else self.path)
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _commits(self) -> list[str]:
        return [n for n in self._names("_commits") if n.endswith(".json")]

    def complete(self) -> None:
        """Carry out the last commit, or what is left of it."""
        if not (names := self._commits()):
            return
        stream = self.fs.open(self._at(f"_commits/{names[-1]}"))
        try:
            commit = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        for name in commit["add"]:
            source, target = self._at(f"_staged/{commit['run']}/{name}"), self._at(name)
            if self.fs.exists(source):
                self.fs.mkdirs(target.getParent())
                if not self.fs.rename(source, target):
                    raise OSError(f"{source} cannot be moved")
        for name in commit["remove"]:
            self.fs.delete(self._at(name), False)
        self.fs.delete(self._at(f"_staged/{commit['run']}"), True)

    def stage(self, tables: dict[str, DataFrame], run: str | None = None) -> str:
        """Write rows with a year of each table to a hidden folder, of an earlier run if given; the name of the run."""
        run = run or uuid.uuid4().hex
        for name, df in tables.items():
            # One file for each year and task that has some; the ids get Bloom filters of their own in each file.
            df.write.option("parquet.bloom.filter.enabled#test_id", "true").partitionBy("year").parquet(f"{self.path}/_staged/{run}/{name}")
        return run

    def _staged_files(self, run: str) -> list[str]:
        out = []
        for table in TABLES:
            for year in self._names(f"_staged/{run}/{table}"):
                out += [f"{table}/{year}/{n}" for n in self._names(f"_staged/{run}/{table}/{year}") if n.startswith("part-")] if year.startswith("year=") else []
        return out

    def commit(self, run: str, remove: list[str], after: int) -> None:
        """Make a staged run the change after ``after`` others. If another writer made that one first, this is an error and nothing changes."""
        body = json.dumps({"run": run, "add": self._staged_files(run), "remove": remove}).encode()
        draft, final = self._at(f"_staged/{run}/commit"), self._at(f"_commits/{after + 1:012d}.json")
        self.fs.mkdirs(final.getParent())
        stream = self.fs.create(draft, True)
        stream.write(body)
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError("another change was made meanwhile; try again")
        self.complete()

    def begin(self) -> int:
        """Complete what was left, and the number of changes so far."""
        self.complete()
        names = self._commits()
        return int(names[-1].removesuffix(".json")) if names else 0

    def read(self, table: str, schema: T.StructType, years: list[int] | None = None) -> DataFrame | None:
        """A table, of some years only if given; None if nothing was saved yet."""
        if not any(n.startswith("year=") for n in self._names(table)):
            return None
        fields = [f for f in schema.fields if f.name != "year"]
        df = self.spark.read.schema(T.StructType([*fields, T.StructField("year", T.IntegerType())])).parquet(f"{self.path}/{table}")
        if years is None:
            return df
        some = [y for y in years if y is not None]
        return df.where(F.col("year").isin(some) | F.col("year").isNull()) if None in years else df.where(F.col("year").isin(some))


@contextmanager
def working_folder(spark: SparkSession, path: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to a hidden folder of the store and reads it back; the folder goes at the end."""
    store, folder = Store(spark, path), f"_staged/work-{uuid.uuid4().hex}"
    names = count()

    def written(df: DataFrame) -> DataFrame:
        at = f"{store.path}/{folder}/{next(names)}"
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    try:
        yield written
    finally:
        store.fs.delete(store._at(folder), True)


def save(tests: DataFrame, markers: DataFrame, path: str, by: str | None = None) -> None:
    """Add the tests that the store does not have yet, with their markers, in one change.

    Only the ids of the years in hand are read. The known ones among them are found by a semi-join
    with the new tests, which is a broadcast or gets a runtime filter if these are few, so
    the stored ids are not shuffled for a small batch. Of rows with one test_id the first by
    their fields is saved. A test is looked for in its own year: one that is saved
    again under another date counts as new. Tests are written first; if none is new, the
    markers are not looked at. ``by`` is a column of both tables that goes with the test_id and is
    not saved; markers that are dealt by it already stay where they are when they meet their tests.
    """
    store, columns = Store(tests.sparkSession, path), [c for c in tests.columns if c != by]
    after = store.begin()
    with working_folder(tests.sparkSession, path) as written:
        new = written(unsaved(tests, path))
        if new.isEmpty():
            return
        key = by or "test_id"
        rows = markers.join(new.select(key, "year"), key)
        run = store.stage({"lab_tests": new.select(*columns, "year"), "lab_markers": rows.select(*[c for c in markers.columns if c != by], "year")})
        store.commit(run, [], after)


def unsaved(tests: DataFrame, path: str) -> DataFrame:
    """The rows of ``tests``, one for each test_id, with their year, that the store does not have in that year."""
    dated = tests.withColumn("year", F.year("date"))
    one = dated.groupBy("test_id").agg(F.min(F.struct(*[c for c in dated.columns if c != "test_id"])).alias("t")).select("test_id", "t.*").select(dated.columns)
    years = [r.year for r in dated.select("year").distinct().collect()]
    there = Store(tests.sparkSession, path).read("lab_tests", tests.select("test_id").schema, years)
    if there is None:
        return one
    known = there.select("test_id").join(tests.select("test_id"), "test_id", "left_semi").distinct()
    return one.join(known, "test_id", "left_anti").select(dated.columns)


def _touched(df: DataFrame, ids: DataFrame, table: str) -> list[tuple[str, int | None]]:
    """(file of the table, year) for files that hold some of the ids. Names of files, as the driver lists them anyway.

    Ids and names meet as hashes, which are much shorter. Two ids with one hash would have
    a file written anew that need not be, with the same rows.
    """
    spark = df.sparkSession
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    hit = df.select(F.xxhash64("test_id").alias("id"), F.xxhash64(name, "year").alias("file")).join(ids.select(F.xxhash64("test_id").alias("id")), "id", "left_semi")
    listed = [(f.split("/")[-1], f.split("/")[-2].removeprefix("year=")) for f in df.inputFiles()]
    files = spark.createDataFrame(listed, "name string, folder string").withColumn("year", F.col("folder").try_cast("int"))
    found = hit.select("file").distinct().join(files.withColumn("file", F.xxhash64("name", "year")), "file").collect()
    return [(f"{table}/year={r.folder}/{r.name}", r.year) for r in found]


def delete(spark: SparkSession, ids: DataFrame, path: str, tests_schema: T.StructType, markers_schema: T.StructType) -> list[str]:
    """Remove the tests of ``ids`` (test_id) and their markers in one change; the files that were rewritten.

    Ids are looked for in the id column of all tests, then in the markers of the years
    where some were found. Only the files that hold some are read whole and written anew without
    them; unknown and null ids change nothing.
    """
    store = Store(spark, path)
    after = store.begin()
    gone = ids.select("test_id").where("test_id IS NOT NULL").distinct()
    tests = store.read("lab_tests", tests_schema)
    if tests is None:
        return []
    touched = {"lab_tests": _touched(tests, gone, "lab_tests")}
    years = sorted({y for _, y in touched["lab_tests"]}, key=lambda y: (y is None, y))
    markers = store.read("lab_markers", markers_schema, years) if years else None
    touched["lab_markers"] = _touched(markers, gone, "lab_markers") if markers is not None else []
    if not years:
        return []
    schemas, left = {"lab_tests": tests_schema, "lab_markers": markers_schema}, {}
    for table, files in touched.items():
        if files:
            whole = T.StructType([*[f for f in schemas[table].fields if f.name != "year"], T.StructField("year", T.IntegerType())])
            old = spark.read.schema(whole).option("basePath", f"{store.path}/{table}").parquet(*[f"{store.path}/{f}" for f, _ in files])
            left[table] = old.join(gone, "test_id", "left_anti")
    run, files = store.stage(left), [f for table in touched.values() for f, _ in table]
    store.commit(run, files, after)
    return files
