"""Saved tests: what a change touches, what a run that was killed leaves, and what is read."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from medloom import schemas
from medloom.operators import store, vault, verify
from medloom.operators.store import Store
from medloom.sources.tables import read_saved


def made(spark, ids, year=lambda k: 2018 + k % 3):
    rows = [(f"t{k}", k, None if k % 10 == 9 else dt.datetime(year(k), 1, 2), "lab", "blood", None, None) for k in ids]
    tests = spark.createDataFrame(rows, schemas.LAB_TESTS)
    markers = [(f"t{k}", p, f"name {p}", None, str(k), None, None, None, False, None) for k in ids for p in range(k % 4)]
    return tests, spark.createDataFrame(markers, schemas.LAB_MARKERS)


def files(path):
    return {os.path.relpath(os.path.join(d, n), path) for t in store.TABLES for d, _, names in os.walk(f"{path}/{t}") for n in names if n.startswith("part-")}


def saved(spark, path):
    return {r.test_id for r in read_saved(spark, path, "lab_tests").collect()}, {(r.test_id, r.pos) for r in read_saved(spark, path, "lab_markers").collect()}


def expected(ids):
    return {f"t{k}" for k in ids}, {(f"t{k}", p) for k in ids for p in range(k % 4)}


def test_save_reads_the_years_in_hand(spark, tmp_path):
    path = str(tmp_path)
    store.save(*made(spark, range(40)), path)
    assert saved(spark, path) == expected(range(40))
    before = files(path)
    # Repeated rows of one batch, known tests and new ones.
    tests, markers = made(spark, range(30, 60))
    store.save(tests.unionAll(tests.limit(5)), markers, path)
    assert saved(spark, path) == expected(range(60)) and before < files(path)
    assert read_saved(spark, path, "lab_markers").count() == len(expected(range(60))[1])
    store.save(tests, markers, path)
    assert len(files(path)) == len(files(path) | before) and saved(spark, path) == expected(range(60))
    there = Store(spark, path).read("lab_tests", tests.select("test_id").schema, [2019])
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*year#\d+ = 2019", plan) and "ReadSchema: struct<test_id:string>" in plan and {r.year for r in there.collect()} == {2019}
    assert {r.year for r in read_saved(spark, path, "lab_tests", [2018, None]).collect()} == {2018, None}


def test_delete_rewrites_touched_files_only(spark, tmp_path):
    path = str(tmp_path)
    for ids in (range(20), range(20, 40), range(40, 50)):
        store.save(*made(spark, ids), path)
    before = files(path)
    gone = spark.createDataFrame([("t3",), ("t3",), ("t6",), ("t9",), ("none",), (None,)], "test_id string")
    touched = vault.delete_saved_tests(spark, gone, path)
    left = [k for k in range(50) if k not in (3, 6, 9)]
    assert saved(spark, path) == expected(left)
    # t3, t6 are of one year of the first change, t9 has no date.
    assert touched and set(touched) == before - files(path) and all("year=2018" in f or "HIVE_DEFAULT" in f for f in touched)
    assert len(before & files(path)) == len(before) - len(touched)
    assert vault.delete_saved_tests(spark, gone, path) == [] and saved(spark, path) == expected(left)
    assert vault.delete_saved_tests(spark, gone.limit(0), path) == []
    # Deleted and saved again.
    store.save(*made(spark, [3]), path)
    assert saved(spark, path) == expected([*left, 3])


def test_delete_from_nothing(spark, tmp_path):
    assert vault.delete_saved_tests(spark, spark.createDataFrame([("t1",)], "test_id string"), f"{tmp_path}/none") == []
    assert read_saved(spark, f"{tmp_path}/none", "lab_tests").count() == 0
    store.save(*made(spark, []), f"{tmp_path}/none")
    assert read_saved(spark, f"{tmp_path}/none", "lab_markers").count() == 0


def test_a_killed_run_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.save(*made(spark, range(10)), path)
    before = files(path)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.save(*made(spark, range(10, 20)), path)
    assert files(path) == before and saved(spark, path) == expected(range(10))
    assert spark.read.parquet(f"{path}/lab_tests").count() == 10
    store.save(*made(spark, range(10, 20)), path)
    assert saved(spark, path) == expected(range(20))


@pytest.mark.parametrize("moves", [0, 1, 3])
def test_a_run_killed_after_its_commit_is_completed(spark, tmp_path, moves):
    """The commit is there and some files are moved: the next reader finds both tables whole."""
    path = str(tmp_path)
    store.save(*made(spark, range(10)), path)
    gone = spark.createDataFrame([("t2",), ("t5",), ("t9",)], "test_id string")

    class Killed(Exception):
        pass

    class Dying(Store):
        def complete(self):
            if self.dying:
                commit = json.load(open(f"{path}/_commits/{self._commits()[-1]}"))
                for name in commit["add"][:moves]:
                    self.fs.mkdirs(self._at(name).getParent())
                    assert self.fs.rename(self._at(f"_staged/{commit['run']}/{name}"), self._at(name))
                raise Killed
            super().complete()

        dying = False

        def stage(self, tables):
            run = super().stage(tables)
            self.dying = True
            return run

    original = store.Store
    store.Store = Dying
    try:
        with pytest.raises(Killed):
            store.delete(spark, gone, path, schemas.LAB_TESTS, schemas.LAB_MARKERS)
    finally:
        store.Store = original
    assert saved(spark, path) == expected([k for k in range(10) if k not in (2, 5, 9)])
    assert not os.listdir(f"{path}/_staged")


def test_two_writers(spark, tmp_path):
    """Of two changes that began at the same state the second one is refused and leaves nothing."""
    path = str(tmp_path)
    first, second = Store(spark, path), Store(spark, path)
    at = first.begin(), second.begin()
    tests, markers = made(spark, range(5))
    with_year = lambda df: df.withColumn("year", F.lit(2020))
    runs = [s.stage({"lab_tests": with_year(tests), "lab_markers": with_year(markers)}) for s in (first, second)]
    first.commit(runs[0], [], at[0])
    with pytest.raises(RuntimeError):
        second.commit(runs[1], [], at[1])
    assert read_saved(spark, path, "lab_tests").count() == 5


def test_codes_are_saved_on_demand(spark, tmp_path):
    docs = spark.createDataFrame([("d", 1, dt.datetime(2020, 1, 1), "p", "n")], "doc_id string, user_id long, date timestamp, provider string, test_name string")
    markers = spark.createDataFrame([("d", 0, "a", "1-1", "5", None, None, None)], "doc_id string, pos int, name string, loinc_code string, value string, unit string, reference_range string, flag string")
    for codes in (False, True):
        verify.save_tests(*verify.to_lab_tests(docs, markers, codes), f"{tmp_path}/{codes}")
        assert read_saved(spark, f"{tmp_path}/{codes}", "lab_markers").first().loinc_code == ("1-1" if codes else None)


def test_what_is_saved_is_not_worked_out_again(spark, tmp_path):
    """A rerun compares ids; it reads no marker."""
    from medloom.operators import store, verify
    from medloom.sources.standin import StandIn

    s = StandIn(spark, "/root/testdata/sf0.001")
    tests, markers = verify.to_lab_tests(s.owners, s.markers_by_doc, keep_doc=True)
    path = f"file://{tmp_path}/store"
    verify.save_tests(tests, markers, path)
    broken = markers.withColumn("name", F.raise_error(F.lit("a marker was read")).cast("string"))
    verify.save_tests(tests, broken, path)
    assert len(store.Store(spark, path)._commits()) == 1
    saved = spark.read.parquet(f"{path}/lab_markers")
    assert saved.count() == s.lab_markers.count() and "doc_id" not in saved.columns
    assert s.markers_by_test.exceptAll(s.lab_markers).isEmpty()
