"""Commits that lose nothing, changes that cost what they change, leases."""

import threading

from pyspark.sql import functions as F

from lexloom.operators import changelog
from lexloom.operators.store import Store

SCHEMA = "id bigint, name string, n int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def seen(log):
    return sorted(tuple(r) for r in log.read().collect())


def test_the_latest_version_of_a_row_wins(spark, tmp_path):
    log = changelog.Log(spark, f"file://{tmp_path}/a b", SCHEMA, "id")
    assert seen(log) == []
    log.commit(lambda _s, _t: rows(spark, (1, "a", 1), (2, "b", 2), (3, None, None)))
    log.commit(lambda s, _t: s.filter("id = 2").withColumn("n", F.lit(9)))
    log.commit(lambda s, _t: s.filter("id = 1").withColumn(changelog.GONE, F.lit(True)))
    log.commit(lambda s, _t: s.limit(0))
    assert seen(log) == [(2, "b", 9), (3, None, None)] and log.numbers() == [0, 1, 2]
    log.compact()
    assert seen(log) == [(2, "b", 9), (3, None, None)] and len(log.entries()) == 1
    log.commit(lambda _s, _t: rows(spark, (1, "again", 1)))
    log.vacuum()
    assert seen(log) == [(1, "again", 1), (2, "b", 9), (3, None, None)]


def test_a_change_writes_what_it_changes_and_compaction_bounds_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changelog, "COMPACT_AFTER", 3)
    log = changelog.Log(spark, f"file://{tmp_path}/t", SCHEMA, "id")
    log.commit(lambda _s, _t: spark.range(1000).selectExpr("id", "'x' as name", "0 as n"))
    for i in range(7):
        log.commit(lambda s, _t, i=i: s.filter(F.col("id") == i).withColumn("n", F.lit(1)))
        assert len(log.entries()) <= 4
    assert log.read().agg(F.sum("n"), F.count("*")).first()[:] == (7, 1000)
    changes = [e for n in log.numbers() if (e := log.entry(n)).kind == changelog.CHANGE][1:]
    assert {spark.read.parquet(f"{log.root}/{e.folder}").count() for e in changes} == {1}


def test_two_writers_of_one_version_both_get_through(spark, tmp_path):
    """A writer that finds its number taken computes its change anew on what the other left."""
    log, other = (changelog.Log(spark, f"file://{tmp_path}/t", SCHEMA, "id") for _ in range(2))
    log.commit(lambda _s, _t: rows(spark, (1, "a", 1)))
    calls = []

    def late(s, _t):
        if not calls:
            other.commit(lambda o, _: o.withColumn("n", F.col("n") + 10))
        calls.append(1)
        return s.withColumn("n", F.col("n") * 2)

    log.commit(late)
    assert len(calls) == 2 and seen(log) == [(1, "a", 22)]


def test_many_writers_at_once_lose_nothing(spark, tmp_path):
    stores = [Store(spark, f"file://{tmp_path}/s") for _ in range(4)]
    got = []

    def work(number, own):
        for i in range(2):
            new = spark.createDataFrame([(f"{number}-{i}-{k}.txt", f"s{number}{i}{k}", ".txt", 1) for k in range(3)], "filename string, stored_name string, file_type string, size_bytes bigint")
            got.append(own.create(new))

    threads = [threading.Thread(target=work, args=x) for x in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = stores[0].documents().select("id", "filename").collect()
    assert len({r.filename for r in found}) == 24 and sorted(r.id for r in found) == list(range(1, 25)) == sorted(i for ids in got for i in ids)


def test_ids_of_deleted_documents_are_not_used_again(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/s")
    new = lambda name: spark.createDataFrame([(name, name, ".txt", 1)], "filename string, stored_name string, file_type string, size_bytes bigint")
    assert list(own.create(new("a"))) == [1] and list(own.create(new("b"))) == [2]
    own.delete([2])
    own.logs["documents"].compact()
    assert list(own.create(new("c"))) == [3] and sorted(r.id for r in own.documents().collect()) == [1, 3]


def test_recovery_fails_only_what_no_lease_holds(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/s")
    ids = own.create(spark.createDataFrame([(f"{k}.txt", f"s{k}", ".txt", 1) for k in range(3)], "filename string, stored_name string, file_type string, size_bytes bigint"))
    frame = lambda *n: spark.createDataFrame([(i,) for i in n], "id bigint")
    assert own.claim(frame(*ids), "one", 1000).count() == 3
    assert own.claim(frame(1, 2), "two", 1000).count() == 0 and own.claim(frame(1), "one", 1000).count() == 1
    own.release("one")
    assert [r.id for r in own.claim(frame(2), "two", 1000).collect()] == [2]
    own.recover()
    assert {r.id: r.status for r in own.documents().collect()} == {1: "failed", 2: "pending", 3: "failed"}
    import time

    own.recover(time.time() + 2000)
    assert {r.status for r in own.documents().collect()} == {"failed"}
