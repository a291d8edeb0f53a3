import base64
import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import incremental
from graphloom.operators.incremental import ChangeJob, LeaseHeld, StaleWriter, WorkLedger, digest, process_changes, replay_changes
from graphloom.workspace import Scratch

A, B = "a1" * 32, "b2" * 32
FILES = "path string, content_hash string, indexed_at bigint, size bigint"
SEEN = "obs_id bigint, run_id int, path string, content_hash string, indexed_at bigint"


def runs(spark, *status):
    start = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(n + 1, start + datetime.timedelta(hours=6 * n), None, s) for n, s in enumerate(status)], "run_id int, started_at timestamp, finished_at timestamp, status string")


def solve(spark, files, seen, *status):
    found = replay_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(seen, SEEN), runs(spark, *status))
    return sorted(tuple(r) for r in found.collect())


def test_spellings_of_a_digest(spark):
    texts = [A, "sha256:" + A, "SHA256:" + A.upper(), "sha256-" + base64.b64encode(bytes.fromhex(A)).decode(), None, " odd "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "h string").select(digest(F.col("h"))).collect()]
    assert got == [A, A, A, A, None, "odd"]


def test_failed_runs_neither_skip_nor_repeat(spark):
    files = [("p", A, 10, 1), ("p", B, 5, 1), ("q", None, 10, 1), (None, A, 1, 1)]
    seen = [(1, 1, "p", "SHA256:" + A.upper(), 20), (2, 2, "p", B, 30), (2, 2, "p", B, 30), (3, 3, "n", A, 31), (4, 3, "q", None, 32), (5, 4, "p", A, 25), (6, 5, "p", B, 40), (7, 5, "n", B, 41)]
    assert solve(spark, files, seen, "success", "failed", "crashed", "success", "success") == [(4, "n"), (4, "p"), (5, "n")]


def test_without_success_or_rows(spark):
    assert solve(spark, [], [], "success") == []
    assert solve(spark, [], [(1, 1, "p", A, 1)], "failed") == []


def test_ledger_leases_expire_and_stale_writers_are_rejected(spark):
    ledger = WorkLedger(spark, Scratch(spark, "t").path("ledger"))
    ledger.add(["a", "b"])
    old, items = ledger.lease("w1", now=0, seconds=10)
    assert items == ["a", "b"] and ledger.lease("w2", now=5, seconds=10)[1] == []
    new, items = ledger.lease("w2", now=10, seconds=10)
    assert items == ["a", "b"] and new > old
    with pytest.raises(StaleWriter):
        ledger.complete(old, ["a"])
    ledger.complete(new, ["a"])
    assert ledger.states() == {"a": "done", "b": "leased"}
    ledger.add(["a"])
    assert ledger.states()["a"] == "done"


def test_an_unfinished_ledger_file_is_no_book(spark):
    folder = Scratch(spark, "t").path("ledger")
    ledger = WorkLedger(spark, folder)
    ledger.add(["a"])
    ledger._fs.create(ledger._path("draft-x"), False).close()  # a writer that died while writing
    assert WorkLedger(spark, folder).states() == {"a": "pending"}
    ledger.add(["b"])
    assert ledger.states() == {"a": "pending", "b": "pending"}


@pytest.mark.parametrize("dies_in", ["_write", "complete"])
def test_a_run_killed_before_its_commit_is_repeated_once(spark, monkeypatch, dies_in):
    folder = Scratch(spark, "t").path("job")
    files = spark.createDataFrame([("p", A, 10, 1)], FILES)
    seen = spark.createDataFrame([(1, 1, "p", B, 20), (2, 2, "q", A, 30), (3, 3, "p", A, 40)], SEEN)
    states = runs(spark, "success", "success", "success")
    assert {tuple(r) for r in process_changes(folder, files, seen.filter("run_id = 1"), states.filter("run_id = 1"), now=0).collect()} == {(1, "p")}

    whole = ChangeJob._write if dies_in == "_write" else WorkLedger.complete

    def dying(self, *args):
        if dies_in == "_write":
            whole(self, *args)  # all is written, nothing committed
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ChangeJob if dies_in == "_write" else WorkLedger, dies_in, dying)
        with pytest.raises(KeyboardInterrupt):
            process_changes(folder, files, seen, states, now=100, lease_seconds=50)
    with pytest.raises(LeaseHeld):
        process_changes(folder, files, seen, states, now=120, lease_seconds=50)
    found = [tuple(r) for r in process_changes(folder, files, seen, states, now=200, lease_seconds=50).collect()]
    assert sorted(found) == [(1, "p"), (2, "q"), (3, "p")]


def test_a_second_call_without_arrivals_reads_no_state(spark, monkeypatch):
    folder = Scratch(spark, "t").path("job")
    files = spark.createDataFrame([("p", A, 10, 1)], FILES)
    seen = spark.createDataFrame([(1, 1, "p", B, 20)], SEEN)
    states = runs(spark, "success", "success")
    first = sorted(map(tuple, process_changes(folder, files, seen, states).collect()))
    called = []
    monkeypatch.setattr(incremental.ChangeJob, "start", lambda *a: called.append("start"))
    monkeypatch.setattr(incremental.ChangeJob, "run", lambda *a: called.append("run"))
    assert sorted(map(tuple, process_changes(folder, files, seen, states).collect())) == first == [(1, "p")]
    assert called == []


def test_only_touched_buckets_are_read(spark):
    folder = Scratch(spark, "t").path("job")
    files = spark.createDataFrame([(f"p{n}", A, 10, 1) for n in range(200)], FILES)
    job = ChangeJob(spark, folder, buckets=16)
    job.start(files, 0)
    arrivals = spark.createDataFrame([("p7", 1, 1, B, 20)], "path string, run_id int, obs_id bigint, digest string, indexed_at bigint")
    bucket = spark.sql("SELECT CAST(pmod(xxhash64('p7'), 16) AS INT)").first()[0]
    job.run(1, arrivals, {1: {bucket}}, True, 0)
    plan = job._read(job.outputs()).filter(F.col("bucket").isin([bucket]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert [tuple(r) for r in job.changes().collect()] == [(1, "p7")]
