"""Processing only new or changed records, through a ledger of work items."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.workspace import Scratch


class StaleWriter(Exception):
    """A writer came back after its lease had passed to another."""


class LeaseHeld(Exception):
    """Arrivals that a run needs are leased to another worker that may still live."""


class WorkLedger:
    """Work items with the states pending, leased and done, kept in a shared folder.

    Every change is a whole numbered file: it is written under a name of its own and
    then renamed to the next number, which fails if another writer was first. So a
    number holds a complete book or does not exist, wherever a writer dies; a reader
    takes the greatest number. A lease has an expiry and a fencing token that grows
    with every lease. An expired lease returns to pending with the next ``lease``
    call, and ``complete`` accepts only the token that holds the item, so a writer
    that was taken for dead cannot commit late. The ledger has one entry per batch
    of arrivals, not per record.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name="": self._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}" if name else folder)
        self._fs = self._path().getFileSystem(conf)
        self._names = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        self._fs.mkdirs(self._path())

    def _load(self) -> tuple[int, dict]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {"token": 0, "items": {}}
        stream = self._fs.open(self._path(f"{max(numbers)}.json"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _change(self, update) -> object:
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        keep = self._gateway.new_array(kinds, 1)
        keep[0] = kinds.NONE
        for _ in range(100):
            version, book = self._load()
            result = update(book)
            draft = self._path(f"draft-{uuid.uuid4().hex}")
            out = self._fs.create(draft, False)
            out.write(bytearray(json.dumps(book).encode()))
            out.close()
            try:
                self._names.rename(draft, self._path(f"{version + 1}.json"), keep)
            except Exception as e:
                self._fs.delete(draft, False)
                if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
                    raise
                continue  # another writer was first; look again
            return result
        raise RuntimeError("the ledger is too busy")

    def add(self, items: Iterable[str]) -> None:
        """New items as pending; known ones stay as they are."""
        new = [i for i in items if i not in self.items()]
        if new:
            self._change(lambda book: [book["items"].setdefault(i, {"state": "pending"}) for i in new])

    def lease(self, owner: str, now: float, seconds: float, among: Iterable[str] | None = None) -> tuple[int, list[str]]:
        """All items (or those named) open at the time now, with the fencing token that holds them."""
        wanted = None if among is None else set(among)

        def update(book):
            book["token"] += 1
            mine = []
            for name, item in book["items"].items():
                if item["state"] == "leased" and item["expires"] <= now:
                    item.update(state="pending")
                if item["state"] == "pending" and (wanted is None or name in wanted):
                    item.update(state="leased", owner=owner, token=book["token"], expires=now + seconds)
                    mine.append(name)
            return book["token"], mine

        return self._change(update)

    def complete(self, token: int, items: Iterable[str], output: str | None = None) -> None:
        """Marks items done, with where their output lies; raises StaleWriter, changing nothing, if a lease is lost."""
        mine = list(items)

        def update(book):
            for i in mine:
                if book["items"][i]["state"] != "leased" or book["items"][i]["token"] != token:
                    raise StaleWriter(f"{i}: token {token} no longer holds it")
            for i in mine:
                book["items"][i].update(state="done", output=output)

        self._change(update)

    def items(self) -> dict[str, dict]:
        return self._load()[1]["items"]

    def states(self) -> dict[str, str]:
        return {k: v["state"] for k, v in self.items().items()}


def digest(content_hash: Column) -> Column:
    """The SHA-256 digest in lower-case hex, whatever the spelling; null stays null.

    Prefixes and letter case are ignored and base64 is decoded; text without a
    digest is compared as it stands, trimmed and lower-cased.
    """
    hexed = F.lower(F.regexp_extract(content_hash, r"(?:^|[^0-9A-Za-z])([0-9a-fA-F]{64})\s*$", 1))
    coded = F.regexp_extract(content_hash, r"(?:^|[^0-9A-Za-z+/])([A-Za-z0-9+/]{43}=)\s*$", 1)
    return F.when(content_hash.isNull(), None).when(hexed != "", hexed).when(coded != "", F.lower(F.hex(F.try_to_binary(coded, F.lit("base64"))))).otherwise(F.lower(F.trim(content_hash)))


def _latest(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy("path").agg(F.max_by("digest", F.struct(*by)).alias("digest"), F.max("indexed_at").alias("indexed_at"))


_READY = "path is not null and digest is not null and indexed_at is not null"
_STATE = "path string, digest string, indexed_at bigint, changed boolean, run_id int, bucket int"


class ChangeJob:
    """Handles the new or changed paths of each scan run, once, from a shared folder.

    The folder holds the ledger, and per run the rows it handled with the state they
    leave, in buckets of the path's hash. A job that starts again with the same
    folder goes on behind the last committed run.
    """

    def __init__(self, spark: SparkSession, folder: str, lease_seconds: float = 3600.0, buckets: int = 8) -> None:
        self.spark, self.folder, self.lease_seconds, self.buckets = spark, folder.rstrip("/"), lease_seconds, buckets
        self.ledger = WorkLedger(spark, f"{self.folder}/ledger")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, output: str) -> None:
        """Rows by bucket under the output's path, which a retry with the same token overwrites."""
        placed = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{output}")

    def outputs(self) -> list[str]:
        """Where the rows of committed items lie, in the order of their tokens."""
        done = {i["output"] for i in self.ledger.items().values() if i["state"] == "done" and i.get("output")}
        return sorted(done, key=lambda o: int(o.rsplit("=", 1)[1]))

    def _read(self, outputs: list[str]) -> DataFrame:
        if not outputs:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(f"{_STATE}, run int, token int").option("basePath", f"{self.folder}/state").parquet(*(f"{self.folder}/{o}" for o in outputs))

    def _hold(self, name: str, now: float, seconds: float, among: list[str]) -> tuple[int, list[str]]:
        token, mine = self.ledger.lease(name, now, seconds, among)
        states = self.ledger.states()
        held = [i for i in among if states[i] == "leased" and i not in mine]
        if held:
            raise LeaseHeld(f"{name} needs {held[:5]}, leased to another worker")
        return token, mine

    def start(self, files: DataFrame, now: float) -> None:
        """Takes the newest row of each path in files as the state before the first run, once."""
        self.ledger.add(["base"])
        token, mine = self._hold("base", now, self.lease_seconds, ["base"])
        if mine:
            rows = files.select("path", digest(F.col("content_hash")).alias("digest"), "indexed_at").filter(_READY)
            output = f"state/run=0/token={token}"
            self._write(_latest(rows, "indexed_at", "digest").select("path", "digest", "indexed_at", F.lit(False).alias("changed"), F.lit(0).alias("run_id")), output)
            self.ledger.complete(token, mine, output)

    def run(self, run: int, arrivals: DataFrame, arrived: dict[int, set[int]], succeeds: bool, now: float) -> None:
        """One scan run: leases all arrivals up to it that are not done, and handles them.

        arrivals has path, run_id, obs_id, digest, indexed_at; arrived names its run
        ids, with the buckets each touches: only these are read of the state. A run
        that does not succeed commits nothing, and its lease ends with it.
        """
        states = self.ledger.states()
        open_items = [str(r) for r in sorted(arrived) if r <= run and states.get(str(r)) != "done"]
        if not open_items:
            return
        self.ledger.add(open_items)
        token, mine = self._hold(f"run-{run}", now, self.lease_seconds if succeeds else 0.0, open_items)
        if not succeeds or not mine:
            return
        output = f"state/run={run}/token={token}"
        batch = _latest(arrivals.filter(F.col("run_id").isin([int(i) for i in mine])), "indexed_at", "run_id", "obs_id", "digest")
        touched = sorted(set().union(*(arrived[int(i)] for i in mine)))
        state = self._read(self.outputs()).filter(F.col("bucket").isin(touched))
        old = state.join(batch.select("path"), "path", "left_semi").groupBy("path").agg(F.max_by("digest", F.struct("indexed_at", "run_id")).alias("old"), F.max("indexed_at").alias("old_at"))
        fresh = batch.join(old, "path", "left").filter("old_at is null or indexed_at >= old_at")
        self._write(fresh.select("path", "digest", "indexed_at", F.expr("old is null or old != digest").alias("changed"), F.lit(run).alias("run_id")), output)
        self.ledger.complete(token, mine, output)

    def changes(self) -> DataFrame:
        """run_id and path of all that committed runs had to handle."""
        return self._read([o for o in self.outputs() if "/run=0/" not in o]).filter("changed").select("run_id", "path")


def process_changes(folder: str, files: DataFrame, observations: DataFrame, scan_runs: DataFrame, now: float | None = None, lease_seconds: float = 3600.0, buckets: int = 8) -> DataFrame:
    """Brings the job of a folder up to the last scan run: run_id int, path.

    The state of a path is the digest of its record with the greatest indexed_at,
    among files and the observations that had become available; a run handles the
    paths whose state differs from that at the last successful run, or is new.
    Records with a null hash, path or indexed_at are left out; of records with the
    same indexed_at the one that became available last counts, then the greater
    obs_id, then the greater digest. Repeated records change nothing; an empty
    input gives an empty result; further columns are ignored.

    Each scan run leases the arrivals not yet done; a failed run leaves them open, so
    the next one takes them again. A successful run compares them with the state,
    writes its changes and state additions under its run and token, and commits with
    its fencing token. A run that died between writing and committing is repeated
    once its lease has expired (until then LeaseHeld is raised); what it wrote is not
    seen. A second call reads only observations of runs not yet done, and without
    any neither them nor the state. ``now`` is the time leases are judged by.
    """
    spark = files.sparkSession
    now = time.time() if now is None else now
    job = ChangeJob(spark, folder, lease_seconds, buckets)
    runs = sorted({(r["run_id"], r["status"]) for r in scan_runs.select("run_id", "status").collect() if r["run_id"] is not None})
    done = [int(i) for i, s in job.ledger.states().items() if s == "done" and i != "base"]
    fresh = observations.filter(~F.col("run_id").isin(done)) if done else observations
    seen = fresh.select("path", "run_id", "obs_id", digest(F.col("content_hash")).alias("digest"), "indexed_at").filter(_READY).filter("run_id is not null")
    seen = seen.filter(F.col("run_id") <= (runs[-1][0] if runs else 0))
    scratch = Scratch(spark, "incremental")
    seen = scratch.save(seen, "arrivals")
    # at most one row per scan run, each of at most `buckets` numbers
    arrived = {r["run_id"]: set(r["b"]) for r in seen.groupBy("run_id").agg(F.collect_set(job.bucket()).alias("b")).collect()}
    if arrived:
        job.start(files, now)
        for run, status in runs:
            job.run(run, seen, arrived, status == "success", now)
    return job.changes()


def replay_changes(files: DataFrame, observations: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """process_changes from the beginning, in a folder that goes when the driver ends."""
    return process_changes(Scratch(files.sparkSession, "incremental").path("job"), files, observations, scan_runs)
