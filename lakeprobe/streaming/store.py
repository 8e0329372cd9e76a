"""Jobs that are started, stepped, cancelled and asked for, from any session: their state is the state of a stream.

Commands are rows appended to a folder; a stateful stream folds each job's commands, in
order, into its state and appends every change to a table of states. The stream's
checkpoint is the lock: one query at a time advances it, and a command is applied once,
whatever fails. Comparing and setting is done by cursor: a step names the cursor it
started from, and whoever comes second with the same one is stale and changes nothing.

A step's work runs in the session that asks for it, before its outcome is posted, and
what the stream carries are small rows: states hold cursors and counts, never datasets.

Defined results:
* a job without state, evicted, or whose state can't be read, is missing (KeyError);
* lines of commands that can't be read are left out;
* a finished job (completed, failed, cancelled) stays as it is;
* a handler that fails, or a state of too many bytes, ends its job as failed, with the
  message; parameters whose names tell of secrets are refused before anything is written;
* starting a job evicts jobs that are too old, too many, or too large together, the
  longest untouched first.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeprobe.functions import urls
from lakeprobe.session import shared_dir

QUEUED, RUNNING, COMPLETED, FAILED, CANCELLED = "queued", "running", "completed", "failed", "cancelled"
TERMINAL = (COMPLETED, FAILED, CANCELLED)
COMMAND = "job_id string, at double, op string, cursor string, payload string"
STATE = (
    "job_id string, version long, status string, kind string, progress double, cursor string, partial string, errors array<string>, created double, updated double, internal string, bytes long, event string"
)


@dataclass(frozen=True)
class Limits:
    """Jobs kept, bytes of a job and of all, seconds a job may stay untouched."""

    jobs: int = 200
    job_bytes: int = 256 * 1024
    total_bytes: int = 64 * 1024 * 1024
    seconds: float = 24 * 3600


@dataclass(frozen=True)
class Budget:
    """What a step may do: units, milliseconds, bytes. Handlers are given it and keep to it."""

    units: int = 10
    ms: int = 8000
    bytes: int = 8 * 1024 * 1024


@dataclass
class Outcome:
    """What a step did: a result to show, the state to go on with, how far it is, whether it is done."""

    partial: object
    internal: dict
    progress: float
    done: bool
    errors: tuple[str, ...] = ()


def token(job_id: str, version: int) -> str:
    """The cursor of a version: the same whenever it is made again."""
    return hashlib.sha256(f"{job_id}:{version}".encode()).hexdigest()[:16]


def fold(job_id: str, state: dict | None, op: str, at: float, cursor: str | None, payload: str | None, job_bytes: int) -> tuple[dict | None, str]:
    """The state after a command, and what became of it: applied, stale, ended, missing or evicted."""
    if op == "start":
        if state is not None:
            return state, "stale"
        asked = json.loads(payload or "{}")
        internal = json.dumps({"params": asked.get("params", {})}, sort_keys=True)
        state = {"version": 0, "status": QUEUED, "kind": asked.get("kind", ""), "progress": 0.0, "cursor": token(job_id, 0), "partial": None, "errors": [], "created": at, "internal": internal}
    elif state is None:
        return None, "missing"
    elif op == "evict":
        return None, "evicted"
    elif state["status"] in TERMINAL:
        return state, "ended"
    elif cursor is not None and cursor != state["cursor"]:
        return state, "stale"
    else:
        state = state | {"version": state["version"] + 1}
        if op == "cancel":
            state |= {"status": CANCELLED, "cursor": None}
        elif op == "fail":
            state |= {"status": FAILED, "cursor": None, "errors": [payload or ""]}
        else:
            got = json.loads(payload or "{}")
            internal = got.get("internal", {}) | {"params": json.loads(state["internal"]).get("params", {})}
            state |= {"status": RUNNING, "partial": json.dumps(got.get("partial"), sort_keys=True), "progress": max(0.0, min(1.0, got.get("progress", 0.0))), "errors": list(got.get("errors", []))}
            state |= {"internal": json.dumps(internal, sort_keys=True), "cursor": token(job_id, state["version"])}
            if got.get("done"):
                state |= {"status": COMPLETED, "progress": 1.0, "cursor": None}
    if size(state) > job_bytes:
        state |= {"status": FAILED, "cursor": None, "errors": ["the state of the job is too large"], "partial": None, "internal": "{}"}
    return state | {"updated": at}, "applied"


def size(state: dict) -> int:
    """Bytes that a state counts as."""
    return len((state["internal"] or "").encode()) + len((state["partial"] or "").encode())


FIELDS = ("version", "status", "kind", "progress", "cursor", "partial", "errors", "created", "updated", "internal")
KEPT = "version long, status string, kind string, progress double, cursor string, partial string, errors array<string>, created double, updated double, internal string"


def states(commands: DataFrame, job_bytes: int = Limits.job_bytes) -> DataFrame:
    """A stream of commands (COMMAND) folded into a stream of states (STATE), one row for every change; a job's commands of one batch are put in order of `at`."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        job_id, state = key[0], dict(zip(FIELDS, held.get, strict=True)) if held.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "op"], kind="stable")
        out = []
        for op, at, cursor, payload in zip(rows["op"], rows["at"], rows["cursor"], rows["payload"], strict=True):
            before = state
            state, event = fold(job_id, state, op, at, None if pd.isna(cursor) else cursor, None if pd.isna(payload) else payload, job_bytes)
            if event in ("applied", "evicted"):
                told = state or before
                out.append({"job_id": job_id, **told, "updated": at, "bytes": size(told), "event": event})
        if state is None:
            if held.exists:
                held.remove()
        else:
            held.update(tuple(list(state[f]) if f == "errors" else state[f] for f in FIELDS))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    known = commands.filter("job_id IS NOT NULL AND op IS NOT NULL AND at IS NOT NULL")
    return known.groupBy("job_id").applyInPandasWithState(run, STATE, KEPT, "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """The last state of every job that isn't evicted, from its changes."""
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), F.struct("updated", "version")).alias("s"))
    return last.select("job_id", "s.*").filter("event <> 'evicted'").drop("event")


class Jobs:
    """Jobs below a shared folder. Sessions that name the same folder see the same jobs."""

    def __init__(self, spark: SparkSession, folder: str | None = None, limits: Limits | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.limits, self.clock = spark, limits or Limits(), clock
        self.folder = folder or f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
        self.handlers: dict[str, Callable[[dict, dict, Budget], Outcome]] = {}

    def register(self, kind: str, handler: Callable[[dict, dict, Budget], Outcome]) -> None:
        """Name the work of a kind of job: handler(params, internal state, budget) does one step."""
        self.handlers[kind] = handler

    def _post(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, COMMAND).coalesce(1).write.mode("append").json(f"{self.folder}/commands")

    def _apply(self, tries: int = 5) -> None:
        """Fold what has been posted; while another session does so, wait for it."""
        for i in range(tries):
            commands = self.spark.readStream.schema(COMMAND).json(f"{self.folder}/commands")
            rows = states(commands, self.limits.job_bytes)
            job = rows.writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/states").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
            try:
                job.awaitTermination()
                return
            except StreamingQueryException as e:
                if i == tries - 1 or "oncurrent" not in str(e):
                    raise
                time.sleep(0.5 * 2**i)

    def changes(self) -> DataFrame:
        """Every state that any job has had; none before the first job."""
        try:
            return self.spark.read.schema(STATE).option("ignoreCorruptFiles", True).parquet(f"{self.folder}/states")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STATE)

    def status(self, job_id: str) -> dict:
        """The state of a job."""
        row = latest(self.changes().filter(F.col("job_id") == job_id)).first()
        if row is None:
            raise KeyError(job_id)
        return row.asDict()

    def start(self, kind: str, params: dict) -> dict:
        """A new job, queued."""
        if kind not in self.handlers:
            raise KeyError(kind)
        if secret := [k for k in params if any(h in k.lower() for h in urls.SECRET_HINTS)]:
            raise ValueError(f"secrets must not be kept with a job: {', '.join(secret)}")
        self.evict()
        job_id = uuid.uuid4().hex
        self._post([(job_id, self.clock(), "start", None, json.dumps({"kind": kind, "params": params}))])
        self._apply()
        return self.status(job_id)

    def step(self, job_id: str, cursor: str | None = None, budget: Budget | None = None) -> dict:
        """One step of a job. A cursor that isn't the job's own, or a job that has ended, changes nothing."""
        state = self.status(job_id)
        if state["status"] in TERMINAL or (cursor is not None and cursor != state["cursor"]):
            return state
        handler, internal = self.handlers.get(state["kind"]), json.loads(state["internal"])
        if handler is None:
            op, payload = "fail", f"no handler for {state['kind']}"
        else:
            try:
                got = handler(internal.get("params", {}), {k: v for k, v in internal.items() if k != "params"}, budget or Budget())
                op, payload = "advance", json.dumps({"partial": got.partial, "internal": got.internal, "progress": got.progress, "done": got.done, "errors": list(got.errors)})
            except Exception as e:  # a handler's failure ends its job, with its message, and not the caller
                op, payload = "fail", f"{type(e).__name__}: {e}"
        self._post([(job_id, self.clock(), op, state["cursor"], payload)])
        self._apply()
        return self.status(job_id)

    def cancel(self, job_id: str) -> dict:
        """End a job where it is."""
        if self.status(job_id)["status"] not in TERMINAL:
            self._post([(job_id, self.clock(), "cancel", None, None)])
            self._apply()
        return self.status(job_id)

    def evict(self) -> int:
        """Drop jobs beyond the limits; how many went."""
        known = latest(self.changes()).select("job_id", "updated", "bytes")
        gone = [r["job_id"] for r in evicted(known, self.limits, self.clock()).collect()]
        if gone:
            now = self.clock()
            self._post([(j, now, "evict", None, None) for j in gone])
            self._apply()
        return len(gone)


def evicted(jobs: DataFrame, limits: Limits, now: float) -> DataFrame:
    """Of jobs (job_id, updated, bytes), those to drop: too old, then beyond the number, then beyond the bytes of all; the last touched stay."""
    fresh = jobs.filter((F.lit(limits.seconds) <= 0) | (F.lit(now) - F.col("updated") <= limits.seconds))
    # at most `jobs` rows are put in one order
    kept = fresh.orderBy(F.desc("updated"), "job_id").limit(limits.jobs)
    held = kept.withColumn("held", F.sum("bytes").over(Window.orderBy(F.desc("updated"), "job_id"))).filter(F.col("held") <= limits.total_bytes)
    return jobs.join(held.select("job_id"), "job_id", "left_anti").select("job_id")
