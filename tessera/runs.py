"""Runs of plans: record, timeout, trace, and comparison."""

from __future__ import annotations

import base64
import json
import threading
import time
import uuid
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .engine import Engine
from .plans.nodes import NLJ, Leaf, Plan
from .plans.planjson import plan_hash, query_hash, to_json, trees_from_json
from .sources.base import INTERFACES

CAP_S = 60
#: An answer's time of arrival, in milliseconds, beside its variables.
ARRIVED = "__arrived"
SCHEMA = "run_id string, query_name string, query string, query_hash string, plan_hash string, plan string, sources array<string>, status string, t_start double, t_end double, t_delta double, result_count long, requests long, path string, error string"


def interface_requests(trees: list[Plan], produced: dict[int, int]) -> int:
    """Pages that are fetched of the leaves, and requests that bind the rows of an NLJ's other side, as joined."""
    at, total = iter(range(10**9)), 0

    def walk(p: Plan, fetched: bool = True) -> int:
        nonlocal total
        if isinstance(p, Leaf):
            if fetched:
                total += sum(ceil(max(p.cardinality, 1) / INTERFACES[k][1]) for k in p.kinds)
            return p.cardinality
        bind = p.op == NLJ and isinstance(p.right, Leaf)
        left = walk(p.left)
        walk(p.right, not bind)
        if bind:
            total += sum(ceil(left / INTERFACES[k][0]) for k in p.right.kinds)
        return produced.get(next(at), p.cardinality)

    for t in trees:
        walk(t)
    return total


def produced(o, wait: float = 10.0) -> int:
    """Rows that an observed join had; 0 if Spark found it empty and left it out, so that it never reports."""
    got: list[int] = []
    t = threading.Thread(target=lambda: got.append(o.get["n"]), daemon=True)
    t.start()
    t.join(wait)
    return got[0] if got else 0


class Runs:
    """A table of runs at `path`, in Parquet: one row a run, and each run's answers beside it."""

    def __init__(self, engine: Engine, path: str):
        self.engine, self.spark, self.path = engine, engine.spark, path.rstrip("/")
        self.reserved: set[str] = set()
        self.lock = threading.Lock()

    def submit(self, plan: dict, query: str, name: str = "", cap: float = CAP_S) -> str:
        """Runs a plan to its end or the cap, and records it; refused while the same plan of the query is running.

        Statuses: done, timeout, failed; `error` says why.  The plan is
        recorded with the rows that each join produced; a run that failed or
        was cut off has none.  Each answer is written with the time when it
        came out of the plan; requests are what the sources' interfaces would
        take for the rows that were joined.
        """
        q = self.engine.parse(query)
        key = plan_hash(plan) + query_hash(q)
        with self.lock:
            if key in self.reserved:
                raise RuntimeError("this plan is already running")
            self.reserved.add(key)
        run_id, start, out = uuid.uuid4().hex, time.time(), f"{self.path}/answers"
        status, n, recorded, cut, over, error, requests = "done", 0, plan, threading.Event(), threading.Event(), None, None
        tag = f"run-{run_id}"

        def stop() -> None:
            cut.set()
            while not over.is_set():  # a job may begin after the first call
                self.spark.sparkContext.cancelJobsWithTag(tag)
                over.wait(0.5)

        timer = threading.Timer(cap, stop)
        self.spark.sparkContext.addJobTag(tag)
        try:
            timer.start()
            trees = trees_from_json(plan, self.engine.sources, q.prefixes)
            seen: list = []
            df = self.engine.run_plan(trees, q, observe=seen)
            out = f"{self.path}/answers/{run_id}"
            df.withColumn(ARRIVED, F.expr("cast(java_method('java.lang.System', 'currentTimeMillis') as long)")).write.mode("overwrite").parquet(out)
            n = self.spark.read.parquet(out).count()
            # a slice may end the joins early: what they counted is what they produced
            counts = {i: produced(o) for i, o in enumerate(seen)}
            recorded, requests = to_json(trees, counts, len(self.engine.sources.sources) > 1), interface_requests(trees, counts)
            if cut.is_set():
                raise TimeoutError(f"over {cap} seconds")
        except Exception as e:
            status, error = "timeout" if cut.is_set() else "failed", f"{type(e).__name__}: {e}"[:2000]
        finally:
            over.set()
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
            with self.lock:
                self.reserved.discard(key)
        end = time.time()
        row = (run_id, name, query, query_hash(q), plan_hash(plan), json.dumps(recorded), [str(s) for s in self.engine.sources.sources.values()], status, start, end, end - start, n, requests, out if status == "done" else None, error)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return run_id

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/runs")

    def recent(self, n: int = 20) -> DataFrame:
        return self.table.orderBy(F.desc("t_start"), "run_id").limit(n)

    def get(self, run_id: str) -> dict | None:
        row = self.table.where(F.col("run_id") == run_id).first()
        return row.asDict() if row else None

    def search(self, text: str) -> DataFrame:
        """Runs with the text in their name, in any case."""
        return self.table.where(F.contains(F.lower("query_name"), F.lit(text.lower())))

    def answers(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self.get(run_id)["path"]).drop(ARRIVED)

    def trace(self, run_id: str) -> DataFrame:
        """(seconds, n): answers of a run that had come by each time, from its begin."""
        run = self.get(run_id)
        each = self.spark.read.parquet(run["path"]).groupBy((F.col(ARRIVED) / 1000 - F.lit(run["t_start"])).alias("seconds")).agg(F.count("*").alias("k"))
        return each.select("seconds", F.sum("k").over(W.orderBy("seconds")).alias("n"))  # a row a millisecond at most

    def other_plans(self, query: str) -> DataFrame:
        """The latest run of each different plan of a query."""
        return latest(self.table.where(F.col("query_hash") == query_hash(self.engine.parse(query))), ["plan_hash"], ["t_start", "run_id"])

    def summary(self) -> DataFrame:
        """Runs, requests and time by interface."""
        each = self.table.withColumn("interface", F.explode(F.array_distinct(F.transform("sources", lambda s: F.substring_index(s, "@", 1)))))
        return each.groupBy("interface").agg(F.count("*").alias("runs"), F.sum("requests").alias("requests"), F.avg("requests").alias("avg_requests"), F.sum("t_delta").alias("seconds"), F.avg("t_delta").alias("avg_seconds"))


def latest(df: DataFrame, by: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each group."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def answer_trace(df: DataFrame, by: list[str], at: list[str], name: str = "n") -> DataFrame:
    """A running count of answers in order of time, within each group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*at)))


def diefficiency(trace: DataFrame, by: list[str], seconds: str, count: str = "n") -> DataFrame:
    """The area under each group's step curve of answers over time, up to its last answer."""
    w = W.partitionBy(*by).orderBy(seconds, count)
    step = trace.withColumn("__d", F.lead(seconds).over(w) - F.col(seconds))
    return step.groupBy(*by).agg(F.coalesce(F.sum(F.col(count) * F.col("__d")), F.lit(0.0)).alias("dief"))


def bounds(a: DataFrame, b: DataFrame, seconds: str, count: str = "n") -> DataFrame:
    """The largest time and count of two traces, as axes that hold both."""
    both = a.select(seconds, count).unionByName(b.select(seconds, count))
    return both.agg(F.max(seconds).alias("max_time"), F.max(count).alias("max_count"))


def to_sparql_json(df: DataFrame, seconds: str | None = None) -> dict:
    """SPARQL results in JSON of a small result, each binding with its place in the order of arrival."""
    names = [c for c in df.columns if c != seconds]
    rows = []
    for i, r in enumerate(df.toLocalIterator(), 1):
        cell = {n: {"value": str(r[n]), "type": "uri" if isinstance(r[n], str) and r[n].startswith(("http://", "https://")) else "Literal"} for n in names if r[n] is not None}
        rows.append(cell | {"_trace_": {"value": str(r[seconds] if seconds else 0), "type": "Literal", "count": str(i)}})
    return {"head": {"vars": names}, "results": {"bindings": rows}}


def encode_args(query: str, sources: list[str], planner: str) -> str:
    """A plan request's arguments as one word for a URL."""
    return base64.urlsafe_b64encode(json.dumps([query, sources, planner]).encode()).decode()


def decode_args(text: str) -> tuple[str, list[str], str]:
    return tuple(json.loads(base64.urlsafe_b64decode(text)))
