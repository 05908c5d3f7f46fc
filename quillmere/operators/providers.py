"""Calls of outside models from tasks: a bounded number in flight, retries, a deadline, order kept, failures as rows."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

Call = Callable[..., object]


class _Request:
    """One row's call in a thread of its own, with its retries; `done` says that there is an answer."""

    def __init__(self, call: Call, values: tuple, retries: int, pause: float, until: float) -> None:
        self.done, self.value, self.error, self.attempts = threading.Event(), None, None, 0
        self.until = until
        threading.Thread(target=self._run, args=(call, values, retries, pause), daemon=True).start()

    def _run(self, call: Call, values: tuple, retries: int, pause: float) -> None:
        for k in range(retries + 1):
            self.attempts = k + 1
            try:
                self.value, self.error = call(*values), None
                break
            except Exception as e:  # noqa: BLE001  a provider may raise anything; the row says what
                self.error = f"{type(e).__name__}: {e}"[:500]
            if time.monotonic() + pause * 2**k >= self.until:
                break
            if k < retries:
                time.sleep(pause * 2**k)
        self.done.set()

    def answer(self) -> tuple[object, str | None, int]:
        if not self.done.wait(max(0.0, self.until - time.monotonic())):
            return None, "deadline", self.attempts
        return (None if self.error else self.value), self.error, self.attempts


def called(rows: DataFrame, use: list[str], result: str, kind: str, start: Callable[[], Call], in_flight: int = 8, retries: int = 2, seconds: float = 60.0, pause: float = 0.1) -> DataFrame:
    """rows with `result` (of the DDL type `kind`), `error` and `attempts`, in their order.

    start() is called once a task and gives the provider: a function of the columns `use`. A task has at most in_flight calls
    under way. A call that raises is tried again up to `retries` times with growing pauses; one that has not answered within
    `seconds` is given up with the error 'deadline'. A task whose provider leaves in_flight calls unanswered stops asking: the
    rest of its rows get the error 'unresponsive' instead of waiting in turn. Rows that the provider fails on never stop the others.
    """
    if in_flight < 1 or retries < 0:
        raise ValueError("at least one call in flight, and no negative number of retries")
    names = rows.columns
    at = [names.index(c) for c in use]
    value = StructType.fromDDL(f"v {kind}")[0].dataType
    schema = StructType([*rows.schema, StructField(result, value), *StructType.fromDDL("error string, attempts int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, hung, sent = start(), 0, 0
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            waiting: deque[_Request] = deque()
            out: list[tuple[object, str | None, int]] = []

            def take() -> None:
                nonlocal hung
                got = waiting.popleft().answer()
                hung += got[1] == "deadline"
                out.append(got)

            for values in zip(*[batch.column(k).to_pylist() for k in at], strict=True):
                if len(waiting) == in_flight:
                    take()
                if hung >= in_flight:
                    while waiting:
                        take()
                    out.append((None, "unresponsive", 0))
                    continue
                sent += 1
                waiting.append(_Request(call, values, retries, pause, time.monotonic() + seconds))
            while waiting:
                take()
            made = [pa.array([o[0] for o in out], to_arrow_type(value)), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, result, "error", "attempts"])

    return rows.mapInArrow(run, schema)


def memoized(requests: DataFrame, keys: list[str], use: list[str], ask: Callable[[DataFrame], DataFrame], memo: str, run: str) -> DataFrame:
    """requests with result, error, attempts and cached; what the memo at path `memo` holds is not asked for again.

    A request is known by its keys; `use` is what the provider is given and depends on the keys alone. Each distinct key that
    the memo lacks is asked for once: its answer is written as the part `run` of the memo and read back from there, so that
    nothing asks again when a task is repeated. Answers without text and failures are kept for this run only.
    """
    spark = requests.sparkSession
    shape = StructType([requests.schema[k] for k in keys] + StructType.fromDDL("result string, error string, attempts int").fields)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(memo)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    held = spark.read.schema(StructType([*shape, StructField("run", StructType.fromDDL("r string")[0].dataType)])).parquet(memo) if there else spark.createDataFrame([], shape).withColumn("run", F.lit(""))
    held = held.where((F.col("run") != run) & F.col("error").isNull() & (F.coalesce("result", F.lit("")) != ""))
    known = held.groupBy(*keys).agg(F.max_by("result", "run").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(True).alias("cached"))
    wanted = requests.groupBy(*keys).agg(*[F.first(c).alias(c) for c in use])
    misses = wanted.join(known.select(*keys), keys, "left_anti")
    ask(misses).select(*shape.names).write.mode("overwrite").parquet(f"{memo}/run={run}")
    new = spark.read.schema(shape).parquet(f"{memo}/run={run}").withColumn("cached", F.lit(False))
    return requests.join(known.unionByName(new), keys, "left")
