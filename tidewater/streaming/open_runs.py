"""Live stop requests against a keyed state of open runs.

Starts, ends and stop requests come as one stream of events.  The state holds
the open runs only: a start adds a run, its end removes it, so no micro-batch
looks at the history again.  A request names every run of its correlation id
that is open when it arrives, each run once; requests for other ids are ignored.

A correlation id is cut into lanes by the run id, and a request goes to every
lane of its id, so the open runs of a busy id are spread over several state
keys.  A state key is a bucket of lanes of many ids, so the number of keys,
each with its cost in every micro-batch that touches it, does not grow with
the ids.  Within a micro-batch starts come before ends and ends before requests,
whatever the order of its rows.  An end that arrives in an earlier micro-batch
than its start is remembered until the start comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Parts of one correlation id.
LANES = 8
#: State keys in all; a micro-batch loads and writes the open runs of the keys it touches.
BUCKETS = 4096
# Kinds of events.
START, END, REQUEST = "start", "end", "request"
#: Microseconds of wall clocks survive the trip through the state.
_CLOCKS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

_STATE = "open_of array<string>, open_ids array<bigint>, open_runs array<string>, early_of array<string>, early_ids array<bigint>"
_OUT = "correlation_id string, execution_id bigint, run string"


def run_events(runs: DataFrame) -> DataFrame:
    """A history of runs as events: one start for each run, one end for each that has ended (``kind``, then the run's columns)."""
    kinds = F.when(F.col("end_time").isNull(), F.array(F.lit(START))).otherwise(F.array(F.lit(START), F.lit(END)))
    events = runs.select(F.explode(kinds).alias("kind"), *runs.columns)
    # A start knows nothing of the end.
    return events.withColumn("end_time", F.when(F.col("kind") == END, F.col("end_time")))


def run_event_source(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run events as a stream of Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _stepper() -> Callable[[tuple, Iterator, GroupState], Iterator]:
    """The state function, made here so that it travels whole: workers need not have this package."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        """One bucket in one micro-batch; a run is known by its correlation id and its own."""
        import pandas as pd

        of, ids, runs, early_of, early_ids = state.get if state.exists else ([], [], [], [], [])
        # A run whose stop was asked for stays until its end, without its record.
        still_open, early = dict(zip(zip(of, ids), runs)), set(zip(early_of, early_ids))
        started, ended, asked = {}, set(), set()
        for rows in batches:
            for kind, c, i, run in zip(rows["kind"], rows["correlation_id"], rows["execution_id"], rows["run"]):
                if kind == REQUEST:
                    asked.add(c)
                    continue
                at = (c, int(i))
                if kind == START:
                    started[at] = "" if at in ended else run
                else:
                    ended.add(at)
                    if at in started:  # its record is no longer needed
                        started[at] = ""
        for at, run in started.items():
            still_open.setdefault(at, run)
        for at in ended:
            if still_open.pop(at, None) is None:
                early.add(at)
        for at in early & set(still_open):
            del still_open[at]
            early.discard(at)
        named = []
        if asked:
            named = [(*at, run) for at, run in still_open.items() if run and at[0] in asked]
            still_open.update(dict.fromkeys([at for at in still_open if at[0] in asked], ""))
        if still_open or early:
            early = sorted(early)
            state.update(([c for c, _ in still_open], [i for _, i in still_open], list(still_open.values()), [c for c, _ in early], [i for _, i in early]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(named, columns=["correlation_id", "execution_id", "run"])

    return step


def stop_actions(events: DataFrame, requests: DataFrame, lanes: int = LANES, buckets: int = BUCKETS) -> DataFrame:
    """Streaming frame of the runs to stop, with the columns of ``events`` but ``kind``.

    ``events``: a stream of ``run_events`` rows; ``requests``: a stream with
    ``correlation_id``.  Events and requests without an id take no part.
    """
    fields = [f for f in events.schema.fields if f.name != "kind"]
    record = F.to_json(F.struct(*[F.col(f.name) for f in fields]), _CLOCKS)
    lane = F.pmod(F.xxhash64("execution_id"), F.lit(lanes)).cast("int")
    told = events.select("correlation_id", lane.alias("lane"), "kind", F.col("execution_id").cast("long").alias("execution_id"),
                         F.when(F.col("kind") == START, record).alias("run"))
    asked = requests.select(
        "correlation_id", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(REQUEST).alias("kind"),
        F.lit(None).cast("long").alias("execution_id"), F.lit(None).cast("string").alias("run"),
    )
    bucket = F.pmod(F.xxhash64("correlation_id", "lane"), F.lit(buckets)).cast("int")
    both = told.union(asked).where(F.col("correlation_id").isNotNull()).select(bucket.alias("bucket"), "kind", "correlation_id", "execution_id", "run")
    found = both.groupBy("bucket").applyInPandasWithState(_stepper(), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.from_json("run", T.StructType(fields), _CLOCKS).alias("run")).select("run.*")
