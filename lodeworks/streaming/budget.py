"""A token budget over a sliding window that requests wait for, as keyed state with timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import shared_folder
from .windows import event_stream

#: Fixed value: seconds that a sent request counts.
WINDOW_SECONDS = 60
OUT = "id long, at long, released long, tokens long"


def released(at: int, tokens: int, last: int, sent: list[tuple[int, int]], budget: int, window: int) -> tuple[int, list[tuple[int, int]]]:
    """When a request may go (microseconds), and the window after it. It goes once the one before it has gone and what still counts leaves
    it room, or once nothing counts any more; a request without tokens, and any without a budget, waits for its turn alone."""
    now = max(at, last)
    if tokens <= 0 or budget <= 0:
        return now, sent
    sent = [s for s in sent if s[0] > now - window]
    used = sum(n for _, n in sent)
    while sent and used + tokens > budget:
        oldest = sent[0][0]
        now = max(now, oldest + window)
        used -= sum(n for s, n in sent if s <= oldest)
        sent = [s for s in sent if s[0] > oldest]
    return now, [*sent, (now, tokens)]


class Waiting(StatefulProcessor):
    """Requests of one key (id, at, tokens) are held until the watermark has passed them, then released in the order of their time; so
    how they fall into batches does not matter. State: the requests held, the sent ones that count, and the time of the last. The store is
    asked a few times for each key and batch, not for each request, as every call is answered by another process."""

    def __init__(self, budget: int, window_seconds: int = WINDOW_SECONDS):
        self.budget, self.window = budget, window_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, tokens long")
        self.sent = handle.getValueState("sent", "last long, at array<long>, tokens array<long>")
        self.timer = handle.getValueState("timer", "due long")

    def _due(self, earliest: int | None) -> None:
        """Keep one timer, that of the earliest request held."""
        old = self.timer.get()[0] if self.timer.exists() else None
        due = None if earliest is None else -(-earliest // 1000)
        if old is not None and due is not None and old <= due:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if due is not None:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at, r.id, r.tokens or 0) for r in rows if r.id is not None]
        if new:
            self.held.appendList(new)
            self._due(min(at for at, _, _ in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        # a request that came again counts once, as it came last
        every = sorted((at, id_, tokens) for (at, id_), tokens in {(at, id_): n for at, id_, n in self.held.get()}.items())
        now = [x for x in every if x[0] <= passed]
        last, sent = 0, []
        if self.sent.exists():
            last, at, tokens = self.sent.get()
            sent = list(zip(at, tokens, strict=True))
        for at, id_, tokens in now:
            last, sent = released(at, tokens, last, sent, self.budget, self.window)
            yield Row(id=id_, at=at, released=last, tokens=tokens)
        if now:
            self.sent.update((last, [s for s, _ in sent], [n for _, n in sent]))
        rest = every[len(now) :]
        if rest:
            self.held.put(rest)
            self._due(rest[0][0])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def waited(requests: DataFrame, key: str, budget: int, window_seconds: int = WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """A stream of requests (key, id, ts, tokens) as a stream of (id, at, released, tokens), times in microseconds. What is later than
    ``late`` behind the newest request is dropped by the watermark; a row without an id only moves the watermark. The state of keys
    needs the RocksDB store, which the stream's session has to name."""
    timed = requests.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    rows = timed.select(key, "id", F.unix_micros("time").alias("at"), F.col("tokens").cast("long").alias("tokens"), "time")
    return rows.groupBy(key).transformWithState(statefulProcessor=Waiting(budget, window_seconds), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> None:
    """Streams that start from now on hold their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(stream: DataFrame, folder: str, wait: bool = True):
    """Run the stream over what is there; a batch that is run again writes the same rows to the same place. What is in ``folder``/state
    lets the next run go on where this one stopped."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    with_state_store(stream.sparkSession)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    if wait:
        q.awaitTermination()
    return q


def budgeted_events(spark: SparkSession, sf_dir: str, budget: int, window_seconds: int) -> DataFrame:
    """The events as requests of their users, each of 100 to 700 tokens: when each was sent."""
    folder = f"{shared_folder(spark)}/lodeworks/budget-{uuid.uuid4().hex}"
    events = event_stream(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), "ts", ((F.col("event_id") % 7 + 1) * 100).alias("tokens"))
    # a last row that moves the watermark past all events
    spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 1 day")).alias("ts")).write.parquet(f"{folder}/end")
    end = spark.readStream.schema("ts timestamp_ntz").parquet(f"{folder}/end").select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("id"), F.col("ts").cast(events.schema["ts"].dataType).alias("ts"), F.lit(0).cast("long").alias("tokens"))
    run(waited(events.unionByName(end), "user_id", budget, window_seconds), folder)
    return spark.read.schema(OUT + ", batch int").parquet(f"{folder}/table").drop("batch")
