"""Streams that stop and go on, rows that come late, and waiting for a budget."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from lodeworks.streaming import budget, jobs, windows

START = dt.datetime(2024, 1, 1)


def waited(rows, most, seconds):
    """id: when each is sent, by looking second by second for room; rows: (id, second, tokens) of one key."""
    sent, last, out = [], 0, {}
    for at, id_, n in sorted((a, i, n) for i, a, n in rows):
        now = max(at, last)
        while n > 0 and (held := [m for t, m in sent if t > now - seconds]) and sum(held) + n > most:
            now += 1
        if n > 0:
            sent.append((now, n))
        out[id_], last = now, now
    return out


def fed(spark, folder, name, rows):
    """One more file of (key, id, second, tokens) in the stream's folder."""
    frame = spark.createDataFrame([(k, i, START + dt.timedelta(seconds=s), n) for k, i, s, n in rows], "key long, id long, ts timestamp_ntz, tokens long")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.05)


def sent(spark, folder, most, seconds):
    stream = spark.readStream.schema("key long, id long, ts timestamp_ntz, tokens long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    budget.run(budget.waited(stream, "key", most, seconds, late="60 seconds"), folder)
    rows = spark.read.schema(budget.OUT).parquet(f"{folder}/table").collect()
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["released"] // 1_000_000 - zero for r in rows}


def test_a_request_waits_for_those_before():
    assert [budget.released(a, n, 0, [(0, 600), (10, 300)], 1000, 60)[0] for a, n in ((20, 100), (20, 101), (20, 701), (20, 5000), (61, 700), (20, 0))] == [20, 60, 70, 70, 61, 20]
    rng = random.Random(1)
    for _ in range(50):
        rows = [(i, rng.randrange(400), rng.choice([0, 100, 300, 700, 1500])) for i in range(60)]
        last, held, out = 0, [], {}
        for at, id_, n in sorted((a, i, n) for i, a, n in rows):
            last, held = budget.released(at, n, last, held, 1000, 60)
            out[id_] = last
        assert out == waited(rows, 1000, 60)


def test_budget_over_restarts_and_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, i // 2 + rng.randrange(40), rng.choice([0, 200, 500])) for i in range(240)]
    folder = f"file://{tmp_path}/a"
    for n in range(0, 120, 40):
        fed(spark, folder, n, rows[n : n + 40])
    first = sent(spark, folder, 1000, 30)
    assert 0 < len(first) < 120  # the rest waits for the watermark
    for n in range(120, 240, 40):
        fed(spark, folder, n, rows[n : n + 40])
    fed(spark, folder, "end", [(None, None, 5000, 0)])
    after = sent(spark, folder, 1000, 30)
    assert all(after[i] == t for i, t in first.items())
    fed(spark, folder, "late", [(1, 999, 10, 100), (1, 1000, 6000, 100)])
    fed(spark, folder, "end", [(None, None, 9000, 0)])
    last = sent(spark, folder, 1000, 30)
    assert 999 not in last and last[1000] == 6000
    want = {}
    for key in (1, 2, None):
        want |= waited([r[1:] for r in rows if r[0] == key], 1000, 30)
    assert {i: t for i, t in last.items() if i != 1000} == want and any(want[r[1]] > r[2] for r in rows)


def test_windows_drop_what_the_watermark_has_passed(spark, tmp_path):
    folder = f"file://{tmp_path}/b"

    def put(hours):
        spark.createDataFrame([(START + dt.timedelta(hours=h), "view", 1.0) for h in hours], "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)

    def run():
        stream = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = windows.counted(stream, "1 hour", "2 hours").writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/table").trigger(availableNow=True).start()
        out.awaitTermination()
        return {r["h"]: r["n"] for r in spark.read.parquet(f"{folder}/table").select(F.hour("window.start").alias("h"), "n").collect()}

    put([0, 0, 1])
    put([5])
    assert run() == {0: 2, 1: 1}
    put([1, 4])  # the first is behind the watermark, the second is not
    put([9])
    assert run() == {0: 2, 1: 1, 4: 1, 5: 1}


def test_jobs_are_created_once(spark, tmp_path):
    rows = [(1, START, 1, "view", 0.0, "{}"), (2, START, 1, "view", 0.0, "{}"), (3, START, 2, "error", 0.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    assert [tuple(r) for r in jobs.created_jobs(spark, f"file://{tmp_path}").collect()] == [("view", 1)]


def test_the_store_is_asked_per_key_not_per_request():
    from types import SimpleNamespace as N

    from lodeworks.streaming.budget import Waiting

    calls = []

    class State:
        def __init__(self):
            self.value = None

        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                if name in ("get", "exists"):
                    return self.value is not None if name == "exists" else self.value if self.value is not None else iter(())
                self.value = None if name == "clear" else a[0] if a else None

            return call

    state = lambda *a: State()
    w = Waiting(1000, 60)
    w.init(N(getMapState=state, getListState=state, getValueState=state, registerTimer=lambda t: None, deleteTimer=lambda t: None))
    list(w.handleInputRows(("k",), iter([N(id=i % 400, at=i % 400 * 1000, tokens=1) for i in range(500)]), None))
    out = list(w.handleExpiredTimer(("k",), N(getCurrentWatermarkInMs=lambda: 300), None))
    assert [r.id for r in out] == list(range(301))
    assert len(calls) < 20
