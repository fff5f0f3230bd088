"""Frames that are registered: which rows are made, and how they meet their parents."""

from lodeworks.operators import gates

FRAMES = "video_media_id long, bucket_name string, object_key string, timestamp double, frame_index int"


def registered(spark):
    frames = spark.createDataFrame([(1, "b", "k1", 0.0, 0), (1, "b", "k2", 2.5, 1), (2, "b", "k3", 0.0, 0), (3, "b", "k4", 0.0, 0), (None, "b", "k5", 0.0, 0)], FRAMES)
    return frames, spark.createDataFrame([(1, 7), (3, None), (9, 8), (None, 6)], "media_id long, post_id long")


def test_each_frame_is_made_or_rejected(spark):
    """A parent without a post is a parent; a frame that names none is rejected."""
    frames, media = registered(spark)
    made = gates.registered_frames(frames, media)
    assert sorted((r["object_key"], r["post_id"]) for r in made["media"].collect()) == [("k1", 7), ("k2", 7), ("k4", None)]
    assert sorted(r["media_id"] for r in made["media"].collect()) == sorted(r["media_id"] for r in made["frames"].collect())
    assert sorted(r["object_key"] for r in made["rejected"].collect()) == ["k3", "k5"] and made["rejected"].columns == frames.columns
    rows = gates.registered_rows(frames, media)
    assert sorted((r["kind"], r["object_key"]) for r in rows.collect()) == [("frames", "k1"), ("frames", "k2"), ("frames", "k4"), ("media", "k1"), ("media", "k2"), ("media", "k4"), ("rejected", "k3"), ("rejected", "k5")]


def test_tasks_do_not_sort_frames(spark):
    """A sort holds all frames of a task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in gates.registered_frames(*registered(spark)).values():
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
