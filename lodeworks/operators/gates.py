"""Gates that rows pass on their way into tables and collections, each with the reasons that it gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .entities import first_reason

#: Why an extracted event is not taken, in the order in which it is asked.
NO_EVENT, NO_NAME, NO_SLUG, ODD_CONFIDENCE, LOW_CONFIDENCE, NO_QUOTE, FOREIGN_QUOTE = (
    "khong_co_su_kien", "thieu_ten", "ten_khong_tao_duoc_slug", "do_tin_cay_khong_doc_duoc", "do_tin_cay_thap", "thieu_trich_dan", "trich_dan_khong_co_trong_bai",
)
LEAST_CONFIDENCE = 0.6


def extraction_reason(has_event: Column, name: Column, confidence: Column, quote: Column, body: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Why an event that was extracted from ``body`` is not taken; empty where it is. ``confidence`` is a text: none at all counts as 0, one that is no
    number is a reason. The quote has to stand in the body, both without marks and anything but letters and digits."""
    named, said = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(confidence, F.lit("")))
    number = F.when(said == "", F.lit(0.0)).otherwise(said.try_cast("double"))
    quoted = F.trim(F.coalesce(quote, F.lit("")))
    held = F.contains(text.letters_and_digits(F.coalesce(body, F.lit(""))), text.letters_and_digits(quoted))
    return first_reason(
        (NO_EVENT, ~F.coalesce(has_event, F.lit(False))),
        (NO_NAME, named == ""),
        (NO_SLUG, text.slug(named) == ""),
        (ODD_CONFIDENCE, number.isNull()),
        (LOW_CONFIDENCE, number < least),
        (NO_QUOTE, quoted == ""),
        (FOREIGN_QUOTE, ~held),
    )


@dataclass(frozen=True)
class Policy:
    """What media have to be like; None sets no bound."""

    video_extensions: tuple[str, ...] = (".mp4", ".mov", ".mkv", ".webm", ".avi")
    image_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")
    least_seconds: float | None = None
    most_seconds: float | None = None
    least_bytes: int | None = None
    most_bytes: int | None = None
    audio_required: bool = False
    ocr: bool = True
    caption: bool = True
    detection: bool = True
    speech: bool = True


def media_errors(media_id: Column, media_type: Column, mime_type: Column, source: Column, seconds: Column, size: Column, audio: Column, policy: Policy) -> Column:
    """An array of all that is wrong with a medium, in a fixed order. The messages. The kind is told by ``media_type``: extensions and
    mime types of images hold for images, those of videos for all else; a mime type counts only where the source has no extension."""
    kind, mime = F.lower(F.trim(F.coalesce(media_type, F.lit("")))), F.lower(F.trim(F.coalesce(mime_type, F.lit(""))))
    extension = F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), r"[^/](\.[^./]+)/*$", 1))
    image = kind == "image"
    known = F.when(image, extension.isin(*policy.image_extensions)).otherwise(extension.isin(*policy.video_extensions))
    of_kind = F.startswith(mime, F.when(image, "image/").otherwise("video/"))
    found = [
        F.when(F.trim(F.coalesce(media_id, F.lit(""))) == "", "media_id is required"),
        F.when(kind == "", "media_type is required"),
        F.when((kind != "") & ~kind.isin("video", "image"), F.concat(F.lit("unsupported media_type: "), media_type)),
        F.when((extension != "") & ~known, F.concat(F.lit("unsupported media extension: "), extension)),
        F.when((extension == "") & (mime != "") & ~of_kind, F.concat(F.lit("unsupported mime_type: "), mime_type)),
    ]
    for bound, value, below, message in (
        (policy.least_seconds, seconds, True, "media duration is below the configured minimum"),
        (policy.most_seconds, seconds, False, "media duration exceeds the configured maximum"),
        (policy.least_bytes, size, True, "media size is below the configured minimum"),
        (policy.most_bytes, size, False, "media size exceeds the configured maximum"),
    ):
        if bound is not None:
            found.append(F.when(value < bound if below else value > bound, message))
    if policy.audio_required:
        found.append(F.when(~image & ~F.coalesce(audio, F.lit(True)), "audio track is required by policy"))
    return F.array_compact(F.array(*found))


def route(media_type: Column, audio: Column, errors: Column, policy: Policy) -> Column:
    """Which stages a valid medium goes through (type, keyframes, ocr, caption, detection, speech); null for one with errors. An image is its own
    frame and has no speech; a video has speech unless it is known to have no sound."""
    image = F.lower(F.trim(F.coalesce(media_type, F.lit("")))) == "image"
    speech = ~image & F.lit(policy.speech) & F.coalesce(audio, F.lit(True))
    stages = F.struct(F.when(image, "image").otherwise("video").alias("type"), (~image).alias("keyframes"), F.lit(policy.ocr).alias("ocr"), F.lit(policy.caption).alias("caption"), F.lit(policy.detection).alias("detection"), speech.alias("speech"))
    return F.when(F.size(errors) == 0, stages)


def media_kind(given: Column, video_id: Column) -> Column:
    """The kind of a point; older ones without it are told by whether they belong to a video."""
    own = F.nullif(F.trim(given), F.lit(""))
    return F.coalesce(own, F.when(F.coalesce(F.length(video_id) > 0, F.lit(False)), "video_frame").otherwise("image"))


def citation(score: Column, payload: dict[str, Column]) -> Column:
    """The fields of a hit that are cited, with defaults for what older payloads lack: no score is 0, no text is empty, an empty id is none."""
    given = lambda k: payload.get(k, F.lit(None).cast("string"))
    ids = [F.nullif(given(k).cast("string"), F.lit("")).alias(k) for k in ("video_id", "unit_id", "bucket_name", "frame_object_key")]
    texts = [F.coalesce(given(k).cast("string"), F.lit("")).alias(k) for k in ("caption", "ocr_text")]
    time = given("timestamp_sec").try_cast("double")
    kind = media_kind(given("media_kind").cast("string"), given("video_id").cast("string"))
    return F.struct(F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"), *ids, time.alias("timestamp_sec"), *texts, kind.alias("media_kind"))


def routed_score(question_class: Column, branches: dict[str, Column], classes: dict[str, list[str]]) -> Column:
    """The top score of the branch that answers the class of a question; one of no branch's class asks all and takes the highest there is."""
    every = F.greatest(*branches.values()) if len(branches) > 1 else next(iter(branches.values()))
    out = F.coalesce(every, *branches.values())
    for branch, own in classes.items():
        out = F.when(question_class.isin(*own), branches[branch]).otherwise(out)
    return out


def result_notes(total: Column, skipped: dict[str, Column], errors: Column, years: Column, events: Column) -> Column:
    """What a reader of a result should know: branches that were skipped; of an empty result without errors the filters that may have emptied it; and
    branches that failed (an array of their names). ``skipped``: note by condition."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")
    empty = (F.coalesce(total, F.lit(0)) == 0) & (F.coalesce(F.size(errors), F.lit(0)) <= 0)
    filtered = [F.when(empty & (F.size(a) > 0), F.concat(F.lit(f"nothing in {name} "), joined(a))) for name, a in (("years", years), ("events", events))]
    notes = F.array(*[F.when(c, note) for note, c in skipped.items()], *filtered)
    failed = F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.concat(F.lit("failed: "), e))
    return F.array_compact(F.concat(notes, failed))


def checked_chunks(chunks: DataFrame, created_at: Column) -> DataFrame:
    """Chunks (place, chunk_id, document_id, text, created_at) with why one is rejected, in this order: no chunk_id, one that an earlier place has, no
    document_id, no text. Those that pass have their text trimmed, its digest as content_hash, and a time of creation."""
    id_, doc, body = (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("chunk_id", "document_id", "text"))
    rows = chunks.withColumns({"chunk_id": id_, "document_id": doc, "text": body})
    first = rows.where("chunk_id <> ''").groupBy("chunk_id").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    reason = first_reason(("missing chunk_id", F.col("chunk_id") == ""), ("duplicate chunk_id", F.col("first").isNull()), ("missing document_id", F.col("document_id") == ""), ("empty text", F.col("text") == ""))
    marked = rows.join(first, "place", "left").withColumn("reason", reason).drop("first")
    fine = F.col("reason") == ""
    return marked.withColumns({"content_hash": F.when(fine, F.sha2("text", 256)), "created_at": F.when(fine, F.coalesce("created_at", created_at))})


def registration(objects: DataFrame, known: DataFrame, posts: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Objects (object_key, post) with what a registration does with each: ``created``; ``skipped``, as it is there; or ``missing``, as its post has no
    metadata and that is not allowed. known: object_key; posts: post. A dry run is this table, a run appends its created rows."""
    held = known.select("object_key", F.lit(True).alias("held")).distinct()
    told = posts.select("post", F.lit(True).alias("told")).distinct()
    rows = objects.join(held, "object_key", "left").join(told, "post", "left")
    missing = F.col("told").isNull() & F.lit(not allow_missing)
    return rows.withColumn("outcome", F.when(F.col("held").isNotNull(), "skipped").when(missing, "missing").otherwise("created")).withColumn("without_metadata", F.col("told").isNull()).drop("held", "told")


def registration_report(outcomes: DataFrame) -> DataFrame:
    """found, created, skipped, skipped_missing_metadata, posts (of created objects), missing_metadata (posts)."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.agg(
        F.count("*").alias("found"), of("created").alias("created"), of("skipped").alias("skipped"), of("missing").alias("skipped_missing_metadata"),
        F.count_distinct(F.when(F.col("outcome") == "created", F.col("post"))).alias("posts"), F.count_distinct(F.when(F.col("without_metadata"), F.col("post"))).alias("missing_metadata"),
    )


def registered_rows(frames: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each row that registering frames makes, with its ``kind``: of a frame with a parent in media (media_id, post_id) one of ``media`` and one
    of ``frames``, with the post_id; of any other one that is ``rejected``. Frames stream past their parents, which are held by hash, so frames are
    dealt out once and a task does not sort them."""
    parents = media.select(F.col("media_id").alias("video_media_id"), F.col("post_id"), F.lit(True).alias("parented"))
    met = frames.join(parents.hint("shuffle_hash"), "video_media_id", "left")
    kinds = F.when(F.col("parented"), F.array(F.lit("media"), F.lit("frames"))).otherwise(F.array(F.lit("rejected")))
    return met.withColumn("kind", F.explode(kinds)).drop("parented")


def registered_frames(frames: DataFrame, media: DataFrame) -> dict[str, DataFrame]:
    """The rows that registering frames (video_media_id, bucket_name, object_key, timestamp, frame_index) makes: ``media`` (the frame as a medium of its
    parent's post) and ``frames``; those without a parent in media (media_id, post_id) are ``rejected``. A frame's id follows from where it lies."""
    rows = registered_rows(frames, media)
    of = {k: rows.where(F.col("kind") == k) for k in ("media", "frames", "rejected")}
    id_ = text.point_id(F.concat_ws("/", "bucket_name", "object_key")).alias("media_id")
    return {
        "media": of["media"].select(id_, "post_id", F.lit("frame").alias("media_type"), "bucket_name", "object_key", F.col("video_media_id").alias("parent_media_id")),
        "frames": of["frames"].select(id_, "video_media_id", "timestamp", "frame_index"),
        "rejected": of["rejected"].select(*frames.columns),
    }


def detections(boxes: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """Detections (class_id, confidence, box as an array of numbers) of enough confidence with the label of their class, else its number: confidence with
    four decimals, the box with one. names: class_id, label."""
    sure = boxes.where(F.col("confidence") >= least)
    named = sure.join(names.select("class_id", "label"), "class_id", "left")
    return named.withColumns({"label": F.coalesce("label", F.col("class_id").cast("string")), "confidence": F.round("confidence", 4), "box": F.transform("box", lambda x: F.round(x, 1))})
