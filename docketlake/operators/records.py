"""Recordings, pages, photos, filings and video frames."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.scan import before, chained, following
from docketlake.functions.scratch import Steps
from docketlake.operators.text import KEY_MOMENTS, STOP_WORDS

# Names of programs that edit images.
EDITORS = ["photoshop", "gimp", "lightroom", "snapseed", "vsco", "afterlight", "pixelmator", "affinity", "capture one", "darktable", "rawtherapee", "adobe", "paint.net", "corel", "acdsee"]

#: The id of the segment before a recording's first one.
NOWHERE = -(2**62)


def label_speakers(segments: DataFrame, turns: DataFrame, bucket: float = 30.0, unknown: str | None = None) -> DataFrame:
    """Each segment (rec_id, id, start_s, end_s) with the speaker of the turn (rec_id, pos, start_s, end_s,
    speaker) that overlaps it most; ties go to the first turn. Both sides are spread over time buckets, so
    the join is on equal keys; a long recording is many keys."""
    def spread(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor(F.col("end_s") / bucket))))

    t = spread(turns.select("rec_id", F.col("start_s"), F.col("end_s"), "pos", "speaker"), "_b").select("rec_id", "_b", F.col("start_s").alias("ts"), F.col("end_s").alias("te"), "pos", F.col("speaker").alias("who"))
    hits = spread(segments.select("rec_id", "id", "start_s", "end_s"), "_b").join(t, ["rec_id", "_b"]).filter("ts < end_s and te > start_s")
    overlap = F.least("te", "end_s") - F.greatest("ts", "start_s")
    best = hits.groupBy("rec_id", "id").agg(F.max(F.struct(overlap.alias("o"), (-F.col("pos")).alias("p"), F.col("who"))).alias("m")).select("rec_id", "id", F.col("m.who").alias("speaker"))
    out = segments.join(best, ["rec_id", "id"], "left")
    return out if unknown is None else out.fillna({"speaker": unknown})


def speaker_stats(labelled: DataFrame) -> DataFrame:
    """Milliseconds, segments, words and share of time (per mille) per recording and speaker."""
    ms = F.floor((F.col("end_s") - F.col("start_s")) * 1000 + 0.5).cast("long")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    by = labelled.groupBy("rec_id", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker")).agg(F.sum(ms).alias("ms"), F.count(F.lit(1)).alias("segments"), F.sum(words).alias("words"))
    total = by.groupBy("rec_id").agg(F.sum("ms").alias("_t"))
    return by.join(total, "rec_id").withColumn("share_milli", F.floor(F.col("ms") * 1000 / F.nullif(F.col("_t"), F.lit(0)))).drop("_t")


def key_moments(segments: DataFrame) -> DataFrame:
    """(rec_id, id, type, matched_text): first pattern of each kind that a segment matches."""
    found = []
    for kind, patterns in KEY_MOMENTS.items():
        hit = F.lit(None).cast("string")
        for p in reversed(patterns):
            hit = F.when(F.col("text").rlike(f"(?i){p}"), F.regexp_extract("text", f"(?i){p}", 0)).otherwise(hit)
        found.append(F.struct(F.lit(kind).alias("type"), hit.alias("matched_text")))
    rows = segments.select("rec_id", "id", F.explode(F.array(*found)).alias("m"))
    return rows.filter("m.matched_text is not null").select("rec_id", "id", "m.type", "m.matched_text")


def topic_windows(segments: DataFrame, least: float = 60.0, terms: int = 5) -> DataFrame:
    """Windows (rec_id, window, start_s, end_s, segments, topic) of at least ``least`` seconds with their most frequent
    words, of equal ones the first.

    A window ends with the first segment that ends ``least`` seconds or more after the window's start, and the next one
    starts there. So each segment has one possible successor as the end of a window, which is looked up by range, and the
    ends are the chain from the first one; a long recording is many tasks. Ends ascend with ``id``, as a
    transcript's do.
    """
    rows = segments.select("rec_id", F.col("id").cast("long").alias("id"), "start_s", "end_s", "text")
    first = rows.groupBy("rec_id").agg(F.min_by("start_s", "id").alias("s"))
    # the way starts at a segment before the first, which "ends" where the first one starts
    reach = rows.select("rec_id", "id", (F.col("end_s") + least).alias("reach")).unionByName(first.select("rec_id", F.lit(NOWHERE).alias("id"), (F.col("s") + least).alias("reach")))
    links = following(rows.select("rec_id", "id", F.col("end_s").alias("v")), ["rec_id"], reach)
    ends = chained(links, first.select("rec_id", F.lit(NOWHERE).alias("id")), ["rec_id"]).filter(F.col("id") != NOWHERE)
    rows = rows.join(ends.withColumn("_end", F.lit(1)), ["rec_id", "id"], "left")
    rows = before(rows, ["rec_id"], ["id"], window=("sum", F.coalesce("_end", F.lit(0)).cast("long")), _from=("last", F.when(F.col("_end") == 1, F.col("end_s"))))
    rows = Steps(segments.sparkSession).keep(rows)
    spans = rows.groupBy("rec_id", "window").agg(F.coalesce(F.max("_from"), F.min_by("start_s", "id")).alias("start_s"), F.max_by("end_s", "id").alias("end_s"), F.count(F.lit(1)).alias("segments"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"), F.lit(0))
    said = rows.select("rec_id", "window", "id", F.posexplode(words).alias("p", "w")).filter(~F.col("w").isin(list(STOP_WORDS)))
    said = said.groupBy("rec_id", "window", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "p")).alias("at"))
    best = said.withColumn("k", F.row_number().over(Window.partitionBy("rec_id", "window").orderBy(F.col("n").desc(), "at"))).filter(F.col("k") <= terms)
    topics = best.groupBy("rec_id", "window").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: F.initcap(x["w"])), ", ").alias("topic"))
    return spans.join(topics, ["rec_id", "window"], "left").select("rec_id", "window", "start_s", "end_s", "segments", F.coalesce("topic", F.lit("General Discussion")).alias("topic"))


def page_layout(segments: DataFrame, lines: int = 25, width: int = 65) -> DataFrame:
    """(rec_id, id, page, line) where each segment starts when texts are set in lines of ``width`` characters: a
    running sum of line counts, which are a matter of each row alone."""

    @F.pandas_udf("bigint")
    def height(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(1, len(textwrap.wrap(t or "", width)))).astype("int64")

    rows = before(segments.select("rec_id", "id", height("text").alias("n")), ["rec_id"], ["id"], at=("sum", F.col("n")))
    return rows.select("rec_id", "id", (F.floor(F.col("at") / lines) + 1).cast("long").alias("page"), (F.col("at") % lines + 1).cast("long").alias("line"))


def shown_speaker(labelled: DataFrame) -> DataFrame:
    """``shown``: the speaker where it changes, else empty."""
    w = Window.partitionBy("rec_id").orderBy("id")
    s = F.coalesce("speaker", F.lit("UNKNOWN"))
    return labelled.withColumn("shown", F.when(F.lag(s).over(w).eqNullSafe(s), "").otherwise(s))


def model_for(seconds: Column) -> Column:
    return F.when(seconds < 1800, "medium").otherwise("small")


def timecode(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat_ws(":", F.lpad((s / 3600).cast("long").cast("string"), 2, "0"), F.lpad(F.floor((s % 3600) / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def merge_windows(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merged overlapping or touching intervals per key."""
    w = Window.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_n", F.when(F.col(start) <= far, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w))
    return rows.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def new_frames(frames: DataFrame, existing: DataFrame, within: int = 100) -> DataFrame:
    """Frames (video_id, ts_ms) farther than ``within`` ms from any existing one: a band anti-join on buckets, shuffled, as a plan's
    estimate does not see how many frames a video comes to and would have them all broadcast."""
    wide = 10 * within  # most frames fall into one bucket, those near an end of it into two
    at = lambda x: F.floor(x / wide)
    e = existing.select("video_id", F.col("ts_ms").alias("e_ms"), F.explode(F.sequence(at(F.col("ts_ms") - within), at(F.col("ts_ms") + within))).alias("_b"))
    f = frames.withColumn("_b", at(F.col("ts_ms")))
    near = (f["video_id"] == e["video_id"]) & (f["_b"] == e["_b"]) & (F.abs(f["ts_ms"] - e["e_ms"]) < within)
    return f.join(e.hint("merge"), near, "left_anti").drop("_b")


def spaced_frames(frames: DataFrame, within: int = 100) -> DataFrame:
    """Of ``frames`` (video_id, frame_id, ts_ms) those that a pass in order of time keeps: the first one, and each that is
    ``within`` ms or more after the last one kept; of equal times the smallest frame_id."""
    rows = frames.select("video_id", F.col("frame_id").cast("long").alias("id"), F.col("ts_ms").alias("v"))
    links = following(rows, ["video_id"], rows.select("video_id", "id", (F.col("v") + within).alias("reach")))
    first = rows.groupBy("video_id").agg(F.min(F.struct("v", "id")).alias("m")).select("video_id", F.col("m.id").alias("id"))
    kept = chained(links, first, ["video_id"]).select("video_id", F.col("id").alias("frame_id"))
    return frames.join(kept, ["video_id", "frame_id"], "left_semi")


def plan_frames(videos: DataFrame, step_ms: int = 5000) -> DataFrame:
    """(video_id, ts_ms) of a coarse pass over videos (video_id, length_ms)."""
    return videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length_ms"), F.lit(step_ms).cast("long"))).alias("ts_ms"))


def plan_dense(videos: DataFrame, scenes: DataFrame, step_ms: int = 500, around_ms: int = 3000) -> DataFrame:
    """(video_id, ts_ms): closer frames within ``around_ms`` of scene changes (video_id, ts_ms). Windows that
    overlap or touch are one, kept inside the video."""
    w = scenes.join(videos, "video_id").select("video_id", F.greatest(F.lit(0).cast("long"), F.col("ts_ms") - around_ms).alias("s"), F.least("length_ms", F.col("ts_ms") + around_ms).alias("e")).filter("s <= e")
    return merge_windows(w, "video_id", "s", "e").select("video_id", F.explode(F.sequence("s", "e", F.lit(step_ms).cast("long"))).alias("ts_ms"))


def plan_offset(videos: DataFrame, step_ms: int = 5000, chapter_ms: int = 600_000) -> DataFrame:
    """(video_id, ts_ms): frames half a step off the coarse ones, counted anew in each chapter."""
    half = step_ms // 2
    c = videos.select("video_id", "length_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length_ms"), F.lit(chapter_ms).cast("long"))).alias("_c"))
    ends = F.least(F.col("_c") + chapter_ms, "length_ms") - 1
    return c.filter(F.col("_c") + half <= ends).select("video_id", F.explode(F.sequence(F.col("_c") + half, ends, F.lit(step_ms).cast("long"))).alias("ts_ms"))


def plan_passes(videos: DataFrame, scenes: DataFrame, most: int = 2000, within: int = 100) -> DataFrame:
    """(video_id, ts_ms, pass) of the coarse, dense and offset passes: a later pass leaves out frames within
    ``within`` ms of an earlier one's, and a video has at most ``most`` frames, in order of pass and time: the
    reader's own limit of frames, a parameter."""
    coarse = plan_frames(videos)
    dense = new_frames(plan_dense(videos, scenes), coarse, within + 1)
    both = coarse.unionByName(dense)
    offset = new_frames(plan_offset(videos), both, within + 1)
    names = ["coarse", "dense", "offset"]
    rows = [p.select("video_id", "ts_ms", F.lit(i).alias("_p")) for i, p in enumerate((coarse, dense, offset))]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2])
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("_p", "ts_ms"))
    rows = rows.withColumn("_k", place).filter(F.col("_k") <= most)
    return rows.select("video_id", "ts_ms", F.element_at(F.array(*map(F.lit, names)), F.col("_p") + 1).alias("pass"))


def chapters(frames: DataFrame, length_ms: int = 600_000) -> DataFrame:
    return frames.groupBy("video_id", (F.floor(F.col("ts_ms") / length_ms) + 1).alias("chapter")).agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("pass") == "click", 1)).alias("scene_changes"))


def confidence_report(pages: DataFrame) -> DataFrame:
    """Mean of a document's pages (per mille, rounded down) and the notes it earns."""
    d = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.floor(F.sum("confidence_milli") / F.count(F.lit(1))).cast("long").alias("mean_milli"), F.count(F.when(F.col("confidence_milli") < 500, 1)).alias("very_low"), F.count(F.when(F.col("confidence_milli").between(500, 699), 1)).alias("low"))
    return d.withColumn("listed", F.col("mean_milli") < 850)


def corpus_confidence(pages: DataFrame) -> DataFrame:
    """Documents, pages, mean of the documents' means (in millionths, rounded down), and documents to report."""
    d = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.floor(F.sum("confidence_milli") * 1000 / F.count(F.lit(1))).cast("long").alias("m"))
    return d.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.floor(F.sum("m") / F.count(F.lit(1))).cast("long").alias("mean_micro"), F.count(F.when(F.col("m") < 850_000, 1)).alias("to_report"))


def decimal_degrees(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """In millionths of a degree, south and west negative."""
    x = F.floor((deg + minutes / 60 + seconds / 3600) * 1000000 + 0.5).cast("long")
    return F.when(ref.isin("S", "W"), -x).otherwise(x)


def gps_centre(places: DataFrame) -> DataFrame:
    """Centre of places (lat, lon) for a map, in thousandths of a degree, both axes known."""
    milli = lambda c: F.floor(F.col(c) * 1000).cast("long")
    known = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.agg(*[F.floor(F.sum(milli(c)) / F.count(F.lit(1))).cast("long").alias(f"{c}_milli") for c in ("lat", "lon")])


def tampering(photos: DataFrame) -> DataFrame:
    """``indicators``: reasons to look again at a photo."""
    from docketlake.functions.core import floor_days

    ratio = F.greatest("width", "height") / F.nullif(F.least("width", "height"), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.lower("software").rlike("|".join(re.escape(e) for e in EDITORS)), "editing software"),
        F.when(F.abs(floor_days(F.col("exif_date"), F.col("mtime"))) > 365, "date mismatch"),
        F.when((F.col("format") == "JPEG") & F.col("camera").isNull(), "no camera"),
        F.when(ratio > 4, "aspect ratio")))
    return photos.withColumn("indicators", reasons).filter(F.size("indicators") > 0)


def dated_first(photos: DataFrame) -> DataFrame:
    """(photo_id, place): photos (photo_id, exif_date) in order of date, undated last; by a range sort and
    offsets per range, so that no task holds all photos."""
    steps = Steps(photos.sparkSession)
    order = [F.col("exif_date").asc_nulls_last(), F.col("photo_id").asc()]
    rows = photos.select("photo_id", "exif_date").repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the range above 33 bits, the row within it below
    rows = steps.keep(rows.select("photo_id", at.alias("_at")).select("photo_id", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_k")))
    per = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(per), "_range").select("photo_id", (F.col("_base") + F.col("_k") + 1).alias("place"))


def filings(rows: DataFrame, forms: list[str], years: int, as_of: Column) -> DataFrame:
    return rows.filter(F.col("form_type").isin(forms) & (F.col("filing_date") >= F.date_sub(as_of, 365 * years)))


def events_by_document(events: DataFrame) -> DataFrame:
    """Events and days with events per document (document, day)."""
    return events.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"))


def filled(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    """Tags of one reader with the gaps filled by another: (key, tags map<string,string>) of both, the first
    one's values where both have a tag."""
    b = second.select(key, F.col("tags").alias("_t"))
    none = F.expr("map()").cast("map<string,string>")
    own = F.map_filter(F.coalesce("tags", none), lambda k, v: v.isNotNull())
    rest = F.map_filter(F.coalesce("_t", none), lambda k, v: ~F.map_contains_key(own, k))
    return first.join(b, key, "full").select(key, F.map_concat(own, rest).alias("tags"))


def transcript_lines(lines: DataFrame) -> DataFrame:
    """Segments from numbered text lines (rec_id, line, text): ``[HH:MM:SS] Speaker: words``; lines without a
    time go to the segment before."""
    start = F.col("text").rlike(r"^\s*\[\d{1,2}:\d{2}:\d{2}")
    w = Window.partitionBy("rec_id").orderBy("line")
    rows = lines.withColumn("_s", F.sum(start.cast("int")).over(w)).filter("_s > 0")
    body = F.regexp_replace("text", r"^\s*\[[^\]]*\]\s*", "")
    rows = rows.select("rec_id", F.col("_s").alias("id"), "line", F.when(start, F.regexp_extract("text", r"\[(\d{1,2}:\d{2}:\d{2})", 1)).alias("at"), F.when(start, F.regexp_extract(body, r"^([A-Za-z][\w .'-]{0,40}):\s", 1)).alias("who"), F.when(start, F.regexp_replace(body, r"^[A-Za-z][\w .'-]{0,40}:\s+", "")).otherwise(body).alias("t"))
    return rows.groupBy("rec_id", "id").agg(F.max("at").alias("at"), F.nullif(F.max("who"), F.lit("")).alias("speaker"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), " ").alias("text"))


