import re

from pyspark.sql import functions as F

from docketlake.operators import records as R
from docketlake.plans.catalog import query

LAB = """SELECT s.rec_id, s.id, s.start_s, s.end_s, s.text, (SELECT max_by(speaker, (least(t.end_s, s.end_s) - greatest(t.start_s, s.start_s), -t.pos)) FROM :turn t WHERE t.rec_id = s.rec_id AND t.start_s < s.end_s AND t.end_s > s.start_s) AS speaker FROM :segment s"""


@query("jon6_speakers", "segment", "turn", sql=f"SELECT rec_id, id, speaker FROM ({LAB}) l")
def speakers(s, t):
    return R.label_speakers(s, t).select("rec_id", "id", "speaker")


STATS = rf"SELECT rec_id, coalesce(speaker, 'UNKNOWN') AS speaker, sum(CAST(floor((end_s - start_s) * 1000 + 0.5e0) AS BIGINT))::BIGINT AS ms, count(*)::BIGINT AS segments, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words FROM ({LAB}) l GROUP BY 1, 2"


@query("tag1_speaker_stats", "segment", "turn", sql=f"SELECT *, CAST(floor(ms * 1000 / sum(ms) OVER (PARTITION BY rec_id)) AS BIGINT) AS share_milli FROM ({STATS}) q")
def stats(s, t):
    return R.speaker_stats(R.label_speakers(s, t))


@query("win10_shown_speaker", "segment", "turn", sql=f"SELECT rec_id, id, CASE WHEN lag(sp) OVER (PARTITION BY rec_id ORDER BY id) = sp THEN '' ELSE sp END AS shown FROM (SELECT rec_id, id, coalesce(speaker, 'UNKNOWN') AS sp FROM ({LAB}) l) q")
def shown(s, t):
    return R.shown_speaker(R.label_speakers(s, t)).select("rec_id", "id", "shown")


@query("win6_dep1_topics", "segment")
def topics(s):
    return R.topic_windows(s)


@query("win9_page_layout", "segment")
def layout(s):
    return R.page_layout(s)


@query("dep3_model", "segment", sql="SELECT rec_id, CASE WHEN max(end_s) < 1800 THEN 'medium' ELSE 'small' END AS model FROM :segment GROUP BY rec_id")
def model(s):
    return s.groupBy("rec_id").agg(R.model_for(F.max("end_s")).alias("model"))


@query("fmt_timecode", "segment", sql="SELECT rec_id, id, printf('%02d:%02d:%02d', CAST(floor(start_s) AS BIGINT) // 3600, CAST(floor(start_s) AS BIGINT) % 3600 // 60, CAST(floor(start_s) AS BIGINT) % 60) AS at FROM :segment")
def codes(s):
    return s.select("rec_id", "id", R.timecode(F.col("start_s")).alias("at"))


@query("src25_transcript_lines", "segment", sql="SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY id)::BIGINT AS id, printf('%02d:%02d:%02d', CAST(start_s AS BIGINT) // 3600, CAST(start_s AS BIGINT) % 3600 // 60, CAST(start_s AS BIGINT) % 60) AS at, CASE WHEN id % 2 = 0 THEN 'Q' END AS speaker, 'word ' || id || ' and more ' || rec_id AS text FROM :segment")
def lines(s):
    """Transcript text made of the segments: every second line names a speaker, all go on in a line of their own."""
    who = F.when(F.col("id") % 2 == 0, "Q: ").otherwise("")
    head = F.concat(F.lit("["), R.timecode(F.col("start_s")), F.lit("] "), who, F.lit("word "), F.col("id").cast("string"))
    two = s.select("rec_id", (F.col("id") * 2).alias("line"), head.alias("text")).unionByName(s.select("rec_id", (F.col("id") * 2 + 1).alias("line"), F.concat(F.lit("and more "), F.col("rec_id").cast("string")).alias("text")))
    return R.transcript_lines(two).withColumn("id", F.col("id").cast("long"))


@query("oag1_confidence", "ocr_page", sql="SELECT doc_id, count(*)::BIGINT AS pages, CAST(floor(sum(confidence_milli) / count(*)) AS BIGINT) AS mean_milli, count(*) FILTER (WHERE confidence_milli < 500)::BIGINT AS very_low, count(*) FILTER (WHERE confidence_milli BETWEEN 500 AND 699)::BIGINT AS low, floor(sum(confidence_milli) / count(*)) < 850 AS listed FROM :ocr_page GROUP BY doc_id")
def confidence(p):
    return R.confidence_report(p)


@query("pho1_degrees", "photo", sql="SELECT photo_id, CASE WHEN ref IN ('S', 'W') THEN -1 ELSE 1 END * CAST(floor((deg + minutes / 60 + seconds / 3600) * 1000000 + 0.5e0) AS BIGINT) AS micro_degrees FROM :photo")
def degrees(p):
    return p.select("photo_id", R.decimal_degrees(F.col("deg"), F.col("minutes"), F.col("seconds"), F.col("ref")).alias("micro_degrees"))


_ED = "|".join(re.escape(e) for e in R.EDITORS)
TAMPER = rf"""SELECT photo_id, concat_ws('|', CASE WHEN regexp_matches(lower(software), '{_ED}') THEN 'editing software' END, CASE WHEN abs(floor((epoch_us(mtime) - epoch_us(exif_date)) / 86400e6)) > 365 THEN 'date mismatch' END,
CASE WHEN format = 'JPEG' AND camera IS NULL THEN 'no camera' END, CASE WHEN greatest(width, height)::DOUBLE / least(width, height) > 4 THEN 'aspect ratio' END) AS indicators FROM :photo"""


@query("pho2_tampering", "photo", sql=f"SELECT * FROM ({TAMPER}) q WHERE indicators <> ''")
def tampering(p):
    return R.tampering(p).select("photo_id", F.array_join("indicators", "|").alias("indicators"))


@query("pho3_hashes", "photo", sql="SELECT photo_id, md5(content) AS md5, sha256(content) AS sha256 FROM :photo")
def hashes(p):
    return p.select("photo_id", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


@query("pag1_cameras", "photo", sql="SELECT coalesce(camera, 'unknown') AS camera, count(*)::BIGINT AS n, min(exif_date) AS first_date, max(exif_date) AS last_date FROM :photo GROUP BY 1")
def cameras(p):
    return p.groupBy(F.coalesce("camera", F.lit("unknown")).alias("camera")).agg(F.count("*").alias("n"), F.min("exif_date").alias("first_date"), F.max("exif_date").alias("last_date"))


@query("srt2_dated_first", "photo", sql="SELECT photo_id, row_number() OVER (ORDER BY CASE WHEN camera IS NOT NULL THEN exif_date END NULLS LAST, photo_id)::BIGINT AS place FROM :photo")
def dated(p):
    """All photos; those without a camera count as undated."""
    return R.dated_first(p.withColumn("exif_date", F.when(F.col("camera").isNotNull(), F.col("exif_date"))))


@query("viz7_gps_centre", "photo", sql="SELECT CAST(floor(sum(CAST(floor(deg * 1000) AS BIGINT)) / count(*)) AS BIGINT) AS lat_milli, CAST(floor(sum(CAST(floor(minutes * 1000) AS BIGINT) * CASE WHEN ref = 'W' THEN -1 ELSE 1 END) / count(*)) AS BIGINT) AS lon_milli FROM :photo")
def centre(p):
    lon = F.when(F.col("ref") == "W", -F.col("minutes")).otherwise(F.col("minutes"))
    return R.gps_centre(p.select(F.col("deg").alias("lat"), lon.alias("lon")))


@query("flt4_filings", "filing", sql="SELECT accession FROM :filing WHERE form_type IN ('10-K', '8-K') AND filing_date >= DATE '1998-08-02' - 1095")
def filings(f):
    return R.filings(f, ["10-K", "8-K"], 3, F.lit("1998-08-02").cast("date")).select("accession")


@query("rag1_by_form", "filing", sql="SELECT form_type, count(*)::BIGINT AS n FROM :filing GROUP BY 1")
def forms(f):
    return f.groupBy("form_type").agg(F.count("*").alias("n"))


@query("vag1_chapters", "frame", sql="SELECT video_id, ts_ms // 600000 + 1 AS chapter, count(*)::BIGINT AS frames, count(*) FILTER (WHERE pass = 'click')::BIGINT AS scene_changes FROM :frame GROUP BY 1, 2")
def chapters(f):
    return R.chapters(f)


@query("win7_merge_windows", "frame", sql="SELECT video_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT video_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM (SELECT video_id, greatest(0, ts_ms - 9000) AS s, ts_ms + 9000 AS e FROM :frame) a) b) c GROUP BY video_id, g")
def merged(f):
    w = f.select("video_id", F.greatest(F.lit(0).cast("long"), F.col("ts_ms") - 9000).alias("s"), (F.col("ts_ms") + 9000).alias("e"))
    return R.merge_windows(w, "video_id", "s", "e")


@query("jon11_new_frames", "frame", sql="SELECT f.video_id, f.frame_id FROM :frame f WHERE f.pass = 'view' AND NOT EXISTS (SELECT 1 FROM :frame e WHERE e.video_id = f.video_id AND e.pass <> 'view' AND abs(e.ts_ms - f.ts_ms) < 20000)")
def fresh(f):
    return R.new_frames(f.filter("pass = 'view'"), f.filter("pass <> 'view'"), 20000).select("video_id", "frame_id")


@query("jon11_spaced_frames", "frame", sql="WITH RECURSIVE f AS (SELECT video_id, ts_ms, min(frame_id) AS frame_id FROM :frame GROUP BY 1, 2), r AS (SELECT video_id, min(ts_ms) AS ts_ms FROM f GROUP BY 1 UNION ALL SELECT r.video_id, min(f.ts_ms) FROM r JOIN f ON f.video_id = r.video_id AND f.ts_ms >= r.ts_ms + 20000 GROUP BY r.video_id) SELECT video_id, frame_id FROM r JOIN f USING (video_id, ts_ms)")
def spaced(f):
    """Frames that a pass keeps, each 20 seconds or more after the one before."""
    return R.spaced_frames(f, 20000).select("video_id", "frame_id")


@query("vid1_coarse_plan", "frame", sql="SELECT video_id, unnest(range(0, max(ts_ms) + 1, 5000)) AS ts_ms FROM :frame GROUP BY video_id")
def plan(f):
    return R.plan_frames(f.groupBy("video_id").agg(F.max("ts_ms").alias("length_ms")))


@query("oag1_corpus_mean", "ocr_page", sql="SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS pages, CAST(floor(sum(m) / count(*)) AS BIGINT) AS mean_micro, count(*) FILTER (WHERE m < 850000)::BIGINT AS to_report FROM (SELECT count(*) AS n, CAST(floor(sum(confidence_milli) * 1000 / count(*)) AS BIGINT) AS m FROM :ocr_page GROUP BY doc_id) q")
def corpus_mean(p):
    return R.corpus_confidence(p)


_PLAN = """WITH v AS (SELECT video_id, max(ts_ms) AS len FROM :frame GROUP BY 1), co AS (SELECT video_id, unnest(range(0, len + 1, 5000)) AS ts_ms FROM v),
w AS (SELECT video_id, greatest(0, ts_ms - 3000) AS s, least(len, ts_ms + 3000) AS e FROM :frame JOIN v USING (video_id) WHERE pass = 'click'),
m AS (SELECT video_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM w) a) b GROUP BY video_id, g),
de AS (SELECT video_id, ts_ms FROM (SELECT video_id, unnest(range(s, e + 1, 500)) AS ts_ms FROM m) x WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.video_id = x.video_id AND abs(co.ts_ms - x.ts_ms) <= 100)),
cd AS (SELECT * FROM co UNION ALL SELECT * FROM de),
oo AS (SELECT video_id, unnest(range(c + 2500, least(c + 600000, len), 5000)) AS ts_ms FROM (SELECT video_id, len, unnest(range(0, len + 1, 600000)) AS c FROM v) y),
o AS (SELECT video_id, ts_ms FROM oo x WHERE NOT EXISTS (SELECT 1 FROM cd WHERE cd.video_id = x.video_id AND abs(cd.ts_ms - x.ts_ms) <= 100)),
u AS (SELECT *, 0 AS p FROM co UNION ALL SELECT *, 1 FROM de UNION ALL SELECT *, 2 FROM o)
SELECT video_id, ts_ms, CASE p WHEN 0 THEN 'coarse' WHEN 1 THEN 'dense' ELSE 'offset' END AS pass FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY p, ts_ms) AS k FROM u) z WHERE k <= 2000"""


@query("vid1_three_passes", "frame", sql=_PLAN)
def passes(f):
    videos = f.groupBy("video_id").agg(F.max("ts_ms").alias("length_ms"))
    return R.plan_passes(videos, f.filter("pass = 'click'").select("video_id", "ts_ms"))


@query("jon18_filled_tags", "photo", sql="SELECT photo_id, CASE WHEN camera IS NULL THEN 'second' ELSE camera END || '|' || CASE WHEN photo_id % 3 = 0 THEN 'first' ELSE 'second' END AS tags FROM :photo")
def filled(p):
    tags = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*kv.values()))
    first = p.select("photo_id", tags(camera=F.col("camera"), lens=F.when(F.col("photo_id") % 3 == 0, "first")).alias("tags"))
    second = p.select("photo_id", tags(camera=F.lit("second"), lens=F.lit("second")).alias("tags"))
    t = F.col("tags")
    return R.filled(first, second, "photo_id").select("photo_id", F.concat_ws("|", t["camera"], t["lens"]).alias("tags"))
