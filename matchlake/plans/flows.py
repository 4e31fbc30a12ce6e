"""Queries of tracking, streams and documents beyond the first set: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake import scratch
from matchlake.functions import formats
from matchlake.functions.geometry import jround
from matchlake.operators import docs, events as ev, frames as fr, stats, tracking
from matchlake.plans import oracle as sql, queries as q
from matchlake.plans.profiles import ELEVEN
from matchlake.sources import bodies, fixtures as fx, predictions as pr
from matchlake.streaming import stateful, triggers

#: Parts in which frames arrive: every seventh frame is a part late.
FRAME_PARTS = ("frame_seq < 20 AND frame_seq % 7 <> 0", "frame_seq BETWEEN 20 AND 39 AND frame_seq % 7 <> 0 OR frame_seq < 20 AND frame_seq % 7 = 0", "frame_seq >= 40 OR frame_seq BETWEEN 20 AND 39 AND frame_seq % 7 = 0")
#: Seconds of the epoch at which matches begin; a watermark can't be before the epoch.
KICK_OFF = 1_700_000_000
#: A player of a lane keeps one track, as in the SQL, however long they aren't seen.
LANE_RULES = tracking.Rules(returns=True)
IN_ORDER = ("frame_seq < 20", "frame_seq BETWEEN 20 AND 39", "frame_seq >= 40")


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of ten players a match who run along lanes of their own, at three speeds, seen in ten of eleven frames."""
    e, k, m = F.col("e"), F.col("k"), F.col("match_id")
    each = fx.frames(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).filter((e * 31 + k * 17) % 11 != 0)
    x = 20 + (m * 7 + k * 13) % 200 + F.col("frame_seq") * (k % 3) / 4
    return each.select(
        "match_id", "frame_seq", k.alias("det_ord"), F.lit(2).alias("class_id"), x.alias("x"), (20.0 + k * 34).alias("y"), F.lit(12.0).alias("width"), F.lit(30.0).alias("height"), ((20 + (e * 7 + k * 11) % 70) / 100).alias("confidence"),
    )


def tracked_lanes(spark, sf_dir):
    """The track of each detection, in a batch."""
    return tracking.tracked(tracking.framed(lanes(spark, sf_dir)), LANE_RULES)


def stream_tracked(spark, sf_dir):
    """The same from a stream of frames in three batches, the live tracks kept by match."""
    return stateful.run_to_end(tracking.tracked_stream(stateful.in_parts(tracking.framed(lanes(spark, sf_dir)), list(IN_ORDER)), LANE_RULES))


def tracked_players(spark, sf_dir):
    """How many detections and tracks the players' own boxes make in each match, and how long its longest track is."""
    own = tracking.tracked(tracking.framed(fx.detections(spark, sf_dir))).filter("track_no IS NOT NULL").groupBy("match_id", "track_no").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy("match_id").agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("detections"), F.max("n").alias("longest"))


def _timed_changes(spark, sf_dir):
    at = fx.table(spark, sf_dir, "events")
    return q._as_status(at).join(at.select(F.col("event_id").alias("at"), F.col("ts").cast("timestamp").alias("ts")), "at").select("id", "at", "status", "ts")


def stream_watch(spark, sf_dir):
    """Documents that come to completed, and those over twelve hours in processing, from changes of which every seventh is a part late."""
    day, late = F.dayofmonth("ts"), F.col("at") % 7 == 0
    part = F.least(F.lit(2), F.floor((day - 1) / 10) + F.when(late, 1).otherwise(0))
    arriving = stateful.in_parts(_timed_changes(spark, sf_dir), [part == i for i in range(3)], key="id")
    return stateful.run_to_end(stateful.watched(arriving, "completed", "processing", 12 * 3600, "21 days"))


def watch(spark, sf_dir):
    """The same from a table."""
    return stateful.watched_batch(_timed_changes(spark, sf_dir), "completed", "processing", 12 * 3600)


def _balls(spark, sf_dir):
    frames = ev.detected(fr.with_state(q.owned(spark, sf_dir, ELEVEN), ELEVEN), ELEVEN).filter("ball IS NOT NULL")
    return frames.select("match_id", "frame_seq", "owner", "ball.x", "ball.y", "near", F.timestamp_seconds(F.lit(KICK_OFF) + F.col("ts_s")).alias("ts"))


def stream_steps_late(spark, sf_dir):
    """Steps and corners of ball frames that come out of order, held until the watermark has passed them."""
    found = stateful.run_to_end(stateful.held_steps(stateful.in_parts(_balls(spark, sf_dir), list(FRAME_PARTS), key="match_id"), ELEVEN.corner_gap, "150 seconds"))
    return found.filter("step IS NOT NULL").select("match_id", "frame_seq", "prev_owner", jround(F.col("step"), 3).alias("step"), "corner")


def stream_momentum(spark, sf_dir):
    """Momentum of all matches, from a stream of possession changes in windows of event time."""
    state = fr.with_state(q.owned(spark, sf_dir, ELEVEN), ELEVEN)  # changes follow from it alone; no other events are looked for
    changes = state.filter(ev.changed()).select("match_id", "frame_seq", F.col("owner").alias("team_side"), F.timestamp_seconds(F.col("ts_s")).alias("ts"))
    counts = stateful.run_to_end(stateful.minute_counts(stateful.in_parts(changes, list(FRAME_PARTS), key="match_id"), "150 seconds"))
    return stats.momentum_shares(counts.filter("match_id >= 0"), q.durations(spark, sf_dir), ELEVEN)


def _arrivals(spark, sf_dir):
    """Uploads with the batch that they come in: some are told again in the next, and matches get a second file in the last."""
    k = F.col("o_orderkey")
    orders = fx.table(spark, sf_dir, "orders")
    path = F.concat(F.when(k % 7 == 0, "images/").otherwise("videos/"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string"), F.lit("/clip.mp4"))
    own = orders.select(path.alias("path"), F.lit("video/mp4").alias("content_type"), (k * 35_001 % 600_000_000).cast("long").alias("size"), F.timestamp_seconds(1_700_000_000 + k).alias("ts"), (k % 3).alias("part"), "o_orderkey", "o_custkey")
    again = own.filter("o_orderkey % 6 < 2").withColumn("part", F.col("part") + 1)
    second = own.filter("o_orderkey % 4 = 0").withColumn("path", F.concat(F.lit("videos/"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string"), F.lit("/second.mp4"))).withColumn("size", F.lit(7).cast("long")).withColumn("part", F.lit(2).cast("long"))
    return own.unionByName(again).unionByName(second).drop("o_orderkey", "o_custkey")


def stream_uploads(spark, sf_dir):
    """Matches started by uploads that come in three batches, with repeats, second files, and a batch that is run again."""
    arriving, folder = _arrivals(spark, sf_dir), scratch.folder(spark, "uploads")
    handle = stateful.starting(fx.matches(spark, sf_dir), folder)
    stream = stateful.new_uploads(stateful.in_parts(arriving, [F.col("part") == i for i in range(3)]))
    with stateful.rocksdb(spark):
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", scratch.folder(spark, "stream-marks")).trigger(availableNow=True).start().awaitTermination()
    handle(arriving.filter("part = 1"), 1)
    started = spark.read.option("basePath", f"{folder}/started").parquet(f"{folder}/started")
    audit = spark.read.option("basePath", f"{folder}/audit").parquet(f"{folder}/audit").select("id", F.col("detail").alias("audit"))
    return started.join(audit, "id").select("id", "user_id", "video_url", "status", F.col("batch").cast("long").alias("batch"), "audit")


def stream_progress(spark, sf_dir):
    """Frames and events (but for corners) of each batch and the last frame in it, as a stream tells them to a listener."""
    frames = ev.detected(fr.with_state(q.owned(spark, sf_dir, ELEVEN), ELEVEN), ELEVEN).select("match_id", "frame_seq", F.size("found").alias("n_events"))
    arriving = stateful.in_parts(frames, list(IN_ORDER))
    seen = arriving.observe("progress", F.count(F.lit(1)).alias("frames"), F.sum("n_events").alias("events"), F.max("frame_seq").alias("last_frame"))
    return stateful.progress_of(seen, "progress", "batch long, frames long, events long, last_frame long").filter("frames > 0")


def doc_merge(spark, sf_dir):
    """Match documents with changes in which a field may be absent or null: nulls count, absence doesn't."""
    old = fx.matches(spark, sf_dir).select("id", F.parse_json(F.to_json(F.struct("status", "progress", "title"))).alias("doc"))
    n, k = F.col("n"), F.col("l_orderkey")
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    status = F.when(n % 3 == 0, '"status":null').when(n % 3 == 1, '"status":"error"')
    progress, note = F.when(n % 2 == 0, '"progress":null'), F.when(n % 4 == 0, '"note":{"a":1}')
    new = li.select((k + F.when(n > 5, 1_000_000).otherwise(0)).alias("id"), F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", status, progress, note), F.lit("}"))).alias("doc"))
    found = docs.merged(old, new)
    has = lambda name: F.variant_get("doc", f"$.{name}", "variant").isNotNull().alias(f"has_{name}")
    text = lambda name: F.try_variant_get("doc", f"$.{name}", "string").alias(name)
    return found.select("id", text("status"), F.try_variant_get("doc", "$.progress", "bigint").alias("progress"), text("title"), F.try_variant_get("doc", "$.note.a", "bigint").alias("note"), has("status"), has("progress"), has("title"), has("note"))


def doc_created(spark, sf_dir):
    """New documents: how many, whether each has an id of its own, and whether both times are that of the write."""
    made = docs.created(fx.matches(spark, sf_dir).filter("status = 'uploading'").drop("id", "created_at"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if((F.col("created_at") == F.col("updated_at")) & (F.length("id") == 36)).alias("fresh"))


def file_places(spark, sf_dir):
    """The place of each file among all files of all folders, in the order of their paths."""
    return docs.placed(q._files(spark, sf_dir).select("path"), "path")


def match_cascade(spark, sf_dir):
    """What is left of four tables once owners have deleted matches; some requests are by others."""
    k = F.col("o_orderkey")
    orders = fx.table(spark, sf_dir, "orders")
    asked = orders.filter("o_orderkey % 5 = 0").select(k.alias("id"), (F.col("o_custkey") + F.when(k % 15 == 0, 1).otherwise(0)).alias("user_id"))
    audit = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entry"))
    teams = orders.select((F.col("o_custkey") % 100).alias("id"), k.alias("match_id")).distinct()
    left = docs.cascade(fx.matches(spark, sf_dir), asked, q._files(spark, sf_dir), audit, teams)
    rows = lambda kind, key: left[kind].select(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    parts = {"matches": F.col("id"), "files": F.col("path"), "audit": F.col("entry"), "teams": F.concat_ws("-", "id", "match_id")}
    return reduce(DataFrame.unionByName, (rows(kind, key) for kind, key in parts.items()))


def source_bodies(spark, sf_dir):
    """Detections written as bodies in folders of some matches each, and read back by the data source."""
    bodies.register(spark)
    path = scratch.folder(spark, "bodies")
    p = F.struct("x", "y", "width", "height", "class_id", "confidence")
    frames = fx.detections(spark, sf_dir).groupBy("match_id", "frame_seq").agg(F.array_sort(F.collect_list(F.struct("det_ord", p.alias("p")))).alias("ps"))
    bodies.written(frames.select("match_id", "frame_seq", F.transform("ps", lambda x: x["p"]).alias("predictions")), path)
    found = spark.read.format("prediction_bodies").load(path)
    return found.select("match_id", "frame_seq", "det_ord", "class_id", jround(F.col("x"), 3).alias("x"), jround(F.col("y"), 3).alias("y"), jround(F.col("confidence"), 3).alias("confidence"))


def source_audit(spark, sf_dir):
    """Audit rows of two batches, one of them written twice, appended by the data source and read back."""
    bodies.register(spark)
    path = scratch.folder(spark, "audit-log")
    for to in ("completed", "error", "completed"):
        rows = docs.transitions(q._status_changes(spark, sf_dir), to).select("id", "at", F.lit(f"match_{to}").alias("action"))
        rows.write.format("audit_log").option("batch", to).mode("append").save(path)
    return spark.read.format("audit_log").load(path)


def timed_seeks(spark, sf_dir):
    """Frames got by eight seeks a match, some of which take too long; some durations are not known."""
    m = F.col("match_id")
    known = q.durations(spark, sf_dir).withColumn("duration", F.when(m % 9 == 0, 0.0).when(m % 9 == 1, float("inf")).when(m % 9 == 2, None).otherwise(F.col("duration")))
    seeks = pr.even_seeks(pr.likely_durations(known), 8).withColumn("took_s", F.when((m + F.col("i")) % 11 != 0, (m * 7 + F.col("i") * 13) % 31 / 8))
    return pr.seeks_within(seeks).select("match_id", "i", jround(F.col("ts_s"), 6).alias("ts_s"), "passed_s")


def upload_errors(spark, sf_dir):
    """Matches whose upload is too large; a third of the files are no videos."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("videos/"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string"), F.when(k % 3 == 0, "/clip.mov").otherwise("/clip.mp4"))
    files = fx.table(spark, sf_dir, "orders").select(path.alias("path"), F.lit("application/octet-stream").alias("content_type"), (k * 350_003 % 700_000_000).cast("long").alias("size"))
    return triggers.refused_uploads(files, fx.matches(spark, sf_dir))


def upload_links(spark, sf_dir):
    """The files that arrive, and until when the link to each is good."""
    return _arrivals(spark, sf_dir).select("path", "part", formats.link_until(F.col("ts")).alias("until_ms"))


QUERIES = {f.__name__: f for f in (tracked_lanes, stream_tracked, tracked_players, stream_watch, watch, stream_steps_late, stream_momentum, stream_uploads, stream_progress, doc_merge, doc_created, file_places, match_cascade, source_bodies, source_audit, timed_seeks, upload_errors, upload_links)}

_LANES = """lane AS (
    SELECT match_id, frame_seq, k, (20 + (e * 7 + k * 11) % 70) / 100.0::DOUBLE >= 0.5::DOUBLE AS sure FROM fr, range(10) t(k) WHERE (e * 31 + k * 17) % 11 <> 0
), run AS (
    SELECT *, frame_seq - row_number() OVER (PARTITION BY match_id, k ORDER BY frame_seq) AS island FROM lane
), held AS (
    SELECT *, bool_or(sure) OVER (PARTITION BY match_id, k, island ORDER BY frame_seq) AS held FROM run
), born AS (
    SELECT match_id, k, row_number() OVER (PARTITION BY match_id ORDER BY min(frame_seq), k) - 1 AS no FROM held WHERE held GROUP BY match_id, k
)"""
_WATCH = """WITH sc AS (
    SELECT user_id AS id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'uploading' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'processing' END AS status FROM events
), seen AS (
    SELECT *, lag(status) OVER w AS before, lead(ts) OVER w AS until FROM sc WINDOW w AS (PARTITION BY id ORDER BY ts, seq)
)
SELECT id, seq AS at, 'completed' AS kind, before AS was FROM seen WHERE status = 'completed' AND before <> 'completed'
UNION ALL SELECT id, seq, 'stuck', NULL FROM seen WHERE status = 'processing' AND coalesce(epoch_ms(until) - epoch_ms(ts) > 43200000, true)"""
_GONE = "gone AS (SELECT id, user_id FROM m WHERE id % 5 = 0 AND id % 15 <> 0)"

SQL = {
    "tracked_lanes": f"WITH {sql.FRAMES}, {_LANES} SELECT match_id, frame_seq, k AS det_ord, CASE WHEN held THEN no END AS track_no FROM held LEFT JOIN born USING (match_id, k)",
    "watch": _WATCH,
    "stream_watch": _WATCH,
    "stream_steps_late": sql.SQL["stream_steps"],
    "stream_momentum": sql.SQL["momentum_eleven"],
    "stream_uploads": f"""WITH {sql.MATCHES}, orderly AS (
        SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS place, o_orderkey * 35001 % 600000000 <= 524288000 AND o_orderkey % 7 <> 0 AS fits FROM orders
    ), arriving AS (
        SELECT k, 'videos/' || place || '/clip.mp4' AS path, k % 3 AS part FROM orderly WHERE fits
        UNION ALL SELECT k, 'videos/' || place || '/second.mp4', 2 FROM orderly WHERE k % 4 = 0
    ), first AS (
        SELECT m.id, m.user_id, path, part FROM arriving JOIN m ON m.id = k WHERE m.status = 'uploading' QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY part, path) = 1
    ) SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, path AS video_url, 'processing' AS status, CAST(part AS BIGINT) AS batch, path AS audit FROM first""",
    "stream_progress": f"""WITH RECURSIVE {sql.events(ELEVEN)}, per AS (
        SELECT fr.match_id, fr.frame_seq, coalesce(n, 0) AS n FROM fr LEFT JOIN (SELECT match_id, frame_seq, count(*) AS n FROM basic GROUP BY ALL) USING (match_id, frame_seq)
    ) SELECT CAST(least(2, frame_seq // 20) AS BIGINT) AS batch, count(*) AS frames, CAST(sum(n) AS BIGINT) AS events, max(frame_seq) AS last_frame FROM per GROUP BY ALL""",
    "doc_merge": f"""WITH {sql.MATCHES}, ch AS (
        SELECT l_orderkey + CASE WHEN n > 5 THEN 1000000 ELSE 0 END AS id, n FROM (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
    ) SELECT coalesce(m.id, ch.id) AS id, CASE WHEN n % 3 = 1 THEN 'error' WHEN n % 3 = 0 THEN NULL ELSE m.status END AS status, CASE WHEN n % 2 = 0 THEN NULL ELSE m.progress END AS progress, title,
        CASE WHEN n % 4 = 0 THEN 1 END AS note, m.id IS NOT NULL OR coalesce(n % 3 IN (0, 1), false) AS has_status, m.id IS NOT NULL OR coalesce(n % 2 = 0, false) AS has_progress,
        m.id IS NOT NULL AS has_title, coalesce(n % 4 = 0, false) AS has_note FROM m FULL JOIN ch ON m.id = ch.id""",
    "doc_created": f"WITH {sql.MATCHES} SELECT count(*) AS n, count(*) AS ids, count(*) AS fresh FROM m WHERE status = 'uploading'",
    "file_places": f"WITH {sql.FILES} SELECT path, row_number() OVER (ORDER BY path) AS place FROM f",
    "match_cascade": f"""WITH {sql.MATCHES}, {sql.FILES}, {_GONE}
        SELECT 'matches' AS kind, CAST(id AS VARCHAR) AS key FROM m WHERE id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'files', path FROM f WHERE NOT EXISTS (SELECT 1 FROM gone WHERE starts_with(path, 'videos/' || CAST(user_id AS VARCHAR) || '/' || CAST(id AS VARCHAR) || '/'))
        UNION ALL SELECT 'audit', CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'teams', CAST(user_id % 100 AS VARCHAR) || '-' || CAST(id AS VARCHAR) FROM m WHERE id NOT IN (SELECT id FROM gone)""",
}
SQL["timed_seeks"] = f"""WITH d AS (
        SELECT user_id AS match_id, CASE WHEN user_id % 9 IN (0, 1, 2) THEN 300.0::DOUBLE ELSE count(*) * 5.0::DOUBLE END AS duration FROM events GROUP BY user_id
    ), s AS (
        SELECT match_id, i, duration / 9 * i AS ts_s, CASE WHEN (match_id + i) % 11 <> 0 THEN (match_id * 7 + i * 13) % 31 / 8.0::DOUBLE END AS took FROM d, range(1, 9) t(i)
    ), p AS (
        SELECT *, sum(least(coalesce(took, 3.0::DOUBLE), 3.0::DOUBLE)) OVER (PARTITION BY match_id ORDER BY i) AS passed_s FROM s
    ) SELECT match_id, i, {sql.jr("ts_s", 6)} AS ts_s, passed_s FROM p WHERE took < 3 AND passed_s < 20"""
SQL["upload_errors"] = "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'error' AS status, 'Video file exceeds the 500MB limit.' AS error_message FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey * 350003 % 700000000 > 524288000"
SQL["upload_links"] = """WITH own AS (
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'images/' ELSE 'videos/' END AS top, CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS place FROM orders
    ), a AS (
        SELECT k, top || place || '/clip.mp4' AS path, k % 3 AS part FROM own UNION ALL SELECT k, top || place || '/clip.mp4', k % 3 + 1 FROM own WHERE k % 6 < 2
        UNION ALL SELECT k, 'videos/' || place || '/second.mp4', 2 FROM own WHERE k % 4 = 0
    ) SELECT path, part, (1700000000 + k) * 1000 + 3600000 AS until_ms FROM a"""
SQL["source_audit"] = sql.SQL["audit_append"]
SQL["source_bodies"] = f"""WITH {sql.FRAMES} SELECT match_id, frame_seq, row_number() OVER (PARTITION BY match_id, frame_seq ORDER BY det_ord) - 1 AS det_ord, class_id, {sql.jr("x", 3)} AS x, {sql.jr("y", 3)} AS y, {sql.jr("confidence", 3)} AS confidence FROM det"""
SQL["stream_tracked"] = SQL["tracked_lanes"]
