"""The registered queries of the match analytics: (spark, sf_dir) -> DataFrame with flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake import scratch
from matchlake.functions import colour, formats, geometry, rng
from matchlake.functions.geometry import jround
from matchlake.operators import docs, events as ev, frames as fr, report, spatial, stats, teams
from matchlake.plans.profiles import ELEVEN, FIVE, Profile
from matchlake.sources import fixtures as fx, predictions as pr
from matchlake.streaming import triggers

HOME, AWAY = "Reds", "Blues"


def owned(spark: SparkSession, sf_dir: str, p: Profile, team=None) -> DataFrame:
    return fr.owned_frames(fx.beside_ball(spark, sf_dir), p, fx.FRAME_W, fx.FRAME_H, team)


def event_stream(spark: SparkSession, sf_dir: str, p: Profile) -> DataFrame:
    return ev.events(fr.with_state(owned(spark, sf_dir, p), p), p)


def flat_summary(spark: SparkSession, sf_dir: str, p: Profile) -> DataFrame:
    return stats.summary(fr.with_state(owned(spark, sf_dir, p), p), p)


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("match_id")).agg((F.count(F.lit(1)) * F.lit(5.0)).alias("duration"))


def match_summary(spark, sf_dir):
    return flat_summary(spark, sf_dir, ELEVEN)


def match_summary_five(spark, sf_dir):
    return flat_summary(spark, sf_dir, FIVE)


def both(make: Callable[[SparkSession, str, Profile], DataFrame], name: str) -> dict:
    return {f"{name}_{p.name}": lambda spark, sf_dir, p=p: make(spark, sf_dir, p) for p in (FIVE, ELEVEN)}


def possession(spark, sf_dir, p):
    return fr.possession(owned(spark, sf_dir, p), p)


def possession_half(spark, sf_dir):
    return fr.half_possession(fx.detections(spark, sf_dir), fx.FRAME_W)


def ball_presence(spark, sf_dir):
    return fr.ball_frames(fx.detections(spark, sf_dir))


def ball_owner_frames(spark, sf_dir, p):
    return owned(spark, sf_dir, p).filter("owner IS NOT NULL").select("match_id", "frame_seq", "owner")


def half_split_owners(spark, sf_dir):
    """Owners under sides by image half: no side ever owns the ball near the goal that it attacks."""
    return owned(spark, sf_dir, ELEVEN, geometry.half_team(F.col("x"), fx.FRAME_W)).filter("owner IS NOT NULL").groupBy("match_id", "owner").agg(F.count(F.lit(1)).alias("frames"))


def steps(spark, sf_dir, p):
    state = fr.with_state(owned(spark, sf_dir, p), p)
    return state.filter("step IS NOT NULL").select("match_id", "frame_seq", "prev_owner", jround(F.col("step"), 3).alias("step"))


def events(spark, sf_dir, p):
    found = event_stream(spark, sf_dir, p)
    return found.select("match_id", "event_seq", "frame_seq", "ts_s", "type", "team_side", "xg", jround(F.col("x"), 3).alias("x"), jround(F.col("y"), 3).alias("y"), "description")


def events_capped(spark, sf_dir, p):
    return ev.capped(event_stream(spark, sf_dir, p), "event_seq", p.event_cap).select("match_id", "event_seq", "type", "team_side")


def corners(spark, sf_dir, p):
    return event_stream(spark, sf_dir, p).filter("type = 'corner'").select("match_id", "frame_seq", "team_side")


def pass_stats(spark, sf_dir, p):
    return stats.pass_stats(fr.with_state(owned(spark, sf_dir, p), p), p)


def shot_stats(spark, sf_dir, p):
    return stats.event_stats(event_stream(spark, sf_dir, p)).select("match_id", *[f"{s}_{c}" for s in ("home", "away") for c in ("shots", "on_target", "xg")])


def score_discipline(spark, sf_dir, p):
    return stats.event_stats(event_stream(spark, sf_dir, p)).select("match_id", *[f"{s}_{c}" for s in ("home", "away") for c in ("goals", "fouls", "corners")])


def pressure_index(spark, sf_dir, p):
    return stats.pressure(possession(spark, sf_dir, p))


def xg_grid(spark, sf_dir, p):
    """xG of each ball position rounded to metres, for both goals."""
    at = owned(spark, sf_dir, p).filter("ball IS NOT NULL").select(F.floor("ball.x").alias("x"), F.floor("ball.y").alias("y")).distinct()
    value = lambda side: jround(geometry.xg(F.col("x").cast("double"), F.col("y").cast("double"), geometry.goal_x(F.lit(side), p), p), 4).alias(f"{side}_xg")
    return at.select("x", "y", value("home"), value("away"))


def momentum(spark, sf_dir, p):
    return stats.momentum(event_stream(spark, sf_dir, p), durations(spark, sf_dir), p)


def heatmap_hist(spark, sf_dir):
    found = spatial.heat_histogram(spatial.player_points(fx.detections(spark, sf_dir), ELEVEN, fx.FRAME_W, fx.FRAME_H), ELEVEN)
    return found.withColumn("x", jround(F.col("x"), 3)).withColumn("y", jround(F.col("y"), 3))


def heatmap_kde(spark, sf_dir):
    return spatial.heat_density(spatial.player_points(fx.detections(spark, sf_dir), FIVE, fx.FRAME_W, fx.FRAME_H), FIVE)


def raw_heat_points(spark, sf_dir):
    """Each player detection as a heat point, of sides (by image half) with over ten of them."""
    seen = fx.detections(spark, sf_dir).filter(F.col("class_id").isin(*fr.PLAYERS)).withColumn("side", geometry.half_team(F.col("x"), fx.FRAME_W))
    many = seen.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("match_id", "side"))).filter("n > 10")
    return many.select("match_id", "side", "frame_seq", "det_ord", jround(geometry.to_pitch(F.col("x"), fx.FRAME_W, 105.0), 2).alias("x"), jround(geometry.to_pitch(F.col("y"), fx.FRAME_H, 68.0), 2).alias("y"), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))).alias("intensity"))


def voronoi_zones(spark, sf_dir):
    frames = fr.frame_table(fx.detections(spark, sf_dir), FIVE, fx.FRAME_W, fx.FRAME_H)
    return spatial.voronoi(spatial.keyframes(frames, FIVE), FIVE)


def _nodes(spark, sf_dir, p):
    seen = fx.detections(spark, sf_dir)
    if p.owner_rule == "first":  # players go by their tracks: partial sums from the scan, no frames
        return spatial.nodes(spatial.player_points(seen, p, fx.FRAME_W, fx.FRAME_H), p)
    return spatial.nodes(spatial.numbered(spatial.player_points(seen, p, fx.FRAME_W, fx.FRAME_H)), p)


def pass_nodes(spark, sf_dir, p):
    return _nodes(spark, sf_dir, p).filter(F.col("node_seq") <= p.node_cap)


def pass_edges(spark, sf_dir, p):
    return spatial.edges(_nodes(spark, sf_dir, p), p)


def edge_resolve(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, FIVE)
    return spatial.resolved_edges(spatial.edges(nodes, FIVE), nodes.filter(F.col("node_seq") <= FIVE.node_cap))


def network_viz(spark, sf_dir):
    return spatial.network_view(_nodes(spark, sf_dir, ELEVEN), ELEVEN, 840.0, 500.0)


def whole_match(spark, sf_dir) -> DataFrame:
    """The document of each match: statistics, momentum, events, heat points, pass network and narrative."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = fx.beside_ball(spark, sf_dir, tasks)  # hashed by match: whatever is grouped by match finds its rows in place
    frames = ev.with_corners(fr.with_state(fr.owned_frames(seen, ELEVEN, fx.FRAME_W, fx.FRAME_H), ELEVEN), ELEVEN)
    frames = scratch.kept(spark, frames.select("match_id", "frame_seq", "ts_s", "owner", "prev_owner", "step", "found", "taken"), "frames")
    told, found = scratch.kept(spark, stats.summary_of(frames, ELEVEN, goals=True), "summary"), ev.told(frames)
    players = spatial.player_points(seen, ELEVEN, fx.FRAME_W, fx.FRAME_H)
    heat = spatial.heat_histogram(players, ELEVEN).withColumns({c: jround(F.col(c), 3) for c in ("x", "y")})
    nodes = scratch.kept(spark, spatial.nodes(spatial.numbered(players), ELEVEN), "nodes")
    words = report.narrative_eleven(told, F.lit(HOME), F.lit(AWAY))
    found = stats.composed(
        told, momentum=(stats.momentum(found, durations(spark, sf_dir), ELEVEN), "minute"), events=(ev.capped(found, "event_seq", ELEVEN.event_cap), "event_seq"), heat=(heat, "team"),
        nodes=(nodes.filter(F.col("node_seq") <= ELEVEN.node_cap), "node_seq"), edges=(spatial.edges(nodes, ELEVEN), "edge_seq"),
    )
    return found.join(words, "match_id", "left")


def match_document(spark, sf_dir):
    """The documents of all matches, with their arrays as text."""
    text = lambda name, *cols: F.array_join(F.transform(name, lambda s: F.concat_ws(":", *[s[c].cast("string") for c in cols])), ",").alias(name)
    return whole_match(spark, sf_dir).select(
        "match_id", F.col("stats.score.home").alias("home_goals"), F.col("stats.shots.away.xg").alias("away_xg"), F.col("stats.possession.home").alias("home_pct"), F.size("heat").cast("long").alias("n_heat"), "narrative",
        F.array_join(F.transform("momentum", lambda s: F.concat_ws(":", s["minute"].cast("string"), geometry.fixed(s["home"], 1))), ",").alias("momentum"),
        text("events", "event_seq", "frame_seq", "type", "team_side"), text("nodes", "node_seq", "player_id", "involvement"), text("edges", "from_id", "to_id", "count"),
    )


def first_last_goal(spark, sf_dir, p):
    return stats.first_last_goal(event_stream(spark, sf_dir, p))


def stats_table(spark, sf_dir):
    return report.stats_table(match_summary(spark, sf_dir))


def report_table(spark, sf_dir):
    return report.report_table(match_summary(spark, sf_dir))


def scoreboard(spark, sf_dir):
    return report.scoreboard(match_summary(spark, sf_dir))


def charts_long(spark, sf_dir):
    return report.charts(match_summary(spark, sf_dir))


def event_feed(spark, sf_dir):
    return report.event_feed(event_stream(spark, sf_dir, ELEVEN))


def report_key_events(spark, sf_dir):
    return report.key_events(event_stream(spark, sf_dir, ELEVEN))


def _told(spark, sf_dir, p):
    return stats.summary(fr.with_state(owned(spark, sf_dir, p), p), p, goals=True)


def narrative_a(spark, sf_dir):
    return report.narrative_five(_told(spark, sf_dir, FIVE))


def narrative_b(spark, sf_dir):
    return report.narrative_eleven(_told(spark, sf_dir, ELEVEN), F.lit(HOME), F.lit(AWAY))


def narrative_c(spark, sf_dir):
    return report.narrative_browser(_told(spark, sf_dir, ELEVEN), F.lit(HOME), F.lit(AWAY), F.greatest(F.lit(5), F.floor(F.col("frames") * 5 / 60 + F.lit(0.5))).cast("long"))


def narrative_d(spark, sf_dir):
    return report.narrative_long(_told(spark, sf_dir, FIVE))


def match_cards(spark, sf_dir):
    """Cards of a user's matches with the statistics of the match of the same number, where there are any."""
    flat = match_summary(spark, sf_dir).select(F.col("match_id").alias("id"), "home_goals", "away_goals", "home_xg", "away_xg")
    return fx.matches(spark, sf_dir).join(flat, "id").select(
        "id", "title", "status", F.concat(F.col("home_goals").cast("string"), F.lit("–"), F.col("away_goals").cast("string")).alias("score"),
        geometry.fixed(F.col("home_xg"), 1).alias("home_xg"), geometry.fixed(F.col("away_xg"), 1).alias("away_xg"), formats.short_date(F.col("created_at")).alias("day"),
    )


def fmt_timestamp(spark, sf_dir):
    return fx.frames(spark, sf_dir).select("match_id", "frame_seq", formats.clock(F.col("ts_s") + 0.5).alias("clock"))


def fmt_filesize(spark, sf_dir):
    n = (F.col("o_orderkey") * F.col("o_custkey") % 7_000_000).cast("long")
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n_bytes"), formats.file_size(n).alias("text"))


def fmt_eta(spark, sf_dir):
    k = F.col("o_orderkey")
    done, total, took = k % 1000 * 1000, F.lit(1_000_000), (k % 97 + 1).cast("double")
    return fx.table(spark, sf_dir, "orders").select(k.alias("id"), formats.eta(done, total, took).alias("eta"), formats.upload_percent(done, total).alias("percent"))


def est_duration(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_custkey") % 120_000_000
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), formats.likely_duration(n).alias("duration"))


def percent_parse(spark, sf_dir):
    return match_summary(spark, sf_dir).select("match_id", formats.percent_value(F.concat(formats.plain_number(F.col("home_pct")), F.lit("%"))).alias("home_pct"))


def report_dates(spark, sf_dir):
    return fx.matches(spark, sf_dir).select("id", formats.long_date(F.col("created_at")).alias("long_day"), formats.short_date(F.col("created_at")).alias("day"), formats.file_stem(F.col("title")).alias("stem"))


def homography(spark, sf_dir):
    """Detections through a fixed perspective; on 32-bit inputs."""
    h = F.array(*[F.lit(v) for v in (0.05, 0.01, 1.0, 0.002, 0.06, 0.5, 0.0001, 0.0002, 1.0)])
    x, y = geometry.homography(F.col("x"), F.col("y"), h)
    return fx.detections(spark, sf_dir).select("match_id", "frame_seq", "det_ord", jround(x, 3).alias("px"), jround(y, 3).alias("py"))


def half_split_teams(spark, sf_dir):
    return fx.detections(spark, sf_dir).filter(F.col("class_id").isin(*fr.PLAYERS)).groupBy("match_id", geometry.half_team(F.col("x"), fx.FRAME_W).alias("team")).agg(F.count(F.lit(1)).alias("n"))


def box_clip(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    a, b, c, d, there = geometry.clip_box(x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    mx, my = pr.box_centre(x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    return fx.detections(spark, sf_dir).select("match_id", "frame_seq", "det_ord", *[v.cast("long").alias(n) for v, n in ((a, "left"), (b, "top"), (c, "right"), (d, "bottom"))], there.alias("there"), jround(mx, 3).alias("mx"), jround(my, 3).alias("my"))


def top_matches(spark, sf_dir):
    """The 20 newest matches of every user."""
    return docs.latest_of_each(fx.matches(spark, sf_dir)).select("user_id", "at", "id")


def match_counts(spark, sf_dir):
    return fx.matches(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "completed").alias("completed"))


def team_docs(spark, sf_dir):
    return docs.members_added(fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), fx.teams(spark, sf_dir)).select("id", F.size("team_ids").cast("long").alias("n_teams"), F.array_join(F.transform("team_ids", lambda t: t.cast("string")), ",").alias("teams"))


def _changes(spark, sf_dir):
    """Changes of matches, made of line items: the last one of an order counts."""
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    return li.select((F.col("l_orderkey") + F.when(F.col("n") > 5, 1_000_000).otherwise(0)).alias("id"), F.when(F.col("n") % 2 == 0, "completed").alias("status"), F.when(F.col("n") % 3 == 0, F.lit(100)).cast("long").alias("progress"))


def doc_upsert(spark, sf_dir):
    return docs.upsert(fx.matches(spark, sf_dir), _changes(spark, sf_dir), ["status", "progress"])


def doc_update(spark, sf_dir):
    return docs.update(fx.matches(spark, sf_dir).select("id", "user_id", "status", "progress"), _changes(spark, sf_dir), ["status", "progress"])


def doc_insert_absent(spark, sf_dir):
    return docs.insert_absent(fx.matches(spark, sf_dir).select("id", "status"), _changes(spark, sf_dir).select("id", F.coalesce("status", F.lit("uploading")).alias("status")))


def doc_delete(spark, sf_dir):
    gone = fx.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return docs.delete(fx.matches(spark, sf_dir).select("id", "user_id"), gone)


def reprocess_reset(spark, sf_dir):
    asked = fx.matches(spark, sf_dir).filter("id % 2 = 0").select("id", (F.col("user_id") + F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("user_id"))
    k = F.col("id")
    full = fx.matches(spark, sf_dir).withColumn("stats", F.when(F.col("status") == "completed", F.struct((k % 7).alias("home_goals")))).withColumn("error_message", F.when(k % 4 == 0, F.concat(F.lit("failed "), k.cast("string"))))
    return docs.reset(full, asked).select("id", "status", "progress", F.col("stats.home_goals").alias("home_goals"), "error_message")


def _files(spark, sf_dir):
    k = F.col("o_orderkey")
    folder = F.when(k % 7 == 0, "images/").otherwise("videos/")
    path = F.concat(folder, F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string"), F.when(k % 5 == 0, "").otherwise("/clip"), F.when(k % 3 == 0, ".mov").otherwise(".mp4"))
    return fx.table(spark, sf_dir, "orders").select(path.alias("path"), F.when(k % 11 == 0, "video/mp4").otherwise("application/octet-stream").alias("content_type"), (k * 35_001 % 700_000_000).cast("long").alias("size"))


def upload_gate(spark, sf_dir):
    return docs.upload_gate(_files(spark, sf_dir))


def prefix_listing(spark, sf_dir):
    return docs.with_prefix(_files(spark, sf_dir), F.lit("videos/1")).select("path", "size")


def rule_check(spark, sf_dir):
    return docs.rule_checks(fx.teams(spark, sf_dir), fx.users(spark, sf_dir))


def immutable_fields(spark, sf_dir):
    after = fx.users(spark, sf_dir).withColumn("email", F.when(F.col("id") % 9 == 0, F.upper("email")).otherwise(F.col("email")))
    return docs.unchanged(fx.users(spark, sf_dir), after, ["email", "role"])


def user_check(spark, sf_dir):
    users = fx.users(spark, sf_dir).withColumn("teams", F.when(F.col("id") % 6 != 0, F.array(F.col("id")))).withColumn("preferences", F.lit("{}"))
    return docs.user_checks(users)


def write_rules(spark, sf_dir):
    """Writes made of orders: a third each creates, changes and deletes, some by others or with another status."""
    k = F.col("o_orderkey")
    op = F.when(k % 3 == 0, "create").when(k % 3 == 1, "update").otherwise("delete")
    status = F.when((op == "create") | (k % 5 == 0), "uploading").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("uploading")
    asker = F.col("o_custkey") + F.when(k % 7 == 0, 1).otherwise(0)
    writes = fx.table(spark, sf_dir, "orders").select((k + F.when(op == "create", 10_000_000).otherwise(0)).alias("id"), asker.alias("asker"), op.alias("op"), F.col("o_custkey").alias("user_id"), status.alias("status"))
    return docs.write_checks(fx.matches(spark, sf_dir), writes)


def match_by_id(spark, sf_dir):
    return docs.by_id(fx.matches(spark, sf_dir), 1).select("id", "user_id", "title", "status")


def teams_of_user(spark, sf_dir):
    return docs.of_user(fx.teams(spark, sf_dir), 3).select("id", "user_id", "name", F.size("players").cast("long").alias("n_players"))


def matches_of_all(spark, sf_dir):
    return docs.of_user(fx.matches(spark, sf_dir)).select("id", "user_id", "status")


def matches_of_user(spark, sf_dir):
    return docs.latest(fx.matches(spark, sf_dir), 4).select("id", "title")


def publish_stats(spark, sf_dir):
    """Statistics of matches written with their documents in one job, and read back."""
    path = scratch.folder(spark, "published")
    docs.published(fx.matches(spark, sf_dir), stats.nested(match_summary(spark, sf_dir)), path)
    return spark.read.parquet(path).select("id", "status", "progress", F.col("stats.score.home").alias("home_goals"), F.col("stats.shots.away.xg").alias("away_xg"))


def audit_append(spark, sf_dir):
    """Two batches of audit rows appended to one log, and read back."""
    path = scratch.folder(spark, "audit")
    for to in ("completed", "error"):
        docs.append(docs.transitions(_status_changes(spark, sf_dir), to).select("id", "at", F.lit(f"match_{to}").alias("action")), path)
    return spark.read.parquet(path)


def team_removal(spark, sf_dir):
    """Owners without the smallest of their teams."""
    owners = docs.members_added(fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), fx.teams(spark, sf_dir))
    left = docs.member_removed(owners, F.array_min("team_ids"))
    return left.select("id", F.coalesce(F.array_join(F.transform("team_ids", lambda t: t.cast("string")), ","), F.lit("")).alias("teams"))


def url_sets(spark, sf_dir):
    """Paths of line items' shipments added to the matches' sets of videos."""
    had = fx.matches(spark, sf_dir).select("id", F.when(F.col("video_url").isNotNull(), F.array(F.lit("videos/TRUCK"))).alias("video_urls"))
    files = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("videos/"), F.when(F.col("l_linenumber") % 3 == 0, "TRUCK").otherwise(F.col("l_returnflag"))).alias("path"))
    return docs.urls_added(had, files).select("id", F.array_join(F.array_sort("video_urls"), ",").alias("urls"))


def request_check(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "  ").when(F.col("o_orderkey") % 6 == 1, None).otherwise(F.col("o_orderkey").cast("string")).alias("match_id"))
    return docs.valid_requests(asked)


def progress_stages(spark, sf_dir):
    return fx.frames(spark, sf_dir).select("match_id", "frame_seq", docs.loop_progress(F.col("frame_idx"), F.lit(30.0)).alias("loop"), docs.frame_progress(F.col("frame_seq"), F.lit(60)).alias("frame"), docs.stage_index(F.least(F.lit(100), F.col("frame_seq")), 6).alias("stage"))


def probe_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    rate = F.when(k % 4 == 0, "30000/1001").when(k % 4 == 1, "25/1").when(k % 4 == 2, "24/0").otherwise(None)
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("string").alias("r_frame_rate"), F.lit("9.5").alias("duration"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))
    video = F.struct(F.lit("video").alias("codec_type"), rate.alias("r_frame_rate"), (k % 5400).cast("string").alias("duration"), F.when(k % 2 == 0, 1280).cast("long").alias("width"), F.when(k % 2 == 0, 720).cast("long").alias("height"))
    body = F.to_json(F.struct(F.when(k % 9 == 0, F.array(audio)).otherwise(F.array(audio, video)).alias("streams")))
    return pr.probed(fx.table(spark, sf_dir, "orders").select(k.alias("id"), body.alias("body"))).withColumn("fps", jround(F.col("fps"), 3))


def pred_explode(spark, sf_dir):
    """Detections written as prediction bodies of frames and read back; frames of sign-ups have a null body."""
    d = F.struct("x", "y", "width", "height", F.lit("player").alias("class"), "class_id", "confidence", "det_ord")
    bodies = fx.detections(spark, sf_dir).groupBy("match_id", "frame_seq").agg(F.array_sort(F.collect_list(F.struct("det_ord", d.alias("d")))).alias("ds"), F.min("det_ord").alias("least"))
    body = F.when(F.col("least") == 0, F.to_json(F.struct(F.transform("ds", lambda s: s["d"]).alias("predictions"))))
    found = pr.exploded(bodies.select("match_id", "frame_seq", body.alias("body")))
    return found.select("match_id", "frame_seq", "det_ord", "class_id", jround(F.col("x"), 3).alias("x"), jround(F.col("y"), 3).alias("y"))


def sampled_frames(spark, sf_dir):
    frames = fx.frames(spark, sf_dir).withColumn("frame_idx", F.col("frame_seq") + 1).withColumn("ts_s", F.col("frame_seq") * 2.5)
    return pr.every_nth(frames).select("match_id", "frame_seq").withColumn("sampler", F.lit("nth")).unionByName(pr.first_by_time(frames).select("match_id", "frame_seq").withColumn("sampler", F.lit("time")))


def even_seeks(spark, sf_dir):
    return pr.even_seeks(durations(spark, sf_dir)).withColumn("ts_s", jround(F.col("ts_s"), 6))


def _as_status(e):
    status = F.when(F.col("event_type") == "signup", "uploading").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("processing")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), status.alias("status"))


def _status_changes(spark, sf_dir):
    return _as_status(fx.table(spark, sf_dir, "events"))


def status_transitions(spark, sf_dir):
    return docs.transitions(_status_changes(spark, sf_dir), "completed").select("id", "at", "was")


def notifications(spark, sf_dir):
    done = docs.transitions(_status_changes(spark, sf_dir), "completed").select(F.col("id").alias("user_id"), "at")
    return docs.notified(done, fx.users(spark, sf_dir)).select("user_id", "at", "fcm_token")


def stream_transitions(spark, sf_dir):
    """The transitions, from a stream of the events' files with the last status as state."""
    schema = fx.table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return triggers.drained(triggers.transitions(_as_status(arriving), "completed"))


def upload_starts(spark, sf_dir):
    """Uploads that start the processing of a match: the stream's transformation on a table."""
    return triggers.accepted_uploads(_files(spark, sf_dir), fx.matches(spark, sf_dir))


def live_status(spark, sf_dir):
    return triggers.live_documents(_status_changes(spark, sf_dir))


def stream_live_status(spark, sf_dir):
    """The last state of each document, from a stream of the events' files in update mode."""
    schema = fx.table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return triggers.drained_updates(triggers.live_documents(_as_status(arriving)), "id")


def stream_steps(spark, sf_dir):
    """Steps and corners of ball frames that arrive in two parts, with the state before each kept by match."""
    frames = ev.detected(fr.with_state(owned(spark, sf_dir, ELEVEN), ELEVEN), ELEVEN).filter("ball IS NOT NULL")
    balls = frames.select("match_id", "frame_seq", "owner", "ball.x", "ball.y", "near")
    path = scratch.folder(spark, "frames")
    parts = (F.col("frame_seq") < 20, F.col("frame_seq") >= 20)
    for part in parts:
        balls.filter(part).coalesce(8).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(balls.schema).option("maxFilesPerTrigger", 8).parquet(path)
    found = triggers.drained(triggers.frame_states(arriving, ELEVEN.corner_gap))
    return found.filter("step IS NOT NULL").select("match_id", "frame_seq", "prev_owner", jround(F.col("step"), 3).alias("step"), "corner")


def last_n_crops(spark, sf_dir):
    crops = fx.detections(spark, sf_dir).filter(F.col("class_id").isin(*fr.PLAYERS)).select("match_id", "track_id", (F.col("frame_seq") * 100 + F.col("det_ord")).alias("seq"))
    return teams.last_crops(crops)


def str_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), rng.string_seed(F.col("c_name")).alias("seed"))


def xorshift(spark, sf_dir):
    drawn = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(rng.draws(F.col("c_custkey"), 5)).alias("n", "value"))
    return drawn.select("id", F.col("n").cast("long").alias("n"), jround(F.col("value"), 9).alias("value"))


def jersey_kmeans(spark, sf_dir):
    """Sides by clusters of jersey features; each label stands for a track."""
    crops = fx.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("long").alias("match_id"), F.col("label").cast("long").alias("track_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("feature"))
    return teams.jersey_clusters(crops)


def jersey_features(spark, sf_dir):
    """Mean colours of the upper halves of crops; the crops' bytes are made of embeddings, five pixels across."""
    pixels = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int"))
    crops = fx.table(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("pixels"))
    found = crops.select("vec_id", colour.mean_hsv(F.col("pixels"), F.lit(5), F.floor(F.size("pixels") / 15)).alias("f"))
    return found.select("vec_id", *[jround(F.col("f")[i], 4).alias(n) for i, n in enumerate(("hue", "saturation", "value"))])


def file_order(spark, sf_dir):
    """Files of each folder in the order of their names."""
    files = _files(spark, sf_dir).withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
    return files.select("folder", "path", F.row_number().over(Window.partitionBy("folder").orderBy("path")).cast("long").alias("place"))


def track_sides(spark, sf_dir):
    """Players with the side that their track was given; tracks without one are home."""
    players = fx.detections(spark, sf_dir).filter(F.col("class_id").isin(*fr.PLAYERS)).select("match_id", "track_id")
    labels = players.filter("track_id % 3 <> 0").select("match_id", "track_id").distinct().withColumn("label", F.when(F.col("track_id") % 2 == 0, "home").otherwise("away"))
    return teams.side_of(players, labels).groupBy("match_id", "team_side").agg(F.count(F.lit(1)).alias("n"))


def edge_viz(spark, sf_dir):
    """Edges as they are drawn: the more passes, the wider."""
    return pass_edges(spark, sf_dir, ELEVEN).select("match_id", "edge_seq", F.greatest(F.lit(1.0), F.col("count") / 5).alias("width"), jround(F.col("accuracy") * 100, 0).alias("percent"))


def heat_viz(spark, sf_dir):
    """Heat points as they are drawn."""
    return heatmap_hist(spark, sf_dir).select("match_id", "team", "x", "y", jround(F.col("intensity") * 20, 3).alias("radius"), jround(F.col("intensity") * F.lit(0.35), 4).alias("opacity"))


SINGLE = (
    match_summary, match_summary_five, match_document, possession_half, ball_presence, half_split_owners, heatmap_hist, heatmap_kde, raw_heat_points, voronoi_zones, edge_resolve, network_viz,
    stats_table, report_table, scoreboard, charts_long, event_feed, report_key_events, narrative_a, narrative_b, narrative_c, narrative_d, match_cards,
    fmt_timestamp, fmt_filesize, fmt_eta, est_duration, percent_parse, report_dates, homography, half_split_teams, box_clip, top_matches, match_counts, team_docs,
    doc_upsert, doc_update, doc_insert_absent, doc_delete, reprocess_reset, upload_gate, prefix_listing, rule_check, immutable_fields, request_check, progress_stages,
    probe_parse, pred_explode, sampled_frames, even_seeks, status_transitions, stream_transitions, upload_starts, live_status, notifications, last_n_crops, str_hash, xorshift, jersey_kmeans, jersey_features, user_check, write_rules, match_by_id, teams_of_user, matches_of_all, matches_of_user, publish_stats, audit_append, team_removal, url_sets, stream_live_status, stream_steps, file_order, track_sides, edge_viz, heat_viz,
)
PAIRED = (possession, ball_owner_frames, steps, events, events_capped, corners, pass_stats, shot_stats, score_discipline, pressure_index, xg_grid, momentum, pass_nodes, pass_edges, first_last_goal)
QUERIES = {f.__name__: f for f in SINGLE}
for _f in PAIRED:
    QUERIES |= both(_f, _f.__name__)
