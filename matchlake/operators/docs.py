"""Documents of matches, users and teams: look-ups, rules and keyed changes as transformations of tables."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake import scratch

STATUSES = ("uploading", "processing", "completed", "error")
#: Roles that a new user may have, and what a user document must hold.
ROLES = ("player", "coach", "club-owner")
USER_KEYS = ("email", "teams", "preferences", "role")
MOST_PLAYERS, MOST_BYTES = 20, 500 * 1024 * 1024


def by_id(docs: DataFrame, key) -> DataFrame:
    return docs.filter(F.col("id") == key)


def of_user(docs: DataFrame, user=None) -> DataFrame:
    """Documents of a user, or all."""
    return docs if user is None else docs.filter(F.col("user_id") == user)


def latest(docs: DataFrame, user, most: int = 20) -> DataFrame:
    """The newest documents of a user; a sort that keeps only as many rows in each task."""
    return of_user(docs, user).orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def latest_of_each(docs: DataFrame, most: int = 20) -> DataFrame:
    return docs.withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))).cast("long")).filter(F.col("at") <= most)


def with_prefix(files: DataFrame, prefix: Column) -> DataFrame:
    return files.filter(F.col("path").startswith(prefix))


def upsert(old: DataFrame, new: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Old rows with the values of new ones where those are given, and new rows that were not there."""
    n = new.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = old.select(key, *columns).join(n, F.col(key) == F.col("new_key"), "full_outer")
    return joined.select(F.coalesce(key, "new_key").alias(key), *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def update(old: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Old rows with the values that changes give; changes to rows that are not there do nothing."""
    n = changes.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in columns])
    keep = [c for c in old.columns if c not in columns]
    return old.join(n, F.col(key) == F.col("new_key"), "left").select(*keep, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def insert_absent(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def created(docs: DataFrame) -> DataFrame:
    """New documents with an id of their own and the time."""
    return docs.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def delete(docs: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(gone.select(key).distinct(), key, "left_anti")


def reset(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Matches asked for by their owner start anew, if they have a video; others stay.

    Status and progress are set, and stats and error_message emptied where docs has them.
    """
    want = asked.select(F.col("id").alias("want_id"), F.col("user_id").alias("want_user")).distinct()
    may = F.col("want_id").isNotNull() & F.col("video_url").isNotNull()
    joined = docs.join(want, (F.col("id") == F.col("want_id")) & (F.col("user_id") == F.col("want_user")), "left")
    anew = {"status": F.lit("processing"), "progress": F.lit(0).cast("long"), "stats": F.lit(None), "error_message": F.lit(None)}
    return joined.withColumns({c: F.when(may, v).otherwise(F.col(c)) for c, v in anew.items() if c in docs.columns}).drop("want_id", "want_user")


def upload_gate(files: DataFrame) -> DataFrame:
    """(path, content_type, size) with the user and match of the path and whether each gate lets it through."""
    parts = F.split("path", "/")
    part = lambda i: F.when(F.size(parts) >= i, F.get(parts, F.lit(i - 1)))
    in_place = F.col("path").startswith("videos/") & (F.size(parts) >= 4)
    kind = (F.col("content_type") == "video/mp4") | F.col("path").endswith(".mp4")
    return files.select(
        "path", "size", part(2).alias("user_part"), part(3).alias("match_part"), in_place.alias("in_place"), kind.alias("is_video"),
        (F.col("size") < MOST_BYTES).alias("rules_size"), (F.col("size") <= MOST_BYTES).alias("trigger_size"), (in_place & kind & (F.col("size") <= MOST_BYTES)).alias("accepted"),
    )


def rule_checks(teams: DataFrame, users: DataFrame) -> DataFrame:
    """Whether team documents keep the rules: an owner who is known, a name, and no more players than allowed."""
    known = users.select(F.col("id").alias("owner_id"), F.col("role").alias("owner_role"))
    out = teams.join(known, F.col("user_id") == F.col("owner_id"), "left")
    return out.select("id", F.col("owner_id").isNotNull().alias("owner_known"), F.coalesce(F.col("owner_role").isin(*ROLES), F.lit(False)).alias("role_allowed"), (F.length(F.trim("name")) > 0).alias("named"), (F.size("players") <= MOST_PLAYERS).alias("roster_fits"))


def unchanged(before: DataFrame, after: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """For each document in both versions, whether each column that clients may not change stayed the same."""
    b = before.select(key, *[F.col(c).alias(f"was_{c}") for c in columns])
    return after.join(b, key).select(key, *[F.col(c).eqNullSafe(F.col(f"was_{c}")).alias(f"{c}_kept") for c in columns])


def user_checks(users: DataFrame) -> DataFrame:
    """Whether user documents hold all required keys and an allowed role; a missing column is a missing key."""
    there = [F.col(c).isNotNull() if c in users.columns else F.lit(False) for c in USER_KEYS]
    whole = there[0]
    for one in there[1:]:
        whole = whole & one
    return users.select("id", whole.alias("complete"), F.coalesce(F.col("role").isin(*ROLES), F.lit(False)).alias("role_allowed"))


def write_checks(docs: DataFrame, writes: DataFrame) -> DataFrame:
    """For each write(id, asker, op, user_id, status) of a client to match documents, whether the rules allow it.

    A client creates matches of its own that are uploading, changes its own without touching owner or status, and
    deletes its own. Creating what is there, or changing what isn't, counts as the other kind of write.
    """
    old = docs.select(F.col("id").alias("old_id"), F.col("user_id").alias("old_user"), F.col("status").alias("old_status"))
    mine, kept = F.col("user_id") == F.col("asker"), F.col("old_user") == F.col("asker")
    there = F.col("old_id").isNotNull()
    allowed = F.when(F.col("op") == "delete", there & kept).when(there, kept & mine & F.col("status").eqNullSafe(F.col("old_status"))).otherwise(mine & (F.col("status") == "uploading"))
    return writes.join(old, F.col("id") == F.col("old_id"), "left").select("id", "asker", "op", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def valid_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("error", F.when(F.length(F.trim(F.coalesce("match_id", F.lit("")))) == 0, "matchId must not be empty"))


def members_added(users: DataFrame, teams: DataFrame) -> DataFrame:
    """Team ids in the documents of their owners: a set, so that adding one twice changes nothing."""
    own = teams.groupBy("user_id").agg(F.array_sort(F.collect_set("id")).alias("team_ids"))
    return users.join(own, users.id == own.user_id, "left").select("id", F.coalesce("team_ids", F.expr("cast(array() AS array<bigint>)")).alias("team_ids"))


def member_removed(users: DataFrame, team: Column) -> DataFrame:
    return users.withColumn("team_ids", F.array_remove("team_ids", team))


def urls_added(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Match documents(id, video_urls) with the paths of files(id, path) added as to a set."""
    new = files.groupBy(F.col("id").alias("file_id")).agg(F.collect_set("path").alias("paths"))
    none = F.array().cast("array<string>")
    joined = docs.join(new, F.col("id") == F.col("file_id"), "left")
    return joined.withColumn("video_urls", F.array_union(F.coalesce("video_urls", none), F.coalesce("paths", none))).drop("file_id", "paths")


def published(docs: DataFrame, results: DataFrame, path: str) -> None:
    """Write documents with the analytics of results(match_id, stats), which complete them, in one job: all or nothing is seen."""
    r = results.select(F.col("match_id").alias("done_id"), F.col("stats").alias("stats"))
    done = F.col("done_id").isNotNull()
    joined = docs.drop("stats").join(r, F.col("id") == F.col("done_id"), "left")
    joined = joined.withColumn("status", F.when(done, "completed").otherwise(F.col("status"))).withColumn("progress", F.when(done, F.lit(100).cast("long")).otherwise(F.col("progress")))
    joined.drop("done_id").write.mode("overwrite").parquet(path)


def stage_index(progress: Column, stages: int) -> Column:
    return F.least(F.lit(stages - 1), F.floor(progress / 100 * stages)).cast("long")


def loop_progress(frame_idx: Column, fps: Column) -> Column:
    return F.least(F.lit(90), 20 + F.floor(70 * (frame_idx / F.greatest(F.lit(1.0), fps * 600)))).cast("long")


def frame_progress(i: Column, n: Column) -> Column:
    return (20 + F.floor(i / n * 65)).cast("long")


def transitions(changes: DataFrame, to: str) -> DataFrame:
    """Changes(id, at, status) by which a document comes to a status that it did not have before."""
    prev = F.lag("status").over(Window.partitionBy("id").orderBy("at"))
    return changes.withColumn("was", prev).filter((F.col("status") == to) & F.col("was").isNotNull() & (F.col("was") != to))


def notified(done: DataFrame, users: DataFrame) -> DataFrame:
    """Finished matches whose owner has a token to send to."""
    who = users.select(F.col("id").alias("owner_id"), "fcm_token")
    return done.join(who, F.col("user_id") == F.col("owner_id"), "left").filter("fcm_token IS NOT NULL")


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, doc) of old and new documents(key, doc VARIANT), the fields of new over those of old.

    A field that new has counts even where it is null, and one that it doesn't have leaves the old one: a VARIANT
    tells the two apart. Documents on one side only stay as they are; fields inside of fields are not merged.
    """
    n = new.select(F.col(key).alias("new_key"), F.expr("CAST(doc AS MAP<STRING, VARIANT>)").alias("fresh"))
    o = old.select(key, F.expr("CAST(doc AS MAP<STRING, VARIANT>)").alias("had"))
    none = F.expr("CAST(map() AS MAP<STRING, VARIANT>)")
    had, fresh = F.coalesce("had", none), F.coalesce("fresh", none)
    left = F.map_filter(had, lambda k, _: ~F.map_contains_key(fresh, k))
    joined = o.join(n, F.col(key) == F.col("new_key"), "full_outer")
    return joined.select(F.coalesce(key, "new_key").alias(key), F.to_variant_object(F.map_concat(left, fresh)).alias("doc"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `place`, counted from 1 over all of them in this order, and no task that sees them all.

    Spark deals rows out by ranges of the order and sorts each range; a row's place is the number of rows in the ranges
    before its own, which are as many numbers as there are partitions, and its place in its range. Ties are in any order.
    """
    spark = rows.sparkSession
    path = scratch.folder(spark, "placed")
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("range_no"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("range_at"))
    ranged.write.parquet(path)  # ranges are drawn from a sample: once written they don't change
    stored = spark.read.schema(ranged.schema).parquet(path)
    sizes = sorted(tuple(r) for r in stored.groupBy("range_no").agg((F.max("range_at") + 1).alias("n")).collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = spark.createDataFrame([(no, start) for (no, _), start in zip(sizes, before)], "range_no long, range_start long")
    return stored.join(F.broadcast(starts), "range_no").withColumn("place", F.col("range_start") + F.col("range_at") + 1).drop("range_no", "range_at", "range_start")


def cascade(matches: DataFrame, asked: DataFrame, files: DataFrame, audit: DataFrame, teams: DataFrame) -> dict[str, DataFrame]:
    """What is left of matches, files, audit and teams once the matches asked(id, user_id) by their owners are gone.

    matches(id, user_id, …), files(path, …) under videos/<owner>/<match>/, audit(match_id, …), teams(id, match_ids, …).
    Requests by others, or for what isn't there, change nothing. All follows from one keyed table of what goes: files
    are met by the owner and match of their path, audit rows by match, and team sets lose these matches only. Teams may
    be given as rows(id, match_id) instead, and stay such: a team of very many matches then is in no task as a whole.
    """
    gone = matches.join(asked.select("id", "user_id").distinct(), ["id", "user_id"], "left_semi").select(F.col("id").alias("gone_id"), F.col("user_id").alias("gone_user"))
    part = lambda i: F.get(F.split("path", "/"), F.lit(i))
    of_file = F.col("path").startswith("videos/") & (F.size(F.split("path", "/")) > 3) & (part(1) == F.col("gone_user").cast("string")) & (part(2) == F.col("gone_id").cast("string"))
    if "match_id" in teams.columns:
        left = teams.join(gone, F.col("match_id") == F.col("gone_id"), "left_anti")
    else:
        member = teams.select("id", F.explode("match_ids").alias("gone_id")).join(gone, "gone_id", "left_semi").groupBy("id").agg(F.collect_list("gone_id").alias("gone_ids"))
        left = teams.join(member, "id", "left").withColumn("match_ids", F.array_except("match_ids", F.coalesce("gone_ids", F.array().cast(teams.schema["match_ids"].dataType)))).drop("gone_ids")
    return {
        "matches": matches.join(gone, F.col("id") == F.col("gone_id"), "left_anti"),
        "files": files.join(gone, of_file, "left_anti"),
        "audit": audit.join(gone, F.col("match_id") == F.col("gone_id"), "left_anti"),
        "teams": left,
    }
