"""Report tables and narratives on the flat summary of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.formats import clock, plain_number
from matchlake.functions.geometry import fixed, jround

#: Icons and labels of event types.
ICONS = {"goal": "⚽", "shot": "🎯", "shot_on_target": "🎯", "foul": "🟨", "corner": "🚩", "possession_change": "↔", "pass": "→", "pressure": "⚡"}
LABELS = {"goal": "Goal", "shot": "Shot", "shot_on_target": "On Target", "foul": "Foul", "corner": "Corner", "possession_change": "Poss. Change", "pass": "Pass", "pressure": "Pressure"}
KEY_EVENTS = ("goal", "shot_on_target", "foul", "corner")
#: (category, label, column, how it is written, lower is better)
METRICS = [
    ("Attack", "Goals", "goals", "int", False), ("Attack", "Shots", "shots", "int", False), ("Attack", "Shots on Target", "on_target", "int", False), ("Attack", "Expected Goals (xG)", "xg", "2", False),
    ("Possession", "Ball Possession", "pct", "%", False), ("Possession", "Pressure Index", "pressure", "1", False),
    ("Passing", "Passes Completed", "completed", "int", False), ("Passing", "Total Passes", "total", "int", False), ("Passing", "Pass Accuracy", "accuracy", "%", False),
    ("Discipline", "Fouls", "fouls", "int", True), ("Discipline", "Corners", "corners", "int", False),
]
REPORT = ["pct", "shots", "on_target", "xg", "completed", "accuracy", "corners", "fouls", "pressure"]
BOARD = ["pct", "shots", "on_target", "corners", "fouls", "xg"]


def _text(column: str, how: str) -> Column:
    c = F.col(column)
    return {"int": c.cast("string"), "2": fixed(c.cast("double"), 2), "1": fixed(c.cast("double"), 1), "%": F.concat(plain_number(c.cast("double")), F.lit("%"))}[how]


def _rows(flat: DataFrame, columns: list[str]) -> DataFrame:
    """Summary rows turned into one row for each metric: at, category, label, texts and values of both sides."""
    known = {m[2]: m for m in METRICS}
    items = []
    for at, name in enumerate(columns):
        category, label, _, how, lower = known[name]
        home, away = f"home_{name}", f"away_{name}"
        items.append(F.struct(F.lit(at).cast("long").alias("at"), F.lit(category).alias("category"), F.lit(label).alias("label"), _text(home, how).alias("home"), _text(away, how).alias("away"), F.col(home).cast("double").alias("home_value"), F.col(away).cast("double").alias("away_value"), F.lit(lower).alias("lower")))
    return flat.select("match_id", F.explode(F.array(*items)).alias("m")).select("match_id", "m.*")


def _bar(home: Column, away: Column) -> Column:
    total = F.when(home + away == 0, 1.0).otherwise(home + away)
    return F.floor(home / total * 100 + F.lit(0.5)).cast("long")


def stats_table(flat: DataFrame) -> DataFrame:
    """Eleven metrics with a bar and the side that wins, if one does; of fouls fewer are better."""
    rows = _rows(flat, [m[2] for m in METRICS])
    h, a = F.col("home_value"), F.col("away_value")
    better = lambda x, y: F.when(F.col("lower"), x < y).otherwise(x > y)
    return rows.select("match_id", "at", "category", "label", "home", "away", _bar(h, a).alias("home_bar"), better(h, a).alias("home_wins"), better(a, h).alias("away_wins"))


def report_table(flat: DataFrame) -> DataFrame:
    """Nine metrics of the printed report: values of fouls change sides, and ties go to the home side."""
    rows = _rows(flat, REPORT).withColumn("h", F.when(F.col("lower"), F.col("away_value")).otherwise(F.col("home_value"))).withColumn("a", F.when(F.col("lower"), F.col("home_value")).otherwise(F.col("away_value")))
    label = F.when(F.col("label") == "Ball Possession", "Possession").otherwise(F.col("label"))
    return rows.select("match_id", "at", label.alias("label"), "home", "away", _bar(F.col("h"), F.col("a")).alias("home_bar"), (F.col("h") >= F.col("a")).alias("home_wins"))


def scoreboard(flat: DataFrame) -> DataFrame:
    label = F.when(F.col("label") == "Ball Possession", "Possession").when(F.col("label") == "Shots on Target", "On Target").when(F.col("label") == "Expected Goals (xG)", "xG").otherwise(F.col("label"))
    return _rows(flat, BOARD).select("match_id", "at", label.alias("label"), "home", "away")


def charts(flat: DataFrame) -> DataFrame:
    """Values of the donut and the bars in long form: chart, metric, side, value."""
    items = [("possession", "Possession", "pct"), ("shots", "Total Shots", "shots"), ("shots", "On Target", "on_target"), ("shots", "xG", "xg"), ("shots", "Fouls", "fouls"), ("shots", "Corners", "corners"), ("passing", "Pass Accuracy", "accuracy")]
    cells = [F.struct(F.lit(c).alias("chart"), F.lit(m).alias("metric"), F.lit(s).alias("side"), F.col(f"{s}_{n}").cast("double").alias("value")) for c, m, n in items for s in ("home", "away")]
    return flat.select("match_id", F.explode(F.array(*cells)).alias("x")).select("match_id", "x.*")


def event_feed(events: DataFrame) -> DataFrame:
    """Events other than possession changes, by time, as they are listed."""
    look = lambda table, rest: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("type")), rest)
    at = F.row_number().over(Window.partitionBy("match_id").orderBy("ts_s", "event_seq")).cast("long")
    side = F.concat(F.when(F.col("team_side") == "home", "Home").otherwise("Away"), F.lit(" team"))
    return events.filter("type <> 'possession_change'").select(
        "match_id", at.alias("at"), clock(F.col("ts_s")).alias("clock"), look(ICONS, F.lit("•")).alias("icon"), look(LABELS, F.col("type")).alias("label"),
        F.coalesce("description", side).alias("text"), F.when(F.col("xg") != 0, F.concat(F.lit("xG "), fixed(F.col("xg"), 2))).alias("xg_text"),
    )


def key_events(events: DataFrame, most: int = 18) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("match_id").orderBy("ts_s", "event_seq")).cast("long")
    return events.filter(F.col("type").isin(*KEY_EVENTS)).withColumn("at", at).filter(F.col("at") <= most).select("match_id", "at", "ts_s", "type", "team_side")


def _named(side: Column, home: Column, away: Column) -> Column:
    return F.when(side == "home", home).otherwise(away)


def _score() -> Column:
    return F.concat(F.col("home_goals").cast("string"), F.lit("–"), F.col("away_goals").cast("string"))


def narrative_five(flat: DataFrame) -> DataFrame:
    h, a = F.lit("Home"), F.lit("Away")
    gap, margin = F.col("home_xg") - F.col("away_xg"), F.abs(F.col("home_goals") - F.col("away_goals"))
    goal = F.concat(F.lit(" The game's fulcrum tilted at "), clock(F.col("first_ts")), F.lit(" when "), _named(F.col("first_side"), h, a), F.lit(" broke the deadlock"), F.when(F.col("first_xg") != 0, F.concat(F.lit(" (xG: "), fixed(F.col("first_xg"), 2), F.lit(")"))).otherwise(""), F.lit("."))
    text = F.concat(
        F.when(F.col("home_pct") > F.col("away_pct"), h).otherwise(a), F.lit(" Team controlled the tempo with "), fixed(F.greatest("home_pct", "away_pct"), 0), F.lit("% possession, completing "),
        F.greatest("home_completed", "away_completed").cast("string"), F.lit(" passes across a compact five-a-side canvas. "), F.when(gap > 0, h).otherwise(a), F.lit("'s xG advantage of "), fixed(F.abs(gap), 2), F.lit(" "),
        F.when(margin > 0, "translated into").otherwise("belied"), F.lit(" a "), F.when(margin > 1, "commanding ").otherwise(""), _score(), F.lit(" result."), F.coalesce(goal, F.lit("")),
    )
    return flat.select("match_id", text.alias("narrative"))


def narrative_eleven(flat: DataFrame, home: Column, away: Column) -> DataFrame:
    gap = F.col("home_xg") - F.col("away_xg")
    goal = F.concat(F.lit(" "), _named(F.col("first_side"), home, away), F.lit(" broke the deadlock at "), clock(F.col("first_ts")), F.lit("."))
    text = F.concat(
        F.when(F.col("home_pct") > F.col("away_pct"), home).otherwise(away), F.lit(" controlled possession with "), fixed(F.greatest("home_pct", "away_pct"), 0), F.lit("% of the ball, building play through "),
        F.greatest("home_shots", "away_shots").cast("string"), F.lit(" shot attempts. "), F.when(gap > 0, home).otherwise(away), F.lit(" created the better chances (xG advantage: "), fixed(F.abs(gap), 2), F.lit("), resulting in a "),
        _score(), F.lit(" final scoreline."), F.coalesce(goal, F.lit("")),
    )
    return flat.select("match_id", text.alias("narrative"))


def narrative_browser(flat: DataFrame, home: Column, away: Column, minutes: Column) -> DataFrame:
    goal = F.concat(_named(F.col("first_side"), home, away), F.lit(" broke the deadlock in the "), F.floor(F.col("first_ts") / 60).cast("string"), F.lit("th minute. "))
    text = F.concat(
        F.when(F.col("home_pct") >= F.col("away_pct"), home).otherwise(away), F.lit(" controlled possession with "), plain_number(F.greatest("home_pct", "away_pct")), F.lit("% of the ball across the "), minutes.cast("string"), F.lit("-minute match. "),
        F.when(F.col("home_xg") >= F.col("away_xg"), home).otherwise(away), F.lit(" generated the better chances with "), fixed(F.greatest("home_xg", "away_xg"), 2), F.lit(" xG. "), F.coalesce(goal, F.lit("")), F.lit("Final score: "), _score(), F.lit("."),
    )
    return flat.select("match_id", text.alias("narrative"))


def narrative_long(flat: DataFrame) -> DataFrame:
    h, a = F.lit("Home"), F.lit("Away")
    home_leads = F.col("home_pct") > F.col("away_pct")
    gap = F.col("home_xg") - F.col("away_xg")
    delta = F.concat(F.when((gap < 0) & (jround(F.abs(gap), 2) > 0), "-").otherwise(""), fixed(F.abs(gap), 2))
    opening = F.concat(F.lit("The game's fulcrum tilted at "), clock(F.col("first_ts")), F.lit(" when "), _named(F.col("first_side"), h, a), F.lit(" broke the deadlock"), F.when(F.col("first_xg") != 0, F.concat(F.lit(" (xG: "), fixed(F.col("first_xg"), 2), F.lit(")"))).otherwise(""))
    ending = F.when(F.col("home_goals") + F.col("away_goals") > 1, F.concat(F.lit(", with the decisive blow landing at "), clock(F.col("last_ts")), F.lit("."))).otherwise(", a lead they would not relinquish.")
    text = F.concat(
        F.when(home_leads, h).otherwise(a), F.lit(" Team controlled the tempo with "), plain_number(F.greatest("home_pct", "away_pct")), F.lit("% possession, weaving "), F.when(home_leads, F.col("home_completed")).otherwise(F.col("away_completed")).cast("string"),
        F.lit(" completed passes across a compact five-a-side canvas. Yet possession yielded uneven opportunity: Home's xG stood at "), fixed(F.col("home_xg"), 2), F.lit(" against Away's "), fixed(F.col("away_xg"), 2), F.lit(", a delta of "), delta, F.lit(" reflecting "),
        F.when(jround(gap, 2) > 0, "Home's cutting edge").otherwise("Away's clinical efficiency"), F.lit(". The scoreline—"), _score(), F.lit("—"),
        F.when(F.abs(F.col("home_goals") - F.col("away_goals")) <= 1, "belies the razor-thin margins separating these sides").otherwise("tells a story of decisive moments"), F.lit(". "),
        F.coalesce(F.concat(opening, ending), F.lit("Both sides fought fiercely, but the net remained silent.")),
    )
    return flat.select("match_id", text.alias("narrative"))
