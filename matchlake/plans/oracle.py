"""SQL of the registered queries, written for DuckDB and independently of the DataFrame plans."""

from __future__ import annotations

from matchlake.plans.profiles import ELEVEN, FIVE, Profile


def jr(x: str, n: int) -> str:
    return f"(floor(({x}) * {10**n}.0::DOUBLE + 0.5) / {10**n}.0::DOUBLE)"


def fx(x: str, n: int) -> str:
    return f"printf('%.{n}f', {jr(x, n)})"


def dist(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(({x1}-{x2})*({x1}-{x2})+({y1}-{y2})*({y1}-{y2}))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def clock(x: str) -> str:
    return f"(CAST({big(f'floor(({x})/60)')} AS VARCHAR) || ':' || lpad(CAST({big(f'floor(({x})%60)')} AS VARCHAR), 2, '0'))"


def plain(x: str) -> str:
    return f"(CASE WHEN ({x}) = floor({x}) THEN CAST({big(f'floor({x})')} AS VARCHAR) ELSE printf('%.1f', {x}) END)"


FRAMES = """fr AS (
    SELECT user_id AS match_id, event_id AS e, event_type AS et, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_seq FROM events
), place AS (
    SELECT *, CASE et
        WHEN 'purchase' THEN CASE WHEN e % 2 = 0 THEN (e*7%80)/10.0::DOUBLE ELSE 105-(e*7%80)/10.0::DOUBLE END
        WHEN 'error' THEN CASE WHEN e % 4 IN (0, 2) THEN (e*3%30)/10.0::DOUBLE ELSE 105-(e*3%30)/10.0::DOUBLE END
        WHEN 'click' THEN 50+((e*3%21)-10)/10.0::DOUBLE WHEN 'view' THEN (e*17%1050)/10.0::DOUBLE END AS ball_x,
      CASE et
        WHEN 'purchase' THEN 34+((e*13%101)-50)/10.0::DOUBLE
        WHEN 'error' THEN CASE WHEN e % 4 IN (0, 1) THEN (e*11%30)/10.0::DOUBLE ELSE 68-(e*11%30)/10.0::DOUBLE END
        WHEN 'click' THEN 34+((e*5%21)-10)/10.0::DOUBLE WHEN 'view' THEN (e*23%680)/10.0::DOUBLE END AS ball_y
    FROM fr
), det AS (
    SELECT match_id, frame_seq, 5*(frame_seq+1) AS frame_idx, frame_seq*5.0::DOUBLE AS ts_s, 0 AS det_ord, 0 AS class_id,
        ball_x*640.0::DOUBLE/105.0::DOUBLE AS x, ball_y*360.0::DOUBLE/68.0::DOUBLE AS y, 6.0::DOUBLE AS width, 6.0::DOUBLE AS height,
        0.30::DOUBLE+(e%70)/100.0::DOUBLE AS confidence, NULL::BIGINT AS track_id, NULL::VARCHAR AS team_side
    FROM place WHERE ball_x IS NOT NULL
    UNION ALL
    SELECT match_id, frame_seq, 5*(frame_seq+1), frame_seq*5.0::DOUBLE, k+1, CASE WHEN k >= 8 THEN 1 ELSE 2 END,
        (CASE WHEN k < 2 AND ball_x IS NOT NULL THEN least(greatest(ball_x + (CASE WHEN (e%8<4) = (k=0) THEN (e%9)*0.45::DOUBLE ELSE 6.0::DOUBLE END), 0.0::DOUBLE), 105.0::DOUBLE)
            WHEN k = 8 THEN 2.0::DOUBLE WHEN k = 9 THEN 103.0::DOUBLE ELSE (e*11+k*917)%1050/10.0::DOUBLE END)*640.0::DOUBLE/105.0::DOUBLE,
        (CASE WHEN k < 2 AND ball_x IS NOT NULL THEN ball_y WHEN k >= 8 THEN 34.0::DOUBLE ELSE (e*29+k*67)%680/10.0::DOUBLE END)*360.0::DOUBLE/68.0::DOUBLE,
        12.0::DOUBLE, 30.0::DOUBLE, 0.30::DOUBLE+((e*7+k*11)%70)/100.0::DOUBLE, match_id*10+k, CASE WHEN k%2=0 THEN 'home' ELSE 'away' END
    FROM place, range(10) AS r(k)
)"""


def pitch(p: Profile, team: str = "team_side") -> str:
    """Ball and players on the pitch, and the owner of each frame."""
    conf = lambda least: "true" if least is None else f"confidence > {least}"
    rank = "d, det_ord" if p.owner_rule == "nearest" else "det_ord"
    return f"""{FRAMES}, bl AS (
    SELECT match_id, frame_seq, x/640.0::DOUBLE*{p.width}::DOUBLE AS x, y/360.0::DOUBLE*{p.height}::DOUBLE AS y FROM det WHERE class_id = 0 AND {conf(p.ball_confidence)}
), pl AS (
    SELECT match_id, frame_seq, det_ord, row_number() OVER (PARTITION BY match_id, frame_seq ORDER BY det_ord) - 1 AS i,
        x/640.0::DOUBLE*{p.width}::DOUBLE AS x, y/360.0::DOUBLE*{p.height}::DOUBLE AS y, {team} AS team, track_id
    FROM det WHERE class_id IN (1, 2) AND {conf(p.player_confidence)}
), near AS (
    SELECT match_id, frame_seq, team AS owner FROM (
        SELECT pl.match_id, pl.frame_seq, pl.team, pl.det_ord, {dist("bl.x", "bl.y", "pl.x", "pl.y")} AS d FROM pl JOIN bl USING (match_id, frame_seq)
    ) WHERE d < {p.reach} QUALIFY row_number() OVER (PARTITION BY match_id, frame_seq ORDER BY {rank}) = 1
), own AS (
    SELECT fr.match_id, fr.frame_seq, fr.frame_seq*5.0::DOUBLE AS ts_s, bl.x AS ball_x, bl.y AS ball_y, near.owner
    FROM fr LEFT JOIN bl USING (match_id, frame_seq) LEFT JOIN near USING (match_id, frame_seq)
)"""


def state(p: Profile) -> str:
    rows = "WHERE ball_x IS NOT NULL" if p.state_over_ball_frames else ""
    g = f"(CASE WHEN owner = 'home' THEN {p.width}::DOUBLE ELSE 0.0::DOUBLE END)"
    xg = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1/(1+exp(-({p.xg_base}::DOUBLE - {p.xg_distance}::DOUBLE*{dist('ball_x', 'ball_y', g, f'{p.height / 2}::DOUBLE')} - {p.xg_angle}::DOUBLE*atan2(abs(ball_y-{p.height / 2}::DOUBLE), abs(ball_x-{g})))))))"
    corner = " OR ".join(f"{dist('ball_x', 'ball_y', f'{cx}::DOUBLE', f'{cy}::DOUBLE')} < {p.corner_radius}" for cx in (0.0, p.width) for cy in (0.0, p.height))
    return f"""{pitch(p)}, st0 AS (
    SELECT *, lag(owner) OVER w AS prev_owner, lag(ball_x) OVER w AS pbx, lag(ball_y) OVER w AS pby FROM own {rows} WINDOW w AS (PARTITION BY match_id ORDER BY frame_seq)
), st AS (
    SELECT *, {dist("ball_x", "ball_y", "pbx", "pby")} AS step, {dist("ball_x", "ball_y", g, f"{p.height / 2}::DOUBLE")} AS gap, {xg} AS chance, coalesce({corner}, false) AS near_corner FROM st0
)"""


def events(p: Profile) -> str:
    shot = f"owner IS NOT NULL AND step > {p.shot_step} AND gap < {p.shot_distance}"
    worth = jr("chance", p.xg_digits)
    foul = "UNION ALL SELECT match_id, frame_seq, ts_s, 2, 'foul', CASE WHEN owner = 'home' THEN 'away' ELSE 'home' END, NULL, NULL, NULL, NULL FROM st WHERE owner <> prev_owner AND ball_x > 30 AND ball_x < 75 AND step < 2" if p.fouls else ""
    basic = f"""{state(p)}, basic AS (
    SELECT match_id, frame_seq, ts_s, 1 AS rank, 'possession_change' AS type, owner AS team_side, NULL::DOUBLE AS xg, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::VARCHAR AS description FROM st WHERE owner <> prev_owner
    {foul}
    UNION ALL SELECT match_id, frame_seq, ts_s, 3, CASE WHEN gap < {p.target_distance} AND chance > {p.target_xg} THEN 'shot_on_target' ELSE 'shot' END, owner, {worth}, ball_x, ball_y, NULL FROM st WHERE {shot}
    UNION ALL SELECT match_id, frame_seq, ts_s, 4, 'goal', owner, {worth}, ball_x, ball_y, '{p.goal_text}' || {fx("chance", 2)} FROM st WHERE {shot} AND gap < {p.goal_distance}
)"""
    if p.corner_rule == "islands":
        corners = """, counted AS (
    SELECT s.match_id, s.frame_seq, s.ts_s, s.owner, s.near_corner, sum(coalesce(b.n, 0)) OVER (PARTITION BY s.match_id ORDER BY s.frame_seq) AS others
    FROM st s LEFT JOIN (SELECT match_id, frame_seq, count(*) AS n FROM basic GROUP BY ALL) b USING (match_id, frame_seq)
), corner AS (
    SELECT match_id, frame_seq, ts_s, coalesce(owner, 'home') AS owner FROM counted WHERE near_corner AND others > 0
    QUALIFY row_number() OVER (PARTITION BY match_id, others ORDER BY frame_seq) = 1
)"""
    else:
        corners = f""", flag AS (
    SELECT match_id, frame_seq FROM st WHERE near_corner AND owner IS NOT NULL
), hop AS (
    SELECT a.match_id, a.frame_seq, min(b.frame_seq) AS next_seq FROM flag a LEFT JOIN flag b ON a.match_id = b.match_id AND b.frame_seq - a.frame_seq > {p.corner_gap} GROUP BY ALL
), taken AS (
    SELECT match_id, min(frame_seq) AS frame_seq FROM flag GROUP BY match_id
    UNION ALL SELECT h.match_id, h.next_seq FROM taken t JOIN hop h ON t.match_id = h.match_id AND t.frame_seq = h.frame_seq WHERE h.next_seq IS NOT NULL
), corner AS (
    SELECT st.match_id, st.frame_seq, st.ts_s, st.owner FROM st JOIN taken USING (match_id, frame_seq)
)"""
    return f"""{basic}{corners}, ev AS (
    SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_seq, rank) AS event_seq FROM (
        SELECT * FROM basic UNION ALL SELECT match_id, frame_seq, ts_s, 5, 'corner', owner, NULL, NULL, NULL, NULL FROM corner)
)"""


def share(p: Profile) -> str:
    return f"""poss AS (
    SELECT *, {jr("100 - home_pct", 1)} AS away_pct FROM (
        SELECT match_id, home_frames, away_frames, none_frames, frames,
            CASE WHEN home_frames + away_frames > 0 THEN {jr("home_frames / (home_frames + away_frames)::DOUBLE * 100", 1)} ELSE {p.empty_possession}::DOUBLE END AS home_pct
        FROM (SELECT match_id, count(*) FILTER (WHERE owner = 'home') AS home_frames, count(*) FILTER (WHERE owner = 'away') AS away_frames, count(*) FILTER (WHERE owner IS NULL) AS none_frames, count(*) AS frames FROM own GROUP BY match_id))
)"""


def passed(p: Profile) -> str:
    side = lambda s: f"""{s}_completed, {s}_total, CASE WHEN {s}_total > 0 THEN {jr(f"{s}_completed / {s}_total::DOUBLE * 100", 1)} ELSE 0.0::DOUBLE END AS {s}_accuracy"""
    total = lambda s: f"greatest({s}_completed, {big(f'floor({s}_pct * {p.pass_floor}::DOUBLE + 0.5)')}) AS {s}_total"
    return f"""done AS (
    SELECT match_id, count(*) FILTER (WHERE owner = prev_owner AND step > {p.pass_step} AND owner = 'home') AS home_completed, count(*) FILTER (WHERE owner = prev_owner AND step > {p.pass_step} AND owner = 'away') AS away_completed FROM st GROUP BY match_id
), passes AS (
    SELECT match_id, {side("home")}, {side("away")} FROM (
        SELECT *, {total("home")}, {total("away")} FROM (SELECT p.match_id, home_pct, away_pct, coalesce(home_completed, 0) AS home_completed, coalesce(away_completed, 0) AS away_completed FROM poss p LEFT JOIN done USING (match_id)))
)"""


def counted() -> str:
    shots = "type IN ('shot', 'shot_on_target', 'goal')"
    cols = []
    for s in ("home", "away"):
        own = f"team_side = '{s}'"
        cols.append(f"count(*) FILTER (WHERE {own} AND {shots}) AS {s}_shots, count(*) FILTER (WHERE {own} AND type = 'shot_on_target') AS {s}_on_target, {jr(jr(f'coalesce(sum(coalesce(xg, 0)) FILTER (WHERE {own} AND {shots}), 0)', 6), 2)} AS {s}_xg")
        cols += [f"count(*) FILTER (WHERE {own} AND type = '{t}') AS {s}_{n}" for t, n in (("goal", "goals"), ("foul", "fouls"), ("corner", "corners"))]
    return f"stat AS (SELECT match_id, {', '.join(cols)} FROM ev GROUP BY match_id)"


STAT = [f"{s}_{c}" for s in ("home", "away") for c in ("shots", "on_target", "xg", "goals", "fouls", "corners")]


def flat(p: Profile) -> str:
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in STAT)
    return f"""WITH RECURSIVE {events(p)}, {share(p)}, {passed(p)}, {counted()}, goal AS (
    SELECT match_id, min_by(ts_s, event_seq) AS first_ts, min_by(team_side, event_seq) AS first_side, min_by(xg, event_seq) AS first_xg, max_by(ts_s, event_seq) AS last_ts, max_by(team_side, event_seq) AS last_side, count(*) AS goals FROM ev WHERE type = 'goal' GROUP BY match_id
), flat AS (
    SELECT poss.*, passes.* EXCLUDE (match_id), {jr("home_pct / 20", 1)} AS home_pressure, {jr("away_pct / 20", 1)} AS away_pressure, {zero}
    FROM poss JOIN passes USING (match_id) LEFT JOIN stat USING (match_id)
)"""


def minutes(p: Profile) -> str:
    n = f"{'ceil' if p.momentum_ceil else 'floor'}(count(*)*5.0::DOUBLE/60)"
    return f"greatest({p.momentum_least}, {big(n)})"


def momentum(p: Profile) -> str:
    return f"""WITH RECURSIVE {events(p)}, grid AS (
    SELECT match_id, unnest(range(0, last + 1, 2)) AS minute FROM (SELECT match_id, {minutes(p)} AS last FROM fr GROUP BY match_id)
)
SELECT g.match_id, g.minute,
    CASE WHEN count(v.ts_s) > 0 THEN {jr("count(v.ts_s) FILTER (WHERE v.team_side = 'home') / count(v.ts_s)::DOUBLE * 100", 1)} ELSE 0.0::DOUBLE END AS home,
    CASE WHEN count(v.ts_s) > 0 THEN {jr("(count(v.ts_s) - count(v.ts_s) FILTER (WHERE v.team_side = 'home')) / count(v.ts_s)::DOUBLE * 100", 1)} ELSE {p.empty_momentum_away}::DOUBLE END AS away
FROM grid g LEFT JOIN (SELECT * FROM ev WHERE type = 'possession_change') v ON v.match_id = g.match_id AND v.ts_s >= (g.minute - 2) * 60 AND v.ts_s <= g.minute * 60
GROUP BY g.match_id, g.minute"""


def nodes(p: Profile) -> str:
    key = "CAST(track_id AS VARCHAR)" if p.owner_rule == "first" else "team || '_' || CAST(i % 11 AS VARCHAR)"
    cap = f"WHERE node_seq <= {p.node_cap}" if p.cap_before_edges else ""
    return f"""{pitch(p)}, node AS (
    SELECT * FROM (
        SELECT match_id, player_id, team, involvement, x, y, row_number() OVER (PARTITION BY match_id ORDER BY first) AS node_seq FROM (
            SELECT match_id, {key} AS player_id, team, min(frame_seq * 1000 + i) AS first, count(*) AS involvement, {jr(jr("avg(x)", 6), 2)} AS x, {jr(jr("avg(y)", 6), 2)} AS y FROM pl GROUP BY 1, 2, 3
        ) WHERE involvement >= 3
    ) {cap}
)"""


def edges(p: Profile) -> str:
    times = f"floor(10.0::DOUBLE / greatest(1.0::DOUBLE, d) + {0.5 if p.edge_round else 0.0})"
    return f"""{nodes(p)}, edge AS (
    SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY a_seq, b_seq) AS edge_seq, from_id, to_id, team, greatest(1, {big(times)}) AS count,
        {jr(f"least(0.95::DOUBLE, {p.accuracy_base}::DOUBLE + {p.accuracy_step}::DOUBLE * ({p.edge_distance}::DOUBLE - d))", 2)} AS accuracy
    FROM (SELECT a.match_id, a.team, a.node_seq AS a_seq, b.node_seq AS b_seq, a.player_id AS from_id, b.player_id AS to_id, {dist("a.x", "a.y", "b.x", "b.y")} AS d FROM node a JOIN node b ON a.match_id = b.match_id AND a.team = b.team AND a.node_seq < b.node_seq)
    WHERE d < {p.edge_distance} QUALIFY edge_seq <= {p.edge_cap}
)"""


def paired() -> dict[str, str]:
    out = {}
    for p in (FIVE, ELEVEN):
        out |= {
            f"possession_{p.name}": f"WITH {pitch(p)}, {share(p)} SELECT * FROM poss",
            f"ball_owner_frames_{p.name}": f"WITH {pitch(p)} SELECT match_id, frame_seq, owner FROM own WHERE owner IS NOT NULL",
            f"steps_{p.name}": f"WITH {state(p)} SELECT match_id, frame_seq, prev_owner, {jr('step', 3)} AS step FROM st WHERE step IS NOT NULL",
            f"events_{p.name}": f"WITH RECURSIVE {events(p)} SELECT match_id, event_seq, frame_seq, ts_s, type, team_side, xg, {jr('x', 3)} AS x, {jr('y', 3)} AS y, description FROM ev",
            f"events_capped_{p.name}": f"WITH RECURSIVE {events(p)} SELECT match_id, event_seq, type, team_side FROM ev WHERE event_seq <= {p.event_cap}",
            f"corners_{p.name}": f"WITH RECURSIVE {events(p)} SELECT match_id, frame_seq, team_side FROM ev WHERE type = 'corner'",
            f"pass_stats_{p.name}": f"WITH {state(p)}, {share(p)}, {passed(p)} SELECT * FROM passes",
            f"shot_stats_{p.name}": f"WITH RECURSIVE {events(p)}, {counted()} SELECT match_id, {', '.join(c for c in STAT if c.split('_', 1)[1] in ('shots', 'on_target', 'xg'))} FROM stat",
            f"score_discipline_{p.name}": f"WITH RECURSIVE {events(p)}, {counted()} SELECT match_id, {', '.join(c for c in STAT if c.split('_', 1)[1] in ('goals', 'fouls', 'corners'))} FROM stat",
            f"pressure_index_{p.name}": f"WITH {pitch(p)}, {share(p)} SELECT match_id, {jr('home_pct / 20', 1)} AS home_pressure, {jr('away_pct / 20', 1)} AS away_pressure FROM poss",
            f"momentum_{p.name}": momentum(p),
            f"pass_nodes_{p.name}": f"WITH {nodes(p)} SELECT * FROM node WHERE node_seq <= {p.node_cap}",
            f"pass_edges_{p.name}": f"WITH {edges(p)} SELECT * FROM edge",
            f"first_last_goal_{p.name}": f"{flat(p)} SELECT * FROM goal",
        }
        value = lambda g, p=p: jr(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1/(1+exp(-({p.xg_base}::DOUBLE - {p.xg_distance}::DOUBLE*{dist('x::DOUBLE', 'y::DOUBLE', g, f'{p.height / 2}::DOUBLE')} - {p.xg_angle}::DOUBLE*atan2(abs(y-{p.height / 2}::DOUBLE), abs(x-{g})))))))", 4)
        out[f"xg_grid_{p.name}"] = f"WITH {pitch(p)}, spot AS (SELECT DISTINCT {big('floor(ball_x)')} AS x, {big('floor(ball_y)')} AS y FROM own WHERE ball_x IS NOT NULL) SELECT x, y, {value(f'{p.width}::DOUBLE')} AS home_xg, {value('0.0::DOUBLE')} AS away_xg FROM spot"
    return out


def voronoi(p: Profile) -> str:
    sq = lambda s: f"({s}.x*{s}.x+{s}.y*{s}.y)"
    under = "(2*(a.x*(b.y-c.y)+b.x*(c.y-a.y)+c.x*(a.y-b.y)))"
    return f"""WITH {pitch(p)}, inside AS (
    SELECT *, count(*) OVER (PARTITION BY match_id, frame_seq) AS n FROM pl WHERE x BETWEEN 0 AND {p.width} AND y BETWEEN 0 AND {p.height}
), keyframe AS (
    SELECT match_id, frame_seq FROM (SELECT DISTINCT match_id, frame_seq FROM inside WHERE n >= 4 AND (frame_seq + 1) % 5 = 0) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY frame_seq) <= {p.zone_cap}
), s AS MATERIALIZED (
    SELECT inside.* FROM inside JOIN keyframe USING (match_id, frame_seq)
), every AS MATERIALIZED (
    SELECT match_id, frame_seq, list({{'x': x, 'y': y}}) AS own FROM s GROUP BY ALL
), tri AS MATERIALIZED (
    SELECT a.match_id, a.frame_seq, a.det_ord AS ao, b.det_ord AS bo, c.det_ord AS co, a.x AS ax, a.y AS ay,
        ({sq("a")}*(b.y-c.y)+{sq("b")}*(c.y-a.y)+{sq("c")}*(a.y-b.y))/{under} AS ux, ({sq("a")}*(c.x-b.x)+{sq("b")}*(a.x-c.x)+{sq("c")}*(b.x-a.x))/{under} AS uy
    FROM s a JOIN s b ON a.match_id = b.match_id AND a.frame_seq = b.frame_seq AND a.det_ord < b.det_ord
    JOIN s c ON b.match_id = c.match_id AND b.frame_seq = c.frame_seq AND b.det_ord < c.det_ord WHERE abs({under}) > 1e-6
), clear AS (
    SELECT t.* FROM (SELECT *, (ax-ux)*(ax-ux)+(ay-uy)*(ay-uy) AS r2 FROM tri) t JOIN every USING (match_id, frame_seq)
    WHERE len(list_filter(own, lambda o: (o.x-ux)*(o.x-ux)+(o.y-uy)*(o.y-uy) < r2 * (1 - 1e-9::DOUBLE) - 1e-9::DOUBLE)) = 0
), corner AS (
    SELECT DISTINCT match_id, frame_seq, unnest([ao, bo, co]) AS det_ord, floor(ux*1e6+0.5)/1e6 AS ux, floor(uy*1e6+0.5)/1e6 AS uy FROM clear
), turn AS (
    SELECT c.*, atan2(c.uy-s.y, c.ux-s.x) AS angle FROM corner c JOIN s USING (match_id, frame_seq, det_ord)
), ring AS (
    SELECT *, coalesce(lead(ux) OVER w, first_value(ux) OVER w) AS nx, coalesce(lead(uy) OVER w, first_value(uy) OVER w) AS ny
    FROM turn WINDOW w AS (PARTITION BY match_id, frame_seq, det_ord ORDER BY angle, ux, uy)
), cell AS (
    SELECT match_id, frame_seq, det_ord, sum(ux*ny-nx*uy) AS twice FROM ring GROUP BY ALL
), aim AS (
    SELECT a.match_id, a.frame_seq, a.det_ord, atan2(o.y-a.y, o.x-a.x) AS angle FROM s a JOIN s o ON a.match_id = o.match_id AND a.frame_seq = o.frame_seq WHERE o.x <> a.x OR o.y <> a.y
), wide AS (
    SELECT match_id, frame_seq, det_ord, max(gap) AS gap FROM (
        SELECT *, coalesce(lead(angle) OVER w, first_value(angle) OVER w + 2*pi()) - angle AS gap FROM aim WINDOW w AS (PARTITION BY match_id, frame_seq, det_ord ORDER BY angle)
    ) GROUP BY ALL
)
SELECT s.match_id, s.frame_seq, s.track_id, s.team, {jr(f"coalesce(CASE WHEN gap < pi() - 1e-7 THEN least(abs(twice)/2, {p.width * p.height}::DOUBLE) ELSE 0 END, 0)", 2)} AS area
FROM s LEFT JOIN cell USING (match_id, frame_seq, det_ord) LEFT JOIN wide USING (match_id, frame_seq, det_ord)"""


def kde(p: Profile) -> str:
    return f"""WITH {pitch(p)}, spread AS (
    SELECT match_id, track_id, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM pl GROUP BY ALL HAVING count(*) >= 5
), good AS (
    SELECT *, vx*vy-cxy*cxy AS det FROM spread WHERE vx*vy-cxy*cxy > 1e-9*greatest(vx*vy, 1e-12)
), grid AS (
    SELECT i*{p.width}::DOUBLE/20 AS gx, j*{p.height}::DOUBLE/11 AS gy FROM range(21) a(i), range(12) b(j)
), dense AS (
    SELECT g.match_id, g.track_id, gx, gy, sum(exp(-((vy*(gx-x)*(gx-x)-2*cxy*(gx-x)*(gy-y)+vx*(gy-y)*(gy-y))/(det*0.09::DOUBLE))/2)) AS density
    FROM good g JOIN pl USING (match_id, track_id), grid GROUP BY ALL
)
SELECT match_id, track_id, {jr("gx", 3)} AS x, {jr("gy", 3)} AS y, {jr("share", 3)} AS intensity
FROM (SELECT *, density / max(density) OVER (PARTITION BY match_id, track_id) AS share FROM dense) WHERE share > 0.1"""


#: (category, label, column, form, lower is better), as in the report.
_METRICS = [
    ("Attack", "Goals", "goals", "int", 0), ("Attack", "Shots", "shots", "int", 0), ("Attack", "Shots on Target", "on_target", "int", 0), ("Attack", "Expected Goals (xG)", "xg", "2", 0),
    ("Possession", "Ball Possession", "pct", "%", 0), ("Possession", "Pressure Index", "pressure", "1", 0), ("Passing", "Passes Completed", "completed", "int", 0),
    ("Passing", "Total Passes", "total", "int", 0), ("Passing", "Pass Accuracy", "accuracy", "%", 0), ("Discipline", "Fouls", "fouls", "int", 1), ("Discipline", "Corners", "corners", "int", 0),
]


def _form(c: str, how: str) -> str:
    return {"int": f"CAST({c} AS VARCHAR)", "2": fx(c, 2), "1": fx(c, 1), "%": f"{plain(c)} || '%'"}[how]


def metric_rows(names: list[str]) -> str:
    known = {m[2]: m for m in _METRICS}
    return " UNION ALL ".join(
        f"SELECT match_id, {at} AS pos, '{known[n][0]}' AS category, '{known[n][1]}' AS label, {_form(f'home_{n}', known[n][3])} AS home, {_form(f'away_{n}', known[n][3])} AS away, home_{n}::DOUBLE AS h, away_{n}::DOUBLE AS a, {known[n][4]} = 1 AS lower FROM flat"
        for at, n in enumerate(names)
    )


def bar(h: str, a: str) -> str:
    return big(f"floor({h} / (CASE WHEN {h} + {a} = 0 THEN 1 ELSE {h} + {a} END) * 100 + 0.5)")


def told(p: Profile, text: str) -> str:
    return f"{flat(p)} SELECT flat.match_id, {text} AS narrative FROM flat LEFT JOIN goal USING (match_id)"


def named(side: str, home: str, away: str) -> str:
    return f"(CASE WHEN {side} = 'home' THEN '{home}' ELSE '{away}' END)"


SCORE = "CAST(home_goals AS VARCHAR) || '–' || CAST(away_goals AS VARCHAR)"
XG_NOTE = f"CASE WHEN first_xg <> 0 THEN ' (xG: ' || {fx('first_xg', 2)} || ')' ELSE '' END"
NARRATIVES = {
    "narrative_a": told(FIVE, f"""(CASE WHEN home_pct > away_pct THEN 'Home' ELSE 'Away' END) || ' Team controlled the tempo with ' || {fx("greatest(home_pct, away_pct)", 0)} || '% possession, completing ' || CAST(greatest(home_completed, away_completed) AS VARCHAR)
        || ' passes across a compact five-a-side canvas. ' || (CASE WHEN home_xg - away_xg > 0 THEN 'Home' ELSE 'Away' END) || '''s xG advantage of ' || {fx("abs(home_xg - away_xg)", 2)} || ' ' || (CASE WHEN home_goals <> away_goals THEN 'translated into' ELSE 'belied' END)
        || ' a ' || (CASE WHEN abs(home_goals - away_goals) > 1 THEN 'commanding ' ELSE '' END) || {SCORE} || ' result.'
        || coalesce(' The game''s fulcrum tilted at ' || {clock("first_ts")} || ' when ' || {named("first_side", "Home", "Away")} || ' broke the deadlock' || {XG_NOTE} || '.', '')"""),
    "narrative_b": told(ELEVEN, f"""(CASE WHEN home_pct > away_pct THEN 'Reds' ELSE 'Blues' END) || ' controlled possession with ' || {fx("greatest(home_pct, away_pct)", 0)} || '% of the ball, building play through ' || CAST(greatest(home_shots, away_shots) AS VARCHAR) || ' shot attempts. '
        || (CASE WHEN home_xg - away_xg > 0 THEN 'Reds' ELSE 'Blues' END) || ' created the better chances (xG advantage: ' || {fx("abs(home_xg - away_xg)", 2)} || '), resulting in a ' || {SCORE} || ' final scoreline.'
        || coalesce(' ' || {named("first_side", "Reds", "Blues")} || ' broke the deadlock at ' || {clock("first_ts")} || '.', '')"""),
    "narrative_c": told(ELEVEN, f"""(CASE WHEN home_pct >= away_pct THEN 'Reds' ELSE 'Blues' END) || ' controlled possession with ' || {plain("greatest(home_pct, away_pct)")} || '% of the ball across the ' || CAST(greatest(5, {big("floor(frames * 5 / 60.0::DOUBLE + 0.5)")}) AS VARCHAR) || '-minute match. '
        || (CASE WHEN home_xg >= away_xg THEN 'Reds' ELSE 'Blues' END) || ' generated the better chances with ' || {fx("greatest(home_xg, away_xg)", 2)} || ' xG. '
        || coalesce({named("first_side", "Reds", "Blues")} || ' broke the deadlock in the ' || CAST({big("floor(first_ts / 60)")} AS VARCHAR) || 'th minute. ', '') || 'Final score: ' || {SCORE} || '.'""").replace("(CASE WHEN first_side = 'home'", "(CASE WHEN first_side IS NULL THEN NULL WHEN first_side = 'home'"),
    "narrative_d": told(FIVE, f"""(CASE WHEN home_pct > away_pct THEN 'Home' ELSE 'Away' END) || ' Team controlled the tempo with ' || {plain("greatest(home_pct, away_pct)")} || '% possession, weaving ' || CAST(CASE WHEN home_pct > away_pct THEN home_completed ELSE away_completed END AS VARCHAR)
        || ' completed passes across a compact five-a-side canvas. Yet possession yielded uneven opportunity: Home''s xG stood at ' || {fx("home_xg", 2)} || ' against Away''s ' || {fx("away_xg", 2)} || ', a delta of '
        || (CASE WHEN home_xg < away_xg AND {jr("abs(home_xg - away_xg)", 2)} > 0 THEN '-' ELSE '' END) || {fx("abs(home_xg - away_xg)", 2)} || ' reflecting ' || (CASE WHEN {jr("home_xg - away_xg", 2)} > 0 THEN 'Home''s cutting edge' ELSE 'Away''s clinical efficiency' END)
        || '. The scoreline—' || {SCORE} || '—' || (CASE WHEN abs(home_goals - away_goals) <= 1 THEN 'belies the razor-thin margins separating these sides' ELSE 'tells a story of decisive moments' END) || '. '
        || coalesce('The game''s fulcrum tilted at ' || {clock("first_ts")} || ' when ' || {named("first_side", "Home", "Away")} || ' broke the deadlock' || {XG_NOTE} || (CASE WHEN goals > 1 THEN ', with the decisive blow landing at ' || {clock("last_ts")} || '.' ELSE ', a lead they would not relinquish.' END),
            'Both sides fought fiercely, but the net remained silent.')"""),
}

MATCHES = """m AS (
    SELECT o_orderkey AS id, o_custkey AS user_id, 'Match ' || CAST(o_orderkey AS VARCHAR) AS title, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'uploading' END AS status,
        CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 40 ELSE 0 END AS progress, CASE WHEN o_orderkey % 3 = 0 THEN 'video' END AS video_url, o_orderdate AS created_at FROM orders
)"""
USERS = """u AS (
    SELECT c_custkey AS id, lower(c_name) AS email, CASE c_custkey % 10 WHEN 0 THEN 'club-owner' WHEN 1 THEN 'coach' WHEN 2 THEN 'owner' ELSE 'player' END AS role, CASE WHEN c_custkey % 4 <> 0 THEN 'tok' || CAST(c_custkey AS VARCHAR) END AS fcm_token FROM customer
)"""
CHANGES = """ch AS (
    SELECT l_orderkey + CASE WHEN n > 5 THEN 1000000 ELSE 0 END AS id, CASE WHEN n % 2 = 0 THEN 'completed' END AS status, CASE WHEN n % 3 = 0 THEN 100 END AS progress
    FROM (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
)"""
FILES = """f AS (
    SELECT (CASE WHEN o_orderkey % 7 = 0 THEN 'images/' ELSE 'videos/' END) || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || (CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '/clip' END) || (CASE WHEN o_orderkey % 3 = 0 THEN '.mov' ELSE '.mp4' END) AS path,
        CASE WHEN o_orderkey % 11 = 0 THEN 'video/mp4' ELSE 'application/octet-stream' END AS content_type, o_orderkey * 35001 % 700000000 AS size FROM orders
)"""
STATUSES = """sc AS (
    SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'uploading' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'processing' END AS status FROM events
), tr AS (
    SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY seq) AS was FROM sc) WHERE status = 'completed' AND was <> 'completed'
)"""
SIZE = "o_orderkey * o_custkey"
HALF = "CASE WHEN x < 320 THEN 'home' ELSE 'away' END"
LONG_DAY = "strftime(created_at, '%A, ') || CAST(day(created_at) AS VARCHAR) || strftime(created_at, ' %B %Y')"

SINGLE = {
    "match_summary": f"{flat(ELEVEN)} SELECT * FROM flat",
    "match_summary_five": f"{flat(FIVE)} SELECT * FROM flat",
    "possession_half": f"WITH {FRAMES} SELECT match_id, home_balls, balls, {big('floor(home_balls / balls::DOUBLE * 100 + 0.5)')} AS home_pct, 100 - {big('floor(home_balls / balls::DOUBLE * 100 + 0.5)')} AS away_pct FROM (SELECT match_id, count(*) FILTER (WHERE x < 320) AS home_balls, count(*) AS balls FROM det WHERE class_id = 0 GROUP BY match_id)",
    "ball_presence": f"WITH {FRAMES} SELECT match_id, count(*) FILTER (WHERE ball_x IS NOT NULL) AS ball_frames, count(*) AS frames FROM place GROUP BY match_id",
    "half_split_owners": f"WITH {pitch(ELEVEN, HALF)} SELECT match_id, owner, count(*) AS frames FROM own WHERE owner IS NOT NULL GROUP BY ALL",
    "heatmap_hist": f"""WITH {pitch(ELEVEN)}, c AS (
        SELECT match_id, team, least(20, {big("floor(x / 105.0::DOUBLE * 21)")}) AS cx, least(12, {big("floor(y / 68.0::DOUBLE * 13)")}) AS cy, count(*) AS n FROM pl GROUP BY ALL
    ) SELECT match_id, team, {jr("cx / 21.0::DOUBLE * 105", 3)} AS x, {jr("cy / 13.0::DOUBLE * 68", 3)} AS y, {jr("n / most::DOUBLE", 3)} AS intensity
    FROM (SELECT *, max(n) OVER (PARTITION BY match_id, team) AS most, sum(n) OVER (PARTITION BY match_id, team) AS total FROM c) WHERE total >= 3 AND n / most::DOUBLE > 0.05""",
    "heatmap_kde": kde(FIVE),
    "raw_heat_points": f"WITH {FRAMES} SELECT match_id, {HALF} AS side, frame_seq, det_ord, {jr('x / 640.0::DOUBLE * 105', 2)} AS x, {jr('y / 360.0::DOUBLE * 68', 2)} AS y, least(1.0::DOUBLE, confidence) AS intensity FROM det WHERE class_id IN (1, 2) QUALIFY count(*) OVER (PARTITION BY match_id, {HALF}) > 10",
    "voronoi_zones": voronoi(FIVE),
    "edge_resolve": f"WITH {edges(FIVE)}, top AS (SELECT * FROM node WHERE node_seq <= 20) SELECT edge.*, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y FROM edge JOIN top a ON a.match_id = edge.match_id AND a.player_id = from_id JOIN top b ON b.match_id = edge.match_id AND b.player_id = to_id",
    "network_viz": f"WITH {nodes(ELEVEN)} SELECT match_id, player_id, team, {jr('x / 105.0::DOUBLE * 840', 2)} AS screen_x, {jr('y / 68.0::DOUBLE * 500', 2)} AS screen_y, {jr('6 + 0.8::DOUBLE * involvement', 2)} AS radius FROM node",
    "stats_table": f"{flat(ELEVEN)} SELECT match_id, pos AS at, category, label, home, away, {bar('h', 'a')} AS home_bar, CASE WHEN lower THEN h < a ELSE h > a END AS home_wins, CASE WHEN lower THEN a < h ELSE a > h END AS away_wins FROM ({metric_rows([m[2] for m in _METRICS])})",
    "report_table": f"{flat(ELEVEN)} SELECT match_id, pos AS at, label, home, away, {bar('hv', 'av')} AS home_bar, hv >= av AS home_wins FROM (SELECT match_id, pos, CASE label WHEN 'Ball Possession' THEN 'Possession' ELSE label END AS label, home, away, CASE WHEN lower THEN a ELSE h END AS hv, CASE WHEN lower THEN h ELSE a END AS av FROM ({metric_rows(['pct', 'shots', 'on_target', 'xg', 'completed', 'accuracy', 'corners', 'fouls', 'pressure'])}))",
    "scoreboard": f"{flat(ELEVEN)} SELECT match_id, pos AS at, CASE label WHEN 'Ball Possession' THEN 'Possession' WHEN 'Shots on Target' THEN 'On Target' WHEN 'Expected Goals (xG)' THEN 'xG' ELSE label END AS label, home, away FROM ({metric_rows(['pct', 'shots', 'on_target', 'corners', 'fouls', 'xg'])})",
    "charts_long": f"{flat(ELEVEN)} " + " UNION ALL ".join(f"SELECT match_id, '{c}' AS chart, '{m}' AS metric, '{s}' AS side, {s}_{n}::DOUBLE AS value FROM flat" for c, m, n in (("possession", "Possession", "pct"), ("shots", "Total Shots", "shots"), ("shots", "On Target", "on_target"), ("shots", "xG", "xg"), ("shots", "Fouls", "fouls"), ("shots", "Corners", "corners"), ("passing", "Pass Accuracy", "accuracy")) for s in ("home", "away")),
    "event_feed": f"""WITH RECURSIVE {events(ELEVEN)} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY ts_s, event_seq) AS at, {clock("ts_s")} AS clock,
        CASE type WHEN 'goal' THEN '⚽' WHEN 'foul' THEN '🟨' WHEN 'corner' THEN '🚩' ELSE '🎯' END AS icon, CASE type WHEN 'goal' THEN 'Goal' WHEN 'shot' THEN 'Shot' WHEN 'shot_on_target' THEN 'On Target' WHEN 'foul' THEN 'Foul' ELSE 'Corner' END AS label,
        coalesce(description, (CASE WHEN team_side = 'home' THEN 'Home' ELSE 'Away' END) || ' team') AS text, CASE WHEN xg <> 0 THEN 'xG ' || {fx("xg", 2)} END AS xg_text FROM ev WHERE type <> 'possession_change'""",
    "report_key_events": f"WITH RECURSIVE {events(ELEVEN)} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY ts_s, event_seq) AS at, ts_s, type, team_side FROM ev WHERE type IN ('goal', 'shot_on_target', 'foul', 'corner') QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ts_s, event_seq) <= 18",
    **NARRATIVES,
    "match_cards": f"{flat(ELEVEN)}, {MATCHES} SELECT id, title, status, {SCORE} AS score, {fx('home_xg', 1)} AS home_xg, {fx('away_xg', 1)} AS away_xg, strftime(created_at, '%d %b %Y') AS day FROM m JOIN flat ON m.id = flat.match_id",
    "fmt_timestamp": f"WITH {FRAMES} SELECT match_id, frame_seq, {clock('frame_seq * 5.0::DOUBLE + 0.5')} AS clock FROM fr",
    "fmt_filesize": f"SELECT id, n_bytes, CASE WHEN n_bytes < 1024 THEN CAST(n_bytes AS VARCHAR) || ' B' WHEN n_bytes < 1048576 THEN {fx('n_bytes / 1024.0::DOUBLE', 1)} || ' KB' ELSE {fx('n_bytes / 1048576.0::DOUBLE', 1)} || ' MB' END AS text FROM (SELECT o_orderkey AS id, {SIZE} % 7000000 AS n_bytes FROM orders)",
    "fmt_eta": f"SELECT id, CASE WHEN done = 0 THEN '--' WHEN (1000000 - done) / (done / took) < 60 THEN CAST({big('ceil((1000000 - done) / (done / took))')} AS VARCHAR) || 's' ELSE CAST({big('ceil((1000000 - done) / (done / took) / 60)')} AS VARCHAR) || 'm' END AS eta, {big('floor(done * 100.0::DOUBLE / 1000000 + 0.5)')} AS percent FROM (SELECT o_orderkey AS id, (o_orderkey % 1000 * 1000)::DOUBLE AS done, (o_orderkey % 97 + 1)::DOUBLE AS took FROM orders)",
    "est_duration": f"SELECT o_orderkey AS id, greatest(60.0::DOUBLE, least(5400.0::DOUBLE, {jr(f'({SIZE} % 120000000) / 1048576.0::DOUBLE * 60', 0)})) AS duration FROM orders",
    "percent_parse": f"{flat(ELEVEN)} SELECT match_id, home_pct FROM flat",
    "report_dates": f"WITH {MATCHES} SELECT id, {LONG_DAY} AS long_day, strftime(created_at, '%d %b %Y') AS day, regexp_replace(title, '\\s+', '_', 'g') AS stem FROM m",
    "homography": f"WITH {FRAMES}, s AS (SELECT match_id, frame_seq, det_ord, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y FROM det) SELECT match_id, frame_seq, det_ord, {jr('(0.05::DOUBLE*x+0.01::DOUBLE*y+1.0::DOUBLE)/(0.0001::DOUBLE*x+0.0002::DOUBLE*y+1.0::DOUBLE)', 3)} AS px, {jr('(0.002::DOUBLE*x+0.06::DOUBLE*y+0.5::DOUBLE)/(0.0001::DOUBLE*x+0.0002::DOUBLE*y+1.0::DOUBLE)', 3)} AS py FROM s",
    "half_split_teams": f"WITH {FRAMES} SELECT match_id, {HALF} AS team, count(*) AS n FROM det WHERE class_id IN (1, 2) GROUP BY ALL",
    "box_clip": f"""WITH {FRAMES}, b AS (SELECT match_id, frame_seq, det_ord, x-width/2 AS x1, y-height/2 AS y1, x+width/2 AS x2, y+height/2 AS y2 FROM det), c AS (
        SELECT *, greatest(0, {big("trunc(x1)")}) AS "left", greatest(0, {big("trunc(y1)")}) AS top, {big("trunc(x2)")} AS "right", {big("trunc(y2)")} AS bottom FROM b
    ) SELECT match_id, frame_seq, det_ord, "left", top, "right", bottom, "right" > "left" AND bottom > top AS there, {jr("(x1+x2)/2", 3)} AS mx, {jr("(y1+y2)/2", 3)} AS my FROM c""",
    "top_matches": f"WITH {MATCHES} SELECT user_id, row_number() OVER w AS at, id FROM m WINDOW w AS (PARTITION BY user_id ORDER BY created_at DESC, id DESC) QUALIFY row_number() OVER w <= 20",
    "match_counts": f"WITH {MATCHES} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed FROM m GROUP BY user_id",
    "team_docs": "SELECT n_nationkey::BIGINT AS id, count(s_suppkey) AS n_teams, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS teams FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "doc_upsert": f"WITH {MATCHES}, {CHANGES} SELECT coalesce(m.id, ch.id) AS id, coalesce(ch.status, m.status) AS status, coalesce(ch.progress, m.progress) AS progress FROM m FULL JOIN ch ON m.id = ch.id",
    "doc_update": f"WITH {MATCHES}, {CHANGES} SELECT m.id, user_id, coalesce(ch.status, m.status) AS status, coalesce(ch.progress, m.progress) AS progress FROM m LEFT JOIN ch ON m.id = ch.id",
    "doc_insert_absent": f"WITH {MATCHES}, {CHANGES} SELECT id, status FROM m UNION ALL SELECT id, coalesce(status, 'uploading') FROM ch WHERE id NOT IN (SELECT id FROM m)",
    "doc_delete": f"WITH {MATCHES} SELECT id, user_id FROM m WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "reprocess_reset": f"WITH {MATCHES} SELECT id, CASE WHEN ok THEN 'processing' ELSE status END AS status, CASE WHEN ok THEN 0 ELSE progress END AS progress, CASE WHEN NOT ok AND status = 'completed' THEN id % 7 END AS home_goals, CASE WHEN NOT ok AND id % 4 = 0 THEN 'failed ' || CAST(id AS VARCHAR) END AS error_message FROM (SELECT *, id % 2 = 0 AND id % 10 <> 0 AND video_url IS NOT NULL AS ok FROM m)",
    "upload_gate": f"""WITH {FILES}, g AS (SELECT *, string_split(path, '/') AS parts, path LIKE 'videos/%' AND len(string_split(path, '/')) >= 4 AS in_place, content_type = 'video/mp4' OR path LIKE '%.mp4' AS is_video FROM f)
        SELECT path, size, parts[2] AS user_part, parts[3] AS match_part, in_place, is_video, size < 524288000 AS rules_size, size <= 524288000 AS trigger_size, in_place AND is_video AND size <= 524288000 AS accepted FROM g""",
    "prefix_listing": f"WITH {FILES} SELECT path, size FROM f WHERE starts_with(path, 'videos/1')",
    "rule_check": f"WITH {USERS} SELECT s_suppkey AS id, u.id IS NOT NULL AS owner_known, coalesce(u.role IN ('player', 'coach', 'club-owner'), false) AS role_allowed, length(trim(s_name)) > 0 AS named, s_suppkey % 25 <= 20 AS roster_fits FROM supplier LEFT JOIN u ON u.id = s_nationkey",
    "immutable_fields": "SELECT c_custkey AS id, c_custkey % 9 <> 0 OR lower(c_name) = upper(lower(c_name)) AS email_kept, true AS role_kept FROM customer",
    "request_check": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS match_id, CASE WHEN o_orderkey % 6 < 2 THEN 'matchId must not be empty' END AS error FROM orders",
    "progress_stages": f"WITH {FRAMES} SELECT match_id, frame_seq, least(90, 20 + {big('floor(70 * (5 * (frame_seq + 1) / 18000.0::DOUBLE))')}) AS loop, 20 + {big('floor(frame_seq / 60.0::DOUBLE * 65)')} AS frame, least(5, {big('floor(least(100, frame_seq) / 100.0::DOUBLE * 6)')}) AS stage FROM fr",
    "probe_parse": f"SELECT o_orderkey AS id, {jr('CASE WHEN o_orderkey % 9 = 0 THEN 30 WHEN o_orderkey % 4 = 0 THEN 30000.0::DOUBLE / 1001 WHEN o_orderkey % 4 = 1 THEN 25 ELSE 30 END', 3)} AS fps, CASE WHEN o_orderkey % 9 = 0 THEN 0.0::DOUBLE ELSE (o_orderkey % 5400)::DOUBLE END AS duration, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 2 = 0 THEN 1280 ELSE 1920 END AS width, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 2 = 0 THEN 720 ELSE 1080 END AS height FROM orders",
    "pred_explode": f"WITH {FRAMES} SELECT d.match_id, d.frame_seq, det_ord, class_id, {jr('x', 3)} AS x, {jr('y', 3)} AS y FROM det d JOIN place p ON p.match_id = d.match_id AND p.frame_seq = d.frame_seq WHERE p.ball_x IS NOT NULL UNION ALL SELECT match_id, frame_seq, NULL, NULL, NULL, NULL FROM place WHERE ball_x IS NULL",
    "sampled_frames": f"WITH {FRAMES} SELECT match_id, frame_seq, 'nth' AS sampler FROM fr WHERE (frame_seq + 1) % 5 = 0 UNION ALL SELECT match_id, frame_seq, 'time' FROM fr WHERE frame_seq % 2 = 0 AND frame_seq < 60",
    "even_seeks": f"SELECT match_id, i, {jr('duration / 7 * i', 6)} AS ts_s FROM (SELECT user_id AS match_id, count(*) * 5.0::DOUBLE AS duration FROM events GROUP BY user_id), range(1, 7) r(i)",
    "status_transitions": f"WITH {STATUSES} SELECT id, seq AS at, was FROM tr",
    "stream_transitions": f"WITH {STATUSES} SELECT id, seq AS at, was FROM tr",
    "live_status": f"WITH {STATUSES} SELECT id, max_by(status, seq) AS status, max(seq) AS at FROM sc GROUP BY id",
    "upload_starts": f"""WITH {FILES}, {MATCHES} SELECT CAST(m.id AS VARCHAR) AS id, CAST(m.user_id AS VARCHAR) AS user_id, path AS video_url, 'processing' AS status FROM f JOIN m ON string_split(path, '/')[3] = CAST(m.id AS VARCHAR) AND string_split(path, '/')[2] = CAST(m.user_id AS VARCHAR)
        WHERE m.status = 'uploading' AND path LIKE 'videos/%' AND len(string_split(path, '/')) >= 4 AND (content_type = 'video/mp4' OR path LIKE '%.mp4') AND size <= 524288000""",
    "notifications": f"WITH {STATUSES}, {USERS} SELECT tr.id AS user_id, seq AS at, fcm_token FROM tr JOIN u ON u.id = tr.id WHERE fcm_token IS NOT NULL",
    "last_n_crops": f"WITH {FRAMES} SELECT match_id, track_id, frame_seq * 100 + det_ord AS seq FROM det WHERE class_id IN (1, 2) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY seq DESC) <= 500",
    "str_hash": "WITH RECURSIVE h AS (SELECT c_custkey AS id, c_name AS s, 0 AS i, 5381::BIGINT AS v FROM customer UNION ALL SELECT id, s, i + 1, xor((v * 33) & 4294967295, ascii(s[i + 1])::BIGINT) FROM h WHERE i < length(s)) SELECT id, v AS seed FROM h WHERE i = length(s)",
    "xorshift": f"""WITH RECURSIVE d AS (
        SELECT c_custkey AS id, -1::BIGINT AS n, xor(c_custkey, 3735928559) & 4294967295 AS c FROM customer
        UNION ALL SELECT id, n + 1, xor(b, (b << 5) & 4294967295) AS c FROM (
            SELECT id, n, xor(a, ((CASE WHEN a >= 2147483648 THEN a - 4294967296 ELSE a END) >> 17) & 4294967295) AS b FROM (
                SELECT id, n, xor(c, (c << 13) & 4294967295) AS a FROM d WHERE n < 4))
    ) SELECT id, n, {jr("c / 4294967295.0::DOUBLE", 9)} AS value FROM d WHERE n >= 0""",
}

SINGLE |= {
    "user_check": f"WITH {USERS} SELECT id, id % 6 <> 0 AS complete, role IN ('player', 'coach', 'club-owner') AS role_allowed FROM u",
    "write_rules": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS id, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS asker,
        CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS op,
        o_orderkey % 7 <> 0 AND (o_orderkey % 3 <> 1 OR o_orderkey % 5 <> 0 OR o_orderstatus NOT IN ('F', 'O')) AS allowed FROM orders""",
    "match_by_id": f"WITH {MATCHES} SELECT id, user_id, title, status FROM m WHERE id = 1",
    "teams_of_user": "SELECT s_suppkey AS id, s_nationkey::BIGINT AS user_id, s_name AS name, s_suppkey % 25 AS n_players FROM supplier WHERE s_nationkey = 3",
    "matches_of_all": f"WITH {MATCHES} SELECT id, user_id, status FROM m",
    "matches_of_user": f"WITH {MATCHES} SELECT id, title FROM m WHERE user_id = 4 ORDER BY created_at DESC, id DESC LIMIT 20",
    "publish_stats": f"{flat(ELEVEN)}, {MATCHES} SELECT id, CASE WHEN match_id IS NULL THEN status ELSE 'completed' END AS status, CASE WHEN match_id IS NULL THEN progress ELSE 100 END AS progress, home_goals, away_xg FROM m LEFT JOIN flat ON match_id = id",
    "audit_append": " UNION ALL ".join(f"SELECT id, seq AS at, 'match_{to}' AS action FROM (SELECT id, seq, status, lag(status) OVER (PARTITION BY id ORDER BY seq) AS was FROM sc) WHERE status = '{to}' AND was <> '{to}'" for to in ("completed", "error")),
    "team_removal": "SELECT n_nationkey::BIGINT AS id, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FILTER (WHERE s_suppkey <> least_one), '') AS teams FROM nation LEFT JOIN (SELECT *, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS least_one FROM supplier) ON s_nationkey = n_nationkey GROUP BY 1",
    "url_sets": """SELECT o_orderkey AS id, coalesce(string_agg(url, ',' ORDER BY url), '') AS urls FROM orders LEFT JOIN (
        SELECT l_orderkey, 'videos/' || CASE WHEN l_linenumber % 3 = 0 THEN 'TRUCK' ELSE l_returnflag END AS url FROM lineitem UNION SELECT o_orderkey, 'videos/TRUCK' FROM orders WHERE o_orderkey % 3 = 0
    ) ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "stream_live_status": SINGLE["live_status"],
    "stream_steps": f"WITH RECURSIVE {events(ELEVEN)} SELECT st.match_id, st.frame_seq, prev_owner, {jr('step', 3)} AS step, corner.frame_seq IS NOT NULL AS corner FROM st LEFT JOIN corner USING (match_id, frame_seq) WHERE step IS NOT NULL",
    "jersey_features": f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: {big('floor(abs(v::DOUBLE) * 1000)')} % 256) AS b FROM embeddings), px AS (
        SELECT vec_id, n, b[3*i+1] AS b, b[3*i+2] AS g, b[3*i+3] AS r FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, ((len(b) // 15) // 2) * 5 AS n FROM c))
    ), deg AS (
        SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS span, CASE WHEN r >= g AND r >= b THEN 60.0::DOUBLE * (g - b) WHEN g >= b THEN 60.0::DOUBLE * (b - r) ELSE 60.0::DOUBLE * (r - g) END AS turn, CASE WHEN r >= g AND r >= b THEN CASE WHEN g < b THEN 360 ELSE 0 END WHEN g >= b THEN 120 ELSE 240 END AS base FROM px
    ), h AS (
        SELECT vec_id, v, CASE WHEN span = 0 THEN 0 ELSE {big('floor((base + turn / span) / 2 + 0.5)')} % 180 END AS h, CASE WHEN v = 0 THEN 0 ELSE floor(span * 255.0::DOUBLE / v + 0.5) END AS s FROM deg
    ) SELECT vec_id, {jr('avg(h)', 4)} AS hue, {jr('avg(s)', 4)} AS saturation, {jr('avg(v)', 4)} AS value FROM h GROUP BY vec_id""",
}
SINGLE["audit_append"] = f"WITH {STATUSES} " + SINGLE["audit_append"]

SINGLE["heat_viz"] = f"SELECT match_id, team, x, y, {jr('intensity * 20', 3)} AS radius, {jr('intensity * 0.35::DOUBLE', 4)} AS opacity FROM ({SINGLE['heatmap_hist']})"
SINGLE["edge_viz"] = f"WITH {edges(ELEVEN)} SELECT match_id, edge_seq, greatest(1.0::DOUBLE, count / 5.0::DOUBLE) AS width, {jr('accuracy * 100', 0)} AS percent FROM edge"
SINGLE["track_sides"] = f"WITH {FRAMES} SELECT match_id, CASE WHEN track_id % 3 <> 0 AND track_id % 2 = 1 THEN 'away' ELSE 'home' END AS team_side, count(*) AS n FROM det WHERE class_id IN (1, 2) GROUP BY ALL"
SINGLE["file_order"] = f"WITH {FILES}, g AS (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, path FROM f) SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path) AS place FROM g"

SQL = {**SINGLE, **paired()}
_joined = lambda name, text, order, where="": f"(SELECT match_id, string_agg({text}, ',' ORDER BY {order}) AS t, count(*) AS n FROM ({SQL[name]}) {where} GROUP BY match_id)"
EVENT_TEXT = "CAST(event_seq AS VARCHAR) || ':' || CAST(frame_seq AS VARCHAR) || ':' || type || ':' || team_side"
SQL["match_document"] = f"""SELECT f.match_id, home_goals, away_xg, home_pct, coalesce(h.n, 0) AS n_heat, narrative, coalesce(m.t, '') AS momentum, coalesce(e.t, '') AS events, coalesce(n.t, '') AS nodes, coalesce(g.t, '') AS edges
FROM ({SQL['match_summary']}) f LEFT JOIN ({SQL['narrative_b']}) w USING (match_id)
LEFT JOIN {_joined('heatmap_hist', "''", 'x')} h USING (match_id) LEFT JOIN {_joined('momentum_eleven', "CAST(minute AS VARCHAR) || ':' || " + fx('home', 1), 'minute')} m USING (match_id)
LEFT JOIN {_joined('events_eleven', EVENT_TEXT, 'event_seq', f'WHERE event_seq <= {ELEVEN.event_cap}')} e USING (match_id)
LEFT JOIN {_joined('pass_nodes_eleven', "CAST(node_seq AS VARCHAR) || ':' || player_id || ':' || CAST(involvement AS VARCHAR)", 'node_seq')} n USING (match_id)
LEFT JOIN {_joined('pass_edges_eleven', "from_id || ':' || to_id || ':' || CAST(count AS VARCHAR)", 'edge_seq')} g USING (match_id)"""
