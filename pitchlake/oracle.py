"""The queries' results stated in DuckDB SQL, from the event log on."""

from __future__ import annotations

F3 = "match_id, period, frame"
SIDE = "(SELECT DISTINCT m AS match_id, 1 AS period, 'home' AS team, 1 AS sign FROM wp UNION ALL SELECT DISTINCT m, 1, 'away', -1 FROM wp)"


def nx(x: str) -> str:
    return f"CASE WHEN sign < 0 THEN 105.0 - {x} ELSE {x} END"


def ny(y: str) -> str:
    return f"CASE WHEN sign < 0 THEN 68.0 - {y} ELSE {y} END"


def box(x: str, y: str) -> str:
    return f"({x} >= 105.0 - 16.5 AND abs({y} - 34.0) <= 20.16)"


FEATURES = ["ball_x", "ball_y", "ball_speed", "goal_dist", "att_x", "att_y", "def_x", "def_y", "compactness", "pressure", "att_in_box", "deepest_x", "beyond", "nearest_goal"]


def feature_sql(source: str, keys: str) -> str:
    """Features of frames; source has keys, team (in attack), q_team, is_gk, x, y, bx, by, bspeed, all normalised, one row a player."""
    att, dfn = "NOT is_gk AND q_team = team", "NOT is_gk AND q_team <> team"
    return f"""SELECT {keys}, any_value(bx) AS ball_x, any_value("by") AS ball_y, any_value(bspeed) AS ball_speed,
 sqrt((105.0 - any_value(bx)) * (105.0 - any_value(bx)) + (34.0 - any_value("by")) * (34.0 - any_value("by"))) AS goal_dist,
 avg(x) FILTER ({att}) AS att_x, avg(y) FILTER ({att}) AS att_y, avg(x) FILTER ({dfn}) AS def_x, avg(y) FILTER ({dfn}) AS def_y,
 sqrt(var_pop(x) FILTER ({dfn}) + var_pop(y) FILTER ({dfn})) AS compactness,
 count(*) FILTER ({dfn} AND sqrt((x - bx) * (x - bx) + (y - "by") * (y - "by")) <= 5.0)::DOUBLE AS pressure,
 count(*) FILTER ({att} AND {box("x", "y")})::DOUBLE AS att_in_box, max(x) FILTER ({att}) AS deepest_x,
 count(*) FILTER ({att} AND x > last_x)::DOUBLE AS beyond, min(sqrt((105.0 - x) * (105.0 - x) + (34.0 - y) * (34.0 - y))) FILTER ({att}) AS nearest_goal
 FROM (SELECT *, max(x) FILTER ({dfn}) OVER (PARTITION BY {keys}) AS last_x FROM {source}) GROUP BY {keys}"""


def logistic(weights: dict[str, float]) -> str:
    return "1.0 / (1.0 + exp(-(" + " + ".join(str(w) if not n else f"{w} * coalesce({n}, 0.0)" for n, w in weights.items()) + ")))"


V1 = {"": -2.0, "ball_x": 0.02, "ball_speed": 0.005, "goal_dist": -0.05, "att_x": 0.02, "def_x": -0.01, "compactness": 0.02, "pressure": -0.2, "att_in_box": 0.3}
V2 = {"": -2.0, "deepest_x": 0.03, "nearest_goal": -0.04, "beyond": 0.4, "goal_dist": -0.02}
MEANS = ", ".join(f"avg({f}) AS {f}" for f in FEATURES)

STEPS: dict[str, str] = {
    "ev": "SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS v, user_id AS u, event_type, event_id // 943 AS m, event_id % 23 AS j, (event_id % 943) // 23 AS k FROM events",
    "wp": """SELECT m, j, k, v, event_type, CASE WHEN m % 4 = 3 THEN 25 ELSE 10 END AS fps,
 CASE WHEN j = 0 THEN 6000 WHEN j = 11 THEN 99000 ELSE (CASE WHEN j <= 10 THEN 22000 + ((j - 1) % 5) * 12000 ELSE 83000 - ((j - 12) % 5) * 12000 END) + (31 * v + 17 * u + 13 * id) % 24001 - 12000 END AS x0,
 CASE WHEN j IN (0, 11) THEN 34000 ELSE 34000 + ((7 * j) % 11 - 5) * 5000 + (29 * v + 11 * u + 19 * id) % 16001 - 8000 END AS y0
 FROM ev WHERE m < (SELECT max(m) FROM ev)""",
    "pos": """SELECT m, j, k, fps, k * n + i AS frame, (x0 * n + (x1 - x0) * i + 1000000000000) // n - 1000000000000 // n AS mx, (y0 * n + (y1 - y0) * i + 1000000000000) // n - 1000000000000 // n AS my
 FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT m, j, k, fps, 3 * fps AS n, x0, y0, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM wp WHERE j < 22 WINDOW w AS (PARTITION BY m, j ORDER BY k)) WHERE k < 40)""",
    "own": "SELECT m, block, CASE WHEN c < 10 THEN c + 1 ELSE c + 2 END AS j FROM (SELECT m, k // 3 AS block, min(v) % 20 AS c FROM wp WHERE j = 22 GROUP BY ALL)",
    "tracking": """SELECT m AS match_id, 1 AS period, frame, fps, frame * 1000 // fps AS t_ms, j AS player_id, CASE WHEN j = 22 THEN 'ball' WHEN j <= 10 THEN 'home' ELSE 'away' END AS team, mx / 1000.0::DOUBLE AS x, my / 1000.0::DOUBLE AS y
 FROM (SELECT m, j, fps, frame, mx, my FROM pos UNION ALL SELECT m, 22, fps, frame, mx + 500, my + 300 FROM pos JOIN own USING (m, j) WHERE k // 3 = block)""",
    "roster": """SELECT match_id, player_id, team, CASE WHEN player_id IN (0, 11) THEN 'GK' WHEN a = 0 THEN 'CB' WHEN a <= 2 THEN 'MF' ELSE 'FW' END AS role, player_id IN (0, 11) AS is_gk
 FROM (SELECT *, CASE WHEN player_id <= 10 THEN (player_id - 1) % 5 ELSE (player_id - 12) % 5 END AS a FROM (SELECT DISTINCT match_id, player_id, team FROM tracking WHERE team <> 'ball'))""",
    "matches": "SELECT DISTINCT m AS match_id, fps, fps = 25 AS has_shots FROM wp",
    "side": f"SELECT * FROM {SIDE}",
    "shots": "SELECT wp.m AS match_id, 1 AS period, k * 3 * fps AS frame, fps, CASE WHEN own.j <= 10 THEN 'home' ELSE 'away' END AS team FROM wp JOIN own ON wp.m = own.m AND k // 3 = block WHERE wp.j = 22 AND event_type = 'error' AND wp.m % 4 = 3 AND k < 40",
    "kin": """SELECT *, dx * fps AS vx, dy * fps AS vy, sqrt(dx * dx + dy * dy) AS step, sqrt(dx * dx + dy * dy) * fps AS speed FROM (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN x - lag(x) OVER w END AS dx, CASE WHEN frame - lag(frame) OVER w = 1 THEN y - lag(y) OVER w END AS dy
 FROM tracking WINDOW w AS (PARTITION BY match_id, period, player_id ORDER BY frame))""",
    "ball": f"SELECT {F3}, x AS ballx, y AS bally, speed AS bspeed FROM kin WHERE team = 'ball'",
    "carrier": f"""SELECT * FROM (SELECT p.match_id, p.period, p.frame, p.fps, p.t_ms, p.player_id, p.team AS team_raw, sqrt((x - ballx) * (x - ballx) + (y - bally) * (y - bally)) AS dist
 FROM tracking p JOIN ball USING ({F3}) WHERE p.team <> 'ball' AND player_id NOT IN (0, 11) QUALIFY row_number() OVER (PARTITION BY {F3} ORDER BY dist, player_id) = 1) WHERE dist <= 3.0""",
    "smooth": """SELECT *, CASE WHEN vote > 0 THEN 'home' WHEN vote < 0 THEN 'away' ELSE team_raw END AS team FROM (SELECT *, sum(CASE WHEN team_raw = 'home' THEN 1 ELSE -1 END) OVER (PARTITION BY match_id, period ORDER BY t_ms RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS vote FROM carrier)""",
    "framed": """SELECT * FROM (SELECT *, min(frame) OVER g AS f_start, max(frame) OVER g AS f_end, count(*) OVER g AS n_frames
 FROM (SELECT *, sum(new) OVER (PARTITION BY match_id, period ORDER BY frame) AS possession_id FROM (SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR frame - lag(frame) OVER w <> 1 OR team <> lag(team) OVER w THEN 1 ELSE 0 END AS new FROM smooth WINDOW w AS (PARTITION BY match_id, period ORDER BY frame)))
 WINDOW g AS (PARTITION BY match_id, period, possession_id)) WHERE n_frames * 1000 >= 3000 * fps""",
    "poss": "SELECT DISTINCT match_id, period, possession_id::BIGINT AS possession_id, team, fps, f_start, f_end, n_frames, n_frames * 1000 // fps AS duration_ms FROM framed",
    "runs": f"""SELECT concat_ws('-', match_id, period, player_id, min(frame)) AS run_id, match_id, period, possession_id::BIGINT AS possession_id, player_id, any_value(team) AS team, any_value(fps) AS fps, min(frame) AS f_start, max(frame) AS f_end, count(*) AS n_frames, count(*) * 1000 // any_value(fps) AS duration_ms, sum(step) AS distance
 FROM (SELECT k.match_id, k.period, k.frame, k.fps, k.player_id, k.team, k.step, f.possession_id, k.frame - row_number() OVER (PARTITION BY k.match_id, k.period, f.possession_id, k.player_id ORDER BY k.frame) AS island
 FROM kin k JOIN framed f USING ({F3}) WHERE k.speed > 4.0 AND k.team = f.team AND k.player_id <> f.player_id AND k.player_id NOT IN (0, 11)) GROUP BY match_id, period, possession_id, player_id, island
 HAVING count(*) * 1000 >= 1000 * any_value(fps) AND sum(step) >= 5.0""",
    "players": f"SELECT t.match_id, t.period, t.frame, t.fps, t.player_id, t.team AS q_team, t.player_id IN (0, 11) AS is_gk, t.x, t.y, ballx, bally, bspeed FROM tracking t JOIN ball USING ({F3}) WHERE t.team <> 'ball'",
    "ends": f"""SELECT run_id, pt, e.player_id, e.team, q.player_id AS q_id, q_team, is_gk, {nx("x")} AS x, {ny("y")} AS y, {nx("ballx")} AS bx
 FROM (SELECT run_id, match_id, period, player_id, team, 0 AS pt, f_start AS frame FROM runs UNION ALL SELECT run_id, match_id, period, player_id, team, 1, f_end FROM runs) e JOIN players q USING ({F3}) JOIN side s ON s.match_id = e.match_id AND s.period = e.period AND s.team = e.team""",
    "me": "SELECT run_id, pt, x AS mx, y AS my, bx FROM ends WHERE q_id = player_id",
    "near": "SELECT run_id, pt, q_id, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS d FROM ends JOIN me USING (run_id, pt) WHERE q_team <> team AND NOT is_gk QUALIFY row_number() OVER (PARTITION BY run_id, pt ORDER BY d, q_id) = 1",
    "line": "SELECT run_id, pt, mx > greatest(x, me.bx, 52.5) AS past FROM (SELECT * FROM ends WHERE q_team <> team QUALIFY row_number() OVER (PARTITION BY run_id, pt ORDER BY x DESC) = 2) JOIN me USING (run_id, pt)",
    "geo": """SELECT r.*, m0.mx AS x_start, m0.my AS y_start, m1.mx AS x_end, m1.my AS y_end, n0.q_id AS nearest_def, n0.d AS space_before, n1.d AS space_after, sqrt((d1.x - d0.x) * (d1.x - d0.x) + (d1.y - d0.y) * (d1.y - d0.y)) AS def_displacement, l1.past AND NOT l0.past AS behind_line
 FROM runs r JOIN me m0 ON m0.run_id = r.run_id AND m0.pt = 0 JOIN me m1 ON m1.run_id = r.run_id AND m1.pt = 1 JOIN near n0 ON n0.run_id = r.run_id AND n0.pt = 0 JOIN near n1 ON n1.run_id = r.run_id AND n1.pt = 1
 JOIN ends d0 ON d0.run_id = r.run_id AND d0.pt = 0 AND d0.q_id = n0.q_id JOIN ends d1 ON d1.run_id = r.run_id AND d1.pt = 1 AND d1.q_id = n0.q_id JOIN line l0 ON l0.run_id = r.run_id AND l0.pt = 0 JOIN line l1 ON l1.run_id = r.run_id AND l1.pt = 1""",
    "labelled": """SELECT g.*, CASE WHEN has_shots THEN EXISTS (SELECT 1 FROM shots s WHERE s.match_id = g.match_id AND s.period = g.period AND s.team = g.team AND s.frame * 1000 // s.fps > g.f_end * 1000 // g.fps AND s.frame * 1000 // s.fps <= g.f_end * 1000 // g.fps + 5000) END AS shot_5s FROM geo g JOIN matches USING (match_id)""",
    "win": "SELECT match_id, period, possession_id, team, fps, w_start, w_start + 3 * fps - 1 AS w_end FROM (SELECT *, unnest(range(f_start, f_end + 2 - 3 * fps, fps)) AS w_start FROM poss)",
    "held": f"""SELECT f.match_id, f.period, f.frame, f.possession_id::BIGINT AS possession_id, f.team, f.fps, p.player_id, q_team, is_gk, {nx("x")} AS x, {ny("y")} AS y, {nx("ballx")} AS bx, {ny("bally")} AS "by", bspeed FROM framed f JOIN players p USING ({F3}) JOIN side s ON s.match_id = f.match_id AND s.period = f.period AND s.team = f.team""",
    "ff": feature_sql("held", f"{F3}, possession_id, team, fps"),
    "wf": f"SELECT w.match_id, w.period, w.possession_id, w.w_start, w.team, w.fps, w_end, {MEANS} FROM win w JOIN ff f ON f.match_id = w.match_id AND f.period = w.period AND f.possession_id = w.possession_id AND f.frame BETWEEN w_start AND w_end GROUP BY ALL",
    "wv": f"SELECT *, {logistic(V1)} AS v1, {logistic(V2)} AS v2 FROM wf",
    "ahead": f"""SELECT w.match_id, w.period, w.possession_id, w.w_start, w.team, {nx("ballx")} AS bx, {ny("bally")} AS "by", CASE WHEN s.sign > 0 THEN rear_away ELSE 105.0 - rear_home END AS rear
 FROM win w JOIN (SELECT {F3}, any_value(ballx) AS ballx, any_value(bally) AS bally, list_sort(list(x) FILTER (q_team = 'away'), 'DESC')[2] AS rear_away, list_sort(list(x) FILTER (q_team = 'home'))[2] AS rear_home FROM players GROUP BY ALL) p ON p.match_id = w.match_id AND p.period = w.period AND p.frame BETWEEN w_end + 1 AND w_end + 5 * w.fps
 JOIN side s ON s.match_id = w.match_id AND s.period = w.period AND s.team = w.team""",
    "wl": f"""SELECT w.*, coalesce(box_entry, false) AS box_entry, coalesce(line_break, false) AS line_break, CASE WHEN has_shots THEN EXISTS (SELECT 1 FROM shots s WHERE s.match_id = w.match_id AND s.period = w.period AND s.team = w.team AND s.frame BETWEEN w_end + 1 AND w_end + 5 * w.fps) END AS shot
 FROM win w LEFT JOIN (SELECT match_id, period, possession_id, w_start, bool_or({box("bx", '"by"')}) AS box_entry, bool_or(bx > rear) AS line_break FROM ahead GROUP BY ALL) USING (match_id, period, possession_id, w_start) JOIN matches USING (match_id)""",
    "gained": """SELECT *, v_after - v_before AS value_gained FROM (SELECT run_id, arg_max(v1, w_end) FILTER (w_end <= f_start) AS v_before, arg_max(v1, w_end) FILTER (w_end <= r.f_end) AS v_after FROM runs r LEFT JOIN wv w ON w.match_id = r.match_id AND w.period = r.period AND w.possession_id = r.possession_id AND w_end <= r.f_end GROUP BY run_id)""",
    "drift": """SELECT run_id, coalesce(avg(vx * sign), 0.0) AS drift_x, coalesce(avg(vy * sign), 0.0) AS drift_y FROM runs r JOIN kin k ON k.match_id = r.match_id AND k.period = r.period AND k.player_id = r.player_id AND k.frame BETWEEN f_start - (500 * r.fps) // 1000 AND f_start JOIN side s ON s.match_id = r.match_id AND s.period = r.period AND s.team = r.team GROUP BY run_id""",
    "cfrows": f"""SELECT run_id, q.frame, r.team, q_team, is_gk, variant, {nx("ballx")} AS bx, {ny("bally")} AS "by", bspeed, 3 * r.fps AS wide,
 CASE WHEN q.player_id <> r.player_id OR q.frame < f_start OR variant = 'actual' THEN {nx("x")} WHEN variant = 'frozen' THEN x_start ELSE least(greatest(x_start + drift_x * ((q.frame - f_start) / r.fps::DOUBLE), 0.0), 105.0) END AS x,
 CASE WHEN q.player_id <> r.player_id OR q.frame < f_start OR variant = 'actual' THEN {ny("y")} WHEN variant = 'frozen' THEN y_start ELSE least(greatest(y_start + drift_y * ((q.frame - f_start) / r.fps::DOUBLE), 0.0), 68.0) END AS y
 FROM geo r JOIN drift USING (run_id) JOIN players q ON q.match_id = r.match_id AND q.period = r.period AND q.frame BETWEEN f_end - 3 * r.fps + 1 AND f_end JOIN side s ON s.match_id = r.match_id AND s.period = r.period AND s.team = r.team, (VALUES ('actual'), ('frozen'), ('drift')) AS t(variant)""",
    "cff": feature_sql("cfrows", "run_id, frame, variant, team, wide"),
    "cfv": f"SELECT run_id, variant, CASE WHEN n = wide THEN {logistic(V1)} END AS v1, CASE WHEN n = wide THEN {logistic(V2)} END AS v2 FROM (SELECT run_id, variant, any_value(wide) AS wide, count(*) AS n, {MEANS} FROM cff GROUP BY run_id, variant)",
    "cf": "SELECT run_id, " + ", ".join(f"max({v}) FILTER (variant = '{n}') AS {v}_{n}" for v in ("v1", "v2") for n in ("actual", "frozen", "drift")) + ", " + ", ".join(f"max({v}) FILTER (variant = 'actual') - max({v}) FILTER (variant = '{n}') AS cf_gain_{v}_{n}" for v in ("v1", "v2") for n in ("frozen", "drift")) + " FROM runs LEFT JOIN cfv USING (run_id) GROUP BY run_id",
    "found": """SELECT l.*, role AS def_role, coalesce(x_start < c0.cx AND x_end > c1.cx AND abs(y_end - 34.0) > abs(c1.cy - 34.0), false) AS overlap FROM labelled l LEFT JOIN roster r ON r.match_id = l.match_id AND r.player_id = nearest_def
 LEFT JOIN carried c0 ON c0.run_id = l.run_id AND c0.pt = 0 LEFT JOIN carried c1 ON c1.run_id = l.run_id AND c1.pt = 1""",
    "close": f"""SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN (lag(d) OVER w - d) * fps END AS closing FROM (SELECT f.match_id, f.period, f.frame, f.fps, f.possession_id::BIGINT AS possession_id, f.player_id AS carrier_id, q.player_id, sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y)) AS d
 FROM framed f JOIN players c USING ({F3}, player_id) JOIN players q ON q.match_id = f.match_id AND q.period = f.period AND q.frame = f.frame AND q.q_team <> f.team AND NOT q.is_gk) WINDOW w AS (PARTITION BY match_id, period, possession_id, player_id, carrier_id ORDER BY frame)""",
    "pressers": """SELECT match_id, period, possession_id, player_id, any_value(fps) AS fps, min(frame) AS f_start, max(frame) AS f_end FROM (SELECT *, frame - row_number() OVER (PARTITION BY match_id, period, possession_id, player_id ORDER BY frame) AS island FROM close WHERE d <= 8.0 AND closing > 2.0) GROUP BY match_id, period, possession_id, player_id, island HAVING count(*) * 1000 >= 500 * any_value(fps)""",
    "presses": """SELECT concat_ws('-', g.match_id, g.period, g.f_start) AS press_id, g.match_id, g.period, g.possession_id, g.f_start, g.f_end, g.f_start * 1000 // g.fps - p_start * 1000 // g.fps AS reaction_ms, n_pressers, coalesce(next_team <> team AND next_start * 1000 // g.fps - g.f_end * 1000 // g.fps <= 5000, false) AS forced_turnover
 FROM (SELECT match_id, period, possession_id, n, any_value(fps) AS fps, min(f_start) AS f_start, max(f_end) AS f_end, count(DISTINCT player_id) AS n_pressers FROM (SELECT *, sum(new) OVER (PARTITION BY match_id, period, possession_id ORDER BY f_start, f_end, player_id) AS n
 FROM (SELECT *, CASE WHEN f_start > coalesce(max(f_end) OVER (PARTITION BY match_id, period, possession_id ORDER BY f_start, f_end, player_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM pressers)) GROUP BY match_id, period, possession_id, n) g
 JOIN (SELECT match_id, period, possession_id, team, f_start AS p_start, lead(team) OVER w AS next_team, lead(f_start) OVER w AS next_start FROM poss WINDOW w AS (PARTITION BY match_id, period ORDER BY f_start)) p USING (match_id, period, possession_id)""",
    "scores": "SELECT r.*, v_before, v_after, value_gained, cf.* EXCLUDE (run_id) FROM runs r LEFT JOIN gained USING (run_id) LEFT JOIN cf USING (run_id)",
}
STEPS = {k: v for k, v in STEPS.items() if k != "found"} | {
    "carried": f"""SELECT e.run_id, e.pt, {nx("q.x")} AS cx, {ny("q.y")} AS cy FROM (SELECT run_id, match_id, period, team, 0 AS pt, f_start AS frame FROM runs UNION ALL SELECT run_id, match_id, period, team, 1, f_end FROM runs) e JOIN framed f USING ({F3}) JOIN players q ON q.match_id = e.match_id AND q.period = e.period AND q.frame = e.frame AND q.player_id = f.player_id
 JOIN side s ON s.match_id = e.match_id AND s.period = e.period AND s.team = e.team""",
    "found": STEPS["found"],
}


def needed(final: str) -> str:
    """The steps that a final SELECT rests on, in order, before it."""
    import re

    words, want, stack = (lambda s: set(re.findall(r"\b\w+\b", s))), set(), [final]
    while stack:
        for name in (words(stack.pop()) & STEPS.keys()) - want:
            want.add(name)
            stack.append(STEPS[name])
    if not want:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in STEPS.items() if n in want) + "\n" + final


def rounded(names: list[str], source: str = "") -> str:
    return ", ".join(f"round({source}{n}, 6) + 0::DOUBLE AS {n}" for n in names)  # + 0: no negative zero
