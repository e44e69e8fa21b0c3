"""Registered queries: trajectory parsing and pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgefuse.functions import text as TX
from judgefuse.operators import trajectory as TR
from judgefuse.plans import fixtures as fx
from judgefuse.plans.q_spatial import ELEMENTS_SQL
from judgefuse.plans.registry import register

L = TX.sql_lit
_X = "concat(CAST((conv_id * 37 + turn * 11) % 1920 AS VARCHAR), CASE WHEN turn % 2 = 1 THEN '.5' ELSE '' END)"
_Y = "concat(CAST((conv_id * 13 + turn * 7) % 1080 AS VARCHAR), CASE WHEN turn % 2 = 1 THEN '.5' ELSE '' END)"
_X2 = "CAST((conv_id * 37 + turn * 11 + 100) % 1920 AS VARCHAR)"
_Y2 = "CAST((conv_id * 13 + turn * 7 + 50) % 1080 AS VARCHAR)"


def _pt(a, b):
    return f"concat('''<point>', {a}, ' ', {b}, '</point>''')"


_ACT = f"""CASE WHEN conv_id % 11 = 0 AND turn % 2 = 0 THEN concat('open_app name', turn)
  WHEN conv_id % 11 = 0 THEN 'launch(app)'
  ELSE CASE (conv_id + turn) % 9
    WHEN 0 THEN concat('click(point=', {_pt(_X, _Y)}, ')')
    WHEN 1 THEN concat('left_double(point=', {_pt(_X, _Y)}, ')')
    WHEN 2 THEN concat('right_single(point=', {_pt(_X, _Y)}, ')')
    WHEN 3 THEN concat('drag(start_point=', {_pt(_X, _Y)}, ', end_point=', {_pt(_X2, _Y2)}, ')')
    WHEN 4 THEN concat('type(content=''hello ', conv_id, ' ', turn, ''')')
    WHEN 5 THEN concat('scroll(point=', {_pt(_X, _Y)}, ', direction=''down'')')
    WHEN 6 THEN 'hotkey(key=''ctrl c'')'
    WHEN 7 THEN 'wait()'
    ELSE concat('finished(content=''done ', conv_id, ''')') END END"""


def _strip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _grp(e, pat, i):
    return f"regexp_extract({e}, {L(pat)}, {i})"


def _int(e):
    return f"CAST(trunc(CAST({e} AS DOUBLE)) AS INTEGER)"


TRAJ_SQL = f"""
turns AS (
  SELECT conv_id AS task, turn, role,
         CASE WHEN role <> 'assistant' THEN text
              WHEN conv_id % 11 = 0 THEN concat(text, chr(10), 'Action: ', act)
              ELSE concat('Thought: ', text, chr(10), 'Action: ', act) END AS content
  FROM (SELECT *, {_ACT} AS act FROM conversations)),
asst AS (
  SELECT task, turn, content,
         CASE WHEN regexp_matches(content, {L(TX.THOUGHT_RE)}) THEN {_strip(_grp('content', TX.THOUGHT_RE, 1))} ELSE '' END AS thought,
         CASE WHEN regexp_matches(content, {L(TX.ACTION_RE)}) THEN {_strip(_grp('content', TX.ACTION_RE, 1))} ELSE '' END AS action
  FROM turns WHERE role = 'assistant')"""

F_ = TX.ACTION_FORMS


def _m(form):
    return f"regexp_matches(a, {L(F_[form])})"


def _xy(form, i, j):
    return f"concat('(', {_int(_grp('a', F_[form], i))}, ', ', {_int(_grp('a', F_[form], j))}, ')')"


GRAMMAR_SQL = f""",
pa AS (
  SELECT task, turn, a,
    CASE WHEN {_m('click')} THEN 'click' WHEN {_m('left_double')} THEN 'left_double'
         WHEN {_m('right_single')} THEN 'right_single' WHEN {_m('drag')} THEN 'drag'
         WHEN {_m('type')} THEN 'type' WHEN {_m('scroll')} THEN 'scroll' WHEN {_m('hotkey')} THEN 'hotkey'
         WHEN starts_with(lower(a), 'wait') THEN 'wait' WHEN {_m('finished')} THEN 'finished'
         WHEN contains(a, '(') THEN split_part(a, '(', 1)
         WHEN a <> '' THEN regexp_split_to_array(a, '\\s+')[1] ELSE 'Unknown' END AS action_type,
    CASE WHEN {_m('click')} THEN {_xy('click', 1, 2)} WHEN {_m('left_double')} THEN {_xy('left_double', 1, 2)}
         WHEN {_m('right_single')} THEN {_xy('right_single', 1, 2)}
         WHEN {_m('drag')} THEN concat({_xy('drag', 1, 2)}, ' -> ', {_xy('drag', 3, 4)})
         WHEN {_m('type')} THEN {_grp('a', F_['type'], 1)}
         WHEN {_m('scroll')} THEN concat({_xy('scroll', 1, 2)}, '; ', {_grp('a', F_['scroll'], 3)})
         WHEN {_m('hotkey')} THEN {_grp('a', F_['hotkey'], 1)}
         WHEN starts_with(lower(a), 'wait') THEN NULL
         WHEN {_m('finished')} THEN {_grp('a', F_['finished'], 1)} ELSE a END AS action_target,
    CASE WHEN {_m('click')} THEN {_int(_grp('a', F_['click'], 1))} WHEN {_m('left_double')} THEN {_int(_grp('a', F_['left_double'], 1))}
         WHEN {_m('right_single')} THEN {_int(_grp('a', F_['right_single'], 1))} WHEN {_m('drag')} THEN {_int(_grp('a', F_['drag'], 1))}
         WHEN {_m('type')} THEN NULL WHEN {_m('scroll')} THEN {_int(_grp('a', F_['scroll'], 1))} END AS x,
    CASE WHEN {_m('click')} THEN {_int(_grp('a', F_['click'], 2))} WHEN {_m('left_double')} THEN {_int(_grp('a', F_['left_double'], 2))}
         WHEN {_m('right_single')} THEN {_int(_grp('a', F_['right_single'], 2))} WHEN {_m('drag')} THEN {_int(_grp('a', F_['drag'], 2))}
         WHEN {_m('type')} THEN NULL WHEN {_m('scroll')} THEN {_int(_grp('a', F_['scroll'], 2))} END AS y
  FROM (SELECT task, turn, {_strip("coalesce(action, '')")} AS a FROM asst))"""

CODES_SQL = f""",
codes AS (
  SELECT conv_id AS task, turn AS code_no,
         CASE WHEN (conv_id + turn) % 4 <> 0 THEN concat(chr(10), 'pyautogui.click(', CAST((conv_id * 5 + turn * 3) % 1920 AS VARCHAR),
              '.25, ', CAST((conv_id * 3 + turn * 5) % 1080 AS VARCHAR), ', button=''left'')') ELSE 'FAILED' END AS code
  FROM conversations WHERE role = 'assistant'),
cc AS (
  SELECT task, code_no, {_int(_grp('code', TX.CODE_CLICK_RE, 1))} AS x, {_int(_grp('code', TX.CODE_CLICK_RE, 2))} AS y,
         row_number() OVER (PARTITION BY task ORDER BY code_no) - 1 AS pos
  FROM codes WHERE regexp_matches(code, {L(TX.CODE_CLICK_RE)})),
shots AS (
  SELECT conv_id AS task, turn AS shot_no, (conv_id * 7 + turn) // 28 AS screen_id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS mt FROM conversations WHERE role = 'assistant')
  WHERE NOT (conv_id % 4 = 0 AND turn = mt)),
tk AS (
  SELECT DISTINCT conv_id AS task, concat('web_', conv_id % 10) AS web_id, CAST(conv_id AS VARCHAR) AS task_id,
         CASE WHEN conv_id % 3 <> 0 THEN 'DONE' ELSE 'FAILED' END AS final_result,
         CASE WHEN conv_id % 5 <> 0 THEN concat('task ', conv_id) END AS instruction
  FROM conversations),
paired AS (
  SELECT a.task, a.pos, CAST(a.pos + 1 AS INTEGER) AS iter_num, s.screen_id, a.thought, a.action, p.action_type, p.action_target,
         coalesce(p.x, c.x) AS click_x, CASE WHEN p.x IS NOT NULL THEN p.y ELSE c.y END AS click_y
  FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY turn) - 1 AS pos FROM asst) a
  JOIN pa p USING (task, turn) JOIN shots s USING (task, pos) LEFT JOIN cc c USING (task, pos))"""

_BASE = "WITH" + TRAJ_SQL


@register("thought_action_split", ops="B1", sql=_BASE + " SELECT task, turn, thought, action FROM asst")
def q_thought_action(spark, sf):
    return TR.parsed_turns(fx.turns(spark, sf)).select("task", "turn", "thought", "action")


@register("action_grammar", ops="B2", sql=_BASE + GRAMMAR_SQL + " SELECT task, turn, action_type, action_target, x, y FROM pa")
def q_action_grammar(spark, sf):
    return TR.parsed_turns(fx.turns(spark, sf)).select("task", "turn", "action_type", "action_target", "x", "y")


@register("code_click_coords", ops="B3", sql=_BASE + CODES_SQL + " SELECT task, code_no, pos, x, y FROM cc")
def q_code_click(spark, sf):
    from judgefuse.operators.ordering import group_positions
    c = fx.codes(spark, sf).select("task", "code_no", TX.code_click(F.col("code")).alias("xy")) \
        .filter(F.col("xy").isNotNull())
    c = group_positions(c, ["task"], ["code_no"], "pos")
    return c.select("task", "code_no", "pos", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"))


@register("last_assistant_thought", ops="B4", sql="WITH" + TRAJ_SQL + f""",
la AS (SELECT task, arg_max(content, turn) FILTER (WHERE role = 'assistant') AS c FROM turns GROUP BY task)
SELECT task, CASE WHEN c IS NULL THEN ''
                  WHEN regexp_matches(c, {L(TX.THOUGHT_LOOSE_RE)}) THEN {_strip(_grp('c', TX.THOUGHT_LOOSE_RE, 1))}
                  ELSE {_strip('c')} END AS last_thought FROM la""")
def q_last_thought(spark, sf):
    return TR.last_assistant_thought(fx.turns(spark, sf))


@register("verdict_rows", ops="B5", sql="WITH" + TRAJ_SQL + CODES_SQL + f""",
la AS (SELECT task, arg_max(content, turn) FILTER (WHERE role = 'assistant') AS c FROM turns GROUP BY task),
lt AS (SELECT task, CASE WHEN c IS NULL THEN ''
                  WHEN regexp_matches(c, {L(TX.THOUGHT_LOOSE_RE)}) THEN {_strip(_grp('c', TX.THOUGHT_LOOSE_RE, 1))}
                  ELSE {_strip('c')} END AS last_thought FROM la)
SELECT concat(web_id, '_', task_id) AS case_name, CAST(final_result = 'DONE' AS INTEGER) AS os_agent_score,
       CASE WHEN final_result = 'DONE' THEN 'Pass' ELSE 'Fail' END AS result,
       coalesce(last_thought, '') AS ev_evidence, coalesce(instruction, '') AS ev_case_desc
FROM tk LEFT JOIN lt USING (task)""")
def q_verdict_rows(spark, sf):
    v = TR.verdict_rows(fx.tasks(spark, sf), TR.last_assistant_thought(fx.turns(spark, sf)))
    ev = F.from_json("evidence", "map<string, struct<result: string, evidence: string, case_desc: string>>")["0"]
    return v.select("case_name", "os_agent_score", "result", ev["evidence"].alias("ev_evidence"),
                    ev["case_desc"].alias("ev_case_desc"))


@register("positional_pairing", ops="D6", sql=_BASE + GRAMMAR_SQL + CODES_SQL + """
SELECT task, iter_num, screen_id, action_type, click_x, click_y FROM paired""")
def q_positional_pairing(spark, sf):
    return TR.positional_pairing(fx.trajectories(spark, sf)) \
        .select("task", "iter_num", "screen_id", "action_type", "click_x", "click_y")


_FIN = TX.ACTION_FORMS["finished"]
PIPE_SQL = _BASE + GRAMMAR_SQL + CODES_SQL + "," + ELEMENTS_SQL + f""",
lastpos AS (SELECT task, max(pos) AS lp FROM paired GROUP BY task),
st AS (SELECT p.*, t.web_id, t.task_id, t.final_result, p.pos = l.lp AS is_last
       FROM paired p JOIN lastpos l USING (task) LEFT JOIN tk t USING (task)),
near AS (
  SELECT task, pos, el_id FROM (
    SELECT s.task, s.pos, e.el_id,
           row_number() OVER (PARTITION BY s.task, s.pos ORDER BY
             sqrt(pow(s.click_x - (e.x1 + e.x2) / 2.0, 2) + pow(s.click_y - (e.y1 + e.y2) / 2.0, 2)), e.pos, e.el_id) AS rn
    FROM st s JOIN el e ON e.screen_id = s.screen_id WHERE s.click_x IS NOT NULL) WHERE rn = 1),
listed AS (
  SELECT task, pos, string_agg(concat(el_id, ':', CAST(round(1000 * d) AS BIGINT)), '|' ORDER BY d, epos) AS sorting FROM (
    SELECT s.task, s.pos, e.el_id, e.pos AS epos,
           sqrt(pow(s.click_x - (e.x1 + e.x2) / 2.0, 2) + pow(s.click_y - (e.y1 + e.y2) / 2.0, 2)) AS d
    FROM st s JOIN el e ON e.screen_id = s.screen_id WHERE s.click_x IS NOT NULL) GROUP BY task, pos),
hit AS (
  SELECT s.task, s.pos, max(CASE WHEN e.x1 <= s.click_x AND s.click_x <= e.x2 AND e.y1 <= s.click_y AND s.click_y <= e.y2
                                 THEN 1 ELSE 0 END) AS accuracy
  FROM st s JOIN el e ON e.screen_id = s.screen_id WHERE s.click_x IS NOT NULL GROUP BY s.task, s.pos),
tell AS (
  SELECT *, CASE WHEN upper(coalesce(final_result, '')) = 'DONE' THEN 'Pass' ELSE 'Fail' END AS tres,
         CASE WHEN regexp_matches(coalesce(action, ''), {L(_FIN)}) AND coalesce(thought, '') <> ''
                THEN concat(thought, ' Final result: ', {_grp("coalesce(action, '')", _FIN, 1)})
              WHEN regexp_matches(coalesce(action, ''), {L(_FIN)}) THEN {_grp("coalesce(action, '')", _FIN, 1)}
              ELSE coalesce(thought, '') END AS ev0 FROM st),
pipe AS (
  SELECT concat(web_id, '_', task_id) AS project_name, task, iter_num, click_x, click_y,
         CASE WHEN thought <> '' THEN thought END AS operation_desc, action_type, action_target,
         CASE WHEN is_last THEN tres END AS tell_result,
         CASE WHEN is_last THEN (CASE WHEN ev0 = '' THEN concat('Task completed with status: ', coalesce(final_result, '')) ELSE ev0 END) END AS tell_evidence,
         CASE WHEN n.el_id IS NOT NULL THEN 1 END AS coordinate_match,
         CASE WHEN n.el_id IS NOT NULL THEN h.accuracy END AS accuracy,
         n.el_id AS matched_element_id,
         CASE WHEN is_last THEN final_result END AS final_result,
         CASE WHEN is_last THEN concat('Tell ({{"0":{{"result":"', tres, '","evidence":', CAST(to_json(
             CASE WHEN ev0 = '' THEN concat('Task completed with status: ', coalesce(final_result, '')) ELSE ev0 END) AS VARCHAR), '}}}})')
              WHEN action <> '' THEN action END AS action_content, l.sorting
  FROM tell LEFT JOIN near n USING (task, pos) LEFT JOIN hit h USING (task, pos) LEFT JOIN listed l USING (task, pos))"""


def trajectory_steps(spark, sf, **how):
    return TR.trajectory_steps(fx.trajectories(spark, sf), fx.tasks(spark, sf), fx.elements(spark, sf), **how)


@register("tell_format", ops="B13", sql=PIPE_SQL + """
SELECT project_name, iter_num, tell_result, tell_evidence FROM pipe WHERE tell_result IS NOT NULL""")
def q_tell_format(spark, sf):
    return trajectory_steps(spark, sf).filter(F.col("tell_result").isNotNull()) \
        .select("project_name", "iter_num", "tell_result", "tell_evidence")


@register("trajectory_pipeline", ops="H19", sql=PIPE_SQL + " SELECT * EXCLUDE (task) FROM pipe")
def q_trajectory_pipeline(spark, sf):
    listed = F.array_join(F.transform("element_distance_sorting", lambda e: F.concat_ws(
        ":", e["el_id"].cast("string"), F.round(1000 * e["distance"]).cast("long").cast("string"))), "|")
    return trajectory_steps(spark, sf).withColumn("sorting", listed).drop("task", "element_distance_sorting")


@register("trajectory_assume_hit", ops="H19", sql=PIPE_SQL + """
SELECT project_name, iter_num, CASE WHEN coordinate_match = 1 THEN 1 END AS accuracy FROM pipe""")
def q_trajectory_assume_hit(spark, sf):
    return trajectory_steps(spark, sf, assume_hit=True).select("project_name", "iter_num", "accuracy")


@register("trajectory_records", ops="H19 E16", sql=PIPE_SQL + """
SELECT project_name, string_agg(concat(iter_num, ':', coalesce(CAST(matched_element_id AS VARCHAR), '')), '|' ORDER BY iter_num) AS steps,
       max(final_result) AS final_result, count(*) AS total_iters,
       count(*) FILTER (WHERE coordinate_match = 1) AS coordinate_cases, count(*) FILTER (WHERE accuracy = 1) AS coordinate_hits
FROM pipe GROUP BY project_name""")
def q_trajectory_records(spark, sf):
    told = F.array_join(F.transform("results", lambda r: F.concat(
        r["iter_num"].cast("string"), F.lit(":"), F.coalesce(r["matched_element_id"].cast("string"), F.lit("")))), "|")
    return TR.nested_records(trajectory_steps(spark, sf)).select("project_name", told.alias("steps"), "final_result", "summary.*")


@register("run_totals", ops="E16", sql=PIPE_SQL + """
SELECT count(DISTINCT project_name) AS n_tasks, count(*) AS n_iters,
       count(*) FILTER (WHERE coordinate_match = 1) AS n_coordinate_cases FROM pipe""")
def q_run_totals(spark, sf):
    return TR.run_totals(TR.task_totals(trajectory_steps(spark, sf)))


@register("task_totals", ops="E16", sql=PIPE_SQL + """
SELECT project_name, count(*) AS total_iters, count(*) FILTER (WHERE coordinate_match = 1) AS coordinate_cases
FROM pipe GROUP BY project_name""")
def q_task_totals(spark, sf):
    return TR.task_totals(trajectory_steps(spark, sf))


_NS = "CASE WHEN regexp_matches(case_name, '^web_(\\d+)_(\\d+)') THEN CAST(regexp_extract(case_name, '^web_(\\d+)_(\\d+)', {i}) AS BIGINT) ELSE 0 END"
_CASES_SQL = """
WITH cn AS (SELECT CASE WHEN conv_id % 7 = 0 THEN concat('case_', conv_id)
                        ELSE concat('web_', conv_id % 10, '_', conv_id) END AS case_name
            FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _case_names(spark, sf):
    c = fx.table(spark, sf, "conversations").select("conv_id").distinct()
    return c.select(F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("case_"), F.col("conv_id")))
                    .otherwise(F.concat(F.lit("web_"), F.col("conv_id") % 10, F.lit("_"), F.col("conv_id")))
                    .alias("case_name"))


@register("natural_sort", ops="F3", sql=_CASES_SQL + f"""
SELECT case_name, {_NS.format(i=1)} AS sort_x, {_NS.format(i=2)} AS sort_y FROM cn ORDER BY sort_x, sort_y, case_name""")
def q_natural_sort(spark, sf):
    c = _case_names(spark, sf)
    x, y = TR.natural_sort_keys(F.col("case_name"))
    return c.select("case_name", x.alias("sort_x"), y.alias("sort_y")).orderBy("sort_x", "sort_y", "case_name")


TASK_LIMIT = 25


@register("task_limit", ops="F7", sql=_CASES_SQL + f"""
SELECT case_name FROM cn ORDER BY {_NS.format(i=1)}, {_NS.format(i=2)}, case_name LIMIT {TASK_LIMIT}""")
def q_task_limit(spark, sf):
    c = _case_names(spark, sf)
    x, y = TR.natural_sort_keys(F.col("case_name"))
    return c.orderBy(x, y, F.col("case_name")).limit(TASK_LIMIT)
