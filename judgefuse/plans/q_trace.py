"""Registered queries: trace-log parsing and the log evidence pipeline
(B6-B11, B17, C13, C14, D9, E14, E15, H18).

The fixture logs are generated from event ids; the oracle states what every
parser must recover from the parameters that generated the text (it never
parses), so the round trip text -> parsed fields is checked end to end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from judgefuse.operators import tracelog as TL
from judgefuse.plans import fixtures as fx
from judgefuse.plans.registry import register
from judgefuse.session import shared_folder
from judgefuse.sources.sinks import drop_folder

PARAMS_SQL = """
WITH it AS (
  SELECT event_id AS e, concat('log_', event_id) AS project_name, CAST(g.i AS INTEGER) AS iter_num,
         CAST(event_id % 6 + 1 AS INTEGER) AS n, coalesce(concat(chr(10), d.text), '') AS told
  FROM events JOIN generate_series(1, 6) AS g(i) ON g.i <= event_id % 6 + 1 LEFT JOIN documents d ON d.doc_id = event_id),
f AS (
  SELECT *, (e * 97 + iter_num * 13) % 1500 + 100 AS x, (e * 61 + iter_num * 7) % 800 + 100 AS y,
         (e * 3 + iter_num) % 3 AS ak, (e + iter_num) % 5 <> 0 AS has_op, (e + iter_num) % 7 <> 0 AS has_refl,
         (e + iter_num) % 4 AS rk, (e + 2 * iter_num) % 3 AS tk, (e + iter_num) % 2 = 0 AS hit,
         (e * iter_num) % 9 <> 4 AS has_screen, e % 8 <> 0 AS has_hist, e % 6 <> 0 AS has_image FROM it),
own AS (
  SELECT *,
    CASE WHEN has_refl THEN (CASE rk WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END) END AS reflection,
    CASE WHEN has_op THEN regexp_replace(concat('Click item ', iter_num, ' of ', e, told), '\\s+$', '') END AS op_block,
    CASE WHEN has_op THEN (CASE ak WHEN 0 THEN concat('pyautogui.click(', x, ', ', y, ')')
                                 WHEN 1 THEN 'pyautogui.typewrite(''abc'')'
                                 ELSE 'Tell ({"0": {"result": "Pass", "evidence": "ok"}})' END) END AS action_own,
    CASE WHEN has_op AND ak = 0 THEN regexp_replace(concat('Click item ', iter_num, ' of ', e, told), '\\s+$', '') END AS op_own,
    CASE WHEN has_op AND ak = 0 THEN CAST(x AS INTEGER) END AS cx_own,
    CASE WHEN has_op AND ak = 0 THEN CAST(y AS INTEGER) END AS cy_own,
    CASE tk WHEN 0 THEN concat('Page ', e, ' changed after step ', iter_num, '.')
            WHEN 1 THEN concat('Button ', iter_num, ' now enabled.') END AS rt_own,
    CASE WHEN has_screen THEN 2 + least((e + iter_num) % 4, 3) ELSE 0 END AS n_el FROM f),
outc AS (
  SELECT *, cx_own IS NOT NULL AS gate,
    CASE WHEN cx_own IS NULL THEN NULL WHEN NOT has_image THEN 0 WHEN n_el = 0 THEN 0
         ELSE CAST(hit AS INTEGER) END AS accuracy,
    CASE WHEN cx_own IS NULL THEN NULL WHEN NOT has_image THEN 'no_image' WHEN n_el = 0 THEN 'element_tree_failed'
         ELSE 'element_tree' END AS method,
    CASE WHEN cx_own IS NOT NULL AND has_image AND n_el > 0 AND hit THEN 'element_0' END AS matched_element_id,
    cx_own IS NOT NULL AND n_el > 0 AS has_distance_sorting FROM own),
fin AS (
  SELECT *, CASE WHEN cx_own IS NOT NULL AND has_image THEN accuracy END AS coordinate_match,
    CASE WHEN has_hist THEN concat('hist op ', iter_num, ' of ', e) ELSE op_own END AS operation_desc,
    CASE WHEN has_hist THEN (CASE WHEN iter_num % 2 = 1
              THEN concat('pyautogui.click(', (e + iter_num * 11) % 1000, ', ', (e + iter_num * 17) % 700, ')')
              ELSE 'pyautogui.press(''enter'')' END) ELSE action_own END AS action_content,
    CASE WHEN has_hist THEN concat('hist refl ', iter_num) ELSE rt_own END AS reflection_thought,
    CASE WHEN has_hist AND iter_num % 2 = 1 THEN CAST((e + iter_num * 11) % 1000 AS INTEGER) ELSE cx_own END AS click_x,
    CASE WHEN has_hist AND iter_num % 2 = 1 THEN CAST((e + iter_num * 17) % 700 AS INTEGER) ELSE cy_own END AS click_y
  FROM outc)"""

SORTED_SQL = """,
boxes AS (
  SELECT own.*, g.idx, CASE WHEN hit THEN x - 10 ELSE x + 200 END AS bx1, CASE WHEN hit THEN y - 10 ELSE y + 150 END AS by1,
    CASE WHEN hit THEN x + 30 ELSE x + 240 END AS bx2, CASE WHEN hit THEN y + 20 ELSE y + 180 END AS by2
  FROM own JOIN (SELECT unnest([0, 4, 8, 9, 10]) AS idx) g ON g.idx < 8 + (e + iter_num) % 4
  WHERE has_screen AND cx_own IS NOT NULL),
dist AS (
  SELECT *, CASE idx WHEN 0 THEN bx1 WHEN 4 THEN x + 60 ELSE (idx - 8) * 10 + 12 END AS ax1,
    CASE idx WHEN 0 THEN by1 WHEN 4 THEN y + 40 ELSE 1050 END AS ay1,
    CASE idx WHEN 0 THEN bx2 WHEN 4 THEN x + 120 ELSE (idx - 8) * 10 + 17 END AS ax2,
    CASE idx WHEN 0 THEN by2 WHEN 4 THEN y + 60 ELSE 1060 END AS ay2 FROM boxes),
sorted AS (
  SELECT project_name, iter_num, string_agg(concat('element_', idx, ':', CAST(round(1000 * d) AS BIGINT), ':',
      CAST(ax1 <= x AND x <= ax2 AND ay1 <= y AND y <= ay2 AS INTEGER)), '|' ORDER BY d, (ax2 - ax1) * (ay2 - ay1), idx) AS sorting
  FROM (SELECT *, sqrt(pow(x - (ax1 + ax2) / 2.0, 2) + pow(y - (ay1 + ay2) / 2.0, 2)) AS d FROM dist) GROUP BY ALL)"""

PIPE_COLS = ("project_name, iter_num, reflection, click_x, click_y, operation_desc, action_content, "
             "reflection_thought, coordinate_match, accuracy, method, matched_element_id, has_distance_sorting, sorting")


def _logs(spark, sf):
    return fx.trace_logs(spark, sf)


def _iters(spark, sf):
    return TL.parse_iterations(_logs(spark, sf))


def _pipeline(spark, sf, condition="all_clicks"):
    return TL.trace_log_pipeline(_logs(spark, sf), fx.trace_images(spark, sf), condition)


@register("log_iterations", ops="B6 A9", sql=PARAMS_SQL + """
,
h AS (
  SELECT e, regexp_replace(string_agg(concat('Step-', iter_num, ': Operation: hist op ', iter_num, ' of ', e, chr(10), 'Action: ',
      CASE WHEN iter_num % 2 = 1 THEN concat('pyautogui.click(', (e + iter_num * 11) % 1000, ', ', (e + iter_num * 17) % 700, ')')
           ELSE 'pyautogui.press(''enter'')' END, chr(10), 'Reflection_thought: hist refl ', iter_num, chr(10), chr(9),
      'Memory: mem ', iter_num, chr(10)), '' ORDER BY iter_num), '\\s+$', '') AS history
  FROM f WHERE has_hist GROUP BY e)
SELECT project_name, iter_num, CASE WHEN iter_num = n THEN coalesce(history, '') END AS history FROM f LEFT JOIN h USING (e)""")
def q_log_iterations(spark, sf):
    return TL.log_iterations(_logs(spark, sf)).select("project_name", "iter_num", "history")


@register("log_blocks", ops="A9 B6", sql=PARAMS_SQL + """
SELECT iter_num, md5(replace(op_block, 'Click item', 'Click #### iter:item')) AS operation_md5, action_own AS action FROM own""")
def q_log_blocks(spark, sf):
    """Logs written as text files and read in small splits; every operation holds a marker without a number."""
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    turns = _turns(fx.table(spark, sf, "events").count())
    for k in range(turns):
        _blocks_of_files(fx.trace_logs(spark, sf, k, turns), f"{folder}/texts-{k}", f"{folder}/blocks-{k}")
    return spark.read.parquet(*[f"{folder}/blocks-{k}" for k in range(turns)])


# The texts of logs are many times as large as the tables that they are built from: they are written, read and
# dropped in turns, so that the disk holds one turn's texts.  Few logs take fewer turns.
TURNS, LOGS_A_TURN = 32, 25_000


def _turns(logs: int) -> int:
    return max(1, min(TURNS, -(-logs // LOGS_A_TURN)))


def _blocks_of_files(logs, texts: str, to: str) -> None:
    """Write ``logs`` as text files below ``texts``, read their blocks from there, write what is compared (the
    digests, not the texts) to ``to`` and drop the texts."""
    spark = logs.sparkSession
    logs.select(F.replace("text", F.lit("Click item"), F.lit("Click #### iter:item")).alias("text")).write.text(texts)
    # The split size follows the size of the files (Spark's own rule) from 256k on.
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "256k")
    try:
        blocks = TL.parse_blocks(TL.read_log_blocks(spark, texts))
        blocks.select("iter_num", F.md5("operation").alias("operation_md5"), F.col("action_content").alias("action")) \
            .write.option("compression", "zstd").parquet(to)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        drop_folder(spark, texts)


@register("history_steps", ops="B7", sql=PARAMS_SQL + """
SELECT project_name, CAST(iter_num AS INTEGER) AS step_num, concat('hist op ', iter_num, ' of ', e) AS h_operation,
       CASE WHEN iter_num % 2 = 1 THEN concat('pyautogui.click(', (e + iter_num * 11) % 1000, ', ', (e + iter_num * 17) % 700, ')')
            ELSE 'pyautogui.press(''enter'')' END AS h_action,
       concat('hist refl ', iter_num) AS h_reflection,
       CASE WHEN iter_num % 2 = 1 THEN CAST((e + iter_num * 11) % 1000 AS INTEGER) END AS h_x,
       CASE WHEN iter_num % 2 = 1 THEN CAST((e + iter_num * 17) % 700 AS INTEGER) END AS h_y
FROM f WHERE has_hist""")
def q_history_steps(spark, sf):
    return TL.history_steps(_iters(spark, sf)).drop("k")


@register("element_lines", ops="B8", sql=PARAMS_SQL + """,
el AS (
  SELECT f.*, g.idx,
    CASE WHEN hit THEN x - 10 ELSE x + 200 END AS bx1, CASE WHEN hit THEN y - 10 ELSE y + 150 END AS by1,
    CASE WHEN hit THEN x + 30 ELSE x + 240 END AS bx2, CASE WHEN hit THEN y + 20 ELSE y + 180 END AS by2
  FROM f JOIN (SELECT unnest([0, 1, 3, 4, 5, 7, 8, 9, 10]) AS idx) g ON g.idx < 8 + (e + iter_num) % 4 WHERE has_screen)
SELECT project_name, iter_num, concat('element_', idx) AS el_id,
  CASE idx WHEN 0 THEN concat('btn', iter_num) WHEN 4 THEN concat('label', iter_num) WHEN 7 THEN 'logo' WHEN 8 THEN 'extra0' WHEN 9 THEN 'extra1' WHEN 10 THEN 'extra2' ELSE '' END AS ui_name,
  CASE idx WHEN 0 THEN 'Button' WHEN 1 THEN 'Text' WHEN 3 THEN 'Pane' WHEN 4 THEN 'Text' WHEN 5 THEN 'Group' WHEN 7 THEN 'Image' ELSE 'Button' END AS control_type,
  CAST(CASE WHEN idx < 2 THEN x WHEN idx = 3 THEN 960 WHEN idx < 6 THEN x + 90 ELSE 1 END AS INTEGER) AS cx,
  CAST(CASE WHEN idx < 2 THEN y WHEN idx = 3 THEN 540 WHEN idx < 6 THEN y + 50 ELSE 1 END AS INTEGER) AS cy,
  CAST(CASE idx WHEN 0 THEN bx1 WHEN 1 THEN bx1 WHEN 3 THEN 0 WHEN 4 THEN x + 60 WHEN 5 THEN x + 55 WHEN 7 THEN 0 ELSE (idx - 8) * 10 + 12 END AS INTEGER) AS x1,
  CAST(CASE idx WHEN 0 THEN by1 WHEN 1 THEN by1 WHEN 3 THEN 0 WHEN 4 THEN y + 40 WHEN 5 THEN y + 35 WHEN 7 THEN 0 ELSE 1050 END AS INTEGER) AS y1,
  CAST(CASE idx WHEN 0 THEN bx2 WHEN 1 THEN bx2 WHEN 3 THEN 1920 WHEN 4 THEN x + 120 WHEN 5 THEN x + 130 WHEN 7 THEN 10 ELSE (idx - 8) * 10 + 17 END AS INTEGER) AS x2,
  CAST(CASE idx WHEN 0 THEN by2 WHEN 1 THEN by2 WHEN 3 THEN 1080 WHEN 4 THEN y + 60 WHEN 5 THEN y + 70 WHEN 7 THEN 10 ELSE 1060 END AS INTEGER) AS y2
FROM el""")
def q_element_lines(spark, sf):
    return TL.element_lines(_iters(spark, sf)).select("project_name", "iter_num", "el_id", "ui_name",
                                                      "control_type", "cx", "cy", "x1", "y1", "x2", "y2")


@register("reflection_verdict", ops="B9", sql=PARAMS_SQL + " SELECT project_name, iter_num, reflection FROM own")
def q_reflection_verdict(spark, sf):
    return _iters(spark, sf).select("project_name", "iter_num", "reflection")


@register("operation_action_blocks", ops="B10", sql=PARAMS_SQL + """
SELECT project_name, iter_num, op_block AS operation, action_own AS action FROM own""")
def q_op_action(spark, sf):
    return _iters(spark, sf).select("project_name", "iter_num", "operation", F.col("action_content").alias("action"))


@register("reflection_text", ops="B11", sql=PARAMS_SQL + " SELECT project_name, iter_num, rt_own AS reflection_thought FROM own")
def q_reflection_text(spark, sf):
    return _iters(spark, sf).select("project_name", "iter_num",
                                    "reflection_thought")


@register("analysis_gate", ops="C13", sql=PARAMS_SQL + """
SELECT project_name, iter_num, gate AS gate_all_clicks, gate AND coalesce(reflection = 0, false) AS gate_error_only FROM outc""")
def q_analysis_gate(spark, sf):
    return _iters(spark, sf).select("project_name", "iter_num", TL.analysis_gate().alias("gate_all_clicks"),
                                    TL.analysis_gate("error_only").alias("gate_error_only"))


@register("hit_outcome", ops="C14", sql=PARAMS_SQL + """
SELECT project_name, iter_num, accuracy, method, matched_element_id, coordinate_match FROM fin""")
def q_hit_outcome(spark, sf):
    return _pipeline(spark, sf).select("project_name", "iter_num", "accuracy", "method",
                                       "matched_element_id", "coordinate_match")


@register("history_to_iter", ops="D9", sql=PARAMS_SQL + """
SELECT project_name, iter_num, operation_desc, action_content, reflection_thought, click_x, click_y FROM fin""")
def q_history_to_iter(spark, sf):
    return _pipeline(spark, sf).select("project_name", "iter_num", "operation_desc", "action_content",
                                       "reflection_thought", "click_x", "click_y")


def _sorting():
    """The distance list as text, for the comparison."""
    return F.array_join(F.transform("element_distance_sorting", lambda e: F.concat_ws(
        ":", e["el_id"], F.round(1000 * e["distance"]).cast("long").cast("string"), e["is_inside"].cast("int").cast("string"))), "|")


@register("trace_log_pipeline", ops="H18 F1", sql=PARAMS_SQL + SORTED_SQL + f"""
SELECT {PIPE_COLS} FROM fin LEFT JOIN sorted USING (project_name, iter_num)""")
def q_trace_pipeline(spark, sf):
    return _pipeline(spark, sf).withColumn("sorting", _sorting()).drop("seg", "element_distance_sorting")


@register("trace_log_error_only", ops="H18 C13", sql=PARAMS_SQL + """
SELECT project_name, iter_num, CASE WHEN reflection = 0 THEN accuracy END AS accuracy,
       CASE WHEN reflection = 0 THEN method END AS method,
       CASE WHEN reflection = 0 THEN matched_element_id END AS matched_element_id FROM fin""")
def q_trace_error_only(spark, sf):
    return _pipeline(spark, sf, "error_only").select("project_name", "iter_num", "accuracy", "method", "matched_element_id")


@register("coordinate_summary", ops="E14", sql=PARAMS_SQL + """
SELECT count(*) FILTER (WHERE click_x IS NOT NULL) AS total_coordinate_cases,
       count(*) FILTER (WHERE method IS NOT NULL) AS successfully_analyzed,
       count(*) FILTER (WHERE method IN ('element_tree', 'element_tree_failed'))
         + count(*) FILTER (WHERE has_distance_sorting) AS element_tree_cases,
       count(*) FILTER (WHERE method IN ('element_tree', 'element_tree_failed')) AS element_tree_cases_clean,
       count(*) FILTER (WHERE method = 'element_tree' AND accuracy = 1) AS element_tree_matched,
       count(*) FILTER (WHERE method IS NOT NULL AND method NOT IN ('element_tree', 'element_tree_failed')) AS mllm_cases
FROM fin""")
def q_coordinate_summary(spark, sf):
    return TL.coordinate_summary(_pipeline(spark, sf))


@register("annotation_summary", ops="E15", sql=PARAMS_SQL + """
SELECT count(*) AS total_iters, count(reflection) AS reflection_found,
       count(*) FILTER (WHERE reflection = 0) AS error_cases, count(coordinate_match) AS coordinate_analyzed,
       count(action_content) AS action_found, count(reflection_thought) AS reflection_thought_found,
       count(*) FILTER (WHERE has_distance_sorting) AS element_tree_found
FROM fin""")
def q_annotation_summary(spark, sf):
    return TL.annotation_summary(_pipeline(spark, sf))


_ANS = ["' 1 '", "concat('0', chr(10))", "'10'", "'yes'", "'1 1'", "concat(chr(10), ' 0 0')"]


@register("answer_validity", ops="B17", sql=f"""
WITH a AS (SELECT event_id, concat(list_extract([{', '.join(_ANS)}], CAST(event_id % 6 + 1 AS INTEGER)),
      CASE WHEN event_id % 4 <> 0 THEN concat(chr(10), coalesce(text, '')) ELSE '' END) AS answer
    FROM events LEFT JOIN documents ON doc_id = event_id),
c AS (SELECT *, replace(replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), chr(10), ''), ' ', '') AS clean FROM a)
SELECT event_id, md5(answer) AS answer_md5, contains(clean, '1') <> contains(clean, '0') AS valid,
       CASE WHEN contains(clean, '1') THEN 1 ELSE 0 END AS value FROM c""")
def q_answer_validity(spark, sf):
    """The answers of three events of four go on with the whole text of the document of that id, digits included."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), "text")
    answers = F.array(F.lit(" 1 "), F.lit("0\n"), F.lit("10"), F.lit("yes"), F.lit("1 1"), F.lit("\n 0 0"))
    more = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.lit(""))
    a = fx.table(spark, sf, "events").select("event_id").join(docs, "event_id", "left").select("event_id", F.concat(
        F.element_at(answers, (F.col("event_id") % 6 + 1).cast("int")), more).alias("answer"))
    valid, value = TL.answer_validity("answer")
    return a.select("event_id", F.md5("answer").alias("answer_md5"), valid.alias("valid"), value.alias("value"))
