"""Registered queries: sources and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgefuse.operators import evaluation as EV
from judgefuse.operators import metrics as M
from judgefuse.plans import fixtures as fx
from judgefuse.plans.registry import register
from judgefuse.sources import records as R

CASE = "concat('web_', doc_id % 50, '_', doc_id)"
PRED_SQL = f"""
pred AS (
  SELECT {CASE} AS case_name,
         CAST(CASE WHEN doc_id % 17 <> 0 THEN 1 - toxic END AS INTEGER) AS os_agent_score,
         concat('{{"0": {{"result": "', CASE WHEN toxic = 0 THEN 'Pass' ELSE 'Fail' END,
                '", "evidence": "doc ', doc_id, ' item 0", "case_desc": "q', quality, '"}}}}') AS evidence,
         doc_id, quality, toxic
  FROM labels)"""
GT_SQL = """
gt AS (
  SELECT concat('web_', doc_id % 50) AS web_id, CAST(doc_id AS VARCHAR) AS task_id, quality AS label,
         concat('code ', doc_id) AS code, doc_id AS ord
  FROM labels WHERE doc_id % 11 <> 0)"""


@register("prediction_scan", ops="A3", sql="WITH" + PRED_SQL + " SELECT case_name, os_agent_score, evidence FROM pred")
def q_prediction_scan(spark, sf):
    return R.prediction_scan(fx.predictions(spark, sf))


@register("gt_scan", ops="A4", sql="WITH" + GT_SQL + """,
b AS (SELECT concat('web_', doc_id % 50, '_', doc_id) AS case_name, quality AS label, doc_id AS ord
      FROM labels WHERE doc_id % 11 <> 0)
SELECT web_id, task_id, label, ord, concat(web_id, '_', task_id) AS case_name, 'webdevjudge' AS layout FROM gt
UNION ALL
SELECT NULL, NULL, label, ord, case_name, 'realdevbench' FROM b""")
def q_gt_scan(spark, sf):
    a = R.gt_scan(fx.gt_webdev(spark, sf), "webdevjudge").withColumn("layout", F.lit("webdevjudge"))
    b = R.gt_scan(fx.gt_realdev(spark, sf), "realdevbench")
    b = b.select(F.lit(None).cast("string").alias("web_id"), F.lit(None).cast("string").alias("task_id"),
                 "label", "ord", "case_name", F.lit("realdevbench").alias("layout"))
    return a.select("web_id", "task_id", "label", "ord", "case_name", "layout").unionByName(b)


@register("gt_lookup_last_wins", ops="A5", sql="""
WITH g AS (
  SELECT concat('web_', doc_id % 50, '_', CAST(doc_id % 97 AS VARCHAR)) AS key, quality AS label, doc_id AS ord
  FROM labels WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0)
SELECT key, arg_max(label, ord) AS value FROM g GROUP BY key""")
def q_gt_lookup(spark, sf):
    return R.gt_lookup(fx.gt_lines(spark, sf), composite=True)


_CODE_SQL = """
WITH c AS (SELECT l.*, d.text AS told FROM labels l JOIN documents d USING (doc_id))"""


@register("code_evidence_norm", ops="A6", sql=_CODE_SQL + """
SELECT concat('web_', doc_id % 50, '_', CAST(doc_id AS VARCHAR)) AS test_case_id,
       CAST(quality = 1 AS INTEGER) AS code_evidence, told AS code_evidence_reason,
       CAST(toxic = 0 AS INTEGER) AS label, 'webdevjudge' AS layout FROM c
UNION ALL
SELECT concat('web_', doc_id % 50, '_', doc_id), quality, told, 1 - toxic, 'realdevbench' FROM c""")
def q_code_evidence(spark, sf):
    a = R.code_evidence(fx.code_evidence_webdev(spark, sf), "webdevjudge").withColumn("layout", F.lit("webdevjudge"))
    b = R.code_evidence(fx.code_evidence_realdev(spark, sf), "realdevbench").withColumn("layout", F.lit("realdevbench"))
    return a.unionByName(b)


@register("code_review_accuracy", ops="E17", doubles=("accuracy",), sql=_CODE_SQL + """
SELECT count(*) AS n, avg(CASE WHEN CAST(toxic = 0 AS INTEGER) = CAST(quality = 1 AS INTEGER) THEN 1.0 ELSE 0.0 END) AS accuracy
FROM c""")
def q_code_acc(spark, sf):
    return R.code_review_accuracy(fx.code_evidence_webdev(spark, sf))


GUI_FLAT_SQL = """
gui_src AS (
  SELECT concat('web_', (event_id // 2) % 50, '_', event_id // 2) AS project_name, event_id, event_type, value,
         CAST(event_id % 3 + 1 AS INTEGER) AS n, event_id % 4 = 0 AS is_flat
  FROM events),
gui_acts AS (
  SELECT g.*, i FROM gui_src g JOIN generate_series(1, 3) AS s(i) ON s.i <= g.n
  WHERE NOT g.is_flat OR s.i = 1),
gui_rows AS (
  SELECT project_name AS test_case_id,
         concat(project_name, '_iter_', CASE WHEN is_flat THEN event_id % 5 + 1 ELSE i END) AS action_id,
         concat(event_type, ' op ', i) AS operation_desc,
         concat('thought ', i) AS reflection_thought,
         CASE WHEN event_type IN ('error', 'purchase') AND i = n
                THEN concat('Tell ({"0": {"result": "', CASE WHEN event_type = 'purchase' THEN 'Pass' ELSE 'Fail' END,
                            '", "evidence": "event ', event_id, ': ',
                            list_extract(['search results updated', 'no visible change', 'modal opened',
                                          'page stuck loading', 'navigated to target page'],
                                         CAST(event_id % 5 + 1 AS INTEGER)), '"}})')
              WHEN event_type = 'signup' THEN 'Stop()'
              WHEN event_id % 23 = 0 THEN NULL
              ELSE concat('Click (', event_id % 97, ')') END AS action_content,
         CASE WHEN event_type = 'click' AND i = 1
              THEN (CASE WHEN event_id % 5 <> 0 THEN CAST(value >= 20 AS INTEGER) ELSE 0 END)
              ELSE -1 END AS gui_evidence,
         event_id AS ord, i AS pos
  FROM gui_acts)"""


@register("gui_evidence_flatten", ops="A7 C7", sql="WITH" + GUI_FLAT_SQL + """
SELECT test_case_id, action_id, operation_desc, reflection_thought, action_content, gui_evidence FROM gui_rows""")
def q_gui_flatten(spark, sf):
    return R.gui_evidence_flatten(fx.gui_records(spark, sf))


@register("upsert_latest", ops="A11 I4", sql="""
WITH o AS (SELECT concat('p', doc_id // 3) AS project_name, quality AS score, 'old' AS note, doc_id AS ord, 0 AS v FROM labels),
n AS (SELECT concat('p', doc_id // 2) AS project_name, toxic AS score, 'new' AS note, doc_id AS ord, 1 AS v
      FROM labels WHERE doc_id % 4 = 0),
u AS (SELECT * FROM o UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY v DESC, ord DESC) AS rn FROM u)
SELECT project_name, score, note, ord FROM r WHERE rn = 1""")
def q_upsert(spark, sf):
    lb = fx.table(spark, sf, "labels")
    old = lb.select(F.concat(F.lit("p"), F.expr("doc_id div 3")).alias("project_name"),
                    F.col("quality").alias("score"), F.lit("old").alias("note"), F.col("doc_id").alias("ord"))
    new = lb.filter(F.col("doc_id") % 4 == 0).select(
        F.concat(F.lit("p"), F.expr("doc_id div 2")).alias("project_name"),
        F.col("toxic").alias("score"), F.lit("new").alias("note"), F.col("doc_id").alias("ord"))
    return R.upsert_latest(old, new, "project_name")


@register("multitest_explode", ops="B16", sql=f"""
SELECT concat({CASE}, '_', CAST(k + 1 AS VARCHAR)) AS case_name, score AS os_agent_score,
       concat('doc ', doc_id, ' item ', k) AS evidence
FROM (SELECT doc_id, 0 AS k, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS score FROM labels
      UNION ALL SELECT doc_id, 1, CASE WHEN quality = 1 THEN 1 ELSE 0 END FROM labels)""")
def q_multitest(spark, sf):
    return EV.multitest_explode(fx.predictions(spark, sf), "evidence_batch")


@register("gt_pred_metrics", ops="D4 E5 E6", doubles=("precision", "recall", "f1", "accuracy"), sql="WITH" + PRED_SQL + "," + GT_SQL + """,
j AS (SELECT g.label, p.os_agent_score FROM (SELECT *, concat(web_id, '_', task_id) AS case_name FROM gt) g
      JOIN pred p USING (case_name) WHERE p.os_agent_score IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND os_agent_score = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND os_agent_score = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND os_agent_score = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND os_agent_score = 0) AS tn, count(*) AS total FROM j),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1,
       round(CASE WHEN total > 0 THEN (tp + tn) / total ELSE 0.0 END, 4) AS accuracy, total FROM r""")
def q_gt_pred_metrics(spark, sf):
    gt = R.gt_scan(fx.gt_webdev(spark, sf), "webdevjudge")
    pred = R.prediction_scan(fx.predictions(spark, sf))
    return EV.run_evaluation(gt, pred)


@register("project_pairs", ops="D10", sql="""
SELECT concat('web_', doc_id % 50) AS case_name, concat('tc_', doc_id) AS testcase, quality AS gt_label,
       1 - toxic AS agent_score
FROM labels WHERE doc_id % 3 <> 0""")
def q_project_pairs(spark, sf):
    lb = fx.table(spark, sf, "labels")
    gt = lb.select(F.concat(F.lit("web_"), F.col("doc_id") % 50).alias("case_name"),
                   F.concat(F.lit("tc_"), F.col("doc_id")).alias("testcase"), F.col("quality").alias("gt_label"))
    ag = lb.filter(F.col("doc_id") % 3 != 0).select(
        F.concat(F.lit("web_"), F.col("doc_id") % 50).alias("case_name"),
        F.concat(F.lit("tc_"), F.col("doc_id")).alias("testcase"), (F.lit(1) - F.col("toxic")).alias("agent_score"))
    return EV.project_pairs(gt, ag)


@register("verdict_totals", ops="E18", sql="WITH" + PRED_SQL + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE os_agent_score = 1) AS n_pass,
       count(*) FILTER (WHERE os_agent_score = 0) AS n_fail FROM pred""")
def q_verdict_totals(spark, sf):
    return M.verdict_totals(fx.predictions(spark, sf))
