"""Registered queries: evidence assembly and case-grouped split
(B12, B14, B18, C8-C11, D1-D3, D5, D12, G1, I2, I3, E19, F4, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgefuse.functions import text as TX
from judgefuse.operators import assembly as A
from judgefuse.operators import metrics as M
from judgefuse.operators.ordering import group_positions
from judgefuse.plans import fixtures as fx
from judgefuse.plans import oracle as O
from judgefuse.plans.q_eval import GUI_FLAT_SQL, PRED_SQL
from judgefuse.plans.registry import register
from judgefuse.sources import records as R


def gui_rows(spark, sf):
    return R.gui_evidence_flatten(fx.gui_records(spark, sf), with_ord=True)


def merged(spark, sf):
    code = R.code_evidence(fx.code_evidence_webdev(spark, sf)).drop("code_evidence_reason")
    judge = fx.predictions(spark, sf).select(F.col("case_name").alias("test_case_id"),
                                             F.col("os_agent_score").alias("agent_judge"))
    return A.evidence_merge(code, judge, gui_rows(spark, sf))


def merged_back(spark, sf):
    m = merged(spark, sf)
    return A.tell_merge_back(m, A.tell_rows(m))


def training(spark, sf, with_gt=False):
    rows = A.stop_null_filter(merged_back(spark, sf))
    gt = R.gt_lookup(fx.gt_webdev(spark, sf), composite=True) if with_gt else None
    return A.train_rows(rows, gt)


_RULE_EV = TX.reflection_rules_sql("evidence")
MERGE_SQL = "WITH" + GUI_FLAT_SQL + "," + PRED_SQL + f""",
code AS (SELECT concat('web_', doc_id % 50, '_', CAST(doc_id AS VARCHAR)) AS test_case_id,
                CAST(quality = 1 AS INTEGER) AS code_evidence, CAST(toxic = 0 AS INTEGER) AS label
         FROM labels JOIN documents USING (doc_id)),
judge AS (SELECT case_name AS test_case_id, os_agent_score AS agent_judge FROM pred),
merged AS (
  SELECT c.test_case_id, c.code_evidence, c.label, j.agent_judge, g.action_id, g.ord, g.pos, g.operation_desc,
         g.action_content, g.gui_evidence
  FROM code c LEFT JOIN judge j USING (test_case_id) LEFT JOIN gui_rows g USING (test_case_id)),
tell_raw AS (
  SELECT action_id, ord, pos, string_split(action_content, '"evidence": ')[2] AS evidence
  FROM merged WHERE contains(action_content, 'Tell (')),
tells AS (
  SELECT action_id, ord, pos, evidence, CASE WHEN evidence IS NULL THEN '-1' ELSE {_RULE_EV} END AS agent_noresp
  FROM tell_raw),
tell_one AS (
  SELECT action_id, arg_max(agent_noresp, ord * 1000 + pos) AS agent_noresp, arg_max(evidence, ord * 1000 + pos) AS evidence
  FROM tells GROUP BY action_id),
back AS (SELECT m.*, t.agent_noresp, t.evidence FROM merged m LEFT JOIN tell_one t USING (action_id)),
kept AS (SELECT * FROM back WHERE action_content IS NOT NULL AND NOT contains(action_content, 'Stop')),
gtl AS (SELECT concat(concat('web_', doc_id % 50), '_', CAST(doc_id AS VARCHAR)) AS key,
               arg_max(quality, doc_id) AS value
        FROM labels WHERE doc_id % 11 <> 0 GROUP BY 1),
train AS (
  SELECT test_case_id, action_id AS step, ord, pos, label AS phi, operation_desc, action_content,
         CASE WHEN gui_evidence = -1 THEN 0.0 ELSE CAST(gui_evidence AS DOUBLE) END AS E1_gui,
         CAST(code_evidence AS DOUBLE) AS E2_code,
         CASE WHEN agent_noresp IS NOT NULL THEN CAST(agent_judge AS DOUBLE) END AS E3_reflect,
         CASE WHEN agent_noresp IS NOT NULL THEN (CASE WHEN agent_noresp = 'Yes' THEN 0.0 ELSE 1.0 END) ELSE 0.0 END AS E4_noresp,
         CASE WHEN agent_noresp IS NOT NULL OR gui_evidence = -1 THEN 1 ELSE 0 END AS M_gui,
         0 AS M_code, 1 AS M_reflect,
         CASE WHEN agent_noresp IS NOT NULL THEN 0 ELSE 1 END AS M_noresp,
         CASE WHEN agent_noresp IS NOT NULL THEN 0.5 ELSE 0.3 END AS weight,
         CAST(agent_noresp IS NOT NULL AS INTEGER) AS is_reflection,
         CAST(agent_judge AS DOUBLE) AS agent_testcase_score,
         CASE WHEN agent_judge IS NOT NULL AND g.value = 1 AND agent_judge = 0 THEN 1.0
              WHEN agent_judge IS NOT NULL AND g.value = 0 AND agent_judge = 1 THEN 0.0 END AS delta_label
  FROM kept LEFT JOIN gtl g ON g.key = kept.test_case_id)"""

TRAIN_DOUBLES = ("E1_gui", "E2_code", "E3_reflect", "E4_noresp", "weight", "agent_testcase_score", "delta_label")
TRAIN_COLS = ("test_case_id, step, ord, pos, phi, operation_desc, action_content, E1_gui, E2_code, E3_reflect, "
              "E4_noresp, M_gui, M_code, M_reflect, M_noresp, weight, is_reflection, agent_testcase_score")


@register("tell_evidence", ops="B12 C8", sql="WITH" + GUI_FLAT_SQL + """
SELECT action_id, ord, pos, string_split(action_content, '"evidence": ')[2] AS evidence
FROM gui_rows WHERE contains(action_content, 'Tell (')""")
def q_tell_evidence(spark, sf):
    g = gui_rows(spark, sf)
    return g.filter(TX.is_tell("action_content")).select(
        "action_id", "ord", "pos", TX.tell_evidence("action_content").alias("evidence"))


_FENCES = ["```json\\n", "```\\n", "", "```json\\n"]


@register("fenced_result", ops="B14", sql="""
WITH t AS (
  SELECT doc_id,
    CASE doc_id % 5
      WHEN 0 THEN concat(chr(10), '```json', chr(10), '{"result": "', CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END, '"}', chr(10), '```')
      WHEN 1 THEN concat('```', chr(10), '{"result": "', CASE WHEN toxic = 1 THEN 'No' ELSE 'Yes' END, '"}', chr(10), '```')
      WHEN 2 THEN concat('  {"result": "Yes", "why": "doc ', doc_id, '"}  ')
      WHEN 3 THEN concat('```json', chr(10), '{"result": ', doc_id)
      ELSE concat('Sure: ', doc_id) END AS raw
  FROM labels),
s AS (SELECT doc_id, raw, trim(regexp_replace(regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '^```(json)?', ''), '```$', '')) AS body FROM t)
SELECT doc_id, coalesce(json_extract_string(try(CAST(body AS JSON)), '$.result'), 'No') AS result FROM s""")
def q_fenced(spark, sf):
    lb = fx.table(spark, sf, "labels")
    nl = F.lit("\n")
    yes_no = lambda cond: F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))
    k = F.col("doc_id") % 5
    raw = (F.when(k == 0, F.concat(nl, F.lit("```json"), nl, F.lit('{"result": "'), yes_no(F.col("quality") == 1), F.lit('"}'), nl, F.lit("```")))
            .when(k == 1, F.concat(F.lit("```"), nl, F.lit('{"result": "'), yes_no(F.col("toxic") != 1), F.lit('"}'), nl, F.lit("```")))
            .when(k == 2, F.concat(F.lit('  {"result": "Yes", "why": "doc '), F.col("doc_id"), F.lit('"}  ')))
            .when(k == 3, F.concat(F.lit("```json"), nl, F.lit('{"result": '), F.col("doc_id")))
            .otherwise(F.concat(F.lit("Sure: "), F.col("doc_id"))))
    return lb.select("doc_id", TX.fenced_result(raw).alias("result"))


_PHR = ", ".join(f"'{p}'" for p in fx.PHRASES + ["", "   ", "status 200 and list updated",
                                                  "button still disabled after click",
                                                  "might have succeeded, not sure"])
_NPH = len(fx.PHRASES) + 5


def _reflection_texts(spark, sf):
    e = fx.table(spark, sf, "events")
    words = F.array(*[F.lit(p) for p in fx.PHRASES + ["", "   ", "status 200 and list updated",
                                                       "button still disabled after click",
                                                       "might have succeeded, not sure"]])
    txt = F.element_at(words, (F.col("event_id") % _NPH + 1).cast("int"))
    txt = F.when(F.col("event_id") % 3 == 0, F.concat(txt, F.lit(" at step "), F.col("event_id") % 400)).otherwise(txt)
    return e.select("event_id", txt.alias("text"))


@register("reflection_rules", ops="B18", sql=f"""
WITH t AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(p, ' at step ', event_id % 400) ELSE p END AS text
  FROM (SELECT event_id, list_extract([{_PHR}], CAST(event_id % {_NPH} + 1 AS INTEGER)) AS p FROM events))
SELECT event_id, text, {TX.reflection_rules_sql('text')} AS verdict FROM t""")
def q_reflection_rules(spark, sf):
    t = _reflection_texts(spark, sf)
    return t.select("event_id", "text", TX.reflection_rules("text").alias("verdict"))


@register("evidence_merge", ops="D1", sql=MERGE_SQL + """
SELECT test_case_id, code_evidence, label, agent_judge, action_id, gui_evidence, action_content FROM merged""")
def q_evidence_merge(spark, sf):
    return merged(spark, sf).select("test_case_id", "code_evidence", "label", "agent_judge", "action_id",
                                    "gui_evidence", "action_content")


@register("tell_merge_back", ops="D2", sql=MERGE_SQL + """
SELECT test_case_id, action_id, ord, pos, agent_noresp, evidence FROM back""")
def q_tell_merge_back(spark, sf):
    return merged_back(spark, sf).select("test_case_id", "action_id", "ord", "pos", "agent_noresp", "evidence")


@register("stop_null_filter", ops="C9", sql=MERGE_SQL + " SELECT test_case_id, action_id, ord, pos, action_content FROM kept")
def q_stop_null(spark, sf):
    return A.stop_null_filter(merged_back(spark, sf)).select("test_case_id", "action_id", "ord", "pos", "action_content")


@register("train_rows", ops="C10", doubles=TRAIN_DOUBLES[:-1], sql=MERGE_SQL + f" SELECT {TRAIN_COLS} FROM train")
def q_train_rows(spark, sf):
    return training(spark, sf).drop("delta_label")


@register("disagreement_label", ops="C11 D3", doubles=("agent_testcase_score", "delta_label"),
          sql=MERGE_SQL + " SELECT test_case_id, step, ord, pos, phi, agent_testcase_score, delta_label FROM train")
def q_disagreement(spark, sf):
    return training(spark, sf, with_gt=True).select("test_case_id", "step", "ord", "pos", "phi",
                                                    "agent_testcase_score", "delta_label")


@register("verdict_attach", ops="D5", doubles=("agent_original",), sql=MERGE_SQL + """
SELECT test_case_id, arg_max(agent_testcase_score, ord * 1000 + pos) FILTER (WHERE agent_testcase_score IS NOT NULL) AS agent_original,
       arg_max(phi, ord * 1000 + pos) FILTER (WHERE phi IS NOT NULL) AS human_gt, count(*) AS n_steps
FROM train GROUP BY test_case_id""")
def q_verdict_attach(spark, sf):
    return A.verdict_attach(training(spark, sf))


SPLIT_SQL = O.with_ctes(O.STEPS_RAW) + """,
dc AS (SELECT DISTINCT test_case_id FROM steps),
rk AS (SELECT test_case_id, row_number() OVER (ORDER BY md5(concat('42|', test_case_id))) AS r,
              count(*) OVER () AS n FROM dc),
sp AS (SELECT s.test_case_id, s.ord, CASE WHEN rk.r <= floor(rk.n * 0.25) THEN 'val' ELSE 'train' END AS split
       FROM steps s JOIN rk USING (test_case_id))"""


@register("grouped_split", ops="G1 I2 I3 D12", sql=SPLIT_SQL + " SELECT * FROM sp")
def q_grouped_split(spark, sf):
    return A.grouped_split(fx.steps(spark, sf), "test_case_id", 0.25, 42).select("test_case_id", "ord", "split")


@register("split_counts", ops="E19", sql=SPLIT_SQL + """
SELECT split, count(DISTINCT test_case_id) AS n_cases, count(*) AS n_rows FROM sp GROUP BY split""")
def q_split_counts(spark, sf):
    return M.split_counts(A.grouped_split(fx.steps(spark, sf), "test_case_id", 0.25, 42))


@register("case_order", ops="F4", sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES) + """
SELECT test_case_id AS case_id, gt_case AS human_gt FROM case_vals ORDER BY case_id""")
def q_case_order(spark, sf):
    from judgefuse.operators.cases import case_last_values
    c = case_last_values(fx.steps(spark, sf), ("phi",))
    return c.select(F.col("test_case_id").alias("case_id"), F.col("phi").alias("human_gt")).orderBy("case_id")


@register("step_numbering", ops="F6", sql=O.with_ctes(O.STEPS_RAW) + """
SELECT test_case_id, ord, CAST(row_number() OVER (PARTITION BY test_case_id ORDER BY ord) - 1 AS BIGINT) AS step_no,
       concat(test_case_id, '_iter_', row_number() OVER (PARTITION BY test_case_id ORDER BY ord)) AS action_id
FROM steps""")
def q_step_numbering(spark, sf):
    s = fx.steps(spark, sf).select("test_case_id", "ord")
    p = group_positions(s, ["test_case_id"], ["ord"], "step_no")
    return p.withColumn("action_id", F.concat(F.col("test_case_id"), F.lit("_iter_"), F.col("step_no") + 1))
