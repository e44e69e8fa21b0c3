"""Registered queries: code-review responses, file lists, training and
prediction jobs (B15, B19, B20, B21, H14, H15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from judgefuse.operators import cases as C
from judgefuse.operators import codeevidence as CE
from judgefuse.operators import em as EM
from judgefuse.operators.model import RUN_WEIGHTS
from judgefuse.plans import fixtures as fx
from judgefuse.plans import oracle as O
from judgefuse.plans.q_em import RUN_CFG
from judgefuse.plans.q_scoring import _cases_sql_ctes
from judgefuse.plans.q_em import EM_FIT_SQL
from judgefuse.plans.jobs import train
from judgefuse.plans.registry import register
from judgefuse.session import shared_folder
from judgefuse.sources.records import write_results

RESP_SQL = """
WITH d AS (SELECT doc_id, text, CAST(doc_id % 3 + 1 AS INTEGER) AS n FROM documents),
c AS (SELECT d.*, g.j FROM d JOIN generate_series(0, 2) AS g(j) ON g.j < d.n
      WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)"""


@register("response_block", ops="B15", sql=RESP_SQL + """
SELECT concat('proj_', doc_id) AS project_name, CAST(j AS INTEGER) AS case_idx, concat('case ', doc_id, '-', j) AS test_case,
       concat('R', j) AS requirement_id, (doc_id + j) % 2 = 0 AS is_implemented, text AS evidence,
       concat('src/f', (doc_id + j) % 5, '.js|src/main.js') AS files
FROM c""")
def q_response_block(spark, sf):
    acc, _ = CE.parse_responses(fx.responses(spark, sf))
    return acc.withColumn("files", F.array_join("files", "|"))


@register("response_rejects", ops="B15", sql="""
SELECT concat('proj_', doc_id) AS project_name,
       CASE WHEN doc_id % 7 = 0 THEN 'no RESPONSE block' ELSE 'invalid JSON' END AS reason
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def q_response_rejects(spark, sf):
    _, rej = CE.parse_responses(fx.responses(spark, sf))
    return rej


@register("ordered_distinct_files", ops="B19", sql=RESP_SQL + """,
f AS (SELECT doc_id, j, 0 AS k, concat('src/f', (doc_id + j) % 5, '.js') AS file FROM c
      UNION ALL SELECT doc_id, j, 1, 'src/main.js' FROM c)
SELECT concat('proj_', doc_id) AS project_name, file, CAST(arg_min(j, j * 10 + k) AS INTEGER) AS case_idx,
       CAST(arg_min(k, j * 10 + k) AS INTEGER) AS file_idx
FROM f GROUP BY doc_id, file""")
def q_ordered_files(spark, sf):
    acc, _ = CE.parse_responses(fx.responses(spark, sf))
    return CE.ordered_distinct_files(acc)


_MANIFEST_SQL = """
WITH m AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN concat('.cache/', regexp_extract(url, '^https?://[^/]+/(.*)$', 1))
                               ELSE regexp_extract(url, '^https?://[^/]+/(.*)$', 1) END AS path, html FROM pages)"""


def _manifest(spark, sf):
    p = fx.table(spark, sf, "pages")
    rel = F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1)
    return p.select("page_id", F.when(F.col("page_id") % 9 == 0, F.concat(F.lit(".cache/"), rel)).otherwise(rel).alias("path"),
                    "html")


@register("manifest_filter", ops="B20", sql=_MANIFEST_SQL + " SELECT page_id, path FROM m WHERE NOT starts_with(path, '.') ORDER BY path")
def q_manifest(spark, sf):
    return CE.manifest_filter(_manifest(spark, sf).select("page_id", "path"))


@register("code_lookup", ops="B21", sql=_MANIFEST_SQL + """
SELECT w.path, m.page_id, length(m.html) AS n_chars, md5(m.html) AS html_md5
FROM (SELECT DISTINCT path FROM m WHERE page_id % 2 = 0
      UNION SELECT concat('missing/', page_id) FROM pages WHERE page_id % 5 = 0) w
JOIN m USING (path)""")
def q_code_lookup(spark, sf):
    m = _manifest(spark, sf)
    wanted = m.filter(F.col("page_id") % 2 == 0).select("path").unionByName(
        fx.table(spark, sf, "pages").filter(F.col("page_id") % 5 == 0)
        .select(F.concat(F.lit("missing/"), F.col("page_id")).alias("path"))).distinct()
    return CE.code_lookup(wanted, m).select("path", "page_id", F.length("html").alias("n_chars"), F.md5("html").alias("html_md5"))


@register("train_pipeline", ops="H14", doubles=tuple(EM.PARAM_COLS), sql=EM_FIT_SQL)
def q_train_pipeline(spark, sf):
    """The job as a user runs it: a step file is loaded, fitted, the parameters saved and loaded again."""
    base = f"{shared_folder(spark)}/train-{uuid.uuid4().hex}"
    write_results(fx.steps_raw(spark, sf), f"{base}/steps.parquet")
    res = train(spark, f"{base}/steps.parquet", base, RUN_CFG)
    saved = EM.load_params(spark, f"{base}/em_params")
    return EM.params_frame(spark, saved, {"n_iter": int(res.n_iter)})


_L, _A = O.threshold_rule_sql(0.75, 0.75, 0.75)


@register("predict_pipeline", ops="H15", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"),
          sql=O.with_ctes(*_cases_sql_ctes()) + f" SELECT *, {_L} AS corrected_label, {_A} AS action FROM cases")
def q_predict_pipeline(spark, sf):
    from judgefuse.plans.jobs import predict
    _, cases = predict(fx.steps_raw(spark, sf), fx.LIT_PARAMS)
    return cases


@register("predict_steps", ops="H15 H5", doubles=("P_EnvFail", "P_AgentFail"), sql=O.with_ctes(
    O.STEPS_RAW, O.CASE_VALUES, O.posterior_ctes(fx.LIT_PARAMS, RUN_WEIGHTS.w, RUN_WEIGHTS.agent_weight)) +
    " SELECT test_case_id, ord, step, p0 AS P_EnvFail, p1 AS P_AgentFail FROM step_post")
def q_predict_steps(spark, sf):
    """The job's step rows: their verdicts come from the scored cases."""
    from judgefuse.plans.jobs import predict
    steps, _ = predict(fx.steps_raw(spark, sf), fx.LIT_PARAMS, both=True)
    return steps
