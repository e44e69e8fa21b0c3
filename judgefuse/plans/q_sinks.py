"""Registered queries: jobs with sinks that go on after an interruption."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from judgefuse.operators import evaluation as EV
from judgefuse.operators import metrics as M
from judgefuse.operators.scorer import bounded_scorer
from judgefuse.plans import fixtures as fx
from judgefuse.plans.jobs import record_trajectories
from judgefuse.plans.q_eval import CASE
from judgefuse.plans.q_scoring import _FLAGS_SQL, scored_cases
from judgefuse.plans.q_traj import PIPE_SQL
from judgefuse.plans.registry import register
from judgefuse.session import shared_folder
from judgefuse.sources import sinks
from judgefuse.sources.records import write_results


def _new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- E7 -----------------------------------------------------------------------------------------
@register("flip_frames", doubles=("agent_original", "P_case_EnvFail", "P_case_AgentFail"), ops="E7", sql=_FLAGS_SQL + """
SELECT *, 'subset_A_original_0' AS frame FROM flags WHERE is_correct_before AND agent_original = 0
UNION ALL SELECT *, 'subset_A_original_1' FROM flags WHERE is_correct_before AND agent_original = 1
UNION ALL SELECT *, 'misflipped_original_0' FROM flags WHERE is_correct_before AND is_flipped AND agent_original = 0
UNION ALL SELECT *, 'misflipped_original_1' FROM flags WHERE is_correct_before AND is_flipped AND agent_original = 1
UNION ALL SELECT *, 'subset_B_corrected' FROM flags WHERE NOT is_correct_before AND is_correct_after""")
def q_flip_frames(spark, sf):
    """The frames as a user gets them: written once into a folder each, read again."""
    path = _new_folder(spark, "flips")
    frames = M.flip_frames(scored_cases(spark, sf))
    write_results(frames, path, by=("frame",))
    return spark.read.schema(frames.schema).parquet(path)


# ---- E16 + A10 + H19 ----------------------------------------------------------------------------
BAD_TASK = 13  # every thirteenth document of the fixture is unreadable


def _documents(spark, sf):
    task = F.col("task")
    bad = task % BAD_TASK == 0
    t = fx.trajectories(spark, sf)
    return t.select(
        F.concat(F.lit("web_"), task % 10, F.lit("_"), task).alias("project_name"), "task",
        F.when(~bad, F.col("messages")).alias("messages"), "screens", "codes",
        F.when(bad, F.concat(F.lit('{"trajectory": ['), task)).alias("bad_document"))


@register("trajectory_run_counts", ops="E16 A10 H19", sql=PIPE_SQL + f""",
ok AS (SELECT * FROM pipe WHERE task % {BAD_TASK} <> 0),
n AS (SELECT count(DISTINCT conv_id) AS n_tasks FROM conversations),
p AS (SELECT count(DISTINCT task) AS n_processed, count(*) AS n_iters,
             count(*) FILTER (WHERE coordinate_match = 1) AS n_coordinate_cases FROM ok)
SELECT n_tasks, n_processed, n_tasks - n_processed AS n_failed, n_iters, n_coordinate_cases FROM n, p""")
def q_trajectory_run_counts(spark, sf):
    """The job's own counts, taken while it writes."""
    counts = record_trajectories(_documents(spark, sf), fx.tasks(spark, sf), fx.elements(spark, sf), _new_folder(spark, "run"),
                                 batches=2)
    return spark.createDataFrame([counts], "n_tasks long, n_processed long, n_failed long, n_iters long, n_coordinate_cases long")


@register("trajectory_resume", ops="A10 H19", sql=PIPE_SQL + f"""
SELECT project_name, string_agg(concat(iter_num, ':', coalesce(CAST(matched_element_id AS VARCHAR), '')), '|' ORDER BY iter_num) AS steps,
       max(final_result) AS final_result, count(*) AS total_iters
FROM pipe WHERE task % {BAD_TASK} <> 0 GROUP BY project_name""")
def q_trajectory_resume(spark, sf):
    """A run over the even tasks, then one over all: the second does the others only."""
    path = _new_folder(spark, "resume")
    documents, tasks, elements = _documents(spark, sf), fx.tasks(spark, sf), fx.elements(spark, sf)
    record_trajectories(documents.filter(F.col("task") % 2 == 0), tasks, elements, path, batches=1)
    record_trajectories(documents, tasks, elements, path, batches=1)
    told = F.array_join(F.transform("results", lambda r: F.concat(
        r["iter_num"].cast("string"), F.lit(":"), F.coalesce(r["matched_element_id"].cast("string"), F.lit("")))), "|")
    return sinks.read_appended(spark, f"{path}/records").select(
        "project_name", told.alias("steps"), "final_result", F.col("summary.total_iters").alias("total_iters"))


# ---- A11 ----------------------------------------------------------------------------------------
@register("upsert_buckets", ops="A11 I4", sql="""
WITH o AS (SELECT concat('p', doc_id // 3) AS project_name, quality AS score, 'old' AS note, doc_id AS ord, 0 AS v FROM labels),
n AS (SELECT concat('p', doc_id // 2) AS project_name, toxic AS score, 'new' AS note, doc_id AS ord, 1 AS v
      FROM labels WHERE doc_id % 4 = 0),
u AS (SELECT * FROM o UNION ALL SELECT * FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY v DESC, ord DESC) AS rn FROM u)
SELECT project_name, score, note, ord FROM r WHERE rn = 1""")
def q_upsert_buckets(spark, sf):
    path = _new_folder(spark, "upsert")
    lb = fx.table(spark, sf, "labels")
    for rows, div, score, note in ((lb, 3, "quality", "old"), (lb.filter(F.col("doc_id") % 4 == 0), 2, "toxic", "new")):
        sinks.upsert_buckets(rows.select(
            F.concat(F.lit("p"), F.expr(f"doc_id div {div}")).alias("project_name"), F.col(score).alias("score"),
            F.lit(note).alias("note"), F.col("doc_id").alias("ord")), path, buckets=8)
    return sinks.read_buckets(spark, path)


# ---- B18 ----------------------------------------------------------------------------------------
def _ask(text: str) -> str:
    """A stand-in for an outside scorer: fails on some texts, judges the others by their length."""
    if len(text) % 7 == 0:
        raise TimeoutError(text[:40])
    return "Yes" if len(text) % 2 == 0 else "No"


@register("adjudication_asked", ops="B18", sql="""
SELECT doc_id, CASE WHEN text IS NULL OR length(text) % 7 = 0 OR length(text) % 2 = 1 THEN 'No' ELSE 'Yes' END AS agent_noresp
FROM documents""")
def q_adjudication_asked(spark, sf):
    """Every document's text as evidence of a pluggable scorer; its errors become the default."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("evidence"))
    scorer = bounded_scorer(_ask, _new_folder(spark, "answers"), batches=2)
    return scorer(docs).select("doc_id", "agent_noresp")


# ---- E6, batched verdicts -----------------------------------------------------------------------
@register("batch_metrics", ops="E6 B16", doubles=("precision", "recall", "f1", "accuracy"), sql=f"""
WITH p AS (SELECT concat({CASE}, '_1') AS case_name, CAST(toxic = 0 AS INTEGER) AS score FROM labels
           UNION ALL SELECT concat({CASE}, '_2'), CAST(quality = 1 AS INTEGER) FROM labels),
g AS (SELECT concat({CASE}, '_', k) AS case_name, (doc_id + k) % 2 AS label
      FROM labels, generate_series(1, 2) AS s(k) WHERE doc_id % 11 <> 0),
c AS (SELECT count(*) FILTER (WHERE label = 1 AND score = 1) AS tp, count(*) FILTER (WHERE label = 0 AND score = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND score = 0) AS fn, count(*) FILTER (WHERE label = 0 AND score = 0) AS tn,
             count(*) AS total FROM g JOIN p USING (case_name)),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1,
       round(CASE WHEN total > 0 THEN (tp + tn) / total ELSE 0.0 END, 4) AS accuracy, total FROM r""")
def q_batch_metrics(spark, sf):
    lb = fx.table(spark, sf, "labels").filter(F.col("doc_id") % 11 != 0)
    case = F.concat(F.lit("web_"), F.col("doc_id") % 50, F.lit("_"), F.col("doc_id"))
    gt = lb.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(case, F.lit("_"), F.col("k")).alias("case_name"), ((F.col("doc_id") + F.col("k")) % 2).alias("label"))
    pred = fx.predictions(spark, sf).select("case_name", F.col("evidence_batch").alias("evidence"))
    return EV.run_evaluation(gt, pred, is_batch=True)
