"""Batch jobs (H14, H15, H16, H19, A10, E16): training, prediction and trajectory records end to end.

Paths are shared storage (the cluster's file system); params are one small
JSON document written through Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from judgefuse.operators import assembly as A
from judgefuse.operators import baseline_lr as LR
from judgefuse.operators import cases as C
from judgefuse.operators import em as EM
from judgefuse.operators import metrics as M
from judgefuse.operators import trajectory as TR
from judgefuse.operators.model import RUN_WEIGHTS, ChannelWeights, EMParams
from judgefuse.operators.steps import apply_defaults, check_evidence, check_order, prepare
from judgefuse.session import checkpoint_dir
from judgefuse.sources.records import BAD, good_rows, load_typed, reject_rows, write_results
from judgefuse.sources.sinks import append_batches


def load_steps(spark: SparkSession, path: str, rejects_path: str | None = None) -> DataFrame:
    """A2 + Q1 + Q3 for a step table of any format: typed, with all evidence and an order without ties.

    Rows that cannot be read are an error, or go to ``rejects_path`` as JSON.
    """
    loaded = load_typed(spark, path, "steps")
    if rejects_path:
        write_results(reject_rows(loaded), rejects_path, "json")
    check_evidence(good_rows(loaded) if rejects_path else loaded, rejects=None if rejects_path else BAD)
    steps = good_rows(loaded)
    check_order(apply_defaults(steps))
    return steps


def train(spark: SparkSession, data_path: str, out_dir: str,
          cfg: EM.EMConfig = EM.EMConfig(max_iter=500, tol=1e-4, weights=RUN_WEIGHTS, temp=0.8),
          rejects_path: str | None = None) -> EM.EMResult:
    """Load -> defaults -> fit on all rows -> save params JSON."""
    steps = prepare(load_steps(spark, data_path, rejects_path))
    res = EM.fit(steps, cfg)
    EM.save_params(spark, res.params, f"{out_dir}/em_params")
    return res


def predict(raw_steps: DataFrame, params: EMParams, weights: ChannelWeights = RUN_WEIGHTS,
            tau_agentfail: float = 0.75, tau_envfail: float = 0.75, alpha: float = 0.75,
            both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Defaults -> step posteriors and corrected cases (τ_envfail_high = τ_envfail).

    Cases are aggregated once and give the steps their verdicts.  Nothing runs
    before a result is used; with ``both`` the scored cases are written first, so
    that steps are read once for the cases and once for the step rows.
    """
    steps = prepare(raw_steps)
    scored = C.case_noisy_or(steps, params, weights, alpha)
    if both:
        checkpoint_dir(raw_steps.sparkSession)
        scored = scored.checkpoint()
    return (C.step_posterior_of(steps, scored, params, weights),
            C.correct_threshold(scored, tau_agentfail, tau_envfail, tau_envfail))


def run_prediction(spark: SparkSession, data_path: str, params_path: str, out_dir: str,
                   fmt: str = "csv", rejects_path: str | None = None) -> DataFrame:
    """H15 with sinks: step posteriors, corrected cases (sorted by case, F4),
    flip / confusion summaries and the flip frames (one folder each)."""
    params = EM.load_params(spark, params_path)
    step_post, cases = predict(load_steps(spark, data_path, rejects_path), params, both=True)
    write_results(step_post, f"{out_dir}/pred_step", fmt)
    write_results(cases.orderBy("case_id"), f"{out_dir}/pred_corrected_cases", fmt)
    write_results(M.flip_analysis(cases), f"{out_dir}/flip_summary", fmt)
    write_results(M.flip_frames(cases), f"{out_dir}/flip_frames", fmt, by=("frame",))
    write_results(M.confusion(cases), f"{out_dir}/confusion", fmt)
    return cases


# ---- H16: the logistic baseline ------------------------------------------------------------
def lr_summary(corrected: DataFrame) -> DataFrame:
    """E3, E4 and E7 of corrected cases in one row; cases without verdict or label are left out."""
    v = corrected.filter(F.col("agent_original").isNotNull() & F.col("human_gt").isNotNull())
    return M.accuracy(v).crossJoin(M.confusion(v)).crossJoin(M.flip_analysis(v))  # of one row each


def train_lr(spark: SparkSession, data_path: str, out_dir: str, val_ratio: float = 0.2, seed: int = 42, reg: float = 1.0,
             tau_agentfail: float = 0.75, tau_envfail: float = 0.75, fmt: str = "parquet",
             rejects_path: str | None = None) -> LR.LRParams:
    """Load -> split by case -> fit on train -> save params -> correct the validation cases -> sinks.

    Writes ``lr_params`` (JSON), ``split_counts``, ``val_corrected_cases`` (with flip flags) and ``summary``.
    """
    checkpoint_dir(spark)
    steps = A.grouped_split(prepare(load_steps(spark, data_path, rejects_path)), "test_case_id", val_ratio, seed)
    features = LR.case_features(steps, extra=("split",)).checkpoint()   # steps are aggregated once for all that follows
    params = LR.fit(features.filter("split = 'train'"), C=reg)
    LR.save_params(spark, params, f"{out_dir}/lr_params")
    write_results(features.groupBy("split").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("step_count").cast("long").alias("n_rows")),
                  f"{out_dir}/split_counts", fmt)
    _lr_sinks(features.filter("split = 'val'"), params, out_dir, "val_corrected_cases", tau_agentfail, tau_envfail, fmt)
    return params


def run_lr_prediction(spark: SparkSession, data_path: str, params_path: str, out_dir: str, tau_agentfail: float = 0.75,
                      tau_envfail: float = 0.75, fmt: str = "parquet", rejects_path: str | None = None) -> DataFrame:
    """H12 + H13 with saved params: every case of a step table, corrected, with sinks."""
    features = LR.case_features(prepare(load_steps(spark, data_path, rejects_path)))
    return _lr_sinks(features, LR.load_params(spark, params_path), out_dir, "pred_corrected_cases", tau_agentfail, tau_envfail, fmt)


def _lr_sinks(features: DataFrame, params: LR.LRParams, out_dir: str, name: str, tau_agentfail: float, tau_envfail: float,
              fmt: str) -> DataFrame:
    checkpoint_dir(features.sparkSession)
    cases = M.flip_flags(LR.correct(LR.score(features, params), tau_agentfail, tau_envfail)).checkpoint()
    write_results(cases.orderBy("case_id"), f"{out_dir}/{name}", fmt)
    write_results(lr_summary(cases), f"{out_dir}/summary", fmt)
    return cases


# ---- H19 + E16 + A10: trajectory records ---------------------------------------------------
def record_trajectories(documents: DataFrame, tasks: DataFrame, elements: DataFrame, out_dir: str,
                        batches: int = 8) -> dict[str, int]:
    """H19 as a job that can be taken up again: one nested record per task appended to ``out_dir``/records.

    ``documents``: project_name, task, messages, screens, codes, bad_document
    (raw text of an unreadable one, else NULL).  Unreadable documents and those
    without a step are failed tasks.  Returns E16's counts of this call, taken
    by the passes that write (``observe``): n_tasks, n_processed, n_failed,
    n_iters, n_coordinate_cases.  Tasks of finished batches are not done again;
    failed ones are tried again.  ``n_tasks`` and ``n_failed`` are counted where
    the documents are read, so a stage that is run again counts its rows twice.
    """
    read, wrote = [], []

    def work(part: DataFrame) -> DataFrame:
        read.append(Observation())
        wrote.append(Observation())
        failed = F.col("bad_document").isNotNull() | (TR.step_count() == 0)
        part = part.observe(read[-1], F.count(F.lit(1)).alias("n_tasks"), F.count_if(failed).alias("n_failed"))
        records = TR.nested_records(TR.trajectory_steps(part.filter(~failed), tasks, elements))
        return records.observe(wrote[-1], F.count(F.lit(1)).alias("n_processed"),
                               F.sum("summary.total_iters").alias("n_iters"),
                               F.sum("summary.coordinate_cases").alias("n_coordinate_cases"))

    total = dict.fromkeys(("n_tasks", "n_processed", "n_failed", "n_iters", "n_coordinate_cases"), 0)
    if documents.isEmpty():
        return total
    # a batch of failed tasks only has no records; its plan must still be run to the end for its counts
    rule = "spark.sql.adaptive.optimizer.excludedRules"
    spark = documents.sparkSession
    before = spark.conf.get(rule, "")
    spark.conf.set(rule, ",".join(filter(None, (before, "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"))))
    try:
        append_batches(documents, work, f"{out_dir}/records", "project_name", batches)
    finally:
        if before:
            spark.conf.set(rule, before)
        else:
            spark.conf.unset(rule)
    for seen in (*read, *wrote):
        for name, n in seen.get.items():
            total[name] += n or 0
    return total
