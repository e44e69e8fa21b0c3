"""Verdict evaluation: B16, D4, D10, E5, E6 (composition of joins and one agg)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.operators.metrics import binary_metrics

VERDICT_MAP = "map<string, struct<result: string, evidence: string, case_desc: string>>"


def multitest_explode(pred: DataFrame, evidence: str = "evidence") -> DataFrame:
    """A batched verdict row holds a JSON map {"0": {...}, "1": {...}};
    one output row per key: case_name_(key+1), score 1 iff result == "Pass"."""
    # explode_outer + key filter: parses the JSON once (a plain explode
    # infers a not-empty filter that parses it a second time)
    x = pred.select("case_name", F.explode_outer(F.from_json(F.col(evidence), VERDICT_MAP)).alias("k", "v")) \
        .filter(F.col("k").isNotNull())
    return x.select(
        F.concat(F.col("case_name"), F.lit("_"), (F.col("k").cast("int") + 1).cast("string")).alias("case_name"),
        F.when(F.col("v.result") == "Pass", F.lit(1)).otherwise(F.lit(0)).alias("os_agent_score"),
        F.col("v.evidence").alias("evidence"))


def gt_pred_join(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """GT left-joined to predictions, then rows without a score dropped —
    i.e. an inner equi-join on case_name plus a NOT NULL filter."""
    p = pred.select("case_name", "os_agent_score")
    return gt.join(p, "case_name", "inner").filter(F.col("os_agent_score").isNotNull())


def run_evaluation(gt: DataFrame, pred: DataFrame, is_batch: bool = False) -> DataFrame:
    """Optional B16, then D4, then E5 with label as truth, score as prediction."""
    if is_batch:
        pred = multitest_explode(pred)
    m = gt_pred_join(gt, pred)
    return binary_metrics(m.withColumn("label", F.col("label").cast("int")), "label", "os_agent_score")


def project_pairs(gt: DataFrame, agent: DataFrame, key: str = "testcase") -> DataFrame:
    """(case_name, testcase, gt_label) ∩ (case_name, testcase, agent_score)."""
    return gt.join(agent, ["case_name", key], "inner").select(
        "case_name", key, "gt_label", "agent_score")
