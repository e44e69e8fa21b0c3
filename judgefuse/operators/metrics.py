"""Verdict-quality metrics: E3, E4, E5, E7, E12, E17-E19.

Every metric is a single global aggregation of ``count_if``/``sum`` terms, so
the data is read once and only one partial row per task is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _eq(a: str, b: str) -> Column:
    """Equality where NULL on either side counts as 'not equal' (pandas ==)."""
    return F.coalesce(F.col(a).cast("double") == F.col(b).cast("double"), F.lit(False))


def accuracy(cases: DataFrame, gt: str = "human_gt") -> DataFrame:
    """Accuracy before (agent_original) and after (corrected_label).

    A NULL verdict counts as wrong; cases without ground truth are left out
    and counted (Q13).
    """
    have = cases.filter(F.col(gt).isNotNull())
    n = F.count(F.lit(1))
    return have.agg(
        n.alias("n_cases"),
        F.try_divide(F.count_if(_eq("agent_original", gt)), n).alias("acc_before"),
        F.try_divide(F.count_if(_eq("corrected_label", gt)), n).alias("acc_after"),
    )


def confusion(cases: DataFrame, gt: str = "human_gt", pred: str = "corrected_label") -> DataFrame:
    """GT × prediction counts as one row with four cells plus accuracy."""
    g, p = F.col(gt), F.col(pred)
    rows = cases.filter(g.isNotNull() & p.isNotNull())
    return rows.agg(
        F.count_if((g == 0) & (p == 0)).alias("gt0_pred0"),
        F.count_if((g == 0) & (p == 1)).alias("gt0_pred1"),
        F.count_if((g == 1) & (p == 0)).alias("gt1_pred0"),
        F.count_if((g == 1) & (p == 1)).alias("gt1_pred1"),
        F.try_divide(F.count_if(g == p), F.count(F.lit(1))).alias("accuracy"),
    )


def flip_flags(cases: DataFrame, gt: str = "human_gt") -> DataFrame:
    """E7 detail: is_correct_before / is_correct_after / is_flipped columns."""
    return (cases
            .withColumn("is_correct_before", _eq(gt, "agent_original"))
            .withColumn("is_correct_after", _eq(gt, "corrected_label"))
            .withColumn("is_flipped", ~_eq("agent_original", "corrected_label")))


def flip_frames(cases: DataFrame, gt: str = "human_gt") -> DataFrame:
    """E7 detail frames in one pass: each case once per ``frame`` it belongs to.

    ``subset_A_original_v``: right before, verdict v; ``misflipped_original_v``:
    those of them that were flipped; ``subset_B_corrected``: wrong before, right
    after.  Other cases are in no frame.  Write it partitioned by ``frame``.
    """
    f = flip_flags(cases, gt)
    right, flipped, o = F.col("is_correct_before"), F.col("is_flipped"), F.col("agent_original")
    rules = {"subset_B_corrected": ~right & F.col("is_correct_after")}
    for v in (0, 1):
        rules[f"subset_A_original_{v}"] = right & (o == v)
        rules[f"misflipped_original_{v}"] = right & flipped & (o == v)
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return f.withColumn("frame", F.explode(named))


def flip_analysis(cases: DataFrame, gt: str = "human_gt") -> DataFrame:
    """Subset A (agent right) misflip counts/rates split by original label;
    subset B (agent wrong) corrected count/rate.  Zero denominators → 0.0."""
    f = flip_flags(cases, gt)
    a = F.col("is_correct_before")
    fl = F.col("is_flipped")
    o = F.col("agent_original")

    def rate(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    agg = f.agg(
        F.count_if(a).alias("subset_a"),
        F.count_if(a & fl).alias("misflipped"),
        F.count_if(a & (o == 0)).alias("subset_a_orig0"),
        F.count_if(a & fl & (o == 0)).alias("misflipped_orig0"),
        F.count_if(a & (o == 1)).alias("subset_a_orig1"),
        F.count_if(a & fl & (o == 1)).alias("misflipped_orig1"),
        F.count_if(~a).alias("subset_b"),
        F.count_if(~a & F.col("is_correct_after")).alias("corrected"),
    )
    return agg.select(
        "*",
        rate(F.col("misflipped"), F.col("subset_a")).alias("misflip_rate"),
        rate(F.col("corrected"), F.col("subset_b")).alias("correct_rate"))


def binary_metrics(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """E5: TP FP FN TN, precision, recall, F1, accuracy (4 decimals), total.

    Always four counts, even for one-class input; zero division → 0.0 (Q11).
    """
    g, p = F.col(gt), F.col(pred)
    c = df.agg(
        F.count_if((g == 1) & (p == 1)).alias("tp"),
        F.count_if((g == 0) & (p == 1)).alias("fp"),
        F.count_if((g == 1) & (p == 0)).alias("fn"),
        F.count_if((g == 0) & (p == 0)).alias("tn"),
        F.count(F.lit(1)).alias("total"))
    tp, fp, fn, tn, tot = (F.col(x) for x in ("tp", "fp", "fn", "tn", "total"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    acc = F.when(tot > 0, (tp + tn) / tot).otherwise(F.lit(0.0))
    return c.select("tp", "fp", "fn", "tn",
                    F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"),
                    F.round(f1, 4).alias("f1"), F.round(acc, 4).alias("accuracy"), "total")


def verdict_totals(df: DataFrame, score: str = "os_agent_score") -> DataFrame:
    """Rows, score = 1, score = 0."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(score) == 1).alias("n_pass"),
                  F.count_if(F.col(score) == 0).alias("n_fail"))


def split_counts(df: DataFrame, case: str = "test_case_id", split: str = "split") -> DataFrame:
    """Distinct cases and rows per split."""
    return df.groupBy(split).agg(F.countDistinct(case).alias("n_cases"),
                                 F.count(F.lit(1)).alias("n_rows"))
