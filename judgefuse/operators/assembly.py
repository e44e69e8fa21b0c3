"""Evidence assembly: D1, D2, D3, D5, D12, C9, C10, C11, B12/B18 wiring, G1, I2, I3.

Code, verdict and GUI evidence are joined per test case, Tell rows are
scored by a pluggable ``DataFrame -> DataFrame`` scorer (default: the
deterministic rule table), then each row becomes one training step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgefuse.functions import text as TX

Scorer = Callable[[DataFrame], DataFrame]


def evidence_merge(code_ev: DataFrame, agent_judge: DataFrame, gui: DataFrame) -> DataFrame:
    """Code ⟕ agent verdict ⟕ GUI actions on test_case_id.

    Case-level values replicate onto every GUI action of the case.  The two
    case tables are joined first (case-sized); AQE broadcasts them when the
    runtime size allows and otherwise shuffles, splitting skewed partitions.
    """
    cases = code_ev.join(agent_judge, "test_case_id", "left")
    return cases.join(gui, "test_case_id", "left")


def row_order(df: DataFrame) -> list[str]:
    """Columns that order rows: the record, then (if present) the position in it."""
    return [c for c in ("ord", "pos") if c in df.columns]


def rule_scorer(df: DataFrame) -> DataFrame:
    """Default B18 scorer: adds ``agent_noresp`` Yes/No from ``evidence``."""
    return df.withColumn("agent_noresp", TX.reflection_rules(F.col("evidence")))


def tell_rows(merged: DataFrame, scorer: Scorer = rule_scorer) -> DataFrame:
    """C8 + B12 + B18: Tell rows with their raw evidence and adjudication.

    A Tell row without extractable evidence keeps agent_noresp = "-1" (Q19).
    """
    t = merged.filter(TX.is_tell(F.col("action_content"))) \
        .select("action_id", *row_order(merged), TX.tell_evidence(F.col("action_content")).alias("evidence"))
    scored = scorer(t.filter(F.col("evidence").isNotNull()))
    missing = t.filter(F.col("evidence").isNull()).withColumn("agent_noresp", F.lit("-1"))
    cols = ["action_id", *row_order(merged), "evidence", "agent_noresp"]
    return scored.select(*cols).unionByName(missing.select(*cols))


def tell_merge_back(merged: DataFrame, tells: DataFrame) -> DataFrame:
    """Merged ⟕ Tell rows on action_id; only agent_noresp and evidence
    come from the right.  The right side is first reduced to one row per
    action_id (largest ord) so the join cannot multiply rows (Q26)."""
    right = tells.groupBy("action_id").agg(
        F.max_by(F.struct("agent_noresp", "evidence"), F.struct(*row_order(tells))).alias("_t"))
    return merged.join(right.select("action_id", "_t.agent_noresp", "_t.evidence"), "action_id", "left")


def stop_null_filter(df: DataFrame, col: str = "action_content") -> DataFrame:
    """Drop rows whose action contains "Stop" and rows without an action."""
    c = F.col(col)
    return df.filter(c.isNotNull() & ~c.contains("Stop"))


def train_rows(df: DataFrame, gt_lookup: DataFrame | None = None, label_col: str = "label") -> DataFrame:
    """C10 (+ C11/D3 when ``gt_lookup`` with key/value is given).

    Non-Tell rows: GUI evidence -1 → masked; weight 0.3; noresp masked.
    Tell rows (agent_noresp not NULL): GUI masked, weight 0.5,
    E4_noresp = 0 iff "Yes" else 1, E3_reflect = agent verdict.
    delta_label: gt = 1 & verdict 0 → 1; gt = 0 & verdict 1 → 0; else NULL.
    """
    tell = F.col("agent_noresp").isNotNull()
    gui = F.col("gui_evidence")
    no_gui = gui == -1
    agent = F.col("agent_judge").cast("double")
    out = df
    if gt_lookup is not None:
        g = gt_lookup.select(F.col("key").alias("test_case_id"), F.col("value").alias("_gt"))
        out = out.join(g, "test_case_id", "left")
        gtv = F.col("_gt").cast("double")
        delta = (F.when(agent.isNotNull() & (gtv == 1.0) & (agent == 0.0), F.lit(1.0))
                  .when(agent.isNotNull() & (gtv == 0.0) & (agent == 1.0), F.lit(0.0)))
    else:
        delta = F.lit(None)
    return out.select(
        "test_case_id",
        F.col("action_id").alias("step"),
        *row_order(df),
        F.col(label_col).cast("int").alias("phi"),
        "operation_desc", "action_content",
        F.when(no_gui, F.lit(0.0)).otherwise(gui.cast("double")).alias("E1_gui"),
        F.col("code_evidence").cast("double").alias("E2_code"),
        F.when(tell, agent).alias("E3_reflect"),
        F.when(tell, F.when(F.col("agent_noresp") == "Yes", F.lit(0.0)).otherwise(F.lit(1.0)))
         .otherwise(F.lit(0.0)).alias("E4_noresp"),
        F.when(tell | no_gui, F.lit(1)).otherwise(F.lit(0)).alias("M_gui"),
        F.lit(0).alias("M_code"),
        F.lit(1).alias("M_reflect"),
        F.when(tell, F.lit(0)).otherwise(F.lit(1)).alias("M_noresp"),
        F.when(tell, F.lit(0.5)).otherwise(F.lit(0.3)).alias("weight"),
        tell.cast("int").alias("is_reflection"),
        agent.alias("agent_testcase_score"),
        delta.cast("double").alias("delta_label"))


def verdict_attach(rows: DataFrame, agent: str = "agent_testcase_score") -> DataFrame:
    """Per case, the last agent value and the last non-null phi, folded
    into one aggregation (no join back)."""
    from judgefuse.operators.steps import last_non_null
    order = F.struct(*row_order(rows))
    return rows.groupBy("test_case_id").agg(
        last_non_null(agent, order).alias("agent_original"),
        last_non_null("phi", order).alias("human_gt"),
        F.count(F.lit(1)).alias("n_steps"))


# ---- G1 / I2 / I3 / D12: case-grouped split ---------------------------------------------
def _case_hash(case: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), case.cast("string")))


def split_threshold(df: DataFrame, case_col: str = "test_case_id", val_ratio: float = 0.2,
                    seed: int = 42, bucket_chars: int = 2) -> tuple[str | None, int, int]:
    """Hash of the ⌊n·ratio⌋-th case in md5(seed|case) order (exact).

    The distinct case hashes are computed once and checkpointed.  Cases are
    counted by the next ``bucket_chars`` digits of their hash (at most 256
    rows reach the driver a round); inside the bucket that holds the cut the
    prefix grows until one hash is left.  The same rounds at every size.
    Returns (threshold hash or None, n_cases, n_val).
    """
    from judgefuse.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    cases = df.select(F.col(case_col).cast("string").alias("c")).distinct() \
        .select(_case_hash(F.col("c"), seed).alias("h")).checkpoint(eager=True)
    sub, n, k, length = cases, None, None, bucket_chars
    while True:
        pre = F.substring("h", 1, length)
        counts = sorted((r["b"], r["n"]) for r in sub.groupBy(pre.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        if n is None:
            n = sum(c for _, c in counts)
            k = int(n * val_ratio)
            if k <= 0:
                return None, n, 0
            rest = k
        acc = 0
        for b, c in counts:
            if acc + c >= rest:
                break
            acc += c
        rest -= acc
        sub = sub.filter(pre == F.lit(b))
        if c == 1 or length >= 32:
            return sub.agg(F.min("h")).first()[0], n, k
        length += bucket_chars


def grouped_split(df: DataFrame, case_col: str = "test_case_id", val_ratio: float = 0.2,
                  seed: int = 42) -> DataFrame:
    """G1: every row gets split = 'val' | 'train' by its case; exactly
    ⌊n·ratio⌋ cases are validation.  Membership (D12, I3) is a per-row
    comparison with the threshold hash — no join with the case list."""
    h, _, _ = split_threshold(df, case_col, val_ratio, seed)
    hv = _case_hash(F.col(case_col), seed)
    is_val = F.lit(False) if h is None else hv <= F.lit(h)
    return df.withColumn("split", F.when(is_val, F.lit("val")).otherwise(F.lit("train")))

