"""Normalisation, step posterior, case aggregation and correction on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from judgefuse.operators import cases as C
from judgefuse.operators import metrics as M
from judgefuse.operators import steps as S
from judgefuse.operators.model import ChannelWeights, EMParams

P = EMParams.two_cause((0.29, 0.71), (0.19, 0.77, 0.44), (0.45, 0.95, 0.05), (0.03, 0.93))
W = ChannelWeights(1.0, 1.2, 0.3, 0.9)
NAN = float("nan")

RAW_SCHEMA = ("test_case_id string, ord long, E1_gui double, E2_code double, E4_noresp double, "
              "M_gui double, M_code double, M_noresp double, weight double, "
              "agent_testcase_score double, delta_label string, phi int")


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_normalise_edge_values(spark):
    rows = [("a", 1, NAN, 0.5, None, 0.5, 0.49, None, -1.0, 0.7, "EnvFail", 1),
            ("a", 2, 1.7, 0.2, 0.9, 0.0, 1.0, 1.0, 12.0, None, " agent ", None),
            ("b", 3, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.3, 0.2, "1", 0),
            ("c", 4, None, None, None, None, None, None, None, None, None, None)]
    out = {r["ord"]: r for r in S.prepare(raw(spark, rows)).collect()}
    assert (out[1]["E1_gui"], out[1]["E2_code"], out[1]["E4_noresp"]) == (0.0, 1.0, 0.0)
    assert (out[2]["E1_gui"], out[2]["E2_code"], out[2]["E4_noresp"]) == (1.0, 0.0, 1.0)
    assert (out[1]["M_gui"], out[1]["M_code"], out[1]["M_noresp"]) == (1, 0, 0)
    assert out[1]["weight"] == 0.0 and out[2]["weight"] == 10.0
    assert out[1]["agent"] == 1.0 and out[2]["agent"] is None and out[3]["agent"] == 0.0
    assert out[1]["delta"] == 0.0 and out[2]["delta"] == 1.0 and out[3]["delta"] is None
    assert out[4]["E1_gui"] == 0.0 and out[4]["M_gui"] == 0


def test_missing_required_column_raises(spark):
    df = spark.createDataFrame([("a", 1.0)], "test_case_id string, E1_gui double")
    with pytest.raises(ValueError, match="E2_code"):
        S.apply_defaults(df)


def test_defaults_fill_optional(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.0)], "test_case_id string, ord long, E1_gui double, E2_code double")
    r = S.prepare(df).first()
    assert r["E4_noresp"] == 0.0 and r["weight"] == 1.0 and r["agent"] is None and r["step"] == "0"


def _numpy_step_post(e, m, c):
    out = []
    for d in range(2):
        l = math.log(P.p_delta[d] + 1e-9)
        for j in range(3):
            if m[j] == 1:
                continue
            th = P.theta[d][j]
            l += W.w[j] * (math.log(th + 1e-9) if e[j] == 1 else math.log(1 - th + 1e-9))
        if c is not None:
            psi = min(max(P.psi[d], 1e-4), 1 - 1e-4)
            l += W.agent_weight * (c * math.log(psi) + (1 - c) * math.log(1 - psi))
        out.append(l)
    mx = max(out)
    lse = mx + math.log(sum(math.exp(x - mx) for x in out) + 1e-9)
    return [math.exp(x - lse) for x in out]


STEP_ROWS = [
    ("a", 1, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.3, None, None, 1),
    ("a", 2, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.5, 0.0, None, 1),
    ("a", 3, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.5, 1.0, None, None),   # last verdict 1
    ("b", 4, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.3, None, None, 0),     # no verdict
    ("c", 5, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.5, 0.0, None, 0),      # single-row case
]


def test_step_posterior_matches_direct_formula(spark):
    steps = S.prepare(raw(spark, STEP_ROWS))
    got = {r["ord"]: r for r in C.step_posterior(steps, P, W).collect()}
    case_c = {"a": 1.0, "b": None, "c": 0.0}
    for row in STEP_ROWS:
        e, m = row[2:5], row[5:8]
        exp = _numpy_step_post(e, m, case_c[row[0]])
        assert got[row[1]]["P_EnvFail"] == pytest.approx(exp[0], abs=1e-12)
        assert got[row[1]]["P_AgentFail"] == pytest.approx(exp[1], abs=1e-12)
        assert got[row[1]]["P_EnvFail"] + got[row[1]]["P_AgentFail"] == pytest.approx(1.0, abs=1e-8)


def test_noisy_or_matches_join_based_computation(spark):
    steps = S.prepare(raw(spark, STEP_ROWS))
    got = {r["case_id"]: r for r in C.case_noisy_or(steps, P, W, 0.75).collect()}
    case_c = {"a": 1.0, "b": None, "c": 0.0}
    for cid in "abc":
        prod = 1.0
        for row in STEP_ROWS:
            if row[0] == cid:
                q = _numpy_step_post(row[2:5], row[5:8], case_c[cid])[1]
                prod *= (1 - q) ** 0.75
        assert got[cid]["P_case_AgentFail"] == pytest.approx(1 - prod, abs=1e-12)
        assert got[cid]["agent_original"] == case_c[cid]
    assert got["a"]["human_gt"] == 1 and got["b"]["human_gt"] == 0


def test_threshold_rule_branches(spark):
    rows = [("x1", 1, 0.0, 0.2, 0.8), ("x2", 1, 0.0, 0.75, 0.25), ("x3", 0, 0.0, 0.5, 0.5),
            ("x4", 0, 1.0, 0.2, 0.8), ("x5", 1, 1.0, 0.1, 0.9), ("x6", 1, None, 0.9, 0.1),
            ("x7", 1, 0.0, 0.25, 0.75)]
    df = spark.createDataFrame(rows, "case_id string, human_gt int, agent_original double, "
                                     "P_case_EnvFail double, P_case_AgentFail double")
    out = {r["case_id"]: (r["corrected_label"], r["action"])
           for r in C.correct_threshold(df, 0.75, 0.75, 0.2).collect()}
    assert out["x1"] == (1, "flip_to_AgentFail")
    assert out["x2"] == (0, "keep_EnvFail")
    assert out["x3"] == (0, "keep_AgentJudge")
    assert out["x4"] == (0, "flip_to_EnvFail")        # P_env exactly at tau_envfail_high
    assert out["x5"] == (1, "keep_AgentJudge")
    assert out["x6"] == (None, "keep_AgentJudge")
    assert out["x7"] == (1, "flip_to_AgentFail")      # P_agent exactly at tau_agentfail


def test_margin_rule_golden_rows(spark):
    # (agent, P_env, P_agent) -> action, as in the committed 2-cause results
    rows = [("r1", 1, 1.0, 6.327432376628573e-05, 0.9999367256762337),
            ("r2", 1, 0.0, 0.6136857499105827, 0.3863142500894173),
            ("r3", 0, 0.0, 0.2, 0.8), ("r4", 0, 1.0, 0.7, 0.3), ("r5", 1, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "case_id string, human_gt int, agent_original double, "
                                     "P_case_EnvFail double, P_case_AgentFail double")
    out = {r["case_id"]: (r["corrected_label"], r["action"]) for r in C.correct_margin(df, 0.0).collect()}
    assert out == {"r1": (1, "keep_AgentJudge"), "r2": (0, "keep_EnvFail_or_AgentFail"),
                   "r3": (1, "flip_to_AgentFail"), "r4": (0, "flip_to_EnvFail"),
                   "r5": (1, "from_model")}


def test_three_cause_type(spark):
    rows = [("w1", 0, 0.0, 0.00017597777711160625, 0.9265680355430801, 0.07325598667980825),
            ("w2", 1, 1.0, 2.8527912513570097e-05, 0.005009107032458316, 0.9949623650550281),
            ("w3", 0, 0.0, 0.999372789349943, 0.0005812556279682953, 4.595502208863892e-05)]
    df = spark.createDataFrame(rows, "case_id string, human_gt int, agent_original double, P_case_EnvFail double, "
                                     "P_case_AgentRetryFail double, P_case_AgentReasoningFail double")
    df = df.withColumn("P_case_AgentFail", F.col("P_case_AgentRetryFail") + F.col("P_case_AgentReasoningFail"))
    out = {r["case_id"]: (r["corrected_label"], r["action"], r["agent_fail_type"])
           for r in C.correct_margin(df, 0.0, ["AgentRetryFail", "AgentReasoningFail"]).collect()}
    assert out["w1"] == (1, "flip_to_AgentRetryFail", "AgentRetryFail")
    assert out["w2"] == (1, "keep_AgentJudge", "AgentReasoningFail")
    assert out["w3"] == (0, "keep_EnvFail_or_AgentFail", None)


def test_metrics_one_class_and_nulls(spark):
    rows = [("a", 1, 1.0, 1), ("b", 1, None, 1), ("c", 1, 0.0, 0), ("d", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "case_id string, human_gt int, agent_original double, corrected_label int")
    acc = M.accuracy(df).first()
    assert acc["n_cases"] == 3 and acc["acc_before"] == pytest.approx(1 / 3) and acc["acc_after"] == pytest.approx(2 / 3)
    bm = M.binary_metrics(df.filter("human_gt is not null"), "human_gt", "corrected_label").first()
    assert (bm["tp"], bm["fp"], bm["fn"], bm["tn"]) == (2, 0, 1, 0)
    assert bm["precision"] == 1.0 and bm["recall"] == pytest.approx(0.6667)
    empty = M.binary_metrics(df.limit(0), "human_gt", "corrected_label").first()
    assert empty["total"] == 0 and empty["precision"] == 0.0 and empty["f1"] == 0.0
    fa = M.flip_analysis(df.filter("human_gt is not null")).first()
    assert fa["subset_a"] == 1 and fa["misflipped"] == 0 and fa["subset_b"] == 2 and fa["corrected"] == 1


def test_result_independent_of_partitioning(spark):
    steps = S.prepare(raw(spark, STEP_ROWS))
    a = sorted(C.case_noisy_or(steps, P, W).collect())
    b = sorted(C.case_noisy_or(steps.repartition(3, "ord"), P, W).collect())
    assert a == b


def test_default_step_is_position_in_case(spark):
    rows = [("a", 30, 1.0, 0.0), ("b", 5, 0.0, 1.0), ("a", 10, 0.0, 0.0), ("a", 20, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "test_case_id string, ord long, E1_gui double, E2_code double")
    got = {(r["test_case_id"], r["ord"]): r["step"] for r in S.prepare(df).collect()}
    assert got == {("a", 10): "0", ("a", 20): "1", ("a", 30): "2", ("b", 5): "0"}


def test_case_value_reaches_hot_and_other_cases(spark):
    from judgefuse.operators import cases as C
    rows = [("hot", i, float(i % 2)) for i in range(3000)] + [(f"c{i // 2}", i, 1.0 if i % 2 else None) for i in range(5000)] + [(None, 1, 1.0)]
    s = spark.createDataFrame(rows, "test_case_id string, ord long, agent double")
    got = C.case_value_broadcast(s, ("agent",)).collect()
    assert len(got) == len(rows)
    assert {r.agent_case for r in got if r.test_case_id == "hot"} == {1.0}
    assert {r.agent_case for r in got if r.test_case_id and r.test_case_id != "hot"} == {1.0}


def test_null_weight_stays_null_and_padded_label(spark):
    from judgefuse.functions import evidence as ev
    df = spark.createDataFrame([(None, "\n agent x"), (20.0, "env"), (float("nan"), "1")], "w double, d string")
    got = df.select(ev.clip_weight("w").alias("w"), ev.delta_label("d", df.schema["d"].dataType).alias("d")).collect()
    assert [(r.w, r.d) for r in got] == [(None, 1.0), (10.0, 0.0), (None, None)]


def test_metrics_without_ground_truth(spark):
    from judgefuse.operators import metrics as M
    cases = spark.createDataFrame([(None, 1.0, 1)], "human_gt int, agent_original double, corrected_label int")
    assert M.accuracy(cases).first().acc_before is None and M.confusion(cases).first().accuracy is None


def test_order_is_required(spark):
    import pytest

    from judgefuse.operators.steps import prepare
    df = spark.createDataFrame([("a", 1.0, 1.0)], "test_case_id string, E1_gui double, E2_code double")
    with pytest.raises(ValueError, match="order"):
        prepare(df)


def test_missing_evidence_is_an_error_where_it_counts(spark):
    import pytest

    from judgefuse.operators.steps import check_evidence
    cols = "test_case_id string, E1_gui double, M_gui int, E2_code double, M_code int, weight double"
    check_evidence(spark.createDataFrame([("a", None, 1, 1.0, 0, 0.5)], cols))
    with pytest.raises(ValueError, match="E2_code in 2 rows, weight in 1 rows"):
        check_evidence(spark.createDataFrame([("a", None, 1, None, 0, 0.5), ("b", 1.0, 0, float("nan"), 0, None)], cols))


def test_jobs_end_to_end(spark, tmp_path):
    from judgefuse.plans import fixtures as fx
    from judgefuse.plans import jobs
    from judgefuse.sources.records import write_results
    base = str(tmp_path)
    write_results(fx.steps_raw(spark, "/root/testdata/sf0.001"), f"{base}/steps.parquet")
    jobs.train(spark, f"{base}/steps.parquet", base)
    cases = jobs.run_prediction(spark, f"{base}/steps.parquet", f"{base}/em_params", f"{base}/out", "parquet")
    assert spark.read.parquet(f"{base}/out/pred_corrected_cases").count() == cases.count() > 0
    assert spark.read.parquet(f"{base}/out/flip_summary").count() == 1
