"""File sources and sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from judgefuse.operators import tracelog as TL
from judgefuse.sources import records as R


def test_jsonl_skips_blank_lines_and_fails_on_bad_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in R.read_jsonl(spark, str(p), "a int").collect()) == [1, 2]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(bad), "a int").collect()


def test_load_table_dispatch(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("x,y\n1,a\n2,b\n")
    assert R.load_table(spark, str(csv)).count() == 2
    with pytest.raises(ValueError, match="Unsupported"):
        R.load_table(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(ValueError, match="Unsupported"):
        R.load_table(spark, str(tmp_path / "t.txt"))


def test_sinks_roundtrip(spark, tmp_path):
    rows = [(1, 'a "quoted" text,\nsecond line'), (2, "b"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "x int, y string")
    for fmt in ("csv", "jsonl", "parquet"):
        out = str(tmp_path / f"t.{fmt}")
        R.write_results(df, out, fmt)
        back = {r.x: r.y for r in R.load_table(spark, out, "x int, y string").collect()}
        assert {x: y or None for x, y in back.items()} == {x: y or None for x, y in rows}
    with pytest.raises(ValueError):
        R.write_results(df, str(tmp_path / "x"), "xlsx")


def test_upsert_duplicates(spark):
    old = spark.createDataFrame([("p1", 1, 1), ("p1", 2, 2), ("p2", 3, 3)], "project_name string, score int, ord long")
    new = spark.createDataFrame([("p1", 9, 0), ("p3", 7, 5), ("p3", 8, 6)], "project_name string, score int, ord long")
    got = {r.project_name: r.score for r in R.upsert_latest(old, new).collect()}
    assert got == {"p1": 9, "p2": 3, "p3": 8}


def test_gt_lookup_last_wins_and_nulls(spark):
    df = spark.createDataFrame([("w", "1", 0, 1), ("w", "1", 1, 2), ("w", None, 1, 3), ("v", "2", None, 4)],
                               "web_id string, task_id string, label int, ord long")
    got = {r.key: r.value for r in R.gt_lookup(df).collect()}
    assert got == {"w_1": 1}


def _write(p, obj):
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_trajectory_tree(spark, tmp_path):
    root = str(tmp_path / "data")
    traj = {"trajectory": [{"role": "user", "content": "go"},
                           {"role": "assistant", "content": "Thought: a\nAction: click(point='<point>1 2</point>')"}],
            "codes": ["pyautogui.click(1, 2)"], "final_result": "DONE"}
    _write(f"{root}/web_0/task_1/messages.json", traj)
    _write(f"{root}/web_0/task_1/metadata.json", {"web_id": "web_0", "task_id": "1", "instruction": "do it"})
    _write(f"{root}/web_3/task_7/messages.json", {**traj, "final_result": "FAILED"})
    _write(f"{root}/web_4/task_2/messages.json", "{not json")
    t = {(r.web_id, r.task_id): r for r in R.read_trajectory_tree(spark, root).collect()}
    assert set(t) == {("web_0", "1"), ("web_3", "7"), ("web_4", "2")}
    assert t[("web_4", "2")].bad_document == "{not json" and t[("web_0", "1")].bad_document is None
    assert t[("web_0", "1")].instruction == "do it" and t[("web_3", "7")].instruction == ""
    assert R.trajectory_turns(R.read_trajectory_tree(spark, root)).count() == 4


def test_read_logs_whole_text(spark, tmp_path):
    p = tmp_path / "proj_a.txt"
    p.write_text("head\n#### iter:1\nx\n#### iter:2\ny\n")
    logs = TL.read_logs(spark, str(p))
    r = logs.first()
    assert r.project_name.endswith("/proj_a.txt") and r.text.startswith("head")
    its = TL.log_iterations(logs).orderBy("seg").collect()
    assert [i.iter_num for i in its] == [1, 2]


STEPS_CSV = """test_case_id,ord,E1_gui,E2_code,M_gui,agent_testcase_score,phi,delta_label,note
c1,9,1.0,1,0,0,0.0,1,"a ""quoted"", note"
c1,10,0,1,0,1,1,0,x
c2,1,True,0.0,0,,1.0, Agent x,
c2,2,nan,0,1,1,NaN,,y
"""


def test_typed_csv_equals_typed_columns(spark, tmp_path):
    p = tmp_path / "steps.csv"
    p.write_text(STEPS_CSV)
    rows = R.good_rows(R.load_typed(spark, str(p), "steps"))
    kinds = dict(rows.dtypes)
    assert (kinds["ord"], kinds["E1_gui"], kinds["phi"], kinds["delta_label"], kinds["note"]) == ("bigint", "double", "bigint", "double", "string")
    got = {(r.test_case_id, r.ord): (r.E1_gui, r.agent_testcase_score, r.phi, r.delta_label) for r in rows.collect()}
    assert got == {("c1", 9): (1.0, 0.0, 0, 1.0), ("c1", 10): (0.0, 1.0, 1, 0.0), ("c2", 1): (1.0, None, 1, 1.0), ("c2", 2): (None, 1.0, None, None)}
    from judgefuse.operators import steps as S
    assert S.prepare(rows).groupBy("test_case_id").agg(S.last_non_null("agent").alias("a")).filter("test_case_id = 'c1'").first().a == 1.0


def test_rows_that_cannot_be_read_are_rejects(spark, tmp_path):
    p = tmp_path / "steps.csv"
    p.write_text(STEPS_CSV + "c3,1.5,1,1,0,0,0,0,whole numbers only\nc4,2,high,1,0,0,0,0,no number\nc5,3,1\n")
    loaded = R.load_typed(spark, str(p), "steps")
    assert R.good_rows(loaded).count() == 4
    rejects = {tuple(r.bad_columns): r.raw for r in R.reject_rows(loaded).collect()}
    assert set(rejects) == {("ord",), ("E1_gui",), ("_record",)} and rejects[("_record",)] == "c5,3,1" and "high" in rejects[("E1_gui",)]
    other = tmp_path / "two.csv"
    other.mkdir()
    (other / "a.csv").write_text("ord,phi\n1,0\n")
    (other / "b.csv").write_text("phi,ord\n1,7\n")   # columns in another order are not mixed up
    with pytest.raises(Exception, match="header"):
        R.load_typed(spark, str(other), "steps").collect()


def test_order_must_be_numbers_without_ties(spark):
    from judgefuse.operators import steps as S
    text = spark.createDataFrame([("a", "9", 1.0, 1.0)], "test_case_id string, ord string, E1_gui double, E2_code double")
    with pytest.raises(ValueError, match="holds text"):
        S.prepare(text)
    cols = "test_case_id string, ord long"
    S.check_order(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], cols))
    with pytest.raises(ValueError, match="3 rows share 1 places of their case, 1 rows have none"):
        S.check_order(spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 1), ("b", None)], cols))


def test_jobs_from_csv_equal_jobs_from_parquet(spark, tmp_path):
    from judgefuse.operators import em as EM
    from judgefuse.plans import fixtures as fx
    from judgefuse.plans import jobs
    base = str(tmp_path)
    raw = fx.steps_raw(spark, "/root/testdata/sf0.001")
    for fmt in ("csv", "parquet"):
        R.write_results(raw, f"{base}/steps.{fmt}", fmt)
        jobs.train(spark, f"{base}/steps.{fmt}", f"{base}/{fmt}")
        jobs.run_prediction(spark, f"{base}/steps.{fmt}", f"{base}/{fmt}/em_params", f"{base}/{fmt}/out", "parquet")
        jobs.train_lr(spark, f"{base}/steps.{fmt}", f"{base}/{fmt}/lr", val_ratio=0.25)
    assert EM.load_params(spark, f"{base}/csv/em_params").to_json() == EM.load_params(spark, f"{base}/parquet/em_params").to_json()
    for name in ("out/pred_step", "out/pred_corrected_cases", "out/flip_summary", "lr/val_corrected_cases", "lr/summary", "lr/split_counts"):
        one, two = (spark.read.parquet(f"{base}/{fmt}/{name}") for fmt in ("csv", "parquet"))
        assert one.count() and one.exceptAll(two.select(one.columns)).count() == 0, name
    # a case file that the job wrote as CSV is read back with numbers
    R.write_results(spark.read.parquet(f"{base}/csv/out/pred_corrected_cases"), f"{base}/cases.csv", "csv")
    cases = dict(R.good_rows(R.load_typed(spark, f"{base}/cases.csv", "cases")).dtypes)
    assert cases["human_gt"] == "bigint" and cases["P_case_AgentFail"] == "double"
    broken = f"{base}/broken.csv"
    R.write_results(raw.limit(20).withColumn("phi", F.when(F.col("ord") % 2 == 0, F.lit("?")).otherwise(F.col("phi").cast("string"))), broken, "csv")
    with pytest.raises(ValueError, match="cannot be read"):
        jobs.train(spark, broken, f"{base}/x")
    jobs.train(spark, broken, f"{base}/x", rejects_path=f"{base}/x/rejects")
    assert spark.read.json(f"{base}/x/rejects").count() > 0


def test_lr_prediction_from_saved_params(spark, tmp_path):
    from judgefuse.plans import fixtures as fx
    from judgefuse.plans import jobs
    base = str(tmp_path)
    R.write_results(fx.steps_raw(spark, "/root/testdata/sf0.001"), f"{base}/steps.parquet")
    p = jobs.train_lr(spark, f"{base}/steps.parquet", f"{base}/lr", val_ratio=0.5)
    from judgefuse.operators import baseline_lr as LR
    assert LR.load_params(spark, f"{base}/lr/lr_params") == p
    cases = jobs.run_lr_prediction(spark, f"{base}/steps.parquet", f"{base}/lr/lr_params", f"{base}/pred")
    val = spark.read.parquet(f"{base}/lr/val_corrected_cases")
    both = val.alias("v").join(cases.alias("c"), "case_id").filter("abs(v.P_case_AgentFail - c.P_case_AgentFail) < 1e-12")
    assert both.count() == val.count() > 0 and cases.count() > val.count()


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_log_blocks_in_small_splits_equal_whole_logs(spark, tmp_path, split):
    """Markers without a number are text, in one split and across several."""
    blocks = "".join(f"#### iter:{i}\n######################## output_action:\n### Action ###\npyautogui.click({i}, 2)\n"
                     f"### Operation ###\nclick {i} #### iter:x {'é y' * (i * 9)}\n#### iter: again\n### Task List ###\n"
                     "######################## output_action end\n" for i in range(1, 30))
    texts = {"a.txt": "head #### iter:\n" + blocks, "b.txt": blocks + "#### iter:", "c.txt": "no marker", "d.txt": "#### iter:7\nlast",
             "e.txt": "x\n#### iter:1\n### History operations ###\nStep-1: Operation: do\nAction: a\n#### iter:2\nend"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = TL.read_log_blocks(spark, str(tmp_path))
        fields = ("project_name", "iter_num", "operation", "action_content", "click_x", "history")
        got = sorted((tuple(r[f] for f in fields) for r in TL.parse_blocks(read).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted((tuple(r[f] for f in fields) for r in TL.parse_iterations(TL.read_logs(spark, str(tmp_path))).collect()), key=str)
    keep = lambda rows: [r for r in rows if "e.txt" not in r[0]]
    assert keep(got) == keep(want) and len(want) == 29 + 29 + 1 + 2
    assert any("#### iter:x" in r[2] and "#### iter: again" in r[2] for r in got if r[2])
