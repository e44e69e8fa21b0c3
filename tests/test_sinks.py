"""Sinks that go on after an interruption, and the scorer that is asked once for each text."""

import os
import time

import pytest
from pyspark.sql import functions as F

from judgefuse.operators import metrics as M
from judgefuse.operators.scorer import answers_of, bounded_scorer
from judgefuse.plans import jobs
from judgefuse.sources import sinks
from judgefuse.sources.records import upsert_latest, write_results


def test_an_interrupted_append_goes_on_without_repeats(spark, tmp_path):
    path = str(tmp_path / "out")
    tasks = spark.createDataFrame([(f"t{k}",) for k in range(40)] + [(None,), ("t1",)], "project_name string")
    calls = []

    def work(part):
        calls.append(1)
        if len(calls) == 3:
            return part.select("project_name", F.raise_error(F.lit("lost")).cast("int").alias("n"))
        return part.groupBy("project_name").agg(F.count(F.lit(1)).cast("int").alias("n"))

    with pytest.raises(Exception, match="lost"):
        sinks.append_batches(tasks, work, path, batches=4)
    kept = sinks.finished_batches(spark, path)
    assert len(kept) == 2
    done = {r[0] for r in sinks.read_appended(spark, path).select("project_name").collect()}
    assert 0 < len(done) < 41
    sinks.append_batches(tasks, work, path, batches=4)
    assert set(kept) < set(sinks.finished_batches(spark, path))
    rows = sorted(((r[0] or "", r[1]) for r in sinks.read_appended(spark, path).collect()))
    assert rows == sorted([("", 1), ("t1", 2), *((f"t{k}", 1) for k in range(40) if k != 1)])
    assert sinks.pending(tasks, path, "project_name").count() == 0


def test_nothing_appended_yet(spark, tmp_path):
    assert sinks.finished_batches(spark, str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        sinks.read_appended(spark, str(tmp_path / "none"))


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    path, cols = str(tmp_path / "t"), "project_name string, score int, ord long"
    old = spark.createDataFrame([(f"p{k}", k, k) for k in range(50)] + [("p1", 7, 99), (None, 1, 1)], cols)
    new = spark.createDataFrame([("p3", 100, 0), ("p3", 101, 5), ("fresh", 1, 1), (None, 2, 0)], cols)
    sinks.upsert_buckets(old, path, buckets=16)
    before = _files(path)
    sinks.upsert_buckets(new, path, buckets=16)
    after = _files(path)
    bucket = lambda f: f.split("bucket_of_16=")[1].split("/")[0]
    touched = {bucket(f) for f in after - before}
    assert len(touched) <= 3
    assert {f for f in before if bucket(f) not in touched} == {f for f in after if bucket(f) not in touched}
    got = sorted(map(tuple, sinks.read_buckets(spark, path).select("project_name", "score", "ord").collect()), key=str)
    want = sorted(map(tuple, upsert_latest(old, new).select("project_name", "score", "ord").collect()), key=str)
    assert got == want and ("p3", 101, 5) in got and (None, 2, 0) in got
    sinks.upsert_buckets(new.limit(0), path, buckets=16)
    assert _files(path) == after
    with pytest.raises(ValueError, match="8 buckets"):
        sinks.upsert_buckets(new, path, buckets=8)


def test_flip_frames(spark, tmp_path):
    rows = [("a", 0.0, 0, 0), ("b", 0.0, 1, 0), ("c", 1.0, 0, 1), ("d", 1.0, 1, 1), ("e", 1.0, 0, 0), ("f", 1.0, 1, 0),
            ("g", None, 1, 1), ("h", 1.0, 1, None)]
    cases = spark.createDataFrame(rows, "case_id string, agent_original double, corrected_label int, human_gt int")
    write_results(M.flip_frames(cases), str(tmp_path / "f"), "csv", by=("frame",))
    got = {}
    for d in os.listdir(tmp_path / "f"):
        if d.startswith("frame="):
            got[d[6:]] = sorted(r[0] for r in spark.read.csv(str(tmp_path / "f" / d), header=True).select("case_id").collect())
    assert got == {"subset_A_original_0": ["a", "b"], "misflipped_original_0": ["b"], "subset_A_original_1": ["c", "d"],
                   "misflipped_original_1": ["c"], "subset_B_corrected": ["e", "g"]}


def test_trajectory_job_counts_failed_tasks_and_tries_them_again(spark, tmp_path):
    said = "array<struct<role: string, content: string>>"
    say = [("assistant", "Thought: look\nAction: click(point='<point>10 10</point>')")]
    docs = spark.createDataFrame(
        [("web_1_1", 1, say, [5], [], None), ("web_1_2", 2, None, [5], [], '{"traj'), ("web_1_3", 3, say, None, None, None),
         ("web_1_4", 4, say * 2, [5, 6], None, None)],
        f"project_name string, task long, messages {said}, screens array<long>, codes array<string>, bad_document string")
    tasks = spark.createDataFrame([(k, "web_1", str(k), "DONE", "do") for k in range(1, 5)],
                                  "task long, web_id string, task_id string, final_result string, instruction string")
    elements = spark.createDataFrame([(5, 1, "ok", "Button", 0, 0, 20, 20, 0)],
                                     "screen_id long, el_id long, ui_name string, control_type string, x1 int, y1 int, x2 int, y2 int, pos int")
    first = jobs.record_trajectories(docs, tasks, elements, str(tmp_path / "run"), batches=3)
    assert first == {"n_tasks": 4, "n_processed": 2, "n_failed": 2, "n_iters": 3, "n_coordinate_cases": 2}
    again = jobs.record_trajectories(docs, tasks, elements, str(tmp_path / "run"), batches=3)
    assert again == {"n_tasks": 2, "n_processed": 0, "n_failed": 2, "n_iters": 0, "n_coordinate_cases": 0}
    none = jobs.record_trajectories(docs.limit(0), tasks, elements, str(tmp_path / "run"))
    assert set(none.values()) == {0}
    got = sinks.read_appended(spark, str(tmp_path / "run" / "records"))
    assert sorted(r[0] for r in got.select("project_name").collect()) == ["web_1_1", "web_1_4"]


def test_answers_in_order_with_errors_and_time_limit():
    def ask(t):
        if t == "slow":
            time.sleep(5)
        if t == "bad":
            raise ValueError(t)
        return t.upper()

    start = time.monotonic()
    assert list(answers_of(["a", "bad", "slow", "b", "c"], ask, 2, 0.3)) == ["A", None, None, "B", "C"]
    assert time.monotonic() - start < 3


def test_scorer_asks_each_text_once_and_keeps_answers(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(t):
        (log / f"{t}-{time.time_ns()}").write_text("")
        if t == "bad":
            raise ValueError(t)
        return "Yes"

    scorer = bounded_scorer(ask, str(tmp_path / "answers"), in_flight=2, parts=2, batches=2)
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "bad"), (4, None), (5, "y")], "action_id int, evidence string")
    want = [(1, "Yes"), (2, "Yes"), (3, "No"), (4, "No"), (5, "Yes")]
    for _ in range(2):
        assert sorted(map(tuple, scorer(df).select("action_id", "agent_noresp").collect())) == want
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == ["bad", "x", "y"]
