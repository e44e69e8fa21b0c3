"""Trace logs on literal texts: repeated iterations, field rules, bad numbers."""

import pathlib
import random
import re
import time

from judgefuse.operators import tracelog as TL


def block(n, click=(500, 500), box=(10, 10, 50, 50), op="press it", answer="CORRECT", history=""):
    return (f"#### iter:{n}\n######################## output_action:\n### Action ###\npyautogui.click({click[0]}, {click[1]})\n"
            f"### Operation ###\n{op}\n### Task List ###\nx\n######################## output_action end\n"
            f"######################## reflection_output:\n### Answer ###\n{answer}\n\n"
            f"######################## reflection_output end\n### Screenshot information ###\nThe information is as follow:\n"
            f"(1, 1); text:a; control_type:Button; rect: {box}\n"
            "Please note that this information is not necessarily accurate\n### Hints ###\n" + history)


def run(spark, text, **kw):
    logs = spark.createDataFrame([("p", "head\n" + text)], "project_name string, text string")
    return sorted(TL.trace_log_pipeline(logs, **kw).collect(), key=lambda r: r.seg)


def test_repeated_iteration_numbers_do_not_mix(spark):
    a, b = (490, 490, 520, 520), (10, 10, 50, 50)
    rows = run(spark, block(1, click=(500, 500), box=b) + block(1, click=(20, 20), box=a))
    assert [r.accuracy for r in rows] == [0, 0] and [r.matched_element_id for r in rows] == [None, None]
    assert [len(r.element_distance_sorting) for r in rows] == [1, 1]


def test_empty_operation_and_bad_numbers(spark):
    rows = run(spark, block(1, op="  ") + block(2, click=(99999999999, 3)) + block(3, box=(1, 1, 99999999999, 5)))
    assert [r.accuracy for r in rows] == [None, None, 0]
    assert [r.method for r in rows] == [None, None, "element_tree_failed"]


def test_history_overrides_field_by_field(spark):
    history = ("### History operations ###\nStep-1: Action: pyautogui.press('x')\nReflection_thought: one\n\tMemory: m\n"
               "Step-1: Operation: second op\nAction: pyautogui.click(7, 8)\nReflection_thought: two\n### Last Task List ###\n")
    r = run(spark, block(1, history=history))[0]
    assert (r.operation_desc, r.action_content, r.reflection_thought) == ("second op", "pyautogui.press('x')", "one")
    assert (r.click_x, r.click_y) == (7, 8)


def test_error_only(spark):
    rows = run(spark, block(1) + block(2, answer="ERROR") + block(3, answer="?"), condition="error_only")
    assert [r.method for r in rows] == [None, "element_tree", None]


def test_elements_of_a_block(spark):
    lines = ["(1, 1); text:; control_type:Text; rect: (10, 10, 40, 40)", "(1, 1); text:named; control_type:Text; rect: (10, 10, 40, 40)",
             "(1, 1); text:box; control_type:Group; rect: (0, 0, 90, 90)", "(1, 1); text:img; control_type:Image; rect: (10, 10, 20, 20)",
             "(1, 1); text:win; control_type:Pane; rect: (0, 0, 200000, 200000)", "(1, 1); text:far; control_type:Edit; rect: (80, 80, 85, 85)"]
    df = spark.createDataFrame([("\n".join(lines),)], "info string")
    got = df.select(TL.cleaned_elements(TL.parsed_elements(df.info)).alias("e")).first().e
    assert [(e.el_id, e.pos) for e in got] == [("element_1", 0), ("element_5", 5)]


def test_large_logs_are_split_by_block(spark, tmp_path):
    history = "### History operations ###\nStep-2: Operation: told\nAction: a\nReflection_thought: r\n### Last Task List ###\n"
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        text = "head\n" + "".join(block(n, history=history if n == 40 else "") for n in range(1, 41))
        (tmp_path / name / "same.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        blocks = TL.read_log_blocks(spark, str(tmp_path / "*"))
        assert blocks.rdd.getNumPartitions() > 2
        got = TL.trace_log_pipeline(blocks).drop("seg").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = TL.trace_log_pipeline(TL.read_logs(spark, str(tmp_path / "*"))).drop("seg").collect()
    assert len(got) == 80 and sorted(map(str, got)) == sorted(map(str, want))
    assert {r.operation_desc for r in got if r.iter_num == 2} == {"told"}


def plain_cleaned(elements):
    """I1 and D8 of a list of dicts, by all pairs."""
    kept, out = [e for e in elements if e["control_type"] not in TL.DROPPED_TYPES], {}
    for e in kept:
        out.setdefault((e["x1"], e["y1"], e["x2"], e["y2"]), []).append(e)
    single = [{**next((e for e in same if e["ui_name"]), same[0]), "pos": same[0]["pos"]} for same in out.values()]
    if len(single) < 2:
        return single

    def holds(a, b):
        inside = a["x1"] <= b["x1"] and a["y1"] <= b["y1"] and a["x2"] >= b["x2"] and a["y2"] >= b["y2"]
        return a is not b and inside and (not a["ui_name"] or b["control_type"] in TL.FUNCTIONAL_TYPES
                                          and a["control_type"] not in TL.FUNCTIONAL_TYPES)
    return [a for a in single if a["control_type"] not in TL.CONTAINER_TYPES and not any(holds(a, b) for b in single)]


ELEMENTS = "id int, els array<struct<el_id:string,pos:int,cx:int,cy:int,ui_name:string,control_type:string,x1:int,y1:int,x2:int,y2:int>>"


def element_list(rng, n, span, side):
    types = [*TL.DROPPED_TYPES, *TL.CONTAINER_TYPES, *TL.FUNCTIONAL_TYPES, "Text", "Text", "Text", "Group", "Edit"]
    out = []
    for k in range(n):
        x, y = rng.randint(0, span), rng.randint(0, span)
        out.append(dict(el_id=f"element_{k}", pos=k, cx=0, cy=0, ui_name=rng.choice(["", "a"]), control_type=rng.choice(types),
                        x1=x, y1=y, x2=x + rng.randint(0, side), y2=y + rng.randint(0, side)))
    return out


def test_elements_of_a_block_against_all_pairs(spark):
    rng = random.Random(3)
    lists = [element_list(rng, rng.randint(0, 25), rng.choice([2, 6, 40]), rng.choice([2, 8, 60])) for _ in range(400)]
    rows = [(k, [tuple(e.values()) for e in es]) for k, es in enumerate(lists)] + [(-1, None)]
    df = spark.createDataFrame(rows, ELEMENTS)
    got = {r.id: r.c for r in df.select("id", TL.cleaned_elements(df.els).alias("c")).collect()}
    assert not got.pop(-1)
    for k, es in enumerate(lists):
        assert [e.asDict() for e in got[k]] == plain_cleaned(es), es


def test_large_block(spark):
    rng = random.Random(4)
    es = element_list(rng, 5000, 20000, 60)
    df = spark.createDataFrame([(0, [tuple(e.values()) for e in es])], ELEMENTS).cache()
    df.count()
    out = df.select(TL.cleaned_elements(df.els).alias("c"))
    out.collect()
    begin = time.perf_counter()
    got = out.first().c
    assert time.perf_counter() - begin < 4
    assert [e.el_id for e in got] == [e["el_id"] for e in plain_cleaned(es)]


def test_last_history_section(spark):
    h, e = TL.HISTORY_MARK, TL.HISTORY_END
    texts = [f"x{h}a{e}b", f"{h}a{e}{h}b{h}c{e}d{e}", f"{h}a", f"a{e}b", "", f"{e}{h}a{e}{e}t", f"{h}a{e}x{h}", f"{h}{e}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.h for r in df.orderBy("k").select(TL._last_history(df.t).alias("h")).collect()]
    want = [(re.findall(f"(?s){re.escape(h)}(.*?)(?={re.escape(e)}|$)", t) or [None])[-1] for t in texts]
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_nobody_reads_are_not_parsed(spark):
    logs = spark.createDataFrame([("p", "head\n" + block(1))], "project_name string, text string")
    plan = plan_of(TL.parse_iterations(logs).select("iter_num", "reflection"))
    assert "### Answer ###" in plan and "Reflection Thought" not in plan and "Screenshot information" not in plan


def test_records_of_whole_logs_are_not_moved(spark):
    history = "### History operations ###\nStep-1: Operation: told\nAction: a\n### Last Task List ###\n"
    logs = spark.createDataFrame([("p", "head\n" + block(1, history=history))], "project_name string, text string")
    out = TL.trace_log_pipeline(logs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.operation_desc, r.action_content) for r in out.collect()] == [("told", "a")]


def test_log_blocks_of_loose_markers_are_not_checkpointed(spark, tmp_path):
    text = "head\n" + "".join(block(n, op=f"press #### iter:it #### iter: {n}") for n in range(1, 31))
    (tmp_path / "a.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        blocks = TL.read_log_blocks(spark, str(tmp_path))
        assert "LogicalRDD" not in plan_of(blocks)  # a checkpoint of the texts
        got = sorted((r.iter_num, r.operation) for r in TL.parse_blocks(blocks).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(n, f"press #### iter:it #### iter: {n}") for n in range(1, 31)]


def test_elements_of_blocks_without_a_click_are_not_parsed(spark):
    text = "head\n" + block(1, op=" ") + block(2, click=(20, 20))
    logs = spark.createDataFrame([("p", text)], "project_name string, text string")
    found = TL._log_blocks(logs, clicks_only=True).collect()
    assert [r.info is not None for r in sorted(found, key=lambda r: r.seg)] == [False, True]
    assert "CASE WHEN isnotnull(click_x" in plan_of(TL.trace_log_pipeline(logs).select("accuracy")).split("AS _els")[0].split("Project")[-1]
    assert [r.matched_element_id for r in run(spark, block(1, op=" ") + block(2, click=(20, 20)))] == [None, "element_0"]


def test_sections_by_plain_search(spark):
    rng = random.Random(5)
    start, end = TL.SECTION_MARKERS["screenshot"]
    bits = [start, end, "###", "#", " Hints", "\n", "\r", " ", "x", "\u2028", "\U0001F600", "\ud7ff", "\uffff", TL.ANSWER_MARKER, "\n\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    got = df.select(TL._section(df.t, "screenshot").alias("s"), TL._answer(df.t).alias("a")).collect()
    for t, r in zip(texts, got):
        _, found, rest = t.partition(start)
        assert r.s == (rest.partition(end)[0] if found and end in rest else ""), t
        answer = re.search(rf"(?s){TL.ANSWER_MARKER}[ \t\n\r\x0b\x0c]*(.*?)(?:\n\n|\Z)", t)
        assert r.a == (answer[1] if answer else ""), t


def test_log_blocks_query_drops_each_turns_texts(spark, tmp_path, monkeypatch):
    from judgefuse.plans import q_trace
    from judgefuse.session import shared_folder

    spark.range(60).selectExpr("id AS event_id").union(spark.sql("SELECT 7L")).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(20).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    kept = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    texts = lambda: set(kept.glob("logs-*/texts-*"))
    before, seen, read = texts(), [], TL.read_log_blocks

    def reading(*args):
        seen.append(len(texts() - before))
        return read(*args)
    monkeypatch.setattr(TL, "read_log_blocks", reading)

    def rows():
        return sorted(map(str, q_trace.q_log_blocks(spark, str(tmp_path)).collect()))
    whole = rows()
    monkeypatch.setattr(q_trace, "LOGS_A_TURN", 20)
    assert rows() == whole and len(whole) == sum(e % 6 + 1 for e in [*range(60), 7])
    assert seen == [1] * 5 and not texts() - before
    assert [q_trace._turns(n) for n in (0, 25, 10 ** 9)] == [1, 2, q_trace.TURNS]
