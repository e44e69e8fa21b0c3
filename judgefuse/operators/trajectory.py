"""Agent trajectories -> per-step evidence.

A trajectory is one document: trajectories(task, messages, screens, codes) with
arrays in their order, as ``read_trajectory_tree`` reads them; tasks(task, web_id,
task_id, final_result, instruction).  Positions are array positions, so pairing
needs no shuffle.  Row tables (turns, codes) serve the single-field parsers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgefuse.functions import text as TX
from judgefuse.operators.ordering import group_positions
from judgefuse.operators.spatial import by_distance, screen_elements


def parsed_turns(turns: DataFrame) -> DataFrame:
    """B1 + B2 on assistant messages: thought, action, parsed action fields."""
    a = turns.filter(F.col("role") == "assistant")
    a = a.select("task", "turn", "content",
                 TX.thought_of("content").alias("thought"), TX.action_of("content").alias("action"))
    p = TX.parse_action(F.col("action"))
    return a.select("*", p["action_type"].alias("action_type"), p["action_target"].alias("action_target"),
                    p["x"].alias("x"), p["y"].alias("y"))


def code_clicks(codes: DataFrame, compact: bool = True) -> DataFrame:
    """Click coordinates found in code lines; with ``compact`` (parity,
    Q14) the lines without a click are dropped before positions are given."""
    c = codes.select("task", "code_no", TX.code_click(F.col("code")).alias("xy"))
    if compact:
        c = c.filter(F.col("xy").isNotNull())
    c = group_positions(c, ["task"], ["code_no"], "pos")
    return c.select("task", "pos", F.col("xy.x").alias("code_x"), F.col("xy.y").alias("code_y"))


def last_assistant_thought(turns: DataFrame) -> DataFrame:
    """Per task, the last assistant message's Thought (``Action:`` not
    newline-anchored), else the whole message stripped; '' without any."""
    last = turns.groupBy("task").agg(
        F.max_by(F.when(F.col("role") == "assistant", F.col("content")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("_c"))
    c = F.col("_c")
    th = F.when(c.isNull(), F.lit("")).when(c.rlike(TX.THOUGHT_LOOSE_RE),
                                            TX.thought_of(c, loose=True)).otherwise(TX.strip_ws(c))
    return last.select("task", th.alias("last_thought"))


def verdict_rows(tasks: DataFrame, thoughts: DataFrame) -> DataFrame:
    """One verdict row per task: DONE -> 1/Pass else 0/Fail; evidence is a
    JSON map {"0": {result, evidence, case_desc}}."""
    t = tasks.join(thoughts, "task", "left")
    done = F.coalesce(F.col("final_result") == "DONE", F.lit(False))
    result = F.when(done, F.lit("Pass")).otherwise(F.lit("Fail"))
    ev = F.to_json(F.create_map(F.lit("0"), F.struct(
        result.alias("result"), F.coalesce(F.col("last_thought"), F.lit("")).alias("evidence"),
        F.coalesce(F.col("instruction"), F.lit("")).alias("case_desc"))))
    return t.select(F.concat(F.col("web_id"), F.lit("_"), F.col("task_id")).alias("case_name"),
                    done.cast("int").alias("os_agent_score"), result.alias("result"), ev.alias("evidence"))


def tell_fields(final_result: Column, thought: Column, action: Column) -> tuple[Column, Column]:
    """(result, evidence) of the Tell record for the last step."""
    res = F.when(F.upper(F.coalesce(final_result, F.lit(""))) == "DONE", F.lit("Pass")).otherwise(F.lit("Fail"))
    fin = F.regexp_extract(F.coalesce(action, F.lit("")), TX.ACTION_FORMS["finished"], 1)
    has_fin = F.coalesce(action, F.lit("")).rlike(TX.ACTION_FORMS["finished"])
    th = F.coalesce(thought, F.lit(""))
    ev = (F.when(has_fin & (th != ""), F.concat(th, F.lit(" Final result: "), fin))
           .when(has_fin, fin).otherwise(th))
    ev = F.when(ev == "", F.concat(F.lit("Task completed with status: "), F.coalesce(final_result, F.lit(""))))\
        .otherwise(ev)
    return res, ev


def tell_text(result: Column, evidence: Column) -> Column:
    """B13: 'Tell ({"0": {"result": ..., "evidence": ...}})'."""
    return F.concat(F.lit("Tell ("), F.to_json(F.create_map(F.lit("0"), F.struct(
        result.alias("result"), evidence.alias("evidence")))), F.lit(")"))


def step_count() -> Column:
    """Steps of a document: the smaller number of assistant messages and screenshots (NULL lists are empty)."""
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    return F.least(F.coalesce(F.size(said), F.lit(0)), F.coalesce(F.size("screens"), F.lit(0)))


def positional_pairing(trajectories: DataFrame, compact: bool = True) -> DataFrame:
    """Assistant message i <-> screenshot i (steps = min of both counts)
    <-> code click i; coordinates from the action, else from the code.

    ``compact`` (parity, Q14): code lines without a click are left out before
    positions are given; otherwise line i belongs to message i."""
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    clicks = F.transform("codes", TX.code_click)
    if compact:
        clicks = F.filter(clicks, lambda c: c.isNotNull())
    t = trajectories.select("task", said.alias("_said"), "screens", clicks.alias("_clicks"))
    n = F.least(F.coalesce(F.size("_said"), F.lit(0)), F.coalesce(F.size("screens"), F.lit(0)))  # NULL lists are empty
    t = t.withColumn("_n", n).filter("_n > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    text, click = F.get("_said", F.col("pos"))["content"], F.get("_clicks", F.col("pos"))
    t = t.select("task", F.col("pos").cast("long").alias("pos"), (F.col("_n") - 1).cast("long").alias("_last"),
                 F.get("screens", F.col("pos")).alias("screen_id"), click.alias("_click"),
                 TX.thought_of(text).alias("thought"), TX.action_of(text).alias("action"))
    t = t.withColumn("_a", TX.parse_action(F.col("action")))
    x = F.col("_a.x")
    return t.select(
        "task", "pos", "_last", (F.col("pos") + 1).cast("int").alias("iter_num"), "screen_id", "thought", "action",
        F.col("_a.action_type").alias("action_type"), F.col("_a.action_target").alias("action_target"),
        F.coalesce(x, F.col("_click.x")).alias("click_x"),
        F.coalesce(F.when(x.isNotNull(), F.col("_a.y")), F.col("_click.y")).alias("click_y"))


def natural_sort_keys(case: Column) -> tuple[Column, Column]:
    """(X, Y) of 'web_X_Y', (0, 0) when the name does not match.  A number
    beyond a long counts as the largest one."""
    pat = r"^web_(\d+)_(\d+)"

    def part(i: int) -> Column:
        number = F.regexp_extract(case, pat, i).try_cast("long")
        return F.when(case.rlike(pat), F.coalesce(number, F.lit((1 << 63) - 1))).otherwise(F.lit(0))
    return part(1), part(2)


def trajectory_steps(trajectories: DataFrame, tasks: DataFrame, elements: DataFrame, compact: bool = True,
                     assume_hit: bool = False) -> DataFrame:
    """Per-step evidence records of every task.

    All elements of the click's screen are listed by centre distance (F1); the
    first is the match (F2: distance only, list position breaks ties) and
    accuracy is true containment (Q17), or always 1 with ``assume_hit``
    (parity).  The last step of a task carries the Tell record (B13) and the
    final result.  Joins: the task's row, and the screen's one row.
    """
    st = positional_pairing(trajectories, compact).join(tasks, "task", "left")
    st = st.join(screen_elements(elements), "screen_id", "left")
    click = F.col("click_x").isNotNull() & F.col("click_y").isNotNull()
    st = st.withColumn("_sorted", F.when(click & F.col("_els").isNotNull(), by_distance(
        F.col("_els"), F.col("click_x"), F.col("click_y"), by_area=False))).drop("_els")
    has = F.size("_sorted") > 0
    hit = F.exists("_sorted", lambda e: e["is_inside"])
    last = F.col("pos") == F.col("_last")
    res, ev = tell_fields(F.col("final_result"), F.col("thought"), F.col("action"))
    content = F.when(last, tell_text(res, ev)).otherwise(F.when(F.col("action") != "", F.col("action")))
    return st.select(
        F.concat(F.col("web_id"), F.lit("_"), F.col("task_id")).alias("project_name"), "task", "iter_num",
        "click_x", "click_y",
        F.when(F.col("thought") != "", F.col("thought")).alias("operation_desc"),
        "action_type", "action_target", content.alias("action_content"),
        F.when(last, res).alias("tell_result"), F.when(last, ev).alias("tell_evidence"),
        F.when(has, F.lit(1)).alias("coordinate_match"),
        F.when(has, F.lit(1) if assume_hit else hit.cast("int")).alias("accuracy"),
        F.when(has, F.get("_sorted", F.lit(0))["el_id"]).alias("matched_element_id"),
        F.when(last, F.col("final_result")).alias("final_result"),
        F.when(has, F.col("_sorted")).alias("element_distance_sorting"))


def nested_records(steps: DataFrame) -> DataFrame:
    """One record per task: its steps in order, the final result and a summary
    (a task's steps are one trajectory)."""
    step = F.struct("iter_num", *[c for c in steps.columns if c not in ("project_name", "task", "iter_num", "final_result")])
    return steps.groupBy("project_name").agg(
        F.sort_array(F.collect_list(F.struct(F.col("iter_num").alias("at"), step.alias("step")))).alias("_s"),
        F.max("final_result").alias("final_result"),
        F.struct(F.count(F.lit(1)).alias("total_iters"), F.count_if(F.col("coordinate_match") == 1).alias("coordinate_cases"),
                 F.count_if(F.col("accuracy") == 1).alias("coordinate_hits")).alias("summary")) \
        .select("project_name", F.transform("_s", lambda x: x["step"]).alias("results"), "final_result", "summary")


def task_totals(steps: DataFrame) -> DataFrame:
    """Per task, iterations and coordinate cases (steps with a click on
    a screen with elements)."""
    return steps.groupBy("project_name").agg(
        F.count(F.lit(1)).alias("total_iters"),
        F.count_if(F.col("coordinate_match") == 1).alias("coordinate_cases"))


def run_totals(per_task: DataFrame) -> DataFrame:
    """E16 run level: tasks, iterations, coordinate cases."""
    return per_task.agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("total_iters").alias("n_iters"),
                        F.sum("coordinate_cases").alias("n_coordinate_cases"))
