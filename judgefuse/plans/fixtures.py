"""Fixture views over the driver's parquet tables (FIXTURES.md §2), Spark side.

The same views are written in DuckDB SQL in ``judgefuse.plans.oracle``; the
driver compares both.  Every view is a lazy DataFrame derived from the given
tables, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgefuse.operators.model import EMParams

# Fixed literal parameters used by the scoring queries (FIXTURES.md §2).
LIT_PARAMS = EMParams.two_cause(pi=(0.29, 0.71), theta_env=(0.19, 0.77, 0.44),
                                theta_agent=(0.45, 0.95, 0.05), psi=(0.03, 0.93))
# Three-cause parameter set for the K-cause scoring path (H7).
LIT_PARAMS_K3 = EMParams(
    causes=["EnvFail", "AgentRetryFail", "AgentReasoningFail"],
    p_delta=[0.32, 0.23, 0.45],
    theta=[[0.29, 0.34, 0.21], [0.24, 0.95, 0.32], [0.42, 0.95, 0.05]],
    psi=[0.35, 0.03, 0.86])
TAU_AGENTFAIL, TAU_ENVFAIL, TAU_ENVFAIL_HIGH = 0.75, 0.75, 0.20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, turns: int = 1) -> DataFrame:
    """The rows of a small file, from each of which long texts are built, over all cores.  Only the given
    columns move; a fixed number of partitions is neither coalesced nor dealt again by a join on ``key``.
    One of several ``turns`` has its share of the partitions, all cores at least."""
    spark = df.sparkSession
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // turns)
    return df.repartition(max(spark.sparkContext.defaultParallelism, parts), key)


def steps_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence steps in the reference's column names (one row per event)."""
    ev = table(spark, sf_dir, "events")
    d = F.dayofmonth("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    click = t == "click"
    tell = t.isin("error", "purchase")
    base = ev.select(
        F.concat(F.lit("web_"), F.col("user_id"), F.lit("_"), d).alias("test_case_id"),
        F.col("event_id").alias("ord"),
        F.col("user_id"),
        t.alias("operation_desc"),
        F.when(click, (F.col("value") >= 20).cast("double")).otherwise(F.lit(0.0)).alias("E1_gui"),
        F.when(click, F.lit(0)).otherwise(F.lit(1)).alias("M_gui"),
        (((F.col("user_id") + d) % 4) != 0).cast("double").alias("E2_code"),
        F.lit(0).alias("M_code"),
        F.when(tell, ((k % 3) == 0).cast("double")).otherwise(F.lit(0.0)).alias("E4_noresp"),
        F.when(tell, F.lit(0)).otherwise(F.lit(1)).alias("M_noresp"),
        F.when(tell, F.lit(0.5)).otherwise(F.lit(0.3)).alias("weight"),
        tell.cast("int").alias("is_reflection"),
        F.when(t == "purchase", F.lit(1.0)).when(t == "error", F.lit(0.0))
         .cast("double").alias("agent_testcase_score"),
        (((F.col("user_id") * 7 + d) % 10) < 6).cast("int").alias("phi"),
    ).withColumn("step", F.concat(F.col("test_case_id"), F.lit("_iter_"), F.col("ord")))
    agent_case = base.groupBy("test_case_id").agg(
        F.max_by("agent_testcase_score",
                 F.when(F.col("agent_testcase_score").isNotNull(), F.col("ord"))).alias("_c"))
    delta = (F.when((F.col("user_id") % 5 == 0) & (F.col("phi") == 1) & (F.col("_c") == 0.0), F.lit(1.0))
              .when((F.col("user_id") % 5 == 0) & (F.col("phi") == 0) & (F.col("_c") == 1.0), F.lit(0.0)))
    return (base.join(agent_case, "test_case_id", "left")
                .withColumn("delta_label", delta.cast("double"))
                .drop("_c", "user_id"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised steps (C1-C6 applied)."""
    from judgefuse.operators.steps import prepare
    return prepare(steps_raw(spark, sf_dir))


# ---- evaluation inputs (from labels / documents) -----------------------------------------
def _case_name(doc_id="doc_id"):
    return F.concat(F.lit("web_"), F.col(doc_id) % 50, F.lit("_"), F.col(doc_id))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_name, os_agent_score (1 - toxic, NULL when doc_id % 17 = 0), evidence JSON."""
    lb = table(spark, sf_dir, "labels")
    res0 = F.when(F.col("toxic") == 0, F.lit("Pass")).otherwise(F.lit("Fail"))
    res1 = F.when(F.col("quality") == 1, F.lit("Pass")).otherwise(F.lit("Fail"))
    item = lambda k, r: F.concat(F.lit(f'"{k}": {{"result": "'), r, F.lit('", "evidence": "doc '),
                                 F.col("doc_id"), F.lit(f' item {k}", "case_desc": "q'),
                                 F.col("quality"), F.lit('"}'))
    return lb.select(
        _case_name().alias("case_name"),
        F.when(F.col("doc_id") % 17 != 0, (F.lit(1) - F.col("toxic"))).cast("int").alias("os_agent_score"),
        F.concat(F.lit("{"), item(0, res0), F.lit("}")).alias("evidence"),
        F.concat(F.lit("{"), item(0, res0), F.lit(", "), item(1, res1), F.lit("}")).alias("evidence_batch"),
        F.col("doc_id").alias("ord"))


def gt_webdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth, layout A: web_id, task_id, label, code (doc_id % 11 = 0 missing)."""
    lb = table(spark, sf_dir, "labels").filter(F.col("doc_id") % 11 != 0)
    return lb.select(F.concat(F.lit("web_"), F.col("doc_id") % 50).alias("web_id"),
                     F.col("doc_id").cast("string").alias("task_id"),
                     F.col("quality").alias("label"),
                     F.concat(F.lit("code "), F.col("doc_id")).alias("code"),
                     F.col("doc_id").alias("ord"))


def gt_realdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth, layout B: test_case_name, GT_value."""
    lb = table(spark, sf_dir, "labels").filter(F.col("doc_id") % 11 != 0)
    return lb.select(_case_name().alias("test_case_name"), F.col("quality").alias("GT_value"),
                     F.col("doc_id").alias("ord"))


def gt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key/value lines with duplicates and NULLs for the last-wins lookup (A5)."""
    lb = table(spark, sf_dir, "labels")
    return lb.select(
        F.concat(F.lit("web_"), F.col("doc_id") % 50).alias("web_id"),
        F.when(F.col("doc_id") % 13 != 0, (F.col("doc_id") % 97).cast("string")).alias("task_id"),
        F.when(F.col("doc_id") % 7 != 0, F.col("quality")).alias("label"),
        F.col("doc_id").alias("ord"))


def code_evidence_webdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code evidence, layout A: web_id, task_id, label, code, code_review struct."""
    lb = table(spark, sf_dir, "labels")
    dc = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lb.join(dc, "doc_id").select(
        F.concat(F.lit("web_"), F.col("doc_id") % 50).alias("web_id"),
        F.col("doc_id").cast("string").alias("task_id"),
        (F.col("toxic") == 0).alias("label"),
        F.lit("<html/>").alias("code"),
        F.struct((F.col("quality") == 1).alias("is_implemented"),
                 F.col("text").alias("evidence")).alias("code_review"))


def code_evidence_realdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code evidence, layout B: test_case_name, GT, Code_Result, Code_Evidence."""
    lb = table(spark, sf_dir, "labels")
    dc = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lb.join(dc, "doc_id").select(
        _case_name().alias("test_case_name"), (F.lit(1) - F.col("toxic")).alias("GT"),
        F.col("quality").alias("Code_Result"), F.col("text").alias("Code_Evidence"))


# Fixed phrases placed in Tell evidence and reflection texts of the fixtures.
PHRASES = ["search results updated", "no visible change", "modal opened",
           "page stuck loading", "navigated to target page"]


def gui_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GUI-evidence records: one per event with a bounded ``results`` array of
    1-3 actions; every fourth record uses the flat layout (fields at top level)."""
    ev = table(spark, sf_dir, "events")
    n = (F.col("event_id") % 3 + 1).cast("int")
    flat = F.col("event_id") % 4 == 0

    def action(i):
        click = (F.col("event_type") == "click") & (i == 1)
        acc_known = F.col("event_id") % 5 != 0
        analysis = F.when(click, F.struct(
            F.when(acc_known, (F.col("value") >= 20).cast("int")).alias("accuracy"),
            F.lit("element_tree").alias("method")))
        content = (F.when(F.col("event_type").isin("error", "purchase") & (i == n),
                          F.concat(F.lit('Tell ({"0": {"result": "'),
                                   F.when(F.col("event_type") == "purchase", F.lit("Pass")).otherwise(F.lit("Fail")),
                                   F.lit('", "evidence": "event '), F.col("event_id"), F.lit(": "),
                                   F.element_at(F.array(*[F.lit(p) for p in PHRASES]),
                                                (F.col("event_id") % 5 + 1).cast("int")),
                                   F.lit('"}})')))
                    .when(F.col("event_type") == "signup", F.lit("Stop()"))
                    .when(F.col("event_id") % 23 == 0, F.lit(None))
                    .otherwise(F.concat(F.lit("Click ("), F.col("event_id") % 97, F.lit(")"))))
        return F.struct(i.alias("iter_num"), F.concat(F.col("event_type"), F.lit(" op "), i).alias("operation_desc"),
                        content.alias("action_content"),
                        F.concat(F.lit("thought "), i).alias("reflection_thought"),
                        analysis.alias("coordinate_analysis"))

    recs = ev.select(F.concat(F.lit("web_"), F.expr("event_id div 2 % 50"), F.lit("_"), F.expr("event_id div 2"))
                      .alias("project_name"), "event_id", "event_type", "value", flat.alias("_flat"),
                     F.transform(F.sequence(F.lit(1), n), action).alias("_acts"))
    first = F.element_at("_acts", 1)
    return recs.select(
        "project_name", F.col("event_id").alias("ord"),
        F.when(~F.col("_flat"), F.col("_acts")).alias("results"),
        F.when(F.col("_flat"), (F.col("event_id") % 5 + 1).cast("int")).alias("iter_num"),
        F.when(F.col("_flat"), first["operation_desc"]).alias("operation_desc"),
        F.when(F.col("_flat"), first["action_content"]).alias("action_content"),
        F.when(F.col("_flat"), first["reflection_thought"]).alias("reflection_thought"),
        F.when(F.col("_flat"), first["coordinate_analysis"]).alias("coordinate_analysis"))


# ---- screens: elements (from part) and clicks (from events) ---------------------------------
# Control type by p_partkey % 6.
CONTROL_TYPES = ["Pane", "Button", "Edit", "Text", "Group", "Image"]


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x1 = (k * 37) % 1600
    y1 = (k * 53) % 900
    return p.select(
        F.expr("p_partkey div 80").alias("screen_id"), k.alias("el_id"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("ui_name"),
        F.element_at(F.array(*[F.lit(t) for t in CONTROL_TYPES]), (k % 6 + 1).cast("int")).alias("control_type"),
        x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
        (x1 + 20 + F.col("p_size") * 8).cast("int").alias("x2"),
        (y1 + 10 + F.col("p_size") * 4).cast("int").alias("y2"),
        (k * 2).alias("pos"))


def elements_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements plus a copy of each box (-el_id, the next position) whose
    name emptiness is flipped, so every box appears twice."""
    e = elements(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("el_id"), "p_name")
    c = e.join(p, "el_id").select(
        "screen_id", (-F.col("el_id")).alias("el_id"),
        F.when(F.col("ui_name") == "", F.col("p_name")).otherwise(F.lit("")).alias("ui_name"),
        "control_type", "x1", "y1", "x2", "y2", (F.col("pos") + 1).alias("pos"))
    return e.unionByName(c)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return ev.select(F.col("event_id").alias("click_id"), F.expr("event_id div 400").alias("screen_id"),
                     ((F.col("event_id") * 97) % 1920).cast("int").alias("cx"),
                     ((F.col("event_id") * 61) % 1080).cast("int").alias("cy"))


# ---- trajectories (from conversations) ------------------------------------------------------
def _coord(expr, half):
    return F.concat(expr.cast("string"), F.when(half, F.lit(".5")).otherwise(F.lit("")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, turn, role, content; assistant content is 'Thought: ...\\nAction: <form>'
    with the form chosen by (task + turn) % 9; tasks with task % 11 = 0 are malformed."""
    cv = table(spark, sf_dir, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    half = t % 2 == 1
    x = _coord((c * 37 + t * 11) % 1920, half)
    y = _coord((c * 13 + t * 7) % 1080, half)
    x2 = ((c * 37 + t * 11 + 100) % 1920).cast("string")
    y2 = ((c * 13 + t * 7 + 50) % 1080).cast("string")
    pt = lambda a, b: F.concat(F.lit("'<point>"), a, F.lit(" "), b, F.lit("</point>'"))
    form = (c + t) % 9
    act = (F.when(form == 0, F.concat(F.lit("click(point="), pt(x, y), F.lit(")")))
            .when(form == 1, F.concat(F.lit("left_double(point="), pt(x, y), F.lit(")")))
            .when(form == 2, F.concat(F.lit("right_single(point="), pt(x, y), F.lit(")")))
            .when(form == 3, F.concat(F.lit("drag(start_point="), pt(x, y), F.lit(", end_point="), pt(x2, y2), F.lit(")")))
            .when(form == 4, F.concat(F.lit("type(content='hello "), c, F.lit(" "), t, F.lit("')")))
            .when(form == 5, F.concat(F.lit("scroll(point="), pt(x, y), F.lit(", direction='down')")))
            .when(form == 6, F.lit("hotkey(key='ctrl c')"))
            .when(form == 7, F.lit("wait()"))
            .otherwise(F.concat(F.lit("finished(content='done "), c, F.lit("')"))))
    bad = c % 11 == 0
    act = F.when(bad & (t % 2 == 0), F.concat(F.lit("open_app name"), t)) \
           .when(bad, F.lit("launch(app)")).otherwise(act)
    body = F.when(bad, F.concat(F.col("text"), F.lit("\nAction: "), act)).otherwise(
        F.concat(F.lit("Thought: "), F.col("text"), F.lit("\nAction: "), act))
    content = F.when(F.col("role") == "assistant", body).otherwise(F.col("text"))
    return cv.select(c.alias("task"), t.alias("turn"), "role", content.alias("content"))


def screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One screenshot per assistant turn, except the last one of tasks with task % 4 = 0."""
    cv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    last = cv.groupBy("conv_id").agg(F.max("turn").alias("_m"))
    s = cv.join(last, "conv_id").filter(~((F.col("conv_id") % 4 == 0) & (F.col("turn") == F.col("_m"))))
    return s.select(F.col("conv_id").alias("task"), F.col("turn").alias("shot_no"),
                    F.expr("(conv_id * 7 + turn) div 28").alias("screen_id"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One executed code line per assistant turn; every fourth is FAILED."""
    cv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    c, t = F.col("conv_id"), F.col("turn")
    code = F.when((c + t) % 4 != 0, F.concat(
        F.lit("\npyautogui.click("), ((c * 5 + t * 3) % 1920).cast("string"), F.lit(".25, "),
        ((c * 3 + t * 5) % 1080).cast("string"), F.lit(", button='left')"))).otherwise(F.lit("FAILED"))
    return cv.select(c.alias("task"), t.alias("code_no"), code.alias("code"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation: messages, screens and code lines in order."""
    def listed(df: DataFrame, order: str, value, name: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("v"))))
        return df.groupBy("task").agg(F.transform(rows, lambda r: r["v"]).alias(name))
    m = listed(turns(spark, sf_dir), "turn", F.struct("role", "content"), "messages")
    s = listed(screenshots(spark, sf_dir), "shot_no", F.col("screen_id"), "screens")
    c = listed(codes(spark, sf_dir), "code_no", F.col("code"), "codes")
    return m.join(s, "task", "left").join(c, "task", "left")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task -> web_id, task_id, final_result, instruction (metadata missing for task % 5 = 0)."""
    cv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    return cv.select(c.alias("task"), F.concat(F.lit("web_"), c % 10).alias("web_id"), c.cast("string").alias("task_id"),
                     F.when(c % 3 != 0, F.lit("DONE")).otherwise(F.lit("FAILED")).alias("final_result"),
                     F.when(c % 5 != 0, F.concat(F.lit("task "), c)).alias("instruction"))


# ---- trace logs (from events and documents): one log text per event, 1-6 iterations ------------------------
def _s(c):
    return c.cast("string")


def trace_logs(spark: SparkSession, sf_dir: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """project_name = log_<event_id>, one to six iterations with the sections the
    parsers read; operations carry the whole text of the document of that id.
    Every log belongs to one of ``turns`` parts by a hash of its id; this is part ``turn``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("doc"))
    ev = table(spark, sf_dir, "events").select("event_id")
    if turns > 1:
        mine = F.pmod(F.xxhash64(F.col("event_id").cast("long")), F.lit(turns)) == turn
        ev, docs = ev.filter(mine), docs.filter(mine)
    ev = dealt(ev, "event_id", turns).join(docs, "event_id", "left")
    e = F.col("event_id")
    n = (e % 6 + 1).cast("int")
    told = F.coalesce(F.concat(F.lit("\n"), F.col("doc")), F.lit(""))

    def block(i):
        """Block ``i`` (a number, so that Spark compiles the texts instead of interpreting a lambda)."""
        x = (e * 97 + i * 13) % 1500 + 100
        y = (e * 61 + i * 7) % 800 + 100
        ak = (e * 3 + i) % 3
        action = (F.when(ak == 0, F.concat(F.lit("pyautogui.click("), _s(x), F.lit(", "), _s(y), F.lit(")")))
                   .when(ak == 1, F.lit("pyautogui.typewrite('abc')"))
                   .otherwise(F.lit('Tell ({"0": {"result": "Pass", "evidence": "ok"}})')))
        op = F.when((e + i) % 5 != 0, F.concat(F.lit(f"### Operation ###\nClick item {i} of "), _s(e),
                                               told, F.lit("\n"))).otherwise(F.lit(""))
        out_action = F.concat(F.lit("######################## output_action:\n### Action ###\n"), action, F.lit("\n"),
                              op, F.lit("### Task List ###\n- do stuff\n######################## output_action end\n"))
        rk = (e + i) % 4
        ans = (F.when(rk == 0, F.lit("CORRECT")).when(rk == 1, F.lit("ERROR: wrong click"))
                .when(rk == 2, F.lit("INCORRECT result")).otherwise(F.lit("UNSURE")))
        refl = F.when((e + i) % 7 != 0, F.concat(
            F.lit("######################## reflection_output:\n### Answer ###\n"), ans,
            F.lit("\n\nmore text\n######################## reflection_output end\n"))).otherwise(F.lit(""))
        tk = (e + 2 * i) % 3
        thought = (F.when(tk == 0, F.concat(
            F.lit("### Reflection Thought ###\nAnalyze whether the screen content and state match the expected outcome of step "),
            F.lit(f"{i}.\n### Thought ###\nthinking\n### Reflection Thought ###\nPage "), _s(e),
            F.lit(f" changed after step {i}.\n### Thought ###\nmore\n")))
            .when(tk == 1, F.lit(f"### Reflection Thought ###\n\nButton {i} now enabled.\nsecond line\n### Action ###\nnext\n"))
            .otherwise(F.lit("")))
        hit = (e + i) % 2 == 0
        bx1 = F.when(hit, x - 10).otherwise(x + 200)
        by1 = F.when(hit, y - 10).otherwise(y + 150)
        bx2 = F.when(hit, x + 30).otherwise(x + 240)
        by2 = F.when(hit, y + 20).otherwise(y + 180)
        rect = lambda a, b, c, d: F.concat(F.lit("rect: ("), _s(a), F.lit(", "), _s(b), F.lit(", "), _s(c),
                                           F.lit(", "), _s(d), F.lit(")"))
        extra = F.concat(*[F.when((e + i) % 4 > j, F.lit(
            f"(1, 1); text:extra{j}; control_type:Button; rect: ({j * 10 + 12}, 1050, {j * 10 + 17}, 1060)\n")).otherwise(F.lit(""))
            for j in range(3)])
        lines = F.concat(
            F.lit("("), _s(x), F.lit(", "), _s(y), F.lit(f"); text:btn{i}; control_type:Button; "),
            rect(bx1, by1, bx2, by2), F.lit("\n"),
            F.lit("("), _s(x), F.lit(", "), _s(y), F.lit("); text:; control_type:Text; "), rect(bx1, by1, bx2, by2),
            F.lit("\n\n(960, 540); text:; control_type:Pane; rect: (0, 0, 1920, 1080)\n"),
            F.lit("("), _s(x + 90), F.lit(", "), _s(y + 50), F.lit(f"); text:label{i}; control_type:Text; "), rect(x + 60, y + 40, x + 120, y + 60), F.lit("\n"),
            F.lit("("), _s(x + 90), F.lit(", "), _s(y + 50), F.lit("); text:; control_type:Group; "),
            rect(x + 55, y + 35, x + 130, y + 70),
            F.lit("\njunk line without format\n(1, 1); text:logo; control_type:Image; rect: (0, 0, 10, 10)\n"), extra)
        screen = F.when((e * i) % 9 != 4, F.concat(
            F.lit("### Screenshot information ###\nThe information is as follow:\n"), lines,
            F.lit("Please note that this information is not necessarily accurate\n### Hints ###\n"))).otherwise(F.lit(""))

        def hstep(k):
            hact = (F.concat(F.lit("pyautogui.click("), _s((e + k * 11) % 1000), F.lit(", "), _s((e + k * 17) % 700), F.lit(")"))
                    if k % 2 else F.lit("pyautogui.press('enter')"))
            return F.concat(F.lit(f"Step-{k}: Operation: hist op {k} of "), _s(e), F.lit("\nAction: "), hact,
                            F.lit(f"\nReflection_thought: hist refl {k}\n\tMemory: mem {k}\n"))
        history = F.when((n == i) & (e % 8 != 0), F.concat(
            F.lit("### History operations ###\n"), *[hstep(k) for k in range(1, i + 1)],
            F.lit("### Last Task List ###\n- done\n"))).otherwise(F.lit(""))
        return F.concat(F.lit(f"#### iter:{i}\n"), out_action, refl, thought, screen, history)

    text = F.when(e.isNotNull(), F.concat(F.lit("log header\n"), *[F.when(n >= i, block(i)).otherwise(F.lit("")) for i in range(1, 7)]))
    return ev.select(F.concat(F.lit("log_"), _s(e)).alias("project_name"), text.alias("text"))


def trace_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_name, iter_num, has_image): screenshots missing for event_id % 6 = 0."""
    ev = table(spark, sf_dir, "events").select("event_id")
    e = F.col("event_id")
    return ev.select(F.concat(F.lit("log_"), _s(e)).alias("project_name"),
                     F.explode(F.sequence(F.lit(1), (e % 6 + 1).cast("int"))).alias("iter_num"),
                     (e % 6 != 0).alias("has_image"))


# ---- code-review responses (from documents) --------------------------------------------------
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review response per document with 1-3 tagged test cases; doc_id % 7 = 0
    lacks the closing tag, doc_id % 11 = 0 carries invalid JSON (trailing comma)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    # the text as a JSON string: to_json of a one-field record without its braces
    told = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":|\}$', "")
    n = (i % 3 + 1).cast("int")

    def case(j):
        files = F.concat(F.lit('["src/f'), _s((i + j) % 5), F.lit('.js", "src/main.js"]'))
        return F.concat(F.lit('{"test_case": "case '), _s(i), F.lit("-"), _s(j),
                        F.lit('", "related_requirement": "req", "requirement_id": "R'), _s(j),
                        F.lit('", "code_review": {"is_implemented": '),
                        F.when((i + j) % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
                        F.lit(', "evidence": '), told, F.lit('}, "files": '), files, F.lit("}"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), case), ", ")
    body = F.when(i % 11 == 0, F.concat(body, F.lit(","))).otherwise(body)
    close = F.when(i % 7 == 0, F.lit("")).otherwise(F.lit("</RESPONSE>"))
    text = F.concat(F.lit("analysis of "), _s(i), F.lit("\n<RESPONSE>[\n"), body, F.lit("\n]"), close, F.lit("\ndone"))
    return d.select(F.concat(F.lit("proj_"), _s(i)).alias("project_name"), text.alias("text"))
