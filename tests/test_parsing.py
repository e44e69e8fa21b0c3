"""Regex parsers on literal edge cases: newlines, quotes, missing tags."""

from pyspark.sql import functions as F

from judgefuse.functions import text as TX
from judgefuse.operators import tracelog as TL


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def test_thought_action(spark):
    s = "Thought: look at\nthe page\nAction: click(point='<point>10.7 20</point>')\n"
    assert one(spark, TX.thought_of, s) == "look at\nthe page"
    assert one(spark, TX.action_of, s) == "click(point='<point>10.7 20</point>')"
    assert one(spark, TX.thought_of, "no markers") == ""


def test_action_grammar_forms(spark):
    cases = {
        "click(point='<point>10.7 20</point>')": ("click", "(10, 20)", 10, 20),
        'left_double(point="<point>5 6</point>")': ("left_double", "(5, 6)", 5, 6),
        "drag(start_point='<point>1 2</point>', end_point='<point>3 4</point>')": ("drag", "(1, 2) -> (3, 4)", 1, 2),
        "type(content='it''s\nmulti')": ("type", "it''s\nmulti", None, None),
        "scroll(point='<point>7 8</point>', direction='up')": ("scroll", "(7, 8); up", 7, 8),
        "hotkey(key='ctrl v')": ("hotkey", "ctrl v", None, None),
        "WAIT()": ("wait", None, None, None),
        "finished(content='all done')": ("finished", "all done", None, None),
        "open_app name": ("open_app", "open_app name", None, None),
        "launch(app)": ("launch", "launch(app)", None, None),
        "": ("Unknown", "", None, None),
    }
    for s, exp in cases.items():
        r = one(spark, TX.parse_action, s)
        assert (r.action_type, r.action_target, r.x, r.y) == exp, s


def test_tell_evidence_and_fenced(spark):
    assert one(spark, TX.tell_evidence, 'Tell ({"0": {"result": "Pass", "evidence": "ok"}})') == '"ok"}})'
    assert one(spark, TX.tell_evidence, "Tell (broken") is None
    assert one(spark, TX.tell_evidence, "Click (1)") is None
    assert one(spark, TX.fenced_result, '```json\n{"result": "Yes"}\n```') == "Yes"
    assert one(spark, TX.fenced_result, '```json\n{"result": ') == "No"


def test_reflection_rules(spark):
    assert one(spark, TX.reflection_rules, "Search results updated") == "Yes"
    assert one(spark, TX.reflection_rules, "No visible change, results updated?") == "No"
    assert one(spark, TX.reflection_rules, "   ") == "No"
    assert one(spark, TX.reflection_rules, None) == "No"
    assert one(spark, TX.reflection_rules, "returned 404 page") == "No"


def test_reflection_verdict_parity_and_strict(spark):
    s = ("######################## reflection_output:\n### Answer ###\nINCORRECT\n\n"
         "######################## reflection_output end")
    logs = spark.createDataFrame([("p", "#### iter:1\n" + s)], "project_name string, text string")
    assert TL.parse_iterations(logs).first().reflection == 1
    r = spark.range(1).select(TL.reflection_of(F.lit("INCORRECT"), strict=True).alias("b")).first()
    assert r.b is None


def test_answer_validity(spark):
    df = spark.createDataFrame([(" 1 ",), ("0\n",), ("10",), ("yes",)], "a string")
    v, x = TL.answer_validity("a")
    assert [(r.v, r.x) for r in df.select(v.alias("v"), x.alias("x")).collect()] == [
        (True, 1), (True, 0), (False, 1), (False, 0)]


def test_natural_sort_bears_any_number(spark):
    from judgefuse.operators.trajectory import natural_sort_keys
    names = ["web_10_2", "web_9_3", "web_99999999999999999999_1", "other", "web_9_x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    x, y = natural_sort_keys(F.col("n"))
    got = [r.n for r in df.orderBy(x, y, "n").collect()]
    assert got == ["other", "web_9_x", "web_9_3", "web_10_2", "web_99999999999999999999_1"]
