"""Per-row text parsing as built-in column expressions.

Everything here is a ``Column``: regular expressions run inside the JVM,
no Python UDF.  Java regex syntax; patterns avoid look-around so the DuckDB
oracle (RE2) can state the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(c, pattern: str, group: int = 1) -> Column:
    """regexp_extract that yields NULL (not '') when the pattern is absent."""
    c = _c(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# ---- B12 / C8: Tell evidence ---------------------------------------------------------
def is_tell(c) -> Column:
    """A string containing ``Tell (``."""
    return F.coalesce(_c(c).contains("Tell ("), F.lit(False))


def tell_evidence(c) -> Column:
    """Second piece of the split on ``"evidence": `` kept raw (trailing
    braces included); NULL when the row is not a Tell row or has no piece."""
    c = _c(c)
    piece = F.try_element_at(F.split(c, '"evidence": ', -1), F.lit(2))
    return F.when(is_tell(c), piece)


# ---- B14: fenced JSON result -------------------------------------------------------------
def fenced_result(c) -> Column:
    """Strip a leading ```json / ``` fence and a trailing ``` fence,
    then read ``result``; anything unparsable gives "No"."""
    s = strip_ws(_c(c))
    s = F.regexp_replace(s, r"^```(json)?", "")
    s = F.regexp_replace(s, r"```$", "")
    s = strip_ws(s)
    return F.coalesce(F.get_json_object(s, "$.result"), F.lit("No"))


# ---- B18: reflection adjudication (deterministic rule table) --------------------------
# Phrase patterns taken from the published adjudication rules
# (failure rules are checked first; anything unmatched or empty is "No").
REFLECTION_FAIL_PATTERNS = [
    "no change", "no visible change", "unresponsive", "stuck", "spinner", "timeout",
    "timed out", "loading", "no results", "wrong page", "differs", "still disabled",
    "did not", "didn.?t", "not apply", "still old", "same page", "error", "exception",
    "stack trace", "not implemented", r"\b[45][0-9][0-9]\b", "browser menu",
    "not sure", "might have", "seems", "unclear", "ambiguous", "fail",
]
REFLECTION_SUCCESS_PATTERNS = [
    "updated", "refreshed", "opened", "closed", "enabled", "disabled", "status 200",
    "navigated to", "is visible", "appeared", "displayed", "succeeded", "success",
]
REFLECTION_TEMPLATE_NOTE = "When using the Tell or Wait action, there is no need to do reflection."


def _alt(words: list[str]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def reflection_rules(c) -> Column:
    """B18 default scorer: "Yes" only for an explicit success statement that
    carries no failure cue; empty or whitespace-only text is "No"."""
    s = strip_ws(F.replace(F.coalesce(_c(c), F.lit("")), F.lit(REFLECTION_TEMPLATE_NOTE), F.lit("")))
    return (F.when(s == "", F.lit("No"))
             .when(s.rlike(_alt(REFLECTION_FAIL_PATTERNS)), F.lit("No"))
             .when(s.rlike(_alt(REFLECTION_SUCCESS_PATTERNS)), F.lit("Yes"))
             .otherwise(F.lit("No")))


def reflection_rules_sql(expr: str) -> str:
    """The same rule table for the DuckDB oracle."""
    s = f"regexp_replace(replace(coalesce({expr}, ''), '{REFLECTION_TEMPLATE_NOTE}', ''), '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN {s} = '' THEN 'No' "
            f"WHEN regexp_matches({s}, '{_alt(REFLECTION_FAIL_PATTERNS)}') THEN 'No' "
            f"WHEN regexp_matches({s}, '{_alt(REFLECTION_SUCCESS_PATTERNS)}') THEN 'Yes' ELSE 'No' END")


WHITESPACE = " \t\n\r\x0b\x0c"


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace (incl. newlines), like str.strip()."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def first_group(c, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when nothing matches (one regex pass)."""
    return F.try_element_at(F.regexp_extract_all(_c(c), F.lit(pattern), group), F.lit(1))


def _lit_re(s: str) -> str:
    return "\\Q" + s + "\\E"


# Each helper below uses its input exactly once (a limit-2 split on a quoted
# literal, i.e. one substring search), so nesting them inside higher-order
# functions never re-evaluates the inner text.
def after(c, marker: str) -> Column:
    """Text after the first ``marker``; NULL when it is absent."""
    return F.try_element_at(F.split(_c(c), _lit_re(marker), 2), F.lit(2))


def before(c, marker: str) -> Column:
    """Text before the first ``marker``; NULL when it is absent."""
    return F.try_element_at(F.reverse(F.split(_c(c), _lit_re(marker), 2)), F.lit(2))


def between(c, start: str, end: str) -> Column:
    """Text between the first ``start`` and the first ``end`` after it, NULL
    when either is missing.  Same value as group 1 of the first match of
    ``(?s)start(.*?)end`` for literal markers, found by substring search
    instead of a regex scan of the whole text."""
    return before(after(c, start), end)


def up_to(c, end: str) -> Column:
    """Text before the first ``end``, or all of it when ``end`` is absent."""
    return F.element_at(F.split(_c(c), _lit_re(end), 2), F.lit(1))


# ---- B1 / B4: Thought / Action ------------------------------------------------------------
THOUGHT_RE = r"(?s)Thought:\s*(.*?)(?:\nAction:|$)"
THOUGHT_LOOSE_RE = r"(?s)Thought:\s*(.*?)(?:Action:|$)"
ACTION_RE = r"(?s)Action:\s*(.*)$"


def thought_of(c, loose: bool = False) -> Column:
    """B1 (or the B4 variant with ``loose``): text after ``Thought:`` up to
    ``\\nAction:`` (``Action:`` when loose) or the end, stripped; '' if absent."""
    c = _c(c)
    pat = THOUGHT_LOOSE_RE if loose else THOUGHT_RE
    return F.when(c.rlike(pat), strip_ws(F.regexp_extract(c, pat, 1))).otherwise(F.lit(""))


def action_of(c) -> Column:
    """B1: text after ``Action:`` to the end, stripped; '' if absent."""
    c = _c(c)
    return F.when(c.rlike(ACTION_RE), strip_ws(F.regexp_extract(c, ACTION_RE, 1))).otherwise(F.lit(""))


# ---- B2: action grammar ----------------------------------------------------------------------
# The nine anchored action forms (number = int or decimal).
_NUM = r"(\d+(?:\.\d+)?)"
_PT = r"""['"]<point>""" + _NUM + r"\s+" + _NUM + r"""</point>['"]"""
ACTION_FORMS = {
    "click": r"^click\s*\(\s*point\s*=\s*" + _PT,
    "left_double": r"^left_double\s*\(\s*point\s*=\s*" + _PT,
    "right_single": r"^right_single\s*\(\s*point\s*=\s*" + _PT,
    "drag": r"^drag\s*\(\s*start_point\s*=\s*" + _PT + r"\s*,\s*end_point\s*=\s*" + _PT,
    "type": r"""(?s)^type\s*\(\s*content\s*=\s*['"](.+?)['"]\s*\)""",
    "scroll": r"^scroll\s*\(\s*point\s*=\s*" + _PT + r"""\s*,\s*direction\s*=\s*['"](\w+)['"]""",
    "hotkey": r"""^hotkey\s*\(\s*key\s*=\s*['"](.+?)['"]\s*\)""",
    "finished": r"""(?s)^finished\s*\(\s*content\s*=\s*['"](.+?)['"]\s*\)""",
}
CODE_CLICK_RE = r"pyautogui\.click\s*\(\s*" + _NUM + r"\s*,\s*" + _NUM


def _int_of(s: Column) -> Column:
    """float then truncate, as int(float(text)); NULL beyond an int."""
    return s.try_cast("double").try_cast("int")


def parse_action(c) -> Column:
    """B2: struct(action_type, action_target, x, y) for an action string.

    Point actions give '(x, y)' targets and integer coordinates (drag: its
    start point); type/hotkey/finished give their argument; wait gives no
    target; anything else is typed by the text before '(' or its first word
    ('Unknown' if empty) and keeps the whole text as target.
    """
    a = strip_ws(F.coalesce(_c(c), F.lit("")))
    g = lambda form, i: F.regexp_extract(a, ACTION_FORMS[form], i)
    xy = lambda form, i, j: F.concat(F.lit("("), _int_of(g(form, i)).cast("string"), F.lit(", "),
                                     _int_of(g(form, j)).cast("string"), F.lit(")"))
    point_forms = ["click", "left_double", "right_single"]
    typ, tgt, x, y = None, None, None, None
    branches = []
    for f in point_forms:
        branches.append((a.rlike(ACTION_FORMS[f]), F.lit(f), xy(f, 1, 2), _int_of(g(f, 1)), _int_of(g(f, 2))))
    branches.append((a.rlike(ACTION_FORMS["drag"]), F.lit("drag"),
                     F.concat(xy("drag", 1, 2), F.lit(" -> "), xy("drag", 3, 4)),
                     _int_of(g("drag", 1)), _int_of(g("drag", 2))))
    branches.append((a.rlike(ACTION_FORMS["type"]), F.lit("type"), g("type", 1), None, None))
    branches.append((a.rlike(ACTION_FORMS["scroll"]), F.lit("scroll"),
                     F.concat(xy("scroll", 1, 2), F.lit("; "), g("scroll", 3)),
                     _int_of(g("scroll", 1)), _int_of(g("scroll", 2))))
    branches.append((a.rlike(ACTION_FORMS["hotkey"]), F.lit("hotkey"), g("hotkey", 1), None, None))
    branches.append((F.lower(a).startswith("wait"), F.lit("wait"), None, None, None))
    branches.append((a.rlike(ACTION_FORMS["finished"]), F.lit("finished"), g("finished", 1), None, None))
    first_word = F.element_at(F.split(a, r"\s+"), 1)
    fb_type = (F.when(a.contains("("), F.substring_index(a, "(", 1))
                .when(a != "", first_word).otherwise(F.lit("Unknown")))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def chain(idx):
        typ = tgt = xx = yy = None
        for cond, t, tg, xv, yv in branches:
            typ = (F.when(cond, t) if typ is None else typ.when(cond, t))
            tgt = (F.when(cond, tg if tg is not None else none_s) if tgt is None
                   else tgt.when(cond, tg if tg is not None else none_s))
            xx = (F.when(cond, xv if xv is not None else none_i) if xx is None
                  else xx.when(cond, xv if xv is not None else none_i))
            yy = (F.when(cond, yv if yv is not None else none_i) if yy is None
                  else yy.when(cond, yv if yv is not None else none_i))
        return (typ.otherwise(fb_type), tgt.otherwise(a), xx.otherwise(none_i), yy.otherwise(none_i))

    t, tg, xx, yy = chain(0)
    return F.struct(t.alias("action_type"), tg.alias("action_target"), xx.alias("x"), yy.alias("y"))


def code_click(c) -> Column:
    """struct(x, y) of the first ``pyautogui.click(x, y`` in a code string, else NULL."""
    c = _c(c)
    return F.when(c.rlike(CODE_CLICK_RE), F.struct(
        _int_of(F.regexp_extract(c, CODE_CLICK_RE, 1)).alias("x"),
        _int_of(F.regexp_extract(c, CODE_CLICK_RE, 2)).alias("y")))


def sql_lit(pattern: str) -> str:
    """A regex as a DuckDB string literal."""
    return "'" + pattern.replace("'", "''") + "'"
