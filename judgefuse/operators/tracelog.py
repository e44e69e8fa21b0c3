"""Agent trace logs -> per-iteration evidence.

A log is one whole text per task (``read.text(wholetext=True)``).  It is cut
into iteration blocks at ``#### iter:N`` markers and every block is parsed where
it lies.  A block's elements stay one array: they are filtered, de-duplicated,
stripped of containers, tested against the block's click and sorted by distance
without a shuffle, and blocks that repeat an iteration number never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgefuse.functions import text as TX
from judgefuse.operators.spatial import CONTAINER_TYPES, DROPPED_TYPES, FUNCTIONAL_TYPES, by_distance

# Section markers and prompt-template markers of the log format.
ITER_MARK = "#### iter:"
ITER_SPLIT = r"#### iter:(?=\d)"
ITER_RE = r"^(\d+)"
DIGITS = frozenset("0123456789")
HISTORY_MARK, HISTORY_END = "### History operations ###", "### Last Task List ###"
STEP_RE = r"(?s)Step-(\d+):(.*?)(?=Step-\d+:|$)"
STEP_OPERATION_RE = r"(?s)Operation:\s*(.*?)(?=Action:|$)"
STEP_ACTION_RE = r"(?s)Action:\s*(.*?)(?=Reflection_thought:|$)"
STEP_REFLECTION_RE = r"(?s)Reflection_thought:\s*(.*?)(?=\n\tMemory:|\nMemory:|$)"
CLICK_RE = r"pyautogui\.click\((\d+),\s*(\d+)\)"
REFLECTION_THOUGHT_RE = r"(?sm)### Reflection Thought ###\s*\n(.*?)(?=\n### Thought ###|\n### Action ###|$)"
ELEMENT_LINE_RE = (r"^\((\d+),\s*(\d+)\);\s*text:(.*?);\s*control_type:(.*?);\s*rect:\s*"
                   r"\((\d+),\s*(\d+),\s*(\d+),\s*(\d+)\)")
# The same on every line of a text, after the line's whitespace: (?d) knows \n alone as a line's end.
ELEMENT_LINES_RE = "(?dm)" + ELEMENT_LINE_RE.replace("^", r"^[ \t\r\x0B\f]*+").replace(r"\s*", r"[ \t\r\x0B\f]*").replace(
    ".*?", r"[^\n\r\u0085\u2028\u2029]*?") + r"[^\n]*$"
# The literal start and end markers of the delimited sections
# above.  A section is the text between the first start marker and the next
# end marker, i.e. the first match of the matching *_RE pattern.
SECTION_MARKERS = {
    "output_action": ("######################## output_action:", "######################## output_action end"),
    "reflection_output": ("######################## reflection_output:", "######################## reflection_output end"),
    "screenshot": ("### Screenshot information ###", "### Hints ###"),
    "info": ("The information is as follow:", "Please note that this information is not necessarily accurate"),
    "operation": ("### Operation ###", "### Task List ###"),
    "action": ("### Action ###", "### Operation ###"),
}
ANSWER_MARKER, ANSWER_END = "### Answer ###", "\n\n"
TEMPLATE_MARKERS = [
    "Analyze whether the screen content and state match the expected outcome",
    "Write a comprehensive analysis of the last operation's outcome",
    "What was expected vs. what actually happened",
    "Success evaluation:",
    "Failure analysis",
]


def _first(c: Column, pat: str, i: int = 1) -> Column:
    """group i of the first match, '' if no match."""
    return F.regexp_extract(c, pat, i)


def _int(c: Column) -> Column:
    """try_cast to int, NULL for '' at once (a failed cast raises and catches an error with its whole stack)."""
    return _non_empty(c).try_cast("int")


def _until(end: str) -> str:
    """Regex of the text before the first ``end`` (or all of it), as ``(?s).*?`` before it: ``end`` is tried
    only where its first character stands, what lies between is taken in runs (of chars but no
    surrogates, which Java's regex finds faster than code points)."""
    at = ord(end[0])
    run = rf"[\x00-\x{at - 1:02X}\x{at + 1:02X}-\uD7FF\uE000-\uFFFF]*"
    return rf"{run}(?:(?!\Q{end}\E).{run})*+"


def _section(c: Column, name: str) -> Column:
    """A delimited section (``SECTION_MARKERS``), '' without any: one search for the start
    marker, then for the end marker; without an end marker nothing is searched again."""
    start, end = SECTION_MARKERS[name]
    return F.regexp_extract(c, rf"(?s)\Q{start}\E(?:({_until(end)})\Q{end}\E|.*)", 1)


def _answer(refl: Column) -> Column:
    """After the marker and its whitespace, up to the first blank line or the end."""
    return F.regexp_extract(refl, rf"(?s)\Q{ANSWER_MARKER}\E[ \t\n\r\x0B\f]*+({_until(ANSWER_END)})", 1)


def _first_line(c: Column) -> Column:
    """ITER_RE is anchored and stays on one line, so it is matched on the
    first line only instead of scanning the whole block (a block's text starts
    behind its marker)."""
    return F.substring_index(c, "\n", 1)


def _last_history(c: Column) -> Column:
    """The last history section; NULL without any.  A section runs from the first mark behind the
    section before it to the next end mark: what follows the text's first mark is cut at the end marks; its first
    piece is a section, and so is what a later piece has behind a mark."""
    pieces = F.split(TX.after(c, HISTORY_MARK), "\\Q" + HISTORY_END + "\\E")
    later = lambda p: F.filter(p, lambda s, i: (i > 0) & s.contains(HISTORY_MARK))
    return _let(pieces, lambda p: F.coalesce(TX.after(F.try_element_at(later(p), F.lit(-1)), HISTORY_MARK), F.get(p, F.lit(0))))


def _info_block(c: Column) -> Column:
    return _non_empty(TX.strip_ws(_section(_section(c, "screenshot"), "info")))


# ---- A9 ---------------------------------------------------------------------------------------
def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: (project_name = the file's path, text), so that
    logs of one name in two folders stay apart."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("project_name"), F.col("value").alias("text"))


def read_log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A9 for logs of any size: one row per iteration block, so that Spark splits
    a large file: (project_name = the file's path, seg = (start of the file's
    split, row in it), content).  ``parse_blocks`` reads them.

    A marker without a number is text: the row behind it belongs to the block before
    it, wherever that began.  Blocks are put together while a split streams through its
    task; only what may go on beyond a split (its last block, and the loose rows before its
    first block) is moved, so that nothing but the logs themselves lies on disk.
    """
    read = spark.read.option("lineSep", ITER_MARK).text(path).select(
        F.col("_metadata.file_path").alias("project_name"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("content"))
    read = read.mapInArrow(_stitched, "project_name string, start long, row long, content string, inner boolean, loose boolean")
    edges = read.filter(~F.col("inner")).withColumn("seg", F.struct("start", "row"))
    before = Window.partitionBy("project_name").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("owner", F.max(F.when(~F.col("loose"), F.col("seg"))).over(before))
    whole = edges.groupBy("project_name", "owner").agg(F.sort_array(F.collect_list(F.struct("seg", "content"))).alias("p"))
    whole = whole.select("project_name", F.col("owner").alias("seg"),
                         F.array_join(F.transform("p", lambda r: r["content"]), ITER_MARK).alias("content"))
    inner = read.filter("inner").select("project_name", F.struct("start", "row").alias("seg"), "content")
    return inner.unionByName(whole)


def _stitched(batches):
    """Rows of splits in their order -> blocks: (project_name, start, row in the split, content,
    inner = complete whatever the next split holds, loose = begins with a marker without a number)."""
    import pyarrow as pa

    names = ("project_name", "start", "row", "content", "inner", "loose")
    split, row, block, out, size = None, 0, None, [], 0

    def flush(inner):
        nonlocal size
        text = ITER_MARK.join(block[3])
        out.append((*block[:3], text, inner and not block[4], block[4]))
        size += len(text)

    def batch_of(rows):
        cols = list(zip(*rows))
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

    for batch in batches:
        for name, start, text in zip(*(c.to_pylist() for c in batch.columns)):
            # the first row of a file is what stands before its first marker
            loose = text[:1] not in DIGITS
            if (name, start) != split:
                if block:
                    flush(False)
                split, row, block = (name, start), 0, None
                loose = loose and start > 0
            if block and loose:
                block[3].append(text)
            else:
                if block:
                    flush(True)
                block = (name, start, row, [text], loose)
            row += 1
        if size > 4 << 20:
            yield batch_of(out)
            out, size = [], 0
    if block:
        flush(False)
    if out:
        yield batch_of(out)


# ---- B6 ---------------------------------------------------------------------------------------
def log_iterations(logs: DataFrame) -> DataFrame:
    """(project_name, seg, iter_num, history) of the parsed blocks.  ``history``
    is the content of the last History-operations block of the whole log and is
    attached to the last iteration only."""
    return parse_iterations(logs).select("project_name", "seg", "iter_num", "history")


def parse_iterations(logs: DataFrame) -> DataFrame:
    """B6 + B9-B11 + the element block: one row per iteration:
    project_name, seg, iter_num, reflection, operation, action_content,
    reflection_thought, click_x, click_y, operation_desc, info, history.
    Empty sections are NULL; numbers beyond an int are no coordinates.

    A block becomes a row before it is parsed: Spark compiles the expressions of a
    row (it interprets those of a lambda) and leaves out the fields nobody reads.
    """
    return _log_blocks(logs).drop("_steps")


def _log_blocks(logs: DataFrame, clicks_only: bool = False) -> DataFrame:
    """``parse_iterations`` plus ``_steps``, the steps of the log's history with the block's number."""
    x = logs.select("project_name", TX.strip_ws(_last_history(F.col("text"))).alias("_hist"), F.split(F.col("text"), ITER_SPLIT).alias("_cut"))
    x = x.select("project_name", "_hist", step_list(F.col("_hist")).alias("_steps"), F.size("_cut").alias("_n"), "_cut")
    # posexplode_outer: a plain one lets the optimizer infer a not-empty filter that splits the text again
    x = x.select("project_name", "_hist", "_steps", "_n", F.posexplode_outer("_cut").alias("_at", "content"))
    # what stands before the first marker is no block; a block takes the steps of its own number along
    number = _int(_first(_first_line(F.col("content")), ITER_RE))
    x = x.filter(F.col("_at") > 0).select(
        "project_name", (F.col("_at") - 1).alias("seg"), "content",
        F.when(F.col("_at") == F.col("_n") - 1, F.coalesce("_hist", F.lit(""))).alias("history"),
        _let(number, lambda n: F.filter("_steps", lambda s: s["step_num"] == n)).alias("_steps"))
    return _parsed(x, "history", "_steps", clicks_only=clicks_only)


def parse_blocks(blocks: DataFrame, clicks_only: bool = False) -> DataFrame:
    """``parse_iterations`` for single blocks.  A history section lies in one
    block; the last one of a log goes to the log's last block.  What stands
    before a log's first marker is its first row (row 0 of the split at 0) and no block."""
    x = blocks.filter(~((F.col("seg.start") == 0) & (F.col("seg.row") == 0)))
    x = _parsed(x.select("project_name", "seg", "content", _last_history(F.col("content")).alias("_h")), "_h", clicks_only=clicks_only)
    last = x.groupBy("project_name").agg(
        F.max("seg").alias("seg"), F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("seg"))).alias("_h"))
    last = last.select("project_name", "seg", F.coalesce(TX.strip_ws(F.col("_h")), F.lit("")).alias("history"))
    return x.drop("_h").join(last, ["project_name", "seg"], "left")


def _parsed(blocks: DataFrame, *keep: str, clicks_only: bool = False) -> DataFrame:
    """The fields of (project_name, seg, content) rows, the text left out; with ``clicks_only`` the
    element block (``info``) of a block without a click is NULL and not looked for."""
    c = F.col("content")
    info = c if clicks_only else _info_block(c)
    x = blocks.select("project_name", "seg", _int(_first(_first_line(c), ITER_RE)).alias("iter_num"),
                      _section(c, "output_action").alias("_out"), TX.strip_ws(_answer(_section(c, "reflection_output"))).alias("_ans"),
                      reflection_text(c).alias("reflection_thought"), info.alias("info"), *keep)
    out = F.col("_out")
    x = x.filter(F.col("iter_num").isNotNull()).select(
        "project_name", "seg", "iter_num", reflection_of(F.col("_ans")).alias("reflection"),
        _non_empty(TX.strip_ws(_section(out, "operation"))).alias("operation"),
        _non_empty(TX.strip_ws(_section(out, "action"))).alias("action_content"), "reflection_thought",
        _int(_first(out, CLICK_RE, 1)).alias("_cx"), _int(_first(out, CLICK_RE, 2)).alias("_cy"), "info", *keep)
    both = F.col("_cx").isNotNull() & F.col("_cy").isNotNull() & F.col("operation").isNotNull()
    info = F.when(both, _info_block(F.col("info"))) if clicks_only else F.col("info")
    return x.select("project_name", "seg", "iter_num", "reflection", "operation", "action_content", "reflection_thought",
                    F.when(both, F.col("_cx")).alias("click_x"), F.when(both, F.col("_cy")).alias("click_y"),
                    F.when(both, F.col("operation")).alias("operation_desc"), info.alias("info"), *keep)


# ---- B7 ---------------------------------------------------------------------------------------
def step_list(history: Column) -> Column:
    """The Step-n segments of a history in order: (k, step_num, h_operation, h_action,
    h_reflection, h_x, h_y).  Each stage is a ``transform`` of its own, so that a text used
    several times is cut once."""
    def cut(s: Column, k: Column) -> Column:
        act = TX.strip_ws(_first(s, STEP_ACTION_RE))
        return F.struct(k.alias("k"), _int(_first(s, r"^Step-(\d+):")).alias("n"), act.alias("act"),
                        TX.strip_ws(_first(s, STEP_OPERATION_RE)).alias("op"), TX.strip_ws(_first(s, STEP_REFLECTION_RE)).alias("refl"))

    def fields(r: Column) -> Column:
        refl = r["refl"]
        refl = F.when(refl.contains("Memory:"), TX.strip_ws(F.substring_index(refl, "Memory:", 1))).otherwise(refl)
        return F.struct(
            r["k"].alias("k"), r["n"].alias("step_num"), _non_empty(r["op"]).alias("h_operation"), _non_empty(r["act"]).alias("h_action"),
            _non_empty(F.regexp_replace(refl, r"[\n\t ]+$", "")).alias("h_reflection"),
            _int(_first(r["act"], CLICK_RE, 1)).alias("h_x"), _int(_first(r["act"], CLICK_RE, 2)).alias("h_y"))

    return F.transform(F.transform(F.regexp_extract_all(history, F.lit(STEP_RE), 0), cut), fields)


def history_steps(iters: DataFrame) -> DataFrame:
    """Step-n segments of the history block -> operation, action,
    reflection (cut at Memory:, trailing whitespace removed, empty -> NULL)
    and click (ints)."""
    h = iters.filter(F.col("history").isNotNull() & (F.col("history") != "")).select("project_name", "history")
    return h.select("project_name", F.inline_outer(step_list(F.col("history")))).filter(F.col("k").isNotNull())


# ---- B8 / C12 / I1 / D8 / D7 / F1: the elements of one block -------------------------------------
# Lists of up to FEW elements are compared by their pairs, longer ones are sorted (in a lambda, where Spark
# interprets every expression, building and sorting keys costs more than the few comparisons).
FEW = 12
ELEMENT_FIELDS = ("cx", "cy", "ui_name", "control_type", "x1", "y1", "x2", "y2")


def parsed_elements(info: Column) -> Column:
    """Array of the information block's elements.  Lines are numbered after
    the block is stripped; blank and non-matching lines, and lines whose
    coordinates are no ints, are skipped but keep their number (id =
    element_<idx>).  One pass over the block rewrites every matching line into its eight fields."""
    rewrite = "\u0001".join(f"${i}" for i in range(1, 9))

    def fields(line: Column, idx: Column) -> Column:
        return F.struct(F.split(line, "\u0001").alias("f"), idx.alias("pos"))

    def element(r: Column) -> Column:
        g = lambda i: F.get(r["f"], F.lit(i))
        return F.struct(F.concat(F.lit("element_"), r["pos"]).alias("el_id"), r["pos"].alias("pos"), *[
            (TX.strip_ws(g(i)) if n in ("ui_name", "control_type") else g(i).try_cast("int")).alias(n)
            for i, n in enumerate(ELEMENT_FIELDS)])

    rows = F.filter(F.transform(F.split(F.regexp_replace(info, ELEMENT_LINES_RE, rewrite), "\n"), fields), lambda r: F.size(r["f"]) == 8)
    return F.filter(F.transform(rows, element), lambda e: e["cx"].isNotNull() & e["cy"].isNotNull() & e["x1"].isNotNull()
                    & e["y1"].isNotNull() & e["x2"].isNotNull() & e["y2"].isNotNull())


def cleaned_elements(elements: Column) -> Column:
    """C12 (no images), I1 (of one box the first named element, at the place of
    the box's first) and D8 (no containers) inside one block's array, which comes in the order of ``pos``:
    a short one by its pairs, a longer one by sorting it.  A single element stays whatever it is."""
    kept = F.filter(elements, lambda e: ~e["control_type"].isin(*DROPPED_TYPES))
    box = ("x1", "y1", "x2", "y2")
    named = lambda e: e["ui_name"] != ""

    def runs(sorted_: Column) -> Column:
        """The first entry of each box in a list sorted by box."""
        return _let(sorted_, lambda r: F.filter(r, lambda e, i: (i == 0) | ~F.struct(*[e[c] for c in box]).eqNullSafe(
            F.struct(*[F.get(r, i - 1)[c] for c in box]))))

    same = lambda a, b: (a["x1"] == b["x1"]) & (a["y1"] == b["y1"]) & (a["x2"] == b["x2"]) & (a["y2"] == b["y2"])

    def few_per_box(es: Column) -> Column:
        """``one_per_box`` of a short list, by its pairs."""
        firsts = F.filter(es, lambda e, i: (i == 0) | ~F.exists(F.slice(es, 1, i), lambda o: same(o, e)))
        return F.transform(firsts, lambda e: F.when(named(e), e).otherwise(F.coalesce(
            F.get(F.filter(es, lambda o: named(o) & same(o, e)), F.lit(0)).withField("pos", e["pos"]), e)))

    def one_per_box(es: Column) -> Column:
        best = runs(F.sort_array(F.transform(es, lambda e: F.struct(*[e[c] for c in box], (~named(e)).alias("unnamed"),
                                                                    e["pos"].alias("pos"), e.alias("e")))))
        first = runs(F.sort_array(F.transform(es, lambda e: F.struct(*[e[c] for c in box], e["pos"].alias("pos")))))
        return F.zip_with(best, first, lambda b, f: b["e"].withField("pos", f["pos"]))

    def holds(a: Column, b: Column) -> Column:
        return ((a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"])
                & (a["y2"] >= b["y2"]) & (~named(a) | (b["control_type"].isin(*FUNCTIONAL_TYPES)
                                                       & ~a["control_type"].isin(*FUNCTIONAL_TYPES))))

    def without_containers(es: Column) -> Column:
        """Sorted from the top, larger boxes first, a box holds only later ones that begin above its lower
        edge; where these end comes from one list of all upper and lower edges in order."""
        tops = F.transform(es, lambda r: F.struct(r["y1"].alias("y"), F.lit(0).alias("lower"), F.lit(-1).alias("i")))
        lows = F.transform(es, lambda r, i: F.struct(r["e"]["y2"].alias("y"), F.lit(1).alias("lower"), i.alias("i")))
        edges = F.transform(F.sort_array(F.concat(tops, lows)), lambda r, p: F.struct(r["i"].alias("i"), p.alias("p")))
        until = F.transform(F.filter(edges, lambda r: r["i"] >= 0), lambda r, j: F.struct(r["i"].alias("i"), (r["p"] - j).alias("n")))
        kept = _let(F.sort_array(until), lambda u: F.filter(es, lambda r, i: ~r["e"]["control_type"].isin(*CONTAINER_TYPES) & ~F.exists(
            F.slice(es, i + 2, F.greatest(F.get(u, i)["n"] - i - 1, F.lit(0))), lambda o: holds(r["e"], o["e"]))))
        return F.transform(F.sort_array(F.transform(kept, lambda r: F.struct(r["e"]["pos"].alias("pos"), r["e"].alias("e")))), lambda r: r["e"])

    def few_without_containers(es: Column) -> Column:
        """``without_containers`` of a short list, by its pairs and in its order."""
        return F.filter(es, lambda e: ~e["control_type"].isin(*CONTAINER_TYPES)
                        & ~F.exists(es, lambda o: holds(e, o) & (o["pos"] != e["pos"]) & (o["y1"] <= e["y2"])))

    ordered = lambda e: F.struct(e["y1"].alias("y1"), (-e["y2"]).alias("y2"), e["x1"].alias("x1"),
                                 (-e["x2"]).alias("x2"), e["pos"].alias("pos"), e.alias("e"))

    def few(es: Column) -> Column:
        return _let(few_per_box(es), lambda es: F.when(F.size(es) < 2, es).otherwise(few_without_containers(es)))

    def many(es: Column) -> Column:
        return _let(one_per_box(es), lambda es: F.when(F.size(es) < 2, es).otherwise(
            _let(F.sort_array(F.transform(es, ordered)), without_containers)))

    return _let(kept, lambda es: F.when(F.size(es) <= FEW, few(es)).otherwise(many(es)))


def element_lines(iters: DataFrame) -> DataFrame:
    """One row per parsed element line of every block."""
    x = iters.select("project_name", "seg", "iter_num", F.explode(parsed_elements(F.col("info"))).alias("e"))
    return x.select("project_name", "seg", "iter_num", "e.*")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body).getItem(0)


def _non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ---- B9 / B11 / B17 ------------------------------------------------------------------------------
def reflection_of(answer: Column, strict: bool = False) -> Column:
    """An Answer section with CORRECT -> 1, else ERROR -> 0, else NULL.
    Parity: 'INCORRECT' contains 'CORRECT' (Q15); ``strict`` uses word bounds."""
    ok = answer.rlike(r"\bCORRECT\b") if strict else answer.contains("CORRECT")
    return F.when(ok, F.lit(1)).when(answer.contains("ERROR"), F.lit(0))


def reflection_text(content) -> Column:
    """First Reflection Thought block that is not a prompt template,
    blank-line runs squeezed, stripped; NULL if none."""
    c = F.col(content) if isinstance(content, str) else content
    blocks = F.regexp_extract_all(c, F.lit(REFLECTION_THOUGHT_RE), 1)
    blocks = F.transform(blocks, lambda b: TX.strip_ws(b))

    def tmpl(b):
        cond = b.contains(TEMPLATE_MARKERS[0])
        for mk in TEMPLATE_MARKERS[1:]:
            cond = cond | b.contains(mk)
        return cond

    keep = F.filter(blocks, lambda b: ~tmpl(b))
    cleaned = F.transform(keep, lambda b: TX.strip_ws(F.regexp_replace(b, r"\n\s*\n+", "\n")))
    first = F.element_at(F.filter(cleaned, lambda b: b != ""), 1)
    return F.when(c.contains("### Reflection Thought ###"), first)


def answer_validity(answer) -> tuple[Column, Column]:
    """(valid, value): valid iff exactly one of '1' / '0' occurs after
    removing newlines and spaces; value 1 iff a '1' occurs."""
    a = F.col(answer) if isinstance(answer, str) else answer
    clean = F.replace(F.replace(TX.strip_ws(a), F.lit("\n"), F.lit("")), F.lit(" "), F.lit(""))
    one, zero = clean.contains("1"), clean.contains("0")
    return (one != zero), F.when(one, F.lit(1)).otherwise(F.lit(0))


# ---- D9 + C13 + C14 + H18 ------------------------------------------------------------------------------
def history_to_iter(records: DataFrame, steps: DataFrame | Column) -> DataFrame:
    """For each field, the first Step-n of the history (n = the iteration
    number) that has it overrides the block's own; both click coordinates come
    from one step.  ``steps``: ``history_steps``, joined by project and number, or
    where a record holds its log's ``step_list``, that column (nothing is moved)."""
    if isinstance(steps, Column):
        j = records.withColumn("_mine", F.filter(steps, lambda s: s["step_num"] == F.col("iter_num")))
        step = F.get("_mine", F.lit(0))
        both = lambda s: F.when(s["h_x"].isNotNull() & s["h_y"].isNotNull(), F.struct(s["h_x"], s["h_y"]))

        def mine(value) -> Column:
            """Nearly always the first step of the number has the field; the others are searched if not."""
            return F.coalesce(value(step), F.when(F.size("_mine") > 1, F.get(F.filter(
                F.transform("_mine", value), lambda v: v.isNotNull()), F.lit(0))))
        field = lambda c: lambda s: s[c]
        j = j.withColumns({c: mine(field(c)) for c in ("h_operation", "h_action", "h_reflection")} | {"h_xy": mine(both)})
    else:
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k")))
        xy = F.when(F.col("h_x").isNotNull() & F.col("h_y").isNotNull(), F.struct("h_x", "h_y"))
        own = steps.withColumn("h_xy", xy).groupBy(F.col("project_name").alias("_hp"), "step_num").agg(
            *[first(c).alias(c) for c in ("h_operation", "h_action", "h_reflection", "h_xy")])
        j = records.join(own, (F.col("project_name") == F.col("_hp")) & (F.col("iter_num") == F.col("step_num")), "left")
    xy = F.col("h_xy")
    return j.select(
        *records.columns,
        F.coalesce("h_operation", "operation_desc").alias("f_operation_desc"),
        F.coalesce("h_action", "action_content").alias("f_action_content"),
        F.coalesce("h_reflection", "reflection_thought").alias("f_reflection_thought"),
        F.coalesce(xy["h_x"], "click_x").alias("f_click_x"), F.coalesce(xy["h_y"], "click_y").alias("f_click_y"))


def analysis_gate(condition: str = "all_clicks") -> Column:
    """A click is analysed when its coordinates and description exist and
    ``condition`` is all_clicks, or error_only with reflection = 0."""
    gate = F.col("click_x").isNotNull() & F.col("operation_desc").isNotNull()
    if condition == "error_only":
        return gate & F.coalesce(F.col("reflection") == 0, F.lit(False))
    if condition != "all_clicks":
        raise ValueError(f"unknown condition {condition}")
    return gate


def trace_log_pipeline(logs: DataFrame, has_image: DataFrame | None = None,
                       condition: str = "all_clicks") -> DataFrame:
    """Logs (or the blocks of ``read_log_blocks``) -> fields and elements ->
    hit test -> history override -> one record per block.

    C14: no screenshot -> accuracy 0, method no_image, match NULL; no
    elements -> 0, element_tree_failed; else the D7 hit test (element_tree).
    ``has_image``: (project_name, iter_num, has_image); absent = all present.
    ``element_distance_sorting`` is F1 for every block with a click.
    """
    # A log's text holds its history, so its records take their steps along; single blocks are joined with them.
    whole = "content" not in logs.columns
    # A block without a click has no verdict and no distance list: nothing reads its elements.
    iters = (_log_blocks if whole else parse_blocks)(logs, clicks_only=True)
    click = F.col("click_x").isNotNull()
    iters = iters.withColumn("_els", F.when(click, cleaned_elements(parsed_elements(F.col("info")))))
    iters = iters.withColumn("_sorted", F.when(click, by_distance(F.col("_els"), F.col("click_x"), F.col("click_y"))))
    # what decides a verdict is short: the lists need not move with it
    iters = iters.withColumn("_hit", F.get(F.filter("_sorted", lambda e: e["is_inside"]), F.lit(0))["el_id"])
    iters = iters.withColumn("n_elements", F.coalesce(F.size("_els"), F.lit(0))) \
        .drop("info", "_els", "operation")  # ``operation_desc`` is the operation of a click
    if not whole:
        from judgefuse.session import checkpoint_dir
        checkpoint_dir(logs.sparkSession)
        iters = iters.checkpoint()          # parsed once: the history branch reads this too
    rec = iters.drop("history")
    if whole:  # before anything is moved by the join with the images
        rec = history_to_iter(rec, F.col("_steps")).drop("_steps")
    else:
        rec = history_to_iter(rec, history_steps(iters))
    return _judged(rec, has_image, condition)


def _judged(rec: DataFrame, has_image: DataFrame | None, condition: str) -> DataFrame:
    """C13 + C14 of records whose overrides are in ``f_`` columns."""
    if has_image is not None:
        # repeated image rows must not multiply records
        images = has_image.groupBy("project_name", "iter_num").agg(F.bool_or("has_image").alias("has_image"))
        rec = rec.join(images, ["project_name", "iter_num"], "left")
    else:
        rec = rec.withColumn("has_image", F.lit(True))
    gate, img = analysis_gate(condition), F.coalesce(F.col("has_image"), F.lit(False))
    has_el = F.col("n_elements") > 0
    hit = F.col("_hit")
    acc = F.when(~gate, F.lit(None).cast("int")).when(~img | ~has_el, F.lit(0)).otherwise(hit.isNotNull().cast("int"))
    method = (F.when(~gate, F.lit(None).cast("string")).when(~img, F.lit("no_image"))
               .when(~has_el, F.lit("element_tree_failed")).otherwise(F.lit("element_tree")))
    rec = rec.withColumns({
        "accuracy": acc, "method": method, "matched_element_id": F.when(gate & img & has_el, hit),
        "coordinate_match": F.when(gate & img, acc),
        "has_distance_sorting": F.col("click_x").isNotNull() & has_el,
        "element_distance_sorting": F.when(has_el, F.col("_sorted"))})
    return rec.select(
        "project_name", "seg", "iter_num", "reflection",
        F.col("f_click_x").alias("click_x"), F.col("f_click_y").alias("click_y"),
        F.col("f_operation_desc").alias("operation_desc"), F.col("f_action_content").alias("action_content"),
        F.col("f_reflection_thought").alias("reflection_thought"),
        "coordinate_match", "accuracy", "method", "matched_element_id", "has_distance_sorting",
        "element_distance_sorting")


def coordinate_summary(records: DataFrame) -> DataFrame:
    """E14 with parity: element_tree_cases also counts every row with a
    distance list (Q16) and unknown/no_image methods count as mllm."""
    m = F.col("method")
    return records.agg(
        F.count_if(F.col("click_x").isNotNull()).alias("total_coordinate_cases"),
        F.count_if(m.isNotNull()).alias("successfully_analyzed"),
        (F.count_if(m.isin("element_tree", "element_tree_failed")) +
         F.count_if(F.col("has_distance_sorting"))).alias("element_tree_cases"),
        F.count_if(m.isin("element_tree", "element_tree_failed")).alias("element_tree_cases_clean"),
        F.count_if((m == "element_tree") & (F.col("accuracy") == 1)).alias("element_tree_matched"),
        F.count_if(m.isNotNull() & ~m.isin("element_tree", "element_tree_failed")).alias("mllm_cases"))


def annotation_summary(records: DataFrame) -> DataFrame:
    """Non-null counts over the per-iteration records."""
    return records.agg(
        F.count(F.lit(1)).alias("total_iters"),
        F.count_if(F.col("reflection").isNotNull()).alias("reflection_found"),
        F.count_if(F.col("reflection") == 0).alias("error_cases"),
        F.count_if(F.col("coordinate_match").isNotNull()).alias("coordinate_analyzed"),
        F.count_if(F.col("action_content").isNotNull()).alias("action_found"),
        F.count_if(F.col("reflection_thought").isNotNull()).alias("reflection_thought_found"),
        F.count_if(F.col("has_distance_sorting")).alias("element_tree_found"))
