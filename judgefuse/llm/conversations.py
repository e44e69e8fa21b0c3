"""Conversation repair as lightest derivations.

Rows of a conversation are repaired so that the initials of their roles read
``(s?(ua)+)?``.  Every row is kept, given another role or deleted, and empty rows
may be inserted; a repair is a derivation, and the lightest one by (cost, audit)
is wanted, where the audit spells the edits' initials.

*Deductions.*  Axioms are the edits of each row and the two insertions.  An item
``(i, q)`` says that ``i`` rows are settled and the output stands at state ``q`` of
the pattern; a hyperedge joins it with an edit of row ``i`` (or an insertion) to
the next item.  Costs add and audits are strung together, which is monotone and
never less than either part (a superior function), so the agenda of Knuth's
algorithm pops every item at its final weight, and may stop at the goal.

*At scale.*  Damaged rows are range-partitioned by (conversation, turn) and
numbered, so a conversation with a third of all rows lies in many partitions.
Runs of ``PIECE`` consecutive rows are solved apart: conversations inside a run
at once, those that reach its edge as the lightest derivations between every
pair of states, which are folded in order afterwards.  Texts stay out of all
that; the last pass streams them once, behind their conversation's audit.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import checkpoint

PIECE_BITS = 9              # rows that are solved at a time: 512
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SOLID = r"[^\x20\x09-\x0D]"
ENDS = (".", "!", "?")
START, SYSTEM, USER, ASSISTANT = range(4)      # what the output's last row was
GOALS = (START, ASSISTANT)                     # nothing at all, or whole pairs
#: state reached by a row of this initial, if the pattern allows it there
STEP = {("s", START): SYSTEM, **{("u", q): USER for q in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
ROLE = {"u": "user", "a": "assistant"}
RETITLE, DROP, ADD, UNFINISHED = 3, 4, 3, 3    # costs


def lightest(axioms, rules, done):
    """Knuth's agenda: final weights of all items up to the one for which ``done`` is true.

    ``axioms``: (weight, item); ``rules(item, final)``: (weight, item) of every hyperedge
    that ``item`` completes, given the weights that are final already.
    """
    final: dict = {}
    agenda = list(axioms)
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if done(item, final):
            break
        for found in rules(item, final):
            if found[1] not in final:
                heapq.heappush(agenda, found)
    return final


def derive(rows: list[tuple[str, str]], enter: int, leave: tuple[int, ...], first_only: bool) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from state ``enter`` before ``rows`` (initial, fault) to the
    states ``leave`` behind them; with ``first_only`` to the lightest of these alone."""
    n = len(rows)
    edits: list[list[tuple[str, str, int]]] = []   # of each row: (letter, initial or '', cost)
    for initial, fault in rows:
        own = [("D", "", DROP)]
        if fault not in ("blank", "duplicate"):
            more = UNFINISHED if fault == "truncated" else 0
            own += [("K", initial, more), ("R", "u", RETITLE + more), ("R", "a", RETITLE + more)]
        edits.append(own)
    axioms = [((0, ""), ("at", 0, enter)), ((ADD, "I"), ("add", "u")), ((ADD, "I"), ("add", "a"))]
    axioms += [((cost, letter), ("edit", i, letter, initial)) for i, own in enumerate(edits) for letter, initial, cost in own]

    def join(prefix, edit, final):
        """The hyperedge of a settled prefix and an edit, if it leads anywhere."""
        _, i, q = prefix
        initial = edit[-1]
        to = q if edit[0] == "edit" and edit[2] == "D" else STEP.get((initial, q))
        if to is not None:
            (c1, a1), (c2, a2) = final[prefix], final[edit]
            yield (c1 + c2, a1 + a2), ("at", i + (edit[0] == "edit"), to)

    def rules(item, final):
        if item[0] == "at":                          # with every edit that is final
            i = item[1]
            partners = [("add", "u"), ("add", "a")]
            if i < n:
                partners += [("edit", i, letter, initial) for letter, initial, _ in edits[i]]
            for edit in partners:
                if edit in final:
                    yield from join(item, edit, final)
        else:                                        # with every prefix that is final
            places = range(n + 1) if item[0] == "add" else (item[1],)
            for i in places:
                for q in range(4):
                    if ("at", i, q) in final:
                        yield from join(("at", i, q), item, final)

    goals = {("at", n, q) for q in leave}
    if first_only:
        final = lightest(axioms, rules, lambda item, _: item in goals)
    else:
        final = lightest(axioms, rules, lambda _, final: goals <= final.keys())
    return {q: final["at", n, q] for q in leave if ("at", n, q) in final}


def lightest_goal(found: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(found[q] for q in GOALS if q in found)


# ---- the jobs ----------------------------------------------------------------------------------------
def keyed(df: DataFrame) -> DataFrame:
    """``__key``: conv_id as a text that a null cannot share."""
    c = F.col("conv_id")
    return df.withColumn("__key", F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string"))))


def damage(df: DataFrame) -> DataFrame:
    """The test damage, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.encode(F.concat(filled("conv_id"), F.lit(":"), filled("turn")), "UTF-8")) % 20
    rows = df.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), h.alias("__h")).filter("__h <> 0")
    text = F.when(F.col("__h") == 1, "").when(F.col("__h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__h") == 4, "user").otherwise(F.col("role"))
    twice = F.array_repeat(F.lit(0), F.when(F.col("__h") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("__r")).drop("__r")


def ordered(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``__key`` and ``__ord``, their place over all
    conversations: by turn (null first), then role and text.  Written, so that places last."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["__key", "turn", "role", "text"]
    rows = keyed(df.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]))
    return checkpoint(rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
                      .withColumn("__ord", F.monotonically_increasing_id()))


def with_faults(rows: DataFrame) -> DataFrame:
    """(``__key``, ``__ord``, initial, fault) of ``ordered`` rows."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    x = rows.select("__key", "__ord", F.substring("role", 1, 1).alias("initial"),
                    F.md5(F.concat("role", F.lit("\0"), "text")).alias("__same"), (~F.col("text").rlike(SOLID)).alias("__blank"),
                    (~tail.isin(*ENDS)).alias("__open"))
    # written, so that the join shuffles both sides and a part that many rows share can be split
    first = checkpoint(x.groupBy("__key", "__same").agg(F.min("__ord").alias("__first")))
    fault = (F.when(F.col("__blank"), "blank").when(F.col("__ord") > F.col("__first"), "duplicate")
              .when(F.col("__open"), "truncated").otherwise(""))
    return checkpoint(x.join(first, ["__key", "__same"]).select("__key", "__ord", "initial", fault.alias("fault")))


def audits(faults: DataFrame) -> DataFrame:
    """(``__key``, cost, audit): the lightest repair of every conversation."""
    import pyarrow as pa

    def solve(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("__ord")
        keys, row = piece.column("__key").to_pylist(), list(zip(piece.column("initial").to_pylist(), piece.column("fault").to_pylist()))
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        out: list[tuple] = []
        at = piece.column("__ord")[0].as_py() >> PIECE_BITS
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if 0 < k < len(cuts) - 2:                 # it begins and ends inside
                out.append((keys[a], at, -1, -1, *lightest_goal(derive(row[a:b], START, GOALS, True))))
                continue
            for enter in range(4):
                for leave, (cost, audit) in derive(row[a:b], enter, (START, SYSTEM, USER, ASSISTANT), False).items():
                    out.append((keys[a], at, enter, leave, cost, audit))
        cols = list(zip(*out))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["__key", "piece", "enter", "leave", "cost", "audit"])

    # narrow rows, much work: dealt by number, so that they are not gathered in few tasks for their size
    n = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = faults.select("*", F.shiftright("__ord", PIECE_BITS).alias("__piece")).repartition(n, "__piece")
    solved = checkpoint(pieces.groupBy("__piece").applyInArrow(
        solve, "__key string, piece long, enter int, leave int, cost long, audit string"))

    def fold(batches):
        key, now, state, best = None, None, {}, {}

        def close():
            nonlocal state, best
            if now is not None:                       # the lightest way to each state behind this piece
                state, best = best, {}

        def row():
            cost, audit = lightest_goal(state)
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([cost], pa.int64()), pa.array([audit])],
                                              names=["__key", "cost", "audit"])
        for batch in batches:
            for k, p, enter, leave, cost, audit in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (k, p) != (key, now):
                    close()
                    if k != key:
                        if key is not None:
                            yield row()
                        key, state = k, {START: (0, "")}
                    now = p
                if enter in state:
                    c, a = state[enter][0] + cost, state[enter][1]
                    old = best.get(leave)
                    if old is None or c < old[0] or c == old[0] and a + audit < old[1]:
                        best[leave] = (c, a + audit)
        if key is not None:
            close()
            yield row()

    edge = solved.filter("enter >= 0").repartition("__key").sortWithinPartitions("__key", "piece")
    whole = solved.filter("enter < 0").select("__key", "cost", "audit")
    return whole.unionByName(edge.mapInArrow(fold, "__key string, cost long, audit string"))


def streams(df: DataFrame, original: DataFrame) -> DataFrame:
    """Every conversation's audit (kind 0, also without rows), and behind it in order each row's
    fault (1) and text (2); so texts are moved once."""
    rows = ordered(df)
    faults = with_faults(rows)
    found = audits(faults)
    base = keyed(original.select("conv_id").distinct()).join(found, "__key", "left").select(
        "__key", F.lit(0).alias("__kind"), F.lit(-1).cast("long").alias("__ord"), "conv_id",
        F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    nothing = {"cost": F.lit(0).cast("long"), "audit": F.lit("")}
    marks = faults.withColumns({"__kind": F.lit(1), **nothing})
    texts = rows.withColumns({"__kind": F.lit(2), "turn": F.col("turn").cast("long"), **nothing})
    return (base.unionByName(marks.drop("initial"), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
            .repartition("__key").sortWithinPartitions("__key", "__ord", "__kind"))


class Repair:
    """Applies an audit to the rows of one conversation as they pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _put(self, initial: str) -> str:
        self.state = STEP[initial, self.state]
        return initial

    def _next(self) -> str:
        return "a" if self.state == USER else "u"

    def insertions(self):
        """The empty rows that come before the next row, or at the end."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield ROLE[self._put(self._next())], "", "I"

    def row(self, role: str, text: str):
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._put(role[:1])
            yield role, text, letter
        elif letter == "R":
            yield ROLE[self._put(self._next())], text, letter


def repair(df: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """The repaired rows: conv_id, seq (from 0), turn (null for inserted rows), role, text, edit (K, R or I).

    ``df`` holds conv_id, turn, role and text; a null role or text counts as one
    space, rows of one turn follow role and text, a null turn comes first, and
    rows with a null conv_id are one conversation.  Repeated rows are duplicates,
    so all but the first go.  Other columns are ignored; an empty table stays empty.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.select("conv_id").schema[0].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("seq", pa.int64()), ("turn", pa.int64()),
                        ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def made(rows):
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    def run(batches):
        fix, conv, seq = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def put(rows, turn):
                nonlocal seq
                for role, text, edit in rows:
                    out.append((conv, seq, None if edit == "I" else turn, role, text, edit))
                    seq += 1
            for kind, c, audit, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("__kind", "conv_id", "audit", "turn", "role", "text"))):
                if kind == 0:
                    if fix:
                        put(fix.insertions(), None)
                    fix, conv, seq = Repair(audit), c, 0
                elif kind == 2:
                    put(fix.row(role, text), turn)
            yield made(out)
        if fix:
            yield made([(conv, seq + k, None, *r) for k, r in enumerate(fix.insertions())])

    return streams(df, df if original is None else original).mapInArrow(
        run, f"conv_id {kind.simpleString()}, seq long, turn long, role string, text string, edit string")


def report(df: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``original`` (default ``df``): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.  Rows are read as ``repair`` reads them;
    a conversation without rows has zeros, an empty audit and the hash of an empty string."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.select("conv_id").schema[0].dataType
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    class Tally:
        def __init__(self, conv, cost, audit):
            self.row = {"conv_id": conv, **dict.fromkeys(counts, 0), "cost": cost, "audit": audit}
            self.fix, self.hash, self.lines = Repair(audit), hashlib.sha256(), 0
            self.turns, self.low, self.high, self.before, self.fault = 0, None, None, None, ""

        def write(self, rows):
            for role, text, _ in rows:
                self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
                self.lines += 1

        def take(self, turn, role, text):
            if self.fault:
                self.row[self.fault] += 1
            initial = role[:1]
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.row["illegal"] += 1
            self.before = initial
            if turn is not None and turn != self.high:   # rows come by turn
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            self.write(self.fix.row(role, text))

        def done(self):
            self.write(self.fix.insertions())
            if self.turns:
                self.row["gaps"] = self.high - self.low + 1 - self.turns
            return self.row | {"repaired_sha256": self.hash.hexdigest()}

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for kind, conv, cost, audit, turn, role, text, fault in zip(*(batch.column(n).to_pylist() for n in (
                    "__kind", "conv_id", "cost", "audit", "turn", "role", "text", "fault"))):
                if kind == 0:
                    if now:
                        out.append(now.done())
                    now = Tally(conv, cost, audit)
                elif kind == 1:
                    now.fault = fault
                else:
                    now.take(turn, role, text)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.done()], schema=schema)

    return streams(df, df if original is None else original).mapInArrow(
        run, f"conv_id {kind.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
