import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

import judgefuse.llm.conversations as C
from judgefuse.llm import queries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("audit", T.StringType())])
PATTERN = re.compile(r"(s?(ua)+)?\Z")
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def choices(role, text, fault):
    """(cost, letter, output rows) of a row."""
    yield 4, "D", ()
    if fault in ("", "truncated"):
        more = 3 * (fault == "truncated")
        yield more, "K", ((role, text),)
        for r in ("user", "assistant"):
            yield 3 + more, "R", ((r, text),)


def fits(output):
    """Whether rows may be followed by others to reach the pattern."""
    return bool(re.fullmatch(r"(s?(ua)*u?)", output))


def plain(rows):
    """Lightest (cost, audit, output) by trying everything, best first kept per output initials' last letter."""
    kinds = faults(rows)
    best = {"": (0, "", ())}    # by what matters of the output: nothing, 's', '...u', '...a'
    state = lambda out: "" if not out else "s" if out == "s" else out[-1]

    def improve(table, c, audit, out):
        initials = "".join(r[:1] or "?" for r, _ in out)
        if fits(initials):
            q = state(initials)
            if q not in table or (c, audit) < table[q][:2]:
                table[q] = (c, audit, out)
                return True
        return False

    def insert(table):
        while any([improve(table, c + 3, a + "I", out + ((r, ""),)) for c, a, out in list(table.values()) for r in ("user", "assistant")]):
            pass
    insert(best)
    for (_, role, text), kind in zip(rows, kinds):
        nxt = {}
        for c, a, out in best.values():
            for more, letter, new in choices(role, text, kind):
                improve(nxt, c + more, a + letter, out + new)
        insert(nxt)
        best = nxt
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def exhaustive(rows, most):
    """Every sequence of edits with at most ``most`` insertions; for tiny conversations."""
    kinds = faults(rows)
    found = []
    for picks in itertools.product(*[list(choices(r, t, k)) for (_, r, t), k in zip(rows, kinds)]):
        slots = len(rows) + 1
        for total in range(most + 1):
            for where in itertools.combinations_with_replacement(range(slots), total):
                for roles in itertools.product("ua", repeat=total):
                    audit, initials, cost = "", "", 3 * total
                    for i in range(slots):
                        for w, r in zip(where, roles):
                            if w == i:
                                audit, initials = audit + "I", initials + r
                        if i < len(rows):
                            c, letter, out = picks[i]
                            audit, cost = audit + letter, cost + c
                            initials += "".join(r[:1] or "?" for r, _ in out)
                    if PATTERN.match(initials):
                        found.append((cost, audit))
    return min(found)


def expected(rows):
    kinds = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = plain(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damaged(table):
    out = {}
    for conv, turn, role, text in table:
        blank = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        out.setdefault(conv, [])
        if h:
            text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
            out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(rows, key=key) for c, rows in out.items()}


def conversation(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Hello.", "ok", "Why?  ", " \t", "", None, "end", "Yes!\n", "a. b"]
    turns = sorted(rng.choice([None, *range(2 * n)]) or 0 for _ in range(n))
    return [(t if rng.random() < 0.9 else None, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts)) for t in turns]


@pytest.mark.parametrize("seed", range(3))
def test_derivations_against_every_sequence(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = [(t, r or " ", x or " ") for t, r, x in conversation(rng, rng.randint(0, 3))]
        found = C.derive(list(zip([r[:1] for _, r, _ in rows], faults(rows))), C.START, C.GOALS, True)
        want = exhaustive(rows, 3)
        assert C.lightest_goal(found) == want == plain(rows)[:2]


@pytest.mark.parametrize("bits", [9, 2])
def test_report_against_a_plain_second_version(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)   # conversations cross pieces even here
    rng = random.Random(bits)
    table = [(c, *row) for c in range(60) for row in conversation(rng, rng.randint(1, 12))]
    table += [(1000, *row) for row in conversation(rng, 300)]   # one conversation holds very many rows
    table += [(None, *row) for row in conversation(rng, 9)]
    df = spark.createDataFrame([(*r, "x") for r in table], SCHEMA)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in C.report(C.damage(df), df).collect()}
    assert got == {c: expected(rows) for c, rows in damaged(table).items()}


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got == {c: expected(rows) for c, rows in damaged(table).items()}


def test_repaired_rows_and_edges(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "Q?"), (1, 4, "assistant", "A."), (2, None, None, None),
            (3, 5, "assistant", "only"), (4, 1, "user", "long. " * 30000), (4, 1, "user", "long. " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {}
    for r in sorted(C.repair(df).collect(), key=lambda r: (r.conv_id, r.seq)):
        got.setdefault(r.conv_id, []).append((r.seq, r.turn, r.role, r.edit))
    assert got == {1: [(0, 0, "system", "K"), (1, 1, "user", "K"), (2, 4, "assistant", "K")],
                   4: [(0, 1, "user", "K"), (1, None, "assistant", "I")]}
    summary = {r.conv_id: r for r in C.report(df).collect()}
    assert [(summary[c].cost, summary[c].audit, summary[c].gaps) for c in (1, 2, 3, 4)] == [
        (4, "KKDK", 1), (4, "D", 0), (4, "D", 0), (7, "KDI", 0)]
    assert summary[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert C.report(df.limit(0)).count() == 0 and C.repair(df.limit(0)).count() == 0
