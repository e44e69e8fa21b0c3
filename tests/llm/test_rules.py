import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from judgefuse.llm import rules


def base(text):
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    n = len(w)
    seen = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    cover = {j for i in range(n - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "b", "ça", "d#", "ee|", "f"])
    out = ["\n".join(" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    return out + [None, "", " \x0b\n\n", "a a a", "a a a a", "a b c a b c", "x\nx\nx", "   ", "b c d " * 30000]


def test_base_statistics(spark, make_docs):
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in rules.base_statistics(make_docs(rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def prose(rng, n):
    w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return "\n".join(" ".join(w[i:i + 12]) for i in range(0, n, 12))


def test_outliers(spark, make_docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(60, 400)), ["en", "de", None][i % 3], ["a", "b"][i % 2]) for i in range(700)]
    junk = [(1000 + i, re.sub(r"(?<=\w)\b", "%%%", prose(rng, 100)), "en", "a") for i in range(12)]
    got = {r.doc_id: r for r in rules.judge(make_docs(rows + junk + [(2000, None, None, None), (2001, "short", "en", "a")])).collect()}
    assert sum(got[i].kept for i, *_ in rows) >= 698
    assert not any(got[i].kept for i, *_ in junk)
    assert got[2000].base_failed and got[2001].base_failed and not got[2000].kept
    assert rules.judge(make_docs([(1, "x")])).first().kept is False
    assert rules.judge(make_docs(rows[:1]).limit(0)).count() == 0


def test_estimate_against_numpy(spark):
    rng = np.random.default_rng(1)
    n = len(rules.STATS)
    a = rng.standard_normal((n, n))
    x = rng.standard_normal((1500, n)) @ a.T + 3
    x[:150] += 40  # a tenth are outliers
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "key string, " + ", ".join(f"{s} double" for s in rules.STATS))
    p = rules.estimates(rows).first()
    low = np.array([[p[f"l_{i}_{j}"] if j <= i else 0 for j in range(n)] for i in range(n)])
    assert np.abs(np.array([p[f"m_{i}"] for i in range(n)]) - x[150:].mean(0)).max() < 0.5
    # the fixed point of concentration steps: mean and covariance of the nearest COVER of all rows
    d = ((np.linalg.solve(low, (x - [p[f"m_{i}"] for i in range(n)]).T)) ** 2).sum(0)
    near = x[np.argsort(d)[:int(rules.COVER * len(x))]]
    scale = rules.COVER / rules.chi2_cdf(rules.chi2_quantile(rules.COVER, n), n + 2)
    assert np.allclose(low @ low.T, np.cov(near.T, bias=True) * scale, rtol=0.2, atol=0.3)


def test_chi2():
    assert abs(rules.chi2_cdf(11.0705, 5) - 0.95) < 1e-5 and abs(rules.chi2_quantile(0.99, 5) - 15.0863) < 1e-3


def test_table_rows_are_outliers(spark, make_docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", "a") for i in range(900)]
    cell = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    table = [(2000 + i, "\n".join(" | ".join(cell() for _ in range(6)) for _ in range(rng.randint(10, 30))), "en", "a") for i in range(60)]
    got = {r.doc_id: r for r in rules.judge(make_docs(rows + table)).collect()}
    assert not any(got[i].kept for i, *_ in table)
    assert sum(got[i].kept for i, *_ in rows) >= 880


def test_fixed_point_of_smallest_determinant(spark):
    rng = np.random.default_rng(8)
    n, m = len(rules.STATS), 1200
    x = rng.standard_normal((m, n)) * 2
    x[:240] = rng.standard_normal((240, n)) * 0.5 + 7  # a dense fifth draws the plain moments
    rows = spark.createDataFrame([("k", *map(float, r)) for r in x], "key string, " + ", ".join(f"{s} double" for s in rules.STATS))
    p = rules.estimates(rows).first()
    low = np.array([[p[f"l_{i}_{j}"] if j <= i else 0 for j in range(n)] for i in range(n)])
    centre, cov = np.array([p[f"m_{i}"] for i in range(n)]), low @ low.T
    scale = rules.COVER / rules.chi2_cdf(rules.chi2_quantile(rules.COVER, n), n + 2)

    def step(c, v):
        d = (np.linalg.solve(np.linalg.cholesky(v), (x - c).T) ** 2).sum(0)
        near = x[np.argsort(d)[:int(rules.COVER * m)]]
        return near.mean(0), np.cov(near.T, bias=True) * scale

    c2, v2 = step(centre, cov)
    assert np.abs(c2 - centre).max() < 0.02 and np.abs(v2 - cov).max() < 0.05  # one more step moves nothing
    ends = []
    for k in range(20):
        c, v = x[rng.choice(m, 40, False)].mean(0), np.cov(x[rng.choice(m, 40, False)].T)
        for _ in range(60):
            c, v = step(c, v)
        ends.append(np.linalg.slogdet(v)[1])
    assert np.linalg.slogdet(cov)[1] <= min(ends) + 0.05


def test_clashing_columns(spark, make_docs):
    rng = random.Random(4)
    docs = make_docs([(i, prose(rng, rng.randint(60, 400)), "en", "a") for i in range(60)])
    want = {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in rules.judge(docs).collect()}
    out = [*rules.BASE, "base_failed", "distance", "KEPT"]
    own = ["__row", "__words", "__text", "__l", "x_words", "m_0", "l_0_0", "key", "start", "__p", "__source", "a.b"]
    clash = docs.select("*", *[F.lit("old").alias(c) for c in out + own])
    got = rules.judge(clash)
    assert set(own) < set(got.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
    rows = got.collect()
    assert {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in rows} == want
    assert all(r[c] == "old" for r in rows for c in own)
    assert {r.doc_id: r.n_words for r in rules.base_statistics(clash.drop("a.b")).collect()} == {k: v[0] for k, v in want.items()}


def test_windows_are_compared_by_words(spark, make_docs, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every window collides
    rows = [(i, t) for i, t in enumerate(texts()[:-1])]
    got = {r.doc_id: r.n_repeat_words for r in rules.base_statistics(make_docs(rows)).collect()}
    assert got == {i: base(t)[4] for i, t in rows}
