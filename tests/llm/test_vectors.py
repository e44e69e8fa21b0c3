import numpy as np

from judgefuse.llm.common import Forest
from judgefuse.llm.vectors import collision, near_vectors, plan


def brute(rows, cosine=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, forest = {i: 0 for i, _ in rows}, Forest()
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                forest.unite(i, j)
    return {i: (links[i], forest.find(i), forest.find(i) == i) for i, _ in rows}


def test_against_brute_force(spark, monkeypatch):
    import judgefuse.llm.vectors as V
    monkeypatch.setattr(V, "BLOCK", 8)  # crowded buckets are cut even here
    rng = np.random.default_rng(0)
    rows, at = [], 0
    for k in range(40):
        base = rng.standard_normal(16)
        for _ in range([1, 2, 5, 30][k % 4]):
            rows.append((at, (base + 0.06 * rng.standard_normal(16)).tolist()))
            at += 1
    rows += [(at + k, rows[3][1]) for k in range(25)]  # exact copies
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15),
             (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] * 16), (1008, [1e200, 2e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, recall=0.9999).collect()}
    want = brute([r for r in rows if r[0] != 1008])
    assert {k: v for k, v in got.items() if k not in (1005, 1006, 1008)} == \
        {k: v for k, v in want.items() if k not in (1005, 1006)}
    assert got[1005][:2] == (2, 1005) and got[1008][1] == 1005  # parallel vectors of any length
    assert near_vectors(df.limit(0)).count() == 0


def test_plan():
    assert collision(0.1) > 0.9 > collision(1.4)
    small, large = plan(1000, 0.95, 0.99), plan(10 ** 9, 0.95, 0.99)
    assert large[0] > small[0] and large[1] > small[1]
