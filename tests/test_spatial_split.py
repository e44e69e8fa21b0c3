"""Spatial edge cases, exact nearest search, group positions with a hot key, split."""

import random

from pyspark.sql import functions as F

from judgefuse.operators import assembly as A
from judgefuse.operators import spatial as SP
from judgefuse.operators.ordering import group_positions

EL = "screen_id int, el_id long, ui_name string, control_type string, x1 int, y1 int, x2 int, y2 int, pos long"


def test_point_on_edge_and_ties(spark):
    els = spark.createDataFrame([(0, 1, "a", "Button", 0, 0, 10, 10, 0), (0, 2, "b", "Button", 10, 0, 20, 10, 1),
                                 (0, 3, "c", "Text", 100, 100, 300, 300, 2)], EL)
    clicks = spark.createDataFrame([(1, 0, 10, 5), (2, 0, 500, 500)], "click_id long, screen_id int, cx int, cy int")
    r = {x.click_id: x for x in SP.point_in_box(clicks, els, g=4).collect()}
    assert r[1].n_matches == 2 and r[1].el_id == 1      # equal distance and area -> list position
    assert r[2].n_matches == 0 and r[2].el_id is None


def test_nearest_exact_against_brute_force(spark):
    rnd = random.Random(5)
    els = [(s, i, f"e{i}", "Button", x, y, x + rnd.randint(1, 60), y + rnd.randint(1, 40), i)
           for i in range(300) for s in [i % 3] for x, y in [(rnd.randint(0, 1800), rnd.randint(0, 1000))]]
    # one sparse screen with a far corner cluster
    els += [(3, 1000 + i, "far", "Text", 1800 + i, 1000, 1810 + i, 1010, 1000 + i) for i in range(3)]
    cl = [(j, j % 4, rnd.randint(0, 1900), rnd.randint(0, 1070)) for j in range(200)]
    E = spark.createDataFrame(els, EL)
    Cdf = spark.createDataFrame(cl, "click_id long, screen_id int, cx int, cy int")
    got = {(r.click_id, r.rank): r.el_id for r in SP.nearest_elements(Cdf, E).collect()}
    for cid, sid, cx, cy in cl:
        cand = sorted((((cx - (e[4] + e[6]) / 2) ** 2 + (cy - (e[5] + e[7]) / 2) ** 2) ** 0.5,
                       (e[6] - e[4]) * (e[7] - e[5]), e[8], e[1]) for e in els if e[0] == sid)
        for rank, c in enumerate(cand, start=1):
            assert got[(cid, rank)] == c[3]


def test_any_box_touches_four_cells_at_most(spark):
    els = spark.createDataFrame([(0, 1, "a", "Button", 3, 5, 200003, 200005, 0), (0, 2, "b", "Button", 0, 0, 5, 5, 1),
                                 (0, 3, "c", "Text", 127, 127, 129, 255, 2)], EL)
    cells = {r.el_id: r["count"] for r in SP.covered_cells(els, 128).groupBy("el_id").count().collect()}
    assert max(cells.values()) <= 4
    clicks = spark.createDataFrame([(1, 0, 150000, 190000), (2, 0, 128, 200), (3, 0, 0, 0)], "click_id long, screen_id int, cx int, cy int")
    got = {r.click_id: (r.n_matches, r.el_id) for r in SP.point_in_box(clicks, els).collect()}
    assert got == {1: (1, 1), 2: (2, 3), 3: (1, 2)}


def test_container_rules(spark):
    els = spark.createDataFrame([
        (0, 1, "", "Group", 0, 0, 100, 100, 0),        # unnamed, contains 2 -> dropped
        (0, 2, "ok", "Button", 10, 10, 20, 20, 1),
        (0, 3, "pane", "Pane", 500, 500, 600, 600, 2),  # container type -> dropped
        (0, 4, "named", "Group", 200, 200, 300, 300, 3),  # contains functional 5 -> dropped
        (0, 5, "t", "Text", 210, 210, 220, 220, 4),
        (1, 6, "", "Pane", 0, 0, 10, 10, 0),            # single-element screen kept
    ], EL)
    kept = sorted(r.el_id for r in SP.container_removal(els, g=32).collect())
    assert kept == [2, 5, 6]


def test_box_dedup_prefers_named(spark):
    els = spark.createDataFrame([(0, 1, "", "Text", 0, 0, 5, 5, 0), (0, 2, "n", "Text", 0, 0, 5, 5, 1),
                                 (0, 3, "m", "Text", 0, 0, 5, 5, 2)], EL)
    r = SP.box_dedup(els).first()
    assert r.el_id == 2 and r.pos == 0


def test_group_positions_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 7}", i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o long")
    out = group_positions(df, ["g"], ["o"], "p", num_partitions=6)
    hot = [r.p for r in out.filter("g = 'hot'").orderBy("o").collect()]
    assert hot == list(range(3000))
    assert out.groupBy("g").agg(F.max("p").alias("m"), F.count("*").alias("n")).filter("m + 1 <> n").count() == 0


def test_split_exact_and_disjoint(spark):
    df = spark.createDataFrame([(f"c{i % 103}", i) for i in range(1000)], "test_case_id string, ord long")
    s = A.grouped_split(df, "test_case_id", 0.25, 42)
    val = {r.test_case_id for r in s.filter("split = 'val'").select("test_case_id").distinct().collect()}
    train = {r.test_case_id for r in s.filter("split = 'train'").select("test_case_id").distinct().collect()}
    assert len(val) == int(103 * 0.25) and not (val & train) and len(val | train) == 103
    import hashlib
    order = sorted((hashlib.md5(f"42|c{i}".encode()).hexdigest(), f"c{i}") for i in range(103))
    assert val == {c for _, c in order[: int(103 * 0.25)]}


def test_split_threshold_refines_large_buckets(spark):
    import hashlib
    cases = [f"case{i}" for i in range(500)]
    df = spark.createDataFrame([(c, j) for c in cases for j in range(2)], "test_case_id string, k int")
    for ratio in (0.2, 0.5, 0.999):
        h, n, k = A.split_threshold(df, val_ratio=ratio, seed=7, bucket_chars=1)
        ranked = sorted(hashlib.md5(f"7|{c}".encode()).hexdigest() for c in cases)
        assert (n, k) == (500, int(500 * ratio))
        assert h == ranked[k - 1]
