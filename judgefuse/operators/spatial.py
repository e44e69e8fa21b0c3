"""Click-to-element matching on screens: C12, I1, D8, D7, F1, F2.

Elements: screen_id, el_id, ui_name, control_type, x1, y1, x2, y2 (+ ``pos``,
the element's position in its source list, used for ties).
Clicks: click_id, screen_id, cx, cy.

Hit tests and containment run on a grid whose cell size follows the box: a box
lies on the level where a cell is at least as wide and high as the box, so it
touches four cells at most whatever its size; a point looks into one cell of
each level that boxes use.  Candidates share (screen, level, cell), then the
exact predicate is applied.  Distance lists hold all elements of the click's own
screen (F1 asks for all), so there a screen is one row with an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control types treated as containers, functional types, and the
# type dropped before matching (element rules of the reference).
CONTAINER_TYPES = ["Pane", "Window", "Document"]
FUNCTIONAL_TYPES = ["Button", "Edit", "Text"]
DROPPED_TYPES = ["Image"]

DEFAULT_CELL = 128


def centre_distance(cx: Column, cy: Column, x1, y1, x2, y2) -> Column:
    mx = (x1 + x2) / F.lit(2.0)
    my = (y1 + y2) / F.lit(2.0)
    return F.sqrt(F.pow(cx - mx, 2) + F.pow(cy - my, 2))


def area(x1, y1, x2, y2) -> Column:
    return (x2.cast("long") - x1) * (y2.cast("long") - y1)


def with_level(df: DataFrame, g: int) -> DataFrame:
    """``_lvl``: the grid level whose cells (g * 2^level pixels) are no smaller than the box."""
    side = F.greatest(F.col("x2").cast("long") - F.col("x1"), F.col("y2").cast("long") - F.col("y1"), F.lit(1))
    return df.withColumn("_lvl", F.greatest(F.lit(0), F.ceil(F.log2(side / F.lit(float(g))))).cast("int"))


def _at(v: Column, g: int) -> Column:
    return F.floor(v / (F.lit(float(g)) * F.pow(F.lit(2.0), F.col("_lvl")))).cast("long")


def covered_cells(df: DataFrame, g: int) -> DataFrame:
    """One row per (element, grid cell its box touches): four at most."""
    d = with_level(df, g)
    return d.withColumn("_gx", F.explode(F.sequence(_at(F.col("x1"), g), _at(F.col("x2"), g)))) \
            .withColumn("_gy", F.explode(F.sequence(_at(F.col("y1"), g), _at(F.col("y2"), g))))


def probed_cells(df: DataFrame, x: str, y: str, levels: list[int], g: int) -> DataFrame:
    """One row per (point, level): the cell that holds the point."""
    d = df.withColumn("_lvl", F.explode(F.array(*map(F.lit, levels))))
    return d.withColumn("_gx", _at(F.col(x), g)).withColumn("_gy", _at(F.col(y), g))


def levels_of(boxes: DataFrame, g: int) -> list[int]:
    """The levels that boxes use (at most 32)."""
    return sorted(r["_lvl"] for r in with_level(boxes, g).select("_lvl").distinct().collect()) or [0]


# ---- C12 ----------------------------------------------------------------------------------------
def element_filter(elements: DataFrame) -> DataFrame:
    """Drop Image elements; flag container types."""
    return elements.filter(~F.col("control_type").isin(*DROPPED_TYPES)) \
        .withColumn("is_container_type", F.col("control_type").isin(*CONTAINER_TYPES))


# ---- I1 -----------------------------------------------------------------------------------------
def box_dedup(elements: DataFrame) -> DataFrame:
    """Per (screen, identical box) keep the first element, unless it is
    unnamed and a later one is named — then the first named one.  The kept
    element inherits the smallest list position of its box group (Q27)."""
    cols = [c for c in elements.columns if c not in ("screen_id", "x1", "y1", "x2", "y2")]
    rec = F.struct(*[F.col(c) for c in cols])
    key = F.struct((F.coalesce(F.col("ui_name"), F.lit("")) == "").alias("unnamed"), F.col("pos"))
    g = elements.groupBy("screen_id", "x1", "y1", "x2", "y2").agg(
        F.min_by(rec, key).alias("_e"), F.min("pos").alias("_pos"))
    return g.select("screen_id", "x1", "y1", "x2", "y2", "_e.*", "_pos") \
        .withColumn("pos", F.col("_pos")).drop("_pos")


# ---- D8 -----------------------------------------------------------------------------------------
def container_removal(elements: DataFrame, g: int = DEFAULT_CELL) -> DataFrame:
    """Drop A if its type is a container, or if A's box contains another
    element B and (A is unnamed, or B is functional and A is not).  Screens with a single element are kept whole.

    Containment candidates: A lies in the cells it touches, B's top-left corner
    looks into one cell of each level; (screen, level, cell) equi-join, then the
    exact box test.  The dropped set leaves through a left-anti join.
    """
    e = elements
    # container types are dropped anyway, so they never need to be probed as A
    a_side = e.filter(~F.col("control_type").isin(*CONTAINER_TYPES))
    a = covered_cells(a_side.select("screen_id", "el_id", "ui_name", "control_type", "x1", "y1", "x2", "y2"), g) \
        .select("screen_id", "_lvl", "_gx", "_gy", *[F.col(c).alias(f"a_{c}") for c in
                                             ("el_id", "ui_name", "control_type", "x1", "y1", "x2", "y2")])
    b = probed_cells(e, "x1", "y1", levels_of(a_side, g), g).select("screen_id", "_lvl", "_gx", "_gy", *[F.col(c).alias(f"b_{c}") for c in ("el_id", "ui_name", "control_type", "x1", "y1", "x2", "y2")])
    pairs = a.join(b, ["screen_id", "_lvl", "_gx", "_gy"])
    contains = ((F.col("a_x1") <= F.col("b_x1")) & (F.col("a_y1") <= F.col("b_y1")) &
                (F.col("a_x2") >= F.col("b_x2")) & (F.col("a_y2") >= F.col("b_y2")) &
                (F.col("a_el_id") != F.col("b_el_id")))
    a_named = F.coalesce(F.col("a_ui_name"), F.lit("")) != ""
    rule = ~a_named | (F.col("b_control_type").isin(*FUNCTIONAL_TYPES) & ~F.col("a_control_type").isin(*FUNCTIONAL_TYPES))
    dropped_by_rule = pairs.filter(contains & rule).select("screen_id", F.col("a_el_id").alias("el_id")).distinct()
    multi = e.groupBy("screen_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("screen_id")
    dropped_type = e.filter(F.col("control_type").isin(*CONTAINER_TYPES)).select("screen_id", "el_id") \
        .join(multi, "screen_id", "left_semi")
    dropped = dropped_by_rule.join(multi, "screen_id", "left_semi").unionByName(dropped_type)
    return e.join(dropped, ["screen_id", "el_id"], "left_anti")


# ---- D7 -----------------------------------------------------------------------------------------
def point_in_box(clicks: DataFrame, elements: DataFrame, g: int = DEFAULT_CELL) -> DataFrame:
    """For every click, the boxes of its screen that contain it (edges
    included); the best is the one with the smallest (centre distance, area,
    list position).  Returns click_id, n_matches, el_id, distance (NULL when
    nothing is hit).  Range join via grid cells, no screen-wide pairing."""
    boxes = covered_cells(elements.select("screen_id", "el_id", "x1", "y1", "x2", "y2", "pos"), g)
    pts = probed_cells(clicks.select("click_id", "screen_id", "cx", "cy"), "cx", "cy", levels_of(elements, g), g)
    hit = pts.join(boxes, ["screen_id", "_lvl", "_gx", "_gy"]).filter(
        (F.col("x1") <= F.col("cx")) & (F.col("cx") <= F.col("x2")) &
        (F.col("y1") <= F.col("cy")) & (F.col("cy") <= F.col("y2")))
    hit = hit.withColumn("distance", centre_distance(F.col("cx"), F.col("cy"), F.col("x1"), F.col("y1"),
                                                     F.col("x2"), F.col("y2"))) \
             .withColumn("area", area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    best = hit.groupBy("click_id").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.min_by(F.struct("el_id", "distance"), F.struct("distance", "area", "pos")).alias("_b"))
    return clicks.select("click_id").join(best, "click_id", "left").select(
        "click_id", F.coalesce(F.col("n_matches"), F.lit(0)).alias("n_matches"),
        F.col("_b.el_id").alias("el_id"), F.col("_b.distance").alias("distance"))


# ---- F1 / F2 --------------------------------------------------------------------------------------
def screen_elements(elements: DataFrame) -> DataFrame:
    """One row per screen: its elements as an array in list order (a screen is one capture)."""
    fields = [c for c in elements.columns if c not in ("screen_id", "pos")]
    return elements.groupBy("screen_id").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_els"))


def by_distance(elements: Column, x: Column, y: Column, by_area: bool = True) -> Column:
    """all elements of a screen by (centre distance, area if ``by_area``, list
    position) from the click, each with its box and whether it contains the
    click (edges count)."""
    def entry(e: Column) -> Column:
        mx, my = (e["x1"] + e["x2"]) / 2.0, (e["y1"] + e["y2"]) / 2.0
        inside = (e["x1"] <= x) & (x <= e["x2"]) & (e["y1"] <= y) & (y <= e["y2"])
        size = area(e["x1"], e["y1"], e["x2"], e["y2"]).alias("area")
        pos = e["pos"].alias("pos")
        return F.struct(F.sqrt(F.pow(x - mx, 2) + F.pow(y - my, 2)).alias("distance"), *((size, pos) if by_area else (pos, size)),
                        e["el_id"].alias("el_id"), e["ui_name"].alias("ui_name"), e["control_type"].alias("control_type"),
                        F.array(e["x1"], e["y1"], e["x2"], e["y2"]).alias("bbox"), inside.alias("is_inside"))
    return F.sort_array(F.transform(elements, entry))


def nearest_elements(clicks: DataFrame, elements: DataFrame, by_area: bool = True) -> DataFrame:
    """for every click all elements of its screen, ranked by centre distance
    (ties: area if ``by_area``, then list position), with area and is_inside.
    The clicks meet one row per screen; a screen with many clicks is split as
    any skewed side of a join."""
    s = clicks.select("click_id", "screen_id", "cx", "cy").join(screen_elements(elements), "screen_id")
    s = s.select("click_id", F.posexplode(by_distance(F.col("_els"), F.col("cx"), F.col("cy"), by_area)).alias("_k", "e"))
    return s.select("click_id", (F.col("_k") + 1).alias("rank"), "e.el_id", "e.distance", "e.area", "e.is_inside")


def nearest_element(clicks: DataFrame, elements: DataFrame, by_area: bool = True) -> DataFrame:
    """the first element of F1 for every click."""
    s = clicks.select("click_id", "screen_id", "cx", "cy").join(screen_elements(elements), "screen_id")
    first = F.get(by_distance(F.col("_els"), F.col("cx"), F.col("cy"), by_area), F.lit(0))
    return s.select("click_id", first.alias("e")).select("click_id", "e.el_id", "e.distance", "e.area", "e.is_inside")
