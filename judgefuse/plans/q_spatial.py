"""Registered queries: element rules, box de-dup, container removal,
point-in-box, nearest elements (C12, I1, D8, D7, F1, F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from judgefuse.operators import spatial as SP
from judgefuse.plans import fixtures as fx
from judgefuse.plans.registry import register

ELEMENTS_SQL = """
el AS (
  SELECT p_partkey // 80 AS screen_id, p_partkey AS el_id,
         CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS ui_name,
         list_extract(['Pane', 'Button', 'Edit', 'Text', 'Group', 'Image'], CAST(p_partkey % 6 + 1 AS INTEGER)) AS control_type,
         CAST((p_partkey * 37) % 1600 AS INTEGER) AS x1, CAST((p_partkey * 53) % 900 AS INTEGER) AS y1,
         CAST((p_partkey * 37) % 1600 + 20 + p_size * 8 AS INTEGER) AS x2,
         CAST((p_partkey * 53) % 900 + 10 + p_size * 4 AS INTEGER) AS y2, p_partkey * 2 AS pos, p_name
  FROM part),
clk AS (
  SELECT event_id AS click_id, event_id // 400 AS screen_id,
         CAST((event_id * 97) % 1920 AS INTEGER) AS cx, CAST((event_id * 61) % 1080 AS INTEGER) AS cy
  FROM events WHERE event_type = 'click'),
elf AS (SELECT * FROM el WHERE control_type <> 'Image')"""

@register("element_filter", ops="C12", sql="WITH" + ELEMENTS_SQL + """
SELECT screen_id, el_id, control_type, control_type IN ('Pane', 'Window', 'Document') AS is_container_type FROM elf""")
def q_element_filter(spark, sf):
    return SP.element_filter(fx.elements(spark, sf)).select("screen_id", "el_id", "control_type", "is_container_type")


@register("box_dedup", ops="I1", sql="WITH" + ELEMENTS_SQL + """,
cp AS (SELECT screen_id, el_id, ui_name, x1, y1, x2, y2, pos FROM el
       UNION ALL
       SELECT screen_id, -el_id, CASE WHEN ui_name = '' THEN p_name ELSE '' END, x1, y1, x2, y2, pos + 1 FROM el),
r AS (SELECT *, row_number() OVER (PARTITION BY screen_id, x1, y1, x2, y2 ORDER BY ui_name = '', pos) AS rn,
             min(pos) OVER (PARTITION BY screen_id, x1, y1, x2, y2) AS first_pos FROM cp)
SELECT screen_id, el_id, ui_name, x1, y1, x2, y2, first_pos AS pos FROM r WHERE rn = 1""")
def q_box_dedup(spark, sf):
    e = fx.elements_with_copies(spark, sf)
    return SP.box_dedup(e).select("screen_id", "el_id", "ui_name", "x1", "y1", "x2", "y2", "pos")


@register("container_removal", ops="D8", sql="WITH" + ELEMENTS_SQL + """,
multi AS (SELECT screen_id FROM elf GROUP BY screen_id HAVING count(*) > 1),
drop_rule AS (
  SELECT DISTINCT a.screen_id, a.el_id FROM elf a JOIN elf b
    ON a.screen_id = b.screen_id AND a.el_id <> b.el_id
   AND a.x1 <= b.x1 AND a.y1 <= b.y1 AND a.x2 >= b.x2 AND a.y2 >= b.y2
  WHERE a.ui_name = '' OR (b.control_type IN ('Button', 'Edit', 'Text') AND a.control_type NOT IN ('Button', 'Edit', 'Text'))),
dropped AS (
  SELECT screen_id, el_id FROM drop_rule WHERE screen_id IN (SELECT screen_id FROM multi)
  UNION SELECT screen_id, el_id FROM elf WHERE control_type IN ('Pane', 'Window', 'Document')
                                         AND screen_id IN (SELECT screen_id FROM multi))
SELECT screen_id, el_id, control_type FROM elf
WHERE (screen_id, el_id) NOT IN (SELECT (screen_id, el_id) FROM dropped)""")
def q_container_removal(spark, sf):
    e = SP.element_filter(fx.elements(spark, sf)).drop("is_container_type")
    return SP.container_removal(e).select("screen_id", "el_id", "control_type")


@register("point_in_box", ops="D7", doubles=("distance",), sql="WITH" + ELEMENTS_SQL + """,
hit AS (
  SELECT c.click_id, e.el_id, e.pos,
         sqrt(pow(c.cx - (e.x1 + e.x2) / 2.0, 2) + pow(c.cy - (e.y1 + e.y2) / 2.0, 2)) AS distance,
         (e.x2 - e.x1) * (e.y2 - e.y1) AS area
  FROM clk c JOIN el e ON c.screen_id = e.screen_id
   AND e.x1 <= c.cx AND c.cx <= e.x2 AND e.y1 <= c.cy AND c.cy <= e.y2),
r AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY distance, area, pos) AS rn,
             count(*) OVER (PARTITION BY click_id) AS n FROM hit)
SELECT c.click_id, coalesce(r.n, 0) AS n_matches, r.el_id, r.distance
FROM clk c LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (click_id)""")
def q_point_in_box(spark, sf):
    return SP.point_in_box(fx.clicks(spark, sf), fx.elements(spark, sf))


NEAR_SQL = "WITH" + ELEMENTS_SQL + """,
pairs AS (
  SELECT c.click_id, e.el_id, e.pos,
         sqrt(pow(c.cx - (e.x1 + e.x2) / 2.0, 2) + pow(c.cy - (e.y1 + e.y2) / 2.0, 2)) AS distance,
         (e.x2 - e.x1) * (e.y2 - e.y1) AS area,
         e.x1 <= c.cx AND c.cx <= e.x2 AND e.y1 <= c.cy AND c.cy <= e.y2 AS is_inside
  FROM clk c JOIN elf e ON c.screen_id = e.screen_id),
r AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY distance, area, pos, el_id) AS rank FROM pairs)"""


@register("elements_by_distance", ops="F1", doubles=("distance",), sql=NEAR_SQL + """
SELECT click_id, CAST(rank AS INTEGER) AS rank, el_id, distance, area, is_inside FROM r""")
def q_elements_by_distance(spark, sf):
    e = SP.element_filter(fx.elements(spark, sf)).drop("is_container_type")
    return SP.nearest_elements(fx.clicks(spark, sf), e)


@register("nearest_element", ops="F2", doubles=("distance",), sql=NEAR_SQL + """
SELECT click_id, el_id, distance, area, is_inside FROM r WHERE rank = 1""")
def q_nearest_element(spark, sf):
    e = SP.element_filter(fx.elements(spark, sf)).drop("is_container_type")
    return SP.nearest_element(fx.clicks(spark, sf), e)
