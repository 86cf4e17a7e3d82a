"""Rooms, the occupancy grid and rays over it.

The floor plan's tables are of fixed size, so they are broadcast; whatever has
many rows (positions, particles) is never shuffled to meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavefix.functions import constants as K
from wavefix.functions.signal import cell_centre, inside
from wavefix.sources import layout


#: Feet of the cells that find a point's polygons.
CELL_FT = 2.0


def polygon_cells(plan: DataFrame, size: float = CELL_FT) -> DataFrame:
    """One row for each (floor, cell) that a room's bounding box touches: its rooms in order, with vertices and first gate."""
    side = lambda i, pick: F.floor(pick(F.transform("poly", lambda p: p[i])) / size).cast("long")
    g = layout.gates(plan).select("floor", "room_pos", F.struct("axis", "coord", "above", "below").alias("gate"))
    rooms = layout.rooms(plan).select("floor", "room_pos", "room", "poly").join(g, ["floor", "room_pos"], "left")
    at = lambda i, name: F.explode(F.sequence(side(i, F.array_min), side(i, F.array_max))).alias(name)
    cells = rooms.withColumn("_r", F.struct("room_pos", "room", "poly", "gate")).select("floor", "_r", "poly", at(0, "_cx")).select("floor", "_r", "_cx", at(1, "_cy"))
    return cells.groupBy("floor", "_cx", "_cy").agg(F.array_sort(F.collect_list("_r")).alias("_rooms"))


def in_polygon(poly: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over an array of vertices, as one expression."""

    def edge(odd: Column, i: Column) -> Column:
        p, q = poly[i], F.element_at(poly, F.when(i == 0, F.size(poly)).otherwise(i))
        cross = (p[1] > y) != (q[1] > y)
        at = (q[0] - p[0]) * (y - p[1]) / F.when(q[1] != p[1], q[1] - p[1]) + p[0]
        return odd != F.coalesce(cross & (x < at), F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), F.size(poly) - 1), F.lit(False), edge)


def labelled(points: DataFrame, plan: DataFrame, size: float = CELL_FT) -> DataFrame:
    """Add room and zone to points (x, y, floor): the first polygon in order wins, then the room's first gate decides.

    A point meets the polygons of its cell by an equi-join, so that it isn't tested against a whole floor's; Spark broadcasts the cells
    where the plan is small.
    """
    x, y = F.col("x"), F.col("y")
    out = points.withColumns({"_cx": F.floor(x / size).cast("long"), "_cy": F.floor(y / size).cast("long")}).join(polygon_cells(plan, size), ["floor", "_cx", "_cy"], "left")
    out = out.withColumn("_r", F.get(F.filter("_rooms", lambda r: in_polygon(r["poly"], x, y)), F.lit(0)))
    at = F.when(F.col("_r.gate.axis") == "x", x).otherwise(y)
    gated = F.when(F.col("_r.gate").isNull(), F.col("_r.room")).when(at >= F.col("_r.gate.coord"), F.col("_r.gate.above")).otherwise(F.col("_r.gate.below"))
    return out.withColumns({"room": F.coalesce("_r.room", F.lit("unknown")), "zone": F.coalesce(gated, F.lit("unknown"))}).drop("_r", "_rooms", "_cx", "_cy")


def walkable_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Add walkable to points (x, y, floor) of any floors: an unknown floor is not walkable."""
    out = points.join(F.broadcast(grid_arrays(cells)), "floor", "left")  # of the plan's size
    good = is_walkable(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("free"), F.col("x_max"), F.col("y_max"))
    return out.withColumn("walkable", F.coalesce(good, F.lit(False))).drop("w", "h", "free", "x_max", "y_max")


def grid(plan: DataFrame, res: float = K.GRID_FT) -> DataFrame:
    """(floor, row, col, walkable, x_max, y_max): rooms, less obstacles and walls between rooms, with openings carved last."""
    dims = layout.floors(plan).select("floor", F.ceil((F.col("x_max") - F.col("x_min")) / res).cast("int").alias("w"), F.ceil((F.col("y_max") - F.col("y_min")) / res).cast("int").alias("h"), "x_max", "y_max")
    cells = dims.select("floor", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row")).select("floor", "w", "h", "row", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))
    cells = cells.select("floor", "row", "col", ((F.col("col") + 0.5) * res).alias("cx"), ((F.col("row") + 0.5) * res).alias("cy"))

    def covered(polygons: DataFrame, key: str) -> DataFrame:
        e = F.broadcast(layout.edges(polygons, "floor", key))
        hit = cells.join(e, "floor").groupBy("floor", "row", "col", key).agg(F.sum(inside("cx", "cy")).alias("n"))
        return hit.where("n % 2 = 1").groupBy("floor", "row", "col").agg(F.min(key).alias(key))

    rooms = covered(layout.rooms(plan).where("walkable"), "room_pos")
    blocked = covered(layout.obstacles(plan), "obstacle").select("floor", "row", "col", F.lit(True).alias("blocked"))
    o = layout.openings(plan)
    half = F.col("width") / 2
    dx, dy = (F.when(F.col("wall_axis") == axis, half).otherwise(2 * res) for axis in ("x", "y"))
    near = (F.abs(F.col("cx") - F.col("ox")) <= F.col("dx")) & (F.abs(F.col("cy") - F.col("oy")) <= F.col("dy"))
    o = o.select(F.col("floor").alias("of"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), dx.alias("dx"), dy.alias("dy"))
    carved = cells.join(F.broadcast(o), (F.col("floor") == F.col("of")) & near).select("floor", "row", "col", F.lit(True).alias("carved")).distinct()

    out = cells.join(rooms, ["floor", "row", "col"], "left").join(blocked, ["floor", "row", "col"], "left").join(carved, ["floor", "row", "col"], "left")
    out = out.withColumn("room_pos", F.when(F.col("blocked").isNull(), F.col("room_pos")))
    # A wall stands where neighbouring open cells belong to different rooms, on the cell of the later room.
    side = out.select("floor", "row", "col", "room_pos").where("room_pos IS NOT NULL")
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))))).alias("s")
    around = side.select("floor", "room_pos", "row", "col", steps).select("floor", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("room_pos").alias("beside"))
    wall = side.join(around, ["floor", "row", "col"]).where("room_pos > beside").select("floor", "row", "col", F.lit(True).alias("wall")).distinct()
    out = out.join(wall, ["floor", "row", "col"], "left")
    free = F.col("carved").isNotNull() | (F.col("room_pos").isNotNull() & F.col("wall").isNull())
    return out.select("floor", "row", "col", free.alias("walkable")).join(F.broadcast(dims.select("floor", "x_max", "y_max")), "floor")


def grid_arrays(cells: DataFrame) -> DataFrame:
    """One row for each floor: (floor, w, h, free, x_max, y_max), ``free`` row by row."""
    ordered = F.array_sort(F.collect_list(F.struct("row", "col", "walkable")))
    return cells.groupBy("floor").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"), F.transform(ordered, lambda c: c["walkable"]).alias("free"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def walkable_fraction(cells: DataFrame) -> DataFrame:
    return cells.groupBy("floor").agg(F.avg(F.col("walkable").cast("int")).alias("fraction"))


def cell_index(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(row, col) of a point: truncated, then clamped to the grid."""
    col, row = ((v / K.GRID_FT).cast("int") for v in (x, y))
    return F.greatest(F.lit(0), F.least(h - 1, row)), F.greatest(F.lit(0), F.least(w - 1, col))


def is_walkable(x: Column, y: Column, w: Column, h: Column, free: Column, x_max: float | Column, y_max: float | Column) -> Column:
    row, col = cell_index(x, y, w, h)
    return (x >= 0) & (y >= 0) & (x <= x_max) & (y <= y_max) & free[row * w + col]


def nearest_walkable(points: DataFrame, cells: DataFrame) -> DataFrame:
    """For points (key, floor, x, y) the walkable cell in the first ring around their own that has one, nearest first."""
    dims = cells.groupBy("floor").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    row, col = cell_index(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    own = points.join(F.broadcast(dims), "floor").withColumns({"r0": row, "c0": col})
    both = own.join(F.broadcast(cells.where("walkable").select("floor", "row", "col")), "floor")
    dr, dc = F.col("row") - F.col("r0"), F.col("col") - F.col("c0")
    cx, cy = cell_centre("col", F.lit(0)), cell_centre("row", F.lit(0))
    d2 = (cx - F.col("x")) * (cx - F.col("x")) + (cy - F.col("y")) * (cy - F.col("y"))
    ring = F.greatest(F.abs(dr), F.abs(dc))
    best = F.min_by(F.struct(cx.alias("sx"), cy.alias("sy")), F.struct(ring, F.round(d2, 9), dr, dc))
    return both.groupBy("key", "floor").agg(best.alias("s")).select("key", "floor", "s.*")


def ray(r0: Column, c0: Column, r1: Column, c1: Column, w: Column, free: Column) -> Column:
    """Walk Bresenham's cells from one cell to another: struct(clear, walls).

    ``clear``: all cells are walkable; ``walls``: how often the walk goes from a walkable
    cell (the one before the first counts as walkable) into a blocked one. The walk
    has max(|dr|, |dc|) + 1 cells, so the fold has a fixed length.
    """
    dr, dc = F.abs(r1 - r0), F.abs(c1 - c0)
    sr, sc = F.when(r0 < r1, 1).otherwise(-1), F.when(c0 < c1, 1).otherwise(-1)
    start = F.struct(r0.cast("int").alias("r"), c0.cast("int").alias("c"), (dc - dr).cast("int").alias("err"), F.lit(True).alias("clear"), F.lit(0).alias("walls"), F.lit(True).alias("was"))

    def step(s: Column, _: Column) -> Column:
        here = free[s["r"] * w + s["c"]]
        e2 = 2 * s["err"]
        go_c, go_r = e2 > -dr, e2 < dc
        err = s["err"] - F.when(go_c, dr).otherwise(0) + F.when(go_r, dc).otherwise(0)
        return F.struct(
            (s["r"] + F.when(go_r, sr).otherwise(0)).cast("int").alias("r"), (s["c"] + F.when(go_c, sc).otherwise(0)).cast("int").alias("c"), err.cast("int").alias("err"),
            (s["clear"] & here).alias("clear"), (s["walls"] + F.when(s["was"] & ~here, 1).otherwise(0)).alias("walls"), here.alias("was"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.greatest(dr, dc)), start, step, lambda s: F.struct(s["clear"], s["walls"]))


def rays(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Add clear and n_walls to rows with floor, (x, y) and (tx, ty)."""
    out = pairs.join(F.broadcast(arrays), "floor")
    r0, c0 = cell_index(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    r1, c1 = cell_index(F.col("tx"), F.col("ty"), F.col("w"), F.col("h"))
    out = out.withColumns({"_r0": r0, "_c0": c0, "_r1": r1, "_c1": c1})
    out = out.withColumn("_ray", ray(F.col("_r0"), F.col("_c0"), F.col("_r1"), F.col("_c1"), F.col("w"), F.col("free")))
    return out.withColumns({"clear": F.col("_ray.clear"), "n_walls": F.col("_ray.walls")}).drop("_ray", "_r0", "_c0", "_r1", "_c1", "w", "h", "free", "x_max", "y_max")


def anchor_rays(cells: DataFrame, snapped: DataFrame) -> DataFrame:
    """(floor, row, col, anchor_idx, clear, n_walls) from each cell to each snapped anchor of its floor.

    A ray depends on its two cells only, so this table of the plan's size answers for any number of particles.
    """
    s = F.broadcast(snapped.select(F.col("key").alias("anchor_idx"), "floor", F.col("sx").alias("tx"), F.col("sy").alias("ty")))
    at = cells.select("floor", "row", "col", cell_centre("col", F.lit(0)).alias("x"), cell_centre("row", F.lit(0)).alias("y"))
    return rays(at.join(s, "floor").repartition("floor", "row"), grid_arrays(cells)).select("floor", "row", "col", "anchor_idx", "clear", "n_walls")


def in_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Add row and col of points (x, y, floor)."""
    dims = cells.groupBy("floor").agg((F.max("col") + 1).alias("_w"), (F.max("row") + 1).alias("_h"))
    row, col = cell_index(F.col("x"), F.col("y"), F.col("_w"), F.col("_h"))
    return points.join(F.broadcast(dims), "floor").withColumns({"row": row, "col": col}).drop("_w", "_h")


# --- the grid in SQL --------------------------------------------------------------

SQL_GRID = f"""cells AS MATERIALIZED (
  SELECT f AS floor, row, col, (col + 0.5) * 0.5 AS cx, (row + 0.5) * 0.5 AS cy FROM range(1, 4) a(f), range(0, 59) b(row), range(0, 36) d(col)
), in_room AS MATERIALIZED (
  SELECT floor, row, col, min(room_pos) AS room_pos FROM (
    SELECT c.floor, row, col, e.room_pos FROM cells c JOIN {layout.values("room_edges", "e")} ON e.floor = c.floor JOIN {layout.values("rooms", "q")} ON q.floor = e.floor AND q.room_pos = e.room_pos AND q.walkable
    GROUP BY ALL HAVING sum(CASE WHEN (yi > cy) <> (yj > cy) AND cx < (xj - xi) * (cy - yi) / nullif(yj - yi, 0) + xi THEN 1 ELSE 0 END) % 2 = 1
  ) GROUP BY ALL
), in_obstacle AS MATERIALIZED (
  SELECT DISTINCT floor, row, col FROM (
    SELECT c.floor, row, col, obstacle FROM cells c JOIN {layout.values("obstacle_edges", "e")} ON e.floor = c.floor
    GROUP BY ALL HAVING sum(CASE WHEN (yi > cy) <> (yj > cy) AND cx < (xj - xi) * (cy - yi) / nullif(yj - yi, 0) + xi THEN 1 ELSE 0 END) % 2 = 1
  )
), open_cells AS MATERIALIZED (SELECT * FROM in_room ANTI JOIN in_obstacle USING (floor, row, col)), beside AS MATERIALIZED (
  SELECT floor, row + dr AS row, col + dc AS col, room_pos FROM open_cells, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS v(dr, dc)
), walls AS MATERIALIZED (
  SELECT DISTINCT a.floor, a.row, a.col FROM open_cells a JOIN beside b ON a.floor = b.floor AND a.row = b.row AND a.col = b.col WHERE a.room_pos > b.room_pos
), carved AS MATERIALIZED (
  SELECT DISTINCT c.floor, row, col FROM cells c JOIN {layout.values("openings", "o")} ON o.floor = c.floor
    AND abs(c.cx - o.cx) <= CASE WHEN wall_axis = 'x' THEN width / 2 ELSE 1.0 END AND abs(c.cy - o.cy) <= CASE WHEN wall_axis = 'y' THEN width / 2 ELSE 1.0 END
), grid AS MATERIALIZED (
  SELECT c.floor, c.row, c.col, (v.floor IS NOT NULL OR (o.floor IS NOT NULL AND w.floor IS NULL)) AS walkable
  FROM cells c LEFT JOIN carved v USING (floor, row, col) LEFT JOIN open_cells o USING (floor, row, col) LEFT JOIN walls w USING (floor, row, col)
)"""
SQL_ROOM = f"""room_hit AS (
  SELECT pid, min(room_pos) AS room_pos FROM (
    SELECT pid, x, y, e.room_pos FROM c JOIN {layout.values("room_edges", "e")} ON e.floor = c.floor
    GROUP BY ALL HAVING sum(CASE WHEN (yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / nullif(yj - yi, 0) + xi THEN 1 ELSE 0 END) % 2 = 1
  ) GROUP BY ALL
), lab AS (
  SELECT c.pid, c.x, c.y, c.floor, coalesce(q.room, 'unknown') AS room,
         coalesce(CASE WHEN g.axis IS NULL THEN q.room WHEN (CASE WHEN g.axis = 'x' THEN c.x ELSE c.y END) >= g.coord THEN g.above ELSE g.below END, 'unknown') AS zone
  FROM c LEFT JOIN room_hit h USING (pid) LEFT JOIN {layout.values("rooms", "q")} ON q.floor = c.floor AND q.room_pos = h.room_pos
    LEFT JOIN {layout.values("gates", "g")} ON g.floor = c.floor AND g.room_pos = h.room_pos
)"""
#: Walks rays (rid, floor, r0, c0, r1, c1) step by step; ``walked`` has rid, clear, n_walls.
SQL_RAYS = """steps AS (
  SELECT rid, floor, r0 AS r, c0 AS c, r1, c1, abs(r1 - r0) AS dr, abs(c1 - c0) AS dc, CASE WHEN r0 < r1 THEN 1 ELSE -1 END AS sr, CASE WHEN c0 < c1 THEN 1 ELSE -1 END AS sc, abs(c1 - c0) - abs(r1 - r0) AS err, 0 AS n FROM ray_in
  UNION ALL
  SELECT rid, floor, CASE WHEN 2 * err < dc THEN r + sr ELSE r END, CASE WHEN 2 * err > -dr THEN c + sc ELSE c END, r1, c1, dr, dc, sr, sc,
         err - CASE WHEN 2 * err > -dr THEN dr ELSE 0 END + CASE WHEN 2 * err < dc THEN dc ELSE 0 END, n + 1
  FROM steps WHERE n < greatest(dr, dc)
), walked AS (
  SELECT rid, bool_and(walkable) AS clear, CAST(sum(CASE WHEN NOT walkable AND was THEN 1 ELSE 0 END) AS INTEGER) AS n_walls
  FROM (SELECT rid, walkable, coalesce(lag(walkable) OVER (PARTITION BY rid ORDER BY n), true) AS was FROM steps s JOIN grid g ON g.floor = s.floor AND g.row = s.r AND g.col = s.c) GROUP BY rid
)"""
SQL_SNAP = f"""snap AS (
  SELECT anchor_idx, floor, arg_min(sx, k) AS sx, arg_min(sy, k) AS sy FROM (
    SELECT a.anchor_idx, a.floor, (g.col + 0.5) * 0.5 AS sx, (g.row + 0.5) * 0.5 AS sy, (g.col + 0.5) * 0.5 - a.ax AS ex, (g.row + 0.5) * 0.5 - a.ay AS ey,
           g.row - greatest(0, least(58, CAST(trunc(a.ay / 0.5) AS INTEGER))) AS dr, g.col - greatest(0, least(35, CAST(trunc(a.ax / 0.5) AS INTEGER))) AS dc,
           {{'a': greatest(abs(dr), abs(dc)), 'b': round(ex * ex + ey * ey, 9), 'c': dr, 'd': dc}} AS k
    FROM {layout.values("anchors", "a")} JOIN grid g ON g.floor = a.floor AND g.walkable
  ) GROUP BY ALL
)"""
