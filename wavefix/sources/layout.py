"""The floor plan as dimension tables.

A floor plan is one small JSON document, so its tables have a fixed size and are broadcast in joins.
``bounds`` may be a list of vertices or a rectangle; both become a polygon.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.functions.constants import FLOOR_ELEVATION_FT

DEFAULT = str(Path(__file__).parent.parent / "data" / "layout.json")

_POINT = "array<double>"
_RECT = "struct<x1: double, y1: double, x2: double, y2: double>"
_DOOR = f"struct<to: string, center: {_POINT}, width: double, wall_axis: string>"
SCHEMA = f"""poi_radius_ft double,
stair_geometry struct<runs: array<struct<from_floor: int, to_floor: int, low_z: double, high_z: double, entry_y_low: double, entry_y_high: double>>>,
floors array<struct<floor: int, name: string, outer_boundary: array<{_POINT}>,
  anchors: array<struct<id: string, position: {_POINT}, x: double, y: double, height_ft: double>>,
  stairs: array<struct<to_floor: int, entry: {_POINT}>>,
  rooms: array<struct<name: string, walkable: boolean, bounds: string,
    obstacles: array<struct<polygon: array<{_POINT}>, bounds: string>>,
    doorways: array<{_DOOR}>, stairs_openings: array<{_DOOR}>,
    gates: array<struct<axis: string, coord: double, between: array<string>>>,
    poi: array<struct<name: string, position: {_POINT}>>>>>>"""


def read(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The document as one row; the packaged plan when no path is given."""
    if path is None:
        # The packaged plan lies beside the code, where executors need not see it.
        return spark.createDataFrame([(Path(DEFAULT).read_text(),)], "value string").select(F.from_json("value", SCHEMA).alias("plan")).select("plan.*")
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def polygon(bounds: Column) -> Column:
    """Vertices from either form of ``bounds`` (JSON text); a closing vertex that repeats the first is dropped."""
    points = F.from_json(bounds, f"array<{_POINT}>")
    r = F.from_json(bounds, _RECT)
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    rect = F.array(*(F.array(r[a], r[b]) for a, b in corners))
    closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(bounds.startswith("{"), rect).otherwise(F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points))


def _floors(plan: DataFrame) -> DataFrame:
    return plan.select("poi_radius_ft", F.explode("floors").alias("f"))


def floors(plan: DataFrame) -> DataFrame:
    elevation = F.create_map(*(F.lit(v) for kv in FLOOR_ELEVATION_FT.items() for v in kv))
    xs, ys = F.transform("f.outer_boundary", lambda p: p[0]), F.transform("f.outer_boundary", lambda p: p[1])
    return _floors(plan).select("f.floor", "f.name", elevation[F.col("f.floor")].alias("elevation"), *(g(v).alias(n) for v, a in ((xs, "x"), (ys, "y")) for g, n in ((F.array_min, f"{a}_min"), (F.array_max, f"{a}_max"))))


def rooms(plan: DataFrame) -> DataFrame:
    """(floor, room_pos, room, walkable, poly); the order is the precedence when a point is in several."""
    out = _floors(plan).select("poi_radius_ft", "f.floor", F.posexplode("f.rooms").alias("room_pos", "r"))
    return out.select("poi_radius_ft", "floor", "room_pos", F.col("r.name").alias("room"), F.coalesce("r.walkable", F.lit(True)).alias("walkable"), polygon(F.col("r.bounds")).alias("poly"), "r")


def edges(polygons: DataFrame, *keep: str) -> DataFrame:
    """One row for each polygon edge (x1, y1) to (x2, y2), the previous vertex last."""
    out = polygons.select(*keep, "poly", F.posexplode("poly").alias("i", "p"))
    q = F.element_at("poly", F.when(F.col("i") == 0, F.size("poly")).otherwise(F.col("i")))
    return out.select(*keep, F.col("i").alias("edge"), F.col("p")[0].alias("xi"), F.col("p")[1].alias("yi"), q[0].alias("xj"), q[1].alias("yj"))


def gates(plan: DataFrame) -> DataFrame:
    """First gate of each room: only that one is ever consulted."""
    g = F.col("r.gates")[0]
    return rooms(plan).where(F.size("r.gates") > 0).select("floor", "room_pos", "room", g["axis"].alias("axis"), g["coord"].alias("coord"), g["between"][0].alias("above"), g["between"][1].alias("below"))


def gate_rooms(plan: DataFrame) -> DataFrame:
    """(zone, room): the room that each side of a gate lies in; of several the last in order."""
    g = F.explode(F.col("r.gates")).alias("g")
    sides = rooms(plan).where(F.size("r.gates") > 0).select("floor", "room_pos", "room", g).select("floor", "room_pos", "room", F.explode("g.between").alias("zone"))
    return sides.groupBy("zone").agg(F.max_by("room", F.struct("floor", "room_pos")).alias("room"))


def pois(plan: DataFrame) -> DataFrame:
    out = rooms(plan).select("floor", "room_pos", "room", F.coalesce("poi_radius_ft", F.lit(3.0)).alias("radius"), F.posexplode("r.poi").alias("poi_pos", "p"))
    return out.select("floor", "room", (F.col("room_pos") * 100 + F.col("poi_pos")).alias("zone_pos"), F.concat_ws("_", "room", "p.name").alias("zone"), F.col("p.position")[0].alias("px"), F.col("p.position")[1].alias("py"), "radius")


def anchors(plan: DataFrame) -> DataFrame:
    """(anchor_idx, anchor_id, floor, ax, ay, height, az), ids in lower case, in layout order."""
    elevation = F.create_map(*(F.lit(v) for kv in FLOOR_ELEVATION_FT.items() for v in kv))
    out = plan.select(F.posexplode(F.flatten(F.transform("floors", lambda f: F.transform(f["anchors"], lambda a: F.struct(f["floor"].alias("floor"), a.alias("a")))))).alias("anchor_idx", "x"))
    at = F.coalesce(F.col("x.a.position"), F.array("x.a.x", "x.a.y"))
    height = F.coalesce("x.a.height_ft", F.lit(0.0))
    return out.select("anchor_idx", F.lower("x.a.id").alias("anchor_id"), "x.floor", at[0].alias("ax"), at[1].alias("ay"), height.alias("height"), (elevation[F.col("x.floor")] + height).alias("az"))


def stairs(plan: DataFrame) -> DataFrame:
    out = _floors(plan).select("f.floor", F.posexplode("f.stairs").alias("stair_pos", "s"))
    return out.select(F.col("floor").alias("from_floor"), "s.to_floor", (F.col("floor") * 100 + F.col("stair_pos")).alias("stair_pos"), F.coalesce(F.col("s.entry")[0], F.lit(0.0)).alias("ex"), F.coalesce(F.col("s.entry")[1], F.lit(0.0)).alias("ey"))


def runs(plan: DataFrame) -> DataFrame:
    """Stair runs under both of their floors, in order."""
    out = plan.select(F.posexplode("stair_geometry.runs").alias("run_pos", "run"))
    return out.select("run_pos", F.explode(F.array("run.from_floor", "run.to_floor")).alias("floor"), "run.low_z", "run.high_z", "run.entry_y_low", "run.entry_y_high")


def staircase_bounds(plan: DataFrame) -> DataFrame:
    """(floor, x_max) of the last room called staircase."""
    out = rooms(plan).where("room = 'staircase'").select("floor", "room_pos", F.array_max(F.transform("poly", lambda p: p[0])).alias("x"))
    return out.groupBy("floor").agg(F.max_by("x", "room_pos").alias("x_max"))


def adjacency(plan: DataFrame) -> DataFrame:
    one = stairs(plan).select(F.col("from_floor").alias("floor_a"), F.col("to_floor").alias("floor_b"))
    return one.union(one.select("floor_b", "floor_a")).distinct()


def obstacles(plan: DataFrame) -> DataFrame:
    out = rooms(plan).select("floor", "room_pos", F.posexplode("r.obstacles").alias("n", "o"))
    return out.select("floor", (F.col("room_pos") * 100 + F.col("n")).alias("obstacle"), F.coalesce("o.polygon", polygon(F.col("o.bounds"))).alias("poly"))


def openings(plan: DataFrame) -> DataFrame:
    """Doorways but those to the exterior, and stair openings."""
    doors = F.filter(F.coalesce("r.doorways", F.array()), lambda d: F.coalesce(d["to"], F.lit("")) != "exterior")
    out = rooms(plan).select("floor", F.explode(F.concat(doors, F.coalesce("r.stairs_openings", F.array()))).alias("d"))
    return out.select("floor", F.col("d.center")[0].alias("cx"), F.col("d.center")[1].alias("cy"), "d.width", "d.wall_axis")


@cache
def values(name: str, alias: str | None = None) -> str:
    """A dimension of the packaged plan as a SQL VALUES list, for the SQL twins of queries."""
    plan: dict[str, Any] = json.loads(Path(DEFAULT).read_text())
    rows: list[tuple] = []

    def poly(b: Any) -> list:
        if isinstance(b, dict):
            return [[b["x1"], b["y1"]], [b["x2"], b["y1"]], [b["x2"], b["y2"]], [b["x1"], b["y2"]]]
        return b[:-1] if len(b) > 1 and b[0] == b[-1] else b

    def sides(p: list) -> list[tuple]:
        return [(i, *map(float, p[i]), *map(float, p[i - 1])) for i in range(len(p))]

    anchor = 0
    for f in plan["floors"]:
        n = f["floor"]
        if name == "anchors":
            for a in f["anchors"]:
                rows.append((anchor, a["id"].lower(), n, *map(float, a["position"]), float(a.get("height_ft", 0)), FLOOR_ELEVATION_FT[n] + a.get("height_ft", 0)))
                anchor += 1
        if name == "stairs":
            rows += [(n, s["to_floor"], n * 100 + i, *map(float, s["entry"])) for i, s in enumerate(f["stairs"])]
        for pos, r in enumerate(f["rooms"]):
            if name == "rooms":
                rows.append((n, pos, r["name"], bool(r.get("walkable", True))))
            if name == "room_edges":
                rows += [(n, pos, *e) for e in sides(poly(r["bounds"]))]
            if name == "gates" and r.get("gates"):
                g = r["gates"][0]
                rows.append((n, pos, g["axis"], float(g["coord"]), *g["between"]))
            if name == "pois":
                rows += [(n, r["name"], pos * 100 + i, f"{r['name']}_{p['name']}", *map(float, p["position"]), float(plan["poi_radius_ft"])) for i, p in enumerate(r.get("poi", []))]
            if name == "obstacle_edges":
                rows += [(n, pos * 100 + i, *e) for i, o in enumerate(r.get("obstacles", [])) for e in sides(poly(o.get("polygon") or o["bounds"]))]
            if name == "openings":
                rows += [(n, *map(float, d["center"]), float(d["width"]), d["wall_axis"]) for d in [*(x for x in r.get("doorways", []) if x.get("to") != "exterior"), *r.get("stairs_openings", [])]]
            if name == "staircase" and r["name"] == "staircase":
                rows.append((n, float(max(p[0] for p in poly(r["bounds"])))))
    if name == "runs":
        rows += [(i, n, r["low_z"], r["high_z"], r["entry_y_low"], r["entry_y_high"]) for i, r in enumerate(plan["stair_geometry"]["runs"]) for n in (r["from_floor"], r["to_floor"])]
    if name == "floors":
        rows += [(n, z) for n, z in FLOOR_ELEVATION_FT.items()]

    def literal(v: Any) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS {alias or name}({COLUMNS[name]})"


#: Columns of ``values``.
COLUMNS = {
    "anchors": "anchor_idx, anchor_id, floor, ax, ay, height, az",
    "stairs": "from_floor, to_floor, stair_pos, ex, ey",
    "rooms": "floor, room_pos, room, walkable",
    "room_edges": "floor, room_pos, edge, xi, yi, xj, yj",
    "gates": "floor, room_pos, axis, coord, above, below",
    "pois": "floor, room, zone_pos, zone, px, py, radius",
    "obstacle_edges": "floor, obstacle, edge, xi, yi, xj, yj",
    "openings": "floor, cx, cy, width, wall_axis",
    "staircase": "floor, x_max",
    "runs": "run_pos, floor, low_z, high_z, entry_y_low, entry_y_high",
    "floors": "floor, elevation",
}
