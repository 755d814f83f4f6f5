"""Places in outlines: an equi-join on cells, with ray casting only in cells that an outline passes through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.session import stored

#: Width of a cell in degrees, and how far beyond its ends an edge counts as touching a cell.
CELL, MARGIN = 1.0, 1e-9


def _span(low, high):
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def outline_edges(outlines: DataFrame) -> DataFrame:
    """(zone, x1, y1, x2, y2) of outlines (zone, points: an array of lon, lat). A ring is closed; nulls and rings of fewer than three points give none."""
    rings = outlines.filter("zone IS NOT NULL AND size(points) > 2 AND NOT exists(points, p -> p IS NULL OR p.lon IS NULL OR p.lat IS NULL)")
    after = F.array_append(F.slice("points", 2, F.size("points")), F.get("points", F.lit(0)))
    both = F.explode(F.arrays_zip(F.col("points").alias("a"), after.alias("b")))
    edges = rings.select("zone", both.alias("e")).select("zone", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))
    return edges.filter("x1 <> x2 OR y1 <> y2")


def zone_cells(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zone, cx, cy) of the cells that an outline passes through, and of those wholly inside it."""
    e = edges.withColumns({"left": F.least("x1", "x2"), "right": F.greatest("x1", "x2")})
    columns = e.withColumn("cx", F.explode(_span(F.col("left") - MARGIN, F.col("right") + MARGIN)))
    at = lambda x: F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    ends = [F.coalesce(at(F.greatest("left", F.col("cx") * CELL)), F.col("y1")), F.coalesce(at(F.least("right", (F.col("cx") + 1) * CELL)), F.col("y2"))]
    edge_cells = columns.select("zone", "cx", F.explode(_span(F.least(*ends) - MARGIN, F.greatest(*ends) + MARGIN)).alias("cy")).distinct()
    # the middle line of a row of cells is inside between its first and second crossing, its third and fourth, and so on
    rows = edges.withColumn("cy", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    y = (F.col("cy") + 0.5) * CELL
    crossing = rows.filter((F.col("y1") <= y) != (F.col("y2") <= y)).select("zone", "cy", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    runs = crossing.groupBy("zone", "cy").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pair = F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)))
    runs = runs.filter("size(xs) > 1").select("zone", "cy", "xs", pair.alias("i")).select("zone", F.explode(_span(F.get("xs", F.col("i")), F.get("xs", F.col("i") + 1))).alias("cx"), "cy")
    return edge_cells, runs.join(edge_cells, ["zone", "cx", "cy"], "left_anti")


def zone_in_outlines(places: DataFrame, outlines: DataFrame, default: str) -> DataFrame:
    """places (lat, lon and others) with `zone`: the outline around each, else the default; an input column zone is replaced.

    outlines: zone, points (an array of structs lon, lat); several rings of a zone count by the even-odd rule, so a ring in a ring
    is a hole. Beyond the date line a ring goes on past 180 degrees (170 to 190), and places are looked for there too.
    Of outlines around one place, that of the smallest box counts, then the first name. A place on an edge belongs to the zone
    on its east or north. Null and non-finite places, and places outside all outlines, get the default.

    A place meets the cells of zones at its own cell alone. In a cell wholly inside, that is all; in a cell of an edge it meets the
    zone's edges of its own row of cells. No place is compared with outlines elsewhere.
    """
    edges = stored(outline_edges(outlines))
    on_edge, inside = (stored(x) for x in zone_cells(edges))
    boxes = edges.groupBy("zone").agg(((F.max("x1") - F.min("x1")) * (F.max("y1") - F.min("y1"))).alias("area"))
    spots = places.select("lat", "lon").filter("abs(lat) <= 90 AND abs(lon) <= 180").distinct()
    spots = spots.withColumn("x", F.explode(F.array(F.col("lon"), F.col("lon") + 360, F.col("lon") - 360)))
    spots = spots.withColumns({"cx": F.floor(F.col("x") / CELL), "cy": F.floor(F.col("lat") / CELL)})
    sure = spots.join(inside, ["cx", "cy"]).select("lat", "lon", "zone")
    rows = edges.withColumn("cy", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    asked = spots.join(on_edge, ["cx", "cy"]).join(rows, ["zone", "cy"])
    cut = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossed = F.when(((F.col("y1") <= F.col("lat")) != (F.col("y2") <= F.col("lat"))) & (F.col("x") < cut), 1)
    odd = asked.groupBy("lat", "lon", "x", "zone").agg(F.count(crossed).alias("n")).filter("n % 2 = 1").select("lat", "lon", "zone")
    best = sure.unionByName(odd).join(boxes, "zone").groupBy("lat", "lon").agg(F.min(F.struct("area", "zone")).alias("__best"))
    names = [c for c in places.columns if c != "zone"]
    return places.select(*names).join(best, ["lat", "lon"], "left").select(*names, F.coalesce("__best.zone", F.lit(default)).alias("zone"))
