"""The nearest of the candidates that share a key with a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions.geo import squared_degrees
from hourmark.runtime import cut

# Degrees a grid cell spans. A place within one cell's width of a point lies in the 3 x 3 cells around it.
CELL = 0.5

# Points far from everything descend levels of cells, each four times the width of the next: from cells of at
# least so many degrees to cells so many levels finer than those of the grid.
COARSEST = 128.0
FINER = 4
# Coordinates beyond are in the outermost cells.
FARTHEST = 1e6

POINT = ["norm", "latitude", "longitude"]


def nearest(points: DataFrame, candidates: DataFrame, cell: float = CELL) -> DataFrame:
    """For each distinct point (norm, latitude, longitude) the candidate of the same norm that is
    nearest by squared degrees, the earlier `seq` on a tie. A point without coordinates gets the
    earliest candidate. Points without a candidate are left out.

    Points and places meet in a grid by an equi-join on key and cell, each point in the nine cells
    around it, so a key with very many places does not pair them all with all of its points. A point
    with no place within a cell's width of it is far from everything; it descends through coarser
    cells instead (`descents`). A coordinate that is not finite counts as none; where a key has no
    other places, its earliest is taken.

    Returns the point columns and `best`, a struct of the candidate's columns.
    """
    points = points.select(*POINT).distinct()
    rest = [c for c in candidates.columns if c not in ("norm", "seq")]
    # Copies at one place can only be told apart by seq: keep the earliest, before any join.
    sites = candidates.groupBy(*POINT).agg(F.min(F.struct("seq", *rest)).alias("site"))
    sites = sites.withColumnsRenamed({"latitude": "site_lat", "longitude": "site_lon"})
    earliest = sites.groupBy("norm").agg(F.min("site").alias("best"))

    placed = _finite("latitude") & _finite("longitude")
    sites = sites.where(_finite("site_lat") & _finite("site_lon"))
    somewhere = sites.select("norm", F.lit(True).alias("somewhere")).distinct()
    known = points.join(somewhere, "norm", "left").withColumn("placed", placed & F.col("somewhere").isNotNull())
    unplaced = known.where(~F.col("placed")).join(earliest, "norm").select(*POINT, "best")
    sites = sites.withColumns({"x": F.floor(F.col("site_lat") / cell), "y": F.floor(F.col("site_lon") / cell)})
    points = known.where("placed").select(*POINT)

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    reach = points.select("*", F.explode(around).alias("step")).select(
        *POINT,
        (F.floor(F.col("latitude") / cell) + F.col("step.i")).alias("x"),
        (F.floor(F.col("longitude") / cell) + F.col("step.j")).alias("y"),
    )
    near = _closest(reach.join(sites, ["norm", "x", "y"])).where(F.col("distance") <= cell * cell)

    found = near.select(*[F.col(c).alias(f"__{c}") for c in POINT])
    same = (F.col("norm") == F.col("__norm")) & (F.col("latitude") == F.col("__latitude")) & (F.col("longitude") == F.col("__longitude"))
    alone = points.join(found, same, "left_anti")
    alone = cut(alone)
    if alone.isEmpty():
        return unplaced.unionByName(near.drop("distance"))
    far = _closest(descents(alone, sites.drop("x", "y"), cell)[-1].join(_at_level(sites.drop("x", "y"), cell, 0), ["norm", "x", "y"]))
    return unplaced.unionByName(near.drop("distance")).unionByName(far.drop("distance"))


def _at_level(sites: DataFrame, cell: float, level: int) -> DataFrame:
    """The cell of each place at a level: 0 has the finest cells, and each above it four times the width."""
    finest = cell / 4**FINER
    at = lambda column: F.shiftright(F.floor(F.greatest(F.least(F.col(column), F.lit(FARTHEST)), F.lit(-FARTHEST)) / finest), 2 * level)
    return sites.withColumns({"x": at("site_lat"), "y": at("site_lon")})


def _boxes(sites: DataFrame, cell: float, level: int) -> DataFrame:
    """What the places of each cell of a level span."""
    return _at_level(sites, cell, level).groupBy("norm", "x", "y").agg(
        F.min("site_lat").alias("south"), F.max("site_lat").alias("north"), F.min("site_lon").alias("west"), F.max("site_lon").alias("east")
    )


def descents(points: DataFrame, sites: DataFrame, cell: float) -> list[DataFrame]:
    """(norm, latitude, longitude, x, y) for every level, the finest last: the cells that can hold the place
    nearest to a point.

    A point is compared with the few cells that span its key, then with the cells inside of those that
    are left, sixteen to one, and so on. The span of the places in a cell says how near and how far they
    can be; a cell is left out once all of it is farther than all of another. So a point meets a few
    cells at each of some ten levels, however many places its key has and wherever they are.
    """
    lat, lon, zero = F.col("latitude"), F.col("longitude"), F.lit(0.0)
    gap = lambda low, high, at: F.greatest(F.col(low) - at, at - F.col(high), zero)
    span = lambda low, high, at: F.greatest(F.abs(F.col(low) - at), F.abs(F.col(high) - at))
    least = gap("south", "north", lat) ** 2 + gap("west", "east", lon) ** 2
    most = span("south", "north", lat) ** 2 + span("west", "east", lon) ** 2
    bound = F.min("most").over(Window.partitionBy(*POINT))
    made: list[DataFrame] = []
    coarser = max(0, math.ceil(math.log(COARSEST / cell, 4)))
    for level in range(FINER + coarser, -1, -1):
        boxes = _boxes(sites, cell, level)
        if made:
            inside = boxes.withColumns({"__x": F.shiftright("x", 2), "__y": F.shiftright("y", 2)})
            above = made[-1].withColumnsRenamed({"x": "__x", "y": "__y"})
            met = above.join(inside, ["norm", "__x", "__y"])
        else:
            met = points.join(boxes, "norm")
        met = met.select(*POINT, "x", "y", least.alias("least"), most.alias("most"))
        made.append(met.withColumn("bound", bound).where(F.col("least") <= F.col("bound")).select(*POINT, "x", "y"))
    return made


def _finite(column: str) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(F.abs(F.col(column)) < F.lit(float("inf")), F.lit(False))


def _closest(pairs: DataFrame) -> DataFrame:
    distance = squared_degrees(F.col("site_lat"), F.col("site_lon"), F.col("latitude"), F.col("longitude"))
    best = F.min(F.struct(distance.alias("distance"), F.col("site.seq").alias("seq"), F.col("site")))
    return pairs.groupBy(*POINT).agg(best.alias("m")).select(*POINT, F.col("m.site").alias("best"), F.col("m.distance").alias("distance"))
