"""Grid and graph operators: cells, edges, neighbour sums, masked grids, nearest sections, sparse geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorloom.functions import geo


def cells(spark, nx: int = 10, ny: int = 10) -> DataFrame:
    """(cell, x, y) of a rectangular grid, row by row."""
    return spark.range(nx * ny).select(F.col("id").cast("int").alias("cell"), (F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))


def edges(grid: DataFrame) -> DataFrame:
    """(cell, neighbour) of the up to eight neighbours: eight offsets and an equi-join, so no pairs of all cells."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    around = grid.select("cell", F.explode(offsets).alias("o"), "x", "y").select("cell", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return around.join(grid.select(F.col("cell").alias("neighbour"), "x", "y"), ["x", "y"]).select("cell", "neighbour")


def transition(grid: DataFrame) -> DataFrame:
    """(cell, neighbour, weight): rows that sum to one; a cell without neighbours keeps its mass."""
    e = edges(grid)
    degree = e.groupBy("cell").agg(F.count("*").alias("degree"))
    alone = grid.select("cell").join(e, "cell", "left_anti").select("cell", F.col("cell").alias("neighbour"), F.lit(1.0).alias("weight"))
    return e.join(degree, "cell").select("cell", "neighbour", (1.0 / F.col("degree")).alias("weight")).unionByName(alone)


def neighbour_values(values: DataFrame, grid: DataFrame, value: str, keys: list[str], how: str = "sum", missing: float = 0.0) -> DataFrame:
    """Sum or least of the neighbours' values by keys and cell. For the least, an absent neighbour counts as missing."""
    e = edges(grid)
    met = values.select(*keys, F.col("cell").alias("neighbour"), value).join(F.broadcast(e), "neighbour")  # at most eight rows a cell
    if how == "sum":
        return met.groupBy(*keys, "cell").agg(F.sum(value).alias(f"neighbour_{value}"))
    return met.groupBy(*keys, "cell").agg(F.min(value).alias("m"), F.count("*").alias("n")).select(*keys, "cell", F.when(F.col("n") < 8, F.least("m", F.lit(missing))).otherwise(F.col("m")).alias(f"neighbour_{value}"))


def cell_right_closed(lon: Column, lat: Column, nx: int = 10, ny: int = 10) -> Column:
    """Cell number where upper edges belong to the cell, -1 outside."""
    i, j = geo.right_closed(lon), geo.right_closed(lat)
    return F.when((i >= 0) & (i < nx) & (j >= 0) & (j < ny), j * nx + i).otherwise(-1).cast("int")


def cell_clipped(lon: Column, lat: Column, nx: int = 10, ny: int = 10, size: float = 1.0) -> Column:
    return (geo.clipped(lat, 0.0, size, ny) * nx + geo.clipped(lon, 0.0, size, nx)).cast("int")


def latent(grid: DataFrame, size: int) -> DataFrame:
    """(cell, latent, area): fine cells, their coarse cell numbered densely in key order, and its summed area."""
    keyed = grid.withColumns({"lx": F.floor((F.col("x") + 1e-9) / size), "ly": F.floor((F.col("y") + 1e-9) / size)})
    area = geo.cell_area_km2(F.col("y").cast("double"), 1.0)
    coarse = keyed.groupBy("lx", "ly").agg(F.sum(area).alias("area")).withColumn("latent", F.dense_rank().over(Window.orderBy("ly", "lx")) - 1)  # as many rows as coarse cells
    return keyed.join(coarse, ["lx", "ly"]).select("cell", "latent", "area")


def bounds(cells: DataFrame, size: float) -> DataFrame:
    """One row (west, east, south, north) around cells (x, y) of a size, whose origins are x * size and y * size."""
    return cells.agg((F.min("x") * size).alias("west"), ((F.max("x") + 1) * size).alias("east"), (F.min("y") * size).alias("south"), ((F.max("y") + 1) * size).alias("north"))


def in_cells(points: DataFrame, cells: DataFrame, size: float, nudge: float = 1e-9) -> DataFrame:
    """points (lon, lat, ...) that lie in one of the cells (x, y), lower edges included: the mask of a grid with holes."""
    keyed = points.withColumns({"x_": geo.left_closed(F.col("lon") / size, nudge), "y_": geo.left_closed(F.col("lat") / size, nudge)})
    mask = cells.select(F.col("x").cast("long").alias("x_"), F.col("y").cast("long").alias("y_")).distinct()
    return keyed.join(mask, ["x_", "y_"], "left_semi").drop("x_", "y_")


def nearest(points: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """The k nearest sections of each point, ties by section id, exactly and for any number of sections.

    points: (point, px, py); sections: (section, sx, sy). Both are dealt to square cells; a point meets the sections of its own
    cell and the eight around it, which hold all within a cell's width. Points that have k sections within that width are done;
    for the others the width doubles, at most until it spans all points and sections.
    """
    box = sections.agg(F.count("*"), F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    of = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    n, low_x, high_x, low_y, high_y = box
    d = F.sqrt(F.pow(F.col("px") - F.col("sx"), 2) + F.pow(F.col("py") - F.col("sy"), 2))
    w = Window.partitionBy("point").orderBy("distance", "section")
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    if not n or of[0] is None:
        return points.join(sections, F.lit(False)).select("point", "section", d.alias("distance"), F.lit(0).alias("rank"))
    span = max(high_x, of[1]) - min(low_x, of[0]) + max(high_y, of[3]) - min(low_y, of[2])  # no distance is longer
    width = max(high_x - low_x, high_y - low_y, span / 100, 1e-9) * (k / n) ** 0.5
    found, left = None, points
    while True:
        cell = lambda x, size=width: F.floor(F.col(x) / size)
        around = sections.select("section", "sx", "sy", (cell("sx")).alias("cx"), (cell("sy")).alias("cy")).withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
        dealt = around.select("section", "sx", "sy", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        met = left.withColumns({"cx": cell("px"), "cy": cell("py")}).join(dealt, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= width)
        ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("point", "section", "distance", "rank")
        if width >= span:
            return ranked if found is None else found.unionByName(ranked)
        done = ranked.where(F.col("rank") == k).select("point").persist()
        settled = ranked.join(done, "point", "left_semi")
        found = settled if found is None else found.unionByName(settled)
        left = left.join(done, "point", "left_anti")
        if left.isEmpty():
            return found
        width *= 2


def sparse_geometry(near: DataFrame, bandwidth: float, cutoff: float, prior_odds: float) -> DataFrame:
    """(point, section, p, off): Gaussian weights within the cutoff against an off-section mass of one."""
    weight = F.when(F.col("distance") <= cutoff, prior_odds * F.exp(-0.5 * F.pow(F.col("distance") / bandwidth, 2))).otherwise(0.0)
    total = 1.0 + F.sum("w").over(Window.partitionBy("point"))
    return near.withColumn("w", weight).withColumn("total", total).select("point", "section", (F.col("w") / F.col("total")).alias("p"), (1.0 / F.col("total")).alias("off"))


def section_mass(geometry: DataFrame, mass: DataFrame) -> DataFrame:
    """Mass of each section, scattered from points (point, mass) by their probabilities."""
    return geometry.join(mass, "point").groupBy("section").agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))


def strongest(graph: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight): the k strongest neighbours of each node, ties by id, with weights that sum to one; loops where none."""
    w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    top = graph.where("weight > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    share = top.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "weight")
    alone = graph.select("src").distinct().join(top.select("src"), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    return share.unionByName(alone)


def axial_mean(segments: DataFrame, key: str) -> DataFrame:
    """Length-weighted mean direction modulo 180 degrees. segments: (key, dx, dy)."""
    length, angle = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.atan2("dy", "dx")
    sums = segments.groupBy(key).agg(F.sum(length * F.cos(2 * angle)).alias("c"), F.sum(length * F.sin(2 * angle)).alias("s"))
    return sums.select(key, F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)).alias("strike"))
