"""Tiles, levels of detail and raster windows as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasheaf.functions import geometry as G
from terrasheaf.operators.curve import cover, in_ranges, morton
from terrasheaf.operators.density import dataset_bbox


def tile_features(features: DataFrame, grid_x: int, grid_y: int, levels: int) -> DataFrame:
    """A row per feature and level: lod, tx, ty and the simplified rings. Features without a vertex are left out.

    Each level is rolled up from the one before it, every other of its vertices, so all levels together cost one pass
    over the rings. The map box is one broadcast row; nothing else is shuffled. Write it with write_tiles."""
    box = dataset_bbox(features).select(F.struct("*").alias("_box"))
    placed = features.withColumn("_c", G.vertex_centroid(F.col("rings"))).filter(F.col("_c").isNotNull()).join(F.broadcast(box))
    tiled = placed.withColumn("_t", G.tile_for_point(F.col("_c.x"), F.col("_c.y"), F.col("_box"), grid_x, grid_y))
    levelled = tiled.withColumn("_levels", _levels(F.col("rings"), levels)).select("*", F.posexplode("_levels").alias("lod", "_rings"))
    return levelled.withColumn("rings", F.col("_rings")).withColumn("tx", F.col("_t.tx")).withColumn("ty", F.col("_t.ty")).drop("_c", "_t", "_box", "_levels", "_rings")


#: Vertices are halved so many times at most.
_DEEPEST = 6


def _levels(rings: Column, levels: int) -> Column:
    """The simplified rings of levels 0 to levels - 1; equal to simplify_ring() of each."""
    every_other = lambda r: F.filter(r, lambda _, i: i % 2 == 0)

    def picked(done: Column, k: Column) -> Column:
        last = F.element_at(done, -1)
        return F.concat(done, F.array(F.when(k <= _DEEPEST, F.transform(last, every_other)).otherwise(last)))

    def finished(thin: Column, whole: Column) -> Column:
        kept = lambda closed: F.when((F.size(whole) <= 4) | (F.size(closed) < 4), whole).otherwise(closed)
        return G.bound(G.ensure_closed(thin), kept)

    coarser = F.aggregate(F.sequence(F.lit(1), F.lit(levels - 1)), F.array(rings), picked) if levels > 1 else F.array(rings)
    return F.transform(coarser, lambda level, k: F.when(k == 0, rings).otherwise(F.zip_with(level, rings, finished)))


def tile_counts(tiles: DataFrame) -> DataFrame:
    """By level and tile: features and vertices; counts only, since a tile's features have no bound."""
    vertices = F.aggregate(F.transform("rings", F.size), F.lit(0), lambda a, b: a + b)
    return tiles.groupBy("lod", "tx", "ty").agg(F.count("*").alias("n_features"), F.sum(vertices.cast("long")).alias("n_vertices"))


def write_tiles(tiles: DataFrame, path: str, files: int = 64) -> None:
    """Up to `files` Parquet files, by level and along the curve of tiles, whatever the number of tiles: neighbours share
    a file, and read_tiles() skips files and row groups by their key ranges. A full tile is spread by row."""
    keyed = tiles.withColumn("tile_key", morton(F.col("ty"), F.col("tx")))
    spread = F.xxhash64(*(f"`{n}`" for n, kind in tiles.dtypes if "map<" not in kind and kind != "variant"))
    keyed.repartitionByRange(files, "lod", "tile_key", spread).sortWithinPartitions("lod", "tile_key").write.parquet(path)


def read_tiles(spark: SparkSession, path: str, lod: int, tx: tuple[int, int], ty: tuple[int, int]) -> DataFrame:
    """Tiles of one level, tx and ty from first to last."""
    tiles = spark.read.parquet(path).filter((F.col("lod") == lod) & in_ranges(F.col("tile_key"), cover(*ty, *tx)))
    return tiles.filter(F.col("tx").between(*tx) & F.col("ty").between(*ty)).drop("tile_key")


def cells_to_polygons(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """pixels (raster_id, r, c, px) as closed unit-grid squares with a warm tint (red 1, green .85, blue .7 of px / 255)."""
    w, h, g = 1.0 / cols, 1.0 / rows, F.col("px") / 255.0
    x, y = F.col("c") * w, F.col("r") * h
    ring = G.bbox_polygon(x, y, x + w, y + h)
    return pixels.select("raster_id", "r", "c", F.array(ring).alias("rings"), g.alias("red"), (g * 0.85).alias("green"), (g * 0.7).alias("blue"))


def raster_window(tiles: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """Pixels (raster_id, r, c, px) of a window, from tiles (raster_id, tile_row, tile_col, w, h, pixels array, width,
    height). Only tiles that meet the window are unpacked; a window outside the raster is an error."""
    outside = (F.lit(row + rows) > F.col("height")) | (F.lit(col + cols) > F.col("width")) | F.lit(row < 0 or col < 0)
    met = tiles.filter((F.col("tile_row") * F.col("h") < row + rows) & ((F.col("tile_row") + 1) * F.col("h") > row) & (F.col("tile_col") * F.col("w") < col + cols) & ((F.col("tile_col") + 1) * F.col("w") > col) | outside)
    checked = met.withColumn("pixels", F.when(outside, F.raise_error(F.lit("window outside the raster"))).otherwise(F.col("pixels")))
    return _pixels(checked, row, col, rows, cols)


def _pixels(tiles: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    each = tiles.select("raster_id", "tile_row", "tile_col", "w", "h", F.posexplode("pixels").alias("i", "px"))
    r, c = F.col("tile_row") * F.col("h") + F.floor(F.col("i") / F.col("w")), F.col("tile_col") * F.col("w") + F.col("i") % F.col("w")
    return each.select("raster_id", r.cast("int").alias("r"), c.cast("int").alias("c"), "px").filter(F.col("r").between(row, row + rows - 1) & F.col("c").between(col, col + cols - 1))


def write_raster_tiles(tiles: DataFrame, path: str, files: int = 64) -> None:
    """Tiles as raster_window() takes them, in up to `files` Parquet files along the curve of their upper left pixels.

    Beside them stands one row a raster with its size and its largest tile. The curve comes before the raster, as a
    window is read from all rasters; tiles at one place of many rasters are dealt on by raster."""
    y, x = F.col("tile_row") * F.col("h"), F.col("tile_col") * F.col("w")
    keyed = tiles.withColumns({"y0": y, "x0": x, "y1": y + F.col("h"), "x1": x + F.col("w"), "tile_key": morton(y, x)})
    keyed.repartitionByRange(files, "tile_key", "raster_id").sortWithinPartitions("tile_key").write.parquet(f"{path}/tiles")
    sizes = tiles.groupBy("raster_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("w").alias("w"), F.max("h").alias("h"))
    sizes.write.parquet(f"{path}/rasters")


def read_raster_window(spark: SparkSession, path: str, row: int, col: int, rows: int, cols: int) -> DataFrame:
    """raster_window() of what write_raster_tiles() wrote: only tiles are read whose key or edges can meet the window.

    Whether the window lies in every raster is asked of their sizes; one row of the largest tile reaches the driver."""
    rasters = spark.read.parquet(f"{path}/rasters")
    largest = rasters.agg(F.max("h").alias("h"), F.max("w").alias("w")).first()
    tall, wide = int(largest["h"] or 1), int(largest["w"] or 1)
    near = in_ranges(F.col("tile_key"), cover(row - tall + 1, row + rows - 1, col - wide + 1, col + cols - 1))
    meets = (F.col("y0") < row + rows) & (F.col("y1") > row) & (F.col("x0") < col + cols) & (F.col("x1") > col)
    tiles = spark.read.parquet(f"{path}/tiles").filter(near & meets)
    outside = (F.lit(row + rows) > F.col("height")) | (F.lit(col + cols) > F.col("width")) | F.lit(row < 0 or col < 0)
    raised = F.raise_error(F.lit("window outside the raster")).cast("boolean")
    pixels = _pixels(tiles, row, col, rows, cols)
    none = rasters.filter(F.when(outside, raised).otherwise(F.lit(False)))  # never a row: it raises where one is too small
    return pixels.unionByName(none.select(*(F.lit(None).cast(t).alias(n) for n, t in pixels.dtypes)))


def verify_rasters(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("passed", (F.col("width") > 0) & (F.col("height") > 0) & (F.col("bands") >= 1) & (F.coalesce("crs", F.lit("")) != ""))
