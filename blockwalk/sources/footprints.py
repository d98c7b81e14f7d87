"""Building footprints: tile index and pruning, line-delimited GeoJSON, provider merge input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions import domain, geo
from blockwalk.operators import cells

LINE = T.StructType([
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])

# Tile zoom, least confidence, smallest building kept.
TILE_ZOOM = 9
MIN_CONFIDENCE = 0.70
NOISE_M2 = 5.0


# --------------------------------------------------------------- tile index

def size_mb(text: Column) -> Column:
    number = F.coalesce(F.regexp_extract(text, r"^\s*(\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0))
    return F.when(text.endswith("MB"), number).when(text.endswith("KB"), number / 1024) \
        .when(text.endswith("B"), number / (1024 * 1024)).otherwise(0.0)


def tile_index(lines: DataFrame) -> DataFrame:
    """(quadkey, url, size_mb) from the index lines (column ``value``, header already dropped)."""
    cols = F.split("value", ",")
    return lines.filter(F.size(cols) >= 4).select(
        F.get(cols, F.lit(1)).alias("quadkey"), F.get(cols, F.lit(2)).alias("url"),
        size_mb(F.get(cols, F.lit(3))).alias("size_mb"))


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    return tile_index(spark.read.option("header", False).text(path).filter(~F.col("value").startswith("Location")))


def tiles_for(boxes: DataFrame, full_cover: bool = True, zoom: int = TILE_ZOOM) -> DataFrame:
    """Quadkeys each box needs: all covering tiles, or only those of its four corners."""
    x0, x1 = geo.tile_x("west", zoom), geo.tile_x("east", zoom)
    y0, y1 = geo.tile_y("north", zoom), geo.tile_y("south", zoom)
    if full_cover:
        out = boxes.withColumn("_x", F.explode(F.sequence(x0, x1))).withColumn("_y", F.explode(F.sequence(y0, y1)))
    else:
        corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        four = F.array_distinct(F.array(corner(x0, y0), corner(x1, y0), corner(x0, y1), corner(x1, y1)))
        out = boxes.withColumn("_t", F.explode(four)).withColumns({"_x": F.col("_t.x"), "_y": F.col("_t.y")}).drop("_t")
    return out.select("hlb_id", geo.tile_quadkey(F.col("_x"), F.col("_y"), zoom).alias("quadkey"))


def prune_tiles(wanted: DataFrame, index: DataFrame, max_mb: float | None = None) -> DataFrame:
    """Tiles to read per area with their state: read, missing, or skipped where the caller asks for a limit in MB."""
    too_large = F.lit(False) if max_mb is None else F.col("size_mb") > max_mb
    return wanted.join(index, "quadkey", "left").withColumn(
        "state", F.when(F.col("url").isNull(), "missing").when(too_large, "skipped").otherwise("read"))


def tile_counts(pruned: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s)
    return pruned.groupBy("hlb_id").agg(count("read").alias("tiles"), count("missing").alias("errors"),
                                        count("skipped").alias("skipped"))


# ------------------------------------------------------------- scan and clip

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Gzip tiles are not splittable; spread their lines before any geometry work."""
    return spark.read.text(path).repartition(spark.sparkContext.defaultParallelism * 4)


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Polygons of newline-delimited GeoJSON; blank, broken and other lines are dropped."""
    f = F.from_json("value", LINE)
    raw = F.get(F.col("_f.geometry.coordinates"), F.lit(0))
    return lines.filter(F.length(F.trim("value")) > 0).withColumn("_f", f) \
        .filter((F.col("_f.geometry.type") == "Polygon") & (F.size(raw) > 0)) \
        .select(*keep, F.transform(raw, lambda p: geo.point(F.get(p, F.lit(1)), F.get(p, F.lit(0)))).alias("closed_ring"),
                F.col("_f.properties").alias("properties"))


def clip(footprints: DataFrame, boundaries: DataFrame, source: str, size: float = 0.01) -> DataFrame:
    """Footprints that meet an area's boundary, for all areas at once.

    The mean of the stored vertices (closing one included) must lie in the
    boundary's box; areas and footprints meet on the grid cell of that mean, then
    the exact polygon test runs.
    """
    areas = boundaries.select("hlb_id", "ring", geo.ring_edges(F.col("ring")).alias("_edges"),
                              geo.ring_bbox(F.col("ring")).alias("_box"))
    keyed = areas.withColumn("_cy", F.explode(F.sequence(cells.cell(F.col("_box.south"), size), cells.cell(F.col("_box.north"), size)))) \
        .withColumn("_cx", F.explode(F.sequence(cells.cell(F.col("_box.west"), size), cells.cell(F.col("_box.east"), size))))
    mean = geo.vertex_mean(F.col("closed_ring"))
    shapes = footprints.withColumns({"_m": mean, "polygon": geo.open_ring(F.col("closed_ring"))}) \
        .withColumns({"_cy": cells.cell(F.col("_m.lat"), size), "_cx": cells.cell(F.col("_m.lng"), size)})
    inside = geo.in_bbox(F.col("_m.lat"), F.col("_m.lng"), F.col("_box.south"), F.col("_box.west"),
                         F.col("_box.north"), F.col("_box.east"))
    hit = shapes.join(keyed, ["_cy", "_cx"]).filter(inside) \
        .filter(geo.rings_intersect(F.col("polygon"), F.col("ring"), F.col("_edges")))
    centre = geo.vertex_mean(F.col("polygon"))
    keep = [c for c in footprints.columns if c not in ("closed_ring", "properties")]
    return hit.select("hlb_id", *keep, centre["lat"].alias("lat"), centre["lng"].alias("lng"),
                      geo.spherical_area_m2(F.col("polygon")).alias("area_sqm"), F.lit(source).alias("source"), "polygon")


def building_elements(elements: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Mapped buildings as typed footprints: ring closed when open, at least 3 vertices."""
    way = F.transform("geometry", lambda p: geo.point(p["lat"], p["lon"]))
    rings = elements.filter(domain.tag(F.col("tags"), "building").isNotNull() & (F.size("geometry") >= 3)) \
        .withColumn("polygon", geo.open_ring(way))
    areas = boundaries.select("hlb_id", "ring", geo.ring_edges(F.col("ring")).alias("_edges"))
    hit = rings.join(areas, "hlb_id").filter(geo.rings_intersect(F.col("polygon"), F.col("ring"), F.col("_edges")))
    centre, raw = geo.vertex_mean(F.col("polygon")), domain.classify_footprint(F.col("tags"))
    return hit.select("hlb_id", "id", centre["lat"].alias("lat"), centre["lng"].alias("lng"),
                      geo.spherical_area_m2(F.col("polygon")).alias("area_sqm"), F.lit("osm").alias("source"),
                      raw.alias("building_type"), domain.footprint_symbol(raw).alias("symbol_type"))


def confident(buildings: DataFrame, boundaries: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Scored footprints above a confidence whose centre lies inside the boundary."""
    areas = boundaries.select("hlb_id", geo.ring_edges(F.col("ring")).alias("_edges"))
    return buildings.filter((F.col("confidence") >= minimum) & F.col("lat").isNotNull() & F.col("lng").isNotNull()) \
        .join(areas, "hlb_id").filter(geo.point_in_edges("lat", "lng", F.col("_edges"))).drop("_edges")


def drop_noise(buildings: DataFrame, least_m2: float = NOISE_M2) -> DataFrame:
    return buildings.filter(F.col("area_sqm").isNull() | (F.col("area_sqm") > least_m2))


def source_counts(buildings: DataFrame, *keys: str) -> DataFrame:
    return buildings.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("count"))
