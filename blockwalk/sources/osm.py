"""Saved map-element dumps: parsing, sanity check, layer status and element selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwalk.functions import domain, geo

ELEMENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.ArrayType(T.StructType([
        T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])))])
DUMP = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT))])


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """One row per dump file: (path, body)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def check_dumps(dumps: DataFrame) -> DataFrame:
    """Parse bodies; a body starting with ``<`` or ``Error:`` is a failure message, not data."""
    text = F.trim(F.regexp_replace("body", r"^\s+", ""))
    refused = text.startswith("<") | text.startswith("Error:")
    unreadable = F.get_json_object("body", "$").isNull()
    error = F.when(refused, F.concat(F.lit("pseudo-200 error ("), F.left("body", F.lit(100)), F.lit(")"))) \
        .when(unreadable, "unreadable body")
    return dumps.withColumn("error", error) \
        .withColumn("elements", F.when(error.isNull(), F.from_json("body", DUMP)["elements"])).drop("body")


def elements(checked: DataFrame, *keep: str) -> DataFrame:
    """One row per element of the good dumps, with its position in the dump."""
    return checked.filter("error IS NULL").select(*keep, F.posexplode("elements").alias("pos", "_e")) \
        .select(*keep, F.col("pos").cast("long").alias("pos"), "_e.*")


def layer_status(checked: DataFrame, layer: str = "layer") -> DataFrame:
    """Per layer: did any dump load, how many elements came, and one failure message."""
    return checked.groupBy(layer).agg(
        F.bool_or(F.col("error").isNull()).alias("ok"),
        F.coalesce(F.sum(F.size(F.coalesce("elements", F.array()))), F.lit(0)).cast("long").alias("rows"),
        F.min("error").alias("error"))


# ---------------------------------------------------------------- selection

def _outline(e_lat="lat", e_lon="lon") -> Column:
    """Geometry as points; a node is its own single point."""
    single = F.array(F.struct(F.col(e_lat).alias("lat"), F.col(e_lon).alias("lon")))
    return F.coalesce("geometry", F.when(F.col(e_lat).isNotNull(), single))


def _touches_box(pad: float) -> Column:
    """Any vertex within the padded box columns south, west, north, east."""
    return F.exists(_outline(), lambda p: geo.in_bbox(
        p["lat"], p["lon"], F.col("south") - pad, F.col("west") - pad, F.col("north") + pad, F.col("east") + pad))


def _has_any(*keys: str) -> Column:
    """Some non-empty tag among the keys."""
    return F.exists(F.map_entries("tags"), lambda e: e["key"].isin(*keys) & (e["value"] != ""))


def _has_match(patterns: dict[str, str]) -> Column:
    """Some tag whose value contains its key's pattern (one pass over the entries)."""
    def test(e):
        out = F.lit(False)
        for key, pattern in patterns.items():
            out = out | ((e["key"] == key) & e["value"].rlike(pattern))
        return out

    return F.exists(F.map_entries("tags"), test)


def _select(elements: DataFrame, boxes: DataFrame, picked: Column, pad: float) -> DataFrame:
    return elements.filter(F.coalesce(picked, F.lit(False))).join(boxes, "hlb_id").filter(_touches_box(pad)) \
        .drop("south", "west", "north", "east")


def road_elements(elements: DataFrame, boxes: DataFrame, pad: float = 0.003) -> DataFrame:
    """Ways that are roads or paths near each area's box."""
    way = (F.col("type") == "way") & (_has_any("highway", "path", "track") | _has_match({"footway": "^crossing$"}))
    return _select(elements, boxes, way, pad)


def feature_elements(elements: DataFrame, boxes: DataFrame, pad: float = 0.002) -> DataFrame:
    """Mapped features near each area's box; tag alternatives are unanchored patterns."""
    way = _has_any("building", "highway", "historic") | _has_match(domain.WAY_TAGS) \
        | (_has_any("name") & _has_any("amenity", "leisure", "tourism", "shop"))
    node = _has_any("place", "historic", "name") | _has_match(domain.NODE_TAGS)
    t = F.col("type")
    return _select(elements, boxes, ((t == "way") & way) | ((t == "node") & node), pad)


def elements_in_ring(elements: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Roads, water and named nodes inside or touching each area's boundary."""
    t = F.col("type")
    way = _has_any("highway", "waterway") | _has_match({"natural": "^(water|coastline)$", "landuse": "^reservoir$"})
    picked = ((t == "way") & way) | ((t == "relation") & _has_match({"natural": "^water$"})) \
        | ((t == "node") & _has_any("name"))
    edged = boundaries.select("hlb_id", geo.ring_edges(F.col("ring")).alias("_edges"))
    line = F.transform(_outline(), lambda p: geo.point(p["lat"], p["lon"]))
    return elements.filter(F.coalesce(picked, F.lit(False))).join(edged, "hlb_id") \
        .filter(geo.line_touches_ring(line, F.col("_edges"))).drop("_edges")


def first_of_each(elements: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Drop repeats by key, the first by ``order`` wins; a map-side combined aggregate."""
    rest = [c for c in elements.columns if c not in keys]
    return elements.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def distinct_roads(roads: DataFrame, strict: bool = True) -> DataFrame:
    """One row per road: by source id, or (compatibility) by the first vertex's latitude only."""
    if strict:
        return first_of_each(roads, ["hlb_id", "osm_id"])
    return first_of_each(roads.withColumn("_lat0", F.element_at("coords", 1)["lat"]), ["hlb_id", "_lat0"]).drop("_lat0")


def distinct_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Label boxes seen at several thresholds, one per 10-pixel grid cell."""
    cell = {"_bx": F.floor(F.col("x") / 10), "_by": F.floor(F.col("y") / 10)}
    return first_of_each(boxes.withColumns(cell), [*keys, "_bx", "_by"], "threshold").drop("_bx", "_by")


# ---------------------------------------------------------------- GeoJSON

def lnglat(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p["lng"], p["lat"]))


def closed(line: Column) -> Column:
    return F.when(F.element_at(line, 1) == F.element_at(line, -1), line) \
        .otherwise(F.concat(line, F.slice(line, F.lit(1), F.lit(1))))


def polygon_feature(ring: Column, properties: Column) -> Column:
    """GeoJSON polygon text, lon/lat order, ring closed."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(lnglat(closed(ring))).alias("coordinates")).alias("geometry")))


def line_feature(line: Column, properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("LineString").alias("type"), lnglat(line).alias("coordinates")).alias("geometry")))


def element_features(elements: DataFrame, compat_close: bool = False) -> DataFrame:
    """GeoJSON geometry type and kind of each element; unnamed nodes are dropped."""
    has = lambda k: F.coalesce(F.map_contains_key("tags", k), F.lit(False))
    value = lambda k: F.try_element_at("tags", F.lit(k))
    g = F.col("geometry")
    is_closed = (F.size(g) > 2) & (F.element_at(g, 1) == F.element_at(g, -1))
    linear = has("highway") | has("waterway")
    wet = F.coalesce(value("natural").isin("water", "coastline") | (value("landuse") == "reservoir"), F.lit(False)) \
        | F.coalesce(value("landuse") == "reservoir", F.lit(False))
    node = F.col("type") == "node"
    kind = F.when(node, F.lit(None)).when(has("waterway"), "waterway").when(linear, "road") \
        .when(wet, "water_body").otherwise("other")
    shape = F.when(node, "Point").when(linear | ~is_closed, "LineString").otherwise("Polygon")
    keep = F.when(node, has("name")).otherwise(F.size(F.coalesce(g, F.array())) > 0)
    return elements.filter(keep).withColumns({"kind": kind, "geometry_type": shape})


def write_collection(features: DataFrame, path: str, key: str = "hlb_id") -> None:
    """One line-delimited GeoJSON feature per row, foldered by area; no area is gathered in one task."""
    features.select(key, "feature").write.mode("overwrite").partitionBy(key).text(path)
