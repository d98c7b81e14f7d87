"""Locations out of text: survey messages and georeferenced PDF headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk.functions import geo

# The three coordinate forms in their order of precedence, and the block code.
COORDINATES = [r"[?&]q=(-?\d+\.?\d*),(-?\d+\.?\d*)", r"@(-?\d+\.?\d*),(-?\d+\.?\d*)",
               r"(-?\d{2}\.\d{3,}),\s*(-?\d{2,3}\.\d{3,})"]
PAIR = r"(-?\d+\.?\d*),\s*(-?\d+\.?\d*)$"
BLOCK_CODE = r"(?i)HLB\s*(\d{4})"
_NUMBER = r"(-?\d+\.?\d*)"
BBOX = rf"/BBox\s*\[\s*{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s*\]"
GPTS = r"/GPTS\s*\[\s*([^\]]+)\s*\]"
LPTS = r"/LPTS\s*\[\s*([^\]]+)\s*\]"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def scan_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Block code and coordinates of each message that has any.

    Coordinates without a code get code 0000; a code without coordinates gets
    (0, 0), which is not usable as a position.
    """
    t = F.col(text)
    # one pass per pattern over the text; the pair is then read off the short match
    found = F.coalesce(*[_group(t, p, 0) for p in COORDINATES])
    number = lambda m, g: F.regexp_extract(m, PAIR, g).cast("double")

    def read(w):
        return F.when(w["at"].isNotNull() | w["hlb"].isNotNull(), F.struct(
            F.coalesce(w["hlb"], F.lit("0000")).alias("hlb"),
            F.coalesce(F.when(w["at"].isNotNull(), number(w["at"], 1)), F.lit(0.0)).alias("lat"),
            F.coalesce(F.when(w["at"].isNotNull(), number(w["at"], 2)), F.lit(0.0)).alias("lng")))

    parsed = geo.let(F.struct(found.alias("at"), _group(t, BLOCK_CODE, 1).alias("hlb")), read)
    keep = [c for c in messages.columns if c != text]
    # exploding the one-element array drops messages without a match and keeps the scan in one operator
    return messages.select(*keep, F.explode(F.array_compact(F.array(parsed))).alias("_m")) \
        .select(*keep, "_m.*", (F.col("_m.lat") != 0).alias("usable"))


def read_pdf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of binary files, bytes read as Latin-1 so that the header stays searchable."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("text"))


def georeference(files: DataFrame, text: str = "text") -> DataFrame:
    """Viewport box and the longitudes and latitudes at its edges; files without them are dropped.

    Corners pair up as they are listed; each edge value is the mean over the
    corners on that side of the unit square.
    """
    t = F.col(text)
    numbers = lambda pattern: F.transform(
        F.split(F.trim(_group(t, pattern, 1)), r"\s+"), lambda s: s.try_cast("double"))
    out = files.withColumns({"_g": numbers(GPTS), "_l": numbers(LPTS),
                             "_b": F.array(*[_group(t, BBOX, i).cast("double") for i in (1, 2, 3, 4)])})
    good = F.get("_b", F.lit(0)).isNotNull() & (F.size("_g") > 0) & (F.size("_l") > 0) \
        & ~F.exists("_g", lambda v: v.isNull()) & ~F.exists("_l", lambda v: v.isNull())
    corner = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / 2).cast("int")), lambda i: F.struct(
        F.get("_l", i * 2).alias("lx"), F.get("_l", i * 2 + 1).alias("ly"),
        F.get("_g", i * 2).alias("lat"), F.get("_g", i * 2 + 1).alias("lon")))

    def mean(test, field):
        side = F.filter("_c", test)
        return F.aggregate(side, F.lit(0.0), lambda acc, c: acc + c[field]) / F.size(side)

    edges = {"lon_at_x0": mean(lambda c: c["lx"] < 0.5, "lon"), "lon_at_x1": mean(lambda c: c["lx"] >= 0.5, "lon"),
             "lat_at_y0": mean(lambda c: c["ly"] < 0.5, "lat"), "lat_at_y1": mean(lambda c: c["ly"] >= 0.5, "lat")}
    box = {n: F.get("_b", F.lit(i)) for i, n in enumerate(("x0", "y0", "x1", "y1"))}
    return out.filter(F.coalesce(good, F.lit(False))).withColumn("_c", corner).withColumns({**box, **edges}) \
        .drop("_g", "_l", "_b", "_c", text)


def pixels_to_lnglat(pixels: DataFrame, decimals: int | None = None) -> DataFrame:
    """Longitude and latitude of page pixels (col, row, width, height + edge columns)."""
    lng, lat = geo.pixel_to_lnglat("col", "row", "width", "height", "lon_at_x0", "lon_at_x1", "lat_at_y0", "lat_at_y1")
    if decimals is not None:
        lng, lat = F.round(lng, decimals), F.round(lat, decimals)
    return pixels.withColumns({"lng": lng, "lat": lat})


def best_label(spans: DataFrame, key: str, target: Column) -> DataFrame:
    """Shortest text span containing the target, the first listed among equals."""
    hit = spans.filter(F.col("text").contains(target))
    return hit.groupBy(key).agg(F.min_by(F.struct("text", "col", "row"), F.struct(F.length("text"), F.col("pos"))).alias("_r")) \
        .select(key, "_r.*")
