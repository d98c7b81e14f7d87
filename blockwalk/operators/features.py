"""Map elements to survey features: one projection decides the branch, arrays carry the rows it emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwalk.functions import domain, geo
from blockwalk.operators.ordered import Ordered

_POINTS = "array<struct<lat:double,lng:double>>"


def _feature(kind, ftype, name, centre, units=None, points=None, counted=False) -> Column:
    text = lambda v: v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(F.lit(kind).alias("kind"), text(ftype).alias("feature_type"), text(name).alias("name"),
                    centre["lat"].alias("lat"), centre["lng"].alias("lng"),
                    (units if units is not None else F.lit(None)).cast("int").alias("units"),
                    (points if points is not None else F.lit(None)).cast(_POINTS).alias("points"),
                    F.lit(counted).alias("counted"))


def placed_elements(elements: DataFrame, boundaries: DataFrame, compat_skip_nodes: bool = False) -> DataFrame:
    """Elements inside (nodes) or touching (ways) their area, with coords and centre.

    Nodes that carry only lat/lon get a one-point geometry; ``compat_skip_nodes``
    leaves them out instead.
    """
    shape = F.col("geometry") if compat_skip_nodes else F.coalesce(
        "geometry", F.when((F.col("type") == "node") & F.col("lat").isNotNull(),
                           F.array(F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")))))
    coords = F.transform(shape, lambda p: geo.point(p["lat"], p["lon"]))
    areas = boundaries.select("hlb_id", geo.ring_edges(F.col("ring")).alias("_edges"), F.size("ring").alias("_n"))
    rows = elements.withColumn("coords", coords).filter(F.size("coords") >= 1) \
        .withColumn("centre", F.when(F.size("coords") >= 3, geo.vertex_mean(F.col("coords")))
                    .otherwise(F.element_at("coords", 1))) \
        .join(areas, "hlb_id", "left")
    meets = F.when(F.col("type") == "node", geo.point_in_edges(F.col("centre.lat"), F.col("centre.lng"), F.col("_edges"))) \
        .otherwise(geo.line_touches_ring(F.col("coords"), F.col("_edges")))
    return rows.filter((F.coalesce(F.col("_n"), F.lit(0)) < 3) | meets).drop("_edges", "_n")


def classify_elements(elements: DataFrame, boundaries: DataFrame, compat_skip_nodes: bool = False) -> DataFrame:
    """Features of every element, one row each: symbol, landmark, farmland, forest, water or landuse.

    The branch order is: building, named place, farmland, forest, water, waterway,
    well, land use; an unnamed sight may follow a land use.
    """
    rows = placed_elements(elements, boundaries, compat_skip_nodes).withColumn("_name", domain.element_name(F.col("tags")))
    t = lambda k: domain.tag(F.col("tags"), k)
    name, at, coords = F.col("_name"), F.col("centre"), F.col("coords")
    area = F.size(coords) >= 3
    outline = geo.thin_outline(coords)
    none = F.lit(None)

    base, levels = domain.classify_building(F.col("tags")), domain.storeys(F.col("tags"))
    tall = F.lower(t("building")).isin("apartments", "flats") | (levels >= 3)
    house = F.when((base == "pucca_house") & F.coalesce(tall, F.lit(False)), "apartment").otherwise(base)
    building = F.array(
        _feature("symbol", house, name, at, units=F.when(house == "apartment", domain.apartment_units(levels)), counted=True),
        F.when(name.isNotNull(), _feature("landmark", house, name, at)))
    place_type = F.coalesce(*[t(k) for k in ("amenity", "shop", "tourism", "office", "leisure", "place", "historic")],
                            F.lit("point_of_interest"))
    place = F.array(F.when(t("amenity").isNotNull(), _feature("symbol", base, name, at)),
                    _feature("landmark", place_type, name, at))
    farm = F.array(F.when(area, _feature("farmland", "farmland", none, at, points=outline)))
    forest = F.array(F.when(area, _feature("forest", "forest", F.coalesce(name, F.lit("Forest")), at, points=outline)))
    pond = F.coalesce(name, F.lit("Water Body"))
    water = F.array(F.when(area, _feature("water", "pond", pond, at, points=coords)),
                    F.when(area, _feature("symbol", "pond", pond, at)))
    stream = F.when(t("waterway").isin("river", "canal"), "river").otherwise("stream")
    middle = F.get(coords, F.floor(F.size(coords) / 2).cast("int"))
    waterway = F.array(_feature("water", stream, F.coalesce(name, stream), middle, points=coords))
    well = F.array(_feature("symbol", "well", name, at))
    use, nat = t("landuse"), t("natural")
    land = F.when(use.isin("farmland", "agricultural"), "farmland").when(use == "orchard", "orchard") \
        .when((use == "forest") | (nat == "wood"), "forest").when(nat == "scrub", "scrub") \
        .when(use.isin("meadow", "grass") | (nat == "grassland"), "grass").when(nat == "water", "water") \
        .when(nat == "wetland", "wetland").when(use == "cemetery", "cemetery") \
        .when(t("leisure").isin("park", "garden", "recreation_ground"), "park")
    sight = name.isNull() & F.coalesce(t("tourism").isNotNull() | t("historic").isNotNull()
                                       | (t("shop") == "supermarket") | (t("office") == "government"), F.lit(False))
    rest = F.array(
        F.when(land.isNotNull() & area, _feature("landuse", land, none, at, points=outline)),
        F.when(sight, _feature("landmark", F.coalesce(t("tourism"), t("historic"), t("shop"), t("office")),
                               F.coalesce(t("tourism"), t("historic"), F.lit("Landmark")), at)))

    named_place = name.isNotNull() & t("waterway").isNull() & t("highway").isNull() \
        & (F.coalesce(nat, F.lit("")) != "water")
    is_well = (t("amenity") == "water_well") | (t("man_made") == "water_well") | (nat == "spring")
    emitted = F.when(t("building").isNotNull(), building).when(named_place, place) \
        .when(use.isin(domain.FARM_LANDUSE), farm).when((use == "forest") | (nat == "wood"), forest) \
        .when(nat.isin("water", "wetland", "bay"), water).when(t("waterway").isNotNull(), waterway) \
        .when(F.coalesce(is_well, F.lit(False)), well).otherwise(rest)
    return rows.select("hlb_id", "pos", "id", F.posexplode(F.array_compact(emitted)).alias("part", "_f")) \
        .select("hlb_id", "pos", "id", F.col("part").cast("long").alias("part"), "_f.*")


def farmland_letters(features: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Farmland with its letter A..Z by order of appearance, and its area.

    ``elements`` (the classified table) lets the size check read raw rows.
    """
    farms = Ordered.of(features.filter(F.col("kind") == "farmland"), ["hlb_id"], [F.col("pos"), F.col("id")],
                       count_on=elements) \
        .row_number("_n").rows()
    return farms.withColumn("label", F.chr(F.lit(65) + (F.col("_n") - 1) % 26)) \
        .withColumn("area_m2", geo.ring_area_m2(F.col("points"))).drop("_n")


def area_stats(features: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Counters per area.

    Every symbol counts as a building, ponds and wells too; houses, apartments and
    non-residential count mapped buildings only (``counted``), not named places.
    """
    kind, ftype = F.col("kind"), F.col("feature_type")
    symbol = kind == "symbol"
    built = symbol & F.col("counted")
    counts = features.groupBy("hlb_id").agg(
        F.count_if(symbol).alias("buildings"),
        F.count_if(built & ftype.isin(domain.COUNTED_HOUSES)).alias("houses"),
        F.count_if(built & (ftype == "apartment")).alias("apartments"),
        F.count_if(built & ~ftype.isin(*domain.COUNTED_HOUSES, "apartment")).alias("non_residential"),
        F.count_if(kind == "farmland").alias("farmland_count"),
        F.coalesce(F.sum(F.when(kind == "farmland", geo.ring_area_m2(F.col("points")))), F.lit(0.0)).alias("_farm"),
        F.count_if((kind == "water") & (ftype == "pond")).alias("water_bodies"),
        F.count_if(kind == "forest").alias("forests"), F.count_if(kind == "landmark").alias("landmarks"))
    total = boundaries.select("hlb_id", geo.ring_area_m2(F.col("ring")).alias("_area"))
    homes = F.col("houses") + F.col("apartments")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in counts.columns if c not in ("hlb_id", "_farm")}
    return total.join(counts, "hlb_id", "left").withColumns(zero).select(
        "hlb_id", *zero, domain.js_round(F.coalesce("_farm", F.lit(0.0))).alias("farmland_area"),
        domain.js_round(F.col("_area")).alias("total_area"),
        F.when(F.col("_area") > 0, domain.js_round(homes / (F.col("_area") / 10000))).otherwise(0).alias("density"))


def clip_roads(elements: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Ways that touch the boundary, whole; a way without a road class is ``unclassified``."""
    coords = F.transform("geometry", lambda p: geo.point(p["lat"], p["lon"]))
    areas = boundaries.select("hlb_id", geo.ring_edges(F.col("ring")).alias("_edges"))
    return elements.filter((F.col("type") == "way") & (F.size("geometry") >= 2)).withColumn("coords", coords) \
        .join(areas, "hlb_id").filter(geo.line_touches_ring(F.col("coords"), F.col("_edges"))) \
        .select("hlb_id", "pos", F.col("id").alias("osm_id"), "coords",
                F.coalesce(domain.tag(F.col("tags"), "highway"), F.lit("unclassified")).alias("highway"),
                domain.element_name(F.col("tags")).alias("name"))


def satellite_features(elements: DataFrame, boundaries: DataFrame, near: float = 0.0015) -> DataFrame:
    """Simpler classification of the satellite workspace: road, water, forest, landmark."""
    t = lambda k: domain.tag(F.col("tags"), k)
    name = domain.element_name(F.col("tags"))
    coords = F.transform("geometry", lambda p: geo.point(p["lat"], p["lon"]))
    rows = elements.join(boundaries.select("hlb_id", "ring"), "hlb_id").withColumns({"_name": name, "coords": coords})
    way = (F.col("type") == "way") & (F.size("coords") >= 2)
    first, mean = F.element_at("coords", 1), geo.vertex_mean(F.col("coords"))
    here = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lng"))
    kind = F.when(way & t("highway").isNotNull(), "road").when(way & (t("natural") == "water"), "water") \
        .when(way & ((t("landuse") == "forest") | (t("natural") == "wood")), "forest") \
        .when(way & F.col("_name").isNotNull() & geo.near_ring(first["lat"], first["lng"], F.col("ring"), near), "landmark") \
        .when((F.col("type") == "node") & F.col("_name").isNotNull()
              & geo.near_ring("lat", "lon", F.col("ring"), near), "landmark")
    label = F.when(F.col("kind") == "road", t("highway")).when(F.col("kind") == "water", "pond") \
        .when(F.col("kind") == "forest", "forest") \
        .when(F.col("type") == "way", F.coalesce(t("amenity"), t("building"), t("landuse"), F.lit("POI"))) \
        .otherwise(F.coalesce(t("amenity"), t("shop"), t("tourism"), F.lit("POI")))
    shown = F.coalesce(F.col("_name"), F.when(F.col("kind") == "water", "Water Body")
                       .when(F.col("kind") == "forest", "Forest Area"))
    at = F.when(F.col("type") == "node", here).otherwise(mean)
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "hlb_id", "pos", "id", "kind", label.alias("feature_type"), shown.alias("name"),
        at["lat"].alias("lat"), at["lng"].alias("lng"))


def add_landcover(landuse: DataFrame, farmland: DataFrame, cover: DataFrame, boundaries: DataFrame,
                  share: float = 0.4) -> DataFrame:
    """Where mapped farmland covers under ``share`` of the area, add land-cover polygons.

    A polygon counts when its first vertex lies inside the boundary.
    """
    areas = boundaries.select("hlb_id", geo.ring_area_m2(F.col("ring")).alias("_area"),
                              geo.ring_edges(F.col("ring")).alias("_edges"))
    farm = farmland.groupBy("hlb_id").agg(F.sum("area_m2").alias("_farm"))
    thin = areas.join(farm, "hlb_id", "left") \
        .filter(domain.js_round(F.coalesce("_farm", F.lit(0.0))) < F.col("_area") * share).select("hlb_id", "_edges")
    first = F.element_at("points", 1)
    extra = cover.filter(F.size("points") >= 3).join(thin, "hlb_id") \
        .filter(geo.point_in_edges(first["lat"], first["lng"], F.col("_edges"))) \
        .select("hlb_id", F.col("landuse_type").alias("feature_type"), "points")
    return landuse.select("hlb_id", "feature_type", "points").unionByName(extra)


def road_name(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent usable road name per key; the first seen wins a tie."""
    usable = traces.filter((F.trim("name") != "") & (F.col("name") != "Route"))
    counts = usable.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counts.groupBy(*keys).agg(F.min_by("name", F.struct((-F.col("n")).alias("a"), F.col("first"))).alias("road_name"))
