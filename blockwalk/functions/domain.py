"""Survey vocabulary: symbol sets, element classifiers, labels and small parsers.

All functions take and return columns.  ``tags`` is a MAP<STRING, STRING>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol types and the three predicates built on them.
HOUSE_TYPES = ["pucca_house", "kutcha_house", "apartment", "non_residential"]
NOT_NUMBERED = ["well", "pond", "farmland"]
COUNTED_HOUSES = ["pucca_house", "kutcha_house"]
PAKKA_ROADS = ["motorway", "trunk", "primary", "secondary"]
BLOCK_CAPACITY = 180

# Tag alternatives of the saved feature dumps (unanchored patterns).
WAY_TAGS = {
    "landuse": "farmland|agriculture|forest|meadow|orchard|vineyard|plant_nursery|greenhouse_horticulture",
    "natural": "water|wood|wetland|scrub|heath|grassland|bay|beach|shingle",
    "waterway": "river|stream|canal|drain|ditch",
    "leisure": "park|garden|playground|pitch|swimming_pool",
    "amenity": "school|hospital|clinic|place_of_worship|post_office|pharmacy|police|fire_station"
               "|community_centre|marketplace|bus_station|parking|fuel|bank",
    "tourism": "hotel|guest_house|hostel|museum|attraction|viewpoint|information",
    "shop": "supermarket|mall",
}
NODE_TAGS = {
    "amenity": "school|hospital|clinic|place_of_worship|post_office|water_well|pharmacy|bank|police|atm"
               "|bus_station|fuel|parking|marketplace|community_centre",
    "natural": "spring|water|tree|cave_entrance|peak",
    "man_made": "water_well|water_tower|tower|monitoring_station|pumping_station",
    "tourism": "hotel|guest_house|museum|attraction|viewpoint|information",
    "shop": "supermarket|convenience|general|bakery|butcher|clothes",
}
# Languages tried, in order, when an element has no plain name.
NAME_LANGUAGES = ["en", "hi", "ml", "ta", "te", "kn", "mr", "gu", "pa", "bn", "or", "ur"]
FARM_LANDUSE = ["farmland", "agriculture", "orchard", "vineyard", "plant_nursery",
                "greenhouse_horticulture", "meadow"]


def tag(tags: Column, key: str) -> Column:
    """A tag's value; an empty string counts as absent."""
    return F.nullif(F.try_element_at(tags, F.lit(key)), F.lit(""))


def is_house(symbol_type: Column) -> Column:
    return symbol_type.isin(HOUSE_TYPES)


def is_numberable(symbol_type: Column) -> Column:
    return ~symbol_type.isin(NOT_NUMBERED)


def unit_count(symbol_type: Column, units: Column) -> Column:
    return F.when((symbol_type == "apartment") & (units > 1), units).otherwise(F.lit(1))


def building_shape(symbol_type: Column, wall: Column, roof: Column) -> Column:
    return F.when(symbol_type == "kutcha_house", "triangle") \
            .when(symbol_type.isin("pucca_house", "apartment"), "square") \
            .when(wall.isin(1, 2, 3, 4, 5) & roof.isin(1, 2), "triangle").otherwise("square")


def is_non_residential(is_residential: Column, legacy_use: Column, use: Column, symbol_type: Column) -> Column:
    return F.when(is_residential.isNotNull(), ~is_residential) \
            .when(legacy_use.isNotNull(), ~legacy_use.isin(1, 2)) \
            .when(use.isNotNull(), ~use.isin(1, 2)) \
            .otherwise(symbol_type == "non_residential")


# ------------------------------------------------------------- classifiers

def classify_building(tags: Column) -> Column:
    """Symbol type of a mapped building or amenity."""
    amenity, building = tag(tags, "amenity"), tag(tags, "building")
    religion, material = F.lower(tag(tags, "religion")), F.lower(building)
    worship = (amenity == "place_of_worship") | (building == "religious")
    return (F.when((amenity == "school") | (building == "school"), "school")
            .when(amenity.isin("hospital", "clinic") | (building == "hospital"), "hospital")
            .when(amenity == "post_office", "post_office")
            .when(amenity == "police", "police_station")
            .when(worship & religion.isin("muslim", "islam"), "mosque")
            .when(worship & (religion == "christian"), "church")
            .when(worship, "temple")
            .when(material.isin("hut", "grass", "thatch", "bamboo", "wood"), "kutcha_house")
            .when(material.isin("commercial", "industrial", "retail", "office", "warehouse", "shop"),
                  "non_residential")
            .when(tag(tags, "shop").isNotNull() | tag(tags, "office").isNotNull(), "non_residential")
            .otherwise("pucca_house"))


def classify_footprint(tags: Column) -> Column:
    """Coarser type used by the footprint feed: every place of worship is a temple."""
    amenity, building = tag(tags, "amenity"), tag(tags, "building")
    return (F.when(building == "school", "school")
            .when(building.isin("temple", "place_of_worship") | (amenity == "place_of_worship"), "temple")
            .when((building == "hospital") | (amenity == "hospital"), "hospital")
            .when(building.isin("commercial", "retail"), "commercial")
            .otherwise("pucca_house"))


def footprint_symbol(building_type: Column) -> Column:
    """``commercial`` is outside the symbol types; it is drawn as non-residential."""
    return F.when(building_type == "commercial", "non_residential").otherwise(building_type)


# Road classes with the width, line, colour and label they are drawn with; any other class gets the last.
ROAD_STYLES = [
    (("motorway", "trunk", "primary"), 3.0, "solid", "#000000", "Main Road"),
    (("secondary", "tertiary", "unclassified"), 2.0, "solid", "#333333", "Road"),
    (("residential", "service", "road"), 1.5, "solid", "#555555", "Lane"),
    (("footway", "path", "pedestrian"), 1.0, "dashed", "#777777", "Footpath"),
    (("track",), 1.0, "dotted", "#888888", "Kachcha Raasta"),
    (("steps",), 0.8, "dotted", "#999999", "Steps"),
    ((), 1.0, "dashed", "#aaaaaa", "Path"),
]
# Classes of the printed map's double lines; paved main roads are PAKKA_ROADS.
STREETS = ["residential", "unclassified", "tertiary", "service", "living_street"]
TRACKS = ["footway", "path", "track", "pedestrian", "steps"]


def classify_road(highway: Column) -> Column:
    """Drawing width, style, colour and label of a road class."""
    names = ("width", "style", "color", "label")
    style = lambda row: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row[1:])])
    *listed, other = ROAD_STYLES
    out = F.when(F.lit(False), style(other))
    for row in listed:
        out = out.when(highway.isin(*row[0]), style(row))
    return out.otherwise(style(other))


def render_class(highway: Column) -> Column:
    """pk for paved roads, rs for streets, kt for tracks and paths, else null; the first that holds."""
    return F.when(is_pakka_road(highway), "pk").when(highway.isin(STREETS), "rs").when(highway.isin(TRACKS), "kt")


def is_pakka_road(highway: Column) -> Column:
    return F.coalesce(highway.isin(PAKKA_ROADS), F.lit(False))


def place_symbol(types: Column) -> Column:
    """Symbol of a listed place from its list of place types."""
    has = lambda t: F.coalesce(F.array_contains(types, t), F.lit(False))
    return (F.when(has("school"), "school").when(has("hospital"), "hospital")
            .when(has("hindu_temple"), "temple").when(has("mosque"), "mosque")
            .when(has("church"), "church").when(has("post_office"), "post_office")
            .when(has("police"), "police_station").otherwise("point_of_interest"))


def movement_class(speed: Column, accuracy: Column) -> Column:
    """How a fix was made; a missing speed was stored as 0 at capture."""
    speed = F.coalesce(speed, F.lit(0.0))
    return (F.when(speed > 8.3, "vehicle").when(speed > 4.2, "bicycle").when(speed > 2.0, "fast_walk")
            .when(accuracy > 20, "poor_gps").otherwise("walking"))


def accuracy_label(accuracy: Column) -> Column:
    return F.when(accuracy > 50, "poor").when(accuracy > 30, "reduced").otherwise("good")


# ------------------------------------------------------------------ labels

def element_name(tags: Column) -> Column:
    """Plain name, then the listed languages, then the first other ``name:*`` by key."""
    other = F.map_filter(tags, lambda k, v: k.startswith("name:") & (v != ""))
    first_key = F.array_min(F.map_keys(other))
    return F.coalesce(tag(tags, "name"), *[tag(tags, f"name:{lang}") for lang in NAME_LANGUAGES],
                      F.try_element_at(other, first_key))


def excel_label(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 702 -> AAA ...: as many letters as a 64-bit index needs."""
    start = F.struct(index.cast("bigint").alias("rest"), F.lit("").alias("text"))

    def add(so_far: Column, _: Column) -> Column:
        rest = so_far["rest"]
        letter = F.chr(F.lit(65) + F.pmod(rest, F.lit(26)))
        longer = F.struct((F.floor(rest / 26) - 1).cast("bigint").alias("rest"), F.concat(letter, so_far["text"]).alias("text"))
        return F.when(rest >= 0, longer).otherwise(so_far)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, add, lambda so_far: so_far["text"])


def house_label(number: Column, units: Column, sub_number: Column, u_loop: bool) -> Column:
    """Map label: n/sub, n(k) on the U-loop, n-(n+k-1) otherwise, or plain n."""
    n = number.cast("string")
    many = F.concat(n, F.lit("("), units.cast("string"), F.lit(")")) if u_loop \
        else F.concat(n, F.lit("-"), (number + units - 1).cast("string"))
    return F.when(number.isNull(), "") \
            .when(F.nullif(sub_number, F.lit("")).isNotNull(), F.concat(n, F.lit("/"), sub_number)) \
            .when(units > 1, many).otherwise(n)


def strip_label(text: Column) -> Column:
    """Remove pictographs, collapse blanks, trim."""
    bare = F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def district_of(address: Column) -> Column:
    parts = ["county", "city", "district", "town", "suburb", "village"]
    return F.coalesce(*[tag(address, p) for p in parts], F.lit(""))


def state_of(address: Column) -> Column:
    return F.coalesce(tag(address, "state"), F.lit(""))


def same_code(text: Column, target: Column) -> Column:
    """A scanned label equals a block code once the letter O is read as zero."""
    return F.translate(text, "Oo", "00") == F.translate(target, "Oo", "00")


def contains_code(text: Column, target: Column) -> Column:
    """A scanned word holds a block code, leading zeros ignored on both sides."""
    bare = lambda c: F.regexp_replace(F.trim(c), r"^0+", "")
    return bare(text).contains(bare(target))


def storeys(tags: Column) -> Column:
    """Leading integer of building:levels; absent counts as 1, unreadable is null."""
    raw = F.coalesce(tag(tags, "building:levels"), F.lit("1"))
    return F.nullif(F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def apartment_units(levels: Column) -> Column:
    return F.greatest(F.lit(2), F.least(levels, F.lit(20)))


# ------------------------------------------------------------------ parsers

# Address prefixes of private and loopback networks.
PRIVATE_PREFIXES = ["127.", "10.", "192.168."]


def client_ip(forwarded: Column) -> Column:
    return F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))


def is_private_ip(ip: Column) -> Column:
    test = ip.isNull() | (ip == "") | (ip == "::1")
    for prefix in PRIVATE_PREFIXES:
        test = test | ip.startswith(prefix)
    return test


def phone_last10(raw: Column, default: str) -> Column:
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(F.lit(default))


def order_route(order_id: Column) -> Column:
    """Which ledger an order id belongs to."""
    return (F.when(order_id.startswith("don_"), "donation").when(order_id.startswith("live_"), "live_session")
            .when(order_id.startswith("lrg_"), "live_regen").otherwise("map"))


def paise(rupees: Column) -> Column:
    return F.round(rupees * 100).cast("long")


def js_round(x: Column) -> Column:
    """Round half towards +infinity."""
    return F.floor(x + 0.5)
