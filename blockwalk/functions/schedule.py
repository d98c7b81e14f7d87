"""The 34-column house-listing schedule: fields, codes, visibility, legacy answers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (column, key, label, kind) of every field.
FIELDS = [
    (1, "col_1_line_no", "Line Number", "number"), (2, "col_2_building_no", "Building Number", "number"),
    (3, "col_3_house_no", "Census House Number", "text"), (4, "col_4_floor", "Floor Material", "select"),
    (5, "col_5_wall", "Wall Material", "select"), (6, "col_6_roof", "Roof Material", "select"),
    (7, "col_7_use", "Use of Census House", "select"), (8, "col_8_condition", "Condition of House", "select"),
    (9, "col_9_household_no", "Household Number", "number"),
    (10, "col_10_persons", "Total Persons in Household", "number"),
    (11, "col_11_head_name", "Name of the Head of Household", "text"), (12, "col_12_sex", "Sex of Head", "select"),
    (13, "col_13_caste", "Caste Category (SC/ST/Other)", "select"),
    (14, "col_14_ownership", "Ownership Status of House", "select"),
    (15, "col_15_rooms", "Dwelling Rooms in Possession", "number"),
    (16, "col_16_couples", "Married Couples in Household", "number"),
    (17, "col_17_water_source", "Main Source of Drinking Water", "select"),
    (18, "col_18_water_location", "Availability of Drinking Water Source", "select"),
    (19, "col_19_lighting", "Main Source of Lighting", "select"), (20, "col_20_latrine", "Access to Latrine", "select"),
    (21, "col_21_latrine_type", "Type of Latrine", "select"),
    (22, "col_22_drainage", "Waste Water Outlet Connected to", "select"),
    (23, "col_23_bathing", "Bathing Facility Within Premises", "select"),
    (24, "col_24_kitchen", "Availability of Kitchen / LPG Connection", "select"),
    (25, "col_25_fuel", "Main Fuel Used for Cooking", "select"), (26, "col_26_radio", "Radio / Transistor", "select"),
    (27, "col_27_tv", "Television", "select"), (28, "col_28_internet", "Internet Facility", "select"),
    (29, "col_29_computer", "Laptop / Computer", "select"), (30, "col_30_phone", "Telephone / Mobile Phone", "select"),
    (31, "col_31_vehicle_2w", "Bicycle / Scooter / Motorcycle", "select"), (32, "col_32_car", "Car / Jeep / Van", "select"),
    (33, "col_33_cereal", "Main Cereal Consumed", "select"), (34, "col_34_mobile", "Mobile Number (for contact)", "text"),
]
KEYS = [key for _, key, _, _ in FIELDS]
TEXT_KEYS = [key for _, key, _, kind in FIELDS if kind == "text"]

# Fixed values: (column, code, label), in the order in which the sheet lists them.
OPTIONS = [
    (4, 1, "Mud"), (4, 2, "Wood/Bamboo"), (4, 3, "Burnt Brick"), (4, 4, "Stone"), (4, 5, "Cement"), (4, 6, "Mosaic/Tiles"),
    (4, 7, "Any Other"),
    (5, 1, "Grass/Thatch/Bamboo"), (5, 2, "Plastic/Polythene"), (5, 3, "Mud/Unburnt Brick"), (5, 4, "Wood"),
    (5, 5, "Stone (No Mortar)"), (5, 6, "Stone (With Mortar)"), (5, 7, "GI/Metal Sheets"), (5, 8, "Burnt Brick"), (5, 9, "Concrete"),
    (5, 0, "Any Other"),
    (6, 1, "Grass/Thatch/Wood"), (6, 2, "Plastic/Polythene"), (6, 3, "Handmade Tiles"), (6, 4, "Machine Made Tiles"),
    (6, 5, "Burnt Brick"), (6, 6, "Stone"), (6, 7, "Slate"), (6, 8, "GI/Metal Sheets"), (6, 9, "Concrete"), (6, 0, "Any Other"),
    (7, 1, "Residence"), (7, 2, "Residence-cum-other"), (7, 3, "Shop/Office"), (7, 4, "School/College"), (7, 5, "Hotel/Lodge"),
    (7, 6, "Hospital/Dispensary"), (7, 7, "Factory/Workshop"), (7, 8, "Place of Worship"), (7, 9, "Other Non-Residential"),
    (7, 0, "Vacant"),
    (8, 1, "Good"), (8, 2, "Livable"), (8, 3, "Dilapidated"),
    (12, 1, "Male"), (12, 2, "Female"), (12, 3, "Transgender"),
    (13, 1, "SC"), (13, 2, "ST"), (13, 3, "Other"),
    (14, 1, "Owned"), (14, 2, "Rented (Own house elsewhere)"), (14, 3, "Rented (No other house)"), (14, 4, "Any Other"),
    (17, 1, "Tap Water (Treated)"), (17, 2, "Tap Water (Untreated)"), (17, 3, "Well"), (17, 4, "Hand Pump"),
    (17, 5, "Tubewell/Borehole"), (17, 6, "Spring"), (17, 7, "River/Canal"), (17, 8, "Tank/Pond/Lake"),
    (17, 9, "Packaged/Bottled Water"), (17, 0, "Other Source"),
    (18, 1, "Within Premises"), (18, 2, "Near Premises"), (18, 3, "Away"),
    (19, 1, "Electricity"), (19, 2, "Kerosene"), (19, 3, "Solar Energy"), (19, 4, "Other Oil"), (19, 5, "Any Other"),
    (19, 6, "No Lighting"),
    (20, 1, "Exclusive for Household"), (20, 2, "Shared with other Household"), (20, 3, "Public Latrine"),
    (20, 4, "No: Open Defecation"),
    (21, 1, "Flush to Sewer"), (21, 2, "Flush to Septic Tank"), (21, 3, "Flush to Twin Pit"), (21, 4, "Flush to Single Pit"),
    (21, 5, "Flush to Other"), (21, 6, "Pit Latrine with Slab"), (21, 7, "Pit Latrine without Slab"), (21, 8, "Service Latrine"),
    (21, 9, "Other Latrine"), (21, 0, "No Latrine / Not Connected"),
    (22, 1, "Closed Drainage"), (22, 2, "Open Drainage"), (22, 3, "No Drainage"),
    (23, 1, "Yes: Bathroom"), (23, 2, "Yes: Enclosure without Roof"), (23, 3, "No"),
    (24, 1, "Kitchen with LPG/PNG"), (24, 2, "Kitchen without LPG/PNG"), (24, 3, "No Separate Kitchen with LPG/PNG"),
    (24, 4, "No Separate Kitchen without LPG/PNG"), (24, 5, "Cooking in Open with LPG/PNG"),
    (24, 6, "Cooking in Open without LPG/PNG"), (24, 7, "No Cooking Done"),
    (25, 1, "Firewood"), (25, 2, "Crop Residue"), (25, 3, "Cowdung Cake"), (25, 4, "Coal/Lignite/Charcoal"), (25, 5, "Kerosene"),
    (25, 6, "LPG/PNG"), (25, 7, "Electricity"), (25, 8, "Bio-gas/Gobar Gas"), (25, 9, "Solar Energy"), (25, 0, "Any Other"),
    (26, 1, "Traditional Radio Set"), (26, 2, "On Mobile/Smartphone"), (26, 3, "On other device"), (26, 4, "No"),
    (27, 1, "DD Free Dish"), (27, 2, "Other DTH/Dish"), (27, 3, "Cable Connection"), (27, 4, "Other"), (27, 5, "No"),
    (28, 1, "On Laptop/Computer"), (28, 2, "On Mobile/Smartphone"), (28, 3, "On other device"), (28, 4, "No"),
    (29, 1, "Yes"), (29, 2, "No"),
    (30, 1, "Landline only"), (30, 2, "Mobile Smartphone only"), (30, 3, "Other basic mobile"), (30, 4, "Both"), (30, 5, "No"),
    (31, 1, "Bicycle"), (31, 2, "Scooter/Motorcycle/Moped"), (31, 3, "Both"), (31, 4, "None"),
    (32, 1, "Yes"), (32, 2, "No"),
    (33, 1, "Rice"), (33, 2, "Wheat"), (33, 3, "Jowar"), (33, 4, "Bajra"), (33, 5, "Maize"), (33, 6, "Any Other"),
]

# Older answer -> current field, applied in this order when the current one is missing.
RENAMED = [
    ("col_6_wall_material", "col_5_wall"), ("col_7_roof_material", "col_6_roof"), ("col_4_use_type", "col_7_use"),
    ("col_10_head_name", "col_11_head_name"), ("head_of_household", "col_11_head_name"),
    ("col_11_total_rooms", "col_15_rooms"), ("col_12_ownership", "col_14_ownership"),
    ("col_18_water_source", "col_17_water_source"), ("col_18a_water_location", "col_18_water_location"),
    ("col_22_bathroom", "col_23_bathing"), ("col_34_mobile_number", "col_34_mobile"),
]
# Older yes/no answer -> (current field, code for yes, code for no), in this order.
YES_NO = [
    ("col_19_electricity", "col_19_lighting", 1, 6), ("asset_radio", "col_26_radio", 1, 4), ("asset_tv", "col_27_tv", 3, 5),
    ("asset_computer_internet", "col_28_internet", 1, 4), ("asset_laptop", "col_29_computer", 1, 2),
    ("asset_mobile", "col_30_phone", 2, 5), ("asset_bicycle", "col_31_vehicle_2w", 1, 4),
    ("asset_scooter_motorcycle", "col_31_vehicle_2w", 2, 4), ("asset_car_jeep_van", "col_32_car", 1, 2),
]


def options() -> list[tuple[int, str, int, str, int]]:
    """(column, key, code, label, position) of every listed code."""
    key = {col: k for col, k, _, _ in FIELDS}
    place: Counter[int] = Counter()
    rows = []
    for col, code, label in OPTIONS:
        rows.append((col, key[col], code, label, place[col]))
        place[col] += 1
    return rows


def options_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(options(), "col int, key string, code int, label string, idx int")


def with_all_fields(df: DataFrame) -> DataFrame:
    """Add the schedule columns a table does not carry, as nulls."""
    missing = {k: F.lit(None).cast("string" if k in TEXT_KEYS else "int") for k in KEYS if k not in df.columns}
    return df.withColumns(missing) if missing else df


# --------------------------------------------------------------- visibility

def _residential() -> Column:
    return F.coalesce(F.col("col_7_use").isin(1, 2), F.lit(False))


def _normal_household() -> Column:
    return F.coalesce(F.col("col_9_household_no") != 999, F.lit(True))


def visible(key: str) -> Column:
    """Is a field shown, given the other answers of its row?"""
    col = KEYS.index(key) + 1
    if col <= 7:
        return F.lit(True)
    if col <= 11:
        return _residential()
    base = _residential() & _normal_household()
    if col == 18:
        return base & F.col("col_17_water_source").isNotNull()
    if col == 21:
        return base & F.coalesce(F.col("col_20_latrine").isin(1, 2), F.lit(False))
    if col == 25:
        return base & F.coalesce(F.col("col_24_kitchen") != 7, F.lit(True))
    return base


def _filled(key: str) -> Column:
    c = F.col(key)
    return c.isNotNull() & (c != "") if key in TEXT_KEYS else c.isNotNull()


def _given(key: str) -> Column:
    """Truthy answer: code 0 and the empty string count as missing."""
    c = F.col(key)
    return F.coalesce(c != ("" if key in TEXT_KEYS else 0), F.lit(False))


def _all(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


# --------------------------------------------------------------- operators

def migrate(df: DataFrame) -> DataFrame:
    """Fill current fields from older answers; the order of the rules decides conflicts."""
    have = set(df.columns)
    df = with_all_fields(df)
    out: dict[str, Column] = {}

    def fill(key: str, value: Column) -> None:
        out[key] = F.coalesce(out.get(key, F.col(key)), value)

    for old, new in RENAMED:
        if old in have:
            fill(new, F.col(old))
    if "col_9_family_count" in have:
        fill("col_9_household_no", F.when(F.col("col_9_family_count").isNotNull(), 1))
        fill("col_10_persons", F.col("col_9_family_count"))
    for old, new, yes, no in YES_NO:
        if old in have:
            fill(new, F.when(F.col(old), yes).when(~F.col(old), no))
    return df.withColumns(out)


def clean(df: DataFrame) -> DataFrame:
    """Clear answers of hidden fields and empty texts; visibility is judged field by field in order.

    Clearing one field can hide a later one, as when a form is edited, so each
    rule sees the answers left by the rules before it.
    """
    df = with_all_fields(df)
    df = df.withColumn("col_3_house_no", F.coalesce(F.nullif("col_3_house_no", F.lit("")),
                                                    F.col("col_2_building_no").cast("string")))
    early = [k for k in KEYS if k not in ("col_18_water_location", "col_21_latrine_type", "col_25_fuel")]
    df = df.withColumns({k: F.when(visible(k), F.col(k)) for k in early})
    df = df.withColumns({k: F.when(visible(k), F.col(k)) for k in KEYS if k not in early})
    return df.withColumns({k: F.nullif(k, F.lit("")) for k in TEXT_KEYS})


def completeness(df: DataFrame) -> DataFrame:
    """Shown and filled field counts, fill percentage, and the two completeness flags."""
    df = with_all_fields(df)
    total, filled = F.lit(0), F.lit(0)
    for key in KEYS:
        total = total + visible(key).cast("int")
        filled = filled + (visible(key) & _filled(key)).cast("int")
    houses = _all(*map(_given, ("col_4_floor", "col_5_wall", "col_6_roof", "col_7_use")))
    living = _all(*map(_given, ("col_17_water_source", "col_19_lighting", "col_20_latrine", "col_24_kitchen")))
    can_save = ~_residential() | (_given("col_11_head_name") & F.coalesce(F.col("col_10_persons") > 0, F.lit(False)))
    return df.withColumns({"visible_fields": total, "filled_fields": filled}).withColumns({
        "form_fill_percentage": F.floor(F.col("filled_fields") / F.col("visible_fields") * 100 + 0.5),
        "schedule1_complete": houses, "schedule_a_complete": ~_residential() | living, "can_save": can_save})


def glossary(spark: SparkSession, translations: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Code sheet: one row per code, the column and its name only on the first of a run.

    ``translations`` (col, code, label_local) adds labels in another language, ``answers`` (col, code, one row per answer) how often each code was given and
    the row's number on the sheet.
    """
    fields = spark.createDataFrame([(c, n) for c, _, n, _ in FIELDS], "col int, name string")
    rows = options_table(spark).join(F.broadcast(fields), "col")  # 34 fields
    extra = []
    if translations is not None:
        rows, extra = rows.join(translations, ["col", "code"], "left"), ["label_local"]
    if answers is not None:
        given = answers.groupBy("col", "code").agg(F.count(F.lit(1)).alias("_given"))
        place = {(col, code): n for n, (col, _, code, _, _) in enumerate(sorted(options(), key=lambda o: (o[0], o[4])), 1)}
        numbered = spark.createDataFrame([(*k, n) for k, n in place.items()], "col int, code int, sheet_row int")
        rows = rows.join(given, ["col", "code"], "left").join(F.broadcast(numbered), ["col", "code"])  # as many rows as codes
        extra += ["sheet_row", F.coalesce("_given", F.lit(0)).alias("answers")]
    first = F.col("idx") == 0
    return rows.orderBy("col", "idx").select(
        F.when(first, F.concat(F.lit("Col "), F.col("col").cast("string"))).otherwise("").alias("column_number"),
        F.when(first, F.col("name")).otherwise("").alias("column_name"), "code", "label", *extra)


def option_labels(df: DataFrame, key: str, spark: SparkSession) -> DataFrame:
    """Label of a coded answer as ``label (code)``; unlisted codes print as they are, nulls as a dash."""
    codes = options_table(spark).filter(F.col("key") == key).select(F.col("code").alias(key), "label")
    shown = F.when(F.col(key).isNull(), "-") \
        .when(F.col("label").isNotNull(), F.concat("label", F.lit(" ("), F.col(key).cast("string"), F.lit(")"))) \
        .otherwise(F.col(key).cast("string"))
    return df.join(F.broadcast(codes), key, "left").withColumn(f"{key}_label", shown).drop("label")  # at most 10 codes
