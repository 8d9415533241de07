"""Column functions on the inputs that their rules are about."""

import datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import classify, dates, rules, text


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (text.clean, {" a b\r": "a b", "-": None, "": None, " \t": None, "\xa0x﻿": "x", " - ": None, None: None}),
        (text.number, {"12.5kg": 12.5, "A0001": None, "-": None, " 7790 ": 7790.0, "1e3x": 1000.0, "1e": 1.0, ".5": 0.5, "5.": 5.0, "Infinity": None, "-3": -3.0, None: None}),
        (text.catalog_number, {"1": 1, "0": None, "A0001": None, "12x": 12, " 5\r": 5, "": None}),
        (text.orbit_class, {"LLEO/I": "LEO", "VLEO": "LEO", "eeo": "LEO", "GTO": "GTO", "GEO/S": "GEO", "MEO": "MEO", "HEO/M": "HEO", "Tundra": "HEO", "SSO": "SSO", "DSO": "Deep Space", "LLO": "Deep Space", "CLO": "CLO", "-": None, "": None}),
        (text.object_class, {"R2": "R", "p": "P", "-": "-", "": None, None: None}),
        (text.vehicle_family, {"Falcon 9 v1.2": "Falcon 9", "Falcon 9 Block 5B": "Falcon 9", "Ariane 5 ECA": "Ariane 5", "Soyuz-2.1b": "Soyuz-2.1b", "Long March 2D": "Long March 2D", "Atlas Blk 2 Block 3": "Atlas Block 3", " v1": " v1", None: None}),
        (text.is_orbital, {"OS": True, " dx": True, "SX": False, "": False, None: False}),
        (dates.iso_date, {"1957 Oct  4": "1957-10-04", "2025 Jan 14 0127": "2025-01-14", "1998 feb 10": None, "1998 Xyz 1": None, "1998": None, "-": None, "1998 Feb 99": "1998-02-99", None: None}),
        (dates.year_text, {"1957-10-04": "1957", "x": None, None: None}),
        (dates.month_number, {"1957-10-04": 10, "1957-13-04": None, "1957": None, "1957-xx": None}),
        (dates.day_number, {"1957-01-01": 0, "1957-01-31": 30, "1998-02-31": (datetime.date(1998, 3, 3) - datetime.date(1957, 1, 1)).days, "1998-02-99": None, "1998-02-00": None, None: None}),
        (dates.decay_day_number, {"2001 Feb 31": (datetime.date(2001, 3, 3) - datetime.date(1957, 1, 1)).days, "1998 Mar": (datetime.date(1998, 1, 1) - datetime.date(1957, 1, 1)).days, "1957 Dec  1 1000?": 334, "1960 Xyz 2": (datetime.date(1960, 1, 2) - datetime.date(1957, 1, 1)).days, "x": None}),
        (classify.class_label, {"P": "Payload", "Z": "Other", "-": "-", None: "-", "Q": "Q"}),
        (classify.state_label, {"OX": "Operational (Extended)", "NEA": "No Longer Exists", "?": "?", None: "---"}),
        (classify.explorer_label, {"P": "PAYLOAD", "U": "UNKNOWN", "Q": "Q", "": "N/A", None: "N/A"}),
        (classify.site_bucket, {"cc": "cape", "KSC39A": "cape", "VSFBS4E": "vandenberg", "VAFB": "vandenberg", "CCX": "other", None: "other"}),
    ],
)
def test_column_function(spark, function, pairs):
    assert dict(zip(pairs, values(spark, list(pairs), function), strict=True)) == pairs


def test_half_up(spark):
    got = [r.y for r in spark.createDataFrame([(-2.5,), (2.5,), (2.4,), (-0.4,)], "x double").select(text.half_up(F.col("x")).alias("y")).collect()]
    assert got == [-2, 3, 2, 0]


def test_provider_rules_apply_in_order(spark):
    pairs = {"Falcon 9": "SpaceX", "Zhuque-3": "LandSpace", "Chang Zheng 2D": "CASC", "CZ-5": "CASC", "Lijian-1 (CZ-x)": "CAS Space", "Kairos": "Space One", "Nova": "Stoke Space", " ": "Unknown", "Minotaur": "Other"}
    assert dict(zip(pairs, values(spark, list(pairs), lambda c: classify.provider(c, F.lit(None).cast("string"))), strict=True)) == pairs
    assert len(rules.PROVIDERS) == 18


def test_customer_segment(spark):
    rows = spark.createDataFrame([("Starlink-1", "US", "SPX"), ("x", "US", "NASA"), ("x", "F", "NASA"), (None, None, None)], "n string, s string, o string")
    assert [r[0] for r in rows.select(classify.customer_segment(F.col("n"), F.col("s"), F.col("o"))).collect()] == ["starlink", "usGov", "commercial", "commercial"]


def test_orbit_shape(spark):
    row = spark.createDataFrame([(None, None, None)], "a double, p double, i double").select(*[c.alias(k) for k, c in classify.orbit_shape(F.col("a"), F.col("p"), F.col("i")).items()]).first()
    assert (row.semi_major_km, row.offset_km, row.inclination_class) == (6771.0, 100.0, "EQUATORIAL")
