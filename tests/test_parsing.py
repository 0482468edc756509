import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticemill.functions import display
from noticemill.functions.parsing import (
    coerce_category,
    first_filled,
    infer_status,
    normalize_vendor_name,
    parse_currency,
    parse_date,
)


def apply(spark, make, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_vendor_names(spark):
    cases = {
        "Acme Corp.": "acme",
        "Big Data LLC": "big data",
        None: None,
        "": None,
        "Acme, Inc.": "acme,",
        "The  Company Group": "the",
        "Inc.": None,
        "Incline  Works Co": "incline works",
        "COMPANY Holdings plc": None,
    }
    assert apply(spark, normalize_vendor_name, list(cases)) == list(cases.values())


def test_dates(spark):
    day = dt.datetime(2024, 3, 15)
    cases = {
        "2024-03-15": day,
        "03/15/2024": day,
        "03-15-2024": day,
        "March 15, 2024": day,
        "mar 15, 2024": day,
        "  March   15, 2024 ": day,
        "2024-3-5": dt.datetime(2024, 3, 5),
        "May 5, 2024": dt.datetime(2024, 5, 5),
        "2024-03-15T10:20:30": dt.datetime(2024, 3, 15, 10, 20, 30),
        "2024-03-15T10:20:30Z": dt.datetime(2024, 3, 15, 10, 20, 30),
        "2024-03-15T10:20:30.5": None,
        "2024-02-30": None,
        "12024-02-03": None,
        "2024-003-15": None,
        "03/15/24": None,
        "not a date": None,
        "Foo 5, 2024": None,
        "2024-03-1503/15/2024": None,
        "": None,
        None: None,
    }
    text = lambda v: F.date_format(parse_date(v), "yyyy-MM-dd HH:mm:ss")
    wanted = [None if d is None else d.strftime("%Y-%m-%d %H:%M:%S") for d in cases.values()]
    assert apply(spark, text, list(cases)) == wanted


def test_amounts(spark):
    cases = {
        "$1,234.56": 1234.56, "TBD": None, None: None, "": None, "(500)": 500.0, "1.5M": 1.5,
        "$1,000-$2,000": None, "-7": -7.0, "1.": 1.0, ".5": 0.5, ".": None, "1.2.3": None,
    }
    assert apply(spark, parse_currency, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    ("extracted", "wanted"),
    [
        ({"status": "Active"}, "open"),
        ({"note": "This opportunity is closed"}, "closed"),
        ({"status": "Awarded"}, "awarded"),
        ({"title": "Something"}, "unknown"),
        ({"status": "Canceled"}, "cancelled"),
        ({"status": "inactive"}, "open"),
        ({"note": "disclosed"}, "closed"),
        ({"a": "past", "b": "due"}, "closed"),
        ({"a": "past", "b": None, "c": "due"}, "unknown"),
        ({}, "unknown"),
    ],
)
def test_status(spark, extracted, wanted):
    assert apply(spark, infer_status, [extracted], "map<string,string>") == [wanted]


def test_status_by_whole_words(spark):
    strict = lambda v: infer_status(v, word_boundary=True)
    values = [{"s": "inactive"}, {"s": "disclosed"}, {"s": "Active"}, {"s": "awarded"}]
    assert apply(spark, strict, values, "map<string,string>") == [
        "unknown", "unknown", "open", "awarded",
    ]


def test_first_filled_keeps_blanks(spark):
    pick = lambda v: first_filled(v, F.lit("next"))
    assert apply(spark, pick, ["", None, " ", "x"]) == ["next", "next", " ", "x"]


def test_category(spark):
    assert apply(spark, coerce_category, ["supplies", "strange", None]) == [
        "supplies", "other", "other",
    ]


def test_display(spark):
    assert apply(spark, display.money, [1234.5, 0.0, None, 1000000.0, 2.12345], "double") == [
        "$1,234.5", "—", "—", "$1,000,000", "$2.123",
    ]
    day = lambda v: display.short_date(v.cast("timestamp"))
    assert apply(spark, day, ["2024-03-05", None]) == ["Mar 5, 2024", "—"]
    assert apply(spark, display.grouped, [1234567], "long") == ["1,234,567"]
    assert apply(spark, display.axis_day, ["2024-03-05"]) == ["03-05"]
