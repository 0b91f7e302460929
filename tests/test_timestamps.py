import datetime

import pytest

from riskloom.functions.timestamps import read_text
from riskloom.operators.timestamps import estimate_zones, with_instants


def us(*parts):
    return int((datetime.datetime(*parts) - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))


@pytest.mark.parametrize(
    "text, order, want",
    [
        ("2020-01-02T03:04:05Z", "ymd", (None, us(2020, 1, 2, 3, 4, 5), 0, None)), (" 2020-01-02t03:04:05z ", "ymd", (None, us(2020, 1, 2, 3, 4, 5), 0, None)), ("2020-01-02 03:04", "ymd", (None, us(2020, 1, 2, 3, 4), None, None)),
        ("2020-01-02", "ymd", (None, us(2020, 1, 2), None, None)), ("02/01/2020 03:04:05", "dmy", (None, us(2020, 1, 2, 3, 4, 5), None, None)), ("02/01/2020 3:04 PM", "mdy", (None, us(2020, 2, 1, 15, 4), None, None)),
        ("2020/01/02 12:31 AM", "dmy", (None, us(2020, 1, 2, 0, 31), None, None)), ("02.01.2020 03:04:05", "mdy", (None, us(2020, 1, 2, 3, 4, 5), None, None)), ("20200102T030405Z", None, (None, us(2020, 1, 2, 3, 4, 5), 0, None)), ("20200102030405", None, (None, us(2020, 1, 2, 3, 4, 5), None, None)),
        ("2020-002T03:04:05Z", None, (None, us(2020, 1, 2, 3, 4, 5), 0, None)), ("2020-W01-4T03:04:05Z", None, (None, us(2020, 1, 2, 3, 4, 5), 0, None)), ("Thu, 02 Jan 2020 03:04:05 -0330", None, (None, us(2020, 1, 2, 3, 4, 5), -210, None)),
        ("Thu Jan  2 03:04:05 CEST 2020", None, (None, us(2020, 1, 2, 3, 4, 5), 120, None)), ("Thu Jan 2 03:04:05 2020 +0100", None, (None, us(2020, 1, 2, 3, 4, 5), 60, None)), ("January 2, 2020 3:04 am", None, (None, us(2020, 1, 2, 3, 4), None, None)),
        ("2020-01-02 16:04:05 America/New_York", None, (None, us(2020, 1, 2, 16, 4, 5), None, "America/New_York")), ("2020-01-02T03:04:05+05:30[Asia/Kolkata]", None, (None, us(2020, 1, 2, 3, 4, 5), 330, None)), ("2020-01-02T03:04:05−04:00", None, (None, us(2020, 1, 2, 3, 4, 5), -240, None)),
        ("2020-01-02 03:04:05 UTC+5:30", None, (None, us(2020, 1, 2, 3, 4, 5), 330, None)), ("2020-01-02 03:04:05 GMT-3", None, (None, us(2020, 1, 2, 3, 4, 5), -180, None)), ("2020-01-02T03:04:05.123456789Z", None, (None, us(2020, 1, 2, 3, 4, 5, 123456), 0, None)), ("2020-01-02 03:04:05,5", None, (None, us(2020, 1, 2, 3, 4, 5, 500000), None, None)),
        ("1577934245", None, (1577934245000000, None, None, None)), ("1577934245.5", None, (1577934245500000, None, None, None)), ("1577934245123", None, (1577934245123000, None, None, None)), ("1577934245123456", None, (1577934245123456, None, None, None)),
    ],
)
def test_read(text, order, want):
    assert read_text(text, order) == want


@pytest.mark.parametrize("text", [None, "", "  ", "n/a", "pending", "last Tuesday", "2023-02-30T10:00:00Z", "0000-00-00T00:00:00Z", "2021-06-31 12:00", "2020-01-02 25:00", "2020-01-02 03:60:00", "2020-01-02 13:00 PM", "2020-01-02T03:04:05 ZZTOP", "2020-W54-1T00:00:00Z", "2021-366T00:00:00Z", "x" * 100_000])
def test_no_timestamp(text):
    assert read_text(text, "ymd") is None


FEEDS = "origin string, tz_name string, day_order string"


def test_instants(spark):
    feeds = spark.createDataFrame([("b", "Europe/Berlin", "dmy"), ("b", "Europe/Berlin", "dmy"), (None, "Asia/Tokyo", "mdy")], FEEDS)
    rows = [
        (1, "b", "2021-03-28 02:30:00", us(2021, 3, 28, 1, 30)),  # skipped: the offset before the change
        (2, "b", "2021-10-31 02:30:00", us(2021, 10, 31, 0, 30)),  # twice: the earlier instant
        (3, None, "01/02/2021 10:00:00", us(2021, 1, 2, 10)), (4, "b", "01/02/2021 10:00:00", us(2021, 2, 1, 9)), (5, "b", "2021-01-01 10:00:00 No/Where", None), (6, "b", None, None), (7, "b", "2021-07-01 00:00:00 America/Bogota", us(2021, 7, 1, 5)),
    ]
    df = spark.createDataFrame([(a, b, c, 9) for a, b, c, _ in rows], "id int, origin string, text string, tz_name int")  # a further column with a clashing name
    got = {r["id"]: r["_ts_utc"] for r in with_instants(df, "text", "origin", None, feeds).collect()}
    assert got == {a: d for a, _, _, d in rows}
    assert with_instants(df.limit(0), "text", "origin", None, feeds).count() == 0
    assert with_instants(df, "text", "origin", None, feeds.limit(0)).count() == len(rows)


def test_zone_is_estimated(spark):
    from pyspark.sql import functions as F

    # an origin nobody declared writes Tokyo time, its rows arrive within the hour
    local = [("x", us(2021, 5, d, 9 + d % 9, 0), us(2021, 5, d, d % 9, 0) + 1_800_000_000) for d in range(1, 28)]
    found = estimate_zones(spark.createDataFrame(local, "_ts_origin string, local_us bigint, ingest_us bigint"), ["Asia/Tokyo", "Europe/Berlin", "UTC", "America/New_York"]).first()
    assert (found["_ts_zone"], found["violations"], found["n"]) == ("Asia/Tokyo", 0, 27)
    feeds = spark.createDataFrame([("b", "Europe/Berlin", "dmy"), ("j", "Asia/Tokyo", "ymd")], FEEDS)
    df = spark.createDataFrame([("x", f"2021-05-{d:02} {9 + d % 9:02}:00:00", us(2021, 5, d, d % 9, 0) + 1_800_000_000) for d in range(1, 28)], "origin string, text string, at bigint")
    bad = with_instants(df, "text", "origin", F.col("at"), feeds).filter("_ts_utc is null or at - _ts_utc <> 1800000000").count()
    assert bad == 0
