"""Times in free text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hydroloom.functions.free_time import parse_free

DAY, MORNING = datetime(2024, 3, 5), datetime(2024, 3, 5, 7, 5)
TEXTS = {
    "2024-03-05": DAY, " 2024/3/5 ": DAY, "20240305": DAY, "2024030507": datetime(2024, 3, 5, 7), "202403050705": MORNING, "20240305070509": datetime(2024, 3, 5, 7, 5, 9),
    "2024-03-05T07:05": MORNING, "2024-03-05t07:05:09.25Z": datetime(2024, 3, 5, 7, 5, 9, 250_000), "2024-03-05T07:05:09.25+02:00": datetime(2024, 3, 5, 5, 5, 9, 250_000), "2024-03-05 01:05 -0600": MORNING,
    "5 March 2024": DAY, "5th of March, 2024 at 7:05 am": MORNING, "Mar 5, 2024": DAY, "MARCH 5TH 2024 07h05": MORNING, "Tue, 05 Mar 2024 07:05:00 GMT": MORNING, "Tuesday 5 Mar 24": DAY, "5-Mar-1999": datetime(1999, 3, 5), "5 mar 70": datetime(1970, 3, 5),
    "03/05/2024": DAY, "13/03/2024": datetime(2024, 3, 13), "03.05.24 12 am": DAY, "3-5-2024 12:30 pm": datetime(2024, 3, 5, 12, 30), "March 2024": datetime(2024, 3, 1), "2024 Mar": datetime(2024, 3, 1), "2024-03": datetime(2024, 3, 1),
    "forecast run of 2024-03-05 at 7 am, second try": datetime(2024, 3, 5, 7), "1709622300": MORNING, "maybe 5 may 2024": datetime(2024, 5, 5), "sept 5, 2024": datetime(2024, 9, 5), "2024-02-29": datetime(2024, 2, 29),
    "": None, "no time": None, "12:30": None, "2024-13-05": None, "2023-02-30": None, "2024-03-05 25:00": None, "marching 5 2024 days": None, "5": None, "12345678901234567890": None, None: None,
}


def test_free_texts(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "said string")
    got = {r["said"]: r["time"] for r in frame.select("said", parse_free(F.col("said")).alias("time")).collect()}
    assert got == TEXTS


def test_day_first_and_long_texts(spark):
    frame = spark.createDataFrame([("05/03/2024",), ("03/13/2024",), ("x " * 20_000 + "2024-03-05 07:05" + " y" * 20_000,)], "said string")
    assert [r[0] for r in frame.select(parse_free(F.col("said"), day_first=True)).collect()] == [DAY, datetime(2024, 3, 13), MORNING]
