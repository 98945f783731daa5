"""Lenient dates against the usual parser, over forms, ambiguous numbers and debris."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgrain.functions import text as X

parser = pytest.importorskip("dateutil.parser")

FORMS = [
    "2001-05-01", "20010501", "2001-05-01T19:30:05Z", "2001-05-01T19:30:05.250+02:00", "2001-05-01 19:30", "May 1, 2001", "1 May 2001", "1st of May 2001", "May 1st, 2001 at 7:30 PM", "Tue, 01 May 2001 19:30:05 GMT", "Tue May  1 19:30:05 2001",
    "Tuesday, May 1, 2001 7:30 am", "01-May-2001 00:05", "5/1/2001", "05/13/2001", "13/05/2001", "31/12/99", "1/2/03", "2001/5/1", "01.02.2003", "2003.02.01", "3 Sept 2010 12:00 am", "3 Sept 2010 12:15 pm", "September 3, 2010, 11pm", "Sept. 3 2010 at 3:04:05.678",
    "2014-05-01T10:00:00 yyyy-mm-dd", "12 dec 68", "12 dec 69", "99 Jan 5", "Jan 5 99", "2012-2-29", "10 October 2010 10:10:10 +0530", "10 October 2010 10:10 -03:00", "10 October 2010 10:10 EST", "10:10 10 October 2010", "10 October 2010 10:10 UTC+1",
]
NOT = ["yesterday", "", "May", "2012", "whenever 1 May 2001", "Published: May 1, 2001", "2013-2-29", "32 May 2001", "25:00 1 May 2001", "13:00 pm 1 May 2001", "1 May 2001 2 3", "May 1 June 2 2001", "1/2", "40/40/40", "5.", None]


def test_against_the_usual_parser(spark):
    df = spark.createDataFrame([(x,) for x in FORMS + NOT], "x string")
    got = {r.x: r.t for r in df.select("x", X.parse_date(F.col("x")).alias("t")).collect()}
    wrong = {}
    for x in FORMS:
        if "UTC+1" in x:  # there the sign is read the other way round; here it is the offset
            assert got[x] == dt.datetime(2010, 10, 10, 9, 10)
            continue
        want = parser.parse(x.split("yyyy-")[0], default=dt.datetime(1900, 1, 1))
        if want.tzinfo is not None:
            want = want.astimezone(dt.timezone.utc).replace(tzinfo=None)
        if want.year >= 2068 + 1:
            want = want.replace(year=want.year - 100)
        if got[x] != want:
            wrong[x] = (got[x], want)
    assert wrong == {}
    assert {x: got[x] for x in NOT if got[x] is not None} == {}
