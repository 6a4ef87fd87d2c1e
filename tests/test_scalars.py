"""Golden values for what the given tables do not contain."""

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import scalars, text


def values(spark, rows, expression, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]




@pytest.mark.parametrize("expression, rows, expected", [
    (lambda x: scalars.numeric(x), ["12", "N/A", None, "1.5", "nan"], [12.0, None, None, 1.5, None]),
    (lambda x: scalars.duration_seconds(x), ["1 day, 2:03:04", "0:00:00", "2 days, 0:00:01", "12:34", "N/A"], [93784.0, 0.0, 172801.0, None, None]),
    (lambda x: scalars.duration_minutes(x), ["1:02:30", "12:30", "1 day, 2:03:04", "x", None], [62.5, 12.5, None, None, None]),
    (lambda x: scalars.iso_duration_seconds(x), ["PT1H2M3S", "PT45S", None, "P1DT1S", "junk"], [3723.0, 45.0, 0.0, 86401.0, None]),
    (lambda x: scalars.age_days(scalars.parse_timestamp(x)),
     ["2024-12-22T12:00:00Z", "2024-12-24T00:00:00Z", "2024-12-24T12:00:00Z", "2024-12-20T00:00:00.5Z", "x"], [1, 0, -1, 3, None]),
    (lambda x: scalars.binary_encode(x), ["true", "false", "N/A", None, "1"], [1, 0, None, None, 1]),
    (lambda x: scalars.binary_encode(x, "hd", "sd"), ["hd", "sd", "N/A"], [1, 0, None]),
    (lambda x: scalars.keyword_slug(x), ["SQL group-by x"], ["SQL_group_by_x"]),
    (lambda x: scalars.label_map(x, {"en": "English"}), ["en", "de", None], ["English", "de", None]),
    (lambda x: text.clean_text(x), ["[Music] a\n b ", "x [a\nb] y", None, "a  b"], ["a b", "x [a b] y", "", "a b"]),
    (lambda x: text.word_count(x), ["a  b c", "", None, "  "], [3, 0, 0, 0]),
    (lambda x: text.truncate_words(x, 2), [" a b c", "a", "", None], ["a b", "a", "", ""]),
    (lambda x: text.tag_count(x), ["a,b", "N/A", None], [2, 1, 0]),
    (lambda x: text.parse_label(x), [" 1\n", "0", "yes", None], [1, 0, None, None]),
    (lambda x: text.not_contains(x, "auto"), ["auto-generated", "creator", None], [False, True, True]),
    (lambda x: text.topics_of(x), ["SQL, SQL join", "data mining,SQL", "other", None],
     [["SQL"], ["SQL", "data mining"], [], []]),
    (lambda x: text.readability_fk(x), ["The cat sat.", "", None], [pytest.approx(0.39 * 3 + 11.8 - 15.59), None, None]),
    (lambda x: text.readability_ari(x), ["The cat sat.", ""], [pytest.approx(4.71 * 10 / 3 + 1.5 - 21.43), None]),
    (lambda x: text.syllable_count(x), ["brr aeon rhythm", "a-b shh"], [3, 2]),
])
def test_text_and_numbers(spark, expression, rows, expected):
    assert values(spark, rows, expression(F.col("x"))) == expected


@pytest.mark.parametrize("seconds", [0, 59, 3600, 86399, 86400, 172801, 1_000_000])
def test_clock_text_reads_back(spark, seconds):
    assert values(spark, [seconds], scalars.duration_seconds(scalars.clock_text(F.col("x"))), "bigint") == [float(seconds)]


def test_rates_and_log(spark):
    df = spark.createDataFrame([(10.0, 0), (10.0, 4), (None, 4)], "c double, d int")
    assert [r[0] for r in df.select(scalars.rate_per_day(F.col("c"), F.col("d"))).collect()] == [None, 2.5, None]
    assert values(spark, [-1.0, -2.0, 0.0], F.log1p(F.col("x")), "double") == [None, None, 0.0]


def test_transcript_type(spark):
    df = spark.createDataFrame([(True, None), (True, "German"), (False, "German")], "g boolean, t string")
    got = [r[0] for r in df.select(text.transcript_type(F.col("g"), F.col("t"))).collect()]
    assert got == ["auto-generated", "auto-generated (Translated from German)", "creator-uploaded (Translated from German)"]


def test_no_python_in_native_expressions(spark):
    df = spark.createDataFrame([("a",)], "x string")
    plan = df.select(text.readability_fk(F.col("x")), text.topics_of(F.col("x")), scalars.duration_seconds(F.col("x")))._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
