import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracelode.functions import levels, logic, numbers as n, text as x, times as tm, values as v


@pytest.fixture
def value(spark):
    def compute(column):
        return spark.range(1).select(column.alias("x")).first().x
    return compute


def test_logic_with_undefined(value):
    undefined = F.lit(None).cast("boolean")
    assert value(logic.op_not(undefined)) is True
    assert value(logic.op_and(F.lit(True), undefined)) is False
    assert value(logic.op_or(F.lit(True), undefined)) is True
    assert value(logic.op_or(F.lit(False), undefined)) is False


def test_arithmetic(value):
    assert value(n.divide(F.lit(1), 0)) is None and value(n.remainder(F.lit(1), 0)) is None
    assert value(n.to_number(F.lit("12.5"))) == 12.5 and value(n.to_number(F.lit("x"))) is None
    assert value(n.add(F.lit(2 ** 63 - 1).cast("bigint"), F.lit(1).cast("bigint"))) is None


@pytest.mark.parametrize("number, places, expected", [(2.5, 0, 3.0), (-2.5, 0, -2.0), (0.125, 2, 0.13), (-0.125, 2, -0.12), (7.0, 1, 7.0)])
def test_midpoints_go_up(value, number, places, expected):
    assert value(n.round_to(F.lit(number), places)) == pytest.approx(expected)


@pytest.mark.parametrize("number", [0.001, 0.5, 1.0, 7.3, 1e6, -42.0])
def test_bucket_error(value, number):
    assert abs(value(n.bucket(F.lit(number), 0.01)) - number) <= abs(number) * 0.0101


def test_bucket_of_zero(value):
    assert value(n.bucket(F.lit(0.0))) == 0.0


def test_magnitude_bands_keep_order(spark):
    numbers = sorted([0.0, -1e-300, 1e-300, -5.5, 5.5, 5.50001, 1e300, -1e300, 3.0, 2.999999999, -3.0, 1024.0, 1023.9])
    rows = spark.createDataFrame([(x,) for x in numbers], "v double").select("v", n.magnitude_band(F.col("v")).alias("b")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)


@pytest.mark.parametrize("text, start, length, expected", [
    ("hello", 1, None, "ello"), ("hello", 0, 2, "he"), ("hello", 3, 99, "lo"), ("hello", 5, None, ""), ("hello", 6, None, None),
    ("hello", -1, None, None), ("hello", 1, -1, None), ("hello", 2, 0, "")])
def test_substring(value, text, start, length, expected):
    assert value(x.substring_of(F.lit(text), start, length)) == expected


@pytest.mark.parametrize("text, pattern, ci, expected", [
    ("abc", "a%", False, True), ("abc", "A%", False, False), ("abc", "A%", True, True), ("abc", "ab?", False, True),
    ("ab", "ab?", False, True), ("abcd", "ab?", False, False), ("50%", "50%%", False, True), ("500", "50%%", False, False),
    ("a?", "a??", False, True), ("ab", "a??", False, False), ("a_c", "a_c", False, True), ("abc", "a_c", False, False),
    ("a\nb", "a%b", False, True), ("a.c", "a.c", False, True), ("a\\b", "a\\%", False, True), ("x(y", "x(?", False, True)])
def test_like(value, text, pattern, ci, expected):
    assert value(x.like_text(F.lit(text), pattern, ci)) is expected


def test_positions(value):
    assert value(x.index_of(F.lit("banana"), "an")) == 1 and value(x.last_index_of(F.lit("banana"), "an")) == 3
    assert value(x.index_of(F.lit("banana"), "AN")) == -1 and value(x.last_index_of(F.lit("banana"), "zz")) == -1
    assert value(x.last_index_of(F.lit("banANa"), "an", ci=True)) == 3


def test_replace(value):
    assert value(x.replace_text(F.lit("a.b.a"), ".", "$1")) == "a$1b$1a"
    assert value(x.replace_text(F.lit("aXa"), "x", "\\$", ci=True)) == "a\\$a"
    assert value(x.replace_text(F.lit("cost 5"), r"(\d)", "$$$1!$0", regex=True)) == "cost $5!5"


def test_regex_is_anchored(value):
    assert value(x.matches_regex(F.lit("abc"), "b")) is False and value(x.matches_regex(F.lit("abc"), "a|abc")) is True


@pytest.mark.parametrize("text, us", [
    ("00:00:01", 1_000_000), ("1.02:03:04.5", 93_784_500_000), ("-00:01:00", -60_000_000), ("12:30", 45_000_000_000),
    ("24:00:00", None), ("x", None), ("1:2", None), ("00:00:00.0000001", 0)])
def test_timespans(value, text, us):
    assert value(tm.parse_timespan(F.lit(text))) == us


@pytest.mark.parametrize("us, text", [(0, "00:00:00"), (93_784_500_000, "1.02:03:04.5000000"), (-60_000_000, "-00:01:00")])
def test_time_strings(value, us, text):
    assert value(tm.to_time_string(F.lit(us))) == text


@pytest.mark.parametrize("text, us", [("5m", 300_000_000), ("12 hours", 43_200_000_000), ("1d 12h", 129_600_000_000), ("100 ms", 100_000), ("23us", 23)])
def test_durations(text, us):
    assert tm.duration_us(text) == us


@pytest.mark.parametrize("text", ["", "5", "5 weeks", "h", "0s"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        tm.duration_us(text)


def test_times(value):
    at = F.lit(dt.datetime(2024, 7, 1, 12, 0)).cast("timestamp")
    assert value(tm.offset_in("Europe/Paris", at)) == 7_200_000_000
    assert value(tm.offset_in("Europe/Paris", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp"))) == 3_600_000_000
    assert value(tm.to_iso_string(at, -tm.UNITS_US["h"] // 2)) == "2024-07-01T11:30:00.0000000-00:30"
    assert value(tm.time_of_day(at, -13)) == 23 * 3_600_000_000
    assert value(tm.date_part(at, "weekday")) == 1 and value(tm.date_part(at, "nonsense")) is None
    assert value(tm.parse_datetime(F.lit("later"))) is None


@pytest.fixture
def event(spark):
    return spark.range(1).select(F.parse_json(F.lit(
        '{"a":1,"s":"7","t":true,"n":null,"o":{"p":{"q":2},"k.l":3},"list":[1,2,3],"d":1.5}')).alias("properties"))


def test_no_coercion(event):
    row = event.select(
        v.prop("s", "double").alias("text_as_number"), v.prop("a", "string").alias("number_as_text"), v.prop("a", "double").alias("a"),
        v.prop("d", "double").alias("d"), v.prop("s", "double", strict=False).alias("cast"), v.prop("n", "string").alias("null")).first()
    assert tuple(row) == (None, None, 1.0, 1.5, 7.0, None)


def test_paths(event):
    row = event.select(v.prop("o.p.q", "int").alias("nested"), v.prop("o.k.l", "int").alias("dotted_is_a_path"),
                       v.prop("k.l", "int", v.member(F.col("properties"), "o"), literal=True).alias("literal"),
                       v.prop("list[1]", "int").alias("element"), v.has_prop("o.p").alias("has"), v.has_prop("o.x").alias("has_not")).first()
    assert tuple(row) == (2, None, 3, 2, True, False)


def test_null_is_a_value(event):
    p = F.col("properties")
    row = event.select(v.has_prop("n").alias("has"), v.is_null(v.member(p, "n"), variant=True).alias("null"),
                       v.is_null(v.member(p, "zz"), variant=True).alias("undefined"), v.is_null(v.member(p, "a"), variant=True).alias("a"),
                       v.type_of(v.member(p, "n")).alias("t1"), v.type_of(v.member(p, "zz")).alias("t2")).first()
    assert tuple(row) == (True, True, True, False, "null", "undefined")


def test_equality_across_types(event):
    row = event.select(v.prop_equals("s", 7).alias("a"), v.prop_differs("s", 7).alias("b"), v.prop_equals("s", "7").alias("c"),
                       v.prop_equals("zz", 7).alias("d"), v.prop_equals("t", True).alias("e")).first()
    assert tuple(row) == (False, True, True, None, True)


def test_collections(event):
    items = v.prop("list", "array<int>")
    row = event.select(v.some(items, lambda e: e > 2).alias("some"), v.every(items, lambda e: e > 0).alias("every"),
                       v.every(items, lambda e: F.lit(None).cast("boolean")).alias("undefined"), v.element_at(items, 5).alias("outside"),
                       F.array_sort(v.keys_of(v.member(F.col("properties"), "o"), variant=True)).alias("keys")).first()
    assert tuple(row) == (True, True, False, None, ["k.l", "p"])


def test_json(value):
    assert value(v.from_json_text(F.lit("{")).isNull()) is True
    assert value(v.template_id(F.lit("Loop {Counter}"))) == v.template_id_of("Loop {Counter}")


@pytest.mark.parametrize("level, full, severity", [("inf", "Information", 2), ("WRN", "Warning", 3), ("panic", "Panic", 5), ("eror", "Error", 4),
                                                   ("weird", "weird", 2), ("T", "Trace", 0), ("notice", "Notice", 2), (None, None, 2)])
def test_levels(value, level, full, severity):
    assert value(levels.normalise_level(F.lit(level).cast("string"))) == full
    assert value(levels.severity_of(F.lit(level).cast("string"))) == severity


def test_every_spelling_is_listed_once():
    spellings = [s for _, _, group in levels.LEVELS for s in group.split()]
    assert len(spellings) == len(set(spellings)) == 50


@pytest.mark.parametrize("prefix, name, optional, expected", [
    ("@Properties", "a b", True, "@Properties['a b']"), ("@Properties", "and", True, "@Properties.and"), ("@Properties", "UserId", True, "UserId"),
    ("@Scope", "name", False, "@Scope.name"), ("@Resource", "it's", False, "@Resource['it''s']")])
def test_accessors(value, prefix, name, optional, expected):
    assert value(v.accessor(F.lit(prefix), F.lit(name), optional)) == expected
