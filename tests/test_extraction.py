import datetime as dt

import pytest

from tracelode.operators import extraction as ex

VALID = ["a", "{a}", "{@m}", "{@m:n}", "{@m:*}", "{@m:***}", "{:*}", "{m_N}", "{_9}", "{:n}", "{{@m}}", "{{a", "a}}",
         "{a} b{c} ", "d {a}b {c}", "{:={@m}}", "Loaded {SignalId:=signal-{:nat}}", "{:={Year:num}-{Month:num}}"]
INVALID = ["", "{}", "{a", "{@@m}", "{m@}", "{a:}", "{:}", "{", "}"]


@pytest.mark.parametrize("pattern", VALID)
def test_accepted(pattern):
    assert ex.parse_pattern(pattern)


@pytest.mark.parametrize("pattern", INVALID)
def test_rejected(pattern):
    with pytest.raises(ex.PatternError):
        ex.parse_pattern(pattern)


def test_unknown_matcher_and_repeated_name():
    with pytest.raises(ex.PatternError):
        ex.compile_pattern("{a:num}")
    with pytest.raises(ex.PatternError):
        ex.compile_pattern("{a} {a}")


def one(spark, pattern, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return ex.extract_fields(df, pattern, keep=(), **options).first().asDict()


def test_default_file_format(spark):
    row = one(spark, "{@t:timestamp} [{@l:ident}] {@m:*}{:n}{@x:*}",
              "2018-02-21 13:29:00.123 +10:00 [ERR] The operation failed\nDivideError: by zero\n  at Some.Method()\n")
    assert row == {"@t": dt.datetime(2018, 2, 21, 3, 29, 0, 123000), "@l": "ERR", "@m": "The operation failed",
                   "@x": "DivideError: by zero\n  at Some.Method()\n", "unmatched": None}


@pytest.mark.parametrize("pattern, text, expected", [
    ("[{test:**}]!", "[0]abc[1]!", {"test": "0]abc[1", "unmatched": None}),
    ("{@m:trailingindent}", "Hello,\n world!", {"@m": "Hello,\n world!", "unmatched": None}),
    ("{@m:trailingindent}", " world", {"@m": None, "unmatched": " world"}),
    ("{class:ident}.{method:ident}", "this.that", {"class": "this", "method": "that", "unmatched": None}),
    ("{first:ident} {content:line} ({last:ident})", "abc def ghi (jkl)",
     {"first": "abc", "content": "def ghi (jkl)", "last": None, "unmatched": None}),
    ("{first:ident} {content:***} ({last:ident})", "abc def ghi (jkl)",
     {"first": "abc", "content": "def ghi", "last": "jkl", "unmatched": None}),
    ("{a:alpha}", "abc 123", {"a": "abc", "unmatched": None}),
    ("{a:alpha}{b:nat}", "abc  \n", {"a": "abc", "b": None, "unmatched": None}),
    ("{a:alpha} {b:nat}", "abc xyz", {"a": "abc", "b": None, "unmatched": "xyz"}),
    ("{a:*}{:n}", "never ends", {"a": None, "unmatched": "never ends"}),
    ("{a:=x{b:nat}} {c}", "x7 y", {"a": "x7", "b": 7, "c": "y", "unmatched": None}),
    ("{k:alpha} {a:=x{b:nat}-{c:nat}} z", "p x7-", {"k": "p", "a": None, "b": None, "c": None, "unmatched": "x7-"}),
    ("{a:token} {b:token}", "one\x1ftwo three\x1f", {"a": "one\x1ftwo", "b": "three\x1f", "unmatched": None}),
    ("{{{a:nat}}}", "{5}", {"a": 5, "unmatched": None}),
    ("{a:int} {b:dec}", "-12 +3.50", {"a": -12, "b": "+3.50", "unmatched": None}),
    ("{l:level}", "wrn", {"l": "Warning", "unmatched": None}),
    ("{l:level}", "odd", {"l": "odd", "unmatched": None}),
    ("{a:alphanum}{:t}{b:s}c", "a1é\t  c", {"a": "a1é", "b": "  ", "unmatched": None}),
])
def test_elements(spark, pattern, text, expected):
    assert one(spark, pattern, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Mar  6 13:22:29", dt.datetime(2024, 3, 6, 13, 22, 29)),
    ("Dec 31 23:59:59", dt.datetime(2023, 12, 31, 23, 59, 59)),
    ("Jan  1 00:00:00", dt.datetime(2024, 1, 1)),
])
def test_syslog(spark, text, expected):
    assert one(spark, "{t:syslogdt}", text, reference_time="2024-03-05 12:00:00")["t"] == expected


@pytest.mark.parametrize("pattern, text, expected", [
    ("{t:w3cdt}", "2019-03-26 21:48:26 xxx", dt.datetime(2019, 3, 26, 21, 48, 26)),
    ("{t:unixdt}", "999999999", dt.datetime(2001, 9, 9, 1, 46, 39)),
    ("{t:unixdt}", "999999999.999", dt.datetime(2001, 9, 9, 1, 46, 39, 999000)),
    ("{t:unixdt}", "999999999999", dt.datetime(2001, 9, 9, 1, 46, 39, 999000)),
    ("{t:timestamp}", "2019-03-26 21:48:26 xxx", dt.datetime(2019, 3, 26, 21, 48, 26)),
    ("{t:iso8601dt}", "2020-01-28T13:50:01.123+02:00", dt.datetime(2020, 1, 28, 11, 50, 1, 123000)),
])
def test_timestamps(spark, pattern, text, expected):
    assert one(spark, pattern, text)["t"] == expected


def test_local_times_take_a_zone(spark):
    row = one(spark, "{a:serilogdt}|{b:serilogdt}", "2024-01-02 10:00:00|2024-01-02 10:00:00 +00:00", zone="Asia/Kolkata")
    assert row["a"] == dt.datetime(2024, 1, 2, 4, 30) and row["b"] == dt.datetime(2024, 1, 2, 10)


def test_web_log(spark):
    pattern = ("{@t:w3cdt} {ServerIP} {@m:={Method} {RequestPath}} {Query} {Port:nat} {Username} {ClientIP} {UserAgent} {Referer} "
               "{StatusCode:nat} {Substatus:nat} {Win32Status:nat} {ResponseBytes:nat} {RequestBytes:nat} {Elapsed}{:n}")
    row = one(spark, pattern, "2019-04-02 05:18:01 1.2.3.4 GET /a/b q=1 80 u 5.6.7.8 Agent ref 200 0 0 100 20 33\n")
    assert row["@m"] == "GET /a/b" and row["Method"] == "GET" and row["StatusCode"] == 200 and row["Elapsed"] == "33"
    assert row["unmatched"] is None


def test_long_text_does_not_recurse(spark):
    text = "x" * 2_000_000 + "\nrest"
    row = one(spark, "{a:*}{:n}{b:*}", text)
    assert len(row["a"]) == 2_000_000 and row["b"] == "rest"
