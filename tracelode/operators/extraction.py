"""Field extraction from plain text with patterns such as ``{@t:timestamp} [{@l:level}] {@m:*}{:n}{@x:*}``.

A pattern is turned, once and on the driver, into a single regular expression of nested optional
atomic groups. Extraction stops at the first element that fails, which is exactly what the nesting
says, and since atomic groups never backtrack the match is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import normalise_level

_SPACE = r"\s\p{Z}\x85"
_ISO = r"\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[+-]\d\d:\d\d|Z)?"
_DATETIME = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"
_OFFSET_DATETIME = _DATETIME + r"(?:\.\d+)?(?: [+-]\d\d:\d\d)?"
_SYSLOG = r"\w{3} (?: )?\d{1,2} \d\d:\d\d:\d\d"

# Matcher names and the text each one accepts.
MATCHERS = {
    "alpha": r"\p{L}++",
    "alphanum": r"[\p{L}\p{Nd}]++",
    "dec": r"[+-]?\d++(?:\.\d++)?",
    "ident": r"[\p{L}_][\p{L}\p{Nd}_]*+",
    "int": r"[+-]?\d++",
    "iso8601dt": _ISO,
    "level": r"\p{L}++",
    "line": r"[^\r\n]++",
    "n": r"\r?\n",
    "nat": r"\d++",
    "s": r"[ \t]++",
    "serilogdt": _OFFSET_DATETIME,
    "syslogdt": _SYSLOG,
    "t": r"\t",
    "timestamp": f"{_ISO}|{_OFFSET_DATETIME}|{_SYSLOG}",
    "token": rf"[^{_SPACE}]++",
    "trailingident": rf"[^{_SPACE}][\s\S]*+",
    "trailingindent": rf"[^{_SPACE}][\s\S]*+",
    "unixdt": r"[+-]?\d++(?:\.\d++)?",
    "w3cdt": _DATETIME,
}


# Text that a matcher consumes after its value.
ENDINGS = {"line": r"(?:\r?\n)?"}


class PatternError(ValueError):
    """The extraction pattern is not well formed."""


@dataclass(frozen=True)
class Element:
    """A literal, a named matcher, non-greedy content or a group."""

    kind: str
    value: object
    name: str | None = None


_NAME = re.compile(r"@\w*|[^\W\d]\w*|_\w*")
_TYPE = re.compile(r"[^\W\d]\w*|_\w*")
_LITERAL = re.compile(r"(?:\{\{|\}\}|[^{}])+")


def parse_pattern(pattern: str) -> list[Element]:
    """The elements of a pattern; raises :class:`PatternError`."""
    elements, at = _elements(pattern, 0)
    if not elements or at < len(pattern):
        raise PatternError(f"not a valid extraction pattern: {pattern!r}")
    return elements


def _elements(pattern: str, at: int) -> tuple[list[Element], int]:
    """Elements from ``at`` on, up to the end or a brace that closes a group."""
    found: list[Element] = []
    while at < len(pattern):
        literal = _LITERAL.match(pattern, at)
        if literal:
            found.append(Element("literal", literal.group().replace("{{", "{").replace("}}", "}")))
            at = literal.end()
        elif pattern[at] == "{":
            element, at = _match_expression(pattern, at + 1)
            found.append(element)
        else:
            break
    return found, at


def _match_expression(pattern: str, at: int) -> tuple[Element, int]:
    named = _NAME.match(pattern, at)
    name = named.group() if named else None
    at = named.end() if named else at
    element = Element("match", "token", name) if name else None
    if pattern.startswith(":", at):
        at += 1
        lazy, typed = re.compile(r"\*+").match(pattern, at), _TYPE.match(pattern, at)
        if lazy:
            element, at = Element("lazy", len(lazy.group()), name), lazy.end()
        elif typed:
            element, at = Element("match", typed.group(), name), typed.end()
        elif pattern.startswith("=", at):
            inner, at = _elements(pattern, at + 1)
            element = Element("group", tuple(inner), name) if inner else None
        else:
            element = None
    if element is None or not pattern.startswith("}", at):
        raise PatternError(f"not a valid match expression at {at} in {pattern!r}")
    return element, at + 1


@dataclass
class Extraction:
    """A compiled pattern: the expression, where a record starts, and its captures in order."""

    regex: str
    start: str
    fields: list[tuple[str, str]] = field(default_factory=list)


def compile_pattern(pattern: str) -> Extraction:
    elements = parse_pattern(pattern)
    captures: list[tuple[str, str]] = []
    pieces = [_regex(e, elements[i + 1:], captures) for i, e in enumerate(elements)]
    names = [name for name, _ in captures]
    if len(set(names)) != len(names):
        raise PatternError(f"a name is extracted twice: {pattern!r}")
    # A full match swallows what follows it, which leaves nothing unmatched.
    body = r"[\s\S]*+"
    for piece in reversed(pieces):
        body = f"(?:(?>{piece}){body})?+"
    return Extraction(rf"\A{body}([\s\S]*+)\z", rf"\A(?:{_regex(elements[0], elements[1:])})", captures)


def _regex(element: Element, following, captures: list | None = None) -> str:
    """Regex of one element; named values become groups when ``captures`` collects them."""
    after = ""
    if element.kind == "literal":
        return _quote(element.value)
    if element.kind == "group":
        if captures is not None and element.name:
            captures.append((element.name, "text"))
        inner = element.value
        value = "".join(f"(?>{_regex(e, inner[i + 1:], captures)})" for i, e in enumerate(inner))
        if captures is not None:
            # A group is all or nothing, but captures of a half-matched one would survive: look first.
            value = f"(?={_regex(element, following)}){value}"
    elif element.kind == "lazy":
        stops = list(following)[:element.value]
        ahead = "".join(f"(?>{_regex(e, following[i + 1:])})" for i, e in enumerate(stops))
        value, after = (r"[\s\S]*?", f"(?={ahead})") if stops else (r"[\s\S]*+", "")
        if captures is not None and element.name:
            captures.append((element.name, "text"))
    else:
        if element.value not in MATCHERS:
            raise PatternError(f"unknown matcher: {element.value}")
        value, after = MATCHERS[element.value], ENDINGS.get(element.value, "")
        if captures is not None and element.name:
            captures.append((element.name, element.value))
    return (f"({value})" if captures is not None and element.name else f"(?:{value})") + after


def _quote(text) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def typed_value(text: Column, matcher: str, reference_time=None, zone: str = "UTC") -> Column:
    """The value that a matcher produces from the text it matched."""
    if matcher == "nat":
        return text.try_cast("decimal(20,0)")
    if matcher == "int":
        return text.try_cast("bigint")
    if matcher == "level":
        return normalise_level(text)
    if matcher in ("iso8601dt", "serilogdt"):
        return _instant(text, zone)
    if matcher == "w3cdt":
        return _instant(text, "UTC")
    if matcher == "unixdt":
        number = text.try_cast("decimal(28,6)")
        millis = F.when((number >= 100_000_000_000) | (number <= -30_000_000_000), number).otherwise(number * 1000)
        return F.timestamp_millis(millis.cast("bigint"))
    if matcher == "syslogdt":
        return syslog_time(text, reference_time, zone)
    if matcher == "timestamp":
        return F.coalesce(_instant(text, zone), syslog_time(text, reference_time, zone))
    return text


def _instant(text: Column, zone: str) -> Column:
    """Text with an offset is an instant; text without one is local to ``zone``."""
    compact = F.regexp_replace(text, r" ([+-]\d\d:\d\d)\z", "$1")
    parsed = compact.try_cast("timestamp")
    if zone == "UTC":
        return parsed
    return F.when(text.rlike(r"(?:Z|[+-]\d\d:\d\d)\z"), parsed).otherwise(F.to_utc_timestamp(parsed, zone))


def syslog_time(text: Column, reference_time=None, zone: str = "UTC") -> Column:
    """The year is the current one, or the one before when the date lies more than a week ahead."""
    now = F.current_timestamp() if reference_time is None else F.lit(reference_time).cast("timestamp")
    compact = F.regexp_replace(text, " +", " ")

    def in_year(year):
        local = F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), compact), F.lit("yyyy MMM d HH:mm:ss"))
        return local if zone == "UTC" else F.to_utc_timestamp(local, zone)

    this_year = in_year(F.year(now))
    return F.when(this_year > now + F.expr("INTERVAL 7 DAYS"), in_year(F.year(now) - 1)).otherwise(this_year)


_SEPARATOR = "\x1f"


def extract_fields(df: DataFrame, pattern: str, text: str = "text", reference_time=None, zone: str = "UTC",
                   keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds one typed column per named element, and ``unmatched`` for text the pattern did not reach.

    The expression runs once per row: the captures are rewritten into one separated string that is
    then split. Rows whose text holds the separator take one extraction per field instead.
    """
    plan = compile_pattern(pattern)
    count = len(plan.fields) + 1
    joined = F.regexp_replace(F.col(text), plan.regex, _SEPARATOR.join(f"${i}" for i in range(1, count + 1)))
    slow = F.array(*[F.regexp_extract(F.col(text), plan.regex, i) for i in range(1, count + 1)])
    parts = F.when(F.contains(F.col(text), F.lit(_SEPARATOR)), slow).otherwise(F.split(joined, _SEPARATOR))
    staged = df.select(*(keep if keep is not None else df.columns), F.col(text).alias("_text"), parts.alias("_parts"))

    def part(i):
        return F.nullif(F.get("_parts", i), F.lit(""))

    rest = part(count - 1)
    columns = [typed_value(part(i), matcher, reference_time, zone).alias(name)
               for i, (name, matcher) in enumerate(plan.fields)]
    kept = [c for c in staged.columns if c not in ("_text", "_parts")]
    return staged.select(*[F.col(f"`{c}`") for c in kept], *columns,
                         F.when(rest.rlike(rf"[^{_SPACE}]"), rest).alias("unmatched"))
