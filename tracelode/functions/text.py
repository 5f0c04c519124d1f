"""Text functions. Indexes are zero-based; ``ci=True`` ignores case."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _fold(value, ci: bool) -> Column:
    return F.lower(_col(value)) if ci else _col(value)


def concat_text(*parts) -> Column:
    return F.concat(*[_col(p) for p in parts])


def contains_text(text: Column, part, ci: bool = False) -> Column:
    return F.contains(_fold(text, ci), _fold(part, ci))


def starts_with(text: Column, part, ci: bool = False) -> Column:
    return F.startswith(_fold(text, ci), _fold(part, ci))


def ends_with(text: Column, part, ci: bool = False) -> Column:
    return F.endswith(_fold(text, ci), _fold(part, ci))


def index_of(text: Column, part, ci: bool = False) -> Column:
    """First position, or -1."""
    return (F.position(_fold(part, ci), _fold(text, ci)) - 1).cast("bigint")


def last_index_of(text: Column, part, ci: bool = False) -> Column:
    """Last position, or -1: the mirror image of a search in the reversed text."""
    whole, piece = _fold(text, ci), _fold(part, ci)
    from_end = F.position(F.reverse(piece), F.reverse(whole))
    return (F.when(from_end == 0, F.lit(-1))
            .otherwise(F.length(whole) - F.length(piece) - from_end + 1).cast("bigint"))


def length_of(value: Column, array: bool = False) -> Column:
    return (F.size(value) if array else F.length(value)).cast("bigint")


def replace_text(text: Column, part: str, replacement: str, ci: bool = False, regex: bool = False) -> Column:
    """Literal replacement, or a regular expression one with ``$0``, ``$1`` and ``$$`` for a dollar sign."""
    if not regex and not ci:
        return F.replace(text, F.lit(part), F.lit(replacement))
    if regex:
        template = replacement.replace("\\", "\\\\").replace("$$", "\\$")
        pattern = part
    else:
        template = replacement.replace("\\", "\\\\").replace("$", "\\$")
        pattern = _quote(part)
    return F.regexp_replace(text, ("(?iu)" if ci else "") + pattern, template)


def substring_of(text: Column, start, length=None) -> Column:
    """Undefined for a negative start or length, or a start beyond the end of the text."""
    begin = _col(start)
    rest = F.substring(text, begin + 1, F.length(text)) if length is None else F.substring(text, begin + 1, _col(length))
    ok = (begin >= 0) & (begin <= F.length(text))
    if length is not None:
        ok = ok & (_col(length) >= 0)
    return F.when(ok, rest)


def to_lower(text: Column) -> Column:
    return F.lower(text)


def to_upper(text: Column) -> Column:
    return F.upper(text)


def _quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def like_text(text: Column, pattern: str, ci: bool = False) -> Column:
    """``%`` stands for any text and ``?`` for at most one character; doubling either escapes it.

    Patterns without ``?`` become SQL ``LIKE``, which Catalyst turns into prefix, suffix or
    substring tests and pushes into the scan; only the others need a regular expression.
    """
    tokens = re.findall(r"%%|\?\?|%|\?|[^%?]+", pattern)
    subject = _fold(text, ci)
    if "?" not in tokens:
        sql = "".join(
            "%" if t == "%" else re.sub(r"([\\%_])", r"\\\1", t[0] if t in ("%%", "??") else t) for t in tokens
        )
        return subject.like(sql.lower() if ci else sql)
    regex = "".join(
        r"[\s\S]*" if t == "%" else r"[\s\S]?" if t == "?" else _quote(t[0] if t in ("%%", "??") else t)
        for t in tokens
    )
    return text.rlike(("(?iu)" if ci else "") + rf"\A(?:{regex})\z")


def matches_regex(text: Column, regex: str, ci: bool = False) -> Column:
    """The whole text must match."""
    return text.rlike(("(?iu)" if ci else "") + rf"\A(?:{regex})\z")


def to_hex_string(number: Column) -> Column:
    """Fraction digits are dropped."""
    return F.concat(F.lit("0x"), F.hex(number.cast("bigint")))
