"""What properties events carry, and what they cost."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.values import accessor, as_object
from ..functions.text import to_hex_string
from .query import event_as_object

# Where properties live, how each place is written, and whether it may be left out.
PLACES = (("properties", "@Properties", True), ("scope", "@Scope", False), ("resource", "@Resource", False))


def shape_paths(shape: str | None) -> list[list[str]]:
    """Lists of member names that lead to everything inside a variant of this schema, at any depth.

    Names are bare or in backquotes; what is inside an array has no path of its own.
    """
    paths: list[list[str]] = []
    at, names, opened = 0, [], []  # opened: whether each bracket that is open belongs to an object
    for token in _TOKEN.finditer(shape or ""):
        text = token[0]
        if text.endswith("<"):
            opened.append(text == "OBJECT<")
            names += [""] * (text == "OBJECT<")
        elif text == ">":
            if opened.pop():
                names.pop()
        elif text.endswith(":") and all(opened):
            name = text[:-1]
            names[-1] = name[1:-1].replace("``", "`") if name.startswith("`") else name
            paths.append(names.copy())
    return paths


_TOKEN = re.compile(r"`(?:[^`]|``)*`:|[^\s<>,:`]+:|\w+<|>")


def key_paths(shape: Column) -> Column:
    """The same for a column of schemas. Meant for distinct ones, of which there are few."""
    @F.udf(ArrayType(ArrayType(StringType())), useArrow=True)
    def read(text):
        return shape_paths(text)

    return read(shape)


def property_paths(df: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct accessor paths over properties, scope and resource, sorted, at any depth unless one is given.

    One pass: the schema of each event's values is taken, and events of the same shape are merged before
    anything is shuffled. Paths are read and accessors written for distinct shapes only.
    """
    have = [p for p in PLACES if p[0] in df.columns]
    shapes = df.select(*[F.schema_of_variant(c).alias(c) for c, _, _ in have]).distinct()
    shapes = shapes.withColumns({c: key_paths(F.col(c)) for c, _, _ in have})
    names = shapes.select(F.explode(F.concat(*[placed_paths(*p) for p in have])).alias("p")).select("p.*").distinct()
    names = names if max_depth is None else names.where(F.size("names") <= max_depth)
    return names.select(written_path().alias("path")).distinct().orderBy("path")


def placed_paths(column: str, prefix: str, optional: bool) -> Column:
    """Paths with the place they were found in."""
    return F.transform(column, lambda path: F.struct(
        F.lit(prefix).alias("prefix"), F.lit(optional).alias("optional"), path.alias("names")))


def written_path() -> Column:
    """The accessor for a row of ``prefix``, ``optional`` and ``names``."""
    first = F.when(F.col("optional"), accessor(F.col("prefix"), F.get("names", 0), True)).otherwise(
        accessor(F.col("prefix"), F.get("names", 0)))
    return F.aggregate(F.slice("names", F.lit(2), F.size("names")), first, lambda prefix, name: accessor(prefix, name))


def available_properties(df: DataFrame, properties: str = "properties") -> DataFrame:
    """Distinct top-level property names."""
    return df.select(F.explode(F.map_keys(as_object(F.col(properties)))).alias("name")).distinct()


def space_by_template(df: DataFrame, n: int | None = None) -> DataFrame:
    """Count and JSON size of the events of each type, largest first."""
    sized = event_as_object(df)
    totals = sized.groupBy("event_type_id").agg(
        F.count(F.lit(1)).alias("occurrences"), F.sum("json_chars").alias("total_chars"),
        F.min_by("message_template", F.struct(*[c for c in ("ts", "id") if c in df.columns])).alias("message_template"))
    ordered = totals.orderBy(F.col("total_chars").desc(), "event_type_id")
    return ((ordered if n is None else ordered.limit(n))
            .select("occurrences", "total_chars", to_hex_string(F.col("event_type_id")).alias("event_type"), "message_template"))
