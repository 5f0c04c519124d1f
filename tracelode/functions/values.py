"""Dynamic values: property paths in ``VARIANT`` columns, arrays, objects and JSON."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, functions as F

_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _stored_as(shape: Column, kind: str) -> Column:
    """Whether a variant of this schema holds a value of a dynamic type."""
    if kind == "number":
        return shape.isin(*_NUMBERS) | shape.startswith("DECIMAL(")
    return shape == kind.upper()


_KIND_OF = {
    "string": "string", "boolean": "boolean",
    "double": "number", "float": "number", "bigint": "number", "int": "number", "long": "number",
}


def json_path(path: str, literal: bool = False) -> str:
    """``Customer.Tier`` to ``$["Customer"]["Tier"]``; a literal path is a single key that may hold dots."""
    steps = [path] if literal else path.split(".")
    out = "$"
    for step in steps:
        name = re.match(r"\A(.*?)((?:\[\d+\])*)\Z", step, re.S)
        out += f"[{json.dumps(name.group(1), ensure_ascii=False)}]" + name.group(2)
    return out


def member(value: Column, path: str, literal: bool = False) -> Column:
    """The variant at ``path``, undefined when missing."""
    return F.try_variant_get(value, json_path(path, literal), "variant")


def prop(path: str, kind: str = "string", source: str | Column = "properties", strict: bool = True,
         literal: bool = False) -> Column:
    """A typed property. Values of another dynamic type are undefined: there is no coercion.

    ``strict=False`` skips the type test and lets Spark cast.
    """
    column = F.col(source) if isinstance(source, str) else source
    typed = F.try_variant_get(column, json_path(path, literal), kind)
    dynamic = _KIND_OF.get(kind.lower()) if strict else None
    if dynamic is None:
        return typed
    return F.when(_stored_as(F.schema_of_variant(member(column, path, literal)), dynamic), typed)


def has(value: Column) -> Column:
    return value.isNotNull()


def has_prop(path: str, source: str | Column = "properties") -> Column:
    column = F.col(source) if isinstance(source, str) else source
    return member(column, path).isNotNull()


def is_null(value: Column, variant: bool = False) -> Column:
    """``null`` or undefined."""
    return value.isNull() | F.is_variant_null(value) if variant else value.isNull()


def is_not_null(value: Column, variant: bool = False) -> Column:
    return ~is_null(value, variant)


def type_of(value: Column) -> Column:
    """Dynamic type name of a variant."""
    shape = F.schema_of_variant(value)
    return (F.when(value.isNull(), "undefined")
            .when(shape == "VOID", "null")
            .when(shape == "BOOLEAN", "boolean")
            .when(shape.startswith("ARRAY<"), "array")
            .when(shape.startswith("OBJECT<"), "object")
            .when(_stored_as(shape, "number"), "number")
            .otherwise("string"))


def prop_equals(path: str, expected, source: str | Column = "properties", ci: bool = False) -> Column:
    """Equality with a scalar: false, not an error, for a defined value of another type."""
    column = F.col(source) if isinstance(source, str) else source
    kind = "boolean" if isinstance(expected, bool) else "string" if isinstance(expected, str) else "double"
    typed = prop(path, kind, column)
    want = F.lit(expected)
    same = F.lower(typed) == F.lower(want) if ci else typed == want
    return F.when(member(column, path).isNotNull(), F.coalesce(same, F.lit(False)))


def prop_differs(path: str, other, source: str | Column = "properties", ci: bool = False) -> Column:
    return ~prop_equals(path, other, source, ci)


def coalesce_values(*values: Column) -> Column:
    return F.coalesce(*values)


def element_at(collection: Column, index, ci: bool = False) -> Column:
    """Zero-based array element, or the value under an object key (a ``MAP``)."""
    if isinstance(index, int):
        return F.get(collection, index) if index >= 0 else F.lit(None)
    if ci:
        matching = F.map_filter(collection, lambda k, _: F.lower(k) == index.lower())
        return F.get(F.map_values(matching), 0)
    return F.try_element_at(collection, F.lit(index))


def as_object(value: Column) -> Column:
    """A variant object as a map of variants, ``NULL`` for other values."""
    return value.try_cast("map<string,variant>")


def keys_of(value: Column, variant: bool = False) -> Column:
    return F.map_keys(as_object(value) if variant else value)


def values_of(value: Column, variant: bool = False) -> Column:
    return F.map_values(as_object(value) if variant else value)


def some(collection: Column, predicate: Callable[[Column], Column], is_map: bool = False) -> Column:
    """True when the predicate is true for some array element or object value."""
    items = F.map_values(collection) if is_map else collection
    return F.exists(items, lambda x: F.coalesce(predicate(x), F.lit(False)))


def every(collection: Column, predicate: Callable[[Column], Column], is_map: bool = False) -> Column:
    """True when the predicate is true for all array elements or object values."""
    items = F.map_values(collection) if is_map else collection
    return F.forall(items, lambda x: F.coalesce(predicate(x), F.lit(False)))


def from_json_text(text: Column) -> Column:
    return F.try_parse_json(text)


def to_json_text(value: Column) -> Column:
    return F.to_json(value)


def template_id(template: Column) -> Column:
    """Stable numeric hash of a message template."""
    return F.crc32(template)


def template_id_of(template: str) -> int:
    """The same hash for a literal, to write predicates with."""
    return zlib.crc32(template.encode("utf-8"))


# Words that cannot be written as a bare property name.
KEYWORDS = (
    "and", "ci", "else", "false", "if", "in", "is", "let", "like", "not", "null", "or", "then", "true",
    "analyze", "as", "asc", "by", "desc", "explain", "for", "from", "group", "having", "into", "lateral",
    "limit", "lower", "order", "select", "where",
)


def accessor(prefix: Column, name: Column, prefix_optional: bool = False) -> Column:
    """How a property is addressed: bare when it can be, dotted when it is an identifier, else quoted."""
    plain = name.rlike(r"\A[_a-zA-Z][_a-zA-Z0-9]*\z")
    dotted = F.concat(prefix, F.lit("."), name)
    quoted = F.concat(prefix, F.lit("['"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("']"))
    if prefix_optional:
        return F.when(plain & ~F.lower(name).isin(*KEYWORDS), name).when(plain, dotted).otherwise(quoted)
    return F.when(plain, dotted).otherwise(quoted)
