"""Steps between reading and writing: building, enriching, cleaning and filtering events."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import severity_number, severity_of
from ..functions.logic import is_true
from ..functions.values import as_object, template_id
from ..model import conform

# Extracted names that become event columns.
REIFIED = {"@t": "ts", "@m": "message", "@l": "level", "@x": "exception", "@tr": "trace_id", "@sp": "span_id"}


def build_events(df: DataFrame, reference_time=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Extracted fields to events: the stream's columns, after those named in ``keep``.

    Names without a column of their own, and unmatched text, become properties.
    """
    have = set(df.columns)
    now = F.current_timestamp() if reference_time is None else F.lit(reference_time).cast("timestamp")

    def taken(name, kind="string"):
        return F.col(f"`{name}`").try_cast(kind) if name in have else F.lit(None).cast(kind)

    own = [c for c in df.columns if c not in REIFIED and c not in keep and c != "unmatched"]
    members = [F.struct(F.lit(c).alias("k"), _as_variant(f"`{c}`", dict(df.dtypes)[c]).alias("v")) for c in own]
    if "unmatched" in have:
        members.append(F.struct(F.lit("@unmatched").alias("k"), F.col("unmatched").cast("variant").alias("v")))
    # Names are distinct columns, so the map has no duplicate keys.
    pairs = F.filter(F.array(*members), lambda x: x["v"].isNotNull()) if members else None
    level = F.coalesce(taken("@l"), F.lit("Information"))
    message = F.coalesce(taken("@m"), F.lit(""))
    events = df.select(
        *keep, F.coalesce(taken("@t", "timestamp"), now).alias("ts"), level.alias("level"),
        severity_of(level).alias("severity"), message.alias("message"), message.alias("message_template"),
        template_id(message).alias("event_type_id"), taken("@x").alias("exception"),
        taken("@tr").alias("trace_id"), taken("@sp").alias("span_id"),
        (F.to_variant_object(F.map_from_entries(pairs)) if members else F.lit(None).cast("variant")).alias("properties"))
    return conform(events, keep=keep)


def _as_variant(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == "timestamp":
        value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return value.cast("variant")


def parse_scalar(text: str | None):
    """Property text from a user: nothing, a boolean, a number or the text itself."""
    value = (text or "").strip()
    if not value:
        return None
    if value in ("true", "false"):
        return value == "true"
    if re.fullmatch(r"[+-]?\d+", value) and abs(int(value)) < 2 ** 63:
        return int(value)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", value):
        return float(value)
    return value


def add_properties(df: DataFrame, properties: dict[str, object]) -> DataFrame:
    """Adds or overwrites scalar properties; text values are typed by :func:`parse_scalar`."""
    return df.withColumn("properties", with_members(F.col("properties"), properties))


def with_members(value: Column, members: dict[str, object]) -> Column:
    """A variant object with some members replaced."""
    typed = {k.strip(): parse_scalar(v) if isinstance(v, str) or v is None else v for k, v in members.items()}
    added = F.map_from_entries(F.array(*[
        F.struct(F.lit(k).alias("k"), _variant_literal(v).alias("v")) for k, v in typed.items()]))
    existing = F.coalesce(as_object(value), F.from_json(F.lit("{}"), "map<string,variant>"))
    return F.to_variant_object(F.map_concat(F.map_filter(existing, lambda k, _: ~k.isin(*typed)), added))


def _variant_literal(value) -> Column:
    return F.parse_json(F.lit("null")) if value is None else F.lit(value).cast("variant")


def override_level(df: DataFrame, level: str) -> DataFrame:
    """One level for all events."""
    return df.withColumns({"level": F.lit(level), "severity": severity_of(F.lit(level))})


def set_template(df: DataFrame, template: str) -> DataFrame:
    """One message template for all events."""
    return df.withColumns({"message_template": F.lit(template), "event_type_id": template_id(F.lit(template))})


def filter_ingest(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


@dataclass(frozen=True)
class IngestPolicy:
    """What happens to events that arrive under one source key."""

    key: str
    filter: Column | None = None
    minimum_level: str | None = None
    properties: dict[str, object] = field(default_factory=dict)
    use_server_time: bool = False


def apply_ingest_policies(df: DataFrame, policies: list[IngestPolicy], key: str = "source_key",
                          arrival: Column | None = None) -> DataFrame:
    """Per source key: filter, minimum level, applied properties and arrival-clock timestamps.

    Policies are definitions, written by hand, so they are folded into expressions of a single
    pass over the events. Events under a key without a policy pass unchanged.
    """
    keep, ts, properties = F.lit(True), F.col("ts"), F.col("properties")
    clock = F.current_timestamp() if arrival is None else arrival
    for policy in policies:
        mine = F.col(key).eqNullSafe(F.lit(policy.key))
        passes = F.lit(True) if policy.filter is None else is_true(policy.filter)
        if policy.minimum_level:
            passes = passes & (severity_of(F.col("level")) >= severity_number(policy.minimum_level))
        keep = F.when(mine, passes).otherwise(keep)
        if policy.use_server_time:
            ts = F.when(mine, clock).otherwise(ts)
        if policy.properties:
            properties = F.when(mine, with_members(F.col("properties"), policy.properties)).otherwise(properties)
    return df.where(keep).withColumns({"ts": ts, "properties": properties})


def unflatten(df: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Columns named ``a.b.c`` become nested structs; a dotted name that clashes with a plain one stays flat.

    Below ``max_depth`` levels, if given, names stay dotted.
    """
    return df.select(*_nest({c: F.col(f"`{c}`") for c in df.columns}, max_depth))


def _nest(columns: dict[str, Column], depth: int | None) -> list[Column]:
    plain, by_head = {}, {}
    for name, column in columns.items():
        parts = name.split(".")
        dotted = depth != 0 and len(parts) > 1 and all(re.fullmatch(r"[^\W\d]\w*", p) for p in parts)
        if dotted:
            by_head.setdefault(parts[0], {})[name] = column
        else:
            plain[name] = column
    result = [c.alias(n) for n, c in plain.items()]
    for head in sorted(by_head):
        members = by_head[head]
        if head in plain:
            result += [c.alias(n) for n, c in members.items()]
        else:
            result.append(F.struct(*_nest({n.split(".", 1)[1]: c for n, c in members.items()}, None if depth is None else depth - 1)).alias(head))
    return result


def sanitise_trace_ids(df: DataFrame) -> DataFrame:
    """Nulls identifiers that are not lower-case hex of the right length, or are all zero."""
    return df.withColumns({name: clean_hex(F.col(name), width)
                           for name, width in (("trace_id", 32), ("span_id", 16), ("parent_id", 16))
                           if name in df.columns})


def clean_hex(value: Column, width: int) -> Column:
    return F.when((F.length(value) == width) & value.rlike(r"\A0*[1-9a-f][0-9a-f]*\z"), value)


def render_messages(df: DataFrame, template: str = "message_template", properties: str = "properties") -> DataFrame:
    """Fills ``message`` from the template and the properties."""
    staged = df.withColumn("_values", as_object(F.col(properties)))
    return staged.withColumn("message", render_template(F.col(template), F.col("_values"))).drop("_values")


def render_template(template: Column, values: Column) -> Column:
    """Replaces ``{Name}`` holes by the values of a map of variants.

    An unknown hole keeps its text, doubled braces are literal.
    """
    tokens = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{[^{}]+\}|[^{}]+|[{}])"), F.lit(1))

    def text_of(token):
        name = F.regexp_extract(token, r"\A\{[@$]?([^,:{}]+)", 1)
        return (F.when(token == "{{", F.lit("{")).when(token == "}}", F.lit("}"))
                .when(F.startswith(token, F.lit("{")) & (F.length(token) > 1),
                      F.coalesce(F.try_element_at(values, name).try_cast("string"), token))
                .otherwise(token))

    return F.when(template.isNotNull(), F.array_join(F.transform(tokens, text_of), ""))


def arrival_order(df: DataFrame, *order) -> DataFrame:
    """Adds ``arrived``: a number that grows in the order of the lines within each file split."""
    if order:
        return df.withColumn("arrived", F.struct(*order))
    return df.withColumn("arrived", F.monotonically_increasing_id())
