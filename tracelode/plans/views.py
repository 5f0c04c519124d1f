"""``stream``, ``spans``, ``logs`` and ``series`` views over the given parquet tables.

Each view has a twin in SQL, so that every registered query can be checked by another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.levels import severity_of
from ..functions.values import template_id
from ..session import configure


_SCHEMAS: dict[tuple[str, str], StructType] = {}


class Tables:
    """Lazily opened tables and the views derived from them. Nothing here runs a job."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table by name. Its schema is read from a file footer once per session."""
        path = f"{self.folder}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def stream(self) -> DataFrame:
        return stream_view(self.events)

    @cached_property
    def spans(self) -> DataFrame:
        nation, customer, orders = self.table("nation"), self.table("customer"), self.table("orders")
        lineitem = self.table("lineitem")
        trace = hex_id(F.col("n") + 1, 32)
        epoch = F.lit("1995-01-01").cast("timestamp")
        roots = nation.select(
            hex_id(F.col("n_nationkey") + 1, 32).alias("trace_id"),
            hex_id("n_nationkey", 15, "a").alias("span_id"),
            F.lit(None).cast("string").alias("parent_id"), epoch.alias("start"),
            F.lit(220_000_000_000_000).cast("bigint").alias("elapsed_us"), F.lit("gateway").alias("service"),
            F.col("n_name").alias("message"), F.lit("Server").alias("span_kind"))
        people = customer.withColumn("n", F.col("c_nationkey")).select(
            trace.alias("trace_id"), hex_id("c_custkey", 15, "b").alias("span_id"),
            hex_id("c_nationkey", 15, "a").alias("parent_id"),
            F.timestamp_micros(F.unix_micros(epoch) + F.col("c_custkey") * 1_000_000).alias("start"),
            F.round(F.abs("c_acctbal") * 1000).cast("bigint").alias("elapsed_us"),
            F.col("c_mktsegment").alias("service"), F.col("c_name").alias("message"),
            F.lit("Server").alias("span_kind"))
        placed = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n")),
                             "o_custkey")
        calls = placed.select(
            trace.alias("trace_id"), hex_id("o_orderkey", 15, "c").alias("span_id"),
            hex_id("o_custkey", 15, "b").alias("parent_id"),
            F.col("o_orderdate").cast("timestamp").alias("start"),
            F.round(F.col("o_totalprice") * 1000).cast("bigint").alias("elapsed_us"),
            F.col("o_orderpriority").alias("service"), F.lit("place order").alias("message"),
            F.lit("Client").alias("span_kind"))
        # Both sides are fact tables: compressed file sizes must not make Spark broadcast either.
        owners = placed.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "n")
        steps = lineitem.join(owners.hint("merge"), "l_orderkey").select(
            trace.alias("trace_id"), line_span_id().alias("span_id"),
            hex_id("l_orderkey", 15, "c").alias("parent_id"),
            F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp"))
                               + F.col("l_linenumber") * 1_000_000).alias("start"),
            F.round(F.col("l_quantity") * 60_000_000).cast("bigint").alias("elapsed_us"),
            F.concat("l_returnflag", "l_linestatus").alias("service"), F.lit("pick item").alias("message"),
            F.lit("Internal").alias("span_kind"))
        return (roots.unionByName(people).unionByName(calls).unionByName(steps)
                .withColumn("ts", F.timestamp_micros(F.unix_micros("start") + F.col("elapsed_us"))))

    @cached_property
    def logs(self) -> DataFrame:
        """Log events recorded inside the customer spans."""
        owner = self.table("customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
        return (self.stream.join(owner, "user_id")
                .withColumn("trace_id", hex_id(F.col("c_nationkey") + 1, 32))
                .withColumn("span_id", hex_id("user_id", 15, "b")).drop("c_nationkey"))

    @cached_property
    def series(self) -> DataFrame:
        """Metric samples: a gauge and a counter on every row, a second gauge on open lines only."""
        def definition(name, kind, unit, text):
            return F.struct(F.lit(name), F.struct(F.lit(kind).alias("kind"), F.lit(unit).alias("unit"),
                                                  F.lit(text).alias("description")))

        base = [definition("quantity", "Gauge", "items", "Items on the line"),
                definition("revenue", "Sum", "USD", "Revenue after discount")]
        extra = definition("discount", "Gauge", "1", "Discount share")
        is_open = F.col("l_linestatus") == "O"
        return self.table("lineitem").select(
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            line_span_id().alias("id"),
            F.when(is_open, F.map_from_entries(F.array(*base, extra)))
            .otherwise(F.map_from_entries(F.array(*base))).alias("definitions"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
            F.when(is_open, F.col("l_discount")).alias("discount"),
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))

    @cached_property
    def samples(self) -> DataFrame:
        """``series`` with its metrics and dimensions in one variant, as they arrive."""
        fields = ["quantity", "revenue", "flag", "status"]
        return self.series.select("ts", "id", "definitions", F.when(
            F.col("discount").isNotNull(), F.to_variant_object(F.struct(*fields, "discount")))
            .otherwise(F.to_variant_object(F.struct(*fields))).alias("properties"))

    @cached_property
    def histograms(self) -> DataFrame:
        """Six-hourly fixed-bucket histograms of ``events.value``: width 10, open at both ends."""
        six_hours = 21_600_000_000
        slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / six_hours) * six_hours
        cell = F.least(F.floor(F.col("value") / 10), F.lit(20))
        cells = self.events.groupBy(F.timestamp_micros(slot).alias("ts"), "event_type", cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        bucket = F.struct(F.when(F.col("cell") > 0, F.col("cell") * 10.0).alias("from"),
                          F.when(F.col("cell") < 20, (F.col("cell") + 1) * 10.0).alias("to"),
                          F.col("n").alias("count"))
        # At most 21 cells per row: the list has a fixed bound.
        return cells.groupBy("ts", "event_type").agg(
            F.sort_array(F.collect_list(bucket)).alias("buckets"), F.sum("n").alias("count"),
            F.min("low").alias("min"), F.max("high").alias("max"))

    @cached_property
    def log_text(self) -> DataFrame:
        """Log records rendered as text; error records carry a two-line stack trace."""
        stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        head = F.concat(stamp, F.lit(" +00:00 ["), spelling(), F.lit("] User "), F.col("user_id").cast("string"),
                        F.lit(" did "), F.col("event_type"), F.lit(" at "), F.col("value").cast("decimal(12,2)").cast("string"))
        trace = F.concat(F.lit("\nTimeoutError: user "), F.col("user_id").cast("string"),
                         F.lit("\n   at step "), F.get_json_object("props", "$.k"))
        return self.events.select(
            "event_id", F.when(F.col("event_type").isin("click", "view"), "web").otherwise("app").alias("source"),
            F.concat(head, F.when(F.col("event_type") == "error", trace).otherwise(F.lit(""))).alias("text"))

    @cached_property
    def log_lines(self) -> DataFrame:
        """The same text cut into lines, as a file reader delivers it."""
        return (self.log_text.select("source", "event_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
                .select("source", (F.col("event_id") * 8 + F.col("n")).alias("line_no"), "line"))

    @cached_property
    def clef_lines(self) -> DataFrame:
        """The events as newline-delimited JSON text with reserved keys."""
        return self.events.select(F.to_json(F.struct(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@t"),
            F.when(F.col("event_type") != "click", spelling()).alias("@l"),
            F.lit("User {user_id} did {event_type}").alias("@mt"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("TimeoutError: user "), F.col("user_id").cast("string")))
            .alias("@x"),
            hex_id(F.col("user_id") + 1, 32).alias("@tr"),
            F.col("event_id").alias("event_id"), F.col("user_id"), F.col("event_type"), F.col("value"),
        )).alias("line"))

    @cached_property
    def raw_lines(self) -> DataFrame:
        """Lines for validation: every kind of event is sent in its own, often broken, way."""
        stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        number = F.col("event_id").cast("string")
        return self.events.select(
            "event_id", F.col("event_type").alias("source"),
            F.when(F.col("event_type") == "click", F.concat(F.lit('{"@t":"'), stamp, F.lit('","n":'), number, F.lit("}")))
            .when(F.col("event_type") == "view", F.concat(F.lit('{"n":'), number, F.lit("}")))
            .when(F.col("event_type") == "error", F.concat(F.lit('{"n":'), number))
            .when(F.col("event_type") == "signup", F.concat(F.lit('{"@t":"not a time ', ), number, F.lit('"}')))
            .otherwise(F.concat(F.lit('["'), number, F.lit('"]'))).alias("line"))


def spelling():
    """How each source spells its level."""
    kind = F.col("event_type")
    return (F.when(kind == "error", "Error").when(kind == "purchase", "warn").when(kind == "click", "INF")
            .when(kind == "view", "dbg").otherwise("Information"))


def hex_id(number, width: int, prefix: str = ""):
    """A key as lower-case hex of fixed width."""
    column = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(column.cast("bigint"))), width, "0"))


def line_span_id():
    """Line numbers repeat within an order, so the id is a digest of the row."""
    return F.concat(F.lit("d"), F.substring(F.md5(F.concat_ws(
        "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.round(F.col("l_quantity")).cast("bigint"),
        F.unix_date(F.col("l_shipdate").cast("date")))), 1, 15))


def stream_view(events: DataFrame) -> DataFrame:
    """Events in the stream model. Often-used properties are promoted to typed columns."""
    template = F.concat(F.lit("User {user_id} did "), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("string").alias("span_id"),
        spelling().alias("level"), severity_of(spelling()).alias("severity"),
        F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type")).alias("message"),
        template.alias("message_template"), template_id(template).alias("event_type_id"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("TimeoutError: user "), F.col("user_id").cast("string"))).alias("exception"),
        F.to_variant_object(F.struct(
            "user_id", "event_type", "value",
            F.struct(k.alias("k"), F.struct(F.col("event_type").alias("Kind")).alias("Origin")).alias("Detail"),
            F.array(F.col("user_id").cast("bigint"), k).alias("Items"))).alias("properties"),
        "user_id", "event_type", "value", k.alias("k"))


LEVEL_SQL = """CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'warn' WHEN 'click' THEN 'INF'
    WHEN 'view' THEN 'dbg' ELSE 'Information' END"""

STREAM_SQL = f"""stream AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts, {LEVEL_SQL} AS level,
    CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 2 END AS severity,
    'User ' || user_id || ' did ' || event_type AS message,
    'User {{user_id}} did ' || event_type AS message_template,
    CASE WHEN event_type = 'error' THEN 'TimeoutError: user ' || user_id END AS exception,
    user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

LINE_ID_SQL = """'d' || substr(md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|'
    || CAST(round(l_extendedprice * 100) AS BIGINT) || '|' || CAST(round(l_quantity) AS BIGINT) || '|'
    || date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))), 1, 15)"""

SPANS_SQL = f"""spans AS (
  SELECT *, start + to_microseconds(elapsed_us) AS ts FROM (
  SELECT printf('%032x', n_nationkey + 1) AS trace_id, printf('a%015x', n_nationkey) AS span_id,
    CAST(NULL AS VARCHAR) AS parent_id, TIMESTAMP '1995-01-01' AS start, CAST(220000000000000 AS BIGINT) AS elapsed_us,
    'gateway' AS service, n_name AS message, 'Server' AS span_kind FROM nation
  UNION ALL
  SELECT printf('%032x', c_nationkey + 1), printf('b%015x', c_custkey), printf('a%015x', c_nationkey),
    TIMESTAMP '1995-01-01' + to_microseconds(c_custkey * 1000000), CAST(round(abs(c_acctbal) * 1000) AS BIGINT),
    c_mktsegment, c_name, 'Server' FROM customer
  UNION ALL
  SELECT printf('%032x', c_nationkey + 1), printf('c%015x', o_orderkey), printf('b%015x', o_custkey),
    o_orderdate, CAST(round(o_totalprice * 1000) AS BIGINT), o_orderpriority, 'place order', 'Client'
    FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT printf('%032x', c_nationkey + 1), {LINE_ID_SQL}, printf('c%015x', l_orderkey),
    o_orderdate + to_microseconds(l_linenumber * 1000000), CAST(round(l_quantity * 60000000) AS BIGINT),
    l_returnflag || l_linestatus, 'pick item', 'Internal'
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""

LOGS_SQL = STREAM_SQL + """, logs AS (
  SELECT stream.*, printf('%032x', c_nationkey + 1) AS trace_id, printf('b%015x', user_id) AS span_id
  FROM stream JOIN customer ON user_id = c_custkey)"""

SERIES_SQL = f"""series AS (
  SELECT l_shipdate AS ts, {LINE_ID_SQL} AS id, l_quantity AS quantity,
    l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_linestatus = 'O' THEN l_discount END AS discount,
    l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""

HISTOGRAM_CELLS_SQL = """cells AS (
  SELECT make_timestamp(CAST(floor(epoch_us(ts) / 21600000000) * 21600000000 AS BIGINT)) AS ts, event_type,
    least(floor(value / 10), 20) AS cell, count(*) AS n, min(value) AS low, max(value) AS high
  FROM events GROUP BY 1, 2, 3)"""
