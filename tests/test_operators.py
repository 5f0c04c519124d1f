import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tracelode.functions import aggregates as a
from tracelode.functions.values import prop
from tracelode.operators import alerts, charts, discovery, filters, joins, lifecycle, metrics as m, query as q, sinks, tracing
from tracelode.operators.percentiles import nearest_rank
from tracelode.operators.signals import Signal, catalogue, intersect


def ranked(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values) / 100)) - 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_of_skewed_groups(spark, seed):
    random.seed(seed)
    rows = [("hot", random.gauss(0, 100)) for _ in range(4000)] + [("cold", float(random.randrange(5))) for _ in range(50)]
    rows += [(None, 7.0), ("nulls", None), ("one", -3.25)]
    wanted = {"p0": 0, "p50": 50, "p95": 95, "p100": 100}
    got = {r.k: r for r in nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), wanted).collect()}
    assert set(got) == {"hot", "cold", None, "one"}
    for key, row in got.items():
        values = [v for k, v in rows if k == key and v is not None]
        assert {n: row[n] for n in wanted} == {n: ranked(values, p) for n, p in wanted.items()}


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([(1.0, 10), (5.0, 85), (9.0, 5), (100.0, 0)], "v double, n int")
    row = m.phist(df, F.col("v"), F.col("n"), {"p10": 10, "p11": 11, "p95": 95, "p96": 96}).first()
    assert tuple(row) == (1.0, 5.0, 5.0, 9.0)


def test_group_by_forms(spark):
    df = spark.createDataFrame([("A", 1.0), ("a", 2.0), (None, 3.0), ("b", 4.0)], "k string, v double")
    rows = q.group_by(df, "k", {"n": a.count_all()}, {"p50": (F.col("v"), 50)}, ci=("k",)).collect()
    assert {tuple(r) for r in rows} == {("A", 2, 1.0), (None, 1, 3.0), ("b", 1, 4.0)}
    assert q.group_by(df, percentiles={"p": (F.col("v"), 100)}).first().p == 4.0
    assert sorted(str(r.k) for r in q.group_by(df, "k").collect()) == ["A", "None", "a", "b"]
    both = q.group_by(df, aggs={"n": a.count_all()}, percentiles={"p": (F.col("v"), 50), "w": (F.col("v") * 2, 50)}).first()
    assert tuple(both) == (4, 2.0, 4.0)


def events(spark, rows):
    return spark.createDataFrame([(f"{i:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), level, value)
                                  for i, (minute, level, value) in enumerate(rows)], "id string, ts timestamp, level string, value double")


def test_slices_are_anchored_and_filled(spark):
    df = events(spark, [(5, "a", 1.0), (65, "a", 2.0), (200, "b", 3.0)])
    start, end = "2024-01-01 00:05:00", "2024-01-01 04:00:00"
    rows = q.time_slices(df, "1h", start, end, aggs={"n": a.count_all()}, fill=True).orderBy("time").collect()
    assert [(r.time.hour, r.time.minute, r.n) for r in rows] == [(0, 5, 1), (1, 5, 1), (2, 5, None), (3, 5, 1)]
    keyed = q.time_slices(df, "1h", start, end, by="level", aggs={"n": a.count_all()}, fill=True)
    assert keyed.count() == 8 and keyed.columns == ["level", "time", "n"]
    with pytest.raises(ValueError):
        q.time_slices(df, "1h", start, fill=True)
    early = q.time_slices(df, "1h", aggs={"n": a.count_all()}).orderBy("time").first()
    assert early.time == dt.datetime(2024, 1, 1)


def test_gaps_are_filled_between_slices_of_a_key(spark):
    df = events(spark, [(5, "a", 1.0), (245, "a", 2.0), (10, "b", 3.0), (130, None, 4.0), (10, None, 5.0)])
    rows = q.time_slices(df, "1h", by="level", aggs={"n": a.count_all(), "high": F.max("value")}, fill="gaps", carry=("high",)).collect()
    got = sorted(((r.level or "", r.time.hour, r.n, r.high) for r in rows), key=str)
    assert got == sorted([("a", 0, 1, 1.0), ("a", 1, None, 1.0), ("a", 2, None, 1.0), ("a", 3, None, 1.0), ("a", 4, 1, 2.0), ("b", 0, 1, 3.0),
                          ("", 0, 1, 5.0), ("", 1, None, 5.0), ("", 2, 1, 4.0)], key=str)
    alone = q.fill_gaps(q.time_slices(df, "1h", aggs={"n": a.count_all()}), "1h").orderBy("time").collect()
    assert [(r.time.hour, r.n) for r in alone] == [(0, 3), (1, None), (2, 1), (3, None), (4, 1)]
    assert q.fill_gaps(q.time_slices(df.where("false"), "1h", by="level", aggs={"n": a.count_all()}), "1h", "level").count() == 0
    untimed = spark.createDataFrame([("a", None, 1), ("a", dt.datetime(2024, 1, 1), 2)], "level string, time timestamp, n int")
    assert sorted(r.n for r in q.fill_gaps(untimed, "1h", "level").collect()) == [1, 2]
    far = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1), ("a", dt.datetime(2024, 1, 1, 1), 2)] + [(f"k{i}", dt.datetime(2020, 1, 1), 1) for i in range(500)],
                                "level string, time timestamp, n int")
    assert q.fill_gaps(far, "1h", "level").count() == 502  # no key is paired with a range


def test_first_last_with_ties(spark):
    df = events(spark, [(1, "a", 1.0), (1, "a", 2.0), (0, "b", 9.0)])
    row = df.agg(a.first_of(F.col("value")).alias("f"), a.last_of(F.col("value")).alias("l")).first()
    assert tuple(row) == (9.0, 2.0)
    assert [r.value for r in q.top_n(df, F.col("value"), 2, by="level").orderBy("level", "position").collect()] == [1.0, 2.0, 9.0]
    big = q.bottom_n(df, F.col("value"), 5000).orderBy("position").collect()
    assert [r.value for r in big] == [2.0, 1.0, 9.0]


def test_search_bounds(spark):
    df = events(spark, [(0, "Error", 1.0), (10, "info", 2.0), (20, "ERR", 3.0), (30, "Error", 4.0)])
    found = filters.search(df, start="2024-01-01 00:00:00", end="2024-01-01 00:30:00", signal=catalogue()["Errors"])
    assert [r.value for r in found.collect()] == [3.0, 1.0]
    with pytest.raises(ValueError):
        filters.bounded(df)


def test_partitions_are_pruned(spark, tmp_path):
    df = events(spark, [(i * 300, "a", float(i)) for i in range(40)])
    sinks.write_events(df, str(tmp_path / "t"))
    table = filters.time_range(sinks.read_events(spark, str(tmp_path / "t")), "2024-01-02", "2024-01-03")
    plan = table._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "event_date" in scan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(ts" in scan
    assert table.count() == sum(1 for i in range(40) if 1440 <= i * 300 < 2880)


def test_signals(spark):
    rows = [(i, level, None) for i, level in enumerate(["Information", "Information", "Warning", "Warning", "Error"])]
    df = spark.createDataFrame(rows, "n int, level string, start timestamp").withColumn("span_id", F.lit(None).cast("string"))
    s = catalogue()

    def n(signal):
        return filters.apply_signal(df, signal).count()

    assert n(s["Errors"] | s["Warnings"]) == 3 and n(s["Warnings"] & s["Logs"]) == 2
    assert n(s["Spans"] | s["Errors"]) == 1 and n((s["Errors"] | s["Warnings"]) & s["Logs"]) == 3
    assert n(intersect(None, s["Logs"], None)) == 5 and intersect(None, None) is None


def test_nested_orders(spark):
    text = ['{"OrderNumber":1,"RunId":"r","Amount":1,"Customer":{"Name":"Ann","Tier":"gold","Address":{"City":"X"}}}',
            '{"OrderNumber":2,"RunId":"r","Amount":2,"Customer":{"Name":"Bob","Tier":"silver","Address":{"City":"Y"}}}',
            '{"OrderNumber":3,"RunId":"r","Amount":3,"Customer":{"Name":"Carol","Tier":"gold","Address":{"City":"X"}}}']
    df = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1, i), x) for i, x in enumerate(text)], "id string, ts timestamp, p string")
    df = df.withColumn("properties", F.parse_json("p"))
    gold = filters.search(df, prop("Customer.Tier") == "gold").select(prop("Customer.Name").alias("name")).collect()
    assert [r.name for r in gold] == ["Carol", "Ann"]
    paths = [r.path for r in discovery.property_paths(df).collect()]
    assert "Customer.Address.City" in paths and paths == sorted(paths) and len(paths) == len(set(paths)) == 8
    assert df.agg(a.sum_of(prop("Amount", "double")).alias("x")).first().x == 6


def test_path_places_and_depth(spark):
    df = spark.range(1).select(F.parse_json(F.lit('{"UserId":1,"a b":2,"and":{"x":1}}')).alias("properties"),
                               F.parse_json(F.lit('{"name":"s"}')).alias("scope"),
                               F.parse_json(F.lit('{"service":{"name":"web","l3":{"l4":{"l5":{"l6":{"l7":1}}}}}}}')).alias("resource"))
    paths = {r.path for r in discovery.property_paths(df).collect()}
    top = {r.path for r in discovery.property_paths(df, 1).collect()}
    assert top == {"UserId", "@Properties['a b']", "@Properties.and", "@Scope.name", "@Resource.service"}
    assert paths == {"UserId", "@Properties['a b']", "@Properties.and", "@Properties.and.x", "@Scope.name", "@Resource.service", "@Resource.service.name",
                     "@Resource.service.l3", "@Resource.service.l3.l4", "@Resource.service.l3.l4.l5", "@Resource.service.l3.l4.l5.l6",
                     "@Resource.service.l3.l4.l5.l6.l7"}
    assert {r.name for r in discovery.available_properties(df).collect()} == {"UserId", "a b", "and"}


def samples(spark):
    text = [('{"a":1,"b":2}', '{"a":{"kind":"Sum","description":"xyz"}}'), ('{"a":1,"c":3,"d":4}', '{"a":{"kind":"Sum","description":"xyz"}}'),
            ('{"a":1,"b":5,"e":6}', '{"a":{"kind":"Sum","description":"xyz"},"e":{"kind":"Sum","description":"ghi"}}')]
    df = spark.createDataFrame(text, "p string, d string")
    return df.select(F.lit("2024-01-01").cast("timestamp").alias("ts"), F.parse_json("p").alias("properties"), F.from_json(
        "d", "map<string,struct<kind:string,unit:string,description:string>>").alias("definitions"))


def test_metric_catalogue(spark):
    series, b = samples(spark), {"b": prop("b", "int")}
    assert m.metric_definitions(series).count() == 2
    assert m.metric_definitions(series, groups=b).count() == 4
    assert m.metric_definitions(series, F.col("description") == "xyz", groups=b).count() == 3
    assert m.search_metrics(series, "GH").count() == 1
    assert [r.dimension for r in m.metric_dimensions(series).orderBy("dimension").collect()] == ["b", "c", "d"]
    assert [r.dimension for r in m.metric_dimensions(series, "e").collect()] == ["b"]
    assert sorted(r.value for r in m.dimension_values(series, prop("b", "int")).collect()) == [2, 5]
    nested = spark.range(1).select(
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.parse_json(F.lit('{"http":{"server":{"duration":{"buckets":[],"count":1}},"route":"/"},"odd name":1}')).alias("properties"),
        F.parse_json(F.lit('{"service":{"name":"cart"}}')).alias("resource"),
        F.from_json(F.lit('{"http.server.duration":{"kind":"Fixed"}}'), "map<string,struct<kind:string,unit:string,description:string>>").alias("definitions"))
    assert [r.dimension for r in m.metric_dimensions(nested, "http.server.duration").orderBy("dimension").collect()] == [
        "@Properties['odd name']", "@Resource.service.name", "http.route"]


def test_exponential_histogram(spark):
    random.seed(4)
    values = [random.lognormvariate(3, 2) for _ in range(3000)]
    df = spark.createDataFrame([("k", v) for v in values] + [("few", 1.0), ("few", 1.0), ("few", 2.0), ("few", 0.0)], "k string, v double")
    rows = {r.k: r.histogram for r in m.build_exp_histogram(df, F.col("v"), "k").collect()}
    h = rows["k"]
    assert len(h.buckets) <= 160 and h["count"] == 3000 == sum(b["count"] for b in h.buckets)
    assert h.min == min(values) and h.max == max(values)
    scale = h.scale

    def index(v, s):
        return math.ceil(math.log2(v) * 2 ** s)

    expected = {}
    for v in values:
        expected[index(v, scale)] = expected.get(index(v, scale), 0) + 1
    assert [b["count"] for b in h.buckets] == [expected[i] for i in sorted(expected)]
    assert len({index(v, scale + 1) for v in values}) > 160
    few = rows["few"]
    assert few.scale == 20 and [b["count"] for b in few.buckets] == [2, 1]
    assert few.buckets[1]["midpoint"] == pytest.approx(2.0, rel=1e-5)


def test_downscaling_matches_building(spark):
    random.seed(6)
    df = spark.createDataFrame([(random.uniform(0.01, 900),) for _ in range(2000)], "v double")
    fine = m.build_exp_histogram(df, F.col("v"), scale=6, target_buckets=100_000)
    small = m.downscale_exp_histogram(fine, target_buckets=40).first().histogram
    direct = m.build_exp_histogram(df, F.col("v"), scale=6, target_buckets=40).first().histogram
    assert small.scale == direct.scale and [b["count"] for b in small.buckets] == [b["count"] for b in direct.buckets]
    assert [b["midpoint"] for b in small.buckets] == pytest.approx([b["midpoint"] for b in direct.buckets])


def test_merged_exp_histograms_equal_that_of_the_values(spark):
    random.seed(3)
    rows = [(k, part, random.lognormvariate(0, spread)) for k, spread in (("wide", 6.0), ("narrow", 0.001), (None, 1.0))
            for part in range(7) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, part int, v double")
    parts = m.build_exp_histogram(df.where("part < 3"), F.col("v"), ["k", "part"], scale=14)
    parts = parts.unionByName(m.build_exp_histogram(df.where("part >= 3"), F.col("v"), ["k", "part"], scale=9, target_buckets=40))
    parts = parts.unionByName(parts.limit(1).select(
        F.lit("none").alias("k"), F.lit(0).alias("part"), F.lit(None).cast(parts.schema["histogram"].dataType).alias("histogram"), F.lit(1.0).alias("sum")))
    # The narrow group stays at its lowest scale, the wide one falls under those of its parts.
    lowest = {r.k: r.s for r in parts.groupBy("k").agg(F.min("histogram.scale").alias("s")).collect()}
    merged = {r.k: r for r in m.merge_exp_histograms(parts, total=F.col("sum"), keys="k").collect()}
    assert set(merged) == {"wide", "narrow", None}
    for key, row in merged.items():
        values = [v for k, _, v in rows if k == key]
        h, at = row.histogram, row.histogram.scale
        assert at <= lowest[key] and len(h.buckets) <= 160

        def counts(scale):
            out = {}
            for v in values:
                i = math.ceil(math.log2(v) * 2.0 ** scale)
                out[i] = out.get(i, 0) + 1
            return out

        assert [b["count"] for b in h.buckets] == [n for _, n in sorted(counts(at).items())]
        assert at == lowest[key] or len(counts(at + 1)) > 160
        assert (h.min, h.max, h["count"]) == (min(values), max(values), len(values)) and row.sum == pytest.approx(sum(values))
    one = m.merge_exp_histograms(parts).first()
    assert one.histogram["count"] == len(rows) and one.sum is None
    # Merges of merges give the same.
    twice = m.merge_exp_histograms(m.merge_exp_histograms(parts, total=F.col("sum"), keys=["k", "part"]), total=F.col("sum"), keys="k")
    assert {r.k: r.histogram for r in twice.collect()} == {k: r.histogram for k, r in merged.items()}
    assert m.merge_exp_histograms(parts.limit(0), keys="k").count() == 0


def spans(spark, rows):
    return spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")


def test_deep_tree_cycles_and_missing_parents(spark):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(37)]
    loop = [("u", "a", "b"), ("u", "b", "a"), ("u", "c", "b")]
    lost = [("v", "x", "gone"), ("v", "y", "x"), ("t2", "s1", None)]
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in tracing.trace_tree(spans(spark, chain + loop + lost)).collect()}
    for i in range(37):
        assert got[("t", f"s{i}")] == (i, "/".join(f"s{j}" for j in range(i + 1)))
    assert got[("u", "a")] == got[("u", "b")] == got[("u", "c")] == (None, None)
    assert got[("v", "x")] == (0, "x") and got[("v", "y")] == (1, "x/y") and got[("t2", "s1")] == (0, "s1")


def test_spans_without_children_stay_out_of_the_rounds(spark, monkeypatch):
    rows = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(9)] + [("t", f"leaf{i}", f"s{i % 9}") for i in range(90)]
    rows += [("t", "alone", None), ("t", "lost", "gone"), ("u", "a", "b"), ("u", "b", "a"), ("u", "leaf", "a"), ("t", "leaf0", "s0"), (None, "x", None)]
    written, cut = [], tracing.cut_lineage
    def counted(df, label="step"):
        table = cut(df, label)
        written.append((label, table.count()))
        return table
    monkeypatch.setattr(tracing, "cut_lineage", counted)
    got = {(r.trace_id, r.span_id): (r.depth, r.path) for r in tracing.trace_tree(spans(spark, rows)).collect()}
    way = lambda i: "/".join(f"s{j}" for j in range(i + 1))
    assert len(got) == 105 and all(got[("t", f"leaf{i}")] == (i % 9 + 1, f"{way(i % 9)}/leaf{i}") for i in range(90))
    assert got[("t", "alone")] == (0, "alone") and got[("t", "lost")] == (0, "lost") and got[(None, "x")] == (0, "x")
    assert got[("u", "leaf")] == got[("u", "a")] == (None, None) and got[("t", "s8")] == (8, way(8))
    rounds = [n for label, n in written if label == "trace-tree"]
    assert 0 < len(rounds) <= 6 and max(rounds) <= 11


def test_span_joins(spark):
    df = spans(spark, [("t", "a", None), ("t", "b", "a"), ("t", "c", "zz"), ("u", "b", "a")]).withColumns(
        {"service": F.col("span_id"), "message": F.lit("m"), "start": F.lit(None).cast("timestamp")})
    parents = {(r.trace_id, r.span_id): r.parent_service for r in joins.span_parents(df).collect()}
    assert parents == {("t", "a"): None, ("t", "b"): "a", ("t", "c"): None, ("u", "b"): None}
    assert {(r.trace_id, r.span_id) for r in joins.orphan_spans(df).collect()} == {("t", "c"), ("u", "b")}
    assert joins.traces_with(df, F.col("span_id") == "c").count() == 3


def test_unnest_drops_rows_without_elements(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, items array<int>")
    assert sorted(tuple(r) for r in joins.lateral_unnest(df, "items", "x").select("id", "x").collect()) == [(1, 1), (1, 2)]


def test_elements_of_rows_brought_together_are_counted_in_place(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_BYTES", 16)
    df = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "b b b b b b b b"), (None, "a"), (None, "a"), (3, None)], "id int, text string")
    words = joins.lateral_unnest(joins.brought_together(df, "id", "text"), F.split("text", " "), "word")
    counts = words.groupBy("id", "word").count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(id" in plan
    assert {tuple(r) for r in counts.collect()} == {(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "b", 8), (None, "a", 2)}
    assert joins.brought_together(df, "id", "text").rdd.getNumPartitions() == 2
    assert joins.brought_together(df.limit(0), "id", "text").count() == 0


def test_deletion_from_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i * 480, "web" if i % 2 else "db", float(i)) for i in range(12)]
    sinks.write_events(events(spark, rows), path)
    assert lifecycle.delete_from_table(spark, path, F.col("level") == "web", start="2024-01-02") == 5
    left = spark.read.parquet(path)
    assert sorted(r.value for r in left.collect()) == [0.0, 1.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert lifecycle.delete_from_table(spark, path, end="2024-01-02") == 3
    assert {str(r.event_date) for r in spark.read.parquet(path).collect()} == {"2024-01-02", "2024-01-03", "2024-01-04"}
    gone = lifecycle.retain_in_table(spark, path, [lifecycle.RetentionPolicy("1d", Signal("x", F.col("value") < 7))], dt.datetime(2024, 1, 4, 1))
    assert gone == 2 and sorted(r.value for r in spark.read.parquet(path).collect()) == [8.0, 10.0]
    assert lifecycle.delete_from_table(spark, path, F.col("value") > 1e9) == 0


def test_deletion_by_filter_and_range(spark):
    df = events(spark, [(0, "h1", 1.0), (0, "h2", 2.0), (60, "h1", 3.0), (60, "h2", 4.0)])
    assert lifecycle.delete_events(df, F.col("level") == "h1").count() == 2
    assert lifecycle.delete_events(df, start="2024-01-01", end="2024-01-01 01:00:00").count() == 2
    assert lifecycle.delete_events(df, F.lit(None).cast("boolean")).count() == 4


def test_retention_rules(spark):
    with pytest.raises(ValueError):
        lifecycle.RetentionPolicy("1d", F.lit(True), "series")
    with pytest.raises(ValueError):
        lifecycle.RetentionPolicy("1d", source="elsewhere")
    df = events(spark, [(0, "a", 1.0), (3000, "a", 2.0)])
    policies = [lifecycle.RetentionPolicy("1d"), lifecycle.RetentionPolicy("1h", source="series")]
    assert lifecycle.apply_retention(df, policies, "2024-01-03").count() == 1
    assert lifecycle.apply_retention(df, policies, "2024-01-03", source="series").count() == 1


@pytest.mark.parametrize("every, start", [
    ("1d", (2024, 5, 3, 0, 0, 0)), ("6h", (2024, 5, 3, 13, 0, 0)), ("5m", (2024, 5, 3, 13, 14, 0)), ("10s", (2024, 5, 3, 13, 14, 15)),
    (None, (2024, 5, 3, 13, 14, 15, 500))])
def test_chart_ranges(every, start):
    now = dt.datetime(2024, 5, 4, 13, 14, 15, 500)
    assert charts.chart_range(now, "1d", every) == (dt.datetime(*start), now)


def test_chart_order_and_cap(spark):
    df = events(spark, [(i, "a" if i % 2 else "b", float(i)) for i in range(10)])
    chart = charts.Chart("c", {"n": a.count_all()}, group_by={"level": F.col("level")}, order_by=(F.col("n").desc(), "level"), limit=1)
    assert charts.render_chart(df, chart).collect() == [("a", 5)]
    flat = charts.flatten_result(charts.render_chart(df, chart, "2024-01-01", "2024-01-02", every="1h"), ["level"], ["n"])
    assert flat.columns == ["level", "time", "n"]


def test_alert_levels_disabled_and_suppression(spark):
    df = events(spark, [(x, "Error", 1.0) for x in (0, 3, 9, 10, 12, 25)])
    alert = alerts.Alert("x", "1m", F.col("n") > 0, {"n": a.count_all()}, suppression="10m", channels=("c1", "c2"), level="wrn")
    rows = alerts.raise_alert(df, alert).orderBy("time", "channel").collect()
    assert [(r.time.minute, r.channel) for r in rows] == [(x, c) for x in (0, 10, 25) for c in ("c1", "c2")]
    assert {r.level for r in rows} == {"Warning"} and {r.event_type_id for r in rows} == {0xA1E77001}
    off = alerts.Alert("x", "1m", F.col("n") > 0, {"n": a.count_all()}, disabled=True)
    assert alerts.evaluate_alert(df, off).count() == 0


def test_suppression_is_per_alert_not_per_group(spark):
    rows = [("a", "g1", 0), ("a", "g2", 1), ("b", "g1", 1), ("a", "g1", 10)]
    df = spark.createDataFrame([(x, g, dt.datetime(2024, 1, 1, 0, k)) for x, g, k in rows], "alert string, g string, time timestamp")
    assert {(r.alert, r.g, r.time.minute) for r in alerts.suppress(df, "10m").collect()} == {("a", "g1", 0), ("b", "g1", 1), ("a", "g1", 10)}


def test_builder(spark):
    from tracelode.operators.builder import query

    df = events(spark, [(i, "Error" if i % 3 else "info", float(i)) for i in range(30)])
    with pytest.raises(ValueError):
        query(df).measure(n=a.count_all()).rows()
    assert query(df).unbounded().measure(n=a.count_all()).rows().first().n == 30
    assert query(df).with_id("0004").rows().first().value == 4.0
    rows = query(df).between("2024-01-01").where(F.col("level") == "Error").select("value").limit(2).rows().collect()
    assert [r.value for r in rows] == [1.0, 2.0]
    grouped = (query(df).between("2024-01-01").group("level", ci=("level",)).measure(n=a.count_all()).percentile(p50=(F.col("value"), 50))
               .having(F.col("n") > 1).order_by(F.col("n").desc()).rows().collect())
    assert [tuple(r) for r in grouped] == [("Error", 20, 14.0), ("info", 10, 12.0)]
    sliced = query(df).between("2024-01-01", "2024-01-01 00:40:00").every("10m", fill=True).measure(n=a.count_all()).rows().collect()
    assert [r.n for r in sliced] == [10, 10, 10, None]


def test_percentiles_of_large_offsets(spark):
    base = 1.7e15
    df = spark.createDataFrame([("k", base + i * 1000.0) for i in range(5000)], "k string, v double")
    row = nearest_rank(df, ["k"], F.col("v"), {"p50": 50, "p99": 99}).first()
    assert (row.p50, row.p99) == (base + 2499 * 1000, base + 4949 * 1000)


def pushed(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("PushedFilters: [") + 16:].split("]")[0]


def test_signals_reach_the_scan(spark, tmp_path):
    from tracelode.operators.signals import Signal, catalogue

    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("event_type_id"), F.lit(None).cast("string").alias("exception"),
                                  F.lit(None).cast("timestamp").alias("start"), F.current_timestamp().alias("ts"))
    rows.write.parquet(str(tmp_path / "events"))
    table = spark.read.parquet(str(tmp_path / "events"))
    five, odd = Signal("five", F.col("event_type_id") == 5), Signal("odd", F.col("event_type_id").isin(1, 5))
    assert "EqualTo(event_type_id,5)" in pushed(filters.apply_signal(table, five))
    both = pushed(filters.apply_signal(table, five & catalogue()["Logs"]))
    assert "EqualTo(event_type_id,5)" in both and "IsNull(start)" in both
    assert "Or(" in pushed(filters.apply_signal(table, five | odd))
    assert "EqualTo(event_type_id,5)" in pushed(filters.search(table, signal=five & odd))
    # Undefined values still neither match nor poison.
    undefined = Signal("undefined", F.col("exception") == "x")
    assert [r.id for r in filters.apply_signal(table, undefined | five).collect()] == ["5"]
    assert filters.apply_signal(table, undefined & five).count() == 0


def test_percentiles_of_close_values(spark):
    from tracelode.operators import percentiles

    rows = spark.range(200_000).select((F.lit(8.0e9) + F.col("id") * 5).alias("v"), F.lit("k").alias("k"))
    got = percentiles.nearest_rank(rows, ["k"], F.col("v"), {"p1": 1, "p50": 50, "p100": 100}).first()
    assert (got.p1, got.p50, got.p100) == (8.0e9 + 1999 * 5, 8.0e9 + 99_999 * 5, 8.0e9 + 199_999 * 5)
    band = rows.select(percentiles.magnitude_band(F.col("v")).alias("b"), "v").groupBy("b").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    parts = rows.select("v", percentiles.magnitude_band(F.col("v")).alias("b")).join(band, "b").select(
        "b", F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * percentiles.PARTS).alias("p"))
    assert parts.groupBy("b", "p").count().agg(F.max("count")).first()[0] <= 20


def test_repeated_spans_do_not_multiply(spark):
    from tracelode.operators import joins, tracing

    rows = [("t", "a", None, "web", "old", 1), ("t", "a", None, "web", "new", 2), ("t", "b", "a", "db", "call", 3)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, service string, message string, n int").withColumn(
        "ts", F.timestamp_seconds("n")).withColumn("start", F.col("ts"))
    found = joins.span_parents(spans, ("message",)).where("span_id = 'b'").collect()
    assert [r.parent_message for r in found] == ["new"]
    logs = spark.createDataFrame([("t", "a", 1)], "trace_id string, span_id string, log int")
    assert [r.span_message for r in joins.logs_in_spans(logs, spans, ("message",)).collect()] == ["new"]
    assert sorted((r.span_id, r.depth, r.path) for r in tracing.trace_tree(spans).collect()) == [("a", 0, "a"), ("b", 1, "a/b")]
