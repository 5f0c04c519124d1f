import random
import re

from pyspark.sql import functions as F

from tracelode.operators.framing import frame_lines, frame_parts
from tracelode.sources.lines import read_lines


def by_hand(lines, start):
    """Records of one source, line by line."""
    frames = []
    for order, line in lines:
        if re.match(start, line):
            frames.append([order, line + "\n", False])
        elif frames and not frames[-1][2]:
            frames[-1][1] += line + "\n"
        else:
            frames.append([order, line + "\n", True])
    return [tuple(f) for f in frames]


def framed(df, start, **options):
    rows = frame_lines(df, start, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["frame_start"])):
        out.setdefault(r["source"], []).append((r["frame_start"], r["text"], r["is_orphan"]))
    return out


def test_trailing_lines(spark):
    lines = ["first", " some more", " and more", "second", "third", " and yet more"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, line_no bigint, line string")
    frames = framed(df, r"\A[a-z]")["s"]
    assert [f[0] for f in frames] == [0, 3, 4]
    assert frames[0][1] == "first\n some more\n and more\n"


def test_orphans_and_block_boundaries(spark):
    random.seed(3)
    sources = {s: [(i, ("+" if random.random() < p else " ") + str(i)) for i in range(400)]
               for s, p in (("often", .5), ("rarely", .01), ("never", 0))}
    rows = [(s, i, x) for s, lines in sources.items() for i, x in lines]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, line_no bigint, line string")
    for width in (1, 7, 1000):
        got = framed(df, r"\A\+", block=F.floor(F.col("line_no") / width))
        assert got == {s: by_hand(lines, r"\+") for s, lines in sources.items()}


def test_line_counts(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(["+a", "b", "+c"])], "source string, line_no bigint, line string")
    assert sorted((r.frame_start, r.n_lines) for r in frame_lines(df, r"\A\+").collect()) == [(0, 2), (2, 1)]


def test_files_split_into_blocks(spark, tmp_path):
    random.seed(5)
    for name in ("log-1.txt", "log-2.txt"):
        lines = [("+" if random.random() < .3 else " ") + f"{name} {i}" for i in range(3000)]
        (tmp_path / name).write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, str(tmp_path / "log-*.txt"))
        assert lines.select("block").distinct().count() > 10
        got = framed(lines, r"\A\+", block="block")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("log-1.txt", "log-2.txt"):
        text = (tmp_path / name).read_text(encoding="utf-8").lstrip("﻿").splitlines()
        expected = [f[1:] for f in by_hand(list(enumerate(text)), r"\+")]
        key = next(k for k in got if k.endswith(name))
        assert [f[1:] for f in got[key]] == expected


def in_parts(frames, size):
    """Texts cut at a length, with the number of lines that end in each part."""
    return sorted((s, at, k, text[i:i + size], text[i:i + size].count("\n"), orphan) for s, own in frames.items() for at, text, orphan in own
                  for k, i in enumerate(range(0, len(text), size)))


def test_records_are_cut_at_a_length(spark):
    random.seed(8)
    sources = {s: [(i, ("+" if random.random() < p else " ") + random.choice(["", "é🙂", "x" * 40, "yz"]) + str(i)) for i in range(300)]
               for s, p in (("often", .5), ("rarely", .02), ("never", 0), ("once", 0))}
    sources["once"][0] = (0, "+begin")
    rows = [(s, i, x) for s, lines in sources.items() for i, x in lines]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, line_no bigint, line string")
    want = {s: by_hand(lines, r"\+") for s, lines in sources.items()}
    for width, size, fragment in ((1, 7, 1 << 20), (7, 50, 20), (1000, 64, 1 << 20), (13, 100_000, 30), (1000, 1, 5)):
        got = frame_parts(df, r"\A\+", block=F.floor(F.col("line_no") / width), max_chars=size, fragment_chars=fragment).collect()
        assert sorted((r.source, r.frame_start, r.part, r.text, r.n_lines, r.is_orphan) for r in got) == in_parts(want, size)


def test_odd_lines(spark):
    rows = [(None, 0, "+a"), (None, 1, None), (None, 2, ""), ("s", 0, None), ("s", 1, "+"), ("s", 1, "+"), (None, 70_000, "b")]
    df = spark.createDataFrame(rows, "source string, line_no bigint, line string")
    got = [(r.source, r.frame_start, r.text, r.n_lines, r.is_orphan) for r in frame_parts(df, r"\A\+").collect()]
    assert (None, 0, "+a\n\n\nb\n", 4, False) in got and ("s", 0, "\n", 1, True) in got
    assert sum(n for *_, n, _ in got) == len(rows)
    assert frame_parts(df.where("false"), r"\A\+").count() == 0
    assert frame_parts(df.where("false"), r"\A\+", max_chars=9).columns == ["source", "frame_start", "text", "n_lines", "is_orphan", "part"]


def test_one_record_of_a_whole_file_stays_in_parts(spark):
    n, size = 1_500_000, 100_000
    line = F.when(F.col("id") == 0, F.lit("+begin")).otherwise(F.concat(F.lit(" at line "), F.col("id").cast("string")))
    df = spark.range(n).select(F.lit("app.log").alias("source"), F.col("id").alias("line_no"), line.alias("line"))
    rows = frame_parts(df, r"\A\+", max_chars=size).select("frame_start", "part", "n_lines", F.length("text").alias("chars"), F.crc32("text").alias("crc")).collect()
    import zlib

    text = "+begin\n" + "".join(f" at line {i}\n" for i in range(1, n))
    assert {r.frame_start for r in rows} == {0} and sum(r.n_lines for r in rows) == n
    want = [text[i:i + size] for i in range(0, len(text), size)]
    assert sorted((r.part, r.chars, r.crc) for r in rows) == [(k, len(t), zlib.crc32(t.encode())) for k, t in enumerate(want)]
