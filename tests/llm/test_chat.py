import hashlib
import json
import random

import oracle
import pytest

from tracelode.llm import chat, registry


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string")


def digest(turns):
    all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_sql_twin(spark):
    con = oracle.duck("/root/testdata/sf0.01")
    assert oracle.compare(con, chat.REPORT_SQL, registry.queries()["op7_chat_layouts"](spark, "/root/testdata/sf0.01")) is None


def test_round_trip_of_any_text():
    r, parts = random.Random(1), ["\\", "#", "###", "### ", "</turn>", "\n", "\n</turn>\n", "a", ":", "é🙂", "<", "/turn>", chat.SAMPLE_TEXT, "### user:\n"]
    turns = [("".join(r.choice(parts) for _ in range(r.randrange(4))), "".join(r.choice(parts) for _ in range(r.randrange(12)))) for _ in range(3000)]
    text = "".join(chat.format_turn(*t)[0] for t in turns)
    read = list(chat.read_turns(text))
    assert [t[:2] for t in read] == turns
    assert all(chat.unescape(text[a:b]) == t for _, t, a, b in read)
    with pytest.raises(ValueError):
        list(chat.read_turns("### user:\nnever closed"))


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 3, "assistant", "x"), (None, None, "user", chat.SAMPLE_TEXT),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, 0, "user", "tie"), (4, 0, "a:\nb\\", "")]
    frame = table(spark, [(*r, "extra") for r in rows])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.formatted(chat.turns_of_table(frame))).collect()}
    assert got == {1: digest([("user", "a"), ("assistant", "b")]), 2: digest([("", "")]), None: digest([("user", chat.SAMPLE_TEXT), ("assistant", "x")]),
                   3: digest([("assistant", "same"), ("assistant", "same"), ("user", "tie")]), 4: digest([("a:\nb\\", "")])}
    assert chat.read_back(chat.formatted(chat.turns_of_table(table(spark, [])))).count() == 0


def test_long_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(c, i, "assistant" if i % 2 else "user", f"t{i} " * 20) for c, n in ((1, 1200), (2, 3), (3, 700)) for i in range(n)]
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.formatted(table(spark, [(*r, "") for r in rows]))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: digest([(r, t) for k, _, r, t in rows if k == c]) for c in (1, 2, 3)}


RECORDS = [
    ({"conv_id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}, [(0, "user", "hi"), (1, "assistant", "ho")]),
    ({"conv_id": 2, "system": "be kind", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
     [(0, "system", "be kind"), (1, "user", "q"), (2, "assistant", "a")]),
    ({"conv_id": 3, "prompt": "p", "completion": "c"}, [(0, "user", "p"), (1, "assistant", "c")]),
    ({"conv_id": 4, "instruction": "do", "input": "", "output": "done"}, [(0, "user", "do"), (1, "assistant", "done")]),
    ({"conv_id": 5, "instruction": "do", "input": "it", "output": None}, [(0, "user", "do\n\nit"), (1, "assistant", "")]),
    ({"conv_id": 6, "turn": 4, "role": "tool", "text": "t"}, [(4, "tool", "t")]),
]


def test_json_records_of_mixed_layouts(spark):
    raw = [json.dumps(r) for r, _ in RECORDS] + ["not json", "[1]", '{"conv_id": 9, "strange": 1}', None]
    rows = chat.turns_of_json(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw").collect()
    got = {}
    for r in rows:
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for record, turns in RECORDS:
        assert sorted(got.pop(record["conv_id"])) == turns
    assert got == {None: [(None, None, None)] * 3, 9: [(None, None, None)]}


@pytest.mark.parametrize("n", range(len(RECORDS)))
def test_tables_of_one_layout(spark, n):
    record, turns = RECORDS[n]
    frame = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"other": 1} | {k: "" for k, v in record.items() if v is None})]))
    assert sorted(map(tuple, chat.turns_of_table(frame).select("turn", "role", "text").collect())) == turns


def test_unknown_table(spark):
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1,)], "conv_id bigint"))
