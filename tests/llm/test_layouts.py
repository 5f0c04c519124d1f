"""Selection of mappings by the fingerprint of a record's or a table's own paths."""

import json

from tracelode.llm import chat


def turns(spark, *records):
    frame = spark.createDataFrame([(json.dumps(r),) for r in records], "raw string")
    return sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.turns_of_json(frame, "raw").collect()), key=str)


def test_empty_lists_and_extra_fields(spark):
    message = {"role": "user", "content": "hi", "name": "n"}
    assert turns(spark, {"conv_id": 1, "messages": []}, {"conv_id": 2, "messages": None}) == []
    assert turns(spark, {"conv_id": 3, "system": "s", "messages": []}) == [(3, 0, "system", "s")]
    assert turns(spark, {"conv_id": 4, "messages": [message], "meta": {"a": [1]}, "id": "x"}) == [(4, 0, "user", "hi")]
    assert turns(spark, {"conv_id": 5, "other": []}) == [(5, None, None, None)]


def test_fingerprints_select():
    layouts = chat.Layouts()
    for m in chat.MAPPINGS:
        assert layouts.find(m.paths) == (chat.fingerprint(m.paths), m)
        assert layouts.find((*m.paths, "unknown", "unknown.deeper")) == (chat.fingerprint(m.paths), m)
    assert layouts.find(["conv_id"])[1] is None
    swapped = (chat.Mapping(("a", "conv_id"), turns=(("user", ("a",)),)), chat.Mapping(("b", "conv_id"), turns=(("assistant", ("b",)),)))
    assert [chat.Layouts(swapped).find(["conv_id", x])[1] for x in "ab"] == list(swapped)


def test_table_of_two_layouts_and_repeated_names(spark):
    frame = spark.createDataFrame([(1, 0, "user", "t", "p")], "conv_id bigint, turn bigint, role string, text string, prompt string")
    assert [tuple(r) for r in chat.turns_of_table(frame).collect()] == [(1, 0, "user", "t")]
    twice = frame.select("*", frame["prompt"])
    assert [tuple(r) for r in chat.turns_of_table(twice).collect()] == [(1, 0, "user", "t")]
