import json

from common import rows

from ripplemark.llm import chat


def turns(record, name=None):
    _, layout, out = chat.Formatter().convert(json.dumps(record) if not isinstance(record, (str, type(None))) else record)
    assert name in (None, layout)
    return out


def test_layouts():
    want = [("user", "hi"), ("assistant", "yo")]
    assert turns({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages") == want
    assert turns({"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}]}, "message_parts") == want
    assert turns({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "from_value") == want
    assert turns({"turns": [{"speaker": "Human", "text": "hi"}, {"speaker": "BOT", "text": "yo"}]}, "turns") == want
    assert turns({"instruction": "hi", "input": "", "output": "yo"}, "instruction") == want
    assert turns({"instruction": "a", "input": "b", "output": "yo", "system": "s"}) == [("system", "s"), ("user", "a\n\nb"), ("assistant", "yo")]
    assert turns({"prompt": "hi", "response": "yo"}, "prompt_response") == want
    assert turns({"prompt": "hi", "completion": "yo"}, "prompt_completion") == want
    assert turns({"question": "hi", "answer": "yo", "context": "c"}, "question_answer") == [("user", "c\n\nhi"), ("assistant", "yo")]
    assert turns({"text": "yo"}, "text") == [("assistant", "yo")]


def test_what_no_layout_fits():
    assert turns(None, "missing") == turns("{", "invalid") == turns({"a": 1}, "unknown") == turns([1], "unknown") == turns({}, "unknown") == []
    assert turns("[" * 100_000, "invalid") == []
    assert turns({"messages": [None, {"role": None, "content": None}, {"role": "user", "content": "x"}]}, "messages") == [(None, None), ("user", "x")]


def test_surrogates_depth_and_odd_keys():
    assert turns('{"prompt":"\\ud800x","response":"\\ud83d\\ude00"}', "prompt_response") == [("user", "\ufffdx"), ("assistant", "\U0001f600")]
    assert turns({"messages": [{"role": "\ud800", "content": [{"text": "\udfff"}]}]}, "message_parts") == [("\ufffd", "\ufffd")]
    assert turns({"prompt": 1, "response": ["\udfff"]}, "unknown") == [] and turns({"prompt": "", "response": 1.5}) == [("user", ""), ("assistant", "1.5")]
    deep = '{"a":' * 1200 + "1" + "}" * 1200
    assert turns(deep, "unknown") == []
    assert turns('{"text":' + deep + "}", "unknown") == []
    assert chat.Formatter().convert('{"text":"x","a":' + "[" * 5000 + "]" * 5000 + "}")[1] in ("text", "invalid")
    for record in ({"messages[]": {"role": "user", "content": "x"}}, {"messages[].role": 1, "messages[].content": 2}, {"messages[].role": {"content": 1}}, {"a.b": 1}, {"": {"": 1}}):
        assert turns(record, "unknown") == []
    f = lambda x: chat.fingerprint(chat.paths(x))
    assert len({f({"a.b": 1}), f({"a": {"b": 1}}), f({"a\\.b": 1}), f({"": {"a": 1}}), f({"a": 1}), f({"a[]": 1}), f({"a": [1]})}) == 7


def test_fingerprints_depend_on_paths_only():
    f = lambda x: chat.fingerprint(chat.paths(x))
    assert f({"a": 1, "b": [{"c": 2}]}) == f({"b": [{"c": "x"}, {"c": None}], "a": []}) != f({"a": 1, "b": {"c": 2}})


def test_odd_rows_and_extra_columns(spark):
    records = [(1, '{"prompt":"p","response":null}'), (1, '{"prompt":"p","response":null}'), (None, '{"text":""}'), (2, None), (3, "")]
    df = spark.createDataFrame(records, "conv_id bigint, record string").selectExpr("*", "1 as id", "2 as turns", "3 as layout")
    got = rows(chat.format_chats(df, "conv_id").selectExpr("conv_id", "layout", "size(turns)"))
    assert got == sorted([(1, "prompt_response", 2)] * 2 + [(None, "text", 1), (2, "missing", 0), (3, "invalid", 0)], key=repr)
    assert rows(chat.format_chats(df.limit(0), "conv_id")) == []


def test_conversations_come_back_as_they_were(spark):
    data = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "x"), (3, 0, "system", ""), (3, 1, "user", "u"), (3, 2, "assistant", "x")]
    data += [(4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (5, 0, "tool", 'q"\n'), (5, 1, None, "z"), (6, 0, "user", "w " * 50_000), (8, 0, "assistant", "t"), (9, 0, "assistant", None), (None, 0, "user", "n"), (7, None, "user", "x"), (7, None, "user", "x")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(chat.conversation_records(df), "conv_id").selectExpr("conv_id", "inline(turns)")
    want = sorted(((c, None if c == 7 else t, r, x) for c, t, r, x in data), key=repr)
    got = sorted(((r[0], None if r[0] == 7 else r[1], r[2], r[3]) for r in out.collect()), key=repr)
    assert got == want


def test_every_layout_is_met(spark):
    data = [(c, i, r, "x") for c in range(6) for i, r in enumerate(("user", "assistant"))] + [(c, i, r, "x") for c in (10, 11) for i, r in enumerate(("user", "assistant", "user"))]
    data += [(12, 0, "assistant", "x"), *((13, i, r, "x") for i, r in enumerate(("system", "user", "assistant"))), (14, 0, "tool", "x"), (15, 0, "tool", "x")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    assert {r[0] for r in chat.format_chats(chat.conversation_records(df), "conv_id").select("layout").collect()} == {x.name for x in chat.LAYOUTS}
