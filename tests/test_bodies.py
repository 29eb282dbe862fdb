"""Chat bodies of any shape against a plain rewriting of their objects."""

import json

from pyspark.sql import functions as F

from hearthline.functions import bodies

BLOCK = "<think>why\nnot</think>"


def plain(body):
    value = json.loads(body)
    for message in value.get("messages", []):
        if isinstance(message, dict) and message.get("role") == "assistant" and isinstance(message.get("content"), str):
            message["content"] = message["content"].replace(BLOCK, "").strip()
    return value


def cleaned(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    return [r["body"] for r in bodies.clean(df).orderBy("i").collect()]


def test_only_text_of_assistants_changes(spark):
    said = [f"{BLOCK} hi ", "plain", f'"q" \\ é   {BLOCK}\t', "", BLOCK, [{"type": "text", "text": BLOCK}], None, 5, {"a": BLOCK}, True]
    messages = [{"role": role, "content": c, "n": i} for i, c in enumerate(said) for role in ("assistant", "user", "Assistant", None, 7)]
    messages += [{"role": "assistant"}, {"content": BLOCK}, {}, "loose", None, 3, [BLOCK], {"role": "assistant", "content": BLOCK, "deep": {"x": [1, None, {"y": -0.25}], "big": 2**60}}]
    texts = [json.dumps({"model": "m", "messages": [m], "options": {"t": 0.5, "stop": ["a", None]}}) for m in messages]
    texts.append(json.dumps({"messages": messages, "id": 1, "nothing": None}))
    for got, text in zip(cleaned(spark, texts), texts, strict=True):
        assert json.loads(got) == plain(text)


def test_bodies_without_anything_to_clean_stay_as_they_are(spark):
    texts = [
        None, "", "broken {", "[1, 2]", "5", '{"x":  1.50}', '{"messages": "none"}', '{"messages": null}', '{"messages": []}',
        '{ "messages": [ {"role": "assistant", "content": "clean"} ], "b": 1e3, "a": 2 }', '{"messages": [{"role": "user", "content": "<think>x</think>"}]}',
    ]
    assert cleaned(spark, texts) == texts


def test_outer_keys_keep_their_order(spark):
    text = '{"z":1,"messages":[{"role":"assistant","content":"<think>x</think>y"}],"a":2}'
    assert cleaned(spark, [text]) == ['{"z":1,"messages":[{"content":"y","role":"assistant"}],"a":2}']


def test_cleaning_is_a_projection(spark):
    plan = bodies.clean(spark.range(1).select(F.lit("{}").alias("body")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
