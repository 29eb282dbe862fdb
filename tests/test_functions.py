"""Literal cases of the column functions."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from hearthline.functions import text, units

C = F.col


def values(spark, function, inputs, kind="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(function(C("x"))).collect()]


BYTES = [
    (0, 1, "0 B"), (512, 1, "512 B"), (1024, 1, "1 KB"), (1024**2, 1, "1 MB"), (1024**3, 1, "1 GB"),
    (1024**4, 1, "1 TB"), (1536, 1, "1.5 KB"), (1536, 2, "1.5 KB"), (20 * 1024**3, 1, "20 GB"),
    (1024**2 - 1, 1, "1024 KB"), (1024**5, 1, "1024 TB"), (1100, 2, "1.07 KB"), (10240, 0, "10 KB"),
    (-1, 1, None), (None, 1, None), (107374182400, 1, "100 GB"),
]


@pytest.mark.parametrize("size,decimals,shown", BYTES)
def test_format_bytes(spark, size, decimals, shown):
    assert values(spark, lambda c: units.format_bytes(c, decimals), [size], "bigint") == [shown]


THINKING = [
    ("<think>a</think>b", "b"),
    ("<THINK>a</thinking> b ", "b"),
    ("x<think>1</think>y<thinking>2</thinking>z", "xyz"),
    ("<think>a<think>b</think>c</think>", "c</think>"),
    ("<think>open", "<think>open"),
    ("<think id=1>a</think>b", "<think id=1>a</think>b"),
    ("  \nhi\t", "hi"),
    ("<think>only</think>", ""),
    ("<think>\nline\n</think>\n\nanswer", "answer"),
    (None, None),
]


def test_strip_thinking(spark):
    got = values(spark, text.strip_thinking, [x for x, _ in THINKING])
    assert got == [want for _, want in THINKING]


def test_strip_thinking_in_sql_is_the_same(spark):
    text.register_sql(spark)
    rows = spark.createDataFrame(list(enumerate(x for x, _ in THINKING)), "i int, x string")
    got = [r[0] for r in rows.orderBy("i").selectExpr("strip_thinking(x)").collect()]
    assert got == [want for _, want in THINKING]


def test_strip_thinking_on_random_texts(spark):
    rng = random.Random(5)
    pieces = ["<think>", "</think>", "<THINKING>", "</Thinking>", "<think ", "a", "\n", " ", "é", "\u2003"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(500)]
    want = [
        re.sub("<think(?:ing)?>.*?</think(?:ing)?>", "", t, flags=re.S | re.I).strip() for t in texts
    ]
    assert values(spark, text.strip_thinking, texts) == want


def test_cleaning_twice_differs_only_for_nested_blocks(spark):
    texts = ["<think>a</think>b", "x <think>1</think> y", "<think>open", " a "]
    once = values(spark, text.strip_thinking, texts)
    assert values(spark, text.strip_thinking, once) == once
    nested = "<thi<think>a</think>nk>b</think>c"
    assert values(spark, text.strip_thinking, [nested]) == ["<think>b</think>c"]
    assert values(spark, lambda c: text.strip_thinking(text.strip_thinking(c)), [nested]) == ["c"]


def test_format_bytes_on_random_sizes(spark):
    rng = random.Random(6)
    sizes = [int(2 ** rng.uniform(0, 52)) for _ in range(500)]

    def shown(size):
        power = max(p for p in range(5) if size >= 1024**p)
        value = (Decimal(size) / 1024**power).quantize(Decimal("0.1"), ROUND_HALF_UP)
        return f"{value:f}".removesuffix(".0") + " " + ["B", "KB", "MB", "GB", "TB"][power]

    assert values(spark, units.format_bytes, sizes, "bigint") == [shown(s) for s in sizes]


def test_strip_ws_takes_what_python_takes(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i).strip() == ""]
    inputs = [s + "a" + s + "b" + s for s in spaces] + ["​a​", "", "plain"]
    assert values(spark, text.strip_ws, inputs) == [x.strip() for x in inputs]


def test_latency_band_edges(spark):
    got = values(spark, units.latency_band, [0.0, 99.99, 100.0, 299.99, 300.0, None], "double")
    assert got == ["go", "go", "warn", "warn", "stop", None]


def test_try_int(spark):
    got = values(spark, text.try_int, ["12", " -7 ", "+3", "12.5", "n/a", "", None, "9" * 30])
    assert got == [12, -7, 3, None, None, None, None, None]


def test_is_json(spark):
    bodies = ['{"a":1}', "[1]", "1", '"x"', "null", '{"a":1} x', '1,"w":2', '{"a":', "", None, "a"]
    got = values(spark, text.is_json, bodies)
    assert got == [True, True, True, True, True, False, False, False, False, False, False]


def test_short_model_name(spark):
    ids = ["mlx-community/a", "a", "mlx-community/mlx-community/b", "x/mlx-community/c", None]
    assert values(spark, text.short_model_name, ids) == ["a", "a", "mlx-community/b", "x/c", None]
    assert values(spark, text.short_model_name_all, ids) == ["a", "a", "b", "x/c", None]


def test_key_value_split(spark):
    lines = ["A=b=c", "A=", "plain", "=x"]
    assert values(spark, text.kv_key, lines) == ["A", "A", "plain", ""]
    assert values(spark, text.kv_value, lines) == ["b=c", "", "", "x"]


def test_clock_time(spark):
    assert values(spark, units.clock_time, [0, None, 1_700_000_000_000], "bigint") == [
        "—", "—", "22:13:20"]


def test_pad_right_never_cuts(spark):
    assert values(spark, lambda c: text.pad_right(c, 4), ["ab", "abcdef"]) == ["ab  ", "abcdef"]


def test_decimal_gb_and_gib(spark):
    assert values(spark, units.decimal_gb, [0, 1_950_000_000, 249_999_999], "bigint") == [
        "0.0GB", "2.0GB", "0.2GB"]
    assert values(spark, units.binary_gib, [17179869184, 536870912], "bigint") == [16.0, 0.5]
