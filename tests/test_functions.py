import json

import pytest
from pyspark.sql import functions as F

from threadlake import functions as fn

NOW = 1_750_000_000


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_strip_fullname(spark):
    names = ["t1_abc", "t3_xyz", "abc", None, "", "t3_", "t1_a_b", "_x"]
    assert values(spark, names, fn.strip_fullname) == ["abc", "xyz", "abc", None, None, "", "a_b", "x"]


def test_parent_kind(spark):
    names = ["t1_abc", "t3_xyz", "abc", None, "", "_x"]
    assert values(spark, names, fn.parent_kind) == ["t1", "t3", "abc", "", "", ""]


@pytest.mark.parametrize(
    "spec, is_since, expected",
    [
        ("1704067200", True, 1704067200),
        ("2024-01-31", True, 1706659200),
        ("2024-1-5", True, 1704412800),
        ("90d", True, NOW - 7_776_000),
        ("2y", True, NOW - 63_072_000),
        ("18m", True, NOW - 46_656_000),
        ("12h", True, NOW - 43_200),
        (" 3 D ", True, NOW - 259_200),
        ("NOW", False, NOW),
        ("all", True, 1119225600),
        ("all", False, NOW),
        (None, True, 1119225600),
        (None, False, NOW),
        ("not-a-date", True, None),
        ("2023-02-30", True, None),
        ("0000-01-01", True, None),
        ("-5", True, None),
        ("5w", True, None),
        ("", True, None),
        ("1969-12-31", True, -86400),
        ("99999999999999999999", True, None),
        ("999999999999999999y", True, None),
    ],
)
def test_timespec(spark, spec, is_since, expected):
    assert values(spark, [spec], lambda c: fn.parse_timespec(c, NOW, is_since)) == [expected]


def test_timespec_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, ["2024-01-31"], lambda c: fn.parse_timespec(c, NOW, True)) == [1706659200]
        assert values(spark, [1706659200], fn.epoch_date, "bigint") == ["2024-01-31"]
        ts = F.expr("timestamp_ntz'2024-03-10 02:30:15'")
        assert values(spark, [0], lambda _: fn.epoch_of_ntz(ts), "int") == [1710037815]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_epoch_date(spark):
    assert values(spark, [0, -1, 1706659199], fn.epoch_date, "bigint") == [
        "1970-01-01",
        "1969-12-31",
        "2024-01-30",
    ]


def test_month_of_epoch(spark):
    months = values(spark, [0, -1, 1706659200], fn.month_of_epoch, "bigint")
    assert months == [0, -1, 54 * 12]


def test_window_days_floors(spark):
    df = spark.createDataFrame([(0, 86399), (0, 86400), (86400, 0), (1, 0)], "s bigint, u bigint")
    assert [r[0] for r in df.select(fn.window_days("s", "u")).collect()] == [0, 1, -1, -1]


def test_int_or_zero(spark):
    texts = ["12", "12.9", "-3.5", None, "", "0", "true", "false", "x", "1.7e9"]
    assert values(spark, texts, fn.int_or_zero) == [12, 12, -3, 0, 0, 0, 1, 0, 0, 1_700_000_000]


def test_truthy(spark):
    cases = {
        "true": 1, "false": 0, "1": 1, "0": 0, "0.0": 0, '""': 0, '"false"': 1, "null": 0,
        "[]": 0, "[0]": 1, "{}": 0, '{"a": 1}': 1, "1.5": 1, "-1": 1,
    }
    docs = list(cases)
    got = values(spark, docs, lambda c: fn.truthy(F.try_parse_json(c)))
    assert dict(zip(docs, got)) == cases
    assert values(spark, [None], lambda c: fn.truthy(F.try_parse_json(c))) == [0]


def test_parse_count(spark):
    texts = ["12", "-3", "1.2k", None, "--5", " 5", "", "-", "99999999999999999999"]
    signed = values(spark, texts, lambda c: F.struct(*fn.parse_count(c, signed=True)))
    assert [tuple(r) for r in signed] == [
        (12, False), (-3, False), (None, False), (None, False), (None, True), (None, False),
        (None, False), (None, False), (None, True),
    ]
    assert values(spark, ["12\n", "-3\n"], lambda c: fn.parse_count(c, signed=True).value) == [None, None]
    unsigned = values(spark, texts, lambda c: fn.parse_count(c).value)
    assert unsigned == [12, None, None, None, None, None, None, None, None]


def test_json_default(spark):
    docs = ['{"a":{"b":{"c":42}}}', '{"a":{"b":{}}}', '{"a":5}', '{"a":{"b":{"c":null}}}', "{}"]
    assert values(spark, docs, lambda c: fn.json_default(c, "a.b.c", "x")) == ["42", "x", "x", None, "x"]
    assert values(spark, docs, lambda c: fn.json_default(c, "z", None)) == [None] * 5


def test_json_quote(spark):
    texts = ["plain", 'a"b\\', "é\n"]
    assert [json.loads(x) for x in values(spark, texts, fn.json_quote)] == texts


def test_drop_json_field(spark):
    docs = [
        '{"id": "a",  "body": "x"}',
        '{"id": "a", "replies": "", "n": 1.50}',
        '{"body": "say \\"replies\\" é"}',
        '{"a": {"replies": 1}}',
    ]
    got = values(spark, docs, lambda c: fn.drop_json_field(c, "replies"))
    assert got[0] == docs[0]
    assert json.loads(got[1]) == {"id": "a", "n": 1.5}
    assert got[2:] == docs[2:]


def test_split_list(spark):
    assert values(spark, ["python, rust,, golang ", "", " , "], fn.split_list) == [
        ["python", "rust", "golang"],
        [],
        [],
    ]


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<shreddit-post score="12" comment-count="3">', "12"),
        ("<SHREDDIT-POST\n comment-count='3'\tScore='-7' >", "-7"),
        ("<shreddit-post score=5/>", "5/"),
        ("<shreddit-post score=5 x>", "5"),
        ("<shreddit-post score>", ""),
        ('<shreddit-post score="">', ""),
        ('<shreddit-post data-score="9">', None),
        ('<shreddit-post title="a > score=1" score="2">', "2"),
        ('<shreddit-post x="1">', None),
        ('<shreddit-poster score="4"><p>', None),
        ('<!-- <shreddit-post score="1"> --><shreddit-post score="2">', "2"),
        ("<script>'<shreddit-post score=\"1\">'</script><shreddit-post score=\"2\">", "2"),
        ('<shreddit-post score="1"><shreddit-post score="2">', "1"),
        ("<p>", None),
        ("<shreddit-post ", None),
    ],
)
def test_tag_attribute(spark, page, expected):
    assert values(spark, [page], lambda c: fn.tag_attribute(c, "shreddit-post", "score")) == [expected]


def test_tag_attribute_on_a_long_page(spark):
    filler = "<p class=\"x\">text 'quoted' > </p>" * 40_000
    page = filler + '<shreddit-post a="' + "y" * 100_000 + '" score="8">' + filler
    assert values(spark, [page], lambda c: fn.tag_attribute(c, "shreddit-post", "score")) == ["8"]
