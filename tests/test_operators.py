import random

import hypothesis.strategies as st
import pytest
from hypothesis import given
from pyspark.sql import functions as F

from shapeminer.functions import columns as C
from shapeminer.functions import text
from shapeminer.operators import charclass as cc
from shapeminer.operators import stats


def _quartiles(values):
    ordered, card, out = sorted(set(values)), len(values), []
    for k in (1, 2, 3):
        before = 0
        for v in ordered:
            if before >= k * card // 4:
                break
            before += values.count(v)
        else:
            v = ordered[-1]
        out.append(v)
    return out


@pytest.mark.parametrize("values", [list(range(10)), [0, 1, 3], [1, 1, 1, 1, 2], [5], list(range(1000)) + [7] * 300])
@pytest.mark.parametrize("spread", [0, 8])
def test_statistics(spark, values, spread, monkeypatch):
    monkeypatch.setattr(stats, "SPREAD_FROM", 20)
    hist = stats.histogram(spark.createDataFrame([("p", v) for v in values], "path_id string, v long"), F.col("v"), "path_id")
    r = stats.statistics(hist, "path_id", spread=spread).first()
    assert [r.q1, r.q2, r.q3] == _quartiles(values) and (r.card, r.min, r["max"]) == (len(values), min(values), max(values))
    assert r.is_unique == (len(set(values)) == len(values))


def test_multisets(spark):
    h = lambda s: stats.histogram(spark.createDataFrame([(c,) for c in s], "c string"), F.col("c"))
    assert stats.equal(stats.merged(h("aab"), h("bc"), "v"), h("aabbc"), "v")
    assert stats.equal(stats.subtracted(h("aabc"), h("abbd"), "v"), h("ac"), "v")
    assert sorted(r.v for r in stats.elements(h("abab")).collect()) == list("aabb")


def _column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize("base, values", [(10, ["1", " 42\t", "+7", "-1_000", "1__0", "_1", "", "x", "9" * 30]), (16, ["ff", "0xFF", "-0x_1f", "f" * 30, "fg", "0x"]), (8, ["17", "0o17", "8", "7" * 30])])
def test_parse_int_like_python(spark, base, values):
    def py(v):
        try:
            return int(v, base)
        except ValueError:
            return None

    assert [None if x is None else int(x) for x in _column(spark, values, lambda c: C.parse_int(c, base))] == [py(v) for v in values]


def test_parse_float_and_bool(spark):
    values = ["1", "1.", ".5", "1_0.5", "1e3", "-inf", "Infinity", "nan", "1d", "1.0f", "", "1e", "_1"]
    assert _column(spark, values, C.parse_float) == [1.0, 1.0, 0.5, 10.5, 1000.0, float("-inf"), float("inf"), None, None, None, None, None, None]
    assert _column(spark, [" Yes ", "NO", "y", ""], lambda c: C.parse_bool(c, "no|yes")) == [True, False, None, None]


def test_parse_datetime(spark):
    cases = {"%Y-%m-%d": ["2020-1-1", "2020-02-31", "20-01-01", "2020-01-01x"], "%a, %d %b %Y %H:%M:%S %Z": ["Wed, 1 Jan 2020 10:20:30 GMT", "Foo, 1 Jan 2020 10:20:30 GMT", "Wed, 1 Jan 2020 10:20:30 EST"], "%Y-%m-%d %H:%M:%S%z": ["2020-01-01 10:00:00+01:00", "2020-01-01 10:00:00Z", "2020-01-01 10:00:00"]}
    got = {f: [x is not None for x in _column(spark, v, lambda c, f=f: C.parse_datetime(c, f))] for f, v in cases.items()}
    assert got == {"%Y-%m-%d": [True, False, False, False], "%a, %d %b %Y %H:%M:%S %Z": [True, False, False], "%Y-%m-%d %H:%M:%S%z": [True, True, False]}


def test_durations():
    assert text.parse_duration("7 min 2hr").total_seconds() == 7620 and text.parse_duration("3wks,4 days").days == 25 and text.parse_duration("-2 d").days == -2
    assert text.parse_duration("250 µs").microseconds == 250 and text.parse_duration("9 msecs").microseconds == 9000
    assert text.duration_parts("1 m") == {"months": 1} and text.duration_parts("1 min") == {"minutes": 1}
    for bad in ("", "soon", "1 fortnight", "4s 2s", "1h2min", "3", "d"):
        with pytest.raises(ValueError):
            text.duration_parts(bad)


def test_formats():
    assert [text.format_int(x) for x in (7, 42, 123_456, 5_250_000, -2500, 3**30)] == ["7", "42", "123.5K", "5.2M", "-2.5K", "205.9T"]
    assert text.format_chars("zmpno7") == "7m-pz" and text.sparkline(0, 2, 5, 7, 9) == "..1..2.3.."
    assert text.format_value('a"b') == '"a""b"' and text.format_value(None) == "null" and text.format_epoch(-2209161600, 86400) == "days since 1899-12-30"
    assert text.num("1%") == text.num("1/100") and text.size("2K") == 2048
    with pytest.raises(ValueError):
        text.format_value(object())


def test_format_int_column(spark):
    rng = random.Random(2)
    sizes = [x * 1000**p // 100 for p in range(1, 6) for x in (125, 135, 145, 175, 4985, 24950, 24955, 99995, 99994)] + [rng.randrange(10 ** rng.randint(1, 15)) for _ in range(2000)] + [997 * k for k in range(1, 3000)] + [9_223 * 10**15]
    sizes = [x for x in sizes if x < 2**53 or x % 10**15 == 0]
    rows = spark.createDataFrame([(s * x,) for x in sizes for s in (1, -1)], "i long").select("i", C.format_int(F.col("i")).alias("si")).collect()
    assert [(r.i, r.si) for r in rows] == [(r.i, text.format_int(r.i)) for r in rows]


chars = st.frozensets(st.characters(min_codepoint=40, max_codepoint=120), max_size=12)


@given(chars, chars)
def test_character_sets(a, b):
    x, y = cc.CharClass(a), cc.CharClass(b)
    assert (x | y, x & y, x - y, x ^ y) == (a | b, a & b, a - b, a ^ b)
    assert (x | cc.ANY) == cc.ANY and (x & cc.ANY) == x and (x - cc.ANY) == frozenset() and x <= cc.ANY
    with pytest.raises(ValueError):
        cc.ANY - x


def test_patterns():
    show = lambda *sets: "".join(map(str, cc.mined([frozenset(s) for s in sets])))
    assert show("fb", "oa", "orz") == "x.." and show("m", "01234567") == "mo" and show("G", "ab", "zq") == "Gxi" and show("0", "9") == "09"
