import json

import pytest
from pyspark.sql import functions as F

from shapeminer import cli
from shapeminer.sources.reader import Source, detect_dialect, detect_encoding, detect_format

DISHES = [("crème brûlée", "dessert"), ("smørrebrød", "snack"), ("goulash", "stew"), ("jalapeño soup", "starter")] * 5


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
@pytest.mark.parametrize("sep", [",", "\t", ";"])
def test_csv(spark, tmp_path, encoding, sep):
    path = tmp_path / "dishes.csv"
    path.write_bytes("".join(f"{sep.join(r)}\n" for r in [("dish", "kind"), *DISHES]).encode(encoding))
    s = Source((str(path),)).detected(spark)
    assert (s.encoding, s.format, s.csv_delimiter) == (encoding, "csv", sep)
    rows = Source((str(path),)).read(spark).select(F.try_variant_get("doc", "$[0]", "string").alias("n")).collect()
    assert [r.n for r in rows] == [n for n, _ in DISHES]


def test_json_yaml_and_others(spark, tmp_path):
    doc = {"a": [1, 2, 3], "b": "x"}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    (tmp_path / "x.yaml").write_text("a:\n- 1\n- 2\n- 3\nb: x\n")
    for name in ("x.json", "x.yaml"):
        got = Source((str(tmp_path / name),)).read(spark).select(F.to_json("doc").alias("j")).first().j
        assert json.loads(got) == doc
    (tmp_path / "x.xml").write_text("<?xml version='1.0'?><a/>")
    with pytest.raises(NotImplementedError):
        Source((str(tmp_path / "x.xml"),)).read(spark)
    (tmp_path / "blank").write_text("\n" * 100)
    with pytest.raises(ValueError):
        Source((str(tmp_path / "blank"),)).read(spark)


def _docs(spark, *paths, **options):
    return [json.loads(r.j) for r in Source(tuple(map(str, paths)), **options).read(spark).select(F.to_json("doc").alias("j")).collect()]


def test_ragged_csv_keeps_every_cell(spark, tmp_path):
    (tmp_path / "r.csv").write_text('source_id,b\n1,2\n1,2,3\n4\n"x\ny",,"q""r",\n5,\n,6\n')
    got = _docs(spark, tmp_path / "r.csv")
    assert sorted(got) == sorted([["1", "2"], ["1", "2", "3"], ["4"], ["x\ny", "", 'q"r', ""], ["5", ""], ["", "6"]])


def test_json_lines(spark, tmp_path):
    docs = [{"a": k, "b": ["é", None]} for k in range(50)]
    text = "\n".join(json.dumps(d, ensure_ascii=False) for d in docs)
    (tmp_path / "x.json").write_text(text + "\n\n")
    (tmp_path / "l1.json").write_text(text, encoding="latin-1")
    key = lambda d: d["a"]
    assert sorted(_docs(spark, tmp_path / "x.json"), key=key) == docs
    assert sorted(_docs(spark, tmp_path / "l1.json", encoding="latin-1"), key=key) == docs
    (tmp_path / "one.json").write_text(json.dumps(docs, indent=1))
    assert _docs(spark, tmp_path / "one.json") == [docs]


def test_loose_json_and_encodings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": "x\x01y\tz"}')
    assert _docs(spark, tmp_path / "c.json", json_strict=False) == [{"a": "x\x01y\tz"}]
    (tmp_path / "p.json").write_bytes('["zażółć"]'.encode("cp1250"))
    assert _docs(spark, tmp_path / "p.json", encoding="cp1250") == [["zażółć"]]
    (tmp_path / "s.json").write_bytes(b'["a\xffb"]')
    assert _docs(spark, tmp_path / "s.json", encoding="shift_jis", encoding_strict=False) == [["a\ufffdb"]]
    assert _docs(spark, tmp_path / "s.json", encoding="utf-8", encoding_strict=False) == [["a\ufffdb"]]


def test_formats_are_told_apart():
    yes = {"yaml": ["k: v\n", "- a, b\n- c, d\n", "# note\nx:\n  - 1\n  - 2\n", "a: 1\nb: {c: 2"], "csv": ["p;q\n1;2\n3;4\n", "n\tm\n1\t2\n", '"only"\n"one"\n', 'a,b\n"x, y",2\n3,4\n5,6,7\n'], "unknown": ["\n\n", "", "word\nother\n"]}
    for kind, texts in yes.items():
        for t in texts:
            assert detect_format(t) == kind, t


def test_detection():
    assert detect_encoding(b"\xff" * 2000) == "latin-1" and detect_encoding("é".encode()[:1]) == "utf-8"
    assert detect_format(" {") == "json" and detect_format("a: 1\nb: 2\n") == "yaml" and detect_format("a,b\n1,2\n") == "csv"
    assert detect_dialect('a;b\n"1";"2"\n"3";"4"\n').delimiter == ";"


def test_cli_prints_structure(spark, tmp_path):
    path = tmp_path / "ints.json"
    path.write_text(json.dumps(list(range(100))))
    assert cli.run([str(path)], spark) == "[ int range=0..99 ]"
    assert cli.run(["--hide-range", str(path)], spark) == "[ int ]"
    assert cli.main([str(tmp_path / "missing.json")]) == 1


def test_incremental_profile(spark, tmp_path):
    from shapeminer.streaming.incremental import IncrementalProfile

    docs = spark.range(100).select(F.parse_json(F.concat(F.lit('{"k": '), F.col("id") % 10, F.lit("}"))).alias("doc"))
    docs.select(F.to_json("doc").alias("j")).write.parquet(str(tmp_path / "in"))
    profile = IncrementalProfile(str(tmp_path / "out"))
    stream = spark.readStream.schema("j string").parquet(str(tmp_path / "in")).select(F.parse_json("j").alias("doc"))
    q = stream.writeStream.foreachBatch(profile).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    profile(docs, 99)
    row = profile.statistics(spark).first()
    assert (row.path_id, row.card, row.distinct_values, row.q2) == ("$[].k", 200, 10, "5")
