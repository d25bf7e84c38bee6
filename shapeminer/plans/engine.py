"""Queries that run the analyzer, its tree and its predicates as a whole, each with an oracle in SQL."""

from __future__ import annotations

from datetime import datetime
from fractions import Fraction

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.text import format_value
from ..operators import infer, nodes, stats
from ..options import Options
from ..sources import reader
from .analyzer import Analyzer, profile
from .catalogue import _ORDERS_DOC, _query, _quartiles_sql, _t
from .pattern import Node, Stats

_WINDOW = {"min_timestamp": datetime(2000, 1, 1), "max_timestamp": datetime(2035, 1, 1)}
_ORDERS_SQL = "SELECT o_orderkey AS key, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders"


def _options(**changes) -> Options:
    return Options.cli(**_WINDOW | changes)


def _analysed(spark, docs, *cols, merge: bool = False, **changes):
    """The profile of a DataFrame's documents, or of its one variant column."""
    a = Analyzer(spark, _options(**changes))
    root = a.analyze(docs)
    return profile(a.merge(root) if merge else root, spark).select(*cols)


def _parsed(docs, expr: str = "doc"):
    return docs.select(F.parse_json(F.expr(expr)).alias("doc"))


def _texts(sql: str) -> str:
    """A quartile query's values as text."""
    return f'SELECT path_id, kind, card, distinct_values, CAST("min" AS VARCHAR) AS "min", CAST(q1 AS VARCHAR) AS q1, CAST(q2 AS VARCHAR) AS q2, CAST(q3 AS VARCHAR) AS q3, CAST("max" AS VARCHAR) AS "max", is_unique FROM ({sql})'


@_query(
    _texts("SELECT *, 'int' AS kind FROM (" + _quartiles_sql("SELECT '$[].k' AS path_id, CAST(props->>'$.k' AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1, 2", "path_id") + ")")
    + " UNION ALL SELECT '$[]', 'record', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events UNION ALL SELECT '$', 'list', 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
)
def profile_events_nested(spark, sf_dir):
    leaf = F.col("kind") == "int"
    cols = ("card", "distinct_values", "min", "q1", "q2", "q3", "max", "is_unique")
    got = _analysed(spark, _parsed(_t(spark, sf_dir, "events"), "props"), "path_id", "kind", "card", *cols[1:])
    return got.select("path_id", "kind", "card", *(F.when(leaf, F.col(c)).alias(c) for c in cols[1:]))


@_query(f"""WITH d AS ({_ORDERS_SQL}), t AS (SELECT count(*) AS n FROM d)
SELECT '$[].key' AS path_id, 'field' AS role, 'int' AS kind, false AS optional, n AS count FROM t
UNION ALL SELECT '$[].status', 'field', 'str', count(status) < any_value(n), count(status) FROM d, t UNION ALL SELECT '$[].price', 'field', 'float', count(price) < any_value(n), count(price) FROM d, t""")
def record_fields_optional(spark, sf_dir):
    got = _analysed(spark, _parsed(_t(spark, sf_dir, "orders"), _ORDERS_DOC), "path_id", "role", "kind", "optional", "count")
    return got.where("role = 'field'")


@_query("""SELECT '$[]' AS path_id, 'tuple' AS kind, 'item' AS role, count(*) AS card, NULL AS "min", NULL AS "max" FROM lineitem UNION ALL SELECT '$', 'list', 'root', 1, NULL, NULL
UNION ALL SELECT '$[][0]', 'int', 'pos', count(*), CAST(min(l_linenumber) AS VARCHAR), CAST(max(l_linenumber) AS VARCHAR) FROM lineitem UNION ALL SELECT '$[][1]', 'str', 'pos', count(*), min(l_returnflag), max(l_returnflag) FROM lineitem""")
def analysed_tuples(spark, sf_dir):
    pairs = _t(spark, sf_dir, "lineitem").select(F.parse_json(F.concat(F.lit("["), "l_linenumber", F.lit(',"'), "l_returnflag", F.lit('"]'))).alias("doc"))
    got = _analysed(spark, pairs, "path_id", "kind", "role", "card", "min", "max")
    leaf = F.col("role") == "pos"
    return got.select("path_id", "kind", "role", "card", F.when(leaf, F.col("min")).alias("min"), F.when(leaf, F.col("max")).alias("max"))


@_query(
    """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 3 END AS k FROM orders)
SELECT '$[]' AS path_id, 'list' AS kind, count(*) AS card, min(k) AS len_min, max(k) AS len_max FROM l UNION ALL SELECT '$[][]', 'int', CAST(sum(k) AS BIGINT), NULL, NULL FROM l"""
)
def analysed_ragged_lists(spark, sf_dir):
    lists = _t(spark, sf_dir, "orders").select(F.parse_json(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("["), "o_orderkey", F.lit("]"))).otherwise(F.concat(F.lit("["), "o_orderkey", F.lit(",1,2]")))).alias("doc"))
    got = _analysed(spark, lists, "path_id", "kind", "card", "len_min", "len_max").where("path_id != '$'")
    return got.select("path_id", "kind", "card", *(F.when(F.col("kind") == "list", F.col(c)).alias(c) for c in ("len_min", "len_max")))


def _map_doc(df, key, value):
    """The table as one mapping, whose entries stay rows."""
    return nodes.Mapping(df.select(key.alias("key"), value.cast("variant").alias("child")))


@_query("""SELECT 'nation' AS source, CASE WHEN count(DISTINCT n_name) < 20 THEN 'record' ELSE 'table' END AS kind, count(DISTINCT n_name) AS keys, min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM nation
UNION ALL SELECT 'region', CASE WHEN count(DISTINCT r_name) < 20 THEN 'record' ELSE 'table' END, count(DISTINCT r_name), min(r_regionkey), max(r_regionkey) FROM region""")
def analysed_record_or_table(spark, sf_dir):
    out = []
    for name, k, v in (("nation", "n_name", "n_nationkey"), ("region", "r_name", "r_regionkey")):
        got = _analysed(spark, _map_doc(_t(spark, sf_dir, name), F.col(k), F.col(v)), "path_id", "kind", "len_max", "min", "max")
        top, leaves = got.where("path_id = '$[]'").select("kind", F.col("len_max").alias("keys")), got.where("kind = 'int'")
        ends = leaves.agg(F.min(F.col("min").cast("int")).alias("lo"), F.max(F.col("max").cast("int")).alias("hi"))
        out.append(top.join(F.broadcast(ends)).select(F.lit(name).alias("source"), "kind", "keys", "lo", "hi"))  # one row each
    return out[0].unionByName(out[1])


@_query("""SELECT 'n' || k AS path_id, CASE WHEN count(*) FILTER (WHERE o_custkey % k = 0) > 0.4 * count(*) THEN 'value' ELSE 'int' END AS kind, count(*) AS count FROM orders, (VALUES (2), (3), (10)) t(k) GROUP BY k""")
def analysed_null_budget(spark, sf_dir):
    cols = [F.when(F.col("o_custkey") % k != 0, F.col("o_custkey")).alias(f"n{k}") for k in (2, 3, 10)]
    docs = _t(spark, sf_dir, "orders").select(F.parse_json(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("doc"))
    got = _analysed(spark, docs, F.substring("path_id", 5, 9).alias("path_id"), "kind", "count", "role", null_threshold=Fraction(40, 100))
    return got.where("role = 'field'").drop("role")


@_query("""WITH b AS (SELECT k, CASE WHEN o_custkey % k <> 0 THEN o_custkey END AS v FROM orders, (VALUES (2), (3), (10)) t(k))
SELECT 'b' || k AS path_id, 'str' AS repr, CASE WHEN count(*) FILTER (WHERE v IS NULL) > 0.4 * count(*) THEN 'str' ELSE 'int' END AS kind, CASE WHEN count(*) FILTER (WHERE v IS NULL) > 0.4 * count(*) THEN count(*) ELSE count(v) END AS card FROM b GROUP BY k""")
def analysed_blank_budget(spark, sf_dir):
    cols = [F.when(F.col("o_custkey") % k != 0, F.col("o_custkey").cast("string")).otherwise("").alias(f"b{k}") for k in (2, 3, 10)]
    docs = _t(spark, sf_dir, "orders").select(F.parse_json(F.to_json(F.struct(*cols))).alias("doc"))
    got = _analysed(spark, docs, F.substring("path_id", 5, 9).alias("path_id"), F.coalesce("repr", F.lit("str")).alias("repr"), "kind", "card", "role", empty_threshold=Fraction(40, 100))
    return got.where("role = 'field'").drop("role")


# a datetime format, how Spark writes it, and what it keeps
_WRITTEN = {
    "%Y-%m-%dT%H:%M:%S": ("yyyy-MM-dd'T'HH:mm:ss", "second"), "%Y-%m-%dT%H:%M": ("yyyy-MM-dd'T'HH:mm", "minute"), "%Y-%m-%d %H:%M:%S": ("yyyy-MM-dd HH:mm:ss", "second"), "%Y-%m-%d %H:%M": ("yyyy-MM-dd HH:mm", "minute"),
    "%Y-%m-%d": ("yyyy-MM-dd", "day"), "%a, %d %b %Y %H:%M:%S": ("EEE, dd MMM yyyy HH:mm:ss", "second"), "%a, %d %b %Y %H:%M:%S %Z": ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"),
    "%Y-%m-%dT%H:%M:%S.%f": ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "microsecond"), "%Y-%m-%dT%H:%M:%S.%f%z": ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "microsecond"), "%Y-%m-%dT%H:%M:%S%z": ("yyyy-MM-dd'T'HH:mm:ss'+00:00'", "second"), "%Y-%m-%dT%H:%M%z": ("yyyy-MM-dd'T'HH:mm'Z'", "minute"),
    "%Y-%m-%d %H:%M:%S.%f": ("yyyy-MM-dd HH:mm:ss.SSSSSS", "microsecond"), "%Y-%m-%d %H:%M:%S.%f%z": ("yyyy-MM-dd HH:mm:ss.SSSSSS'Z'", "microsecond"), "%Y-%m-%d %H:%M:%S%z": ("yyyy-MM-dd HH:mm:ss'Z'", "second"), "%Y-%m-%d %H:%M%z": ("yyyy-MM-dd HH:mm'+00:00'", "minute"),
}
_DATE_TEXT = "strftime(date_trunc('{}', {}(CAST(ts AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S')"


@_query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, 'datetime' AS kind, count(*) AS card, count(DISTINCT date_trunc('{unit}', CAST(ts AS TIMESTAMP))) AS distinct_values, {_DATE_TEXT.format(unit, 'min')} AS first, {_DATE_TEXT.format(unit, 'max')} AS last FROM events" for p, (_, unit) in _WRITTEN.items()))
def analysed_datetime_formats(spark, sf_dir):
    cols = [F.date_format("ts", f).alias(f"f{k}") for k, (f, _) in enumerate(_WRITTEN.values())]
    docs = _t(spark, sf_dir, "events").select(F.parse_json(F.to_json(F.struct(*cols))).alias("doc"))
    got = _analysed(spark, docs, "pattern", "kind", "card", "distinct_values", F.substring("min", 1, 19).alias("first"), F.substring("max", 1, 19).alias("last"), "role")
    return got.where("role = 'field'").drop("role")


@_query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders)
SELECT 'bool' AS field, 'bool' AS kind, 'str' AS repr, 'no|yes' AS pattern, count(*) AS card, 'False' AS lo, 'True' AS hi FROM o
UNION ALL SELECT 'oct', 'int', 'str', 'o', count(*), CAST(min(k) AS VARCHAR), CAST(max(k) AS VARCHAR) FROM o UNION ALL SELECT 'dec', 'int', 'str', 'd', count(*), CAST(min(k) AS VARCHAR), CAST(max(k) AS VARCHAR) FROM o
UNION ALL SELECT 'hex', 'int', 'str', 'x', count(*), CAST(min(k) AS VARCHAR), CAST(max(k) AS VARCHAR) FROM o UNION ALL SELECT 'float', 'float', 'str', 'f', count(*), CAST(min(k) + 0.5 AS VARCHAR), CAST(max(k) + 0.5 AS VARCHAR) FROM o
UNION ALL SELECT 'url', 'url', NULL, NULL, count(*), min('http://x.y/' || k), max('http://x.y/' || k) FROM o UNION ALL SELECT 'text', 'str', NULL, NULL, count(*), min(repeat('z', k % 9 + 1)), max(repeat('z', k % 9 + 1)) FROM o
UNION ALL SELECT 'fixed', 'str', NULL, 'No ddddddd', count(*), min('No ' || lpad(CAST(k * 7919 % 9999991 AS VARCHAR), 7, '0')), max('No ' || lpad(CAST(k * 7919 % 9999991 AS VARCHAR), 7, '0')) FROM o""")
def analysed_strings(spark, sf_dir):
    k = F.col("o_orderkey")
    cols = [
        F.when(k % 2 == 0, "yes").otherwise("no").alias("bool"), F.concat(F.lit("0o"), F.conv(k.cast("string"), 10, 8)).alias("oct"), k.cast("string").alias("dec"), F.concat(F.lit("0x"), F.lower(F.hex(k))).alias("hex"),
        F.concat(k.cast("string"), F.lit(".5")).alias("float"), F.concat(F.lit("http://x.y/"), k).alias("url"), F.repeat(F.lit("z"), (k % 9 + 1).cast("int")).alias("text"), F.concat(F.lit("No "), F.lpad((k * 7919 % 9999991).cast("string"), 7, "0")).alias("fixed"),
    ]
    docs = _t(spark, sf_dir, "orders").select(F.parse_json(F.to_json(F.struct(*cols))).alias("doc"))
    got = _analysed(spark, docs, F.col("key").alias("field"), "kind", "repr", "pattern", "card", F.col("min").alias("lo"), F.col("max").alias("hi"), "role")
    return got.where("role = 'field'").drop("role")


@_query("""SELECT 'seconds' AS field, 'datetime' AS kind, 'num' AS repr, strftime(min(date_trunc('second', CAST(ts AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S') AS lo, strftime(max(date_trunc('second', CAST(ts AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S') AS hi FROM events
UNION ALL SELECT 'texts', 'datetime', 'str', strftime(min(date_trunc('second', CAST(ts AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S'), strftime(max(date_trunc('second', CAST(ts AS TIMESTAMP))), '%Y-%m-%d %H:%M:%S') FROM events
UNION ALL SELECT 'small', 'int', NULL, CAST(min(event_id) AS VARCHAR), CAST(max(event_id) AS VARCHAR) FROM events""")
def analysed_numeric_timestamps(spark, sf_dir):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    docs = _t(spark, sf_dir, "events").select(F.parse_json(F.to_json(F.struct(at.alias("seconds"), at.cast("string").alias("texts"), F.col("event_id").alias("small")))).alias("doc"))
    got = _analysed(spark, docs, F.col("key").alias("field"), "kind", "repr", F.col("min").alias("lo"), F.col("max").alias("hi"), "role")
    return got.where("role = 'field'").drop("role")


@_query("""SELECT '$[]' AS path_id, 'table' AS kind, count(*) FILTER (WHERE o_orderkey % 200 = 0) AS rejected, NULL AS lo, NULL AS hi, NULL AS card FROM orders
UNION ALL SELECT '$[]{}', 'int', 0, CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), count(*) FROM orders WHERE o_orderkey % 200 <> 0""")
def analysed_rejected_keys(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 200 == 0, F.concat(F.lit("no key "), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    got = _analysed(spark, _map_doc(_t(spark, sf_dir, "orders"), key, F.col("o_custkey")), "path_id", "kind", "rejected", "min", "max", "card")
    leaf = F.col("kind") == "int"
    return got.where("path_id in ('$[]', '$[]{}')").select("path_id", "kind", "rejected", F.when(leaf, F.col("min")).alias("lo"), F.when(leaf, F.col("max")).alias("hi"), F.when(leaf, F.col("card")).alias("card"))


_BY_PRIORITY = "map_from_entries(collect_list(struct(o_orderpriority, d)))"


def _priorities(spark, sf_dir):
    """{priority: {count, total, first?}}: alike records, one field of which some lack."""
    o = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("count"), F.min("o_custkey").alias("least"), F.when(F.col("o_orderpriority") < "4", F.max("o_custkey")).alias("most"))
    return o.select("o_orderpriority", F.struct("count", "least", "most").alias("d")).selectExpr(f"parse_json(to_json({_BY_PRIORITY})) AS doc")


_MERGED_SQL = """WITH p AS (SELECT o_orderpriority AS k, count(*) AS count, min(o_custkey) AS least, CASE WHEN o_orderpriority < '4' THEN max(o_custkey) END AS most FROM orders GROUP BY 1)"""


@_query(f"""{_MERGED_SQL}
SELECT '$[]' AS path_id, 'table' AS kind, false AS optional, 1 AS count, NULL AS lo, NULL AS hi FROM (SELECT 1) UNION ALL SELECT '$[]{{}}', 'record', false, count(*), NULL, NULL FROM p
UNION ALL SELECT '$[]{{}}.count', 'int', false, count(*), CAST(min(count) AS VARCHAR), CAST(max(count) AS VARCHAR) FROM p UNION ALL SELECT '$[]{{}}.least', 'int', false, count(*), CAST(min(least) AS VARCHAR), CAST(max(least) AS VARCHAR) FROM p
UNION ALL SELECT '$[]{{}}.most', 'int', true, count(most), CAST(min(most) AS VARCHAR), CAST(max(most) AS VARCHAR) FROM p UNION ALL SELECT '$[]{{key}}', 'str', false, count(*), min(k), max(k) FROM p""")
def merged_alike_records(spark, sf_dir):
    got = _analysed(spark, _priorities(spark, sf_dir), "path_id", "kind", "optional", "card", "min", "max", merge=True).where("path_id != '$'")
    leaf = F.col("kind").isin("int", "str")
    return got.select("path_id", "kind", F.coalesce("optional", F.lit(False)).alias("optional"), F.col("card").alias("count"), F.when(leaf, F.col("min")).alias("lo"), F.when(leaf, F.col("max")).alias("hi"))


@_query("SELECT '0.5' AS threshold, 'table' AS kind UNION ALL SELECT '0.9', 'record'")
def merge_threshold(spark, sf_dir):
    """Records that share two thirds of their fields are alike from one half on, not from nine tenths."""
    o = _t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_custkey").alias("m"))
    some = lambda s: F.when(F.col("o_orderstatus") == s, F.col("m"))
    docs = o.select(F.col("o_orderstatus").alias("o_orderpriority"), F.struct("n", "m", some("F").alias("f"), some("O").alias("o"), some("P").alias("p")).alias("d")).selectExpr(f"parse_json(to_json({_BY_PRIORITY})) AS doc")
    each = [_analysed(spark, docs, F.lit(str(t)).alias("threshold"), "kind", "path_id", merge=True, merge_threshold=Fraction(str(t))) for t in (0.5, 0.9)]
    return each[0].unionByName(each[1]).where("path_id = '$[]'").drop("path_id")


@_query(f"{_MERGED_SQL} SELECT CAST(r AS INTEGER) AS rounds, 'table' AS outer_kind, 'table' AS inner_kind FROM (SELECT 2 AS r)")
def merge_fixpoint(spark, sf_dir):
    """Merging goes on until nothing changes: records of alike records become a table of tables."""
    o = _t(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_custkey").alias("m"))
    inner = o.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct("n", "m")))).alias("d"))
    docs = inner.withColumnRenamed("o_orderstatus", "o_orderpriority").selectExpr(f"parse_json(to_json({_BY_PRIORITY})) AS doc")
    a = Analyzer(spark, _options())
    root = a.merge(a.analyze(docs))
    rounds = len({n.path for n in root.walk() if n.kind == "table"})
    again = a.merge(root)
    kinds = {n.path: n.kind for n in again.walk()}
    return spark.createDataFrame([(rounds, kinds["$[]"], kinds["$[]{}"])], "rounds int, outer_kind string, inner_kind string")


@_query("""WITH e AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), x AS (SELECT min(o_orderkey) AS k0, max(o_orderkey) AS k1, min(o_totalprice) AS p0, max(o_totalprice) AS p1, min(CAST(o_orderdate AS DATE)) AS d0, max(CAST(o_orderdate AS DATE)) AS d1, min(o_orderpriority) AS s0, max(o_orderpriority) AS s1 FROM e),
o AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1)
SELECT field, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM (
SELECT 'dec' AS field, o_orderkey BETWEEN k0 AND k1 AS ok FROM o, x UNION ALL SELECT 'hex', o_orderkey BETWEEN k0 AND k1 FROM o, x UNION ALL SELECT 'price', o_totalprice BETWEEN p0 AND p1 FROM o, x
UNION ALL SELECT 'day', CAST(o_orderdate AS DATE) BETWEEN d0 AND d1 FROM o, x UNION ALL SELECT 'text', o_orderpriority BETWEEN s0 AND s1 FROM o, x UNION ALL SELECT 'flag', o_orderstatus IN ('F', 'O') FROM o, x) GROUP BY 1""")
def validated_by_predicates(spark, sf_dir):
    """Types that are inferred from one half of the orders check the other half."""
    o = _t(spark, sf_dir, "orders")
    as_text = {"dec": F.col("o_orderkey").cast("string"), "hex": F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey"))), "price": F.col("o_totalprice"), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "text": F.col("o_orderpriority"), "flag": F.when(F.col("o_orderstatus") == "F", "off").when(F.col("o_orderstatus") == "O", "on").otherwise("?")}
    half = lambda k: o.where(F.col("o_orderkey") % 2 == k)
    seen = half(0).select(*(v.alias(k) if k != "flag" else F.when(F.col("o_orderkey") % 4 == 0, "off").otherwise("on").alias(k) for k, v in as_text.items()))
    root = Analyzer(spark, _options()).analyze(seen)
    types = {f[0]: f[3] for f in root.item.fields}
    cells = half(1).select(*(types[k].predicate(v).alias(k) for k, v in as_text.items()))
    each = cells.selectExpr(f"stack({len(as_text)}, " + ", ".join(f"'{k}', {k}" for k in as_text) + ") as (field, ok)")
    return each.groupBy("field").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


@_query("""WITH t AS (SELECT o_orderkey % 7 AS k, o_custkey AS c FROM orders)
SELECT 'record' AS kind, count(*) FILTER (WHERE k IN (0, 1, 6)) AS valid, count(*) AS n FROM t UNION ALL SELECT 'list', count(*) FILTER (WHERE k = 2), count(*) FROM t UNION ALL SELECT 'tuple', count(*) FILTER (WHERE k = 2), count(*) FROM t
UNION ALL SELECT 'int', count(*) FILTER (WHERE k = 3), count(*) FROM t UNION ALL SELECT 'bool', count(*) FILTER (WHERE k = 4), count(*) FROM t UNION ALL SELECT 'str', count(*) FILTER (WHERE k = 5), count(*) FROM t UNION ALL SELECT 'value', count(*), count(*) FROM t""")
def accepted_by_kind(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    text = F.when(k < 2, F.concat(F.lit('{"a":'), "o_custkey", F.lit("}"))).when(k == 2, F.concat(F.lit("["), "o_custkey", F.lit(",1]"))).when(k == 3, (F.col("o_custkey") + 2).cast("string")).when(k == 4, "true").when(k == 5, '"text"').otherwise("{}")
    v = F.parse_json(text)
    wide = lambda a, b: Stats(1, 1, a, a, a, a, b, True)
    types = (Node("record"), Node("list"), Node("tuple", lengths=wide(2, 2)), Node("int", values=wide(2, 10**12)), Node("bool"), Node("str", values=wide("", "~")), Node("value"))
    got = _t(spark, sf_dir, "orders").agg(F.count("*").alias("n"), *(F.count_if(n.accepts(v)).alias(n.kind) for n in types))
    return got.selectExpr(f"stack({len(types)}, " + ", ".join(f"'{n.kind}', {n.kind}, n" for n in types) + ") as (kind, valid, n)")


@_query("""SELECT 'nation' AS a, 'region' AS b, false AS alike UNION ALL SELECT 'orders even', 'orders odd', true UNION ALL SELECT 'keys of orders', 'keys of customer', true UNION ALL SELECT 'names', 'keys of orders', false""")
def compatible_structures(spark, sf_dir):
    """Whether analysed structures are alike: records by shared fields, scalars by type."""
    a = lambda df: Analyzer(spark, _options()).analyze(df)
    tables = {t: a(_t(spark, sf_dir, t)).item for t in ("nation", "region")}
    rows = [(x, y, tables[x].compatible(tables[y])) for x in tables for y in tables if x < y]
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    even, odd = a(o.where("o_orderkey % 2 = 0")), a(o.where("o_orderkey % 2 = 1"))
    fields = {f[0]: f[3] for x in (even, a(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"))) for f in x.item.fields}
    rows.append(("orders even", "orders odd", even.compatible(odd)))
    rows += [("keys of orders", "keys of customer", fields["o_orderkey"].compatible(fields["c_custkey"])), ("names", "keys of orders", fields["c_name"].compatible(fields["o_orderkey"]))]
    return spark.createDataFrame(rows, "a string, b string, alike boolean")


@_query("""SELECT 'c_custkey' AS field, 'int range=' || (SELECT min(c_custkey) FROM customer) || '..' || (SELECT CASE WHEN max(c_custkey) >= 1000 THEN printf('%.1fK', max(c_custkey) / 1000.0) ELSE CAST(max(c_custkey) AS VARCHAR) END FROM customer) AS text
UNION ALL SELECT 'c_name', 'str range="' || (SELECT min(c_name) FROM customer) || '".."' || (SELECT max(c_name) FROM customer) || '" pattern="Customer#000000ddd"' WHERE (SELECT max(c_custkey) FROM customer) < 1001
UNION ALL SELECT 'c_name', 'str range="' || (SELECT min(c_name) FROM customer) || '".."' || (SELECT max(c_name) FROM customer) || '" pattern="Customer#00000dddd"' WHERE (SELECT max(c_custkey) FROM customer) BETWEEN 1001 AND 9999""")
def rendered_fields(spark, sf_dir):
    root = Analyzer(spark, _options()).analyze(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    return spark.createDataFrame([(k, n.render()) for k, _, _, n in root.item.fields], "field string, text string")


@_query("""SELECT 'n_name' AS field, '"NATION_0"' AS lo, 'StringType()' AS type UNION ALL SELECT 'n_nationkey', '0', 'LongType()' UNION ALL SELECT 'n_regionkey', '0', 'LongType()'""")
def profile_text(spark, sf_dir):
    """Of each field: its smallest value as text, and its Spark type."""
    root = Analyzer(spark, _options()).analyze(_t(spark, sf_dir, "nation"))
    return spark.createDataFrame([(k, format_value(n.values.min), str(n.spark_type())) for k, _, _, n in root.item.fields], "field string, lo string, type string")


@_query("""WITH h AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k, count(*) OVER () AS c FROM h) SELECT '"' || v || '"' AS literal, n FROM r WHERE k <= 3 OR k > c - 3""")
def format_sample_literals(spark, sf_dir):
    root = Analyzer(spark, _options()).analyze(_t(spark, sf_dir, "part").select("p_type"))
    return spark.createDataFrame([(format_value(v), n) for v, n in root.item.fields[0][3].values.samples], "literal string, n long")


@_query("""SELECT k AS name, e AS encoding, f AS format FROM (VALUES ('json', 'utf-8', 'json'), ('csv', 'utf-8', 'csv'), ('yaml', 'utf-8', 'yaml'), ('xml', 'utf-8', 'xml'), ('latin', 'latin-1', 'csv'), ('wide', 'utf-16', 'csv'), ('marked', 'utf-8-sig', 'csv')) t(k, e, f)""")
def encoding_and_format_detect(spark, sf_dir):
    """Of the nations, written in several ways."""
    rows = [(r.n_name, r.n_regionkey) for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    table = "name,région\n" + "".join(f"{n},{k}\n" for n, k in rows)
    yaml = "".join(f"- name: {n}\n  region: {k}\n" for n, k in rows)
    heads = {"json": '[{"a": 1}]'.encode(), "csv": table.encode(), "yaml": yaml.encode(), "xml": b"<?xml version='1.0'?><a/>", "latin": table.encode("latin-1"), "wide": table.encode("utf-16"), "marked": table.encode("utf-8-sig")}
    got = [(k, e := reader.detect_encoding(b), reader.detect_format(b.decode(e))) for k, b in heads.items()]
    return spark.createDataFrame(got, "name string, encoding string, format string")


@_query("""WITH v AS (SELECT path, v FROM (SELECT '0|1' AS path, CAST(quality AS VARCHAR) AS v FROM labels WHERE quality IS NOT NULL UNION ALL SELECT 'text', o_orderstatus FROM orders UNION ALL SELECT 'dec', CAST(o_orderkey * 11 AS VARCHAR) FROM orders UNION ALL SELECT 'price', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders))
SELECT path AS path_id, CASE path WHEN '0|1' THEN 'bool' WHEN 'dec' THEN 'int' WHEN 'price' THEN 'float' ELSE 'fixed' END AS chosen, count(*) AS total FROM v GROUP BY 1""")
def chosen_conversions(spark, sf_dir):
    """The conversion that the analyzer itself chooses from one aggregation over all paths' distinct strings."""
    o = _t(spark, sf_dir, "orders")
    cells = _t(spark, sf_dir, "labels").where("quality is not null").select(F.lit("0|1").alias("path_id"), F.col("quality").cast("string").alias("v"))
    for path, v in (("text", F.col("o_orderstatus")), ("dec", (F.col("o_orderkey") * 11).cast("string")), ("price", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))):
        cells = cells.unionByName(o.select(F.lit(path).alias("path_id"), v.alias("v")))
    rows = []
    for r in infer.evidence(stats.histogram(cells, F.col("v"), "path_id"), _options()).collect():  # a row per path
        how, c, _ = infer.chosen(r, _options())
        rows.append((r.path_id, c.kind if c else how, r.total))
    return spark.createDataFrame(rows, "path_id string, chosen string, total long")


@_query("""WITH h AS (SELECT DISTINCT s_name FROM supplier) SELECT 'Supplier#000000' || CASE WHEN (SELECT count(*) FROM h) > 100 THEN 'ddd' WHEN (SELECT count(*) FROM h) > 10 THEN '0dd' ELSE '00d' END AS pattern FROM (SELECT 1) WHERE (SELECT count(*) FROM h) <= 1000""")
def mined_pattern_supplier(spark, sf_dir):
    hist = stats.histogram(_t(spark, sf_dir, "supplier").withColumn("path_id", F.lit("$")), F.col("s_name"), "path_id")
    found = infer.patterns(hist, spark.createDataFrame([("$",)], "path_id string"))
    return spark.createDataFrame([("".join(map(str, found["$"])),)], "pattern string")


@_query("SELECT CAST(1 + (SELECT count(*) FROM region) * 3 AS BIGINT) AS nodes")
def measured_nodes(spark, sf_dir):
    """Containers, keys and values of a list of records of one field: the list, then a record, a key and a value each."""
    docs = spark.createDataFrame([(1,)], "x int")
    names = [r.r_name for r in _t(spark, sf_dir, "region").collect()]  # five rows
    return docs.select(F.lit(Analyzer(spark, _options()).measure([{"name": n} for n in names])).cast("long").alias("nodes"))


@_query("""WITH x AS (SELECT min(o_orderkey) AS k0, max(o_orderkey) AS k1, min(o_orderstatus) AS s0, max(o_orderstatus) AS s1, min(o_totalprice) FILTER (WHERE o_totalprice > 100000) AS p0, max(o_totalprice) FILTER (WHERE o_totalprice > 100000) AS p1 FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey % 5 AS form, count(*) FILTER (WHERE o_orderkey % 5 = 0 AND o_orderkey BETWEEN k0 AND k1 AND o_orderstatus BETWEEN s0 AND s1 AND (o_totalprice <= 100000 OR o_totalprice BETWEEN p0 AND p1)) AS valid, count(*) AS n FROM orders, x GROUP BY 1""")
def validated_structures(spark, sf_dir):
    """Records inferred from one half of the orders check all of them: as they are, without a field, with a field
    too many, with a field of another type, and with one out of range."""
    o, form = _t(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    price = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    doc = lambda *more, key=F.col("o_orderkey"), status=F.col("o_orderstatus"), price=price: F.parse_json(F.to_json(F.struct(key.alias("key"), status.alias("status"), price.alias("price"), *more)))
    root = Analyzer(spark, _options()).analyze(o.where("o_orderkey % 2 = 0").select(doc().alias("doc")))
    forms = F.when(form == 0, doc()).when(form == 1, doc(status=F.lit(None).cast("string"))).when(form == 2, doc(F.lit(1).alias("other"))).when(form == 3, doc(key=F.lit("x"))).otherwise(doc(price=F.lit(1e12)))
    return o.select(form.alias("form"), root.item.matches(forms).alias("ok")).groupBy("form").agg(F.count_if("ok").alias("valid"), F.count("*").alias("n"))
