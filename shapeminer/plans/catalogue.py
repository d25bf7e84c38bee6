"""The profiling operators as queries over the driver's tables, each with an oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import charclass, infer, nodes, stats
from ..options import Options

_QUERIES: dict = {}
_ORACLES: dict = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quartiles_sql(hist: str, key: str) -> str:
    """The quartile rule in DuckDB's SQL over a histogram (key, v, n)."""
    return f"""
WITH h AS ({hist}),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(n) OVER (PARTITION BY {key}) AS c FROM h)
SELECT {key}, CAST(max(c) AS BIGINT) AS card, count(*) AS distinct_values, min(v) AS "min",
  coalesce(min(v) FILTER (WHERE bef >= c // 4), max(v)) AS q1, coalesce(min(v) FILTER (WHERE bef >= (2 * c) // 4), max(v)) AS q2,
  coalesce(min(v) FILTER (WHERE bef >= (3 * c) // 4), max(v)) AS q3, max(v) AS "max", max(n) = 1 AS is_unique
FROM b GROUP BY {key}"""


def _whole(df: DataFrame, value) -> DataFrame:
    return stats.histogram(df.withColumn("path_id", F.lit("$")), value, "path_id")


@_query("SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1")
def value_counts_order_priority(spark, sf_dir):
    return stats.histogram(_t(spark, sf_dir, "orders"), F.col("o_orderpriority"))


@_query(_quartiles_sql("SELECT '$' AS path_id, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2", "path_id"))
def quartiles_lineitem_quantity(spark, sf_dir):
    return stats.statistics(_whole(_t(spark, sf_dir, "lineitem"), F.col("l_quantity")), "path_id")


@_query(_quartiles_sql("SELECT '$' AS path_id, o_totalprice AS v, count(*) AS n FROM orders GROUP BY 1, 2", "path_id"))
def quartiles_order_totalprice(spark, sf_dir):
    return stats.statistics(_whole(_t(spark, sf_dir, "orders"), F.col("o_totalprice")), "path_id")


@_query(_quartiles_sql("SELECT l_returnflag, l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1, 2", "l_returnflag"))
def quartiles_by_returnflag(spark, sf_dir):
    return stats.statistics(stats.histogram(_t(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), "l_returnflag"), "l_returnflag")


def _unpivoted(df: DataFrame) -> DataFrame:
    cols = ", ".join(f"'{c}', cast(`{c}` as string)" for c in df.columns)
    return df.selectExpr(f"stack({len(df.columns)}, {cols}) as (path_id, v)")


@_query("""
WITH u AS (UNPIVOT (SELECT c_custkey::VARCHAR AS c_custkey, c_name::VARCHAR AS c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment::VARCHAR AS c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR AS c_acctbal FROM customer) ON * INTO NAME path_id VALUE v),
h AS (SELECT path_id, v, count(*) AS n FROM u GROUP BY 1, 2)
SELECT path_id, CAST(sum(n) AS BIGINT) AS card, count(*) AS distinct_values, max(n) = 1 AS is_unique FROM h GROUP BY 1""")
def unique_column_scan(spark, sf_dir):
    df = _unpivoted(_t(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")))
    return stats.histogram(df, F.col("v"), "path_id").groupBy("path_id").agg(F.sum("n").alias("card"), F.count("*").alias("distinct_values"), (F.max("n") == 1).alias("is_unique"))


@_query(_quartiles_sql("SELECT '$' AS path_id, CAST(length(p_name) AS INTEGER) AS v, count(*) AS n FROM part GROUP BY 1, 2", "path_id"))
def length_stats_part_name(spark, sf_dir):
    return stats.statistics(stats.lengths(_whole(_t(spark, sf_dir, "part"), F.col("p_name")), "path_id"), "path_id")


@_query("SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1")
def stats_merge_two_halves(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    half = lambda k: stats.histogram(o.where(F.col("o_orderkey") % 2 == k), F.col("o_orderstatus"))
    return stats.merged(half(0), half(1), "v")


@_query("""SELECT o_orderstatus AS v, CAST(count(*) FILTER (WHERE o_orderkey % 3 <> 0) - count(*) FILTER (WHERE o_orderkey % 3 = 0) AS BIGINT) AS n FROM orders
GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 3 <> 0) > count(*) FILTER (WHERE o_orderkey % 3 = 0)""")
def multiset_subtract_status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    part = lambda c: stats.histogram(o.where(c), F.col("o_orderstatus"))
    return stats.subtracted(part("o_orderkey % 3 != 0"), part("o_orderkey % 3 = 0"), "v")


@_query("SELECT n_regionkey AS v FROM nation")
def elements_expand(spark, sf_dir):
    return stats.elements(stats.histogram(_t(spark, sf_dir, "nation"), F.col("n_regionkey")))


@_query("""
WITH h AS (SELECT '$' AS path_id, p_type AS v, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rank, count(*) OVER () AS k FROM h)
SELECT path_id, v, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3 OR rank > k - 3""")
def top_bottom_common_part_type(spark, sf_dir):
    return stats.common_and_rare(_whole(_t(spark, sf_dir, "part"), F.col("p_type")), "path_id")


def _props(spark, sf_dir):
    return nodes.typed(_t(spark, sf_dir, "events").select(F.lit("$[]").alias("path_id"), F.parse_json("props").alias("v")))


@_query(_quartiles_sql("SELECT '$[].k' AS path_id, CAST(props->>'$.k' AS DECIMAL(38,0)) AS v, count(*) AS n FROM events GROUP BY 1, 2", "path_id"))
def json_flatten_props(spark, sf_dir):
    kids = nodes.children(_props(spark, sf_dir)).select(F.concat("path_id", F.lit("."), "key").alias("path_id"), F.col("child").alias("v"))
    return stats.statistics(nodes.scalars(nodes.typed(kids)).select("path_id", F.col("i").alias("v"), "n"), "path_id")


_ORDERS_DOC = "to_json(struct(o_orderkey AS key, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price))"


@_query("""
WITH d AS (SELECT o_orderkey AS key, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders),
k AS (SELECT 'key' AS key, count(key) AS n FROM d UNION ALL SELECT 'status', count(status) FROM d UNION ALL SELECT 'price', count(price) FROM d)
SELECT key, n, n < (SELECT count(*) FROM d) AS optional FROM k WHERE n > 0""")
def json_key_frequency_optional(spark, sf_dir):
    docs = _t(spark, sf_dir, "orders").selectExpr("'$[]' AS path_id", f"parse_json({_ORDERS_DOC}) AS v")
    parents = docs.agg(F.count("*").alias("parents"))
    keys = nodes.children(nodes.typed(docs)).groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(F.broadcast(parents)).select("key", "n", (F.col("n") < F.col("parents")).alias("optional"))  # one row


@_query("""
SELECT 'nation' AS path_id, count(DISTINCT n_name) AS distinct_keys, CASE WHEN count(DISTINCT n_name) < 20 THEN 'record' ELSE 'table' END AS kind FROM nation
UNION ALL SELECT 'region', count(DISTINCT r_name), CASE WHEN count(DISTINCT r_name) < 20 THEN 'record' ELSE 'table' END FROM region""")
def record_vs_table(spark, sf_dir):
    doc = lambda t, k, v: _t(spark, sf_dir, t).select(F.lit(t).alias("path_id"), F.to_variant_object(F.create_map(k, v)).alias("v"))
    both = doc("nation", "n_name", "n_nationkey").unionByName(doc("region", "r_name", "r_regionkey"))
    keys = nodes.children(nodes.typed(both)).groupBy("path_id").agg(F.countDistinct("key").alias("distinct_keys"))
    return keys.withColumn("kind", F.when(F.col("distinct_keys") < Options().field_threshold, "record").otherwise("table"))


@_query("SELECT '$' AS path_id, count(*) AS n, CAST(2 AS BIGINT) AS width, CASE WHEN count(*) > 2 THEN 'tuple' ELSE 'list' END AS kind FROM lineitem")
def list_as_tuple(spark, sf_dir):
    docs = _t(spark, sf_dir, "lineitem").select(F.lit("$").alias("path_id"), F.to_variant_object(F.array("l_quantity", "l_tax")).alias("v"))
    agg = nodes.typed(docs).groupBy("path_id").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("size").alias("width"))
    tuple_ = (F.col("lo") == F.col("width")) & (F.col("n") > F.col("width")) & F.col("width").between(1, Options().field_threshold - 1)
    return agg.select("path_id", "n", "width", F.when(tuple_, "tuple").otherwise("list").alias("kind"))


@_query("SELECT CAST(pos AS INTEGER) AS pos, count(*) AS card, count(DISTINCT x) AS distinct_values, min(x) AS \"min\", max(x) AS \"max\" FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1")
def tuple_positions(spark, sf_dir):
    each = _t(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("pos").agg(F.count("*").alias("card"), F.countDistinct("x").alias("distinct_values"), F.min("x").alias("min"), F.max("x").alias("max"))


@_query("""SELECT k AS path_id, count(*) AS n, count(*) FILTER (WHERE o_custkey % k = 0) AS nulls, count(*) FILTER (WHERE o_custkey % k = 0) > 0.4 * count(*) AS over FROM orders, (VALUES (2), (3), (10)) t(k) GROUP BY 1""")
def null_budget(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select("o_custkey", F.explode(F.array(F.lit(2), F.lit(3), F.lit(10))).alias("path_id"))
    held = keys.withColumn("v", F.when(F.col("o_custkey") % F.col("path_id") != 0, F.col("o_custkey")))
    return held.groupBy("path_id").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), (F.count_if(F.col("v").isNull()) > 0.4 * F.count("*")).alias("over"))


@_query("""SELECT role AS path_id, count(*) AS total, count(*) FILTER (WHERE turn % 3 = 0) AS blank, count(*) FILTER (WHERE turn % 3 = 0) > 0.98 * count(*) AS plain FROM conversations GROUP BY 1""")
def blank_budget(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("role").alias("path_id"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("v"))
    hist = stats.histogram(c.where("v is not null"), F.col("v"), "path_id")
    out = hist.groupBy("path_id").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("v") == "", F.col("n"))), F.lit(0)).alias("blank"))
    return out.withColumn("plain", F.col("blank") > 0.98 * F.col("total"))


@_query("SELECT '$' AS path_id, lang AS v, count(*) AS n FROM documents GROUP BY 1, 2")
def strip_recount(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "\t ").otherwise(""), F.col("lang"), F.lit("  ")).alias("v"))
    return infer.prepared(_whole(d, F.col("v")), Options.cli())


def _inferred(hist: DataFrame, options: Options) -> DataFrame:
    """Per path: the winning candidate of the cascade, by its bad and good values."""
    seen = infer.evidence(infer.prepared(hist, options), options)
    budget = F.ceil(F.col("total") * float(options.bad_threshold))
    pick = F.lit(None)
    for k, c in reversed(list(enumerate(infer.CASCADE))):
        pick = F.when((F.col("max_len") <= options.max_numeric_len) & (F.col(f"good{k}") > 0) & (F.col(f"bad{k}") <= budget), F.lit(f"{c.kind}:{c.pattern}")).otherwise(pick)
    return seen.select("path_id", "total", "blank", F.coalesce(pick, F.when(F.col("url"), "url"), F.lit("str")).alias("type"))


@_query("SELECT '$' AS path_id, count(*) AS total, CAST(0 AS BIGINT) AS blank, 'bool:0|1' AS type FROM labels WHERE quality IS NOT NULL")
def infer_bool_strings(spark, sf_dir):
    return _inferred(_whole(_t(spark, sf_dir, "labels").where("quality is not null"), F.col("quality").cast("string")), Options.cli())


@_query("""SELECT 'hex' AS path_id, count(*) AS total, CAST(0 AS BIGINT) AS blank, 'int:x' AS type FROM orders
UNION ALL SELECT 'dec', count(*), 0, 'int:d' FROM orders""")
def infer_int_base(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    both = o.selectExpr("'hex' AS path_id", "lower(hex(o_orderkey)) AS v").union(o.selectExpr("'dec' AS path_id", "cast(o_orderkey AS string) AS v"))
    return _inferred(stats.histogram(both, F.col("v"), "path_id"), Options.cli())


@_query("SELECT '$' AS path_id, count(*) AS total, CAST(0 AS BIGINT) AS blank, 'float:f' AS type FROM lineitem")
def infer_float_strings(spark, sf_dir):
    return _inferred(_whole(_t(spark, sf_dir, "lineitem"), F.concat(F.lit("0."), F.lpad((F.col("l_tax") * 100).cast("int").cast("string"), 2, "0"), F.lit("9"))), Options.cli())


@_query("""SELECT '$' AS path_id, min(ts) AS "min", max(ts) AS "max", count(*) AS n FROM (SELECT date_trunc('minute', CAST(o_orderdate AS TIMESTAMP)) AS ts FROM orders)""")
def infer_datetime_strings(spark, sf_dir):
    text = _whole(_t(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    got = C.parse_datetime(F.col("v"), "%Y-%m-%dT%H:%M").cast("timestamp_ntz")
    return text.groupBy("path_id").agg(F.min(got).alias("min"), F.max(got).alias("max"), F.sum("n").alias("n"))


@_query("""SELECT '$' AS path_id, count(*) AS total, CAST(0 AS BIGINT) AS blank, CASE WHEN count(*) FILTER (WHERE o_orderkey % 200 = 0) <= ceil(count(*) * 0.01) THEN 'int:d' ELSE 'str' END AS type FROM orders""")
def bad_threshold_cascade(spark, sf_dir):
    return _inferred(_whole(_t(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 200 == 0, "foo").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("9")))), Options.cli())


@_query("""SELECT '$' AS path_id, min(date_trunc('second', ts)) AS "min", max(date_trunc('second', ts)) AS "max", count(*) AS n, min(epoch(ts)) >= 946684800 AND max(epoch(ts)) <= 2051222400 AS is_timestamp FROM events""")
def numeric_timestamp_detect(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("v"))
    at = lambda c: C.from_number(c, 0, 1).cast("timestamp_ntz")
    return e.groupBy(F.lit("$").alias("path_id")).agg(at(F.min("v")).alias("min"), at(F.max("v")).alias("max"), F.count("*").alias("n"), ((F.min("v") >= 946684800) & (F.max("v") <= 2051222400)).alias("is_timestamp"))


@_query("""SELECT o_orderkey, date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) AS ts FROM orders""")
def excel_epoch_detect(spark, sf_dir):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", C.from_number(days, -2209161600.0, 86400.0).cast("timestamp_ntz").alias("ts"))


@_query("SELECT '$' AS path_id, count(*) AS n, bool_and(regexp_matches(url, '^https?://')) AS url FROM pages")
def url_detect(spark, sf_dir):
    return _whole(_t(spark, sf_dir, "pages"), F.col("url")).groupBy("path_id").agg(F.sum("n").alias("n"), F.bool_and(C.is_url(F.col("v"))).alias("url"))


_CHARS_SQL = """WITH s AS (SELECT DISTINCT {c} AS v FROM {t}), c AS (SELECT DISTINCT CAST(i - 1 AS INTEGER) AS pos, v[i] AS ch FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM s))
SELECT pos, string_agg(ch, '' ORDER BY ch) AS chars FROM c GROUP BY 1"""


def _positions(spark, sf_dir, table, col):
    return charclass.positions(_whole(_t(spark, sf_dir, table), F.col(col)), "path_id").select("pos", F.array_join("chars", "").alias("chars"))


@_query(f"""SELECT '$' AS path_id, string_agg(CASE WHEN length(chars) = 1 THEN chars WHEN regexp_full_match(chars, '[0-7]+') AND NOT bool_or(length(chars) > 1 AND NOT regexp_full_match(chars, '[0-7]+')) OVER () THEN 'o' WHEN regexp_full_match(chars, '[0-9]+') THEN 'd' ELSE '.' END, '' ORDER BY pos) AS pattern
FROM (SELECT pos, chars, bool_or(length(chars) > 1 AND regexp_matches(chars, '[89]')) OVER () AS dec FROM ({_CHARS_SQL.format(c="c_name", t="customer")}))""".replace("WHEN regexp_full_match(chars, '[0-7]+') AND NOT bool_or(length(chars) > 1 AND NOT regexp_full_match(chars, '[0-7]+')) OVER () THEN 'o'", "WHEN regexp_full_match(chars, '[0-7]+') AND NOT dec THEN 'o'"))
def fixed_pattern_customer_name(spark, sf_dir):
    hist = _whole(_t(spark, sf_dir, "customer"), F.col("c_name"))
    sets = charclass.positions(hist, "path_id").select("path_id", "pos", F.array_join("chars", "").alias("c"))
    dec = F.array_join("sets.c", "\n").rlike(r"(?m)^(?=[0-9]{2,}$).*[89]")
    one = lambda s: F.when(F.length(s["c"]) == 1, s["c"]).when(s["c"].rlike("^[0-9]+$"), F.when(F.col("dec"), "d").otherwise("o")).otherwise(".")
    return sets.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("sets")).withColumn("dec", dec).select("path_id", F.array_join(F.transform("sets", one), "").alias("pattern"))


@_query(_CHARS_SQL.format(c="s_name", t="supplier"))
def char_set_by_position(spark, sf_dir):
    return _positions(spark, sf_dir, "supplier", "s_name")


@_query("""WITH a AS (SELECT DISTINCT p_brand[i] AS c FROM (SELECT p_brand, unnest(range(1, length(p_brand) + 1)) AS i FROM part)), b AS (SELECT unnest(string_split('0123456789ABCDEFabcdef', '')) AS c)
SELECT (SELECT count(*) FROM (SELECT c FROM a UNION SELECT c FROM b)) AS n_union, (SELECT string_agg(c, '' ORDER BY c) FROM (SELECT c FROM a INTERSECT SELECT c FROM b)) AS both,
(SELECT string_agg(c, '' ORDER BY c) FROM (SELECT c FROM a EXCEPT SELECT c FROM b)) AS only, (SELECT count(*) FROM (SELECT c FROM a UNION SELECT c FROM b)) - (SELECT count(*) FROM (SELECT c FROM a INTERSECT SELECT c FROM b)) AS n_symmetric""")
def charclass_algebra(spark, sf_dir):
    a = _t(spark, sf_dir, "part").select(F.explode(F.split("p_brand", "")).alias("c")).where("c != ''").agg(F.collect_set("c").alias("a"))
    b = F.array(*map(F.lit, sorted(charclass.HEX)))
    text = lambda x: F.array_join(F.array_sort(x), "")
    return a.select(F.size(F.array_union("a", b)).cast("long").alias("n_union"), text(F.array_intersect("a", b)).alias("both"), text(F.array_except("a", b)).alias("only"), F.size(F.array_except(F.array_union("a", b), F.array_intersect("a", b))).cast("long").alias("n_symmetric"))


@_query("""WITH c AS (SELECT DISTINCT ascii(p_brand[i]) AS o FROM (SELECT p_brand, unnest(range(1, length(p_brand) + 1)) AS i FROM part)), g AS (SELECT o, o - row_number() OVER (ORDER BY o) AS k FROM c)
SELECT CAST(min(o) AS INTEGER) AS first, CAST(max(o) AS INTEGER) AS last FROM g GROUP BY k""")
def char_ranges(spark, sf_dir):
    from pyspark.sql import Window

    c = _t(spark, sf_dir, "part").select(F.explode(F.split("p_brand", "")).alias("c")).where("c != ''").select(F.ascii("c").alias("o")).distinct()
    runs = c.withColumn("k", F.col("o") - F.row_number().over(Window.orderBy("o")))  # an alphabet at most
    return runs.groupBy("k").agg(F.min("o").alias("first"), F.max("o").alias("last")).drop("k")


@_query("SELECT l_linenumber AS a, lead(l_linenumber) OVER (ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_linenumber FROM lineitem) QUALIFY b IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    from pyspark.sql import Window

    d = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a")).distinct()
    return d.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b is not null")


@_query("""WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice BETWEEN lo AND hi) AS valid, count(*) FILTER (WHERE NOT o_totalprice BETWEEN lo AND hi) AS invalid FROM orders, r WHERE o_orderkey % 2 = 1 GROUP BY 1""")
def validate_range_split(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    seen = F.broadcast(o.where("o_orderkey % 2 = 0").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))  # one row
    ok = F.col("o_totalprice").between(F.col("lo"), F.col("hi"))
    return o.where("o_orderkey % 2 = 1").join(seen).groupBy("o_orderstatus").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@_query("SELECT count(*) FILTER (WHERE regexp_full_match(s, 'Customer#[0-9]{9}')) AS valid, count(*) AS n FROM (SELECT s_name AS s FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT c_name || '0' FROM customer)")
def validate_str_pattern(spark, sf_dir):
    from .pattern import Node, Stats

    sets = [*map(charclass.CharClass, "Customer#"), *[charclass.DEC] * 9]
    node = Node("str", pattern=tuple(sets), values=Stats(1, 1, "", "", "", "", "~", True))
    c = _t(spark, sf_dir, "customer")
    names = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("s")).union(c.select("c_name")).union(c.select(F.concat("c_name", F.lit("0"))))
    return names.agg(F.count_if(node.predicate(F.col("s"))).alias("valid"), F.count("*").alias("n"))


@_query("SELECT CAST(count(*) FILTER (WHERE event_id % 50 <> 0) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE event_id % 50 = 0) AS BIGINT) AS rejected FROM events")
def validate_reject_keys(spark, sf_dir):
    keys = _t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("k"))
    ok = C.parse_int(F.col("k"), 10).isNotNull()
    return keys.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


def _keys_by_status(spark, sf_dir, status):
    doc = _t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).selectExpr("'$' AS path_id", f"parse_json({_ORDERS_DOC}) AS v")
    return nodes.children(nodes.typed(doc)).groupBy("key").agg(F.count("*").alias("n"))


@_query("""WITH d AS (SELECT o_orderstatus AS st, o_orderkey AS key, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders),
k AS (SELECT st, 'key' AS key, count(key) AS n FROM d GROUP BY 1 UNION ALL SELECT st, 'status', count(status) FROM d GROUP BY 1 UNION ALL SELECT st, 'price', count(price) FROM d GROUP BY 1),
a AS (SELECT key, n FROM k WHERE st = 'F' AND n > 0), b AS (SELECT key, n FROM k WHERE st = 'P' AND n > 0)
SELECT coalesce(a.key, b.key) AS key, a.n AS left_n, b.n AS right_n, a.n IS NULL OR b.n IS NULL AS optional,
(SELECT count(*) FROM a JOIN b USING (key)) >= ceil(0.5 * least((SELECT count(*) FROM a), (SELECT count(*) FROM b))) AS alike FROM a FULL JOIN b ON a.key = b.key""")
def field_outer_join_similarity(spark, sf_dir):
    a, b = _keys_by_status(spark, sf_dir, "F").toDF("ka", "left_n"), _keys_by_status(spark, sf_dir, "P").toDF("kb", "right_n")
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    total = F.broadcast(both.agg((F.count_if(F.col("ka").isNotNull() & F.col("kb").isNotNull()) >= F.ceil(0.5 * F.least(F.count("ka"), F.count("kb")))).alias("alike")))  # one row
    return both.join(total).select(F.coalesce("ka", "kb").alias("key"), "left_n", "right_n", (F.col("left_n").isNull() | F.col("right_n").isNull()).alias("optional"), "alike")


@_query("SELECT r_name, r_name BETWEEN (SELECT min(n_name) FROM nation) AND (SELECT max(n_name) FROM nation) AS fits FROM region")
def field_cross_generic(spark, sf_dir):
    key = F.broadcast(_t(spark, sf_dir, "nation").agg(F.min("n_name").alias("lo"), F.max("n_name").alias("hi")))  # one row
    return _t(spark, sf_dir, "region").join(key).select("r_name", F.col("r_name").between(F.col("lo"), F.col("hi")).alias("fits"))


@_query("SELECT field, sum(n)::BIGINT AS n, bool_or(n < total) AS optional FROM (SELECT o_orderstatus, 'priority' AS field, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS n, count(*) AS total FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'price', count(*), count(*) FROM orders GROUP BY 1) GROUP BY 1")
def merge_records_by_status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderstatus", F.explode(F.array(F.struct(F.lit("price").alias("field"), F.lit(True).alias("has")), F.struct(F.lit("priority").alias("field"), (F.col("o_orderpriority") != "5-LOW").alias("has")))).alias("f"))
    per = o.groupBy("o_orderstatus", "f.field").agg(F.count_if("f.has").alias("n"), F.count("*").alias("total"))
    return per.groupBy("field").agg(F.sum("n").alias("n"), F.bool_or(F.col("n") < F.col("total")).alias("optional"))


@_query("SELECT coalesce(a.pos, b.pos) AS pos, a.c AS a, b.c AS b FROM (SELECT * FROM (VALUES (0, 'x'), (1, 'y')) t(pos, c)) a FULL JOIN (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS pos, r_name AS c FROM region) b ON a.pos = b.pos")
def tuple_outer_join(spark, sf_dir):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, a string")
    b = _t(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r")).select(F.posexplode("r.r_name").alias("pos", "b"))
    return a.join(b, "pos", "full_outer")


_TYPES = ("bool", "int", "float", "str", "url", "datetime")


@_query("""WITH w(narrow, wide) AS (VALUES ('bool','bool'),('bool','int'),('bool','float'),('int','int'),('int','float'),('float','float'),('url','url'),('url','str'),('str','str'),('datetime','datetime')),
t(k) AS (VALUES ('bool'),('int'),('float'),('str'),('url'),('datetime'))
SELECT a.k AS a, b.k AS b, coalesce((SELECT max(wide) FROM w WHERE narrow = a.k AND wide = b.k), (SELECT max(wide) FROM w WHERE narrow = b.k AND wide = a.k)) AS wide FROM t a, t b""")
def widen_types(spark, sf_dir):
    from .pattern import _WIDER

    rows = [(a, b, b if b in _WIDER[a] else a if a in _WIDER[b] else None) for a in _TYPES for b in _TYPES]
    return spark.createDataFrame(rows, "a string, b string, wide string")


@_query("""SELECT p_partkey, CASE WHEN p_partkey * 997 >= 1000000000 THEN printf('%.1fG', p_partkey * 997 / 1000000000.0) WHEN p_partkey * 997 >= 1000000 THEN printf('%.1fM', p_partkey * 997 / 1000000.0) WHEN p_partkey * 997 >= 1000 THEN printf('%.1fK', p_partkey * 997 / 1000.0) ELSE CAST(p_partkey * 997 AS VARCHAR) END AS si FROM part""")
def format_int_si(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", C.format_int(F.col("p_partkey") * 997).alias("si"))


@_query("""WITH q AS (SELECT l_returnflag AS f, min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_quantity, 0.5) AS q2, quantile_disc(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
k AS (SELECT f, CAST(floor(9 * ((q1 - lo) / (hi - lo))) AS INTEGER) AS a, CAST(floor(9 * ((q2 - lo) / (hi - lo))) AS INTEGER) AS b, CAST(floor(9 * ((q3 - lo) / (hi - lo))) AS INTEGER) AS c FROM q)
SELECT f AS l_returnflag, (SELECT string_agg(CASE i WHEN c THEN '3' WHEN b THEN '2' WHEN a THEN '1' ELSE '.' END, '' ORDER BY i) FROM range(10) r(i)) AS graph FROM k""")
def quartile_graph(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    q = li.groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.expr("percentile_disc(0.25) within group (order by l_quantity)").alias("q1"), F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("q2"), F.expr("percentile_disc(0.75) within group (order by l_quantity)").alias("q3"))
    return q.select("l_returnflag", C.sparkline(*map(F.col, ("lo", "q1", "q2", "q3", "hi"))).alias("graph"))


@_query("SELECT * FROM (VALUES ('1h 5min', 3900.0), ('1 week, 2 days', 777600.0), ('30s', 30.0), ('500ms', 0.5)) t(s, seconds)")
def parse_duration_interval(spark, sf_dir):
    from ..functions.text import parse_duration

    rows = [(s, parse_duration(s).total_seconds()) for s in ("1h 5min", "1 week, 2 days", "30s", "500ms")]
    return spark.createDataFrame(rows, "s string, seconds double")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_TEXTS = ("l_returnflag", "l_linestatus")


def _split_sql(kind: str, cells: str) -> str:
    names = ("min", "q1", "q2", "q3", "max")
    own = lambda k: ", ".join(f'"{n}" AS {n}_{k}' if k == kind else f"NULL AS {n}_{k}" for n in names)
    return f"SELECT path_id, card, distinct_values, is_unique, {own('d')}, {own('s')} FROM (" + _quartiles_sql(f"SELECT path_id, v, count(*) AS n FROM (UNPIVOT (SELECT {cells} FROM lineitem) ON * INTO NAME path_id VALUE v) GROUP BY 1, 2", "path_id") + ")"


@_query(_split_sql("d", ", ".join(f"{c}::DOUBLE AS {c}" for c in _NUMBERS) + ", epoch(CAST(l_shipdate AS TIMESTAMP))::DOUBLE AS l_shipdate") + " UNION ALL " + _split_sql("s", ", ".join(_TEXTS)))
def profile_lineitem(spark, sf_dir):
    """The flat profile of all columns: one scan, one histogram, windows over ranges of values."""
    cells = [f"'{c}', named_struct('d', cast({c} as double), 's', cast(null as string))" for c in _NUMBERS]
    cells.append("'l_shipdate', named_struct('d', cast(unix_timestamp(cast(l_shipdate as timestamp)) as double), 's', cast(null as string))")
    cells += [f"'{c}', named_struct('d', cast(null as double), 's', {c})" for c in _TEXTS]
    li = _t(spark, sf_dir, "lineitem").selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (path_id, v)")
    got = stats.statistics(stats.histogram(li, F.col("v"), "path_id"), "path_id", spread=64)
    return got.select("path_id", "card", "distinct_values", "is_unique", *(F.col(f"{n}.{k}").alias(f"{n}_{k}") for k in "ds" for n in ("min", "q1", "q2", "q3", "max")))


@_query("""SELECT 'price' AS path_id, CAST(0 AS BIGINT) AS bad, count(DISTINCT CAST(o_totalprice AS VARCHAR)) AS good, true AS converts FROM orders
UNION ALL SELECT 'status', count(*), 0, false FROM orders""")
def try_conversion_float(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    both = o.selectExpr("'price' AS path_id", "cast(cast(o_totalprice AS decimal(18,2)) AS string) AS v").union(o.selectExpr("'status' AS path_id", "o_orderstatus AS v"))
    return infer.try_conversion(stats.histogram(both, F.col("v"), "path_id"), C.parse_float)


@_query("SELECT count(*) FILTER (WHERE l_linenumber % 5 <> 0) AS tuples, count(*) FILTER (WHERE l_linenumber % 5 = 0) AS others FROM lineitem")
def validate_tuple_lengths(spark, sf_dir):
    from .pattern import Node, Stats

    node = Node("tuple", lengths=Stats(1, 1, 2, 2, 2, 2, 2, True))
    v = F.to_variant_object(F.when(F.col("l_linenumber") % 5 == 0, F.array("l_tax")).otherwise(F.array("l_tax", "l_discount")))
    ok = _t(spark, sf_dir, "lineitem").select(node.accepts(v).alias("ok"))
    return ok.agg(F.count_if("ok").alias("tuples"), F.count_if(~F.col("ok")).alias("others"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["profile_events_nested"](spark, sf_dir)


from . import engine  # noqa: E402, F401  registers the queries that run whole analyses
