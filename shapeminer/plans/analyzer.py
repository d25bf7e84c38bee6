"""Structure inference: one pass over the data for each level of nesting, decisions on the driver.

What reaches the driver is one row per path (and the literal keys of record-like mappings, fewer than the field
threshold each). Merging alike sub-structures does not rewrite results: it marks mappings as tables and runs the
levels again, so merged types, counts and statistics come from the data themselves.
"""

from __future__ import annotations

import json
import re
import warnings
from datetime import datetime, timedelta
from fractions import Fraction
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import infer, nodes, stats
from ..options import Options
from .pattern import Node, Stats

_SPECIAL = re.compile(r"([\\.\[\]{}])")


class ValidationWarning(UserWarning):
    """Data that does not match what was inferred of it."""


def field_path(path: str, key: str) -> str:
    return f"{path}.{_SPECIAL.sub(r'\\\1', key)}"


class Analyzer:
    """analyze() infers, merge() collapses alike sub-structures; progress(level, paths) is told of every level."""

    def __init__(self, spark: SparkSession, options: Options | None = None, progress=None):
        self.spark, self.options, self.progress = spark, options or Options.library(), progress
        self._root: tuple[DataFrame | nodes.Mapping, str] | None = None

    # ---- input

    def nodes_of(self, data) -> tuple[DataFrame | nodes.Mapping, str]:
        """(rows of (path_id, v), the root's path) of a DataFrame or of a value that JSON can hold; a Mapping stays."""
        if isinstance(data, nodes.Mapping):
            return data, "$[]"
        if isinstance(data, DataFrame):
            if [t for _, t in data.dtypes] == ["variant"]:
                return data.select(F.lit("$[]").alias("path_id"), F.col(data.columns[0]).alias("v")), "$[]"
            return nodes.documents(data), "$[]"
        text = self.spark.createDataFrame([(json.dumps(data, allow_nan=False),)], "s string")
        return text.select(F.lit("$").alias("path_id"), F.parse_json("s").alias("v")), "$"

    def measure(self, data) -> int:
        """Containers, keys and values of the data, all levels."""
        level, top = self.nodes_of(data)
        total = 0
        if isinstance(level, nodes.Mapping):  # itself and its keys
            kids = level.children(top)
            total, level = 1 + kids.count(), kids.select("path_id", F.col("child").alias("v"))
        level = nodes.typed(level)
        for _ in range(self.options.max_depth):
            n, inner = level.agg(F.count("*"), F.count_if(F.col("kind").isin("object", "array"))).first()
            total += n
            if not inner:
                break
            kids = nodes.children(level)
            total += kids.where("key is not null").count()
            level = nodes.typed(kids.select("path_id", F.col("child").alias("v")))
        return total

    # ---- analysis

    def analyze(self, data) -> Node:
        self._root = self.nodes_of(data)
        return self._run(set())

    def merge(self, root: Node) -> Node:
        """Collapses mappings whose values are alike into tables, until nothing changes."""
        forced: set[str] = set()
        while True:
            new = {n.path for n in root.walk() if n.path not in forced and self._alike(n)}
            if not new or self._root is None:
                return root
            forced |= new
            root = self._run(forced)

    def _alike(self, n: Node) -> bool:
        if n.kind != "record" or len(n.fields) < 2 or not n.fields[0][3].container:
            return False
        first, *rest = (f[3] for f in n.fields)
        return all(first.compatible(x, float(self.options.merge_threshold)) for x in rest)

    def _run(self, forced: set[str]) -> Node:
        o, (root, top) = self.options, self._root
        held, hists, key_hists = [], [], []
        facts: dict[str, dict] = {}
        keep = lambda df: held.append(df.persist(StorageLevel.MEMORY_AND_DISK)) or held[-1]
        whole = isinstance(root, nodes.Mapping)
        level = root if whole else keep(root)
        for depth in range(o.max_depth):
            # of a level's nodes only the distinct values and the containers are held
            hist = keep(level.histogram(top) if level is root and whole else nodes.histogram(level, infer.C.stripped if o.strip_whitespace else None))
            kinds = ("object", "array", "null", "bool", "int", "float", "str", "datetime")
            size, count = F.when(F.col("kind") == "array", F.col("size")), lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
            rows = hist.groupBy("path_id").agg(F.sum("n").alias("n"), *map(count, kinds), F.min(size).alias("lo"), F.max(size).alias("hi")).collect()
            if self.progress:
                self.progress(depth, len(rows))
            here = {r.path_id: r.asDict() | {"mode": self._mode(r)} for r in rows}
            facts |= here
            hists.append(hist)
            inner = {p: f for p, f in here.items() if f["mode"] in ("dict", "list", "tuple")}
            if not inner:
                break
            if level is root and whole:
                kids = level.children(top)
            else:
                own = self._only(level, list(inner))
                kids = nodes.exploded((keep(own) if depth else own).withColumn("kind", F.lit(None).cast("string")))
            keys = keep(kids.where("key is not null").groupBy("path_id", F.col("key").alias("v")).agg(F.count("*").alias("n")))
            self._keys(keys, inner, forced, key_hists, keep)
            level = self._next(kids, keys, inner)
        else:
            warnings.warn(f"nesting beyond {o.max_depth} levels is not followed", ValidationWarning, stacklevel=3)
        tree = self._tree(facts, hists, key_hists, keep, top, forced)
        for x in held:
            x.unpersist()
        return tree

    def _mode(self, r) -> str:
        if r["object"] == r.n:
            return "dict"
        if r["array"] == r.n:
            return "tuple" if r.n > r.hi and r.lo == r.hi and 0 < r.hi < self.options.field_threshold else "list"
        if r["object"] or r["array"]:
            return "value"
        if Fraction(r["null"], r.n) > Fraction(self.options.null_threshold):
            return "value"
        full = r.n - r["null"]
        if not full:
            return "empty"
        for kind, own in (("bool", r["bool"]), ("int", r["bool"] + r["int"]), ("float", r["bool"] + r["int"] + r["float"]), ("datetime", r["datetime"]), ("str", r["str"])):
            if own == full:
                return kind
        return "value"

    def _keys(self, keys: DataFrame, inner: dict, forced: set[str], key_hists: list, keep) -> None:
        """Record or table; the literal keys of records, the key conversion of tables."""
        o = self.options
        dicts = {p: f for p, f in inner.items() if f["mode"] == "dict"}
        counts = {r.path_id: r.k for r in keys.groupBy("path_id").agg(F.count("*").alias("k")).collect()}
        for p, f in dicts.items():
            f["mode"] = "table" if counts.get(p, 0) and (p in forced or counts[p] >= o.field_threshold) else "record"
            f["fields"] = []
        records = [p for p, f in dicts.items() if f["mode"] == "record"]
        tables = [p for p, f in dicts.items() if f["mode"] == "table"]
        if records:
            for r in self._only(keys, records).orderBy("path_id", "v").collect():
                dicts[r.path_id]["fields"].append((r.v, r.n, r.n < dicts[r.path_id]["n"]))
        if tables:
            own = keep(infer.prepared(self._only(keys, tables), o))
            for r in infer.evidence(own, o).collect():
                dicts[r.path_id]["key"] = infer.chosen(r, o, Fraction(0) if r.path_id in forced else None)
            key_hists.append(own.withColumn("path_id", F.concat("path_id", F.lit("{key}"))))

    def _only(self, df: DataFrame, paths: list[str]) -> DataFrame:
        return df.join(F.broadcast(self.spark.createDataFrame([(p,) for p in paths], "path_id string")), "path_id", "left_semi")

    def _next(self, kids: DataFrame, keys: DataFrame, inner: dict) -> DataFrame:
        """The next level's nodes; children behind keys that the table's key type rejects are counted and left out."""
        conv = {p: (infer.ALL.index(f["key"][1]) if f["key"][1] else -1, f["key"][2]) for p, f in inner.items() if f["mode"] == "table"}
        rows = [(p, f["mode"], *conv.get(p, (-1, True))) for p, f in inner.items()]
        plan = F.broadcast(self.spark.createDataFrame(rows, "path_id string, mode string, conv int, blanks boolean"))
        used = sorted({k for k, _ in conv.values() if k >= 0})

        def valid(key):
            key = infer.C.stripped(key) if self.options.strip_whitespace else key
            ok = F.when(F.col("blanks") | (key != ""), F.lit(True)).otherwise(F.lit(False))
            for k in used:
                ok = F.when(F.col("conv") == k, infer.ALL[k](key).isNotNull()).otherwise(ok)
            return ok

        if used or any(not b for _, b in conv.values()):
            bad = keys.join(plan, "path_id").where("mode = 'table'").where(~valid(F.col("v"))).groupBy("path_id").agg(F.sum("n").alias("n")).collect()
            for r in bad:
                inner[r.path_id]["rejected"] = r.n
                warnings.warn(f"{r.n} rows under keys that {r.path_id} rejects are left out", ValidationWarning, stacklevel=5)
        escaped = F.regexp_replace("key", r"([\\.\[\]{}])", r"\\$1")
        path = F.when(F.col("mode") == "record", F.concat("path_id", F.lit("."), escaped)).when(F.col("mode") == "table", F.concat("path_id", F.lit("{}"))).when(F.col("mode") == "tuple", F.concat("path_id", F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat("path_id", F.lit("[]")))
        joined = kids.join(plan, "path_id").where((F.col("mode") != "table") | valid(F.col("key")))
        return joined.select(path.alias("path_id"), F.col("child").alias("v"))

    # ---- types and statistics of the leaves

    def _tree(self, facts, hists, key_hists, keep, top, forced) -> Node:
        o = self.options
        every = hists[0]
        for h in hists[1:]:
            every = every.unionByName(h)
        sizes = every.where("kind in ('array', 'object')").groupBy("path_id", F.col("size").cast("int").alias("v")).agg(F.sum("n").alias("n"))
        every = every.where(nodes.SCALAR)
        strings = every.where("kind = 'str'").select("path_id", F.col("s").alias("v"), "n")
        strings = self._only(strings, [p for p, f in facts.items() if f["mode"] == "str"] or [""])
        for h in key_hists:
            strings = strings.unionByName(h)
        loose = {p + "{key}" for p in forced}
        texts = key_hists or any(f["mode"] == "str" for f in facts.values())
        seen = {r.path_id: r for r in infer.evidence(strings, o).collect()} if texts else {}
        picks = {p: infer.chosen(r, o, Fraction(0) if p in loose else None) for p, r in seen.items()}
        typed = self._values(every, strings, facts, picks, keep)
        few = keep(stats.narrowed(typed, "path_id"))
        values = {r.path_id: self._stats(r) for r in stats.narrowed_statistics(few, "path_id").collect()}
        for r in stats.narrowed_common_and_rare(few, "path_id").orderBy("path_id", "rank").collect():
            values[r.path_id].samples.append((_plain(r.v), r.n))
        size = stats.lengths(typed.select("path_id", F.col("v.s").alias("v"), "n").where("v is not null"), "path_id").unionByName(sizes)
        lengths = {r.path_id: self._stats(r) for r in stats.statistics(size, "path_id").collect()}
        fixed = [p for p, (k, _, _) in picks.items() if k == "fixed"]
        mined = infer.patterns(strings, self.spark.createDataFrame([(p,) for p in fixed], "path_id string")) if fixed else {}
        return self._node(top.removesuffix("[]") if top == "$[]" else top, facts, picks, values, lengths, mined, top)

    def _values(self, every: DataFrame, strings: DataFrame, facts, picks, keep) -> DataFrame:
        """The histogram (path_id, v, n) of typed values. Only what several distinct values may convert to is grouped again."""
        numbers = {p: f for p, f in facts.items() if f["mode"] in ("bool", "int", "float", "datetime")}
        mixed = {p for p, f in numbers.items() if sum(f[k] > 0 for k in ("bool", "int", "float")) > 1}
        direct, again = [], []
        for paths, parts in ((numbers.keys() - mixed, direct), (mixed, again)):
            if paths:
                parts.append(self._numbers(every, [(p, numbers[p]["mode"]) for p in sorted(paths)]))
        for convert, parts in ((False, direct), (True, again)):
            rows = [(p, infer.ALL.index(c) if c else -1, blanks) for p, (_, c, blanks) in picks.items() if bool(c) == convert]
            if rows:
                plan = self.spark.createDataFrame(rows, "path_id string, conv int, blanks boolean")
                parts.append(infer.converted(strings, plan, sorted({k for _, k, _ in rows if k >= 0})))
        value = F.struct("i", "d", "t", "s").alias("v")
        if again:
            direct = [x.select("path_id", value, "n") for x in direct] + [keep(infer.regrouped(reduce(DataFrame.unionByName, again)))]
            return reduce(DataFrame.unionByName, direct)
        return reduce(DataFrame.unionByName, direct or [self._numbers(every, [])]).select("path_id", value, "n")

    def _numbers(self, every: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
        plan = F.broadcast(self.spark.createDataFrame(rows, "path_id string, mode string"))
        number = F.coalesce("i", "b")
        return every.join(plan, "path_id").select(
            "path_id", "n", F.when(F.col("mode").isin("bool", "int"), number).alias("i"), F.when(F.col("mode") == "float", F.coalesce(F.col("d"), number.cast("double"))).alias("d"),
            F.when(F.col("mode") == "datetime", F.col("t")).alias("t"), F.lit(None).cast("string").alias("s"),
        )

    def _stats(self, r) -> Stats:
        return Stats(r["card"], r["distinct_values"], *(_plain(r[k]) for k in ("min", "q1", "q2", "q3", "max")), r["is_unique"])

    def _node(self, path, facts, picks, values, lengths, mined, top) -> Node:
        again = lambda p: self._node(p, facts, picks, values, lengths, mined, top)
        if path == "$" and top == "$[]":
            n = facts[top]["n"] if top in facts else 0
            return Node("list", path, count=1, lengths=Stats(1, 1, n, n, n, n, n, True), item=again("$[]"))
        f = facts.get(path)
        if f is None and not path.endswith("{key}"):
            return Node("empty", path)
        if f and f["mode"] in ("record", "table", "list", "tuple"):
            node = Node(f["mode"], path, count=f["n"], lengths=lengths.get(path), rejected=f.get("rejected", 0))
            if f["mode"] == "record":
                node.fields = [(k, n, opt, again(field_path(path, k))) for k, n, opt in f["fields"]]
            elif f["mode"] == "table":
                node.fields = [(again(path + "{key}"), f["n"], False, again(path + "{}"))]
            elif f["mode"] == "tuple":
                node.fields = [(k, f["n"], False, again(f"{path}[{k}]")) for k in range(f["hi"])]
            else:
                node.item = again(path + "[]")
            return node
        if f and f["mode"] in ("value", "empty"):
            return Node(f["mode"], path, count=f["n"])
        node = Node(f["mode"] if f else "str", path, count=f["n"] if f else 0, values=values.get(path), lengths=lengths.get(path))
        if path in picks:
            how, c, _ = picks[path]
            if how == "repr":
                node.kind, node.repr, node.pattern = c.kind, "str", c.pattern
            elif how == "fixed":
                node.pattern = mined.get(path)
            else:
                node.kind = how
        if node.values is None:
            return Node("empty", path, count=node.count)
        if node.kind == "bool":
            v = node.values
            v.min, v.q1, v.q2, v.q3, v.max = (None if x is None else bool(x) for x in (v.min, v.q1, v.q2, v.q3, v.max))
            v.samples = [(bool(x), n) for x, n in v.samples]
        return self._dated(node)

    def _dated(self, n: Node) -> Node:
        """A number whose range lies in the timestamps' window stands for a timestamp."""
        lo, hi = self.options.window()
        if n.kind not in ("int", "float") or n.repr == "str" and n.pattern not in ("d", "f") or not lo <= n.values.min <= n.values.max <= hi:
            return n
        at = lambda x: datetime(1970, 1, 1) + timedelta(seconds=float(x) * self.options.scale + self.options.offset)
        v = n.values
        n.base, n.kind, n.scale, n.offset = n.kind, "datetime", self.options.scale, self.options.offset
        n.repr = n.repr or "num"
        v.min, v.q1, v.q2, v.q3, v.max = map(at, (v.min, v.q1, v.q2, v.q3, v.max))
        v.samples = [(at(x), k) for x, k in v.samples]
        return n


def _plain(v):
    """The Python value of a length or of a typed struct, of which one field is set."""
    if v is None or isinstance(v, int):
        return v
    x = next((y for y in (v["i"], v["d"], v["t"], v["s"]) if y is not None), None)
    return x if isinstance(x, (float, str, datetime, type(None))) else int(x)


def profile(root: Node, spark: SparkSession) -> DataFrame:
    """The tree as rows, one per path: the result to store."""
    rows = []

    def text(v):
        return None if v is None else str(v)

    def add(n: Node, parent, depth, role, key, count, optional):
        v, ln = n.values or Stats(), n.lengths or Stats()
        rows.append((n.path, parent, depth, role, key, n.kind, n.repr, n.pattern_text() or None, n.scale, n.offset, optional, count, v.card or n.count, v.distinct, *map(text, (v.min, v.q1, v.q2, v.q3, v.max)), v.unique, *((ln.min, ln.q1, ln.q2, ln.q3, ln.max)), [(text(x), c) for x, c in v.samples], n.rejected))
        for k, c, opt, child in n.fields:
            if isinstance(k, Node):
                add(k, n.path, depth + 1, "map_key", None, c, False)
                add(child, n.path, depth + 1, "map_value", None, c, False)
            else:
                add(child, n.path, depth + 1, "pos" if n.kind == "tuple" else "field", str(k), c, opt)
        if n.item:
            add(n.item, n.path, depth + 1, "item", None, n.item.count, False)

    add(root, None, 0, "root", None, root.count, False)
    return spark.createDataFrame(
        rows,
        "path_id string, parent_id string, depth int, role string, key string, kind string, repr string, pattern string, num_scale double, num_offset double, optional boolean, count long, card long, distinct_values long, "
        "min string, q1 string, q2 string, q3 string, max string, is_unique boolean, len_min long, len_q1 long, len_q2 long, len_q3 long, len_max long, samples array<struct<value:string,n:long>>, rejected long",
    )
