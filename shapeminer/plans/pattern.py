"""The inferred structure: a small tree on the driver, with compatibility, validation, rendering and Spark types."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from math import ceil
from textwrap import indent, shorten

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.text import format_epoch, format_int, format_value, sparkline

CONTAINERS = ("record", "table", "list", "tuple")
#: Which scalar types contain which, for merging.
_WIDER = {"bool": ("bool", "int", "float"), "int": ("int", "float"), "float": ("float",), "url": ("url", "str"), "str": ("str",), "datetime": ("datetime",)}


@dataclass
class Stats:
    card: int = 0
    distinct: int = 0
    min: object = None
    q1: object = None
    q2: object = None
    q3: object = None
    max: object = None
    unique: bool = False
    samples: list = field(default_factory=list)


@dataclass
class Node:
    kind: str
    path: str = "$"
    #: None, or how the value is written: str or num.
    repr: str | None = None
    pattern: object = None
    scale: float | None = None
    offset: float | None = None
    base: str | None = None
    count: int = 0
    values: Stats | None = None
    lengths: Stats | None = None
    #: Of a record or tuple: (literal key, count, optional, node); of a table: (key node, ..., value node).
    fields: list = field(default_factory=list)
    item: Node | None = None
    rejected: int = 0

    @property
    def container(self) -> bool:
        return self.kind in CONTAINERS

    def children(self) -> list[Node]:
        out = [f[3] for f in self.fields] + [f[0] for f in self.fields if isinstance(f[0], Node)]
        return out + ([self.item] if self.item else [])

    @property
    def size(self) -> int:
        """Nodes of the tree; keys count, empties do not."""
        if not self.container:
            return 0 if self.kind == "empty" else 1
        return 1 + sum(c.size for c in self.children()) + sum(not isinstance(f[0], Node) for f in self.fields)

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()

    # ---- compatibility

    def compatible(self, o: Node, threshold=0.5) -> bool:
        a, b = self, o
        if "empty" in (a.kind, b.kind) or "value" in (a.kind, b.kind):
            return True
        if a.container or b.container:
            if {a.kind, b.kind} <= {"record", "table"}:
                return _fields_compatible(a, b, threshold)
            if a.kind != b.kind:
                return False
            if a.kind == "list":
                return a.item.compatible(b.item, threshold)
            other = {f[0]: f[3] for f in b.fields}
            return all(f[0] not in other or f[3].compatible(other[f[0]], threshold) for f in a.fields)
        if a.repr != b.repr:
            return False
        if a.repr == "num":
            return (a.scale, a.offset) == (b.scale, b.offset)
        if a.repr == "str":
            return _written_alike(a, b)
        return b.kind in _WIDER[a.kind] or a.kind in _WIDER[b.kind]

    def predicate(self, c: Column, strict: bool = False) -> Column:
        """Whether a (string or number) column's value is of this type and within what was seen.

        strict follows the rule that characters are checked as far as both lengths reach; else lengths count, too.
        """
        s = self.values
        if self.kind in ("value", "empty") or self.container:
            return F.lit(True)
        if self.repr == "str":
            got = {"int": lambda: C.parse_int(c, C.INT_BASES[self.pattern]), "float": lambda: C.parse_float(c), "bool": lambda: C.parse_bool(c, self.pattern), "datetime": lambda: C.parse_datetime(c, self.pattern) if not self.scale else C.from_number(C.parse_float(c), self.offset, self.scale)}[self.kind]()
            ok = got.isNotNull() if self.kind == "bool" or not s or s.min is None else got.between(F.lit(s.min), F.lit(s.max))
        elif self.repr == "num":
            ok = C.from_number(c, self.offset, self.scale).between(F.lit(s.min), F.lit(s.max))
        elif self.kind == "bool":
            ok = c.cast("string").isin("0", "1", "true", "false")
        else:
            ok = c.between(F.lit(s.min), F.lit(s.max))
            if self.kind == "url":
                ok = ok & C.is_url(c)
            if self.pattern:
                parts = [p.regex() for p in self.pattern]
                nested = "".join(f"(?:{p}" if strict else p for p in parts) + (")?" * len(parts) if strict else "")
                ok = ok & c.rlike(f"^{nested}" + ("" if strict else "$"))
        return F.coalesce(ok, F.lit(False))

    def accepts(self, v: Column) -> Column:
        """Whether a VARIANT column's value is of this type: containers by kind (and a tuple by its length), scalars
        by predicate."""
        shape = F.schema_of_variant(v)
        if self.kind in ("record", "table"):
            return shape.startswith("OBJECT")
        if self.kind in ("list", "tuple"):
            size = F.size(F.try_variant_get(v, "$", "array<variant>"))
            return shape.startswith("ARRAY") & (size.between(self.lengths.min, self.lengths.max) if self.kind == "tuple" and self.lengths else F.lit(True))
        if self.kind in ("value", "empty"):
            return F.lit(True)
        if self.repr == "str" or self.kind in ("str", "url"):
            return (shape == "STRING") & self.predicate(F.try_variant_get(v, "$", "string"))
        if self.kind == "bool":
            return shape.isin("BOOLEAN") | F.coalesce(F.try_variant_get(v, "$", "double").isin(0, 1), F.lit(False))
        if self.kind == "datetime" and not self.repr:
            return self.predicate(F.try_variant_get(v, "$", "timestamp"))
        return ~shape.isin("STRING", "BOOLEAN") & self.predicate(F.try_variant_get(v, "$", "double"))

    def is_field(self, c: Column) -> Column:
        """Whether a key column's value is one of the record's literal keys."""
        return F.coalesce(c.isin([str(f[0]) for f in self.fields]), F.lit(False))

    def matches(self, v: Column) -> Column:
        """As accepts, and all that a container holds is of its type: a record has all mandatory fields and none but
        its own, a table's keys and values, a list's and a tuple's items are of theirs. A null is of no scalar type."""
        ok = F.coalesce(self.accepts(v), F.lit(False))
        if self.kind in ("record", "table"):
            held = F.try_variant_get(v, "$", "map<string,variant>")
            if self.kind == "table":
                key, _, _, value = self.fields[0]
                parts = [F.forall(F.map_keys(held), key.key_predicate), F.forall(F.map_values(held), value.matches)]
            else:
                parts = [F.forall(F.map_keys(held), self.is_field)]
                parts += [F.when(F.map_contains_key(held, str(k)), n.matches(F.try_element_at(held, F.lit(str(k))))).otherwise(bool(optional)) for k, _, optional, n in self.fields]
        elif self.kind in ("list", "tuple"):
            held = F.try_variant_get(v, "$", "array<variant>")
            if self.kind == "list":
                parts = [F.forall(held, self.item.matches)] if self.item else []
            else:
                parts = [F.when(F.size(held) > k, n.matches(F.get(held, F.lit(k)))).otherwise(bool(optional)) for k, (_, _, optional, n) in enumerate(self.fields)]
        else:
            return ok
        for part in parts:
            ok = ok & F.coalesce(part, F.lit(False))
        return ok

    def key_predicate(self, c: Column) -> Column:
        return self.predicate(C.stripped(c))

    # ---- Spark types

    def spark_type(self) -> T.DataType:
        simple = {"bool": T.BooleanType, "float": T.DoubleType, "datetime": T.TimestampType, "str": T.StringType, "url": T.StringType, "value": T.VariantType, "empty": T.NullType}
        if self.kind == "record":
            return T.StructType([T.StructField(str(k), n.spark_type(), opt) for k, _, opt, n in self.fields])
        if self.kind == "table":
            return T.MapType(T.StringType(), self.fields[0][3].spark_type())
        if self.kind == "tuple":
            return T.StructType([T.StructField(f"_{k}", n.spark_type(), opt) for k, _, opt, n in self.fields])
        if self.kind == "list":
            return T.ArrayType(self.item.spark_type())
        if self.repr == "str":
            return T.StringType()
        if self.repr == "num":
            return T.LongType() if self.base == "int" else T.DoubleType()
        if self.kind == "int":
            return T.LongType() if self.values.max is None or -(2**63) <= self.values.min and self.values.max < 2**63 else T.DecimalType(38, 0)
        return simple[self.kind]()

    # ---- text

    def pattern_text(self) -> str:
        return self.pattern if isinstance(self.pattern, str) else "".join(map(str, self.pattern or ()))

    def __str__(self):
        if self.container:
            parts = [f"{k!r}{'*' * bool(opt)}: {n}" if not isinstance(k, Node) else f"{k}: {n}" for k, _, opt, n in self.fields] if self.kind in ("record", "table") else [str(n) for _, _, _, n in self.fields] if self.kind == "tuple" else [str(self.item)]
            a, b = {"list": "[]", "tuple": "()"}.get(self.kind, "{}")
            text = ", ".join(parts)
            return f"{a}{text}{b}" if "\n" not in text and len(text) <= 60 else a + "\n" + indent(",\n".join(parts), "    ") + "\n" + b
        v = self.values
        inner = {"bool": lambda: "bool", "int": lambda: f"int range={format_int(v.min)}..{format_int(v.max)}", "float": lambda: f"float range={v.min:.7g}..{v.max:.7g}", "datetime": lambda: f"datetime range={v.min:%Y-%m-%d %H:%M:%S}..{v.max:%Y-%m-%d %H:%M:%S}", "str": lambda: "str" + (f" pattern={shorten(self.pattern_text(), 60, placeholder='...')}" if self.pattern else ""), "url": lambda: "URL"}.get(self.kind, lambda: self.kind)()
        if self.scale:
            inner = f"{self.base} {format_epoch(self.offset, self.scale)} of {inner}"
        return f"str of {inner} pattern={self.pattern_text()}" if self.repr == "str" else inner

    def render(self, *, show_range: str = "limits", show_count=False, show_lengths=False, show_pattern=True, show_samples=False, str_limit: int = 20, style: dict | None = None, depth: int = 0) -> str:
        """The command line's text; style: see TERMINAL."""
        st = lambda name, text: f"{style[name]}{text}{_PLAIN}" if style and name in style and text else text
        again = lambda n, d=depth: n.render(show_range=show_range, show_count=show_count, show_lengths=show_lengths, show_pattern=show_pattern, show_samples=show_samples, str_limit=str_limit, style=style, depth=d)
        if self.container:
            a, b = {"list": "[]", "tuple": "()"}.get(self.kind, "{}")
            below = [n for f in self.fields for n in (f[3], f[0]) if isinstance(n, Node)] + ([self.item] if self.item else [])
            deep = any(x.container for n in below for x in n.walk())
            wide = deep or len(self.fields) > 1
            parts = [again(self.item, depth + wide)] if self.kind == "list" else [again(n, depth + wide) if self.kind == "tuple" else f"{again(k) if isinstance(k, Node) else repr(k)}{st('optional', '?' * bool(opt))}: {again(n, depth + wide)}" for k, _, opt, n in self.fields]
            count = f"count={format_int(self.lengths.card if self.lengths else self.count)}" if show_count else ""
            if not wide:
                return f"{a} {count + ' ' if count else ''}{parts[0] if parts else ''} {b}"
            pad = "\n" + "    " * (depth + 1)
            return f"{a}{' ' + count if count else ''}{','.join(pad + p for p in parts)}\n{'    ' * depth}{b}"
        name = {"datetime": "timestamp", "url": "URL"}.get(self.kind, self.kind)
        text = st("unique" if self.values and self.values.unique else "type", name)
        if self.kind in ("int", "float", "datetime", "str"):
            by_length = self.kind == "str" and self.lengths and self.lengths.max is not None and self.lengths.max > str_limit
            stats, shown = (self.lengths, show_lengths) if by_length else (self.values, True)
            if show_count and not by_length:
                text += f" count={format_int(stats.distinct)}"
            if shown and show_range != "hidden" and stats:
                text += f" {'lengths' if by_length else 'range'}={st('fill', '..').join(_range(stats, show_range))}"
            if show_samples and self.values and self.values.samples and not by_length:
                text += " samples=" + ", ".join(format_value(x) for x, _ in self.values.samples)
        if self.kind == "str" and show_pattern and self.pattern:
            text += f' pattern="{st("pattern", self.pattern_text())}"'
        if self.scale:
            text = f"{st('type', self.base)} of {text}"
        if self.repr == "str":
            text = f"{st('type', 'str')} of {text}" + (f' pattern="{st("pattern", self.pattern_text())}"' if show_pattern and self.pattern else "")
        return text

    def xml(self) -> ET.Element:
        e = ET.Element({"record": "dict", "table": "dict", "datetime": "datetime"}.get(self.kind, self.kind), {k: str(v) for k, v in (("pattern", self.pattern_text()), ("repr", self.repr), ("count", self.count)) if v})
        for tag, s in (("values", self.values), ("lengths", self.lengths)):
            if s:
                summary = ET.SubElement(ET.SubElement(e, tag), "summary", {"count": str(s.card), "values": str(s.distinct), "unique": str(s.unique).lower()})
                for name, least in (("min", 2), ("q1", 5), ("q2", 3), ("q3", 5), ("max", 1)):
                    if s.distinct >= least:
                        ET.SubElement(summary, name).text = format_value(getattr(s, name))
        if self.container:
            content = ET.SubElement(e, "content")
            for k, n, opt, child in self.fields:
                f = ET.SubElement(content, "field")
                if isinstance(k, Node):
                    f.append(k.xml())
                else:
                    ET.SubElement(f, "key", {"count": str(n), **({"optional": "optional"} if opt else {})}).text = repr(k)
                f.append(child.xml())
            if self.item:
                content.append(self.item.xml())
        return e


#: Terminal codes of the parts of a rendered structure: colours, and an underline for types whose values are unique.
TERMINAL = {"type": "\x1b[36m", "unique": "\x1b[36;4m", "fill": "\x1b[32m", "pattern": "\x1b[33m", "optional": "\x1b[31m"}
_PLAIN = "\x1b[0m"


def _range(s: Stats, mode: str) -> list[str]:
    """The values of a range, from its least on."""
    v = format_value
    if s.distinct < 2:
        return [v(s.max)]
    if mode == "graph" and s.distinct > 4 and isinstance(s.min, (int, float)):
        return [f"{v(s.min)} [{sparkline(s.min, s.q1, s.q2, s.q3, s.max)}] {v(s.max)}"]
    inner = [s.q1] * (mode == "quartiles" and s.distinct > 4) + [s.q2] * (mode in ("median", "quartiles") and s.distinct > 2) + [s.q3] * (mode == "quartiles" and s.distinct > 4)
    return [v(x) for x in (s.min, *inner, s.max)]


def _written_alike(a: Node, b: Node) -> bool:
    kinds = {a.kind, b.kind}
    if a.scale or b.scale or kinds == {"datetime"}:
        return kinds == {"datetime"} and (a.pattern, a.scale, a.offset) == (b.pattern, b.scale, b.offset)
    if kinds == {"bool"}:
        return a.pattern == b.pattern
    if "bool" in kinds:
        return (a if a.kind == "bool" else b).pattern == "0|1" and kinds <= {"bool", "int", "float"}
    if kinds == {"int", "float"}:
        return (a if a.kind == "int" else b).pattern != "x"
    return len(kinds) == 1


def _fields_compatible(a: Node, b: Node, threshold) -> bool:
    if a.kind == b.kind == "table":
        (ka, _, _, va), (kb, _, _, vb) = a.fields[0], b.fields[0]
        return ka.compatible(kb, threshold) and va.compatible(vb, threshold)
    if a.kind != b.kind:
        record, table = (a, b) if a.kind == "record" else (b, a)
        key, _, _, value = table.fields[0]
        return all(holds(key, k) and n.compatible(value, threshold) for k, _, _, n in record.fields)
    fa, fb = ({f[0]: f[3] for f in x.fields} for x in (a, b))
    if not fa or not fb:
        return True
    shared = fa.keys() & fb.keys()
    return len(shared) >= ceil(threshold * min(len(fa), len(fb))) and all(fa[k].compatible(fb[k], threshold) for k in shared)


def holds(n: Node, key) -> bool:
    """Whether a literal key lies within a key type: a driver-side check of one value."""
    if n.kind in ("value", "empty"):
        return True
    key = str(key)
    if n.repr == "str" and n.kind == "int":
        try:
            return n.values.min <= int(key, C.INT_BASES[n.pattern]) <= n.values.max
        except ValueError:
            return False
    if n.repr == "str" and n.kind == "float":
        try:
            return n.values.min <= float(key) <= n.values.max
        except ValueError:
            return False
    if n.kind == "str":
        ok = n.values.min <= key <= n.values.max
        return ok and (not n.pattern or bool(re.match("".join(p.regex() for p in n.pattern) + r"\Z", key, re.S)))
    return True
