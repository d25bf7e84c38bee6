"""Readers that find out encoding, format and dialect, and give documents as variants.

Detection looks at the head of one file (`sample_bytes`), read through Spark, so any store that Spark reads will
do. JSON lines are read line by line and CSV files record by record; other JSON and YAML are one document a file, of
at most the size of a VARIANT. YAML needs a parser on the executors; XML is recognised and refused.
"""

from __future__ import annotations

import csv
import io
import json
from collections import Counter
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "yaml")
_BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
_DELIMITERS = ",; \t"
#: Charsets that Spark's own functions decode; others are decoded in Python.
_JAVA = {"latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32"}


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quotechar: str | None = '"'


@dataclass(frozen=True)
class Source:
    """What is set is taken; what is `auto` is detected from the head of the first file."""

    paths: tuple[str, ...]
    encoding: str = "auto"
    encoding_strict: bool = True
    format: str = "auto"
    csv_delimiter: str = "auto"
    csv_quotechar: str = "auto"
    json_strict: bool = True
    sample_bytes: int = 1 << 20
    #: Of JSON: whether each line is a document. Of CSV: the fields of the first record.
    lines: bool | None = None
    width: int = 0

    def detected(self, spark: SparkSession) -> Source:
        head = bytes(spark.read.format("binaryFile").load(self.paths[0]).select(F.substring("content", 1, self.sample_bytes).alias("b")).first().b)
        encoding = detect_encoding(head) if self.encoding == "auto" else self.encoding
        text = head.decode(encoding, "replace")
        kind = detect_format(text) if self.format == "auto" else self.format
        out = replace(self, encoding=encoding, format=kind)
        if kind == "csv":
            d = detect_dialect(text)
            out = replace(out, csv_delimiter=d.delimiter if self.csv_delimiter == "auto" else self.csv_delimiter, csv_quotechar=(d.quotechar or "") if self.csv_quotechar == "auto" else self.csv_quotechar)
            out = replace(out, width=len(next(_records(text, out.csv_delimiter, out.csv_quotechar), [""])))
        if kind == "json" and self.lines is None:
            out = replace(out, lines=_are_documents(text.splitlines()[: None if len(head) < self.sample_bytes else -1]))
        return out

    def read(self, spark: SparkSession) -> DataFrame:
        """(source_id, doc VARIANT): one row per file for JSON and YAML, per line for JSON lines, and per data row for
        CSV: an array of all its cells, however many."""
        s = self.detected(spark)
        if s.format == "xml":
            raise NotImplementedError("XML is recognised but not analysed")
        if s.format not in FORMATS:
            raise ValueError("unable to guess the data's format")
        if s.format == "csv":
            return s._csv(spark)
        text = s._text(spark)
        if s.format == "json" and s.lines:
            text = text.select("source_id", F.explode(F.split("text", "\r?\n")).alias("text")).where("trim(text) != ''") if not s._plain() else s._lines(spark)
        if s.format == "yaml":
            text = text.mapInPandas(_yaml_to_json, "source_id string, text string")
        elif not s.json_strict:  # control characters within strings stay what they are
            text = text.mapInPandas(_loose_json, "source_id string, text string")
        return text.select("source_id", F.parse_json("text").alias("doc"))

    def _plain(self) -> bool:
        return self.encoding.lower().replace("_", "-") in ("utf-8", "ascii") and self.encoding_strict

    def _lines(self, spark) -> DataFrame:
        """The lines of UTF-8 files, which any number of tasks can share."""
        lines = spark.read.text(list(self.paths)).select(F.col("_metadata.file_path").alias("source_id"), F.validate_utf8("value").alias("text"))
        return lines.where("trim(text) != ''")

    def _text(self, spark) -> DataFrame:
        files = spark.read.format("binaryFile").load(list(self.paths)).select(F.col("path").alias("source_id"), "content")
        name = self.encoding.lower().replace("_", "-")
        if name in ("utf-8", "utf-8-sig", "ascii"):
            body = F.when(F.expr("hex(substring(content, 1, 3))") == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
            text = F.validate_utf8(body.cast("string")) if self.encoding_strict else F.make_valid_utf8(body.cast("string"))
        elif self.encoding_strict and name in _JAVA:
            text = F.decode("content", _JAVA[name])
        else:
            encoding, errors = self.encoding, "strict" if self.encoding_strict else "replace"
            return files.mapInPandas(lambda frames: _decoded(frames, encoding, errors), "source_id string, text string")
        return files.select("source_id", text.alias("text"))

    def _csv(self, spark) -> DataFrame:
        """Records of the usual width come from Spark's parser; of others it keeps the text, which is parsed again."""
        names = [f"c{k}" for k in range(self.width)]
        read = spark.read.schema(", ".join(f"{c} string" for c in [*names, "ragged"])).option("columnNameOfCorruptRecord", "ragged").option("mode", "PERMISSIVE").option("header", True).option("enforceSchema", True)
        read = read.option("sep", self.csv_delimiter).option("quote", self.csv_quotechar).option("escape", self.csv_quotechar or "\\").option("multiLine", True)
        charset = {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}.get(self.encoding.lower(), self.encoding)
        delimiter, quote = self.csv_delimiter, self.csv_quotechar

        @F.pandas_udf("array<string>")
        def cells_of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else next(_records(t, delimiter, quote), []))

        df = read.option("encoding", charset).csv(list(self.paths)).withColumn("source_id", F.col("_metadata.file_path"))
        usual = F.array(*(F.coalesce(c, F.lit("")) for c in names))
        cells = F.when(F.col("ragged").isNull(), usual).otherwise(cells_of("ragged"))
        return df.select("source_id", F.to_variant_object(cells).alias("doc"))


def _records(text: str, delimiter: str, quote: str | None):
    style = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, **style)


def _are_documents(lines: list[str]) -> bool:
    """Whether there are several lines and each is a JSON document by itself."""
    lines = [x for x in lines if x.strip()]
    try:
        return len(lines) > 1 and all(isinstance(json.loads(x, strict=False), (dict, list)) for x in lines[:100])
    except ValueError:
        return False


def _loose_json(frames):
    for f in frames:
        f["text"] = [json.dumps(json.loads(t, strict=False)) for t in f["text"]]
        yield f


def _decoded(frames, encoding: str, errors: str):
    for f in frames:
        f["text"] = [bytes(b).decode(encoding, errors) for b in f.pop("content")]
        yield f


def _yaml_to_json(frames):
    import yaml

    for f in frames:
        f["text"] = [json.dumps(yaml.safe_load(t), default=str) for t in f["text"]]
        yield f


def detect_encoding(head: bytes) -> str:
    """By byte order mark, else UTF-8 if it decodes (a character cut off at the end is fine), else Latin-1."""
    for bom, name in _BOMS:
        if head.startswith(bom):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 3 or e.reason != "unexpected end of data":
            return "latin-1"
    return "utf-8"


def detect_format(text: str) -> str:
    lead = text.lstrip()[:1]
    return {"<": "xml", "[": "json", "{": "json"}.get(lead) or _yaml_or_csv(text)


#: Lines of the head that are tried as YAML and as records.
_TRIED = 200


def _yaml_or_csv(text: str) -> str:
    """By trying: YAML if a parser finds a mapping or a list in the first lines, CSV if with some delimiter most of
    their records have the same number of fields, two at least."""
    import yaml

    lines = [x for x in text.splitlines()[: -1 if text[-1:] not in ("", "\n", "\r") and "\n" in text else None] if x.strip()][:_TRIED]
    try:
        if isinstance(yaml.safe_load("\n".join(lines)), (dict, list)):
            return "yaml"
    except yaml.YAMLError:
        pass
    for d in _DELIMITERS:
        sizes = Counter(map(len, _records("\n".join(lines), d, '"')))
        if any(k > 1 and 2 * n > sizes.total() for k, n in sizes.items()):
            return "csv"
    return "csv" if lines and all(x[0] == x[-1] == '"' for x in lines) else "unknown"


def detect_dialect(text: str) -> Dialect:
    try:
        found = csv.Sniffer().sniff(text.partition("\n")[2][:8192] or text[:8192], _DELIMITERS)
    except csv.Error:
        return Dialect()
    return Dialect(found.delimiter, found.quotechar or '"')
