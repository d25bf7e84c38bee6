"""Command line: prints the structure of files."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from datetime import datetime, timezone

from . import __version__
from .functions.text import num, shift, size, timestamps
from .options import Options


def _flag(p, name: str, default: bool, verbs=("no-", "")) -> None:
    dest = name.replace("-", "_")
    p.add_argument(f"--{verbs[1]}{name}", dest=dest, action="store_true", default=default)
    p.add_argument(f"--{verbs[0]}{name}", dest=dest, action="store_false")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shapeminer", description=__doc__)
    p.add_argument("files", nargs="*", default=["-"], metavar="file")
    p.add_argument("-f", "--format", choices=("auto", "csv", "json", "yaml"), default="auto")
    p.add_argument("-e", "--encoding", default="auto")
    _flag(p, "encoding-strict", True)
    p.add_argument("-F", "--field-threshold", type=int, default=20)
    p.add_argument("-M", "--merge-threshold", type=num, default=num("50%"))
    p.add_argument("-B", "--bad-threshold", type=num, default=num("1%"))
    p.add_argument("-E", "--empty-threshold", type=num, default=num("99%"))
    p.add_argument("-N", "--null-threshold", type=num, default=num("99%"))
    p.add_argument("--str-limit", type=num, default=20)
    for name, default in (("count", False), ("lengths", False), ("pattern", True), ("samples", False)):
        p.add_argument(f"--show-{name}", dest=f"show_{name}", action="store_true", default=default)
        p.add_argument(f"--hide-{name}", dest=f"show_{name}", action="store_false")
    p.add_argument("--show-range", choices=("hidden", "limits", "median", "quartiles", "graph"), default="limits")
    p.add_argument("--hide-range", dest="show_range", action="store_const", const="hidden")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto", help="auto: on a terminal")
    p.add_argument("--min-timestamp", default="20 years")
    p.add_argument("--max-timestamp", default="10 years")
    p.add_argument("--timestamps", type=timestamps, default=timestamps("unix"))
    p.add_argument("--max-numeric-len", type=int, default=30)
    p.add_argument("--sample-bytes", type=size, default=1 << 20)
    _flag(p, "strip-whitespace", True)
    p.add_argument("--csv-format", default="auto", help="FIELD[QUOTE]")
    _flag(p, "yaml-safe", True)
    _flag(p, "json-strict", True)
    p.add_argument("--version", action="version", version=__version__)
    return p


def options_of(a) -> Options:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return Options.cli(
        bad_threshold=a.bad_threshold, empty_threshold=a.empty_threshold, null_threshold=a.null_threshold, field_threshold=a.field_threshold, merge_threshold=a.merge_threshold,
        max_numeric_len=a.max_numeric_len, strip_whitespace=a.strip_whitespace, min_timestamp=shift(now, a.min_timestamp, -1), max_timestamp=shift(now, a.max_timestamp, 1), epoch_unit=a.timestamps[0], epoch=a.timestamps[1],
    )


def run(args: list[str] | None = None, spark=None) -> str:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.analyzer import Analyzer
    from .plans.pattern import TERMINAL
    from .sources.reader import Source

    a = parser().parse_args(args)
    if not a.yaml_safe:
        raise ValueError("only the safe YAML loader is supported")
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files = []
    for f in a.files:
        if f == "-":
            with tempfile.NamedTemporaryFile(delete=False) as held:
                held.write(sys.stdin.buffer.read())
            f = held.name
        files.append(f)
    delimiter, quote = ("auto", "auto") if a.csv_format == "auto" else (a.csv_format[:1], a.csv_format[1:2] or '"')
    source = Source(tuple(files), encoding=a.encoding, encoding_strict=a.encoding_strict, format=a.format, csv_delimiter=delimiter, csv_quotechar=quote, json_strict=a.json_strict, sample_bytes=a.sample_bytes)
    docs = source.read(spark).select(F.col("doc"))
    analyzer = Analyzer(spark, options_of(a))
    root = analyzer.merge(analyzer.analyze(docs))
    style = TERMINAL if a.color == "always" or a.color == "auto" and sys.stdout.isatty() else None
    single = len(files) == 1 and root.kind == "list" and source.detected(spark).format != "csv"
    return (root.item if single else root).render(show_range=a.show_range, show_count=a.show_count, show_lengths=a.show_lengths, show_pattern=a.show_pattern, show_samples=a.show_samples, str_limit=a.str_limit, style=style)


def main(args: list[str] | None = None) -> int:
    """0, or 1 with a message on an error, 2 if interrupted; DEBUG=1 lets errors through."""
    try:
        print(run(args))
    except KeyboardInterrupt:
        return 2
    except Exception as e:
        if os.environ.get("DEBUG", "0") not in ("", "0"):
            raise
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
