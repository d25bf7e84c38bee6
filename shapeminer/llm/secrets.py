"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the three base kinds (assign, access, hex), further token shapes and bearer headers. Each candidate's
value is hashed, and from then on only its hash is kept; per hash the corpus gives the distinct repositories and
owners that hold it. A value that is spread over many owners or repositories is a copied example; one that few hold,
and that looks random enough, is live-looking. Base spans are always reported; a further candidate is reported
(kind `live`) only if it is live-looking.

The counts are taken in two steps, distinct (hash, owner, repository) first, so that a value held by a third of
all documents is reduced before it is shuffled; the join back to the candidates is salted for such values. Null or
empty text has no candidates; null owners and repositories count as one of their own. Repeated rows with one doc_id
are scanned one by one; the row number within the scan, not doc_id, ties candidates to their row. Very long texts and
columns with clashing names are fine; an empty table gives no rows. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, maybe_among, salted_join, written

#: Base kinds in their listed order: pattern, group that must have `least` characters. Leftmost matches.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"()(AKIA[A-Z0-9]+)", 20),
    # runs of 24 and more are the runs of one and more that are long enough, as runs are maximal
    ("hex", r"()([0-9a-f]{24,})", 24),
)
#: Further shapes: vendor-prefixed tokens, signed web tokens.
MORE = r"()((?:gh[pousr]_|glpat-|sk_live_|sk-|xox[abprs]-)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
#: Bearer headers, whose tokens have no shape of their own; the span holds the keyword, as that of `assign` does.
BEARER = r"([Bb]earer\x20+)([A-Za-z0-9+/_.=-]{20,})"


#: Of a document: its candidates in order. Values are there as hashes only.
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,hash:bigint,random:boolean>>"
#: Matches whose offsets are added up one by one; longer lists are added up in such stretches.
_STRETCH = 256


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _running(sizes: Column) -> Column:
    """Running totals of an array of sizes, in time that grows as its length."""

    def within(a, base):
        zero = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    def all_of(a):
        each = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _STRETCH).cast("int"))
        part = lambda k: F.slice(a, k * _STRETCH + 1, F.lit(_STRETCH))
        return _let(F.transform(each, lambda k: _sum(part(k))), lambda sums: F.flatten(F.transform(each, lambda k: within(part(k), _sum(F.slice(sums, F.lit(1), k))))))

    return _let(sizes, all_of)


def _spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    """SPANS of the leftmost non-overlapping matches whose group 2 is long enough.

    Pieces between matches and the matches themselves alternate; their lengths add up to the offsets.
    """
    names = [k for k, *_ in BASE]
    rank = names.index(kind) if kind in names else len(BASE)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, 2))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def found(m):
        lens = F.transform(m, F.length)
        ends = _running(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), lens, lambda g, n: g + n))
        spans = F.zip_with(F.zip_with(ends, lens, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))), value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
        long_ = F.filter(spans, lambda s: F.length(s["value"]) >= least)
        return F.transform(long_, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.xxhash64(s["value"]).alias("hash"), _randomness(s["value"]).alias("random")))

    return F.coalesce(F.when(text.rlike(pattern), _let(whole, found)).cast(SPANS), F.array().cast(SPANS))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _randomness(value: Column) -> Column:
    """Distinct characters relative to what a random string of the length would show, and a mix of classes."""
    chars = F.array_distinct(F.split(value, ""))
    classes = sum(value.rlike(p).cast("int") for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (F.size(chars) >= F.least(F.lit(8), F.length(value) / 2)) & (classes >= 2)


def candidates(docs: DataFrame, *, id_col="doc_id", text_col="text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row per document with its candidate spans, in order; only those rows with any are worth a join."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *_held_by(docs, owner, repo))
    return base.select("doc_id", "owner", "repo", _found(F.col("text")).alias("spans"))


def _held_by(docs: DataFrame, owner: Column | None = None, repo: Column | None = None) -> tuple[Column, Column]:
    owner = docs["source"] if owner is None else owner
    repo = F.concat_ws("/", docs["source"], docs["lang"]) if repo is None else repo
    return F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo")


def _found(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_spans(text, k, p, n) for k, p, n in BASE), *(_spans(text, "live", p, 1) for p in (MORE, BEARER))))


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a candidate's value: distinct owners and repositories, and occurrences."""
    each = found.select(F.explode("spans.hash").alias("hash"), "owner", "repo")
    held = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("occurrences"))


#: A value that more owners, or more repositories, hold is a copied example.
MOST_OWNERS, MOST_REPOS = 2, 6


def secret_spans(docs: DataFrame, *, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS, id_col="doc_id", text_col="text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row per row of docs: counts and digest of the base spans, and all spans with the corpus's verdicts.

    n_copied and n_live split the distinct places by ownership: copied if over `most_owners` owners or `most_repos`
    repositories hold the value, live if fewer do and it looks random. `verdicts` has (start, rank, end, kind,
    owners, repos, verdict).
    """
    found = candidates(docs, id_col=id_col, text_col=text_col, owner=owner, repo=repo).withColumn("row", F.monotonically_increasing_id())
    return _judged(written(found, "secrets"), most_owners, most_repos).drop("row")


def _judged(found: DataFrame, most_owners: int, most_repos: int) -> DataFrame:
    """secret_spans and the row number of candidates that are written with one."""
    some = found.where(F.size("spans") > 0)
    owners = written(ownership(some), "owners")
    each = some.select("row", F.explode("spans").alias("s")).select("row", "s", "s.hash")
    judged = salted_join(each, owners.drop("occurrences"), "hash", "row", owners.select("hash", "occurrences"))
    verdict = F.when((F.col("owners") > most_owners) | (F.col("repos") > most_repos), "copied").when(F.col("s.random"), "live").otherwise("plain")
    judged = judged.select("row", F.struct("s.start", "s.rank", "s.end", "s.kind", "owners", "repos", verdict.alias("verdict")).alias("v")).where("v.rank < 3 or v.verdict = 'live'")
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list("v")).alias("verdicts"))
    out = found.select("row", "doc_id", "spans").join(per_row, "row", "left")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    verdicts = F.coalesce("verdicts", F.array().cast(per_row.schema["verdicts"].dataType))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    judged_as = lambda k: F.size(F.filter(verdicts, lambda s: s["verdict"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "row", "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"),
        _text_of(verdicts).alias("spans"), judged_as("live"), judged_as("copied"), verdicts.alias("verdicts"),
    )


def ownership_text(verdicts: Column) -> Column:
    """The verdicts as text: start:end:owners:repos:verdict, comma-joined."""
    return F.array_join(F.transform(verdicts, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["owners"].cast("string"), s["repos"].cast("string"), s["verdict"])), ",")


def redacted(docs: DataFrame, *, mark: str = "[SECRET]", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """docs with the spans of live-looking credentials replaced by `mark`; copied examples stay as they are.

    Rows and columns stay; n_chars follows the text. Rows are written once with their candidates and a row number,
    by which the cuts are tied to them: null and repeated doc_ids, and columns of any name, are fine.
    """
    columns, (owner, repo) = docs.columns, _held_by(docs)
    row, own, at, spans, maybe, cut, clean = fresh(docs, "row_number", "owner", "repo", "spans", "maybe_cut", "cuts", "clean_text")
    held = written(docs.withColumns({row: F.monotonically_increasing_id(), own: owner, at: repo, spans: _found(F.col("text"))}), "secrets")
    found = held.select(F.col(row).alias("row"), "doc_id", F.col(own).alias("owner"), F.col(at).alias("repo"), F.col(spans).alias("spans"))
    live = F.filter("verdicts", lambda s: s["verdict"] == "live")
    cuts = written(_judged(found, most_owners, most_repos).where("n_live > 0").select(F.col("row").alias(row), live.alias(cut)), "cuts")
    marked = maybe_among(held.select(*columns, row), cuts.select(row), row, maybe)
    rest, some = marked.where(~F.col(maybe)).select(*columns), marked.where(F.col(maybe)).drop(maybe)
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        lead = F.substring(F.col("text"), acc["at"], F.greatest(s["start"] + 1 - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), F.concat(acc["out"], lead, F.when(s["start"] + 1 >= acc["at"], mark).otherwise("")).alias("out"))

    text = F.aggregate(cut, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"], F.length("text"))))
    out = some.join(cuts, row, "left").withColumn(clean, F.when(F.col(cut).isNotNull(), text).otherwise(F.col("text")))
    out = out.select(*(F.col(clean).alias("text") if c == "text" else F.length(clean).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns))
    return rest.unionByName(out)
