"""Secrets in texts, and how widely each is owned; DataFrame functions only.

Patterns find candidates with their positions. The hash of each candidate's value is counted over the whole corpus by
distinct repositories (here: documents) and owners (here: sources). A value that several owners hold, or many documents
of one owner, is an example that was copied; one that few documents of a single owner hold and that looks random is live.
Opaque tokens, which no pattern names, count as secrets only where those frequencies say live.

Offsets count code points, ends are exclusive. Null and empty texts have no spans; a null owner is an owner of its own.
Equal rows are separate documents with equal spans. An empty table gives an empty result; other columns, whatever their
names, are left alone. Values held by very many documents are counted by partial sums and joined by broadcast, so none of
them meets in one task. The matches of one text do meet in one task; they are shuffled without the text, and the work on
them is that of sorting them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_name, join_by_key, stage_table


@dataclass(frozen=True)
class Kind:
    """pattern: a Java regular expression; group: which group is the secret; shortest: length it needs; hint: a text that any match holds."""

    name: str
    pattern: str
    group: int = 0
    shortest: int = 0
    hint: str = ""


#: Fixed values. Runs that are too short are dropped; where a length stands in the pattern itself, it drops the same ones.
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", hint="AKIA"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
#: Kinds that are added to the base.
ADDED = (
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=".eyJ"),
    Kind("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}"),
    Kind("url", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", hint="://"),
)
OPAQUE = Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+")
ORDER = {k.name: i for i, k in enumerate((*BASE, *ADDED, OPAQUE))}
#: So many owners, or so many documents whoever owns them, make a value an example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 10
#: Values that hold one of these are placeholders, whoever owns them.
PLACEHOLDER = "(?i)example|changeme|placeholder|your|xxxx|dummy|sample"

#: A base kind's shortest value, and what an opaque one must hold besides its length.
SHORTEST = {ORDER[k.name]: k.shortest for k in (*BASE, *ADDED, OPAQUE) if k.shortest}
MIXED = ("[A-Z]", "[a-z]", "[0-9]")


def matches_of(text: Column, kind: Kind) -> Column:
    """The kind's matches in the text, in order: characters since the last match, characters of the match, and its value."""
    between = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    # One more text lies between matches than there are matches; the last is left out.
    found = F.filter(F.arrays_zip(between, whole, value), lambda m: m["1"].isNotNull())
    empty = F.array().cast("array<struct<ord: int, i: int, gap: int, size: int, value: string>>")
    out = F.transform(found, lambda m, i: F.struct(F.lit(ORDER[kind.name]).alias("ord"), i.alias("i"), F.length(m["0"]).alias("gap"), F.length(m["1"]).alias("size"), m["2"].alias("value")))
    return F.when(text.rlike(kind.pattern) if not kind.hint else text.contains(kind.hint) & text.rlike(kind.pattern), out).otherwise(empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(row, doc_id, owner, matches) of every document; row numbers the documents. No shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), text.alias("text"))
    matches = F.concat(*[matches_of(F.col("text"), k) for k in (*BASE, *ADDED, OPAQUE)])
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", matches.alias("matches"))


def located(found: DataFrame) -> DataFrame:
    """(row, doc_id, owner, ord, kind, start, end, hash, random): a row for each match; hash is null for those that are dropped.

    found: a staged table of candidates. Offsets are running sums over a document's matches of a kind, and an opaque span
    is held against the running ends and starts of the others, so the work is linear but for sorting. One shuffle, of matches.
    """
    rows = found.filter(F.size("matches") > 0).select("row", "doc_id", "owner", F.explode("matches").alias("m")).select("row", "doc_id", "owner", "m.*").repartition("row")
    so_far = Window.partitionBy("row", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    rows = rows.withColumn("start", F.col("end") - F.col("size")).drop("gap", "size", "i")
    opaque = F.col("ord") == ORDER[OPAQUE.name]
    long_enough = F.lit(True)
    for number, shortest in SHORTEST.items():
        long_enough = long_enough & ((F.col("ord") != number) | (F.length("value") >= shortest))
    rows = rows.withColumn("valid", long_enough & (~opaque | reduce(and_, [F.col("value").rlike(m) for m in MIXED])))
    named = F.col("valid") & ~opaque
    # Ties in start lie within both windows. The second runs from the text's end, so that it only ever adds rows, too.
    rows = rows.withColumn("before", F.max(F.when(named, F.col("end"))).over(Window.partitionBy("row").orderBy("start")))
    rows = rows.withColumn("after", F.min(F.when(named, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc())))
    overlaps = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    valid = F.col("valid") & (~opaque | ~overlaps)
    kind = F.element_at(F.array(*[F.lit(k) for k in ORDER]), F.col("ord") + 1)
    random = F.col("value").rlike("[0-9]") & ~F.col("value").rlike(PLACEHOLDER)
    return rows.select("row", "doc_id", "owner", "ord", kind.alias("kind"), "start", "end", F.when(valid, F.sha2("value", 256)).alias("hash"), random.alias("random"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners): documents and distinct owners of each candidate value in the corpus."""
    held = spans.filter("hash is not null").select("hash", "owner", "row").distinct()
    return held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Located spans, dropped ones too (their verdict is null), with n_repos, n_owners and verdict: example, live or unsure."""
    spans = stage_table(located(found), "spans")
    counted = join_by_key(spans.filter("hash is not null"), stage_table(ownership(spans), "ownership"), "hash", "n_repos", "inner")
    counted = counted.unionByName(spans.filter("hash is null"), allowMissingColumns=True)
    wide = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    verdict = F.when(F.col("hash").isNull(), None).when(wide, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unsure")
    return counted.withColumn("verdict", verdict)


def judged_spans(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(row, doc_id, spans) by start and kind, with a verdict for each span; opaque spans stay only where live.

    found: a staged table of candidates.
    """
    span = "array<struct<start: int, ord: int, kind: string, `end`: int, verdict: string, n_repos: bigint, n_owners: bigint>>"
    none = found.filter(F.size("matches") == 0).select("row", "doc_id", F.array().cast(span).alias("spans"))
    kept = F.col("verdict").isNotNull() & ((F.col("kind") != OPAQUE.name) | (F.col("verdict") == "live"))
    of_row = F.array_sort(F.collect_list(F.when(kept, F.struct("start", "ord", "kind", "end", "verdict", "n_repos", "n_owners")))).cast(span)
    some = judged(found, example_owners, example_repos).groupBy("row").agg(F.first("doc_id").alias("doc_id"), of_row.alias("spans"))
    return none.unionByName(some)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """(row, doc_id, spans) of every document, each span with its verdict and how many documents and owners hold its value."""
    return judged_spans(stage_table(candidates(docs, id_col, text_col, owner_col), "candidates", narrow=True), example_owners, example_repos)


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_sha256, spans, n_live, n_example, most_repos, most_owners) from find_secrets.

    The last two tell how many documents and owners hold the widest spread value of the text; 0 without spans.
    """

    def text(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(name: str):
        return lambda s: s["kind"] == name

    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(of_kind(k.name)).alias(f"n_{k.name}") for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
        *[F.coalesce(F.array_max(f"spans.{n}"), F.lit(0)).cast("long").alias(f"most_{n[2:]}") for n in ("n_repos", "n_owners")],
    )


#: What a text with a candidate holds: one of these in any case, one of these as it stands, or a long run.
HINTS_ANY_CASE = ("password", "passwd", "secret", "token", "api_key", "apikey")
HINTS = ("AKIA", "PRIVATE KEY-----", ".eyJ", "://", "xox")
HINT_RUN = "[A-Za-z0-9+/_-]{24}"


def may_hold(text: Column) -> Column:
    """Whether a text may hold a candidate of any kind: cheap, and true for every text that does."""
    as_it_stands = reduce(or_, [text.contains(h) for h in HINTS])
    # The lower-cased text is made once, as the one element of an array.
    any_case = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [t.contains(h) for h in HINTS_ANY_CASE]))
    return as_it_stands | any_case | text.rlike(HINT_RUN)


#: Characters of the blocks that a text is cut into, so that its pieces are found without reading it from the start.
BLOCK_CHARS = 4096


def redactions(live: DataFrame) -> DataFrame:
    """(row, doc_id, last, cuts): for each row with live spans, where the last one ends and, by start, (from, start, kind) of each run of overlapping ones.

    from: where the run before ends. A run has the kind of its first span.
    """
    earlier = Window.partitionBy("row").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    runs = live.select("row", "doc_id", "start", "ord", "end", "kind", F.coalesce(F.max("end").over(earlier), F.lit(0)).alias("from"))
    cut = F.when(F.col("start") >= F.col("from"), F.struct("start", "from", "kind"))
    return runs.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("end").alias("last"), F.array_sort(F.collect_list(cut)).alias("cuts"))


def redacted(text: Column, cuts: Column, last: Column) -> Column:
    """The text with <kind> in place of what is cut; linear in text and cuts."""

    def apply(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK_CHARS).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor(b / BLOCK_CHARS).cast("int") - first + 1), "")
            return F.substr(some, a - first * BLOCK_CHARS + 1, b - a)

        parts = F.transform(cuts, lambda c: F.concat(piece(c["from"], c["start"]), F.lit("<"), c["kind"], F.lit(">")))
        return F.concat(F.array_join(parts, ""), piece(last, F.length(text)))

    # The blocks are made once, as the one element of an array.
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))), apply)[0]


def redact_live(docs: DataFrame, text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """The documents with each live secret replaced by <kind>; examples stay. All rows and columns stay.

    Spans are joined back by a hash of the text and its owner, so equal or missing ids do no harm: equal rows have
    equal spans and one row of redactions serves them all.
    """
    mark = clear_name(docs.columns, "redact")
    text = F.col(f"`{text_col}`")
    key = F.xxhash64(text, F.col(f"`{owner_col}`").cast("string"))
    found = stage_table(candidates(docs.select(key.alias("doc_id"), text.alias("text"), F.col(f"`{owner_col}`").alias("owner")), owner_col="owner"), "candidates", narrow=True)
    cuts = redactions(judged(found, example_owners, example_repos).filter("verdict = 'live'"))
    cuts = cuts.groupBy("doc_id").agg(F.first(F.struct("cuts", "last")).alias(f"{mark}_cuts"), F.count(F.lit(1)).alias(f"{mark}_n")).withColumnRenamed("doc_id", f"{mark}_key")
    # Only texts that may hold a candidate are joined, and so shuffled; all others pass.
    maybe = F.coalesce(may_hold(text), F.lit(False))
    joined = join_by_key(docs.filter(maybe).withColumn(f"{mark}_key", key), stage_table(cuts, "cuts"), f"{mark}_key", f"{mark}_n")
    of_row = F.col(f"{mark}_cuts")
    new = F.when(of_row.isNull(), text).otherwise(redacted(text, of_row["cuts"], of_row["last"]))
    changed = joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return docs.filter(~maybe).unionByName(changed)
