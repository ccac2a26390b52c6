"""Quality rules of documents, judged once more by host.

Each text gets counts, and rules over the counts fail or pass it. Rule failures are aggregated by host; a host's
failure rate is shrunk towards the corpus by a beta prior whose strength comes from the spread between hosts. Where even
a cautious reading of a host's rate is nearer to one than to the corpus' rate, the host is rejected with all its documents.
Where that reading is above the corpus' rate by a stated factor, the host is suspect: then its documents that break any of
the rules go, while at other hosts only the base rules reject a document. Host verdicts are joined back.

Null and empty texts have no words and fail as too short. A null host is never rejected nor suspect. An empty table gives
an empty result. Equal rows are separate documents. Other columns stay as they are, whatever their names. Hosts may be of
any size: they are pre-aggregated before the shuffle, and large ones are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import clear_name, join_by_key, map_rows, release_state, slices, stage_table, text_list

#: White space between words, and the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document also breaks these rules beyond: symbols for each 100 word characters, repeated lines of 100, mean word length.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTH = (2, 15)
#: A host is rejected if the lower bound of its shrunk rate of failing documents lies beyond this share of the way from the corpus' rate to 1.
REJECT_AT = 0.5
#: It is suspect if that lower bound is above the corpus' rate times this.
SUSPECT_FACTOR = 1.5
#: Standard deviations between a host's shrunk rate and its lower bound.
CAUTION = 2.0
#: Documents that the prior counts for at least and at most: a host with many more is judged by its own record.
PRIOR_DOCS = (1.0, 100.0)
#: Rejected and suspect hosts up to this number are broadcast (some 10 MB); more are joined by shuffle.
BROADCAST_HOSTS = 100_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    k = len(seen)
    if k < 1 << 20:
        keys = (codes[:-2] * k + codes[1:-1]) * k + codes[2:]
    else:
        keys = np.unique(codes[:-2] * k + codes[1:-1], return_inverse=True)[1] * k + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return 0
    covered = np.zeros(len(words), bool)
    for ends in (order[same], order[same + 1]):
        covered[ends] = covered[ends + 1] = covered[ends + 2] = True
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


def base_fails(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[5] > MAX_REPEAT_PERCENT * counts[0]


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, counts...) of every document; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*[text_counts(t) for t in text_list(batch.column(2))], strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "host", *COUNTS])

    return map_rows(docs, [id_col, host_col, text_col], run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def rules(prefix: str = "") -> dict[str, Column]:
    """For each rule whether the counts, whose columns' names begin with the prefix, break it."""
    n = {c: F.col(f"{prefix}{c}") for c in COUNTS}
    return {
        "short": n["n_words"] < MIN_WORDS,
        "repeats": 100 * n["n_repeat_words"] > MAX_REPEAT_PERCENT * n["n_words"],
        "symbols": 100 * n["n_symbols"] > MAX_SYMBOL_PERCENT * n["word_chars"],
        "dup_lines": 100 * n["n_dup_lines"] > MAX_DUP_LINE_PERCENT * n["n_lines"],
        "word_length": (n["word_chars"] < WORD_LENGTH[0] * n["n_words"]) | (n["word_chars"] > WORD_LENGTH[1] * n["n_words"]),
    }


def apply_rules(counts: DataFrame) -> DataFrame:
    """Adds a boolean fails_<rule> for each rule, base_failed and failed (any rule)."""
    out = counts.withColumns({f"fails_{r}": x for r, x in rules().items()})
    return out.withColumns({"base_failed": F.col("fails_short") | F.col("fails_repeats"), "failed": reduce(or_, [F.col(f"fails_{r}") for r in RULES])})


def host_verdicts(judged: DataFrame, reject_at: float = REJECT_AT, suspect_factor: float = SUSPECT_FACTOR) -> DataFrame:
    """(host, n_docs, n_failed, one count for each rule, rate, rejected, suspect): one row for each host that is not null.

    The prior is fitted by moments. All hosts weigh the same in the spread of rates between hosts, whatever their size,
    so a few bad hosts show in it however large the corpus is; what chance alone gives is taken off.
    """
    hosts = judged.filter("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("failed").alias("n_failed"), *[F.count_if(f"fails_{r}").alias(f"n_{r}") for r in RULES]
    )
    hosts = stage_table(hosts, "hosts")
    n, k, mean = F.col("n_docs"), F.col("n_failed"), F.col("mean")
    # One row on one side of these joins.
    corpus = hosts.agg((F.sum(k) / F.sum(n)).alias("mean"))
    spread = hosts.join(F.broadcast(corpus)).agg(F.first("mean").alias("mean"), (F.avg(F.pow(k / n - mean, 2)) - F.first("mean") * (1 - F.first("mean")) * F.avg(1 / n)).alias("between"))
    strength = F.greatest(F.lit(PRIOR_DOCS[0]), F.least(F.lit(PRIOR_DOCS[1]), mean * (1 - mean) / F.greatest(F.col("between"), F.lit(1e-9)) - 1))
    prior = spread.select("mean", strength.alias("strength"))
    size = n + F.col("strength")
    rate = (k + mean * F.col("strength")) / size
    low = rate - CAUTION * F.sqrt(rate * (1 - rate) / (size + 1))
    out = hosts.join(F.broadcast(prior)).withColumns({"rate": rate, "rejected": low > mean + reject_at * (1 - mean), "suspect": low > suspect_factor * mean})
    return out.drop("mean", "strength")


def _passes(failed: Column) -> Column:
    """Whether a document stays, after its host's verdict is joined."""
    rejected, suspect = (F.coalesce(c, F.lit(False)) for c in ("rejected", "suspect"))
    return ~F.col("base_failed") & ~rejected & ~(suspect & failed)


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", reject_at: float = REJECT_AT, suspect_factor: float = SUSPECT_FACTOR) -> DataFrame:
    """Every document's counts, broken rules, its host's rate and verdict, and kept."""
    judged = apply_rules(stage_table(document_counts(docs, id_col, text_col, host_col), "counts", narrow=True))
    hosts = stage_table(host_verdicts(judged, reject_at, suspect_factor).select("host", "n_docs", "rate", "rejected", "suspect"), "verdicts")
    joined = join_by_key(judged, hosts, "host", "n_docs")
    return joined.withColumn("kept", _passes(F.col("failed"))).withColumnsRenamed({"rate": "host_rate", "n_docs": "host_docs"})


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", reject_at: float = REJECT_AT, suspect_factor: float = SUSPECT_FACTOR) -> DataFrame:
    """The documents that judge_documents keeps, with all their columns.

    Texts are read and counted once: the documents are written with their counts, which the hosts' verdicts and then the
    filter use. Texts are never shuffled unless very many hosts are bad.
    """
    mark, at = clear_name(docs.columns, "quality"), docs.columns.index(text_col)
    fields = ", ".join(f"`{mark}_{c}` long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        for part in slices(batches):
            columns = zip(*[text_counts(t) for t in text_list(part.column(at))], strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.int64()) for c in columns]], [*part.schema.names, *[f"{mark}_{c}" for c in COUNTS]])
        pa.default_memory_pool().release_unused()

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(fields).fields])
    counted = stage_table(docs.mapInArrow(run, schema), "counted")
    names = [F.col(f"`{host_col}`").cast("string").alias("host"), *[F.col(f"{mark}_{c}").alias(c) for c in COUNTS]]
    bad = host_verdicts(apply_rules(counted.select(*names)), reject_at, suspect_factor).filter("rejected or suspect")
    bad = stage_table(bad.select(F.col("host").alias(f"{mark}_host"), F.col("rejected").alias(f"{mark}_rejected")), "verdicts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    fails = rules(f"{mark}_")
    any_rule = reduce(or_, fails.values())
    joined = counted.filter(~(fails["short"] | fails["repeats"])).join(bad, counted[host_col].cast("string") == F.col(f"{mark}_host"), "left")
    # A joined host is rejected or else suspect.
    stays = F.col(f"{mark}_host").isNull() | (~F.col(f"{mark}_rejected") & ~any_rule)
    return joined.filter(stays).select(*[F.col(f"`{c}`") for c in docs.columns])
