"""Source divergence audit: how far the terms of a source stray from its language and from the language's other sources.

A term is a run of ASCII letters and characters beyond ASCII, with only A-Z lower-cased. A language keeps the terms that at
least MIN_DOCS of its documents hold. A group is a (lang, source) that occurs. Every kept term has a share in each group and in
the language, p = 1 + floor(SCALE * (count + 1) / (N + V)): N is the sum of kept terms' counts there, V the number of kept
terms. Divergence of p from q is floor((p - q)^2 / q). All arithmetic is exact.

* `term_part` ranks the terms that a group uses more than its language does. The TOP most divergent of each group are found by
  radix selection: histograms over the values' bits, one digit after the other, lead to the value of the TOP-th term, and
  those over the bytes of its UTF-8 form, beyond the bytes that all candidates share, split what ties there. Only once what is left of a
  group is a bounded number of rows is it ranked.
* `pair_part` sums each group's divergence from each other source of the language over all kept terms. Terms that neither holds
  diverge by a baseline of the pair; terms that one of them holds add a correction that hangs on its share alone, so it is
  taken over the histogram of its shares; only terms that both hold are visited one by one, term by term, on arrays.

Null text, lang or source count as ''. Each row is a document, whatever its id. Groups without terms, and languages that keep
none, have pairs (of value 0 where V = 0) and no terms. An empty table gives no rows. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release_state, slices, stage_table

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Values lie below 2**60, as shares do not exceed SCALE + 1; they are read in digits of so many bits.
VALUE_BITS, DIGIT_BITS = 60, 15
#: Bytes of a term that a histogram splits by; once so few terms of a group tie, they are ranked as they are.
DIGIT_BYTES, FEW_TIES = 2, 1024
#: Terms that a task counts before it hands them on; bytes of a text that are split at once; pairs that are worked out at once.
HELD_TERMS, SPLIT_BYTES, PAIRS_AT_ONCE = 1 << 18, 1 << 20, 1 << 19

#: A-Z become lower case, letters and bytes beyond ASCII stay, all else is a space.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of about SPLIT_BYTES."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + SPLIT_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) of every term in every group, and a row with a null term for each group. Counted in the tasks first, then once by key."""

    def rows(held: dict) -> pa.RecordBatch:
        keys = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in counts.items()]
        keys += [(*group, None, 0, 0) for group in held]
        lang, source, term, n, of = zip(*keys, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        held: dict = {}
        size = 0
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(counts)
                own = set()
                for terms in split_terms(text):
                    counts.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(counts)
            if size > HELD_TERMS:
                yield rows(held)
                held, size = {}, 0
        if held:
            yield rows(held)

    empty = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*empty).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, once): the groups' counts of terms that their language keeps and its own count; once marks one row of each term."""
    of_term = Window.partitionBy("lang", "term")  # a row for each source that holds it
    held = counts.filter("term IS NOT NULL").select("*", F.sum("docs").over(of_term).alias("__docs"), F.sum("n").over(of_term).alias("total"), F.min("source").over(of_term).alias("__first"))
    return held.filter(F.col("__docs") >= min_docs).select("lang", "source", "term", "n", "total", (F.col("source") == F.col("__first")).cast("int").alias("once"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count; decimals, as the product may pass 64 bits."""
    product = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", product, whole) + 1


def strays(p: Column, q: Column) -> Column:
    """Divergence of p from q."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(counts: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, place, n_terms, n_group, n_lang, p0): every group with V, its N and its language's, its number there, and its share of a term that it lacks."""
    groups = counts.filter("term IS NULL").select("lang", "source")
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    whole = held.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("once").alias("n_terms"))
    known = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["n_group", "n_lang", "n_terms"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return known.select("lang", "source", place.alias("place"), "n_terms", "n_group", "n_lang", share(F.lit(0), F.col("n_group"), F.col("n_terms")).alias("p0"))


def with_shares(held: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, place, term, p, p0, q): shares in the group and in its language."""
    return held.join(totals, ["lang", "source"]).select(
        "lang", "source", "place", "term", share(F.col("n"), F.col("n_group"), F.col("n_terms")).alias("p"), "p0", share(F.col("total"), F.col("n_lang"), F.col("n_terms")).alias("q")
    )


def _last_bin(bins: DataFrame, order: Column, digit: Column) -> DataFrame:
    """Of each group's histogram (n rows in a bin, need rows sought) the bin in which the last sought row lies: its prefix, the need left there, the rows there."""
    so_far = F.sum("n").over(Window.partitionBy("lang", "source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    reached = bins.withColumn("__to", so_far).filter((F.col("__to") >= F.col("need")) & (F.col("__to") - F.col("n") < F.col("need")))
    return reached.select("lang", "source", digit.alias("prefix"), (F.col("need") - F.col("__to") + F.col("n")).alias("need"), F.col("n").alias("here"))


def kth_values(found: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, prefix, need, here): of each group with more than k rows the k-th greatest value, how many rows of just that value belong
    to the k greatest, and how many have it. found: (lang, source, value, ...), staged, as each digit reads it once."""
    state = found.groupBy("lang", "source").count().filter(F.col("count") > k).select("lang", "source", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = found.join(state, ["lang", "source"]).filter(F.shiftright("value", shift + DIGIT_BITS) == F.col("prefix"))
        bins = inside.groupBy("lang", "source", F.shiftright("value", shift).alias("__digit")).agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        state = _last_bin(bins, F.desc("__digit"), F.col("__digit")).select("lang", "source", "prefix", "need", "here")
    return state


def tie_bounds(found: DataFrame, state: DataFrame, few: int = FEW_TIES) -> DataFrame:
    """(lang, source, value, bound): the k-th value of each group, and for more than `few` ties beyond need the prefix of UTF-8 bytes up to which
    they are taken; null where all are.

    Each round reads two more bytes after those that the candidates of a group share, so it splits them; what lies in the last
    bin goes on. state: staged.
    """
    done = state.filter(F.col("here") <= F.col("need") + few).select("lang", "source", F.col("prefix").alias("value"), F.lit(None).cast("binary").alias("bound"))
    left = state.filter(F.col("here") > F.col("need") + few).select("lang", "source", F.col("prefix").alias("value"), "need", F.lit(b"").alias("prefix"))
    text = F.col("term").cast("binary")
    while left.take(1):
        ties = found.join(left, ["lang", "source", "value"]).filter(text.substr(F.lit(1), F.octet_length("prefix")) == F.col("prefix"))
        ends = ties.groupBy("lang", "source").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
        # The first byte, from 1, in which the least and the greatest differ; they do, as terms of a group are distinct.
        differs = F.expr("array_position(transform(sequence(1, octet_length(hi)), i -> substring(cast(lo as binary), i, 1) <> substring(cast(hi as binary), i, 1)), true)")
        cuts = ends.select("lang", "source", differs.alias("__cut"))
        bins = ties.join(cuts, ["lang", "source"]).groupBy("lang", "source", text.substr(F.lit(1), F.col("__cut").cast("int") + (DIGIT_BYTES - 1)).alias("__digit"))
        bins = bins.agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"), F.max("value").alias("value"))
        values = left.select("lang", "source", "value")
        step = stage_table(_last_bin(bins, F.asc("__digit"), F.col("__digit")).join(values, ["lang", "source"]), "ties", narrow=True)
        ready = F.col("here") <= F.col("need") + few
        done = done.unionByName(step.filter(ready).select("lang", "source", "value", F.col("prefix").alias("bound")))
        left = step.filter(~ready).select("lang", "source", "value", "need", "prefix")
    return done


def term_part(shares: DataFrame, top: int = TOP, few: int = FEW_TIES) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms of a greater share than in the language, the `top` most divergent."""
    found = stage_table(shares.filter("p > q").select("lang", "source", "term", strays(F.col("p"), F.col("q")).alias("value")), "found")
    bounds = tie_bounds(found, stage_table(kth_values(found, top), "kth", narrow=True), few)
    bounds = bounds.withColumnRenamed("value", "__kth")
    head = F.col("term").cast("binary").substr(F.lit(1), F.octet_length("bound"))
    taken = F.col("__kth").isNull() | (F.col("value") > F.col("__kth")) | ((F.col("value") == F.col("__kth")) & (F.col("bound").isNull() | (head <= F.col("bound"))))
    chosen = found.join(bounds, ["lang", "source"], "left").filter(taken)
    # At most top + few rows of a group are left.
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term")))
    return chosen.select("lang", "source", F.col("term").alias("item"), "value", rank.alias("rank")).filter(F.col("rank") <= top)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, other, value): what terms that two groups share add to the pair, beyond both groups' own corrections.

    Rows (lang, term, place, p, p0) arrive term by term.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def pairs(lang: str, starts: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(starts)
        size, first = np.repeat(sizes, sizes), np.repeat(starts[:-1], sizes)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            a = np.repeat(np.arange(at, to), size[at:to])
            b = np.arange(len(a)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to]) + np.repeat(first[at:to], size[at:to])
            a, b = a[a != b], b[a != b]
            # Sums may wrap on the way; the whole does not, and modulo 2**64 that is all the same.
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            key, inverse = np.unique(place[a] << 32 | place[b], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, value)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(total)], ["lang", "place", "other", "value"])
            at = to

    waiting: list[pa.RecordBatch] = []
    n = 0

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
        numbers = [table.column(c).to_numpy().astype(np.int64) for c in ("place", "p", "p0")]
        if not len(lang):
            return
        lang, term = (c.dictionary_encode() for c in (lang, term))
        of, name = lang.indices.to_numpy(), term.indices.to_numpy()
        edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (name[1:] != name[:-1]), True])
        for k in range(len(lang.dictionary)):
            own = edges[:-1][of[edges[:-1]] == k]
            lo, hi = own[0], edges[np.searchsorted(edges, own[-1]) + 1]
            yield from pairs(lang.dictionary[k].as_py(), np.r_[own, hi] - lo, *(c[lo:hi] for c in numbers))

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        """Works on all whole terms that wait; rows of the last one wait on, as more of them may come."""
        nonlocal waiting, n
        table = pa.Table.from_batches(waiting).combine_chunks()
        keep = 0 if last else _open_rows(table)
        yield from work(table.slice(0, table.num_rows - keep))
        waiting, n = (table.slice(table.num_rows - keep).to_batches(), keep) if keep else ([], 0)

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
            if n >= PAIRS_AT_ONCE // 8:
                yield from cut(False)
    if waiting:
        yield from cut(True)


def _open_rows(table: pa.Table) -> int:
    """Rows at the table's end that belong to its last term."""
    lang, term = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
    other = np.flatnonzero((lang != lang[-1]) | (term != term[-1]))
    return len(term) - (int(other[-1]) + 1 if len(other) else 0)


def pair_part(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each group's divergence from every other source of its language, summed over all kept terms."""
    a, b = totals.select("lang", "place", "p0", "n_terms"), totals.select("lang", F.col("place").alias("other"), F.col("p0").alias("q0"))
    wide = "decimal(38,0)"
    pairs = a.join(b, "lang").filter("place <> other")  # a row for each row of the result
    base = strays(F.col("p0"), F.col("q0"))
    rows = [pairs.select("lang", "place", "other", (base.cast("decimal(19,0)") * F.col("n_terms").cast("decimal(19,0)")).cast(wide).alias("value"))]
    # How often each share comes in each group: few numbers, whatever the terms.
    levels = shares.groupBy("lang", "place", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    times = F.col("n").cast("decimal(19,0)")
    met = levels.join(b, "lang").filter("place <> other")
    from_it, to_it = strays(F.col("p"), F.col("q0")) - strays(F.col("p0"), F.col("q0")), strays(F.col("q0"), F.col("p")) - strays(F.col("q0"), F.col("p0"))
    rows.append(met.select("lang", "place", "other", (times * from_it.cast("decimal(19,0)")).cast(wide).alias("value")))
    rows.append(met.select("lang", F.col("other").alias("place"), F.col("place").alias("other"), (times * to_it.cast("decimal(19,0)")).cast(wide).alias("value")))
    by_term = shares.select("lang", "term", "place", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = by_term.mapInArrow(_both, "lang string, place long, other long, value long")
    rows.append(both.select("lang", F.col("place").cast("int").alias("place"), F.col("other").cast("int").alias("other"), F.col("value").cast(wide).alias("value")))
    summed = rows[0]
    for more in rows[1:]:
        summed = summed.unionByName(more)
    summed = summed.groupBy("lang", "place", "other").agg(F.sum("value").cast("long").alias("value"))
    names = totals.select("lang", "place", "source")
    named = summed.join(names, ["lang", "place"]).join(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return named.select("lang", "source", "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, few: int = FEW_TIES) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts. Texts are read once; counts, kept terms and shares are staged."""
    counts = stage_table(count_terms(docs, text_col, lang_col, source_col), "counts")
    held = stage_table(kept_terms(counts, min_docs), "held")
    totals = stage_table(group_totals(counts, held), "totals", narrow=True)
    shares = stage_table(with_shares(held, totals), "shares")
    parts = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, part in (("pair", pair_part(shares, totals)), ("term", term_part(shares, top, few)))]
    return parts[0].unionByName(parts[1])
