"""Quality rules: plain counts first, then a log-likelihood ratio between trusted text and the raw corpus.

Tokens are runs of letters, runs of digits and runs of other visible characters. Every token and every pair of
neighbours is hashed into one of `BUCKETS` buckets. Counts over the whole corpus give the raw multinomial, counts over
all trusted documents the target. A text's score is the mean over its buckets of the logarithm of target
by raw share, and a fixed threshold decides every text alike.

Everything here is DataFrame functions: one pass counts buckets (added up before the shuffle), one pass scores each
row where it lies, with the ratios as one constant array of `BUCKETS` numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.25
SYMBOL = "[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+"
FEWEST_WORDS, MOST_REPEATED = 50, 50


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once per row, however often it is read inside."""
    return F.transform(F.array(value), use)[0]


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def buckets_of(text: Column) -> Column:
    """The bucket of every token, then of every pair of neighbouring tokens."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return _once(
        tokens,
        lambda t: F.concat(
            F.transform(t, lambda x: _bucket(x)),
            F.transform(F.slice(t, 2, 1 << 30), lambda x, i: _bucket(F.get(t, i), x)),
        ),
    )


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text.

    Windows are hashed, sorted with their places, and kept where a neighbour in that order is equal; a kept window
    covers three words, less what the window before it covers too.
    """

    def spread(places: Column) -> Column:
        def covered(p: Column, i: Column) -> Column:
            return F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(places, i - 1)))

        return F.aggregate(F.transform(places, covered), F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        def met(x: Column, i: Column) -> Column:
            same = (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
            return F.coalesce(same, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, met), lambda x: x["p"]))

    def from_words(w: Column) -> Column:
        return F.transform(F.slice(w, 3, 1 << 30), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))

    def from_windows(windows: Column) -> Column:
        alone = F.size(F.array_distinct(windows)) == F.size(windows)  # true of most texts, which need no sorting
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(alone, F.lit(0).cast("long")).otherwise(_once(F.sort_array(placed), lambda o: _once(places(o), spread)))

    return _once(_once(words, from_words), from_windows)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every whole text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counted = docs.select(
        "doc_id", text.alias("text"),
        _once(
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).alias("repeated")
            ),
        ).alias("words"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, repeated = F.col("words.n"), F.col("words.repeated")
    failed = (n < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    return counted.select(
        "doc_id", "text", n.alias("n_words"), F.col("words.chars").alias("word_chars"), "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), failed.alias("base_failed")
    )


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Logarithm of target by raw share of every bucket, both smoothed by one; all zero without trusted documents.

    `trusted` lists doc_ids; every text of theirs counts.
    """
    target = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(1))
    marked = docs.select("doc_id", "text").where("text IS NOT NULL").join(target, "doc_id", "left")
    met = marked.select("good", F.explode(buckets_of(F.col("text"))).alias("bucket"))
    counts = met.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()  # BUCKETS rows at most
    raw, good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    out = [0.0] * BUCKETS
    if good:
        for r in counts:
            out[r["bucket"]] = round(math.log((r["good"] + 1) / (good + BUCKETS) * (raw + BUCKETS) / (r["raw"] + 1)), 6)
    return out


def _array(numbers: list[float]) -> Column:
    """One constant; Spark folds it before the query runs."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`base_counts` with llr, the mean log ratio of the text's buckets, and kept.

    A text is kept if it passes the base rules and its llr is at least `threshold`. A null or empty text has no words,
    fails the base rules and has llr 0. Repeated rows give repeated rows, very long texts are read whole, an empty table
    gives an empty one, and no other column is looked at.
    """
    ratios = _array(log_ratios(docs, trusted))

    def mean(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(ratios, b))
        return F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0)

    scored = base_counts(docs).withColumn("llr", _once(buckets_of(F.col("text")), mean)).drop("text")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
