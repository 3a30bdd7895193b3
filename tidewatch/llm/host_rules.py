"""Quality rules per document and per host, with built-in functions only.

A document's base rules are counts over its words and lines. A host's failure rate is the share of its documents
that fail a base rule, shrunk towards all hosts with a beta prior fitted to the hosts by moments; a host whose shrunk
rate exceeds ``max_host_rate`` is rejected, and its verdict reaches all its documents.

Counts are partial sums per task before they meet, so a host with a third of all rows costs no more than another. The
verdicts come back by a plain join of tables of known size; the planner broadcasts them when they are small and splits
the hot host otherwise.

Defined cases: a null text has no words and fails like an empty one; a null host is a host of its own; repeated rows
count each time and are returned each time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

#: Fixed values of the contract.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class RuleLimits:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_host_rate: float = 0.5
    #: Weight of the prior, in documents, where the hosts do not differ enough to estimate one.
    max_prior_weight: float = 1e6


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _covered_words(words: Column) -> Column:
    """Words that stand in a window that occurs twice or more, exactly: windows sorted as text, those that equal a
    neighbour, and the length of the union of their intervals."""
    n = F.size(words) - (WINDOW - 1)
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("at"))))
    marked = F.transform(F.arrays_zip(ordered.alias("here"), F.concat(F.array(F.lit(None).cast("struct<w:string,at:int>")), F.slice(ordered, 1, n - 1)).alias("before"),
                                      F.slice(ordered, 2, n).alias("after")),
                         lambda z: F.when((z["here"]["w"] == z["before"]["w"]) | (z["here"]["w"] == z["after"]["w"]), z["here"]["at"]))
    starts = F.array_sort(F.array_compact(marked))
    gaps = F.zip_with(starts, F.slice(starts, 2, n), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = docs.select(*docs.columns, whole.alias("_whole"), words_of(whole).alias("_words"),
                        F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"))
    hashed = split.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    long_enough = F.size("_words") > WINDOW
    windows = hashed.select("*", F.when(long_enough, F.transform(
        F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.col("_hashes")[i + k] for k in range(1, WINDOW)]))).alias("_windows"))
    # Windows with equal hashes are rare; only texts that have some are compared as text.
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered_words(F.col("_words"))).otherwise(0)
    return windows.select(
        *docs.columns, F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_whole", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_whole") - F.length(F.translate("_whole", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"))


def base_failure(limits: RuleLimits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def host_verdicts(rows: DataFrame, host: str, failed: str, limits: RuleLimits = RuleLimits()) -> DataFrame:
    """Per host: n_docs, n_failed, host_rate (shrunk) and host_kept. ``rows`` should be a written table."""
    hosts = materialize(rows.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # two numbers
    mean = 0.5 if mean is None else mean
    weight = min(max(mean * (1 - mean) / variance - 1, 1.0), limits.max_prior_weight) if variance else limits.max_prior_weight
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select(host, "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk <= limits.max_host_rate).alias("host_kept"))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limits: RuleLimits = RuleLimits()) -> DataFrame:
    """One row per input row: key, the counts, base_failed, host_rate and kept."""
    counted = document_counts(docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(text).alias("_text")), "_text")
    rows = materialize(counted.drop("_text").withColumn("base_failed", base_failure(limits)), "rule-counts")
    verdicts = host_verdicts(rows, "_host", "base_failed", limits).withColumnRenamed("_host", "_verdict_host")
    joined = rows.join(verdicts, rows["_host"].eqNullSafe(verdicts["_verdict_host"]))
    return joined.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
