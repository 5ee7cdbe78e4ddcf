"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document when a measure (per thousand) reaches a cutoff. Of a fixed grid of cutoffs,
each stratum takes for each rule the lowest that is certified: with n good labelled documents, k of them rejected, the
hypothesis "more than `risk / rules` of the good documents are rejected" is refused by the exact
binomial test, P(Bin(n, risk / rules) <= k) <= error / tests, where tests counts all strata, rules and
cutoffs (Bonferroni). So with probability 1 - error at least, no stratum loses more than `risk` of its
good documents to all rules together. A rule without a certified cutoff in a stratum rejects nothing there.

The grid is fixed beforehand and nothing else is learned, so every labelled document is held out.

Measures: symbols by word characters, capitals A-Z by word characters, repeated lines by lines with a
word, words in repeated windows by words. Only built-in functions are used; whole texts, no shuffle of text.

NULL and empty texts have no words: all counts are 0 and they fail the base rule. NULL strata are one
stratum. Documents labelled both good and bad are not good. Rows with NULL or equal ids stay. Extra columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import BLANK_RUN, BLANKS, settle
from touchline.session import broadcast_within

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: measure -> (counted, out of); rejected when 1000 * counted >= cutoff * out of, and out of > 0.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
CUTOFFS = (50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
RISK, ERROR = 0.05, 0.05


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: from sorted (hash, position) pairs, no list is searched."""
    pairs = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p")))

    def positions(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (
            ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        ))
        return F.sort_array(F.transform(again, lambda x: x["p"]))

    # an array of one, so that the sorted pairs are made once and not for every element
    found = F.get(F.transform(F.array(pairs), positions), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(
        (p + WINDOW).cast("long").alias("end"), (a["n"] + p + WINDOW - F.greatest(p.cast("long"), a["end"])).alias("n")
    )
    return F.aggregate(found, start, step, lambda a: a["n"])


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` and the counts of every row's whole text."""
    text = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    trimmed = F.btrim("_t", F.lit(BLANKS))
    lines = F.filter(F.split("_t", "\n"), lambda x: _without(x, BLANKS) != "")
    cut = text.select(
        *keep,
        F.length(_without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(_without(F.col("_t"), CAPITALS))).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
        F.when(trimmed == "", F.array().cast("array<long>")).otherwise(
            F.transform(F.split(trimmed, BLANK_RUN), lambda w: F.xxhash64(w))
        ).alias("_w"),
    )
    hashed = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )
    windows = F.when(F.size("_w") < WINDOW, F.array().cast("array<long>")).otherwise(F.get(F.transform(F.array("_w"), hashed), F.lit(0)))
    windowed = cut.select(
        *keep, "word_chars", "n_symbols", "n_capitals",
        F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    repeats = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_covered(F.col("_h")))
    return windowed.withColumn("n_repeat_words", repeats).drop("_h")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_below(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term; 1 where k is at the mean or above, which certifies nothing."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    summed = F.aggregate(F.slice(F.sequence(F.lit(1), k.cast("int") + 1), F.lit(1), k.cast("int")), start, step, lambda a: a["sum"])
    return F.when(k >= n * p, 1.0).otherwise(summed)


def certified(good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(`stratum`, `rule`, `cutoff`) from the measures of good labelled documents; rules without a certified cutoff are absent."""
    values = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(-1).alias("value"))
        for r, (a, b) in RULES.items()
    ])
    counts = good.select("stratum", F.explode(values).alias("v")).groupBy("stratum", "v.rule", "v.value").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*map(F.lit, CUTOFFS))).alias("cutoff")
    tested = settle(counts.select("*", grid).groupBy("stratum", "rule", "cutoff").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("value") >= F.col("cutoff"), F.col("n")).otherwise(0)).alias("k")
    ), "tests")
    tests = max(1, tested.count())
    passed = tested.where(binomial_below(F.col("n"), F.col("k"), risk / len(RULES)) <= error / tests)
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts of every row, `base_failed` and `kept`. `labels` has `doc_id` and `quality` (1: good)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text")
    )
    found = settle(measures(rows, ["doc_id", "stratum"]), "measures")
    good_ids = labels.groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = 1 and _high = 1").select("doc_id")
    cutoffs = certified(found.join(good_ids, "doc_id"), risk, error).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_c_{r}") for r in RULES])
    joined = found.join(broadcast_within(settle(cutoffs, "cutoffs"), 10_000), F.col("stratum") == F.col("_stratum"), "left")
    rejected = F.lit(False)
    for rule, (a, b) in RULES.items():
        hit = (F.col(b) > 0) & (F.floor(1000 * F.col(a) / F.col(b)) >= F.col(f"_c_{rule}"))
        rejected = rejected | F.coalesce(hit, F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).select(
        F.col("doc_id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
