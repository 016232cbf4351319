"""Quality rules judged per document and per host.

Document rules give pass or fail; failures are counted per host (any grouping column), failure rates
are shrunk towards the corpus by a beta prior fitted to all hosts, and a host whose shrunk rate of any
rule is over ``max_rate`` is rejected with all its documents. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, materialize

RULES = ["short", "repetitive", "symbols", "dup_lines"]


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more.

    Windows are sorted by (hash, position) within the row; a window equal to a neighbour is repeated.
    The covered positions of the repeated windows, in order, overlap only with the one before.
    """
    count = F.size(words)
    hashed = F.transform(
        F.sequence(F.lit(1), count - 2),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")),
    )

    def neighbours(windows: Column) -> Column:
        twice = F.filter(
            windows,
            lambda w, at: F.coalesce(F.get(windows, at - 1)["h"] == w["h"], F.lit(False))
            | F.coalesce(F.get(windows, at + 1)["h"] == w["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda w: w["i"]))

    def covered(at: Column) -> Column:
        # each window covers 3 words, less what the repeated window before it covers already
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-2).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        )["n"]

    # transform over a one-element array binds the sorted windows once
    bound = F.transform(F.array(F.sort_array(hashed)), lambda windows: covered(neighbours(windows)))
    return F.when(count < 3, F.lit(0).cast("long")).otherwise(F.get(bound, F.lit(0)))


def text_measures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the measures of each text; null text has no words."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(*keep, body.alias("_body"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_body", "\n", -1), lambda line: line.rlike(WORD))
    return base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_body", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))[0].alias("_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    ).select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("_lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.col("_lines.n").cast("long").alias("n_text_lines"),
    )


def rule_failures() -> dict[str, Column]:
    """Failed rules of a document, from its measures."""
    return {
        "short": F.col("n_words") < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_text_lines"),
    }


def host_verdicts(measures: DataFrame, host: str, max_rate: float) -> DataFrame:
    """_host, host_docs, host_rate (largest shrunk failure rate) and host_ok, a row per host.

    The prior of a rule has the mean and, by moments, the spread of the hosts' rates; with one host or
    no spread it weighs as much as ``1e6`` documents at that mean.
    """
    failed = rule_failures()
    counts = measures.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(c.cast("long")).alias(name) for name, c in failed.items()]
    )
    rate = {name: F.col(name) / F.col("host_docs") for name in RULES}
    moments = counts.agg(*[f(rate[n]).alias(f"{k}_{n}") for n in RULES for k, f in (("mean", F.avg), ("spread", F.var_samp))])
    joined = counts.withColumn("_moments", moments.select(F.struct("*")).scalar())
    shrunk = []
    for name in RULES:
        mean, spread = F.col(f"_moments.mean_{name}"), F.coalesce(F.nanvl(F.col(f"_moments.spread_{name}"), F.lit(0.0)), F.lit(0.0))
        weight = F.when(spread > 0, F.least(F.lit(1e6), F.greatest(F.lit(1e-3), mean * (1 - mean) / spread - 1))).otherwise(1e6)
        shrunk.append((F.col(name) + mean * weight) / (F.col("host_docs") + weight))
    worst = F.greatest(*shrunk)
    return joined.select("_host", "host_docs", worst.alias("host_rate"), (worst <= max_rate).alias("host_ok"))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """key, host, measures, base_failed, host_rate and kept, a row per row of ``docs``.

    Null text has no words and fails; null hosts are one host; repeated rows count as often as they
    occur. An empty table gives an empty table.
    """
    named = docs.select(F.col(key).alias("_key"), F.col(host).alias("_from"), F.col(text).alias("_text"))
    measures = materialize(text_measures(named, "_text", ["_key", "_from"]), "quality-measures")
    verdicts = host_verdicts(measures, "_from", max_rate)
    failed = rule_failures()
    base = failed["short"] | failed["repetitive"]
    return measures.join(verdicts, F.col("_from").eqNullSafe(F.col("_host"))).select(
        F.col("_key").alias(key),
        F.col("_from").alias(host),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        "host_rate",
        (~base & F.col("host_ok")).alias("kept"),
    )
