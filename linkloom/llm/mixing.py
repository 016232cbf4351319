"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target (its share of all tokens by weight, at most ``max_repeats`` times its own
size) and a schedule: how its weight runs over training time. The integral of the schedule is the
source's cumulative token demand; its documents, in a fixed random order, fill that demand token by
token, round after round. Inverting the demand at a document's first token gives its training
position in [0, 1), and the mix is the documents range-sorted by position.

Offsets within a source are running sums over small buckets of its order plus per-bucket offsets, so
no task ever holds a whole source. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import materialize

#: Weight of a source over training time as (time, factor) knots; factors are scaled to average 1.
SCHEDULES = [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)], [(0.0, 1.5), (1.0, 0.5)]]
BUCKET_ROWS = 4_000


def integrate(knots: list[tuple[float, float]]) -> list[dict[str, float]]:
    """Pieces of the schedule: time t0, length, weight w0 at its start, slope, demand c0..c1 (1 in all)."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
    pieces, demand = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        part = (t1 - t0) * (w0 + w1) / 2 / area
        pieces.append({"t0": t0, "w0": w0 / area, "slope": (w1 - w0) / (t1 - t0) / area, "c0": demand, "c1": demand + part})
        demand += part
    return pieces


def _position(share: Column, slot: Column, schedules: list[list[tuple[float, float]]]) -> Column:
    """Time at which the demand of a slot's schedule reaches ``share`` (0 to 1)."""
    found = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        pieces = integrate(knots)
        time = F.lit(None).cast("double")
        for piece in reversed(pieces):
            ahead = share - F.lit(piece["c0"])
            root = F.lit(piece["w0"]) + F.sqrt(F.greatest(F.lit(0.0), F.lit(piece["w0"] ** 2) + F.lit(2 * piece["slope"]) * ahead))
            here = F.lit(piece["t0"]) + F.when(root > 0, F.lit(2.0) * ahead / root).otherwise(0.0)
            time = here if piece is pieces[-1] else F.when(share < piece["c1"], here).otherwise(time)
        found = F.when(slot == number, time).otherwise(found)
    return found


def source_targets(sized: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """One row per source: source, slot, source_size, n_docs, target, quota (words, rounded target).

    Sources by code point, null last, take the weights in turn and share all tokens by weight. A
    source whose share exceeds ``max_repeats`` times its size gets that; the rest is shared anew among
    the others. In order of cap per weight the capped ones come first, so one running sum settles it.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    slots = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    cap = F.col("source_size") * max_repeats
    order = Window.orderBy(cap / F.col("weight"), "place")
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = slots.withColumns(
        {
            "left_tokens": F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "cap": cap,
            "rank": F.row_number().over(order),
        }
    )
    # the first source, in order of cap per weight, whose share of what is left lies below its cap
    free = F.col("weight") * F.col("left_tokens") <= F.col("cap") * F.col("left_weight")
    first = F.min(F.when(free, F.struct("rank", "left_tokens", "left_weight"))).over(everyone)
    return (
        filled.withColumn("first", first)
        .withColumn(
            "target",
            F.when(
                F.col("rank") >= F.col("first.rank"),
                F.col("weight").cast("double") * F.col("first.left_tokens").cast("double") / F.col("first.left_weight").cast("double"),
            ).otherwise(F.col("cap").cast("double")),
        )
        .withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
        .select("source", (F.col("place") % F.lit(max(len(weights), 1))).cast("int").alias("slot"), "source_size", "n_docs", "target", "quota")
    )


def curriculum(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    weights: list[int] = (1, 2, 3),
    schedules: list[list[tuple[float, float]]] = SCHEDULES,
    max_repeats: int = 3,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken and placements (copy, position, words).

    ``words`` is how many of the copy's words the mix takes: all, but for the one document at which
    the source's quota ends. A document without tokens is never taken; all sources empty, all targets
    are 0. Null sources are one source. Rows are independent: a repeated row is another document. Order
    within a source is the md5 of the id, ties by id and size, so reruns agree. Result columns replace
    input columns of the same name.
    """
    weights = list(weights)
    spread = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    sized = materialize(docs.select(F.col(source).cast("string").alias("source"), size.cast("long").alias("size"), spread.alias("_spread")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, max_repeats).coalesce(1), "mix-targets").withColumn(
        "_buckets", F.ceil(F.col("n_docs") / F.lit(BUCKET_ROWS)).cast("long")
    )
    bucket = F.floor(F.conv(F.substring("_spread", 1, 8), 16, 10).cast("double") / F.lit(float(2**32)) * F.col("_buckets")).cast("long")
    per_bucket = (
        sized.join(targets.select(F.col("source").alias("_s"), "_buckets"), F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source", bucket.alias("bucket"))
        .agg(F.sum("size").alias("tokens"))
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        F.col("source").alias("_os"), F.col("bucket").alias("_ob"), F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("_offset")
    )
    made = ["size", "source_size", "target", "taken", "placements"]
    rows = docs.withColumns({"_size": size.cast("long"), "_spread": spread, "_source": F.col(source).cast("string")})
    rows = rows.drop(*[c for c in made if c != source and c in docs.columns])
    known = targets.select(
        F.col("source").alias("_s"), F.col("slot").alias("_slot"), "source_size", "target", F.col("quota").alias("_quota"), "_buckets"
    )
    rows = rows.join(known, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_bucket", bucket)
    rows = rows.join(offsets, F.col("_source").eqNullSafe(F.col("_os")) & (F.col("_bucket") == F.col("_ob")))
    ahead = Window.partitionBy("_source", "_bucket").orderBy("_spread", key, "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    copies = []
    for copy in range(max_repeats):
        first = F.col("_start") + F.col("source_size") * copy
        words = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_quota") - first))
        share = F.when(F.col("_quota") > 0, first.cast("double") / F.col("_quota").cast("double")).otherwise(0.0)
        copies.append(F.struct(F.lit(copy).alias("copy"), _position(share, F.col("_slot"), schedules).alias("position"), words.alias("words")))
    placed = rows.withColumn("placements", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    placed = placed.withColumns({"size": F.col("_size"), "taken": taken})
    return placed.drop("_size", "_spread", "_source", "_s", "_slot", "_quota", "_buckets", "_bucket", "_os", "_ob", "_offset", "_start")


def first_words(text: Column, words: Column) -> Column:
    """Text up to the end of its first ``words`` words."""
    space = r"[\x20\x09-\x0D]+"
    lead = F.length(F.regexp_extract(text, f"^{space}", 0))
    body = F.substring(text, lead + 1, F.length(text))
    parts = F.split(body, space, (words + 1).cast("int"))
    rest = F.when(F.size(parts) > words, F.length(F.element_at(parts, -1))).otherwise(0)
    return F.rtrim(F.substring(text, F.lit(1), F.length(text) - rest))


def mixed_documents(docs: DataFrame, size: Column, text: str = "text", **options) -> DataFrame:
    """The mix itself: a row per placement, range-sorted by position, text cut where a quota ends.

    Returns the columns of ``docs``; documents that the mix doesn't take go.
    """
    columns = docs.columns
    placed = curriculum(docs, size, **options).withColumn("_placed", F.explode("placements"))
    cut = F.when(F.col("_placed.words") < F.col("size"), first_words(F.col(text), F.col("_placed.words"))).otherwise(F.col(text))
    sorted_rows = placed.orderBy(F.col("_placed.position"), options.get("key", "doc_id"), F.col("_placed.copy"))
    return sorted_rows.select(*[cut.alias(text) if c == text else F.col(c) for c in columns])
