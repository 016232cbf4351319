"""Site-wide figures: totals, depth profile, link health, traffic comparison, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.links import power_label
from linkloom.operators.ordering import dense_index, quantiles, running_total

FEW_IN_LINKS = 2
PLAIN_TEMPLATES = ["homepage", "dc"]  # Fixed values: templates never reported as orphans.


def _count() -> Column:
    return F.count(F.lit(1))


def _percent(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)) * 100


def overview_kpis(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    edge_count = edges.agg(_count().alias("n")).scalar()
    return metrics.agg(
        _count().alias("pages"),
        F.coalesce(F.sum("pri_score"), F.lit(0.0)).alias("pri_sum"),
        F.coalesce(F.avg("out_degree"), F.lit(0.0)).alias("avg_out_degree"),
        F.count_if("can_give_juice").alias("donors"),
    ).withColumn("edges", edge_count)


def block_mix(edges: DataFrame) -> DataFrame:
    return edges.groupBy("block_type").agg(_count().alias("count"))


def template_stats(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("template").agg(
        _count().alias("pages"), F.sum("pri_score").alias("pri_sum"), F.avg("pri_score").alias("pri_mean")
    )


def depth_kpis(metrics: DataFrame) -> DataFrame:
    spread = quantiles(metrics, "depth", {"p90_depth": 0.90}, ["median_depth"], few_values=True)
    spread = spread.select(F.struct("median_depth", "p90_depth")).scalar()
    return metrics.agg(
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") >= 3).alias("deep_pages")
    ).select("min_depth", "max_depth", "deep_pages", spread.alias("s")).select("min_depth", "max_depth", "deep_pages", "s.*")


def depth_stats(metrics: DataFrame) -> DataFrame:
    """Per depth: size, score distribution, share of the total score, flag shares."""
    spread = quantiles(metrics, "pri_score", {"pri_p10": 0.10, "pri_p50": 0.50, "pri_p90": 0.90}, by="depth")
    total = metrics.agg(F.coalesce(F.sum("pri_score"), F.lit(0.0)).alias("t")).select(
        F.when(F.col("t") > 0, F.col("t")).otherwise(1.0)
    ).scalar()
    per_depth = metrics.groupBy("depth").agg(
        _count().cast("long").alias("page_count"),
        F.sum("pri_score").alias("pri_sum"),
        F.avg("pri_score").alias("pri_mean"),
        (F.avg(F.col("can_give_juice").cast("double")) * 100).alias("donor_ratio_pct"),
        (F.avg(F.col("is_low_power").cast("double")) * 100).alias("low_power_ratio_pct"),
    )
    return per_depth.join(F.broadcast(spread), "depth").withColumn("pri_share_pct", F.col("pri_sum") / total * 100)


def traffic_pareto(real: DataFrame) -> DataFrame:
    """Clicked pages, most clicked first, with cumulative shares of clicks and pages."""
    clicked = real.where(F.col("real_clicks") > 0).select("path", F.col("real_clicks").cast("double").alias("real_clicks"))
    order = [F.desc("real_clicks"), F.col("path")]
    placed = running_total(dense_index(clicked, order, "position"), [F.col("position")], "real_clicks", "so_far")
    totals = clicked.agg(F.struct(_count().alias("pages"), F.sum("real_clicks").alias("clicks"))).scalar()
    return placed.withColumn("t", totals).select(
        "path",
        "position",
        (F.col("position") / F.col("t.pages") * 100).alias("pages_pct"),
        (F.col("so_far") / F.col("t.clicks") * 100).alias("cumul_clicks_pct"),
    )


def pareto_summary(pareto: DataFrame) -> DataFrame:
    """Share of pages that brings half, and four fifths, of all clicks."""
    reached = F.col("cumul_clicks_pct")
    return pareto.agg(
        _count().alias("clicked_pages"),
        F.min(F.when(reached >= 50, F.col("pages_pct"))).alias("pages_pct_for_50"),
        F.min(F.when(reached >= 80, F.col("pages_pct"))).alias("pages_pct_for_80"),
    )


def _median_out(metrics: DataFrame) -> Column:
    return quantiles(metrics, "out_degree", {}, ["median"], few_values=True).scalar()


def link_health(metrics: DataFrame) -> DataFrame:
    marked = metrics.withColumn("_median", _median_out(metrics))
    counts = marked.agg(
        _count().alias("pages"),
        F.count_if(F.col("in_degree") <= FEW_IN_LINKS).alias("orphans"),
        F.count_if("is_low_power").alias("low_power"),
        F.count_if("can_give_juice").alias("donors"),
        F.count_if(F.col("can_give_juice") & (F.col("out_degree") < F.col("_median"))).alias("underused_donors"),
    )
    whole = F.greatest("pages", F.lit(1))
    score = 100 * (1 - F.col("orphans") / whole * 2 - F.col("low_power") / whole)
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))
    return counts.withColumn("health_score", bounded)


def bottlenecks(metrics: DataFrame, n: int = 30) -> DataFrame:
    """Pages that take in many links and pass on few."""
    high_in = quantiles(metrics, "in_degree", {"q": 0.75}, few_values=True).scalar()
    low_out = quantiles(metrics, "out_degree", {"q": 0.25}, few_values=True).scalar()
    return (
        metrics.where((F.col("in_degree") > high_in) & (F.col("out_degree") < F.greatest(low_out, F.lit(5))))
        .orderBy(F.desc("in_degree"), "page_id")
        .limit(n)
    )


def orphan_pages(metrics: DataFrame) -> DataFrame:
    few = metrics.where(F.col("in_degree") <= FEW_IN_LINKS)
    return few.where(~F.col("template").isin(PLAIN_TEMPLATES)) if "template" in metrics.columns else few


def orphans_by_category(metrics: DataFrame, n: int = 15) -> DataFrame:
    counted = orphan_pages(metrics).groupBy("category").agg(_count().alias("pages"))
    return counted.orderBy(F.desc("pages"), F.asc_nulls_first("category")).limit(n)


def underused_donors(metrics: DataFrame, n: int = 30) -> DataFrame:
    few_out = F.col("out_degree") < _median_out(metrics)
    return metrics.where(F.col("can_give_juice") & few_out).orderBy(F.desc("pri_score"), "page_id").limit(n)


def rank_vs_clicks(metrics: DataFrame, real: DataFrame) -> DataFrame:
    """Scores next to measured clicks."""
    columns = [c for c in ("page_id", "path", "pri_score", "in_degree", "template") if c in metrics.columns]
    measured = real.where(F.col("real_clicks").isNotNull()).select("path", "real_clicks", "botify_pr")
    return metrics.select(*columns).join(measured, "path")


def _with_medians(compared: DataFrame) -> DataFrame:
    return compared.withColumn(
        "_med_pri", quantiles(compared, "pri_score", {}, ["m"]).scalar()
    ).withColumn("_med_clicks", quantiles(compared, "real_clicks", {}, ["m"]).scalar())


def quadrants(compared: DataFrame) -> DataFrame:
    """Pages above/below the median score and the median clicks."""
    ranked, clicked = F.col("pri_score") >= F.col("_med_pri"), F.col("real_clicks") >= F.col("_med_clicks")
    return _with_medians(compared).agg(
        F.count_if(ranked & clicked).alias("aligned"),
        F.count_if(ranked & ~clicked).alias("over_linked"),
        F.count_if(~ranked & clicked).alias("under_linked"),
        F.count_if(~ranked & ~clicked).alias("weak"),
    )


def under_linked_top(compared: DataFrame, n: int = 20) -> DataFrame:
    marked = _with_medians(compared)
    return (
        marked.where((F.col("pri_score") < F.col("_med_pri")) & (F.col("real_clicks") >= F.col("_med_clicks")))
        .orderBy(F.desc("real_clicks"), "page_id")
        .limit(n)
        .drop("_med_pri", "_med_clicks")
    )


def top_n_by(metrics: DataFrame, column: str, n: int, descending: bool = True, minimum: float | None = None) -> DataFrame:
    """First n pages by any column, ties by page id."""
    kept = metrics if minimum is None else metrics.where(F.col(column) >= minimum)
    order = F.desc_nulls_first(column) if descending else F.asc_nulls_first(column)
    return kept.orderBy(order, "page_id").limit(n)


def cheirank_kpis(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.coalesce(F.sum("cheirank_score"), F.lit(0.0)).alias("cheirank_sum"),
        F.count_if("can_give_juice").alias("donors"),
        F.count_if("is_low_power").alias("low_power"),
        _percent(F.count_if("is_low_power"), _count()).alias("low_power_pct"),
    )


def cheirank_top(metrics: DataFrame, n: int = 25, side: int = 30) -> DataFrame:
    """(board, ...): best reverse rank, best donors, weakest low-power pages."""
    boards = (
        top_n_by(metrics, "cheirank_score", n).withColumn("board", F.lit("cheirank")),
        top_n_by(metrics.where("can_give_juice"), "cheirank_score", side).withColumn("board", F.lit("donors")),
        top_n_by(metrics.where("is_low_power"), "pri_score", side, descending=False).withColumn("board", F.lit("low_power")),
    )
    merged = boards[0].unionByName(boards[1]).unionByName(boards[2])
    return merged.select("board", "page_id", "path", "cheirank_score", "pri_score", "in_degree", "out_degree")


def power_map(metrics: DataFrame) -> DataFrame:
    """Score, reverse score and power label of every page (the rank/reverse-rank chart)."""
    label = power_label(F.col("can_give_juice"), F.col("is_low_power"))
    return metrics.select("page_id", "pri_score", "cheirank_score", "out_degree", label.alias("segment"))


def systematic_sample(df: DataFrame, keys: list[Column], max_points: int) -> DataFrame:
    """Every ceil(n / max_points)-th row in key order, at most ``max_points``; all rows if few."""
    indexed = dense_index(df, keys, "_i", start=0)
    step = indexed.agg(F.greatest(F.lit(1), F.ceil(_count() / F.lit(max_points)))).scalar()
    return indexed.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < max_points)).drop("_i")


def random_sample_cap(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random n rows: the smallest md5 values of seed and key."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(draw, key).limit(n)
