"""Figures per vertical and category, with measured traffic where it is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.overview import FEW_IN_LINKS, top_n_by

KEYWORD_TEMPLATE = "ck"

# Labels the external traffic table uses for each vertical.
EXTERNAL_LABELS = {
    "_vehicules_": ["Motors"],
    "_immobilier_": ["RealEstate"],
    "_mode_": ["Mode"],
    "_maison_jardin_": ["MaisonJardin"],
    "_electronique_": ["Autres"],
    "_loisirs_": ["Autres"],
    "_famille_": ["Autres"],
    "_services_": ["Services", "Jobs"],
    "_autre_": ["Autres", "Vacances", "MatPro"],
}


def vertical_kpis(metrics: DataFrame, real: DataFrame) -> DataFrame:
    traffic = real.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("real_clicks"), F.lit(0)).alias("clicks"))
    ).scalar()
    return metrics.agg(
        F.countDistinct("verticale").alias("verticals"),
        F.countDistinct("category").alias("categories"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("pri_score").alias("pri_sum"),
    ).withColumn("t", traffic).select("verticals", "categories", "pages", "pri_sum", F.col("t.n").alias("real_pages"), F.col("t.clicks").alias("clicks"))


def vertical_tree(metrics: DataFrame) -> DataFrame:
    """Score and pages per vertical, category and template, where the score is positive."""
    known = metrics.where(F.col("verticale").isNotNull() & F.col("category").isNotNull())
    return (
        known.groupBy("verticale", "category", "template")
        .agg(F.sum("pri_score").alias("pri_sum"), F.count(F.lit(1)).alias("page_count"))
        .where(F.col("pri_sum") > 0)
    )


def vertical_ranking(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("verticale").isNotNull()).groupBy("verticale").agg(F.sum("pri_score").alias("pri_sum"))


def real_by_vertical(real: DataFrame, labels: dict[str, list[str]] = EXTERNAL_LABELS) -> DataFrame:
    """Traffic rows with every vertical their external label belongs to."""
    owners: dict[str, list[str]] = {}
    for vertical, names in labels.items():
        for name in names:
            owners.setdefault(name, []).append(vertical)
    lookup = F.create_map(
        *[item for name, verticals in owners.items() for item in (F.lit(name), F.array(*[F.lit(v) for v in verticals]))]
    )
    return real.withColumn("verticale", F.explode(F.try_element_at(lookup, F.col("botify_verticale"))))


def vertical_detail(metrics: DataFrame, real: DataFrame, labels: dict[str, list[str]] = EXTERNAL_LABELS) -> DataFrame:
    """All verticals: size, score, share of the whole, degrees, flags, measured traffic."""
    total = metrics.agg(F.greatest(F.sum("pri_score"), F.lit(1e-12))).scalar()
    model = metrics.where(F.col("verticale").isNotNull()).groupBy("verticale").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("pri_score").alias("pri_sum"),
        F.avg("pri_score").alias("pri_mean"),
        F.avg("in_degree").alias("avg_in"),
        F.count_if("can_give_juice").alias("donors"),
        F.count_if("is_low_power").alias("low_power"),
    )
    measured = real_by_vertical(real, labels).groupBy("verticale").agg(
        F.count(F.lit(1)).alias("real_pages"),
        F.coalesce(F.sum("real_clicks"), F.lit(0)).alias("clicks"),
        F.avg("botify_pr").alias("avg_botify_pr"),
    )
    return (
        model.withColumn("pri_pct", F.col("pri_sum") / total * 100)
        .join(measured, "verticale", "left")
        .withColumn("clicks_per_page", F.col("clicks") / F.col("real_pages"))
    )


def category_table(metrics: DataFrame, real: DataFrame, labels: dict[str, list[str]] = EXTERNAL_LABELS) -> DataFrame:
    """All categories of all verticals with their dominant template and measured clicks."""
    known = metrics.where(F.col("category").isNotNull())
    keys = ["verticale", "category"]
    per_template = known.groupBy(*keys, "template").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pri_score").alias("pri"),
        F.sum("in_degree").alias("ins"),
        F.sum("out_degree").alias("outs"),
        F.count_if("is_low_power").alias("low"),
        F.count_if("can_give_juice").alias("give"),
        F.count_if(F.col("in_degree") <= FEW_IN_LINKS).alias("few"),
    )
    pages = F.sum("n")
    stats = per_template.groupBy(*keys).agg(
        F.min_by("template", F.struct((-F.col("n")).alias("n"), "template")).alias("template_dom"),
        pages.alias("pages"),
        F.sum("pri").alias("pri_sum"),
        (F.sum("pri") / pages).alias("pri_mean"),
        (F.sum("ins") / pages).alias("avg_in"),
        (F.sum("outs") / pages).alias("avg_out"),
        (F.sum("low") / pages * 100).alias("low_power_pct"),
        (F.sum("give") / pages * 100).alias("donor_pct"),
        F.sum("few").alias("orphans"),
    )
    measured = real_by_vertical(real, labels).where(F.col("category").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("real_pages"),
        F.coalesce(F.sum("real_clicks"), F.lit(0)).alias("clicks"),
        F.avg("real_clicks").alias("clicks_avg"),
        F.avg("real_inlinks").alias("real_inlinks_avg"),
    )
    return stats.join(measured, keys, "left")


def vertical_block_mix(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Block mix of the out-links of each vertical's pages."""
    owners = metrics.where(F.col("verticale").isNotNull()).select(F.col("page_id").alias("source_id"), "verticale")
    return edges.join(owners, "source_id").groupBy("verticale", "block_type").agg(F.count(F.lit(1)).alias("count"))


def keyword_pages(metrics: DataFrame, n: int = 10) -> DataFrame:
    """(board, ...): best keyword pages, and the weakest of those with few in-links."""
    keywords = metrics.where(F.col("template") == KEYWORD_TEMPLATE)
    orphans = keywords.where(F.col("in_degree") <= FEW_IN_LINKS)
    best = top_n_by(keywords, "pri_score", n).withColumn("board", F.lit("best"))
    weakest = top_n_by(orphans, "pri_score", n, descending=False).withColumn("board", F.lit("weakest_orphans"))
    return best.unionByName(weakest).select("board", "page_id", "path", "pri_score", "in_degree", "out_degree")


def keyword_orphans(metrics: DataFrame) -> DataFrame:
    keywords = metrics.where(F.col("template") == KEYWORD_TEMPLATE)
    return keywords.agg(
        F.count(F.lit(1)).alias("keyword_pages"), F.count_if(F.col("in_degree") <= FEW_IN_LINKS).alias("orphans")
    )


def category_drilldown(metrics: DataFrame, category: str, n: int = 15) -> DataFrame:
    """(board, ...): most and least linked pages of one category."""
    pages = metrics.where(F.col("category") == category)
    most = top_n_by(pages, "in_degree", n).withColumn("board", F.lit("most_linked"))
    least = top_n_by(pages, "in_degree", n, descending=False, minimum=1).withColumn("board", F.lit("least_linked"))
    return most.unionByName(least).select("board", "page_id", "path", "template", "pri_score", "rank", "in_degree", "out_degree")


def category_profile(metrics: DataFrame, real: DataFrame, category: str) -> DataFrame:
    """(template, ...): template mix of one category, with the category's measured traffic."""
    traffic = real.where(F.col("category") == category).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("real_clicks").alias("clicks"), F.avg("botify_pr").alias("pr"))
    ).scalar()
    return (
        metrics.where(F.col("category") == category)
        .groupBy("template")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum("pri_score").alias("pri_sum"),
            F.avg("in_degree").alias("avg_in"),
            F.avg("out_degree").alias("avg_out"),
            F.count_if("is_low_power").alias("low_power"),
        )
        .withColumn("t", traffic)
        .select("template", "pages", "pri_sum", "avg_in", "avg_out", "low_power", F.col("t.n").alias("real_pages"), F.col("t.clicks").alias("clicks"), F.col("t.pr").alias("avg_botify_pr"))
    )
