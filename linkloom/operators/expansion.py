"""Landing-page tables from taxonomy tables.

Taxonomy inputs:
``categories(category, verticale)``; ``facets(category, facet, facet_no, value, value_no)``
with both numbers starting at 1; ``keywords(category, keyword, facet, value)`` with the facet
value that a keyword names; ``places(kind, place, place_no, code)`` with kind ``region``,
``department`` or ``town`` numbered from 1 within its kind; ``static_pages(path,
parent_path, template, cluster_thematique)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import segment_pieces
from linkloom.operators.ordering import dense_index
from linkloom.schemas import TEMPLATE_PAGES, conform

DRAFT = ["path", "parent_path", "template", "cluster_thematique"]

# Fixed value: vertical of unlisted categories.
OTHER_VERTICAL = "_services_"
#: Places that are sent to tasks as one constant; some 50 bytes each.
PLACES_TOGETHER = 20_000


@dataclass(frozen=True)
class ExpansionOptions:
    """How many values of a list are used; None: all."""

    combo_values: int | None = None
    combo_other_values: int | None = None
    towns_per_category: int | None = None
    geo_facet_regions: int | None = None
    geo_facets: int | None = None
    geo_facet_values: int | None = None
    hybrid_regions: int | None = None


def _up_to(rows: DataFrame, number: str, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.where(F.col(number) <= limit)


def _draft(df: DataFrame, path: Column, parent: Column, template: str, family: str) -> DataFrame:
    return df.select(
        path.alias("path"),
        parent.alias("parent_path"),
        F.lit(template).alias("template"),
        F.concat(F.lit(f"{family}:"), F.col("category")).alias("cluster_thematique"),
    )


def _p(pattern: str) -> Column:
    """Path from a pattern with ``{column}`` holes."""
    parts = []
    for i, piece in enumerate(pattern.replace("}", "{").split("{")):
        if piece:
            parts.append(F.col(piece) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def expand_category_pages(categories: DataFrame, static_pages: DataFrame) -> DataFrame:
    """Static pages, one page per vertical and one per category."""
    vertical = F.coalesce("verticale", F.lit(OTHER_VERTICAL))
    tops = categories.select(vertical.alias("category")).distinct()
    rows = categories.withColumn("verticale", vertical)
    return (
        static_pages.select(*DRAFT)
        .unionByName(_draft(tops, _p("/c/{category}"), F.lit("/"), "c_L0", "c"))
        .unionByName(_draft(rows, _p("/c/{category}"), _p("/c/{verticale}"), "c_L1", "c"))
    )


def expand_facet_pages(facets: DataFrame, options: ExpansionOptions = ExpansionOptions()) -> DataFrame:
    """One page per facet value, and combinations with the category's first other facet."""
    single = _draft(facets, _p("/c/{category}/{facet}:{value}"), _p("/c/{category}"), "c_L2", "c")
    named = facets.select("category", "facet", "facet_no").distinct()
    # The first other facet is number 1, except for facet 1 itself, which pairs with number 2.
    wanted = F.when(F.col("facet_no") == 1, F.lit(2)).otherwise(F.lit(1))
    pairs = named.select("category", "facet", wanted.alias("other_no"))
    others = _up_to(facets, "value_no", options.combo_other_values).select(
        "category", F.col("facet").alias("other"), F.col("facet_no").alias("other_no"), F.col("value").alias("other_value")
    )
    combos = (
        _up_to(facets, "value_no", options.combo_values)
        .join(pairs, ["category", "facet"])
        .join(others, ["category", "other_no"])
    )
    combined = _p("/c/{category}/{facet}:{value}+{other}:{other_value}")
    return single.unionByName(_draft(combos, combined, _p("/c/{category}/{facet}:{value}"), "c_L3", "c"))


def _with_places(rows: DataFrame, places: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Every row with the first ``limit`` places of a kind.

    Up to PLACES_TOGETHER places are one array that goes to the tasks of ``rows`` as a constant, so no
    row moves. Longer lists are cut into arrays of that many, and rows meet them by the array's number.
    """
    of_kind = _up_to(places.where(F.col("kind") == kind), "place_no", limit)
    last = of_kind.agg(F.max("place_no")).first()[0]  # they are numbered from 1
    if last is None:
        return rows.withColumns({"place": F.lit(None).cast("string"), "code": F.lit(None).cast("string")}).limit(0)
    number = F.floor((F.col("place_no") - 1) / F.lit(PLACES_TOGETHER)).cast("long")
    lists = of_kind.groupBy(number.alias("_list")).agg(F.collect_list(F.struct("place", "code")).alias("_places"))
    if last <= PLACES_TOGETHER:
        met = rows.withColumn("_places", lists.select("_places").scalar())
    else:
        numbers = F.sequence(F.lit(0).cast("long"), F.lit((last - 1) // PLACES_TOGETHER).cast("long"))
        met = rows.withColumn("_list", F.explode(numbers)).join(lists, "_list").drop("_list")
    return met.withColumn("_place", F.explode("_places")).select(*[F.col(f"`{c}`") for c in rows.columns], "_place.place", "_place.code")


def expand_geo_pages(
    categories: DataFrame, places: DataFrame, facets: DataFrame, options: ExpansionOptions = ExpansionOptions()
) -> DataFrame:
    """Category pages per region, department and town, and region pages per facet value."""
    names = categories.select("category").distinct()
    parent = _p("/c/{category}")
    regions = _with_places(names, places, "region")
    departments = _with_places(names, places, "department")
    towns = _with_places(names, places, "town", options.towns_per_category)
    top_facets = _up_to(_up_to(facets, "facet_no", options.geo_facets), "value_no", options.geo_facet_values).select(
        "category", "facet", "value"
    )
    faceted = _with_places(top_facets, places, "region", options.geo_facet_regions)
    return (
        _draft(regions, _p("/cl/{category}/rp_{place}"), parent, "cl", "cl")
        .unionByName(_draft(departments, _p("/cl/{category}/dp_{place}"), parent, "cl", "cl"))
        .unionByName(_draft(towns, _p("/cl/{category}/cp_{place}_{code}"), parent, "cl", "cl"))
        .unionByName(
            _draft(faceted, _p("/cl/{category}/rp_{place}/{facet}:{value}"), _p("/cl/{category}/rp_{place}"), "cl", "cl")
        )
    )


def expand_keyword_pages(keywords: DataFrame) -> DataFrame:
    """One page per keyword of a category."""
    rows = keywords.select("category", "keyword").distinct()
    return _draft(rows, _p("/ck/{category}/{keyword}"), _p("/c/{category}"), "ck", "ck")


def expand_hybrid_pages(keywords: DataFrame, places: DataFrame, options: ExpansionOptions = ExpansionOptions()) -> DataFrame:
    """One page per keyword, facet value that it names, and region."""
    rows = _with_places(keywords.select("category", "keyword", "facet", "value").distinct(), places, "region", options.hybrid_regions)
    path = _p("/ckl/{category}/{keyword}/cp_{place}_{code}/{facet}:{value}")
    return _draft(rows, path, _p("/ck/{category}/{keyword}"), "ckl", "ckl")


def expand_finalize(drafts: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """Template page table: one row per path, first pages of each budgeted template, dense ids."""
    facts = F.min(F.struct("template", "parent_path", "cluster_thematique")).alias("facts")
    unique = drafts.groupBy("path").agg(facts).select("path", "facts.*")
    if budgets:
        placed = dense_index(unique, [F.col("template"), F.col("path")], "_n")
        first = placed.groupBy("template").agg(F.min("_n").alias("_first"))
        limit = F.lit(None).cast("long")
        for template, budget in budgets.items():
            limit = F.when(F.col("template") == template, F.lit(budget).cast("long")).otherwise(limit)
        unique = placed.join(F.broadcast(first), "template").where(
            limit.isNull() | (F.col("_n") - F.col("_first") < limit)
        )
    pages = dense_index(unique.select("path", "template", "parent_path", "cluster_thematique"), [F.col("path")], "page_id")
    pieces = segment_pieces(F.col("path"))
    return conform(
        pages.withColumn("depth", F.size(pieces))
        .withColumn("section", F.coalesce(F.try_element_at(pieces, F.lit(1)), F.lit("root")))
        .withColumn("is_leaf", F.lit(True)),
        TEMPLATE_PAGES,
    )


def template_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("template").agg(F.count(F.lit(1)).alias("count"))
