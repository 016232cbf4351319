"""The demonstration sites: given tables -> inputs -> stage tables, each stage written once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import anchors as an
from linkloom.operators import crawl_links as cl
from linkloom.operators import expansion as ex
from linkloom.operators import marts
from linkloom.operators.block_edges import Block, BlockOptions
from linkloom.operators.rank_iteration import RankOptions
from linkloom.operators.scoring import ScoreOptions, compute_pri
from linkloom.operators.url_tree import merge_trees, tree_flatten, tree_pages
from linkloom.plans import inputs
from linkloom.sources.crawl import tree_json_lines_scan
from linkloom.sources.workspace import Workspace
from linkloom.storage import new_folder

# Until a step changes the ranks by less than a thousandth of their rounding; more than 200 steps raise an error.
RANK = RankOptions(tolerance=1e-12)
SCORE = ScoreOptions(rank=RANK)
EXPANSION = ex.ExpansionOptions()
ALL_LISTINGS = ["/c/", "/ck/", "/ckl/", "/cl/", "/l/", "homepage"]
BLOCKS = BlockOptions(
    blocks={
        "breadcrumb": Block(1.0, 5, ["/c/", "/ck/", "/ckl/", "/cl/"]),
        "seo_top_filters": Block(0.85, 20, ALL_LISTINGS),
        "top_searches": Block(0.80, 24, ALL_LISTINGS),
        "top_locations": Block(0.80, 34, ALL_LISTINGS),
        "box_top_filters": Block(0.65, 10, ["/cl/", "/ckl/"]),
        "footer_corporate": Block(0.15, 20, ["all"]),
    },
    max_out_links_per_page=60,
)


class Site:
    """Stage tables of one data folder. A stage is computed when first asked for, then read back."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = inputs.load_tables(spark, folder)
        self.workspace = Workspace(spark, new_folder(spark, "site"))
        self._written: set[str] = set()

    def _input(self, sql: str) -> DataFrame:
        return inputs.derive(self.spark, self.tables, sql)

    def _stage(self, name: str, make, partition_by: list[str] | None = None) -> DataFrame:
        return self.workspace.table(name, make, partition_by)

    # Shop crawl.

    @property
    def raw_links(self) -> DataFrame:
        return self._input(inputs.CRAWL_LINKS)

    @property
    def normalized(self) -> DataFrame:
        return cl.links_normalized(self.raw_links)

    @property
    def host_links(self) -> DataFrame:
        return self._stage("host_links", lambda: cl.host_links(self.normalized))

    @cached_property
    def host(self) -> str:
        return cl.source_host(self.host_links)

    @property
    def internal(self) -> DataFrame:
        return cl.links_internal_follow(self.normalized, self.host)

    @property
    def groups(self) -> DataFrame:
        return cl.link_groups(self.host_links, self.host)

    @property
    def pages(self) -> DataFrame:
        return self._stage("pages", lambda: cl.pages_from_links(self.groups))

    @property
    def identified(self) -> DataFrame:
        return self._stage("links_identified", lambda: cl.link_id_lookup(self.groups, self.pages))

    @property
    def profiles(self) -> DataFrame:
        return self._stage("edge_profiles", lambda: cl.link_edges_topk(cl.edge_profiles(self.identified)))

    @property
    def edges(self) -> DataFrame:
        return self._stage("edges", lambda: cl.profile_edges(self.profiles))

    @property
    def candidates(self) -> DataFrame:
        return self._stage("anchor_candidates", lambda: cl.profile_candidates(self.profiles))

    @property
    def scores(self) -> DataFrame:
        return self._stage("pri_scores", lambda: compute_pri(self.pages, self.edges, SCORE))

    @property
    def plain_metrics(self) -> DataFrame:
        return self._stage("url_metrics", lambda: marts.url_metrics(self.pages, self.scores, self.edges, self.candidates))

    @property
    def template_pages(self) -> DataFrame:
        return self.pages.withColumn("template", F.expr(inputs.TEMPLATE_OF_PAGE))

    @property
    def verticals(self) -> DataFrame:
        return self._input(inputs.CATEGORY_VERTICALS)

    @property
    def metrics(self) -> DataFrame:
        """URL metrics with template, category and vertical."""
        return self._stage(
            "url_metrics_enriched", lambda: marts.url_enrich(self.plain_metrics, self.template_pages, self.verticals)
        )

    @property
    def segments(self) -> DataFrame:
        return self._stage("page_segments", lambda: marts.page_segments(self.pages))

    @property
    def segment_metrics(self) -> DataFrame:
        return self._stage("segment_metrics", lambda: marts.segment_metrics(self.segments, self.plain_metrics))

    @property
    def scenario_edges(self) -> DataFrame:
        return self._stage("scenario_edges", lambda: an.scenario_edges(self.candidates), ["scenario"])

    @property
    def scenario_pri(self) -> DataFrame:
        return self._stage("scenario_pri", lambda: an.scenario_pri(self.pages, self.scenario_edges, SCORE), ["scenario"])

    @property
    def comparison(self) -> DataFrame:
        return self._stage("scenario_comparison", lambda: an.scenario_comparison(self.scenario_pri))

    @property
    def real(self) -> DataFrame:
        return self._stage("real_metrics", lambda: self._input(inputs.REAL_METRICS))

    # URL trees.

    @property
    def tree_documents(self) -> DataFrame:
        """One JSON object per customer."""
        pieces = self._input(inputs.TREE_PIECES)
        leaf = F.create_map(F.lit("_meta"), F.col("note"), F.col("segment_key"), F.lit("page"))
        nested = F.create_map(
            F.col("region_key"), F.create_map(F.col("nation_key"), F.create_map(F.col("customer_key"), leaf))
        )
        return pieces.select(F.to_json(nested).alias("value"))

    @property
    def trees(self) -> DataFrame:
        path = self.workspace.path("tree_documents")
        if "tree_documents" not in self._written:
            self.tree_documents.write.text(path)
            self._written.add("tree_documents")
        return tree_json_lines_scan(self.spark, path)

    @property
    def tree_nodes(self) -> DataFrame:
        return self._stage("tree_nodes", lambda: tree_flatten(self.trees))

    @property
    def tree_pages(self) -> DataFrame:
        return self._stage("tree_pages", lambda: tree_pages(merge_trees(self.tree_nodes)))

    # Expanded template site.

    @property
    def categories(self) -> DataFrame:
        return self._input(inputs.CATEGORIES)

    @property
    def facets(self) -> DataFrame:
        return self._stage("facets", lambda: self._input(inputs.FACETS))

    @property
    def keywords(self) -> DataFrame:
        return self._stage("keywords", lambda: self._input(inputs.KEYWORDS))

    @property
    def places(self) -> DataFrame:
        return self._stage("places", lambda: self._input(inputs.PLACES))

    @property
    def static_pages(self) -> DataFrame:
        return self._input(inputs.STATIC_PAGES)

    @property
    def drafts(self) -> DataFrame:
        return (
            ex.expand_category_pages(self.categories, self.static_pages)
            .unionByName(ex.expand_facet_pages(self.facets, EXPANSION))
            .unionByName(ex.expand_geo_pages(self.categories, self.places, self.facets, EXPANSION))
            .unionByName(ex.expand_keyword_pages(self.keywords))
            .unionByName(ex.expand_hybrid_pages(self.keywords, self.places, EXPANSION))
        )

    @property
    def expanded(self) -> DataFrame:
        return self._stage("expanded_pages", lambda: ex.expand_finalize(self.drafts))

    # Audit document.

    @property
    def audits(self) -> DataFrame:
        return self._stage("audits", self._audit_documents)

    def _audit_documents(self) -> DataFrame:
        """Audit documents as (audit_id, audit): link rules a template, matrix cells a section, schemas a template.

        None holds more than one template's sections or one section's destinations, so they are made and parsed in parallel.
        """
        cells = self._input(inputs.AUDIT_CELLS)
        average = F.sum("links") / F.sum("files")

        def as_map(key: str, value: str):
            return F.map_from_entries(F.collect_list(F.struct(key, value)))

        def documents(rows: DataFrame, part: str, key: str, value) -> DataFrame:
            document = F.struct(F.create_map(F.col(key), value).alias(part))
            return rows.select(F.concat(F.lit(f"{part} "), F.col(key)).alias("audit_id"), F.to_json(document).alias("audit"))

        detail = cells.where(F.col("section") != "A-F").groupBy("template", "section").agg(
            F.map_from_entries(
                F.collect_list(F.struct("destination", (F.col("links") / F.col("files")).alias("v")))
            ).alias("avg_links_by_destination")
        )
        rules = (
            cells.groupBy("template", "section")
            .agg(average.alias("avg_total_links"), F.sum("files").alias("files"))
            .join(detail, ["template", "section"], "left")
            .select("template", "section", "files", F.struct("avg_total_links", "avg_links_by_destination").alias("data"))
            .groupBy("template")
            .agg(F.sum("files").cast("int").alias("file_count"), as_map("section", "data").alias("sections"))
        )
        matrix = (
            cells.groupBy("section", "destination")
            .agg(average.alias("avg_links"))
            .groupBy("section")
            .agg(as_map("destination", "avg_links").alias("cells"))
        )
        kinds = self._input(inputs.AUDIT_SCHEMAS).groupBy("template").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
        found = F.map_from_entries(F.transform("kinds", lambda k: F.struct(k.alias("key"), F.lit(1).alias("value"))))
        schemas = F.struct((F.size("kinds") > 1).alias("has_schema"), found.alias("schemas_found"))
        return (
            documents(rules, "linking_rules_per_template", "template", F.struct("file_count", "sections"))
            .unionByName(documents(matrix, "linking_matrix_section_x_destination", "section", F.col("cells")))
            .unionByName(documents(kinds, "json_ld_diff", "template", schemas))
        )

    @property
    def anomaly_documents(self) -> DataFrame:
        """One JSON document per anomaly, so that no document grows with the data."""
        rows = self._input(inputs.AUDIT_ANOMALIES)
        document = F.struct(F.array(F.struct("severity", "template", "type", "detail")).alias("anomalies"))
        return rows.select(F.col("detail").alias("audit_id"), F.to_json(document).alias("audit"))


_SITES: dict[tuple[str, str], Site] = {}


def site_of(spark: SparkSession, folder: str) -> Site:
    """One Site per application and data folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SITES:
        _SITES[key] = Site(spark, folder)
    return _SITES[key]
