"""Every operator as a named query over the given tables, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import anchors as fa
from linkloom.functions import links as fl
from linkloom.functions import urls as fu
from linkloom.operators import anchors as an
from linkloom.operators import audit as au
from linkloom.operators import block_edges as be
from linkloom.operators import crawl_links as cl
from linkloom.operators import expansion as ex
from linkloom.operators import marts
from linkloom.operators import overview as ov
from linkloom.operators import report as rp
from linkloom.operators import rule_edges as ru
from linkloom.operators import scenario_views as sv
from linkloom.operators import scoring as sc
from linkloom.operators import selection as se
from linkloom.operators import url_tree as ut
from linkloom.operators import verticals as ve
from linkloom.plans import oracle as o
from linkloom.plans.runs import RunOptions, run_record
from linkloom.plans.site import BLOCKS, EXPANSION, SCORE, Site, site_of
from linkloom.schemas import ANCHOR_CANDIDATES, PAGES, conform
from linkloom.sources import crawl as src
from linkloom.sources import workspace as ws
from linkloom.storage import new_folder

DOUBLE_DECIMALS = 10
FLOAT_DECIMALS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[Site], DataFrame]
    sql: str | None
    decimals: int


QUERIES: dict[str, Query] = {}


def comparable(df: DataFrame, decimals: int = DOUBLE_DECIMALS) -> DataFrame:
    """Round floating-point columns, so that summation order does not show."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column, decimals)
        elif kind == "float":
            column = F.round(column.cast("double"), FLOAT_DECIMALS)
        columns.append(column.alias(name))
    return df.select(*columns)


def add(
    key: str,
    run: Callable[[Site], DataFrame],
    sql: str | None,
    *needs: str,
    d: str = "",
    f: str = "",
    decimals: int = DOUBLE_DECIMALS,
) -> None:
    """Register a query; ``d`` and ``f`` name the double and float columns of the SQL."""
    if sql is not None:
        # Adding zero turns a rounded -0.0 into 0.0.
        rounded = [f"round({c}, {decimals}) + 0.0 AS {c}" for c in d.split()]
        rounded += [f"round(CAST({c} AS DOUBLE), {FLOAT_DECIMALS}) AS {c}" for c in f.split()]
        body = f"SELECT * REPLACE ({', '.join(rounded)}) FROM ({sql})" if rounded else sql
        sql = o.build(body, *needs)
    QUERIES[key] = Query(run, sql, decimals)


SCORES_D = "pri_score cheirank_score juice_potential_score"
UM_D = "pri_score cheirank_score incoming_weight outgoing_weight lexical_diversity_out"
SEGM_D = (
    "pri_sum pri_mean cheirank_sum cheirank_mean donor_ratio low_power_ratio avg_in_degree avg_out_degree avg_lexical_diversity_out"
)
RAW = ", ".join(cl.RAW_LINKS)
E_COLS = "source_id, target_id, block_type, rule_weight"
PAGE = 1  # the home page, for the views of one page


# 2.1 Sources and sinks.


def crawl_csv_scan(s: Site) -> DataFrame:
    path = new_folder(s.spark, "crawl-csv")
    src.write_crawl_csv(s.raw_links, path)
    return src.crawl_csv_scan(s.spark, path)


def parquet_sink(s: Site) -> DataFrame:
    folder = ws.Workspace(s.spark, new_folder(s.spark, "sink"))
    return folder.write("edges", s.edges)


def _report_workspace(s: Site) -> ws.Workspace:
    for table in (s.pages, s.edges, s.scores, s.candidates, s.segments, s.plain_metrics, s.segment_metrics):
        table.schema
    for table in (s.scenario_edges, s.scenario_pri, s.comparison):
        table.schema
    return s.workspace


def csv_export(s: Site) -> DataFrame:
    exported, _ = ws.export_workspace(_report_workspace(s), new_folder(s.spark, "export"))
    return exported


def run_log_append(s: Site) -> DataFrame:
    s.scores.schema
    path = new_folder(s.spark, "run-log")
    for run_id in ("first", "second"):
        record = run_record(s.workspace, run_id, "2024-01-01T00:00:00+00:00", 1.0, RunOptions(score=SCORE))
        log = ws.run_log_append(s.spark, path, record)
    return log.drop("workspace")


def scenario_table_scan(s: Site) -> DataFrame:
    s.scenario_edges.schema
    return ws.scenario_table_scan(s.workspace).groupBy("scenario").agg(F.count(F.lit(1)).alias("edge_count"))


SELECTION = se.UrlFilter(
    segment_level=1,
    segment_path="/economy",
    depth_min=2,
    depth_max=3,
    url_search="BRAND-1",
    templates=["ck", "c_L1"],
    verticals=["_vehicules_", "_immobilier_"],
    block_types=["content", "navigation", "head"],
    anchor_types=["exact", "contextual"],
)
SELECTED = """SELECT * FROM um WHERE page_id IN (SELECT page_id FROM seg WHERE level = 1 AND segment_path = '/economy')
  AND depth BETWEEN 2 AND 3 AND contains(lower(path), 'brand-1') AND template IN ('ck', 'c_L1') AND verticale IN ('_vehicules_', '_immobilier_')
  AND page_id IN (SELECT source_id FROM edges WHERE block_type IN ('content', 'navigation', 'head'))
  AND page_id IN (SELECT source_id FROM cands WHERE anchor_type IN ('exact', 'contextual'))"""
SELECTED_NEEDS = ["um", "seg", "edges", "cands"]


def selected(s: Site) -> DataFrame:
    return se.filter_urls(s.metrics, s.edges, SELECTION, s.segments, s.candidates)


def filtered_csv_export(s: Site) -> DataFrame:
    path = new_folder(s.spark, "filtered")
    chosen = selected(s).select("page_id", "path", "template")
    ws.csv_export(chosen, path)
    return s.spark.read.option("header", True).schema(chosen.schema).csv(path)


add("crawl_csv_scan", crawl_csv_scan, f"SELECT {RAW} FROM raw", "raw")
add(
    "tree_json_scan", lambda s: s.trees.select("tree_id", F.to_json("tree").alias("tree")),
    """SELECT sha256(tree) AS tree_id, tree FROM (SELECT concat('{"', region_key, '":{"', nation_key, '":{"', customer_key, '":{"_meta":"', note,
  '","', segment_key, '":"page"}}}}') AS tree FROM tree_pieces)""",
    "tree_pieces",
)
add(
    "parquet_scan",
    lambda s: s.tables["lineitem"].where(F.col("l_returnflag") == "R").select("l_suppkey", "l_partkey"),
    "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'",
)
add("parquet_sink", parquet_sink, f"SELECT {E_COLS} FROM edges", "edges", f="rule_weight")
add(
    "csv_export",
    csv_export,
    """SELECT 'pages' AS "table", count(*) AS row_count FROM pg UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'pri_scores', count(*) FROM scores UNION ALL SELECT 'anchor_candidates', count(*) FROM cands
UNION ALL SELECT 'page_segments', count(*) FROM seg UNION ALL SELECT 'url_metrics', count(*) FROM plain
UNION ALL SELECT 'segment_metrics', count(*) FROM segm UNION ALL SELECT 'scenario_edges', count(*) FROM scen_edges
UNION ALL SELECT 'scenario_pri', count(*) FROM scen_scores UNION ALL SELECT 'scenario_comparison', count(*) FROM cmp""",
    "pg", "edges", "scores", "cands", "seg", "plain", "segm", "scen_edges", "scen_scores", "cmp",
)
def exported(s: Site, name: str, contract: dict[str, str]) -> DataFrame:
    """A table's CSV as read back."""
    path = new_folder(s.spark, f"export-{name}")
    ws.csv_export(getattr(s, name), path)
    return conform(ws.csv_table(s.spark, path), contract)


add("csv_export_pages", lambda s: exported(s, "pages", PAGES), "SELECT * FROM pg", "pg")
add("csv_export_candidates", lambda s: exported(s, "candidates", ANCHOR_CANDIDATES), "SELECT * FROM cands", "cands", f="rule_weight")
add(
    "run_log_append",
    run_log_append,
    """SELECT run_id, '2024-01-01T00:00:00+00:00' AS "timestamp", (SELECT count(*) FROM pg) AS page_count, (SELECT count(*) FROM edges) AS edge_count,
  (SELECT sum(pri_score) FROM scores) AS pri_sum, 1.0::DOUBLE AS duration_seconds, 0.85::DOUBLE AS damping, '' AS included_block_types,
  40 AS max_out_links_per_page, 8 AS cluster_peer_k FROM (VALUES ('first'), ('second')) r(run_id)""",
    "pg", "edges", "scores", d="pri_sum duration_seconds damping",
)
add("scenario_table_scan", scenario_table_scan, "SELECT scenario, count(*) AS edge_count FROM scen_edges GROUP BY 1", "scen_edges")
add("filtered_csv_export", filtered_csv_export, f"SELECT page_id, path, template FROM ({SELECTED})", *SELECTED_NEEDS)


# 2.2 Scalar functions, each over a whole column of links, pages or edges.


def scalar(key: str, table: str, expression, sql: str, source: str, *keep: str, d: str = "", needs: tuple = ()) -> None:
    """A function's value next to its inputs, once per distinct input."""
    columns = ", ".join(keep)
    add(
        key,
        lambda s: getattr(s, table).select(*keep, expression().alias("value")).distinct(),
        f"SELECT DISTINCT {columns}, {sql} AS value FROM {source}",
        *(needs or (source,)),
        d=d,
    )


scalar("url_host", "raw_links", lambda: fu.url_host(F.col("from_url")), o.host("from_url"), "raw", "from_url")
scalar("url_path", "raw_links", lambda: fu.url_path(F.col("to_url")), o.path("to_url"), "raw", "to_url")
scalar("parse_boolean", "raw_links", lambda: fl.parse_boolean(F.col("follow")), o.boolean("follow"), "raw", "follow")
scalar(
    "normalize_block_type", "raw_links", lambda: fl.normalize_block_type(F.col("link_position")), o.block("link_position"),
    "raw", "link_position",
)
scalar(
    "block_rule_weight", "normalized", lambda: F.round(fl.block_rule_weight(F.col("block_type")).cast("double"), 6),
    f"round(CAST({o.WEIGHT} AS DOUBLE), 6)", "norm", "block_type",
)
scalar("label_from_path", "pages", lambda: fa.label_from_path(F.col("path")), o.label("path"), "pg", "path")
scalar(
    "coalesce_anchor_text", "raw_links",
    lambda: fa.coalesce_anchor_text(F.col("anchor_text"), F.col("alt_text"), fu.url_path(F.col("to_url"))),
    o.coalesced("anchor_text", "alt_text", o.path("to_url")), "raw", "anchor_text", "alt_text", "to_url",
)
scalar(
    "anchor_lexical_normal", "raw_links", lambda: fa.anchor_lexical_normal(F.col("anchor_text")), o.lexical("anchor_text"),
    "raw", "anchor_text",
)
scalar(
    "infer_anchor_type", "groups", lambda: fa.infer_anchor_type(F.col("anchor_text"), F.col("to_path")),
    o.anchor_type("a", "l"), f"(SELECT *, {o.lexical('anchor_text')} AS a, {o.lexical(o.label('to_path'))} AS l FROM internal)",
    "anchor_text", "to_path", needs=("internal",),
)
scalar("parent_path", "pages", lambda: fu.parent_path(F.col("path")), o.parent("path"), "pg", "path")
scalar("path_depth", "pages", lambda: fu.path_depth(F.col("path")), o.depth("path"), "pg", "path")
scalar("path_section", "pages", lambda: fu.path_section(F.col("path")), o.section("path"), "pg", "path")
scalar("path_cluster", "pages", lambda: fu.path_cluster(F.col("path")), o.cluster("path"), "pg", "path")
scalar("anchor_token_count", "groups", lambda: fa.anchor_token_count(F.col("anchor_text")), o.tokens("anchor_text"), "internal", "anchor_text")
scalar(
    "normalize_segment_path", "raw_links", lambda: fu.normalize_segment_path(F.col("from_url")),
    f"concat('/', array_to_string({o.segment_pieces('from_url')}, '/'))", "raw", "from_url",
)
scalar(
    "scenario_selector", "edges", lambda: fa.scenario_selector(F.col("source_id"), F.col("target_id"), F.col("block_type")),
    o.selector(), "edges", "source_id", "target_id", "block_type", d="value",
)
scalar(
    "anchor_type_choice", "edges",
    lambda: fa.anchor_type_choice(
        fa.scenario_selector(F.col("source_id"), F.col("target_id"), F.col("block_type")), F.lit(0.4), F.lit(0.7), F.lit(0.9)
    ),
    f"CASE WHEN {o.selector()} < 0.4::DOUBLE THEN 'exact' WHEN {o.selector()} < 0.7::DOUBLE THEN 'partial' "
    f"WHEN {o.selector()} < 0.9::DOUBLE THEN 'contextual' ELSE 'generic' END",
    "edges", "source_id", "target_id", "block_type",
)
scalar(
    "page_category", "pages", lambda: fu.page_category(F.col("cluster_thematique")),
    "nullif(regexp_extract(cluster_thematique, ':(.+)$', 1), '')", "pg", "cluster_thematique",
)
add(
    "category_vertical",
    lambda s: s.metrics.select("category", "verticale").distinct(),
    "SELECT DISTINCT category, verticale FROM um", "um",
)
scalar(
    "juice_score", "scores", lambda: fl.juice_score(F.col("cheirank_score"), F.col("out_degree")),
    "cheirank_score * ln(CAST(out_degree AS DOUBLE) + 1)", "scores", "page_id", d="value",
)
scalar(
    "power_label", "scores", lambda: fl.power_label(F.col("can_give_juice"), F.col("is_low_power")),
    "CASE WHEN can_give_juice THEN 'donor' WHEN is_low_power THEN 'low_power' ELSE 'normal' END", "scores", "page_id",
)
_ALIASES = " ".join(f"WHEN '{a}' THEN [{', '.join(repr(t) for t in ts)}]" for a, ts in fl.TEMPLATE_ALIASES.items())
add(
    "template_expand",
    lambda s: s.expanded.select(F.concat(F.lit("/"), F.col("section"), F.lit("/")).alias("alias")).distinct()
    .select("alias", F.explode(fl.alias_templates(F.col("alias"))).alias("template")),
    f"SELECT alias, unnest(CASE alias {_ALIASES} ELSE [alias] END) AS template FROM (SELECT DISTINCT concat('/', section, '/') AS alias FROM xp)",
    "xp",
)


# 2.3 Crawl links.

NORM = "link_type, from_host, to_host, from_path, to_path, block_type, is_follow, status_code, anchor_text"
add("links_normalized", lambda s: s.normalized, f"SELECT {NORM} FROM norm", "norm")
add("infer_source_host", lambda s: cl.infer_source_host(s.normalized), "SELECT * FROM src", "src")
add("links_internal_follow", lambda s: s.internal, "SELECT * FROM internal", "internal")
add("pages_from_links", lambda s: cl.pages_from_links(s.groups), "SELECT * FROM pg", "pg")
add(
    "link_id_lookup",
    lambda s: cl.link_id_lookup(s.groups, s.pages).select(
        "source_id", "target_id", "block_type", F.round(F.col("base_weight").cast("double"), 6).alias("base_weight"),
        "anchor_text", "to_path", "instances",
    ),
    """SELECT source_id, target_id, block_type, round(CAST(base_weight AS DOUBLE), 6) AS base_weight, anchor_text, to_path,
  count(*) AS instances FROM ident GROUP BY ALL""",
    "ident",
)
add("link_edges_agg", lambda s: cl.link_edges_agg(s.identified), "SELECT * FROM edges_all", "edges_all", f="rule_weight")
add(
    "link_edges_topk", lambda s: cl.link_edges_topk(cl.link_edges_agg(s.identified), 40),
    f"SELECT {E_COLS} FROM edges_all QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY rule_weight DESC, target_id, block_type) <= 40",
    "edges_all", f="rule_weight",
)
TEXTS = "source_id, target_id, block_type, anchor_type, anchor_text, anchor_instances, rule_weight, anchor_token_count"
add("anchor_text_counts", lambda s: cl.anchor_text_counts(s.identified), f"SELECT {TEXTS} FROM texts", "texts", f="rule_weight")
add(
    "anchor_top_text", lambda s: cl.anchor_top_text(cl.anchor_text_counts(s.identified)), f"SELECT {TEXTS} FROM top_texts",
    "top_texts", f="rule_weight",
)
add(
    "anchor_candidates_links",
    lambda s: cl.anchor_candidates_links(cl.anchor_top_text(cl.anchor_text_counts(s.identified)), s.edges),
    "SELECT * FROM cands", "cands", f="rule_weight",
)
add(
    "links_summary", lambda s: cl.links_summary(s.raw_links, s.groups, s.edges, s.candidates),
    """SELECT 'raw_rows' AS metric, '' AS name, count(*) AS count FROM raw UNION ALL SELECT 'kept_rows', '', count(*) FROM internal
UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'anchor_candidates', '', count(*) FROM cands
UNION ALL SELECT 'block_type', block_type, count(*) FROM edges GROUP BY block_type
UNION ALL SELECT 'anchor_type', anchor_type, count(*) FROM cands GROUP BY anchor_type""",
    "raw", "internal", "edges", "cands",
)

# 2.4 URL tree.

TREE = "path, parent_path, depth, section, cluster_thematique, is_leaf"
add("tree_flatten", lambda s: ut.tree_flatten(s.trees).drop("tree_id"), f"SELECT {TREE} FROM tree_nodes", "tree_nodes")
add("tree_pages", lambda s: ut.tree_pages(ut.merge_trees(s.tree_nodes)), f"SELECT page_id, {TREE} FROM tp", "tp")
add(
    "tree_summary", lambda s: ut.tree_summary(s.tree_pages),
    """SELECT 'pages' AS metric, '' AS name, count(*) AS count FROM tp UNION ALL SELECT 'leaves', '', count(*) FROM tp WHERE is_leaf
UNION ALL SELECT 'clusters', '', count(DISTINCT cluster_thematique) FROM tp
UNION ALL (SELECT 'section', section, count(*) AS n FROM tp GROUP BY section ORDER BY n DESC, section LIMIT 10)""",
    "tp",
)

# 2.5 Rule edges.

add(
    "parent_child_pairs", lambda s: ru.parent_child_pairs(s.tree_pages), "SELECT child_id, parent_id FROM tree_pairs", "tree_pairs"
)
add("hierarchy_up", lambda s: ru.hierarchy_up(ru.parent_child_pairs(s.tree_pages)), f"SELECT {E_COLS} FROM tree_up", "tree_up", f="rule_weight")
add("hierarchy_down", lambda s: ru.hierarchy_down(ru.parent_child_pairs(s.tree_pages)), f"SELECT {E_COLS} FROM tree_down", "tree_down", f="rule_weight")
add("cluster_peer", lambda s: ru.cluster_peer(s.tree_pages), f"SELECT {E_COLS} FROM tree_peer", "tree_peer", f="rule_weight")


def _tree_links(s: Site) -> DataFrame:
    pairs = ru.parent_child_pairs(s.tree_pages)
    return ru.hierarchy_up(pairs).unionByName(ru.hierarchy_down(pairs)).unionByName(ru.cluster_peer(s.tree_pages))


add(
    "edge_dedup_priority", lambda s: ru.edge_dedup_priority(_tree_links(s)), f"SELECT {E_COLS}, priority FROM tree_dedup", "tree_dedup",
    f="rule_weight",
)
add("edge_cap_priority", lambda s: ru.build_rule_edges(s.tree_pages), f"SELECT {E_COLS} FROM tree_edges", "tree_edges", f="rule_weight")
add(
    "edges_summary", lambda s: ru.edges_summary(s.edges),
    """SELECT 'edges' AS metric, '' AS name, count(*) AS count FROM edges UNION ALL SELECT 'block_type', block_type, count(*) FROM edges GROUP BY block_type
UNION ALL SELECT 'max_out_degree', '', max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY source_id)""",
    "edges",
)

# 2.6 Template blocks.

for _key, _build, _cte in (
    ("block_breadcrumb", be.block_breadcrumb, "b_breadcrumb"),
    ("block_top_facets", be.block_top_facets, "b_facets"),
    ("block_top_searches", be.block_top_searches, "b_searches"),
    ("block_top_locations", be.block_top_locations, "b_locations"),
    ("block_cross_links", be.block_cross_links, "b_cross"),
    ("block_footer", be.block_footer, "b_footer"),
):
    _name = {build: name for name, build in be.BLOCK_BUILDERS.items()}[_build]
    add(
        _key, lambda s, b=_build, n=_name: b(s.expanded, BLOCKS.blocks[n]), f"SELECT {E_COLS} FROM {_cte}", _cte, f="rule_weight"
    )
add(
    "block_hierarchy", lambda s: be.block_hierarchy(s.expanded),
    f"SELECT {E_COLS} FROM exp_up UNION ALL SELECT {E_COLS} FROM exp_down", "exp_up", "exp_down", f="rule_weight",
)
add("block_cluster_peer", lambda s: ru.cluster_peer(s.expanded), f"SELECT {E_COLS} FROM exp_peer", "exp_peer", f="rule_weight")


def block_edges(s: Site) -> DataFrame:
    return be.build_block_edges(s.expanded, BLOCKS)


add("block_dedup_cap", block_edges, f"SELECT {E_COLS} FROM b_edges", "b_edges", f="rule_weight")
add(
    "block_summary", lambda s: be.block_summary(block_edges(s)),
    """SELECT 'edges' AS metric, '' AS name, count(*) AS count FROM b_edges
UNION ALL SELECT 'block_type', block_type, count(*) FROM b_edges GROUP BY block_type""",
    "b_edges",
)

# 2.7 Scores.

add(
    "edge_block_filter", lambda s: sc.edge_block_filter(s.edges, ["content", "footer"]),
    f"SELECT {E_COLS} FROM edges WHERE block_type IN ('content', 'footer')", "edges", f="rule_weight",
)
add(
    "edge_id_validation", lambda s: sc.edge_id_validation(s.edges, s.pages.where(~F.col("is_leaf") & (F.col("depth") != 1))),
    f"""SELECT {E_COLS} FROM edges WHERE source_id NOT IN (SELECT page_id FROM pg WHERE NOT is_leaf AND depth <> 1)
  OR target_id NOT IN (SELECT page_id FROM pg WHERE NOT is_leaf AND depth <> 1)""",
    "edges", "pg", f="rule_weight",
)
add("pagerank", lambda s: s.scores.select("page_id", "pri_score"), "SELECT page_id, pri_score FROM scores", "scores", d="pri_score")
add("cheirank", lambda s: s.scores.select("page_id", "cheirank_score"), "SELECT page_id, cheirank_score FROM scores", "scores", d="cheirank_score")
add("degrees", lambda s: sc.degrees(s.pages, s.edges), "SELECT page_id, out_degree, in_degree FROM scores", "scores")
add("score_ranks", lambda s: s.scores.select("page_id", "rank", "cheirank_rank"), "SELECT page_id, rank, cheirank_rank FROM scores", "scores")
add(
    "juice_potential", lambda s: s.scores.select("page_id", "juice_potential_score"), "SELECT page_id, juice_potential_score FROM scores",
    "scores", d="juice_potential_score",
)
add(
    "power_flags", lambda s: s.scores.select("page_id", "is_low_power", "can_give_juice"),
    "SELECT page_id, is_low_power, can_give_juice FROM scores", "scores",
)
add(
    "score_summary", lambda s: sc.score_summary(s.scores),
    """SELECT count(*) AS node_count, sum(pri_score) AS pri_sum, sum(cheirank_score) AS cheirank_sum,
  max(pri_score) FILTER (is_low_power) AS low_power_threshold, min(juice_potential_score) FILTER (can_give_juice) AS donor_threshold,
  count(*) FILTER (is_low_power) AS low_power_page_count, count(*) FILTER (can_give_juice) AS donor_page_count FROM scores""",
    "scores", d="pri_sum cheirank_sum low_power_threshold donor_threshold",
)
add(
    "score_leaders", lambda s: sc.score_leaders(s.scores),
    " UNION ALL ".join(
        f"(SELECT '{c}' AS board, page_id, {c} AS value FROM scores ORDER BY {c} DESC, page_id LIMIT 10)" for c in SCORES_D.split()
    ),
    "scores", d="value",
)
add(
    "scores_normalize", lambda s: sc.scores_normalize(s.scores.select("page_id", "pri_score")),
    f"""SELECT page_id, pri_score, r AS rank, pri_score AS cheirank_score, r AS cheirank_rank, 0.0::DOUBLE AS juice_potential_score,
  0 AS out_degree, 0 AS in_degree, pri_score <= {o.nearest('pri_score', 'scores', 0.1)} AS is_low_power, true AS can_give_juice
FROM (SELECT page_id, pri_score, CAST(row_number() OVER (ORDER BY pri_score DESC, page_id) AS INTEGER) AS r FROM scores)""",
    "scores", d="pri_score cheirank_score juice_potential_score",
)

add(
    "scores_normalize_degrees", lambda s: sc.scores_normalize(s.scores.select("page_id", "pri_score", "cheirank_score", "out_degree", "in_degree")),
    """SELECT page_id, pri_score, rank, cheirank_score, cheirank_rank, juice_potential_score, out_degree, in_degree, is_low_power, can_give_juice
FROM scores""",
    "scores", d="pri_score cheirank_score juice_potential_score",
)

# 2.8 Marts.

add("link_stats", lambda s: marts.link_stats(s.pages, s.edges), "SELECT * FROM stats", "stats", d="outgoing_weight incoming_weight")
add("anchor_stats", lambda s: marts.anchor_stats(s.candidates), "SELECT * FROM astats", "astats")
add("url_metrics", lambda s: marts.url_metrics(s.pages, s.scores, s.edges, s.candidates), "SELECT * FROM plain", "plain", d=UM_D)
add("page_segments", lambda s: marts.page_segments(s.pages), "SELECT * FROM seg", "seg")
add("segment_metrics", lambda s: marts.segment_metrics(s.segments, s.plain_metrics), "SELECT * FROM segm", "segm", d=SEGM_D)
add(
    "top_segments", lambda s: marts.top_segments(s.segment_metrics, 1, 10),
    "SELECT * FROM segm WHERE level = 1 ORDER BY page_count DESC, segment_path LIMIT 10", "segm", d=SEGM_D,
)
add("url_enrich", lambda s: marts.url_enrich(s.plain_metrics, s.template_pages, s.verticals), "SELECT * FROM um", "um", d=UM_D)

# 2.9 Anchors and scenarios.

BASE = f"""SELECT source_id, target_id, block_type, rule_weight, {o.label('path')} AS target_label, {o.label('parent_path')} AS target_parent_label
FROM edges JOIN pg ON page_id = target_id"""
RULE_CANDS = f"""SELECT source_id, target_id, block_type, rule_weight, anchor_type, anchor_text, {o.tokens('anchor_text')} AS anchor_token_count
FROM (SELECT *, unnest(['exact', 'partial', 'contextual', 'generic']) AS anchor_type, unnest([target_label,
  CASE WHEN target_parent_label <> target_label THEN concat(target_label, ' ', target_parent_label) ELSE target_label END,
  concat('Voir ', target_label), 'En savoir plus']) AS anchor_text FROM ({BASE}))"""
add("anchor_base", lambda s: an.anchor_base(s.edges, s.pages), BASE, "edges", "pg", f="rule_weight")
add(
    "anchor_candidates_rules", lambda s: an.anchor_candidates_rules(an.anchor_base(s.edges, s.pages)), RULE_CANDS, "edges", "pg",
    f="rule_weight",
)
add(
    "anchor_candidates_summary", lambda s: an.anchor_candidates_summary(an.anchor_candidates_rules(an.anchor_base(s.edges, s.pages))),
    f"""SELECT 'anchor_candidates' AS metric, '' AS name, count(*) AS count FROM ({RULE_CANDS})
UNION ALL SELECT 'anchor_type', anchor_type, count(*) FROM ({RULE_CANDS}) GROUP BY anchor_type""",
    "edges", "pg",
)
add("candidates_contract_check", lambda s: an.candidates_contract_check(s.candidates), "SELECT * FROM cands", "cands", f="rule_weight")
add("scenario_base_edges", lambda s: an.scenario_base_edges(s.candidates), "SELECT * FROM base_edges", "base_edges", f="rule_weight")
add(
    "scenario_select_anchor", lambda s: an.scenario_select_anchor(s.candidates), "SELECT * FROM selected", "selected", d="alpha",
    f="rule_weight",
)
for _key, _column in (
    ("lexical_diversity", "lexical_diversity_ratio"),
    ("anchor_type_entropy", "anchor_type_entropy_norm"),
    ("diversity_score", "anchor_diversity_score"),
):
    add(
        _key,
        lambda s, c=_column: an.source_diversity(an.scenario_select_anchor(s.candidates)).select("scenario", "source_id", c),
        f"SELECT scenario, source_id, {_column} FROM diversity", "diversity", f=_column,
    )
add("scenario_edges", lambda s: an.scenario_edges(s.candidates), "SELECT * FROM scen_edges", "scen_edges", f="rule_weight anchor_diversity_score")
add("scenario_pri", lambda s: s.scenario_pri, "SELECT * FROM scen_scores", "scen_scores", d=SCORES_D)
_NAMES = [x.name for x in an.SCENARIOS]
_DELTAS = [f"delta_{n}_vs_{_NAMES[0]}" for n in _NAMES[1:]]
CMP_D = " ".join([f"pri_{n}" for n in _NAMES] + _DELTAS)
add("scenario_comparison", lambda s: an.scenario_comparison(s.scenario_pri), "SELECT * FROM cmp", "cmp", d=CMP_D, decimals=14)
add(
    "scenario_summary", lambda s: an.scenario_summary(s.scenario_edges, s.scenario_pri),
    """SELECT e.scenario, edge_count, avg_anchor_diversity_score, avg_rule_weight, exact_count, partial_count, contextual_count, generic_count, pri_sum
FROM (SELECT scenario, count(*) AS edge_count, avg(CAST(anchor_diversity_score AS DOUBLE)) AS avg_anchor_diversity_score,
  avg(CAST(rule_weight AS DOUBLE)) AS avg_rule_weight, count(*) FILTER (anchor_type = 'exact') AS exact_count,
  count(*) FILTER (anchor_type = 'partial') AS partial_count, count(*) FILTER (anchor_type = 'contextual') AS contextual_count,
  count(*) FILTER (anchor_type = 'generic') AS generic_count FROM scen_edges GROUP BY 1) e
JOIN (SELECT scenario, sum(pri_score) AS pri_sum FROM scen_scores GROUP BY 1) p USING (scenario)""",
    "scen_edges", "scen_scores", d="avg_anchor_diversity_score avg_rule_weight pri_sum",
)

# 2.10 Interactive queries.

add("filter_urls", selected, SELECTED, *SELECTED_NEEDS, d=UM_D)
add(
    "filter_edges", lambda s: se.filter_edges(s.edges, selected(s), ["content", "head"]),
    f"SELECT {E_COLS} FROM edges WHERE block_type IN ('content', 'head') AND source_id IN (SELECT page_id FROM ({SELECTED}))",
    *SELECTED_NEEDS, f="rule_weight",
)
add(
    "filter_anchors", lambda s: se.filter_anchors(s.candidates, selected(s), ["content", "head"], ["exact", "contextual"]),
    f"""SELECT * FROM cands WHERE block_type IN ('content', 'head') AND anchor_type IN ('exact', 'contextual')
  AND source_id IN (SELECT page_id FROM ({SELECTED}))""",
    *SELECTED_NEEDS, f="rule_weight",
)
add(
    "filter_options", lambda s: se.filter_options(s.metrics, s.edges, s.candidates, s.segment_metrics),
    """SELECT 'block_type' AS option, block_type AS value, count(*) AS size FROM edges GROUP BY ALL
UNION ALL SELECT 'anchor_type', anchor_type, count(*) FROM cands GROUP BY ALL
UNION ALL SELECT 'template', template, count(*) FROM um WHERE template IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'verticale', verticale, count(*) FROM um WHERE verticale IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'depth_min', CAST(min(depth) AS VARCHAR), NULL FROM um UNION ALL SELECT 'depth_max', CAST(max(depth) AS VARCHAR), NULL FROM um
UNION ALL SELECT 'segment', segment_path, page_count FROM segm WHERE level = 1""",
    "edges", "cands", "um", "segm",
)
add(
    "filtered_summary",
    lambda s: se.filtered_summary(selected(s), se.filter_edges(s.edges, selected(s)), se.filter_anchors(s.candidates, selected(s))),
    f"""WITH f AS ({SELECTED}) SELECT 'pages' AS metric, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM f
UNION ALL SELECT 'pri_sum', '', coalesce(sum(pri_score), 0) FROM f UNION ALL SELECT 'cheirank_sum', '', coalesce(sum(cheirank_score), 0) FROM f
UNION ALL SELECT 'donors', '', count(*) FILTER (can_give_juice) FROM f UNION ALL SELECT 'low_power', '', count(*) FILTER (is_low_power) FROM f
UNION ALL SELECT 'block_type', block_type, count(*) FROM edges WHERE source_id IN (SELECT page_id FROM f) GROUP BY ALL
UNION ALL SELECT 'anchor_type', anchor_type, count(*) FROM cands WHERE source_id IN (SELECT page_id FROM f) GROUP BY ALL""",
    *SELECTED_NEEDS, d="value",
)
add(
    "overview_kpis", lambda s: ov.overview_kpis(s.metrics, s.edges),
    """SELECT count(*) AS pages, sum(pri_score) AS pri_sum, avg(out_degree) AS avg_out_degree, count(*) FILTER (can_give_juice) AS donors,
  (SELECT count(*) FROM edges) AS edges FROM um""",
    "um", "edges", d="pri_sum avg_out_degree",
)
add("block_mix", lambda s: ov.block_mix(s.edges), "SELECT block_type, count(*) AS count FROM edges GROUP BY 1", "edges")
add(
    "template_stats", lambda s: ov.template_stats(s.metrics),
    "SELECT template, count(*) AS pages, sum(pri_score) AS pri_sum, avg(pri_score) AS pri_mean FROM um GROUP BY 1", "um", d="pri_sum pri_mean",
)
TOP = "rank, page_id, path, depth, template, pri_score, cheirank_score, in_degree, out_degree, can_give_juice, is_low_power"
add(
    "top_pages", lambda s: se.top_pages(s.metrics, 25).select(*TOP.split(", ")),
    f"SELECT {TOP} FROM um ORDER BY pri_score DESC, page_id LIMIT 25", "um", d="pri_score cheirank_score",
)
add(
    "depth_kpis", lambda s: ov.depth_kpis(s.metrics),
    f"""SELECT min(depth) AS min_depth, max(depth) AS max_depth, count(*) FILTER (depth >= 3) AS deep_pages, median(depth) AS median_depth,
  {o.nearest('depth', 'um', 0.9)} AS p90_depth FROM um""",
    "um", d="median_depth",
)


def _depth_quantile(fraction: float) -> str:
    return f"max(pri_score) FILTER (i = CAST(floor({fraction}::DOUBLE * (n - 1) + 0.5) AS BIGINT))"


add(
    "depth_stats", lambda s: ov.depth_stats(s.metrics),
    f"""SELECT depth, CAST(count(*) AS INTEGER) AS page_count, sum(pri_score) AS pri_sum, avg(pri_score) AS pri_mean,
  avg(CAST(can_give_juice AS DOUBLE)) * 100 AS donor_ratio_pct, avg(CAST(is_low_power AS DOUBLE)) * 100 AS low_power_ratio_pct,
  {_depth_quantile(0.1)} AS pri_p10, {_depth_quantile(0.5)} AS pri_p50, {_depth_quantile(0.9)} AS pri_p90,
  sum(pri_score) / (SELECT sum(pri_score) FROM um) * 100 AS pri_share_pct
FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY pri_score) - 1 AS i, count(*) OVER (PARTITION BY depth) AS n FROM um) GROUP BY depth""",
    "um", d="pri_sum pri_mean donor_ratio_pct low_power_ratio_pct pri_p10 pri_p50 pri_p90 pri_share_pct",
)
PARETO = """SELECT path, row_number() OVER w AS position, row_number() OVER w / n::DOUBLE * 100 AS pages_pct,
  sum(c) OVER (ORDER BY c DESC, path ROWS UNBOUNDED PRECEDING) / t * 100 AS cumul_clicks_pct
FROM (SELECT path, CAST(real_clicks AS DOUBLE) AS c, count(*) OVER () AS n, sum(CAST(real_clicks AS DOUBLE)) OVER () AS t FROM real WHERE real_clicks > 0)
WINDOW w AS (ORDER BY c DESC, path)"""
add("traffic_pareto", lambda s: ov.traffic_pareto(s.real), PARETO, "real", d="pages_pct cumul_clicks_pct")
add(
    "pareto_summary", lambda s: ov.pareto_summary(ov.traffic_pareto(s.real)),
    f"""SELECT count(*) AS clicked_pages, min(pages_pct) FILTER (cumul_clicks_pct >= 50) AS pages_pct_for_50,
  min(pages_pct) FILTER (cumul_clicks_pct >= 80) AS pages_pct_for_80 FROM ({PARETO})""",
    "real", d="pages_pct_for_50 pages_pct_for_80",
)
MEDIAN_OUT = "(SELECT median(out_degree) FROM um)"
add(
    "link_health", lambda s: ov.link_health(s.metrics),
    f"""SELECT *, greatest(0, least(100, CAST(trunc(100 * (1 - orphans::DOUBLE / greatest(pages, 1) * 2 - low_power::DOUBLE / greatest(pages, 1))) AS INTEGER)))
  AS health_score FROM (SELECT count(*) AS pages, count(*) FILTER (in_degree <= 2) AS orphans, count(*) FILTER (is_low_power) AS low_power,
  count(*) FILTER (can_give_juice) AS donors, count(*) FILTER (can_give_juice AND out_degree < {MEDIAN_OUT}) AS underused_donors FROM um)""",
    "um",
)
SHOW = "page_id, path, template, category, in_degree, out_degree, pri_score, rank"


def show(df: DataFrame) -> DataFrame:
    return df.select(*SHOW.split(", "))


add(
    "bottlenecks", lambda s: show(ov.bottlenecks(s.metrics)),
    f"""SELECT {SHOW} FROM um WHERE in_degree > {o.nearest('in_degree', 'um', 0.75)}
  AND out_degree < greatest({o.nearest('out_degree', 'um', 0.25)}, 5) ORDER BY in_degree DESC, page_id LIMIT 30""",
    "um", d="pri_score",
)
ORPHANS = "SELECT * FROM um WHERE in_degree <= 2 AND template NOT IN ('homepage', 'dc')"
add("orphan_pages", lambda s: show(ov.orphan_pages(s.metrics)), f"SELECT {SHOW} FROM ({ORPHANS})", "um", d="pri_score")
add(
    "orphans_by_category", lambda s: ov.orphans_by_category(s.metrics),
    f"SELECT category, count(*) AS pages FROM ({ORPHANS}) GROUP BY 1 ORDER BY pages DESC, category NULLS FIRST LIMIT 15", "um",
)
add(
    "underused_donors", lambda s: show(ov.underused_donors(s.metrics)),
    f"SELECT {SHOW} FROM um WHERE can_give_juice AND out_degree < {MEDIAN_OUT} ORDER BY pri_score DESC, page_id LIMIT 30", "um", d="pri_score",
)
COMPARED = "SELECT page_id, um.path AS path, pri_score, in_degree, template, real_clicks, botify_pr FROM um JOIN real ON um.path = real.path WHERE real_clicks IS NOT NULL"


def compared(s: Site) -> DataFrame:
    return ov.rank_vs_clicks(s.metrics, s.real)


add("rank_vs_clicks", compared, COMPARED, "um", "real", d="pri_score botify_pr")
QUAD = f"SELECT *, median(pri_score) OVER () AS mp, median(real_clicks) OVER () AS mc FROM ({COMPARED})"
add(
    "quadrants", lambda s: ov.quadrants(compared(s)),
    f"""SELECT count(*) FILTER (pri_score >= mp AND real_clicks >= mc) AS aligned, count(*) FILTER (pri_score >= mp AND real_clicks < mc) AS over_linked,
  count(*) FILTER (pri_score < mp AND real_clicks >= mc) AS under_linked, count(*) FILTER (pri_score < mp AND real_clicks < mc) AS weak FROM ({QUAD})""",
    "um", "real",
)
add(
    "under_linked_top", lambda s: ov.under_linked_top(compared(s)),
    f"SELECT * EXCLUDE (mp, mc) FROM ({QUAD}) WHERE pri_score < mp AND real_clicks >= mc ORDER BY real_clicks DESC, page_id LIMIT 20",
    "um", "real", d="pri_score botify_pr",
)

# Audit documents.

SECTIONS = [f"{r}-{l}" for r in "ANR" for l in "FO"]
DESTINATIONS = [f"/d{i}/" for i in range(1, 8)]
CELL = "SELECT section, destination, sum(links) / sum(files) AS avg_links FROM cells GROUP BY ALL"


def audits(s: Site) -> DataFrame:
    return au.parse_audit(s.audits)


def anomaly_audits(s: Site) -> DataFrame:
    return au.parse_audit(s.anomaly_documents)


def pivot_sql(rows: str, key: str, column: str, value: str, names: list[str]) -> str:
    picks = ", ".join(f"coalesce(sum({value}) FILTER ({column} = '{n}'), 0) AS \"{n}\"" for n in names)
    return f"SELECT {key}, {picks} FROM ({rows}) GROUP BY {key}"


def quoted(names: list[str]) -> str:
    return " ".join(f'"{n}"' for n in names)


add(
    "section_destination_matrix", lambda s: au.section_destination_matrix(audits(s), DESTINATIONS),
    pivot_sql(CELL, "section", "destination", "avg_links", DESTINATIONS), "cells", d=quoted(DESTINATIONS),
)
PROFILE = """SELECT template, section, destination, links / files AS avg_links FROM cells WHERE section <> 'A-F'
UNION ALL SELECT template, section, '(total)', sum(links) / sum(files) FROM cells WHERE section = 'A-F' GROUP BY ALL"""
add("template_section_profile", lambda s: au.template_section_profile(audits(s)), PROFILE, "cells", d="avg_links")
add(
    "template_section_totals", lambda s: au.template_section_totals(audits(s)),
    f"SELECT template, section, sum(avg_links) AS total FROM ({PROFILE}) GROUP BY ALL", "cells", d="total",
)
HEAT = "SELECT template, section, sum(links) / sum(files) AS links FROM cells GROUP BY ALL"
add(
    "template_section_heatmap", lambda s: au.template_section_heatmap(audits(s), SECTIONS),
    pivot_sql(HEAT, "template", "section", "links", SECTIONS), "cells", d=quoted(SECTIONS),
)
add(
    "anomaly_table", lambda s: au.anomaly_table(anomaly_audits(s), ["HIGH", "MEDIUM"]),
    "SELECT severity, template, count(*) AS count FROM anomalies WHERE severity IN ('HIGH', 'MEDIUM') GROUP BY ALL", "anomalies",
)
add(
    "anomaly_severities", lambda s: au.anomaly_severities(anomaly_audits(s)),
    "SELECT severity, count(*) AS count FROM anomalies GROUP BY ALL", "anomalies",
)
add(
    "ad_outlinks_total", lambda s: au.ad_outlinks_total(audits(s), "promo"),
    f"SELECT sum(links) AS total_outlinks FROM ({HEAT}) WHERE template = 'promo'", "cells", d="total_outlinks",
)
_HAS = ", ".join(
    f"list_has_any(kinds, [{', '.join(repr(n) for n in names)}]) AS \"{kind}\"" for kind, names in au.SCHEMA_KINDS.items()
)
add(
    "schema_checklist", lambda s: au.schema_checklist(audits(s)),
    f"""SELECT template, len(kinds) > 1 AS has_schema, {_HAS}, array_to_string(kinds, ', ') AS schemas_found
FROM (SELECT template, list(kind ORDER BY kind) AS kinds FROM audit_schemas GROUP BY 1)""",
    "audit_schemas",
)

# Verticals.

add(
    "vertical_kpis", lambda s: ve.vertical_kpis(s.metrics, s.real),
    """SELECT count(DISTINCT verticale) AS verticals, count(DISTINCT category) AS categories, count(*) AS pages, sum(pri_score) AS pri_sum,
  (SELECT count(*) FROM real) AS real_pages, (SELECT CAST(sum(real_clicks) AS BIGINT) FROM real) AS clicks FROM um""",
    "um", "real", d="pri_sum",
)
add(
    "vertical_tree", lambda s: ve.vertical_tree(s.metrics),
    """SELECT verticale, category, template, sum(pri_score) AS pri_sum, count(*) AS page_count FROM um
WHERE verticale IS NOT NULL AND category IS NOT NULL GROUP BY ALL HAVING sum(pri_score) > 0""",
    "um", d="pri_sum",
)
add("vertical_ranking", lambda s: ve.vertical_ranking(s.metrics), "SELECT verticale, sum(pri_score) AS pri_sum FROM um GROUP BY 1", "um", d="pri_sum")
_OWNERS = " UNION ALL ".join(
    f"SELECT '{v}' AS verticale, '{name}' AS label" for v, names in ve.EXTERNAL_LABELS.items() for name in names
)
REALV = f"SELECT real.*, verticale FROM real JOIN ({_OWNERS}) ON label = botify_verticale"
add(
    "real_by_vertical", lambda s: ve.real_by_vertical(s.real), REALV, "real", d="botify_pr real_inlinks",
)
add(
    "vertical_detail", lambda s: ve.vertical_detail(s.metrics, s.real),
    f"""SELECT m.*, real_pages, clicks, avg_botify_pr, clicks / real_pages::DOUBLE AS clicks_per_page
FROM (SELECT verticale, count(*) AS pages, sum(pri_score) AS pri_sum, avg(pri_score) AS pri_mean, avg(in_degree) AS avg_in,
  count(*) FILTER (can_give_juice) AS donors, count(*) FILTER (is_low_power) AS low_power,
  sum(pri_score) / (SELECT greatest(sum(pri_score), 1e-12) FROM um) * 100 AS pri_pct FROM um GROUP BY 1) m
LEFT JOIN (SELECT verticale, count(*) AS real_pages, CAST(coalesce(sum(real_clicks), 0) AS BIGINT) AS clicks, avg(botify_pr) AS avg_botify_pr
  FROM ({REALV}) GROUP BY 1) r USING (verticale)""",
    "um", "real", d="pri_sum pri_mean avg_in pri_pct avg_botify_pr clicks_per_page",
)
add(
    "category_table", lambda s: ve.category_table(s.metrics, s.real),
    f"""SELECT m.*, real_pages, clicks, clicks_avg, real_inlinks_avg FROM (
SELECT verticale, category, arg_min(template, {{'n': -n, 't': template}}) AS template_dom, CAST(sum(n) AS BIGINT) AS pages, sum(p) AS pri_sum, sum(p) / sum(n) AS pri_mean,
  sum(i)::DOUBLE / sum(n) AS avg_in, sum(u)::DOUBLE / sum(n) AS avg_out, sum(l)::DOUBLE / sum(n) * 100 AS low_power_pct,
  sum(g)::DOUBLE / sum(n) * 100 AS donor_pct, CAST(sum(f) AS BIGINT) AS orphans
FROM (SELECT verticale, category, template, count(*) AS n, sum(pri_score) AS p, sum(in_degree) AS i, sum(out_degree) AS u,
  count(*) FILTER (is_low_power) AS l, count(*) FILTER (can_give_juice) AS g, count(*) FILTER (in_degree <= 2) AS f
  FROM um WHERE category IS NOT NULL GROUP BY ALL) GROUP BY ALL) m
LEFT JOIN (SELECT verticale, category, count(*) AS real_pages, CAST(coalesce(sum(real_clicks), 0) AS BIGINT) AS clicks, avg(real_clicks) AS clicks_avg,
  avg(real_inlinks) AS real_inlinks_avg FROM ({REALV}) GROUP BY ALL) r USING (verticale, category)""",
    "um", "real", d="pri_sum pri_mean avg_in avg_out low_power_pct donor_pct clicks_avg real_inlinks_avg",
)
add(
    "top_n_by", lambda s: show(ov.top_n_by(s.metrics.where(F.col("verticale") == "_vehicules_"), "in_degree", 20, False, 1)),
    f"SELECT {SHOW} FROM um WHERE verticale = '_vehicules_' AND in_degree >= 1 ORDER BY in_degree, page_id LIMIT 20", "um", d="pri_score",
)
add(
    "vertical_block_mix", lambda s: ve.vertical_block_mix(s.edges, s.metrics),
    "SELECT verticale, block_type, count(*) AS count FROM edges JOIN um ON page_id = source_id GROUP BY ALL", "edges", "um",
)
KEY = "page_id, path, pri_score, in_degree, out_degree"
add(
    "keyword_pages", lambda s: ve.keyword_pages(s.metrics),
    f"""(SELECT 'best' AS board, {KEY} FROM um WHERE template = 'ck' ORDER BY pri_score DESC, page_id LIMIT 10) UNION ALL
(SELECT 'weakest_orphans', {KEY} FROM um WHERE template = 'ck' AND in_degree <= 2 ORDER BY pri_score, page_id LIMIT 10)""",
    "um", d="pri_score",
)
add(
    "keyword_orphans", lambda s: ve.keyword_orphans(s.metrics),
    "SELECT count(*) AS keyword_pages, count(*) FILTER (in_degree <= 2) AS orphans FROM um WHERE template = 'ck'", "um",
)
DRILL = "page_id, path, template, pri_score, rank, in_degree, out_degree"
add(
    "category_drilldown", lambda s: ve.category_drilldown(s.metrics, "brand-17"),
    f"""(SELECT 'most_linked' AS board, {DRILL} FROM um WHERE category = 'brand-17' ORDER BY in_degree DESC, page_id LIMIT 15) UNION ALL
(SELECT 'least_linked', {DRILL} FROM um WHERE category = 'brand-17' AND in_degree >= 1 ORDER BY in_degree, page_id LIMIT 15)""",
    "um", d="pri_score",
)
add(
    "category_profile", lambda s: ve.category_profile(s.metrics, s.real, "brand-17"),
    """SELECT template, count(*) AS pages, sum(pri_score) AS pri_sum, avg(in_degree) AS avg_in, avg(out_degree) AS avg_out,
  count(*) FILTER (is_low_power) AS low_power, (SELECT count(*) FROM real WHERE category = 'brand-17') AS real_pages,
  (SELECT CAST(sum(real_clicks) AS BIGINT) FROM real WHERE category = 'brand-17') AS clicks,
  (SELECT avg(botify_pr) FROM real WHERE category = 'brand-17') AS avg_botify_pr FROM um WHERE category = 'brand-17' GROUP BY 1""",
    "um", "real", d="pri_sum avg_in avg_out avg_botify_pr",
)

# Detail views.

add(
    "segments_by_level", lambda s: marts.top_segments(s.segment_metrics, 2, 30),
    "SELECT * FROM segm WHERE level = 2 ORDER BY page_count DESC, segment_path LIMIT 30", "segm", d=SEGM_D,
)
EXPLORE = ", ".join(se.EXPLORER_COLUMNS)
add(
    "url_explorer", lambda s: se.url_explorer(s.metrics, 1000), f"SELECT {EXPLORE} FROM um ORDER BY pri_score DESC, page_id LIMIT 1000",
    "um", d="pri_score cheirank_score",
)
add(
    "page_neighbors", lambda s: se.page_neighbors(s.edges, s.pages, PAGE),
    f"""SELECT direction, page_id, path, block_type, rule_weight FROM (
(SELECT 'out' AS direction, target_id AS page_id, block_type, rule_weight FROM edges WHERE source_id = {PAGE} ORDER BY rule_weight DESC, target_id, block_type LIMIT 100)
UNION ALL (SELECT 'in', source_id, block_type, rule_weight FROM edges WHERE target_id = {PAGE} ORDER BY rule_weight DESC, source_id, block_type LIMIT 100))
LEFT JOIN (SELECT page_id, path FROM pg) USING (page_id)""",
    "edges", "pg", f="rule_weight",
)


def both_sides(table: str, keys: str) -> str:
    return f"""SELECT 'out' AS direction, {keys}, count(*) AS count FROM {table} WHERE source_id = {PAGE} GROUP BY ALL
UNION ALL SELECT 'in', {keys}, count(*) FROM {table} WHERE target_id = {PAGE} GROUP BY ALL"""


add("page_block_mix", lambda s: se.page_block_mix(s.edges, PAGE), both_sides("edges", "block_type"), "edges")


def anchor_boards(keys: str) -> str:
    return f"""SELECT * FROM ({both_sides('cands', keys)})
QUALIFY row_number() OVER (PARTITION BY direction ORDER BY count DESC, {keys}) <= 100"""


add("page_anchors", lambda s: se.page_anchors(s.candidates, PAGE), anchor_boards("anchor_text, anchor_type"), "cands")
add("anchor_type_mix", lambda s: se.anchor_type_mix(s.candidates), "SELECT anchor_type, count(*) AS count FROM cands GROUP BY 1", "cands")
add(
    "top_anchor_texts", lambda s: se.top_anchor_texts(s.candidates),
    "SELECT anchor_text, count(*) AS count FROM cands GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30", "cands",
)
add(
    "source_anchor_diversity", lambda s: se.source_anchor_diversity(s.candidates),
    """SELECT avg(r) AS mean_lexical_diversity_ratio, median(r) AS median_lexical_diversity_ratio, avg(t) AS mean_unique_anchor_types
FROM (SELECT count(DISTINCT anchor_text)::DOUBLE / count(*) AS r, count(DISTINCT anchor_type) AS t FROM cands GROUP BY source_id)""",
    "cands", d="mean_lexical_diversity_ratio median_lexical_diversity_ratio mean_unique_anchor_types",
)
add(
    "page_anchor_focus", lambda s: se.page_anchors(s.candidates, PAGE, with_block=True),
    anchor_boards("anchor_text, anchor_type, block_type"), "cands",
)
add(
    "cheirank_kpis", lambda s: ov.cheirank_kpis(s.metrics),
    """SELECT sum(cheirank_score) AS cheirank_sum, count(*) FILTER (can_give_juice) AS donors, count(*) FILTER (is_low_power) AS low_power,
  count(*) FILTER (is_low_power)::DOUBLE / count(*) * 100 AS low_power_pct FROM um""",
    "um", d="cheirank_sum low_power_pct",
)
CHEI = "page_id, path, cheirank_score, pri_score, in_degree, out_degree"
add(
    "cheirank_top", lambda s: ov.cheirank_top(s.metrics),
    f"""(SELECT 'cheirank' AS board, {CHEI} FROM um ORDER BY cheirank_score DESC, page_id LIMIT 25) UNION ALL
(SELECT 'donors', {CHEI} FROM um WHERE can_give_juice ORDER BY cheirank_score DESC, page_id LIMIT 30) UNION ALL
(SELECT 'low_power', {CHEI} FROM um WHERE is_low_power ORDER BY pri_score, page_id LIMIT 30)""",
    "um", d="cheirank_score pri_score",
)
MAP = """SELECT page_id, pri_score, cheirank_score, out_degree,
  CASE WHEN can_give_juice THEN 'donor' WHEN is_low_power THEN 'low_power' ELSE 'normal' END AS segment FROM um"""
add(
    "systematic_sample",
    lambda s: ov.systematic_sample(ov.power_map(s.metrics), [F.desc("pri_score"), F.col("page_id")], 500),
    f"""SELECT * EXCLUDE (i, n) FROM (SELECT *, row_number() OVER (ORDER BY pri_score DESC, page_id) - 1 AS i, count(*) OVER () AS n FROM ({MAP}))
WHERE i % CAST(ceil(n / 500.0) AS BIGINT) = 0 QUALIFY row_number() OVER (ORDER BY i) <= 500""",
    "um", d="pri_score cheirank_score",
)
add(
    "random_sample_cap", lambda s: ov.random_sample_cap(compared(s), "page_id", 60),
    f"SELECT * FROM ({COMPARED}) ORDER BY md5(concat('42:', page_id)), page_id LIMIT 60", "um", "real", d="pri_score botify_pr",
)
add(
    "scenario_mix_pivot", lambda s: sv.scenario_mix_pivot(s.scenario_edges),
    "SELECT scenario, " + ", ".join(f"count(*) FILTER (anchor_type = '{t}') AS {t}" for t in fa.ANCHOR_TYPES) + " FROM scen_edges GROUP BY 1",
    "scen_edges",
)
IN_TYPE = "page_id IN (SELECT page_id FROM um WHERE verticale = '_vehicules_')"


def in_type(s: Site) -> DataFrame:
    return s.metrics.where(F.col("verticale") == "_vehicules_")


add(
    "scenario_top_pages", lambda s: sv.scenario_top_pages(s.scenario_pri, s.pages, _NAMES[1], in_type(s)),
    f"""SELECT rank, page_id, path, pri_score, in_degree, out_degree FROM scen_scores JOIN (SELECT page_id, path FROM pg) USING (page_id)
WHERE scenario = '{_NAMES[1]}' AND {IN_TYPE} ORDER BY pri_score DESC, page_id LIMIT 20""",
    "scen_scores", "pg", "um", d="pri_score",
)


def add_delta_views(suffix: str, delta: str) -> None:
    """Boards and figures of one scenario's difference from the first."""
    add(
        f"scenario_gainers_losers{suffix}", lambda s: sv.scenario_gainers_losers(s.comparison, s.pages, delta, in_type(s)),
        f"""WITH x AS (SELECT page_id, path, {delta} AS delta_pri FROM cmp JOIN (SELECT page_id, path FROM pg) USING (page_id) WHERE {IN_TYPE})
(SELECT 'gainers' AS board, * FROM x ORDER BY delta_pri DESC, page_id LIMIT 15) UNION ALL (SELECT 'losers', * FROM x ORDER BY delta_pri, page_id LIMIT 15)""",
        "cmp", "pg", "um", d="delta_pri", decimals=14,
    )
    add(
        f"scenario_delta_stats{suffix}", lambda s: sv.scenario_delta_stats(s.comparison, delta),
        f"SELECT min({delta}) AS min_delta_pri, avg({delta}) AS mean_delta_pri, max({delta}) AS max_delta_pri, median({delta}) AS median_delta_pri FROM cmp",
        "cmp", d="min_delta_pri mean_delta_pri max_delta_pri median_delta_pri", decimals=14,
    )


add_delta_views("", _DELTAS[1])
add_delta_views("_first_change", _DELTAS[0])

add(
    "scenario_page_impact", lambda s: sv.scenario_page_impact(s.comparison, s.pages, PAGE),
    f"SELECT cmp.*, path FROM cmp JOIN (SELECT page_id, path FROM pg) USING (page_id) WHERE page_id = {PAGE}", "cmp", "pg", d=CMP_D, decimals=14,
)

# 2.11 Page expansion.

DRAFT = ", ".join(ex.DRAFT)
add(
    "expand_category_pages", lambda s: ex.expand_category_pages(s.categories, s.static_pages), f"SELECT {DRAFT} FROM x_category", "x_category"
)
add("expand_facet_pages", lambda s: ex.expand_facet_pages(s.facets, EXPANSION), f"SELECT {DRAFT} FROM x_facet", "x_facet")
add("expand_geo_pages", lambda s: ex.expand_geo_pages(s.categories, s.places, s.facets, EXPANSION), f"SELECT {DRAFT} FROM x_geo", "x_geo")
add("expand_keyword_pages", lambda s: ex.expand_keyword_pages(s.keywords), f"SELECT {DRAFT} FROM x_keyword", "x_keyword")
add("expand_hybrid_pages", lambda s: ex.expand_hybrid_pages(s.keywords, s.places, EXPANSION), f"SELECT {DRAFT} FROM x_hybrid", "x_hybrid")
add(
    "expand_finalize", lambda s: s.expanded,
    "SELECT page_id, path, parent_path, depth, section, cluster_thematique, template, is_leaf FROM xp", "xp",
)
add("expand_template_counts", lambda s: ex.template_counts(s.expanded), "SELECT template, count(*) AS count FROM xp GROUP BY 1", "xp")

# 2.12 Reports.

KPIS = """SELECT 'node_count' AS metric, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM scores UNION ALL SELECT 'pri_sum', '', sum(pri_score) FROM scores
UNION ALL SELECT 'cheirank_sum', '', sum(cheirank_score) FROM scores UNION ALL SELECT 'donor_count', '', count(*) FROM scores WHERE can_give_juice
UNION ALL SELECT 'low_power_count', '', count(*) FROM scores WHERE is_low_power UNION ALL SELECT 'page_count', '', count(*) FROM pg
UNION ALL SELECT 'edge_count', '', count(*) FROM edges UNION ALL SELECT 'anchor_candidate_count', '', count(*) FROM cands
UNION ALL (SELECT 'block_type', block_type, count(*) AS c FROM edges GROUP BY block_type ORDER BY c DESC, block_type LIMIT 15)
UNION ALL (SELECT 'anchor_type', anchor_type, count(*) AS c FROM cands GROUP BY anchor_type ORDER BY c DESC, anchor_type LIMIT 15)"""
add("report_kpis", lambda s: rp.report_kpis(s.pages, s.edges, s.scores, s.candidates), KPIS, "pg", "edges", "scores", "cands", d="value")
REPORT = ", ".join(rp.TOP_COLUMNS)
add(
    "report_top_pages", lambda s: rp.report_top_pages(s.scores, s.pages),
    f"SELECT {REPORT} FROM scores JOIN (SELECT page_id, path FROM pg) USING (page_id) ORDER BY pri_score DESC, page_id LIMIT 20",
    "scores", "pg", d="pri_score cheirank_score",
)
add(
    "report_top_segments", lambda s: rp.report_top_segments(s.segment_metrics),
    "SELECT * FROM segm WHERE level = 1 ORDER BY page_count DESC, segment_path LIMIT 20", "segm", d=SEGM_D,
)
add(
    "report_table_counts",
    lambda s: rp.report_table_counts({"pages": s.pages, "edges": s.edges, "pri_scores": s.scores, "url_metrics": s.plain_metrics}),
    """SELECT 'pages' AS "table", count(*) AS row_count FROM pg UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'pri_scores', count(*) FROM scores UNION ALL SELECT 'url_metrics', count(*) FROM plain""",
    "pg", "edges", "scores", "plain",
)
add(
    "report_export_counts",
    lambda s: rp.report_table_counts({name: _report_workspace(s).read(name) for name in [*ws.REQUIRED_TABLES, *ws.OPTIONAL_TABLES, *ws.SCENARIO_TABLES]}),
    """SELECT 'pages' AS "table", count(*) AS row_count FROM pg UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'pri_scores', count(*) FROM scores UNION ALL SELECT 'anchor_candidates', count(*) FROM cands
UNION ALL SELECT 'page_segments', count(*) FROM seg UNION ALL SELECT 'url_metrics', count(*) FROM plain
UNION ALL SELECT 'segment_metrics', count(*) FROM segm UNION ALL SELECT 'scenario_edges', count(*) FROM scen_edges
UNION ALL SELECT 'scenario_pri', count(*) FROM scen_scores UNION ALL SELECT 'scenario_comparison', count(*) FROM cmp""",
    "pg", "edges", "scores", "cands", "seg", "plain", "segm", "scen_edges", "scen_scores", "cmp",
)
add(
    "report_kpis_json",
    lambda s: rp.kpis_as_json(rp.report_kpis(s.pages, s.edges, s.scores, s.candidates).withColumn("value", F.round("value", 6))),
    f"""SELECT CAST(to_json(list(struct_pack(metric := metric, name := name, value := round(value, 6)) ORDER BY metric, name)) AS VARCHAR) AS kpis
FROM ({KPIS})""",
    "pg", "edges", "scores", "cands",
)
BEST = "page_id, path, pri_score, rank, cheirank_score, cheirank_rank"
add(
    "filtered_top_pages", lambda s: se.top_pages(selected(s), 20).select(*BEST.split(", ")), f"SELECT {BEST} FROM ({SELECTED}) ORDER BY pri_score DESC, page_id LIMIT 20",
    *SELECTED_NEEDS, d="pri_score cheirank_score",
)
# the selected page is the selection's first one here
add(
    "filtered_page", lambda s: se.selected_page(selected(s), selected(s).agg(F.min("page_id")).scalar()),
    f"WITH f AS ({SELECTED}) SELECT * FROM f WHERE page_id = (SELECT min(page_id) FROM f)", *SELECTED_NEEDS, d=UM_D,
)


def callable_for(key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = QUERIES[key]
        return comparable(query.run(site_of(spark, sf_dir)), query.decimals)

    return run
