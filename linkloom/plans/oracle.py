"""DuckDB forms of the stage tables, as CTEs, to check the Spark results against."""

from __future__ import annotations

import math

from linkloom.functions.anchors import GENERIC_PHRASES
from linkloom.functions.links import TRUE_WORDS, expand_templates
from linkloom.operators.anchors import SCENARIOS
from linkloom.plans import inputs
from linkloom.plans.site import BLOCKS, RANK

SPACE = "\\s"  # the given tables only hold ASCII white space


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def cut(x: str) -> str:
    return f"regexp_replace({strip(f'coalesce({x}, chr(32))')}, '[?#].*$', '')"


def host(x: str) -> str:
    return f"regexp_replace(lower(nullif(regexp_extract({cut(x)}, '(?i)^https?://([^/:?#]+)', 1), '')), '^www\\.', '')"


def path(x: str) -> str:
    tail = f"regexp_extract({cut(x)}, '(?i)^https?://[^/:?#]+([^?#]*)$', 1)"
    return f"coalesce(nullif(regexp_replace(regexp_replace({tail}, '/{{2,}}', '/', 'g'), '/+$', ''), ''), '/')"


def block(x: str) -> str:
    slug = f"regexp_replace(lower({strip(f'coalesce({x}, chr(32))')}), '[^a-z0-9]+', '_', 'g')"
    return f"coalesce(nullif(trim({slug}, '_'), ''), 'unknown')"


def boolean(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in TRUE_WORDS)
    return f"(lower({strip(f'coalesce({x}, chr(32))')}) IN ({words}))"


def title(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')"
    return f"coalesce(array_to_string(list_transform({runs}, lambda r: concat(upper(r[1]), r[2:])), ''), '')"


def label(x: str) -> str:
    pieces = f"string_split(regexp_replace(coalesce({x}, ''), '/$', ''), '/')"
    slug = f"(CASE WHEN {pieces}[-1] = '_meta' THEN coalesce({pieces}[-2], 'destination') ELSE {pieces}[-1] END)"
    return title(f"replace(replace({slug}, '-', ' '), '_', ' ')")


def coalesced(anchor: str, alt: str, target: str) -> str:
    return f"coalesce(nullif({strip(anchor)}, ''), nullif({strip(alt)}, ''), {label(target)})"


def lexical(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def anchor_type(anchor: str, lab: str) -> str:
    """Both arguments in lexical normal form."""
    generic = ", ".join(f"'{g}'" for g in GENERIC_PHRASES)
    return (
        f"CASE WHEN {anchor} = '' OR {anchor} IN ({generic}) THEN 'generic' WHEN {anchor} = {lab} THEN 'exact' "
        f"WHEN (starts_with({anchor}, {lab}) OR ends_with({anchor}, {lab}) OR starts_with({lab}, {anchor})) "
        f"AND length({anchor}) >= 3 AND length({lab}) >= 3 THEN 'partial' ELSE 'contextual' END"
    )


def tokens(x: str) -> str:
    return f"CAST(len(string_split({x}, ' ')) AS INTEGER)"


def selector(source: str = "source_id", target: str = "target_id", block_type: str = "block_type") -> str:
    key = f"concat({source}, ':', {target}, ':', {block_type})"
    return f"(CAST(concat('0x', substring(md5({key}), 1, 8)) AS BIGINT) % 10000) / 10000.0::DOUBLE"


def parent(x: str) -> str:
    up = f"regexp_replace({x}, '/[^/]+$', '')"
    return f"CASE WHEN {x} = '/' THEN NULL ELSE coalesce(nullif({up}, ''), '/') END"


def pieces(x: str) -> str:
    return f"string_split(regexp_replace({x}, '^/', ''), '/')"


def depth(x: str) -> str:
    return f"CAST(CASE WHEN {x} = '/' THEN 0 ELSE len({pieces(x)}) END AS INTEGER)"


def section(x: str) -> str:
    return f"CASE WHEN {x} = '/' THEN 'root' ELSE {pieces(x)}[1] END"


def cluster(x: str) -> str:
    return f"concat({section(x)}, ':', coalesce({pieces(x)}[2], '__root__'))"


def segment_pieces(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({strip(x)}, '(?s)#.*$', ''), '(?s)\\?.*$', '')"
    return f"list_filter(string_split({bare}, '/'), lambda p: p <> '')"


def nearest(value: str, table: str, fraction: float, where: str = "TRUE") -> str:
    """Scalar subquery: nearest order statistic."""
    return (
        f"(SELECT v FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS n "
        f"FROM {table} WHERE ({where}) AND {value} IS NOT NULL) WHERE i = CAST(floor({fraction}::DOUBLE * (n - 1) + 0.5) AS BIGINT))"
    )


WEIGHT = (
    "CAST(CASE block_type WHEN 'content' THEN 1.0 WHEN 'navigation' THEN 0.9 WHEN 'footer' THEN 0.45 "
    "WHEN 'head' THEN 0.25 ELSE 0.6 END AS FLOAT)"
)

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, list(needs))


def given(sql: str) -> str:
    return sql.format(**{name: name for name in inputs.TABLES})


for _name, _sql in {
    "raw": inputs.CRAWL_LINKS,
    "real": inputs.REAL_METRICS,
    "verticals": inputs.CATEGORY_VERTICALS,
    "categories": inputs.CATEGORIES,
    "facets": inputs.FACETS,
    "keywords": inputs.KEYWORDS,
    "places": inputs.PLACES,
    "static_pages": inputs.STATIC_PAGES,
    "tree_pieces": inputs.TREE_PIECES,
    "cells": inputs.AUDIT_CELLS,
    "audit_schemas": inputs.AUDIT_SCHEMAS,
    "anomalies": inputs.AUDIT_ANOMALIES,
}.items():
    cte(_name, given(_sql))

cte(
    "norm",
    f"""SELECT lower({strip("coalesce(type, '')")}) AS link_type, {host('from_url')} AS from_host, {host('to_url')} AS to_host,
  {path('from_url')} AS from_path, {path('to_url')} AS to_path, {block('link_position')} AS block_type,
  {boolean('follow')} AS is_follow, TRY_CAST(status_code AS INTEGER) AS status_code,
  {coalesced('anchor_text', 'alt_text', path('to_url'))} AS anchor_text FROM raw""",
    "raw",
)
cte(
    "src",
    "SELECT from_host, count(*) AS link_count FROM norm WHERE from_host IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "norm",
)
cte(
    "internal",
    """SELECT from_path, to_path, block_type, anchor_text FROM norm
  WHERE link_type = 'hyperlink' AND from_host = (SELECT from_host FROM src) AND to_host = (SELECT from_host FROM src)
  AND is_follow AND status_code = 200 AND from_path <> to_path""",
    "norm",
    "src",
)
cte(
    "pg",
    f"""SELECT CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS page_id, path, {parent('path')} AS parent_path,
  {depth('path')} AS depth, {section('path')} AS section, {cluster('path')} AS cluster_thematique,
  path NOT IN (SELECT from_path FROM internal) AS is_leaf
  FROM (SELECT from_path AS path FROM internal UNION SELECT to_path FROM internal)""",
    "internal",
)
cte(
    "ident",
    f"""SELECT s.page_id AS source_id, t.page_id AS target_id, block_type, {WEIGHT} AS base_weight, anchor_text, to_path
  FROM internal JOIN pg s ON s.path = from_path JOIN pg t ON t.path = to_path""",
    "internal",
    "pg",
)
cte(
    "edges_all",
    "SELECT source_id, target_id, block_type, CAST(sum(CAST(base_weight AS DOUBLE)) AS FLOAT) AS rule_weight FROM ident GROUP BY ALL",
    "ident",
)
cte(
    "edges",
    """SELECT * FROM edges_all QUALIFY row_number() OVER
  (PARTITION BY source_id ORDER BY rule_weight DESC, target_id, block_type) <= 120""",
    "edges_all",
)
cte(
    "texts",
    f"""SELECT source_id, target_id, block_type, anchor_type, anchor_text, count(*) AS anchor_instances,
  max(base_weight) AS rule_weight, {tokens('anchor_text')} AS anchor_token_count
  FROM (SELECT *, {anchor_type('a', 'l')} AS anchor_type
    FROM (SELECT *, {lexical('anchor_text')} AS a, {lexical(label('to_path'))} AS l FROM ident)) GROUP BY ALL""",
    "ident",
)
cte(
    "top_texts",
    """SELECT * FROM texts QUALIFY row_number() OVER
  (PARTITION BY source_id, target_id, block_type, anchor_type ORDER BY anchor_instances DESC, anchor_text) = 1""",
    "texts",
)
cte(
    "cands",
    """SELECT source_id, target_id, block_type, rule_weight, anchor_type, anchor_text, anchor_token_count
  FROM top_texts SEMI JOIN edges USING (source_id, target_id, block_type)""",
    "top_texts",
    "edges",
)
cte("ppg", f"SELECT *, {inputs.TEMPLATE_OF_PAGE} AS template FROM pg", "pg")


#: Steps of plain power iteration: 0.85 to this power is far below the grid of the scores.
POWER_STEPS = 190


def add_rank(prefix: str, links: str, *needs: str) -> None:
    """CTE ``<prefix>_rank(graph, page_id, score)`` from links(graph, source, target, weight).

    Plain power iteration from the uniform vector, with teleport and with the rank of dead ends spread evenly.
    A dead end is a row to the null page, and every page has a row of share 0 to itself, so that pages without links stay.
    """
    d = RANK.damping
    cte(f"{prefix}_m", f"SELECT graph, source, target, sum(weight) AS weight FROM ({links}) GROUP BY ALL", *needs)
    cte(
        f"{prefix}_w",
        f"""SELECT graph, source, target, weight / total AS share FROM {prefix}_m
  JOIN (SELECT graph, source, sum(weight) AS total FROM {prefix}_m GROUP BY ALL) USING (graph, source) WHERE total > 0""",
        f"{prefix}_m",
    )
    cte(f"{prefix}_nodes", f"SELECT graph, page_id FROM pg, (SELECT DISTINCT graph FROM {prefix}_m)", "pg", f"{prefix}_m")
    cte(
        f"{prefix}_all",
        f"""SELECT graph, source, target, share FROM {prefix}_w
UNION ALL SELECT graph, page_id, NULL, 1.0::DOUBLE FROM {prefix}_nodes ANTI JOIN (SELECT graph, source AS page_id FROM {prefix}_w) USING (graph, page_id)
UNION ALL SELECT graph, page_id, page_id, 0.0::DOUBLE FROM {prefix}_nodes""",
        f"{prefix}_w",
        f"{prefix}_nodes",
    )
    cte(
        f"{prefix}_rank",
        f"""WITH RECURSIVE size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pg),
steps AS (
  SELECT 0 AS step, graph, page_id, 1.0::DOUBLE / n AS score FROM {prefix}_nodes, size
  UNION ALL
  SELECT step, graph, target, {1 - d!r}::DOUBLE / n + {d!r}::DOUBLE * (flow + coalesce(dead, 0) / n) FROM (
    SELECT step, graph, target, flow, max(CASE WHEN target IS NULL THEN flow END) OVER (PARTITION BY graph) AS dead FROM (
      SELECT s.step + 1 AS step, s.graph, a.target, sum(s.score * a.share) AS flow
      FROM steps s JOIN {prefix}_all a ON a.graph = s.graph AND a.source = s.page_id WHERE s.step < {POWER_STEPS}
      GROUP BY s.step, s.graph, a.target)), size WHERE target IS NOT NULL)
SELECT graph, page_id, round(score * n, 8) / n AS score FROM steps, size WHERE step = {POWER_STEPS}""",
        "pg",
        f"{prefix}_nodes",
        f"{prefix}_all",
    )


def _scores(prefix: str, edges: str) -> str:
    """SQL for (variant + pri_scores columns); graphs are named 'pri <variant>' and 'chei <variant>'."""
    low = "CAST(floor(0.1::DOUBLE * (n - 1) + 0.5) AS BIGINT)"
    high = "CAST(floor(0.9::DOUBLE * (n - 1) + 0.5) AS BIGINT)"
    return f"""SELECT variant, page_id, pri_score, rank, cheirank_score, cheirank_rank, juice_potential_score, out_degree, in_degree,
  pri_score <= max(CASE WHEN rank = n - {low} THEN pri_score END) OVER (PARTITION BY variant) AS is_low_power,
  juice_potential_score >= max(CASE WHEN j = {high} THEN juice_potential_score END) OVER (PARTITION BY variant) AS can_give_juice
FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY juice_potential_score) - 1 AS j, count(*) OVER (PARTITION BY variant) AS n
FROM (SELECT variant, page_id, pri_score, CAST(row_number() OVER (PARTITION BY variant ORDER BY pri_score DESC, page_id) AS INTEGER) AS rank,
  cheirank_score, CAST(row_number() OVER (PARTITION BY variant ORDER BY cheirank_score DESC, page_id) AS INTEGER) AS cheirank_rank,
  cheirank_score * ln(CAST(coalesce(o, 0) AS DOUBLE) + 1) AS juice_potential_score,
  CAST(coalesce(o, 0) AS INTEGER) AS out_degree, CAST(coalesce(i, 0) AS INTEGER) AS in_degree
FROM (SELECT regexp_replace(graph, '^(pri|chei) ', '') AS variant, page_id,
    max(CASE WHEN graph LIKE 'pri %' THEN score END) AS pri_score, max(CASE WHEN graph LIKE 'chei %' THEN score END) AS cheirank_score
    FROM {prefix}_rank GROUP BY ALL)
LEFT JOIN (SELECT variant, source_id AS page_id, count(*) AS o FROM ({edges}) GROUP BY ALL) USING (variant, page_id)
LEFT JOIN (SELECT variant, target_id AS page_id, count(*) AS i FROM ({edges}) GROUP BY ALL) USING (variant, page_id)))"""


def both_ways(edges: str, weight: str = "CAST(rule_weight AS DOUBLE)") -> str:
    return (
        f"SELECT concat('pri ', variant) AS graph, source_id AS source, target_id AS target, {weight} AS weight FROM ({edges}) "
        f"UNION ALL SELECT concat('chei ', variant), target_id, source_id, {weight} FROM ({edges})"
    )


SITE_EDGES = "SELECT 'site' AS variant, * FROM edges"
add_rank("site", both_ways(SITE_EDGES), "edges")
cte("scores", f"SELECT * EXCLUDE (variant) FROM ({_scores('site', SITE_EDGES)})", "site_rank", "edges")

cte(
    "stats",
    """SELECT page_id, CAST(coalesce(ol, 0) AS INTEGER) AS outgoing_links, coalesce(ow, 0) AS outgoing_weight,
  CAST(coalesce(ou, 0) AS INTEGER) AS unique_out_targets, CAST(coalesce(il, 0) AS INTEGER) AS incoming_links,
  coalesce(iw, 0) AS incoming_weight, CAST(coalesce(iu, 0) AS INTEGER) AS unique_in_sources FROM pg
LEFT JOIN (SELECT source_id AS page_id, count(*) AS ol, sum(CAST(rule_weight AS DOUBLE)) AS ow, count(DISTINCT target_id) AS ou
  FROM edges GROUP BY 1) USING (page_id)
LEFT JOIN (SELECT target_id AS page_id, count(*) AS il, sum(CAST(rule_weight AS DOUBLE)) AS iw, count(DISTINCT source_id) AS iu
  FROM edges GROUP BY 1) USING (page_id)""",
    "pg",
    "edges",
)
cte(
    "astats",
    """SELECT source_id AS page_id, CAST(count(DISTINCT anchor_text) AS INTEGER) AS unique_anchor_texts_out,
  CAST(count(DISTINCT anchor_type) AS INTEGER) AS unique_anchor_types_out FROM cands GROUP BY 1""",
    "cands",
)
cte(
    "plain",
    """SELECT page_id, path, depth, pri_score, rank, cheirank_score, cheirank_rank, in_degree, out_degree, can_give_juice, is_low_power,
  incoming_links, outgoing_links, incoming_weight, outgoing_weight, unique_out_targets, unique_in_sources,
  coalesce(unique_anchor_texts_out, 0) AS unique_anchor_texts_out, coalesce(unique_anchor_types_out, 0) AS unique_anchor_types_out,
  coalesce(unique_anchor_texts_out, 0)::DOUBLE / greatest(outgoing_links, 1) AS lexical_diversity_out
FROM pg JOIN scores USING (page_id) JOIN stats USING (page_id) LEFT JOIN astats USING (page_id)""",
    "pg",
    "scores",
    "stats",
    "astats",
)
cte(
    "um",
    """SELECT plain.*, template, x.category, coalesce(verticale, '_autre_') AS verticale FROM plain
JOIN (SELECT page_id, template, nullif(regexp_extract(cluster_thematique, ':(.+)$', 1), '') AS category FROM ppg) x USING (page_id)
LEFT JOIN verticals ON verticals.category = x.category""",
    "plain",
    "ppg",
    "verticals",
)
cte(
    "seg",
    f"""SELECT page_id, CAST(0 AS INTEGER) AS level, 'root' AS segment, '/' AS segment_path, CAST(NULL AS VARCHAR) AS parent_segment_path,
  depth, len(p) = 0 AS is_terminal FROM (SELECT *, {segment_pieces('path')} AS p FROM pg)
UNION ALL SELECT page_id, CAST(i AS INTEGER), p[i], concat('/', array_to_string(p[1:i], '/')),
  CASE WHEN i = 1 THEN '/' ELSE concat('/', array_to_string(p[1:i-1], '/')) END, depth, i = len(p)
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, {segment_pieces('path')} AS p FROM pg))""",
    "pg",
)
cte(
    "segm",
    """SELECT level, segment_path, segment, CAST(count(*) AS INTEGER) AS page_count, sum(pri_score) AS pri_sum, avg(pri_score) AS pri_mean,
  sum(cheirank_score) AS cheirank_sum, avg(cheirank_score) AS cheirank_mean, avg(CAST(can_give_juice AS DOUBLE)) AS donor_ratio,
  avg(CAST(is_low_power AS DOUBLE)) AS low_power_ratio, avg(in_degree) AS avg_in_degree, avg(out_degree) AS avg_out_degree,
  avg(lexical_diversity_out) AS avg_lexical_diversity_out FROM seg JOIN plain USING (page_id) GROUP BY ALL""",
    "seg",
    "plain",
)
cte(
    "scenarios",
    " UNION ALL ".join(
        f"SELECT '{s.name}' AS scenario, {s.exact!r}::DOUBLE AS e, {s.exact + s.partial!r}::DOUBLE AS p, "
        f"{s.exact + s.partial + s.contextual!r}::DOUBLE AS c, {s.alpha!r}::DOUBLE AS alpha"
        for s in SCENARIOS
    ),
)
cte("base_edges", "SELECT DISTINCT source_id, target_id, block_type, rule_weight FROM cands", "cands")
cte(
    "selected",
    f"""SELECT scenario, alpha, source_id, target_id, block_type, d.rule_weight, anchor_type, coalesce(anchor_text, 'En savoir plus') AS anchor_text
FROM (SELECT *, CASE WHEN h < e THEN 'exact' WHEN h < p THEN 'partial' WHEN h < c THEN 'contextual' ELSE 'generic' END AS anchor_type
  FROM (SELECT *, {selector()} AS h FROM base_edges), scenarios) d
LEFT JOIN (SELECT source_id, target_id, block_type, anchor_type, anchor_text FROM cands) USING (source_id, target_id, block_type, anchor_type)""",
    "base_edges",
    "scenarios",
    "cands",
)
_ENTROPY = " + ".join(
    f"CASE WHEN n{i} > 0 THEN -(n{i}::DOUBLE / n) * ln(n{i}::DOUBLE / n) ELSE 0 END" for i in range(4)
)
cte(
    "diversity",
    f"""SELECT *, CAST(lexical_diversity_ratio * 0.5::DOUBLE + anchor_type_entropy_norm * 0.5::DOUBLE AS FLOAT) AS anchor_diversity_score FROM (
SELECT scenario, source_id, CAST(t::DOUBLE / n AS FLOAT) AS lexical_diversity_ratio,
  CAST(({_ENTROPY}) / {math.log(4)!r}::DOUBLE AS FLOAT) AS anchor_type_entropy_norm FROM (
SELECT scenario, source_id, count(*) AS n, count(DISTINCT anchor_text) AS t, count(*) FILTER (anchor_type = 'exact') AS n0,
  count(*) FILTER (anchor_type = 'partial') AS n1, count(*) FILTER (anchor_type = 'contextual') AS n2,
  count(*) FILTER (anchor_type = 'generic') AS n3 FROM selected GROUP BY ALL))""",
    "selected",
)
cte(
    "scen_edges",
    """SELECT scenario, source_id, target_id, block_type,
  CAST(CAST(rule_weight AS DOUBLE) * (1 + CAST(anchor_diversity_score AS DOUBLE) * alpha) AS FLOAT) AS rule_weight,
  anchor_type, anchor_text, anchor_diversity_score FROM selected JOIN diversity USING (scenario, source_id)""",
    "selected",
    "diversity",
)
SCENARIO_EDGES = "SELECT scenario AS variant, source_id, target_id, rule_weight FROM scen_edges"
add_rank("scen", both_ways(SCENARIO_EDGES), "scen_edges")
cte("scen_scores", f"SELECT variant AS scenario, * EXCLUDE (variant) FROM ({_scores('scen', SCENARIO_EDGES)})", "scen_rank", "scen_edges")
_A, _B, _C = [s.name for s in SCENARIOS]
cte(
    "cmp",
    f"""SELECT page_id, pri_{_A}, pri_{_B}, pri_{_C}, pri_{_B} - pri_{_A} AS delta_{_B}_vs_{_A}, pri_{_C} - pri_{_A} AS delta_{_C}_vs_{_A}
FROM (SELECT page_id, """
    + ", ".join(f"max(pri_score) FILTER (scenario = '{s.name}') AS pri_{s.name}" for s in SCENARIOS)
    + " FROM scen_scores GROUP BY 1)",
    "scen_scores",
)

# URL tree pages: every prefix of region / nation / customer / {_meta, segment}.
cte(
    "tree_nodes",
    """WITH keyed AS (SELECT *, concat(nation_key, '/') AS n2, concat(customer_key, '/') AS c2 FROM tree_pieces)
SELECT path, parent_path, CAST(d AS INTEGER) AS depth, section, cluster_thematique, is_leaf FROM (
SELECT region_key AS path, CAST(NULL AS VARCHAR) AS parent_path, 1 AS d, false AS is_leaf, region_key, nation_key FROM keyed
UNION ALL SELECT concat(region_key, n2), region_key, 2, false, region_key, nation_key FROM keyed
UNION ALL SELECT concat(region_key, n2, c2), concat(region_key, n2), 3, false, region_key, nation_key FROM keyed
UNION ALL SELECT concat(region_key, n2, c2, '_meta'), concat(region_key, n2, c2), 4, true, region_key, nation_key FROM keyed
UNION ALL SELECT concat(region_key, n2, c2, segment_key), concat(region_key, n2, c2), 4, true, region_key, nation_key FROM keyed),
LATERAL (SELECT replace(region_key, '/', '') AS section,
  concat(replace(region_key, '/', ''), ':', CASE WHEN d = 1 THEN '__root__' ELSE nation_key END) AS cluster_thematique)""",
    "tree_pieces",
)
cte(
    "tp",
    """SELECT CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS page_id, * FROM
  (SELECT path, parent_path, depth, section, cluster_thematique, min(is_leaf) AS is_leaf FROM tree_nodes GROUP BY ALL)""",
    "tree_nodes",
)


def add_rules(prefix: str, pages: str) -> None:
    cte(
        f"{prefix}_pairs",
        f"""SELECT c.page_id AS child_id, p.page_id AS parent_id FROM {pages} c JOIN {pages} p ON c.parent_path = p.path""",
        pages,
    )
    cte(f"{prefix}_up", f"SELECT child_id AS source_id, parent_id AS target_id, 'hierarchy_up' AS block_type, CAST(1.0 AS FLOAT) AS rule_weight FROM {prefix}_pairs", f"{prefix}_pairs")
    cte(f"{prefix}_down", f"SELECT parent_id AS source_id, child_id AS target_id, 'hierarchy_down' AS block_type, CAST(0.7 AS FLOAT) AS rule_weight FROM {prefix}_pairs", f"{prefix}_pairs")
    cte(
        f"{prefix}_peer",
        f"""WITH r AS (SELECT page_id, cluster_thematique, row_number() OVER (PARTITION BY cluster_thematique ORDER BY page_id) AS n FROM {pages})
SELECT a.page_id AS source_id, b.page_id AS target_id, 'cluster_peer' AS block_type, CAST(0.4 AS FLOAT) AS rule_weight
FROM (SELECT *, unnest(range(1, 9)) AS step FROM r) a JOIN r b ON a.cluster_thematique = b.cluster_thematique AND b.n = a.n + a.step""",
        pages,
    )


add_rules("tree", "tp")
cte(
    "tree_dedup",
    """SELECT source_id, target_id, arg_min(block_type, k) AS block_type, CAST(sum(CAST(rule_weight AS DOUBLE)) AS FLOAT) AS rule_weight,
  CAST(min(priority) AS TINYINT) AS priority
FROM (SELECT *, concat(priority, block_type) AS k FROM (SELECT *, CASE block_type WHEN 'hierarchy_up' THEN 0 WHEN 'hierarchy_down' THEN 1 ELSE 2 END AS priority
FROM (SELECT * FROM tree_up UNION ALL SELECT * FROM tree_down UNION ALL SELECT * FROM tree_peer) WHERE source_id <> target_id))
GROUP BY source_id, target_id""",
    "tree_up",
    "tree_down",
    "tree_peer",
)
cte(
    "tree_edges",
    """SELECT source_id, target_id, block_type, rule_weight FROM tree_dedup QUALIFY row_number() OVER
  (PARTITION BY source_id ORDER BY priority, rule_weight DESC, target_id) <= 40""",
    "tree_dedup",
)

# Expanded pages.
cte(
    "x_category",
    """SELECT path, parent_path, template, cluster_thematique FROM static_pages
UNION ALL SELECT DISTINCT concat('/c/', coalesce(verticale, '_services_')), '/', 'c_L0', concat('c:', coalesce(verticale, '_services_')) FROM categories
UNION ALL SELECT concat('/c/', category), concat('/c/', coalesce(verticale, '_services_')), 'c_L1', concat('c:', category) FROM categories""",
    "static_pages",
    "categories",
)
cte(
    "x_facet",
    """SELECT concat('/c/', category, '/', facet, ':', value) AS path, concat('/c/', category) AS parent_path, 'c_L2' AS template,
  concat('c:', category) AS cluster_thematique FROM facets
UNION ALL SELECT concat('/c/', a.category, '/', a.facet, ':', a.value, '+', b.facet, ':', b.value),
  concat('/c/', a.category, '/', a.facet, ':', a.value), 'c_L3', concat('c:', a.category)
FROM facets a JOIN facets b ON a.category = b.category AND a.facet <> b.facet""",
    "facets",
)
cte(
    "x_geo",
    """SELECT concat('/cl/', category, '/', CASE kind WHEN 'region' THEN concat('rp_', place) WHEN 'department' THEN concat('dp_', place)
    ELSE concat('cp_', place, '_', code) END) AS path,
  concat('/c/', category) AS parent_path, 'cl' AS template, concat('cl:', category) AS cluster_thematique
FROM (SELECT DISTINCT category FROM categories), places
UNION ALL SELECT concat('/cl/', category, '/rp_', place, '/', facet, ':', value), concat('/cl/', category, '/rp_', place), 'cl', concat('cl:', category)
FROM facets, places WHERE kind = 'region'""",
    "categories",
    "places",
    "facets",
)
cte(
    "x_keyword",
    """SELECT DISTINCT concat('/ck/', category, '/', keyword) AS path, concat('/c/', category) AS parent_path, 'ck' AS template,
  concat('ck:', category) AS cluster_thematique FROM keywords""",
    "keywords",
)
cte(
    "x_hybrid",
    """SELECT concat('/ckl/', category, '/', keyword, '/cp_', place, '_', code, '/', facet, ':', value) AS path,
  concat('/ck/', category, '/', keyword) AS parent_path, 'ckl' AS template, concat('ckl:', category) AS cluster_thematique
FROM keywords, places WHERE kind = 'region'""",
    "keywords",
    "places",
)
cte(
    "xp",
    """SELECT CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS page_id, path, parent_path,
  CAST(len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS INTEGER) AS depth,
  coalesce(nullif(string_split(path, '/')[2], ''), 'root') AS section, cluster_thematique, template, true AS is_leaf
FROM (SELECT path, m.template AS template, m.parent_path AS parent_path, m.cluster_thematique AS cluster_thematique FROM
  (SELECT path, min({'template': template, 'parent_path': parent_path, 'cluster_thematique': cluster_thematique}) AS m FROM
    (FROM x_category UNION ALL FROM x_facet UNION ALL FROM x_geo UNION ALL FROM x_keyword UNION ALL FROM x_hybrid) GROUP BY path))""",
    "x_category",
    "x_facet",
    "x_geo",
    "x_keyword",
    "x_hybrid",
)
add_rules("exp", "xp")


def present(aliases: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in expand_templates(aliases))


def category_block(name: str, is_target: str) -> str:
    b = BLOCKS.blocks[name]
    return f"""SELECT s.page_id AS source_id, t.page_id AS target_id, '{name}' AS block_type, CAST({b.weight} AS FLOAT) AS rule_weight
FROM (SELECT page_id, string_split(cluster_thematique, ':')[-1] AS cat FROM xp WHERE template IN ({present(b.present_on)})) s
JOIN (SELECT page_id, string_split(cluster_thematique, ':')[-1] AS cat FROM xp WHERE {is_target}
  QUALIFY row_number() OVER (PARTITION BY string_split(cluster_thematique, ':')[-1] ORDER BY page_id) <= {b.max_links}) t USING (cat)"""


_REGION = "template = 'cl' AND contains(path, '/rp_')"
cte("b_facets", category_block("seo_top_filters", "template IN ('c_L2', 'c_L3')"), "xp")
cte("b_searches", category_block("top_searches", "template = 'ck'"), "xp")
cte("b_locations", category_block("top_locations", _REGION), "xp")
cte("b_cross", category_block("box_top_filters", _REGION), "xp")
cte(
    "b_breadcrumb",
    f"""SELECT c.page_id AS source_id, p.page_id AS target_id, 'breadcrumb' AS block_type, CAST(1.0 AS FLOAT) AS rule_weight
FROM xp c JOIN xp p ON c.parent_path = p.path WHERE c.template IN ({present(BLOCKS.blocks['breadcrumb'].present_on)})""",
    "xp",
)
cte(
    "b_footer",
    """SELECT s.page_id AS source_id, t.page_id AS target_id, 'footer_corporate' AS block_type, CAST(0.15 AS FLOAT) AS rule_weight
FROM xp s, (SELECT page_id FROM xp WHERE template IN ('dc', 'c_L0', 'c_L1') ORDER BY page_id LIMIT 20) t WHERE s.page_id <> t.page_id""",
    "xp",
)
cte(
    "b_edges",
    """SELECT source_id, target_id, block_type, CAST(w AS FLOAT) AS rule_weight FROM (
SELECT source_id, target_id, CAST(sum(CAST(rule_weight AS DOUBLE)) AS FLOAT) AS w, arg_min(block_type, {'w': -rule_weight, 'b': block_type}) AS block_type
FROM (FROM b_breadcrumb UNION ALL FROM b_facets UNION ALL FROM b_searches UNION ALL FROM b_locations UNION ALL FROM b_cross
  UNION ALL FROM b_footer UNION ALL FROM exp_up UNION ALL FROM exp_down UNION ALL FROM exp_peer)
WHERE source_id <> target_id GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY w DESC, target_id) <= 60""",
    "b_breadcrumb",
    "b_facets",
    "b_searches",
    "b_locations",
    "b_cross",
    "b_footer",
    "exp_up",
    "exp_down",
    "exp_peer",
)


def build(sql: str, *needs: str) -> str:
    """One statement: the needed CTEs in order, then the query."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][1]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return sql
    parts = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][0]})" for name in order)
    return f"WITH {parts}\n{sql}"
