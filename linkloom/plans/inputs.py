"""Site data derived from the given tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a given table (or another input of this module).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
]

# A crawl of a shop: supplier pages, part pages under /type/brand, listings and a home page.
# Every line item is a link between its supplier and its part; parts link to their listings
# and back. URL spelling, anchors, positions and status codes vary the way crawls do.
CRAWL_LINKS = """
WITH item AS (
  SELECT l_linenumber, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity, p_name, p_brand,
    CAST(l_suppkey AS STRING) AS supp, CAST(p_partkey AS STRING) AS part,
    concat('https://www.shop.example.com/supplier/', CAST(l_suppkey AS STRING)) AS supplier_url,
    concat('/', lower(p_type), '/', replace(lower(p_brand), '#', '-'), '/', CAST(p_partkey AS STRING)) AS part_path
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
),
spelled AS (
  SELECT *, CASE l_returnflag
    WHEN 'A' THEN concat('HTTPS://WWW.Shop.Example.com/', part_path, '/?ref=', CAST(l_linenumber AS STRING))
    WHEN 'R' THEN concat(' https://shop.example.com', part_path, '/ ')
    ELSE concat('https://www.shop.example.com', part_path, '#reviews') END AS part_url
  FROM item
),
listing AS (
  SELECT p_name, p_brand, p_type, CAST(p_partkey AS STRING) AS part,
    'https://www.shop.example.com/' AS home_url,
    concat('https://www.shop.example.com/', lower(p_type)) AS type_url,
    concat('https://www.shop.example.com/', lower(p_type), '/', replace(lower(p_brand), '#', '-')) AS brand_url,
    concat('https://www.shop.example.com/', lower(p_type), '/', replace(lower(p_brand), '#', '-'), '/',
           CAST(p_partkey AS STRING)) AS part_url
  FROM {part}
)
SELECT CASE WHEN l_tax > 0.075 THEN 'Image' ELSE ' HyperLink' END AS type,
  CASE WHEN l_linestatus = 'F' THEN supplier_url ELSE part_url END AS from_url,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN concat('https://www.partner.example.org/', supp)
       WHEN l_linestatus = 'F' THEN part_url ELSE supplier_url END AS to_url,
  CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'En savoir plus'
       WHEN 4 THEN concat('  ', p_name, ' ', CASE WHEN l_linestatus = 'F' THEN part ELSE supp END, ' ')
       WHEN 5 THEN p_name WHEN 6 THEN 'Découvrir !' ELSE concat('Offre ', p_brand) END AS anchor_text,
  CASE l_linenumber WHEN 1 THEN concat('photo ', p_name) ELSE NULL END AS alt_text,
  CASE WHEN l_discount > 0.095 THEN 'False' WHEN l_discount > 0.045 THEN ' TRUE' ELSE 'yes' END AS follow,
  CASE WHEN l_quantity > 49 THEN '404' WHEN l_quantity > 48 THEN 'n/a' ELSE '200' END AS status_code,
  CASE l_returnflag WHEN 'A' THEN 'Content' WHEN 'N' THEN ' Navigation'
       ELSE CASE l_linestatus WHEN 'F' THEN 'Footer' ELSE 'Side-Bar (2)' END END AS link_position
FROM spelled
UNION ALL SELECT 'Hyperlink', part_url, brand_url, p_brand, NULL, 'true', '200', 'Head' FROM listing
UNION ALL SELECT 'Hyperlink', brand_url, part_url, p_name, NULL, 'true', '200', 'Content' FROM listing
UNION ALL SELECT 'Hyperlink', brand_url, type_url, p_type, NULL, '1', '200', 'Navigation' FROM listing
UNION ALL SELECT 'Hyperlink', type_url, part_url, concat(part, ' ', p_name), NULL, 'Y', '200', NULL FROM listing
UNION ALL SELECT 'Hyperlink', type_url, home_url, 'Accueil', NULL, 'true', '200', 'Head' FROM listing
UNION ALL SELECT 'Hyperlink', home_url, type_url, '', '', 'true', '200', 'Navigation' FROM listing
UNION ALL SELECT 'Hyperlink', concat('http://blog.example.com:8080/author/', CAST(s_suppkey AS STRING)),
  concat('https://www.shop.example.com/supplier/', CAST(s_suppkey AS STRING)), s_name, NULL, 'true', '200', 'Content'
FROM {supplier}
UNION ALL SELECT 'Hyperlink', 'mailto:shop@example.com', 'https://www.shop.example.com/', NULL, NULL, 'true', '200', NULL
FROM {region}
"""

# Measured traffic of part pages: clicks and other events of the user with the part's number.
REAL_METRICS = """
SELECT concat('/', lower(p_type), '/', replace(lower(p_brand), '#', '-'), '/', CAST(p_partkey AS STRING)) AS path,
  replace(lower(p_brand), '#', '-') AS category,
  CAST(nullif(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 0) AS BIGINT) AS real_clicks,
  avg(value) AS botify_pr,
  CASE p_type WHEN 'ECONOMY' THEN 'Motors' WHEN 'STANDARD' THEN 'RealEstate' WHEN 'PROMO' THEN 'Mode'
    WHEN 'SMALL' THEN 'Autres' WHEN 'MEDIUM' THEN 'Services' ELSE 'Jobs' END AS botify_verticale,
  CAST(count(*) AS DOUBLE) AS real_inlinks
FROM {events} JOIN {part} ON p_partkey = user_id
GROUP BY p_partkey, p_type, p_brand
"""

# Which vertical a brand category belongs to; other categories have none.
CATEGORY_VERTICALS = """
SELECT DISTINCT replace(lower(p_brand), '#', '-') AS category,
  CASE substring(p_brand, 7, 1) WHEN '1' THEN '_vehicules_' WHEN '2' THEN '_immobilier_' WHEN '3' THEN '_mode_'
    WHEN '4' THEN '_services_' ELSE '_loisirs_' END AS verticale
FROM {part}
"""

TEMPLATE_OF_PAGE = """
CASE WHEN section = 'root' THEN 'homepage' WHEN section = 'supplier' THEN 'l'
  WHEN depth = 1 THEN 'c_L0' WHEN depth = 2 THEN 'c_L1' ELSE 'ck' END
"""

# Taxonomy for page expansion.
CATEGORIES = """
SELECT DISTINCT concat(lower(p_type), '-', replace(p_brand, 'Brand#', '')) AS category,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE concat('_', lower(p_type), '_') END AS verticale
FROM {part}
"""
FACETS = """
WITH named AS (
  SELECT concat(lower(p_type), '-', replace(p_brand, 'Brand#', '')) AS category, p_name FROM {part}
),
pairs AS (
  SELECT DISTINCT category, 'color' AS facet, 1 AS facet_no, split_part(p_name, ' ', 1) AS value FROM named
  UNION ALL
  SELECT DISTINCT category, 'kind' AS facet, 2 AS facet_no, split_part(p_name, ' ', 2) AS value FROM named
)
SELECT category, facet, facet_no, value,
  row_number() OVER (PARTITION BY category, facet ORDER BY value) AS value_no
FROM pairs
"""
# Part names are what people look for; the first word names a colour.
KEYWORDS = """
SELECT DISTINCT concat(lower(p_type), '-', replace(p_brand, 'Brand#', '')) AS category, replace(lower(p_name), ' ', '-') AS keyword,
  'color' AS facet, split_part(p_name, ' ', 1) AS value
FROM {part}
"""
PLACES = """
SELECT 'region' AS kind, lower(n_name) AS place, n_nationkey + 1 AS place_no, concat('n', CAST(n_nationkey AS STRING)) AS code FROM {nation}
UNION ALL SELECT 'department', lower(r_name), r_regionkey + 1, concat('r', CAST(r_regionkey AS STRING)) FROM {region}
UNION ALL SELECT 'town', replace(lower(s_name), '#', '-'), CAST(s_suppkey + 1 AS INT),
  concat('n', CAST(s_nationkey AS STRING), '-', CAST(s_suppkey AS STRING)) FROM {supplier}
"""
STATIC_PAGES = """
SELECT '/' AS path, CAST(NULL AS STRING) AS parent_path, 'homepage' AS template, 'root' AS cluster_thematique
FROM {region} WHERE r_regionkey = 0
UNION ALL SELECT DISTINCT concat('/dc/', lower(c_mktsegment)), '/', 'dc', 'dc' FROM {customer}
UNION ALL SELECT DISTINCT concat('/guide/', replace(lower(o_orderpriority), ' ', '-')), '/', 'guide', 'guide' FROM {orders}
UNION ALL SELECT concat('/l/rp_', lower(n_name)), '/', 'l', concat('l:', lower(n_name)) FROM {nation}
"""

# One partial URL tree per customer, as key / value pieces of its nested JSON object.
TREE_PIECES = """
SELECT concat(r_name, '/') AS region_key, n_name AS nation_key, replace(c_name, '#', '-') AS customer_key,
  concat(lower(c_mktsegment), '/') AS segment_key, CAST(c_acctbal AS STRING) AS note
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Audit figures: links per template (part type), section (flags) and destination (line number).
AUDIT_CELLS = """
SELECT lower(p_type) AS template, concat(l_returnflag, '-', l_linestatus) AS section,
  concat('/d', CAST(l_linenumber AS STRING), '/') AS destination, sum(l_quantity) AS links, count(*) AS files
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
GROUP BY lower(p_type), concat(l_returnflag, '-', l_linestatus), concat('/d', CAST(l_linenumber AS STRING), '/')
"""
AUDIT_SCHEMAS = """
SELECT DISTINCT concat(lower(p_type), '/', replace(lower(p_brand), '#', '-')) AS template,
  CASE WHEN p_size > 42 THEN 'Vehicle' WHEN p_size > 34 THEN 'Article' WHEN p_size > 26 THEN 'BreadcrumbList'
    WHEN p_size > 18 THEN 'CollectionPage' WHEN p_size > 10 THEN 'RealEstateListing' ELSE 'Thing' END AS kind
FROM {part}
"""
AUDIT_ANOMALIES = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  lower(o_orderpriority) AS template, 'slow_order' AS type, CAST(o_orderkey AS STRING) AS detail
FROM {orders}
"""


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES}


def derive(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    return spark.sql(sql, **{name: df for name, df in tables.items() if "{" + name + "}" in sql})
