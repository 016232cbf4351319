"""Time the work flow stages and headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the given tables, BENCH_CPUS the number
of local threads, BENCH_RING the ring graph's "pages,links" ("0,0" leaves it out).
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bench_graphs import ring_edges, ring_pages
from linkloom.operators import audit, overview, selection, verticals
from linkloom.operators.block_edges import build_block_edges
from linkloom.operators.rule_edges import build_rule_edges
from linkloom.operators.scoring import compute_pri
from linkloom.plans import runs
from linkloom.plans.site import BLOCKS, Site
from linkloom.sources.crawl import crawl_csv_scan, write_crawl_csv
from linkloom.sources.workspace import Workspace
from linkloom.storage import new_folder


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    ring_nodes, ring_links = (int(n) for n in os.environ.get("BENCH_RING", "200000,4000000").split(","))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no Python call site is looked up for each column
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    site = Site(spark, folder)
    workspace = Workspace(spark, new_folder(spark, "bench"))
    site.workspace = workspace
    csv = new_folder(spark, "bench-csv")
    write_crawl_csv(site.raw_links, csv)
    raw = crawl_csv_scan(spark, csv)
    seconds: dict[str, float] = {}

    def timed(name: str, work: Callable[[], object]) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}s", file=sys.stderr, flush=True)

    def drain(name: str, make: Callable[[], DataFrame]) -> None:
        timed(name, lambda: make().write.format("noop").mode("overwrite").save())

    timed("crawl_links", lambda: runs.prepare_crawl(raw, workspace))
    timed("scores", lambda: runs.score_site(workspace))
    timed("marts", lambda: runs.build_marts(workspace))
    timed("scenarios", lambda: runs.model_scenarios(workspace))
    metrics, edges = site.metrics, site.edges
    for table in (site.tree_pages, site.expanded, site.audits, site.real):  # inputs of the next stages, made before they are timed
        table.schema
    drain("tree_rule_edges", lambda: build_rule_edges(site.tree_pages))
    drain("template_block_edges", lambda: build_block_edges(site.expanded, BLOCKS))
    drain("depth_stats", lambda: overview.depth_stats(metrics))
    drain("category_table", lambda: verticals.category_table(metrics, site.real))
    drain("traffic_pareto", lambda: overview.traffic_pareto(site.real))
    drain("page_neighbors", lambda: selection.page_neighbors(edges, site.pages, 1))
    drain("template_section_profile", lambda: audit.template_section_profile(audit.parse_audit(site.audits)))
    if ring_nodes > 0:
        pages = workspace.write("ring_pages", ring_pages(spark, ring_nodes, max(ring_nodes // 100, 1)))
        links = workspace.write("ring_edges", ring_edges(spark, ring_nodes, ring_links))
        drain("ring_scores", lambda: compute_pri(pages, links))
    raw_rows = raw.count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "raw_links": raw_rows,
                "raw_links_per_second": round(raw_rows / seconds["crawl_links"]),
                "pages": site.pages.count(),
                "edges": edges.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
