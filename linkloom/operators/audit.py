"""Queries over link-audit documents (nested JSON, one document per row in ``audit``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "map<string,struct<file_count:int,sections:map<string,struct<avg_total_links:double,avg_links_by_destination:map<string,double>>>>>"
MATRIX = "map<string,map<string,double>>"
ANOMALIES = "array<struct<severity:string,template:string,type:string,detail:string>>"
SCHEMAS = "map<string,struct<has_schema:boolean,schemas_found:map<string,int>>>"
AUDIT = (
    f"struct<linking_rules_per_template:{RULES},linking_matrix_section_x_destination:{MATRIX},"
    f"anomalies:{ANOMALIES},json_ld_diff:{SCHEMAS}>"
)

# Destination used for sections without a breakdown, and the schema kinds checked.
TOTAL_ONLY = "(total)"
SCHEMA_KINDS = {
    "BreadcrumbList": ["BreadcrumbList"],
    "CollectionPage": ["CollectionPage"],
    "Product": ["Product", "Vehicle"],
    "RealEstateListing": ["RealEstateListing"],
    "Article": ["Article"],
}
NO_SCHEMA = "Aucun"


def parse_audit(documents: DataFrame) -> DataFrame:
    """Typed audit documents from JSON text in ``audit``."""
    return documents.select("audit_id", F.from_json("audit", AUDIT).alias("audit"))


def section_destinations(audits: DataFrame) -> DataFrame:
    """(section, destination, avg_links) cells of the audit matrix."""
    return (
        audits.select(F.explode("audit.linking_matrix_section_x_destination").alias("section", "cells"))
        .select("section", F.explode("cells").alias("destination", "avg_links"))
    )


def section_destination_matrix(audits: DataFrame, destinations: list[str]) -> DataFrame:
    cells = section_destinations(audits)
    wide = cells.groupBy("section").pivot("destination", destinations).agg(F.sum("avg_links"))
    return wide.na.fill(0.0)


def _sections(audits: DataFrame) -> DataFrame:
    return (
        audits.select(F.explode("audit.linking_rules_per_template").alias("template", "rules"))
        .select("template", "rules.file_count", F.explode("rules.sections").alias("section", "data"))
    )


def template_section_profile(audits: DataFrame) -> DataFrame:
    """Links per template, section and destination; one total row where no breakdown exists."""
    return _sections(audits).select(
        "template",
        "section",
        F.col("data.avg_total_links").alias("total"),
        F.explode_outer("data.avg_links_by_destination").alias("destination", "avg_links"),
    ).select(
        "template",
        "section",
        F.coalesce("destination", F.lit(TOTAL_ONLY)).alias("destination"),
        F.when(F.col("destination").isNull(), F.coalesce("total", F.lit(0.0))).otherwise(F.col("avg_links")).alias("avg_links"),
    )


def template_section_totals(audits: DataFrame) -> DataFrame:
    return template_section_profile(audits).groupBy("template", "section").agg(F.sum("avg_links").alias("total"))


def template_section_heatmap(audits: DataFrame, sections: list[str]) -> DataFrame:
    links = _sections(audits).select("template", "section", F.coalesce("data.avg_total_links", F.lit(0.0)).alias("links"))
    return links.groupBy("template").pivot("section", sections).agg(F.sum("links")).na.fill(0.0)


def anomaly_rows(audits: DataFrame, severities: list[str] | None = None) -> DataFrame:
    rows = audits.select(F.explode("audit.anomalies").alias("a")).select("a.*")
    return rows.where(F.col("severity").isin(severities)) if severities else rows


def anomaly_table(audits: DataFrame, severities: list[str] | None = None) -> DataFrame:
    return anomaly_rows(audits, severities).groupBy("severity", "template").agg(F.count(F.lit(1)).alias("count"))


def anomaly_severities(audits: DataFrame) -> DataFrame:
    """Anomalies of each severity, over all templates."""
    return anomaly_rows(audits).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def ad_outlinks_total(audits: DataFrame, template: str) -> DataFrame:
    """Links a page of one template sends out, over all its sections."""
    of_template = _sections(audits).where(F.col("template") == template)
    return of_template.agg(F.coalesce(F.sum("data.avg_total_links"), F.lit(0.0)).alias("total_outlinks"))


def schema_checklist(audits: DataFrame) -> DataFrame:
    """Which structured-data kinds each template carries."""
    rows = audits.select(F.explode("audit.json_ld_diff").alias("template", "data"))
    found: Column = F.coalesce(F.map_keys("data.schemas_found"), F.array().cast("array<string>"))
    kinds = [F.arrays_overlap(found, F.array(*[F.lit(n) for n in names])).alias(kind) for kind, names in SCHEMA_KINDS.items()]
    listed = F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(NO_SCHEMA)
    return rows.select(
        "template", F.coalesce("data.has_schema", F.lit(False)).alias("has_schema"), *kinds, listed.alias("schemas_found")
    )
