"""Link-graph analytics for web sites, expressed as Spark DataFrame jobs."""
