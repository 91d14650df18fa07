"""Build-graph and CI-run analytics expressed as Spark jobs."""
