"""Evidence catalog and graph analytics as Spark jobs."""
