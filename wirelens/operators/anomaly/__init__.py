"""Three-model anomaly vote over window features, as Spark jobs."""
