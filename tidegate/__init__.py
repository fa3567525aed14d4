"""Web-traffic risk scoring and audit analytics, expressed as PySpark jobs."""
