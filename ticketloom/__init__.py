"""Support-ticket analytics as Spark DataFrame jobs."""
