"""Schema discovery over tables without declared constraints, as Spark DataFrame jobs."""
