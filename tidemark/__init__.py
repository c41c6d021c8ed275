"""tidemark: Spark-first analytics over versioned decisions, estimates and outcomes."""
