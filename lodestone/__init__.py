"""lodestone: a Spark-first retrieval and analytics engine over source and document tables."""
