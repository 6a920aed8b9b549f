"""Document retrieval, ranking and governance as Spark DataFrame operators."""
