"""Citation and literature analytics as Spark DataFrame operators."""
