"""Literature-stream analytics as Spark DataFrame operators."""
