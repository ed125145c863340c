"""Transit analytics as Spark DataFrame operators."""
