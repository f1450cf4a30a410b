"""Visual observation analytics as Spark DataFrame operators."""
