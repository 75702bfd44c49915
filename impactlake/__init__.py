"""Research-impact analytics as composable Spark DataFrame transformations."""
