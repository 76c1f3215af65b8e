"""earshot: listening-history analytics as composable Spark DataFrame operators."""
