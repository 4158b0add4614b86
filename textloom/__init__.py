"""Text-corpus analytics as composable, lazy Spark DataFrame operators."""
