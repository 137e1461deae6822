"""Spark-first analytics over large, incomplete sample-by-feature matrices."""
