"""Allelic-imbalance analytics as Spark DataFrame jobs."""
