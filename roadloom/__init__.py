"""Spark-first trajectory and corpus analytics."""
