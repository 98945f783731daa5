"""Spark-first analytics of how web articles are shared, extracted and sampled."""
