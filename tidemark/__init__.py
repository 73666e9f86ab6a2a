"""Tidemark: weighted weekly series, text coding and robust inference on Spark."""
