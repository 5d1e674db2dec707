"""Kernels over one string, without Spark: markup trees, Markdown, nested query strings."""
