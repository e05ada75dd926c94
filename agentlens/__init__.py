"""Coding-agent outcome analytics as Spark DataFrame plans."""
