"""Byte formats, free of Spark."""
