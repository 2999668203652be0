"""Spark-first engine for deduplicating and curating audio-file libraries."""
