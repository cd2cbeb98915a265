"""Structured Streaming: event windows, and incremental refresh of tables by micro-batches."""
