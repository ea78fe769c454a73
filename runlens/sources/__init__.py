"""Ingest jobs and sinks: text, JSON, binary and table inputs to the typed model tables, and back."""
