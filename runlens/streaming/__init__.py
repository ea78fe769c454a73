"""Structured Streaming jobs. Each stateful job has a batch twin in `operators.incidents` or `operators.series`."""
