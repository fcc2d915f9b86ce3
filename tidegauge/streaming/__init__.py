"""Structured Streaming: windowed aggregates, the stateful detector and drift detection."""
