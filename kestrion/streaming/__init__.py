"""Structured Streaming around the engine: continuous indexing and telemetry."""
