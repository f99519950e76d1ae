"""Structured Streaming forms of the event-log operators and their batch twins."""
