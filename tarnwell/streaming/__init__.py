"""Structured Streaming forms: windowed metrics, sessions, breakers, thread memory, fan-out."""
