"""Structured Streaming: stream scoring (C4) and prediction history (T5)."""
