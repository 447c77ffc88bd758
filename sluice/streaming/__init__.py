"""Structured Streaming: continuous classification and log metrics."""
