"""Structured Streaming: debouncing, folding change events, idempotent appends, the running projection."""
