"""Structured Streaming: the stateful tier and its sinks."""
