"""Structured Streaming: the error-log stream, sinks, launch and stop."""
