"""Structured Streaming: state that follows arrivals instead of being computed from the whole history."""
