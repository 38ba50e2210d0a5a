"""Resumable and continuous forms of the batch operators, on Structured Streaming."""
