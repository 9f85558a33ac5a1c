"""Structured Streaming entry points (the batch operators applied per micro-batch)."""

from .extraction import start_extraction_stream

__all__ = ["start_extraction_stream"]
