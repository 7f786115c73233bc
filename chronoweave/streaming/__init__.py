"""Typed tables over Structured Streaming."""

from .stream import StreamFrame, stream_csv_load, stream_load, stream_parquet

__all__ = ["StreamFrame", "stream_csv_load", "stream_load", "stream_parquet"]
