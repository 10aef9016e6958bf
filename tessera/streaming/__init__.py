"""A basic graph pattern over a stream."""

from .bgp import stream_query

__all__ = ["stream_query"]
