"""Expressions of FILTER and ORDER BY."""

from .expr import condition, evaluate, order_key

__all__ = ["condition", "evaluate", "order_key"]
