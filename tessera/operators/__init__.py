"""Operators over solutions."""

from .joins import inner_join, left_join
from .modifiers import distinct, order, project, render, slice_rows

__all__ = ["distinct", "inner_join", "left_join", "order", "project", "render", "slice_rows"]
