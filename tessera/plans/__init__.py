"""Plans of joins: nodes, costs, planners, federation, JSON and edits."""

from .nodes import Join, Leaf, Plan, leaves
from .planners import PLANNERS, get_planner

__all__ = ["PLANNERS", "Join", "Leaf", "Plan", "get_planner", "leaves"]
