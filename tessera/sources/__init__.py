"""Sources of solutions for triple patterns."""

from .base import Source, Federation
from .files import read_ntriples, read_sparql_json, read_statistics, read_turtle
from .triples import TripleSource
from .virtual import VirtualSource

__all__ = ["Federation", "Source", "TripleSource", "VirtualSource", "read_ntriples", "read_sparql_json", "read_statistics", "read_turtle"]
