"""Tables as a graph: classes, IRI templates, column and link predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

BASE = "http://ex.org/"


@dataclass(frozen=True)
class TableMap:
    """One table.  Its key identifies a row; each column that isn't null is a triple."""

    name: str
    key: tuple[str, ...]
    #: link predicate -> (column, table whose key it holds)
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: text column -> column with its language
    langs: dict[str, str] = field(default_factory=dict)
    #: columns without a predicate
    hidden: tuple[str, ...] = ()

    @property
    def template(self) -> str:
        return f"{BASE}{self.name}/"

    @property
    def cls(self) -> str:
        return f"{BASE}{self.name.capitalize()}"

    def predicate(self, column: str) -> str:
        return f"{BASE}{self.name}#{column}"


TABLES = {
    t.name: t
    for t in (
        TableMap("region", ("r_regionkey",)),
        TableMap("nation", ("n_nationkey",), {"region": ("n_regionkey", "region")}),
        TableMap("customer", ("c_custkey",), {"nation": ("c_nationkey", "nation")}),
        TableMap("supplier", ("s_suppkey",), {"nation": ("s_nationkey", "nation")}),
        TableMap("part", ("p_partkey",)),
        TableMap("orders", ("o_orderkey",), {"customer": ("o_custkey", "customer")}),
        TableMap("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), {"orders": ("l_orderkey", "orders"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier")}),
        TableMap("events", ("event_id",), {"customer": ("user_id", "customer")}),
        TableMap("documents", ("doc_id",), langs={"text": "lang"}),
        TableMap("labels", ("doc_id",), {"document": ("doc_id", "documents")}),
        TableMap("embeddings", ("vec_id",), hidden=("embedding",)),
        TableMap("pages", ("page_id",)),
        TableMap("benchmark", ("item_id",)),
        TableMap("conversations", ("conv_id", "turn")),
    )
}
