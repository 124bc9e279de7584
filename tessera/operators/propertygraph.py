"""Property graphs over tables: labelled node and edge tables, and patterns in text such as `(a:customer)-[e:placed]->(b:order)<-[:part_of]-(c:line)`.

A pattern becomes a chain of equi-joins, so the optimiser orders and prunes it; a name that comes again closes a cycle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*\)")
_EDGE = re.compile(r"\s*(<?)-\s*(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*\])?\s*-(>?)\s*")


class PatternError(ValueError):
    """The text isn't a pattern of this graph."""


@dataclass
class PropertyGraph:
    nodes: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    edges: dict[str, tuple[DataFrame, str, str, str, str]] = field(default_factory=dict)

    def add_nodes(self, label: str, df: DataFrame, key: str) -> None:
        self.nodes[label] = df, key

    def add_edges(self, label: str, df: DataFrame, source: str, source_label: str, target: str, target_label: str) -> None:
        """Edges from the nodes source_label whose key is in column source to those of target_label."""
        self.edges[label] = df, source, source_label, target, target_label

    def match(self, pattern: str, where: str | None = None, select: list[str] | None = None) -> DataFrame:
        """Rows for all matches; columns are name_column for each named node and edge. where and select may say name.column."""
        nodes, edges, at, unnamed = [], [], 0, 0
        while True:
            m = _NODE.match(pattern, at)
            if not m:
                raise PatternError(f"a node is missing at {pattern[at:]!r}")
            unnamed += not m[1]
            nodes.append((m[1] or f"_n{unnamed}", m[2]))
            at = m.end()
            if not pattern[at:].strip():
                break
            e = _EDGE.match(pattern, at)
            if not e or (e[1] == "<") == (e[4] == ">"):
                raise PatternError(f"an edge with one direction is missing at {pattern[at:]!r}")
            unnamed += not e[2]
            edges.append((e[2] or f"_e{unnamed}", e[3], e[1] == "<"))
            at = e.end()
        labels = dict(self._labels(nodes, edges))
        out, seen = None, set()
        for i, (name, _) in enumerate(nodes):
            df, key = self.nodes[labels[name]]
            part = df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))
            if i == 0:
                out = part
            else:
                e, label, back = edges[i - 1]
                rows, source, _, target, _ = self.edges[label]
                link = rows.select(*(F.col(c).alias(f"{e}_{c}") for c in rows.columns))
                before = nodes[i - 1][0]
                near, far = (target, source) if back else (source, target)
                out = out.join(link, F.col(f"{before}_{self.nodes[labels[before]][1]}") == F.col(f"{e}_{near}"))
                meets = F.col(f"{e}_{far}") == F.col(f"{name}_{key}")
                out = out.filter(meets) if name in seen else out.join(part, meets)
            seen.add(name)
        flat = lambda text: re.sub(r"\b(\w+)\.(\w+)\b", lambda m: f"{m[1]}_{m[2]}" if m[1] in seen | {e for e, _, _ in edges} else m[0], text)
        out = out.filter(flat(where)) if where else out
        return out.selectExpr(*map(flat, select)) if select else out

    def _labels(self, nodes: list, edges: list) -> list[tuple[str, str]]:
        known = {n: label for n, label in nodes if label}
        for i, (_, label, back) in enumerate(edges):
            if label not in self.edges:
                raise PatternError(f"no edges {label!r}")
            _, _, a, _, b = self.edges[label]
            ends = (b, a) if back else (a, b)
            for (name, _), wanted in zip(nodes[i : i + 2], ends, strict=True):
                if known.setdefault(name, wanted) != wanted:
                    raise PatternError(f"{name!r} can't be both {known[name]!r} and {wanted!r}")
        for n, _ in nodes:
            if known.get(n) not in self.nodes:
                raise PatternError(f"no nodes {known.get(n)!r}")
        return list(known.items())
