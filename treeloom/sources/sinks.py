"""Report sinks: JSON, YAML, CSV sections, text, HTML and DOT.

Section frames are written by Spark, one folder each.  Formats for people (text, HTML, YAML,
DOT) hold a report's first rows: callers pass frames that a report limit has cut.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours of risk levels in graphs.
COLOURS = {"high": "#FFB3B3", "medium": "#FFE0B3", "low": "#C8F0C8"}
LIMIT = 1_000


def write_json(sections: dict[str, DataFrame], path: str) -> None:
    """Line-delimited JSON, a folder for each section."""
    for name, frame in sections.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def write_csv(sections: dict[str, DataFrame], path: str) -> None:
    """CSV with headers, a folder for each section."""
    for name, frame in sections.items():
        flat = frame.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in frame.dtypes))
        flat.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def rows(frame: DataFrame, limit: int = LIMIT) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.limit(limit).collect()]


def _scalar(value) -> str:
    return "null" if value is None else json.dumps(value, ensure_ascii=False, default=str)


def to_yaml(value, depth: int = 0) -> str:
    """Block YAML of mappings, lists and scalars."""
    pad = "  " * depth
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:{_nested(v, depth)}" for k, v in value.items()) or f"{pad}{{}}\n"
    if isinstance(value, (list, tuple)):
        return "".join(f"{pad}-{_nested(v, depth)}" for v in value) or f"{pad}[]\n"
    return f"{pad}{_scalar(value)}\n"


def _nested(value, depth: int) -> str:
    if isinstance(value, (dict, list, tuple)) and value:
        return "\n" + to_yaml(value, depth + 1)
    return " " + (("{}" if isinstance(value, dict) else "[]") if isinstance(value, (dict, list, tuple)) else _scalar(value)) + "\n"


def to_text(title: str, data: list[dict]) -> str:
    """An aligned table."""
    if not data:
        return f"{title}\n(none)\n"
    names = list(data[0])
    cells = [names] + [[f"{v:.2f}" if isinstance(v, float) else "" if v is None else str(v) for v in r.values()] for r in data]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    return title + "\n" + "".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() + "\n" for r in cells)


def to_html(title: str, sections: dict[str, list[dict]]) -> str:
    """A page of tables; every value is escaped."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, data in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2><table>")
        if data:
            out.append("<tr>" + "".join(f"<th>{html.escape(k)}" for k in data[0]))
        out += ["<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}" for v in r.values()) for r in data]
        out.append("</table>")
    return "".join(out)


def _name(text) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def to_dot(nodes: Iterable[dict], edges: Iterable[dict], rank: str = "TB") -> str:
    """Nodes (id, risk, cycle) and edges (src, dst, edge_type) as a graph; members of a cycle share a cluster."""
    if rank not in ("TB", "LR", "BT", "RL"):
        raise ValueError(f"no direction {rank}")
    out = ["digraph dependencies {", f"  rankdir={rank};", "  node [shape=box, style=filled];"]
    clusters: dict = {}
    for n in sorted(nodes, key=lambda n: str(n["id"])):
        line = f"{_name(n['id'])} [fillcolor={_name(COLOURS.get(n.get('risk'), '#FFFFFF'))}];"
        clusters.setdefault(n.get("cycle"), []).append(line)
    for line in clusters.pop(None, []):
        out.append("  " + line)
    for i, (_, lines) in enumerate(sorted(clusters.items(), key=lambda x: str(x[0]))):
        out += [f"  subgraph cluster_{i} {{", '    label="cycle";', *("    " + x for x in lines), "  }"]
    for e in sorted(edges, key=lambda e: (str(e["src"]), str(e["dst"]))):
        style = {"dynamic": " [style=dashed]", "type_only": " [style=dotted]"}.get(e.get("edge_type"), "")
        out.append(f"  {_name(e['src'])} -> {_name(e['dst'])}{style};")
    return "\n".join([*out, "}"]) + "\n"
