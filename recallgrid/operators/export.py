"""The association graph for viewing: nodes and edges as JSON lines, and a page that draws them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.scalars import truncated_bytes


def nodes_json(edges: DataFrame, memories: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, json) of the memories at the edges that weigh enough; those that don't exist are left out."""
    heavy = edges.where(F.col("weight") >= least)
    ends = heavy.select(F.col("from_id").alias("id")).union(heavy.select("to_id")).distinct()
    shown = memories.join(ends, "id", "left_semi")
    fields = [F.col("id").cast("string").alias("id"), truncated_bytes("content", 30).alias("label"), F.round("energy", 6).alias("energy"), "state", "access_count"]
    return shown.select("id", F.to_json(F.struct(*fields)).alias("json"))


def edges_json(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """(from_id, to_id, json) of the edges that weigh enough."""
    fields = [F.col("from_id").cast("string").alias("from"), F.col("to_id").cast("string").alias("to"), F.round("weight", 6).alias("weight"), F.col("co_activation_count").alias("co_activations")]
    return edges.where(F.col("weight") >= least).select("from_id", "to_id", F.to_json(F.struct(*fields)).alias("json"))


def write(edges: DataFrame, memories: DataFrame, folder: str, least: float = 0.0) -> None:
    """nodes and edges under a folder as JSON lines, written by the executors."""
    nodes_json(edges, memories, least).select("json").write.mode("overwrite").text(f"{folder}/nodes")
    edges_json(edges, least).select("json").write.mode("overwrite").text(f"{folder}/edges")


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Associations</title></head>
<body><svg id="graph" width="900" height="900"></svg>
<script>
const data = %s;
const svg = document.getElementById("graph"), at = {};
data.nodes.forEach((n, i) => { const t = 2 * Math.PI * i / data.nodes.length; at[n.id] = [450 + 400 * Math.cos(t), 450 + 400 * Math.sin(t)]; });
const draw = (tag, set) => { const e = document.createElementNS("http://www.w3.org/2000/svg", tag); for (const k in set) e.setAttribute(k, set[k]); svg.appendChild(e); return e; };
data.edges.forEach(e => { const a = at[e.from], b = at[e.to]; if (a && b) draw("line", {x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999", "stroke-width": 3 * e.weight}); });
data.nodes.forEach(n => { draw("circle", {cx: at[n.id][0], cy: at[n.id][1], r: 4 + 6 * n.energy}); draw("text", {x: at[n.id][0] + 8, y: at[n.id][1]}).textContent = n.label; });
</script></body></html>
"""


def page(edges: DataFrame, memories: DataFrame, most_edges: int = 500, least: float = 0.0) -> str:
    """A page that draws the heaviest edges; a drawing of more than a few hundred shows nothing."""
    top = edges.where(F.col("weight") >= least).orderBy(F.desc("weight"), "from_id", "to_id").limit(most_edges)
    nodes = [json.loads(r.json) for r in nodes_json(top, memories).orderBy("id").collect()]
    drawn = [json.loads(r.json) for r in edges_json(top).orderBy("from_id", "to_id").collect()]
    return PAGE % json.dumps({"nodes": nodes, "edges": drawn}).replace("</", "<\\/")
