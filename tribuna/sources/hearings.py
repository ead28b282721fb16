"""Readers and writers: hearings as JSON Lines, stances as CSV, the graph as an interactive page."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribuna import schema


def read_hearings(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with the declared schema; a malformed line fails the read instead of becoming nulls."""
    return spark.read.schema(schema.HEARING).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)


def write_stances(df: DataFrame, path: str, single: bool = False) -> None:
    """Stances as CSV with a header; one file only where somebody asks for it."""
    columns = [x.split()[0] for x in schema.STANCE.split(", ")]
    out = df.select(*columns)
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_stances(spark: SparkSession, path: str) -> DataFrame:
    """The CSV back, line breaks and quotes inside fields included."""
    return spark.read.schema(schema.STANCE).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


PAGE = """<!doctype html><html lang="pt"><head><meta charset="utf-8"><title>Alinhamento</title>
<style>body{margin:0;background:#ffffff;color:black}#rede{width:100%;height:800px}</style></head>
<body><canvas id="rede"></canvas><script>
const nodes=__NODES__,edges=__EDGES__,physics=__PHYSICS__;
const c=document.getElementById('rede'),g=c.getContext('2d');c.width=innerWidth;c.height=800;
const at={};nodes.forEach((n,i)=>{const a=2*Math.PI*i/nodes.length;at[n.id]=n;n.x=c.width/2+300*Math.cos(a);n.y=400+300*Math.sin(a);n.vx=n.vy=0});
function step(){for(const n of nodes){n.fx=(c.width/2-n.x)*physics.central_gravity*.01;n.fy=(400-n.y)*physics.central_gravity*.01}
for(let i=0;i<nodes.length;i++)for(let j=i+1;j<nodes.length;j++){const a=nodes[i],b=nodes[j];let dx=a.x-b.x,dy=a.y-b.y,d=Math.hypot(dx,dy)||1;
const f=d<2*physics.node_distance?Math.max(0,1-d/(2*physics.node_distance)):0;a.fx+=f*dx/d;a.fy+=f*dy/d;b.fx-=f*dx/d;b.fy-=f*dy/d}
for(const e of edges){const a=at[e.from],b=at[e.to];let dx=b.x-a.x,dy=b.y-a.y,d=Math.hypot(dx,dy)||1,f=physics.spring_strength*(d-physics.spring_length)/d;
a.fx+=f*dx;a.fy+=f*dy;b.fx-=f*dx;b.fy-=f*dy}
for(const n of nodes){n.vx=(n.vx+n.fx)*(1-physics.damping);n.vy=(n.vy+n.fy)*(1-physics.damping);n.x+=n.vx;n.y+=n.vy}}
function draw(){step();g.clearRect(0,0,c.width,c.height);for(const e of edges){g.strokeStyle=e.color;g.lineWidth=Math.min(8,e.value);g.beginPath();g.moveTo(at[e.from].x,at[e.from].y);g.lineTo(at[e.to].x,at[e.to].y);g.stroke()}
for(const n of nodes){g.fillStyle=n.color;g.beginPath();g.arc(n.x,n.y,n.size/2,0,7);g.fill();g.fillStyle='black';g.fillText(n.label.split('\\n')[0],n.x+9,n.y)}requestAnimationFrame(draw)}
draw();
c.onmousemove=m=>{c.title='';for(const n of nodes)if(Math.hypot(n.x-m.offsetX,n.y-m.offsetY)<9)c.title=n.title};
</script></body></html>"""
#: Fixed values of the layout.
PHYSICS = {"node_distance": 180, "central_gravity": 0.15, "spring_length": 250, "spring_strength": 0.05, "damping": 0.09}
MOST_EDGES = 100_000


def write_dashboard(nodes: DataFrame, edges: DataFrame, path: str, most: int = MOST_EDGES) -> tuple[int, int]:
    """The graph as one page, and how many nodes and edges it shows.

    A page is for looking at: of a graph with more than ``most`` edges it shows the ``most`` widest (ties: by names) and
    the nodes they join; the whole graph is then written beside it as JSON lines (gzip), in ``<path>.data``.
    """
    if edges.limit(most + 1).count() > most:
        for name, part in (("nodes", nodes), ("edges", edges)):
            part.write.mode("overwrite").json(f"{path}.data/{name}", compression="gzip")
        edges = edges.orderBy(F.desc("value"), "src", "dst").limit(most)
        ends = edges.select(F.explode(F.array("src", "dst")).alias("nome")).distinct()
        nodes = nodes.join(F.broadcast(ends), "nome", "left_semi")  # at most two an edge shown
    elif nodes.limit(2 * most + 1).count() > 2 * most:
        nodes.write.mode("overwrite").json(f"{path}.data/nodes", compression="gzip")
        nodes = nodes.orderBy("nome").limit(2 * most)
    points = [{"id": n.nome, "label": n.label, "title": html.escape(n.title or ""), "color": n.color, "group": n.group, "size": n.size} for n in nodes.collect()]
    lines = [{"from": e.src, "to": e.dst, "color": e.color, "value": e.value, "title": e.title} for e in edges.collect()]
    text = PAGE
    for mark, value in (("__NODES__", points), ("__EDGES__", lines), ("__PHYSICS__", PHYSICS)):
        text = text.replace(mark, json.dumps(value, ensure_ascii=False).replace("</", "<\\/"))
    page = Path(path.removeprefix("file:"))
    page.parent.mkdir(parents=True, exist_ok=True)
    page.write_text(text, encoding="utf-8")
    return len(points), len(lines)
