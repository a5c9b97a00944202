"""Inference graphs: numbering of nodes with fuzzy merging, marks on fragments, bridges and removals.

Numbering is greedy in the order of edges, so each inference (one row) is handled whole by one call; rows are independent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.functions import fuzzy
from tessera.functions.grams import meeting_tokens

#: What merges two statements, what makes one a conclusion, what marks a fragment, and a record with no page.
SAME_STATEMENT, CONCLUSION, FRAGMENT = 90.0, 60.0, 90.0
PROGRAM_TITLE = "ProgrammerNode"

NODES = "array<struct<id:int,label:string,url:string,kind:string>>"
EDGES = "array<struct<heads:array<int>,relation:string,tail:int>>"
FLAT = "array<struct<src:int,relation:string,dst:int>>"
PARTS = "array<array<struct<id:int,label:string>>>"


class Numbering:
    """Ids in the order of first appearance. Records are one node for each url; statements join the most similar earlier one.

    Earlier statements are found by tokens that two alike texts have in common (functions.grams), so a statement meets few of them.
    often orders those tokens by how often they occur.
    """

    def __init__(self, conclusion: str, often: dict[str, int]):
        self.conclusion, self.nodes, self.by_key, self.often = conclusion or "", [], {}, often
        self.labels: list[tuple[str, int]] = []
        self.same: dict[str, int] = {}
        self.by_token: dict[str, list[int]] = {}

    def add(self, key: tuple, label: str, url: str | None, kind: str) -> int:
        if key not in self.by_key:
            self.by_key[key] = len(self.nodes)
            self.nodes.append({"id": len(self.nodes), "label": label, "url": url, "kind": kind})
        return self.by_key[key]

    def record(self, ref: int, title: str | None, url: str | None) -> int:
        if title == PROGRAM_TITLE:
            return self.add(("program", ref), str(ref), None, "program")
        return self.add(("url", url) if url else ("ref", ref), f"《{title or ''}》", url, "citation")

    def statement(self, text: str | None) -> int:
        text = (text or "").strip()
        if text in self.same:
            return self.same[text]
        own = meeting_tokens(text, SAME_STATEMENT, self.often)
        met = {i for t in own for i in self.by_token.get(t, ())}
        best = max(((fuzzy.ratio_over(text, self.labels[i][0], SAME_STATEMENT), -i) for i in met), default=(0.0, 0))
        if best[0] > SAME_STATEMENT:
            return self.labels[-best[1]][1]
        final = fuzzy.token_set_over(text, self.conclusion, CONCLUSION) or fuzzy.partial_over(text, self.conclusion, CONCLUSION)
        node = self.same[text] = self.add(("text", text), text, None, "conclusion" if final else "statement")
        for t in own:
            self.by_token.setdefault(t, []).append(len(self.labels))
        self.labels.append((text, node))
        return node


def often_in(edges) -> dict[str, int]:
    """How many statements of the edges have each pair of characters, and each single one."""
    said = {(x or "").strip() for e in edges for x in [e["tail"], *(h["text"] for h in e["heads"])]}
    return Counter(g for s in said for g in {*s, *(s[i : i + 2] for i in range(len(s) - 1))})


def number_edges(edges, records, conclusion: str) -> tuple[list, list]:
    at, out = Numbering(conclusion, often_in(edges)), []
    for e in edges:
        heads = []
        for h in e["heads"]:
            if h["ref"] is not None and not pd.isna(h["ref"]):
                i = int(h["ref"])
                r = records[i] if 0 <= i < len(records) else {"title": None, "url": None}
                heads.append(at.record(i, r["title"], r["url"]))
            else:
                heads.append(at.statement(h["text"]))
        out.append({"heads": heads, "relation": e["relation"], "tail": at.statement(e["tail"])})
    return at.nodes, out


def numbered(inferences: DataFrame) -> DataFrame:
    """inference_id, nodes and edges by ids from 0.

    inferences: inference_id, conclusion, edges array<struct<heads:array<struct<ref,text>>,relation,tail>> and records
    array<struct<title,url>>. A head is a record (ref, from 0; one out of range is a citation of its own) or a text.
    A text over 90 like an earlier one is that one (of equals the first); null lists are empty, null texts empty texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [number_edges([] if r.edges is None else r.edges, [] if r.records is None else r.records, r.conclusion) for r in b.itertuples()]
            yield pd.DataFrame({"inference_id": b["inference_id"], "nodes": [n for n, _ in rows], "edges": [e for _, e in rows]})

    kind = inferences.schema["inference_id"].dataType.simpleString()
    # as many parts as a shuffle has, though they be small: inferences take long for their bytes. By a key it would be left out after a grouping
    parts = int(inferences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inferences.select("inference_id", "conclusion", "edges", "records").repartition(parts).mapInPandas(run, f"inference_id {kind}, nodes {NODES}, edges {EDGES}")


def grounded_part(nodes: list[dict], edges: list[dict]) -> tuple | None:
    """goal, nodes, edges (src, relation, dst) and parts of a graph without loops and nodes that nothing leads to; None if no goal or not one is left.

    The goal is the one conclusion that leads nowhere; removed are, until nothing changes, nodes that are no citation and that no node left leads to.
    """
    flat = [{"src": h, "relation": e["relation"], "dst": e["tail"]} for e in edges for h in e["heads"] if h != e["tail"]]
    onward: dict[int, list[int]] = {}
    for e in flat:
        onward.setdefault(e["src"], []).append(e["dst"])
    goals = [n["id"] for n in nodes if n["kind"] == "conclusion" and n["id"] not in onward]
    fed = Counter(e["dst"] for e in flat)
    ground = {n["id"] for n in nodes if n["kind"] in ("citation", "program")}
    bare = [n["id"] for n in nodes if n["id"] not in ground and not fed[n["id"]]]
    gone = set(bare)
    while bare:
        for x in onward.get(bare.pop(), ()):
            fed[x] -= 1
            if not fed[x] and x not in ground and x not in gone:
                gone.add(x)
                bare.append(x)
    if len(goals) != 1 or goals[0] in gone:
        return None
    nodes, flat = [n for n in nodes if n["id"] not in gone], [e for e in flat if e["src"] not in gone and e["dst"] not in gone]
    near: dict[int, list[int]] = {}
    for e in flat:
        near.setdefault(e["src"], []).append(e["dst"])
        near.setdefault(e["dst"], []).append(e["src"])
    part: dict[int, int] = {}
    for n in nodes:
        spread(near, n["id"], part, n["id"])
    parts: dict[int, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: n["id"]):
        parts.setdefault(part[n["id"]], []).append({"id": n["id"], "label": n["label"]})
    return goals[0], nodes, flat, sorted(parts.values(), key=lambda p: p[0]["id"])


def spread(near: dict[int, list[int]], start: int, seen: dict[int, int], name: int) -> None:
    """Gives a name to what can be reached from start and has none."""
    front = [] if start in seen else [start]
    seen.setdefault(start, name)
    while front:
        for x in near.get(front.pop(), ()):
            if x not in seen:
                seen[x] = name
                front.append(x)


def grounded_graphs(graphs: DataFrame) -> DataFrame:
    """inference_id, goal, nodes, edges and parts (nodes that hang together) of numbered graphs, as grounded_part has them; those without are left out."""
    kind = graphs.schema["inference_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grounded_part(n, e) for n, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            own = [i for i, x in enumerate(found) if x]
            columns = zip(*[found[i] for i in own], strict=True) if own else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=names)

    schema = f"inference_id {kind}, goal int, nodes {NODES}, edges {FLAT}, parts {PARTS}"
    names, types = arrow_types(schema)
    return graphs.select("inference_id", "nodes", "edges").mapInArrow(run, schema)


def arrow_types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    """Names of a schema's columns, and the Arrow types of all but the first."""
    fields = StructType.fromDDL(schema).fields
    return [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields[1:]]


def leading_to_goal(graphs: DataFrame) -> DataFrame:
    """inference_id, nodes and edges that lead to the goal of grounded graphs, with those of the proposed edges that join two parts."""
    kind = graphs.schema["inference_id"].dataType.simpleString()

    def led(goal: int, nodes: list[dict], edges: list[dict], parts: list[list[dict]], proposed: list[dict]) -> tuple[list[dict], list[dict]]:
        part = {n["id"]: k for k, p in enumerate(parts) for n in p}
        edges = edges + [e for e in proposed if e["src"] in part and e["dst"] in part and part[e["src"]] != part[e["dst"]]]
        back: dict[int, list[int]] = {}
        for e in edges:
            back.setdefault(e["dst"], []).append(e["src"])
        seen: dict[int, int] = {}
        spread(back, goal, seen, 0)
        return [n for n in nodes if n["id"] in seen], [e for e in edges if e["src"] in seen and e["dst"] in seen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [led(*row) for row in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[k] for x in found], t) for k, t in enumerate(types)]], names=names)

    schema = f"inference_id {kind}, nodes {NODES}, edges {FLAT}"
    names, types = arrow_types(schema)
    return graphs.select("inference_id", "goal", "nodes", "edges", "parts", "proposed").mapInArrow(run, schema)


def find_fragment(text: str, piece: str, threshold: float) -> tuple[int, int] | None:
    """Where piece is in text: exactly, or the window of its length most like it, the first of equals.

    A window's likeness is at most its share of characters in common with piece, kept while the window moves; only windows
    whose share can reach the threshold and beat the best so far are compared.
    """
    at = text.find(piece)
    if at >= 0:
        return at, at + len(piece)
    n, best, found = len(piece), 0.0, None
    if not n or n > len(text):
        return None
    lack, common = Counter(piece), 0  # what piece has more of than the window
    for end, c in enumerate(text):
        common += lack[c] > 0
        lack[c] -= 1
        if end >= n:
            old = text[end - n]
            lack[old] += 1
            common -= lack[old] > 0
        if end >= n - 1 and 100.0 * common / n >= threshold and 100.0 * common / n > best:
            score = fuzzy.ratio_of(piece, text[end - n + 1 : end + 1])
            if score > best:
                best, found = score, end - n + 1
    return (found, found + n) if found is not None and best >= threshold else None


def tag_fragments(text: str | None, pieces, template: str = "<mark>{}</mark>", threshold: float = FRAGMENT) -> str | None:
    """text with its fragments in the template, put from the last to the first; a span met twice is marked once."""
    if text is None:
        return None
    spans = {s for p in (pieces if pieces is not None else []) if p and (s := find_fragment(text, p, threshold))}
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + template.format(text[a:b]) + text[b:]
    return text


def tagged(text: Column, pieces: Column) -> Column:
    """tag_fragments as a column; only texts that lack some fragment as it stands need it, the others are few replacements."""

    @F.pandas_udf("string")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([tag_fragments(a, b) for a, b in zip(t, p, strict=True)], dtype=object)

    return run(text, pieces)


def bridges(proposed: DataFrame, labels: DataFrame) -> DataFrame:
    """Proposed edges (src, dst) that join two different components; labels: id, component. Unknown nodes give none."""
    a = labels.select(F.col("id").alias("src"), F.col("component").alias("_a"))
    b = labels.select(F.col("id").alias("dst"), F.col("component").alias("_b"))
    return proposed.join(a, "src").join(b, "dst").where("_a <> _b").select(*proposed.columns)


def without_nodes(hyper: DataFrame, nodes: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (edge_id, heads, relation, tail) whose tail stays, and nodes (id) without the ends of the edges that went."""
    gone = hyper.join(removed.select(F.col("id").alias("tail")).distinct(), "tail", "left_semi")
    ends = gone.select(F.col("tail").alias("id")).union(gone.select(F.explode("heads").alias("id"))).distinct()
    kept = hyper.join(removed.select(F.col("id").alias("tail")).distinct(), "tail", "left_anti").select(*hyper.columns)
    return kept, nodes.join(ends, "id", "left_anti")


def rendered(hyper: DataFrame) -> DataFrame:
    """src, dst and label to draw: an edge of several heads goes through a node of its own (`e` and its id)."""
    many = F.size("heads") > 1
    own = F.concat(F.lit("e"), F.col("edge_id").cast("string"))
    part = hyper.select(F.explode("heads").alias("h"), "relation", "tail", many.alias("many"), own.alias("own"))
    into = part.select(F.col("h").cast("string").alias("src"), F.when(F.col("many"), F.col("own")).otherwise(F.col("tail").cast("string")).alias("dst"), F.when(~F.col("many"), F.col("relation")).alias("label"))
    out = hyper.where(many).select(own.alias("src"), F.col("tail").cast("string").alias("dst"), F.col("relation").alias("label"))
    return into.unionByName(out)
