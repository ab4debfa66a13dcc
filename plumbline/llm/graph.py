"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import dropped, partition_map, stored

#: Links that one task may finish: a few tens of MB of its memory. More are contracted first.
FINISH = 1_000_000


def lowest(n: int, pairs) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by arrays of pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _finish(table: pa.Table) -> list[dict]:
    """Components of a bounded table of links (u, v), by union of all its pairs."""
    ends = pa.chunked_array([*table["u"].chunks, *table["v"].chunks]).to_pylist()
    as_key = (lambda x: tuple(x.values())) if isinstance(ends[0], dict) else (lambda x: x)
    keys = [as_key(x) for x in ends]
    nodes = sorted(set(keys))
    place = {k: i for i, k in enumerate(nodes)}
    at = np.array([place[k] for k in keys])
    root = lowest(len(nodes), [(at[: len(table)], at[len(table) :])])
    back = {k: x for k, x in zip(keys, ends, strict=True)}
    kind = table["u"].type
    return [{"node": pa.array([back[k] for k in nodes], kind), "component": pa.array([back[nodes[r]] for r in root.tolist()], kind)}]


def components(links: DataFrame, a: str = "a", b: str = "b", finish: int = FINISH) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` reaches.

    While there are over ``finish`` links, large-star and small-star rounds point them to ever
    smaller nodes, until each points to its component's smallest; a counted ``finish`` links or
    fewer go to one task instead. Rounds join by node with plain equi-joins, so a node with most
    of the links is split by the engine's skew handling, and minima are pre-aggregated. Null
    ends and self-links are left out; a node without links isn't in the result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, before = stored(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= finish:
            kind = edges.schema["u"].dataType
            return partition_map(edges.coalesce(1), _finish, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
        if state == before:
            break
        before, after = state, stored(_stars(edges), "links")
        dropped(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over links from larger (u) to smaller nodes (v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u != v").distinct()
