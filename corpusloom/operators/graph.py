"""Connected components by contraction, all in DataFrames.

Every round each node points at the smallest of itself and its neighbours,
pointers are shortened, and edges are rewritten between the nodes pointed at.
A round's tables are written to the shared folder, so lineage stays short and
a lost executor costs one round. No node, edge or component reaches the driver;
it sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list.

    component is the smallest node reachable. Null ends, self loops and repeated
    edges are ignored; an empty edge list gives an empty result.
    """
    cur = materialize(
        edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .where("a < b")
        .distinct(),
        "cc-edges",
    )
    rounds: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.union(cur.select("b", "a")).toDF("node", "other")
        ptr = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")), "cc-ptr")
        # one shortening: a pointer to a pointer; chains of pointers halve
        nxt = ptr.select(F.col("node").alias("via"), F.col("to").alias("far"))
        ptr = materialize(ptr.join(nxt, ptr["to"] == nxt["via"]).select("node", F.col("far").alias("to")), "cc-ptr")
        rounds.append(ptr)
        pa, pb = ptr.toDF("na", "ta"), ptr.toDF("nb", "tb")
        cur = materialize(
            cur.join(pa, F.col("a") == F.col("na"))
            .join(pb, F.col("b") == F.col("nb"))
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct(),
            "cc-edges",
        )
    if not rounds:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds[-1].toDF("node", "component")
    for ptr in reversed(rounds[:-1]):
        later = out.toDF("ln", "lc")
        out = ptr.join(later, ptr["to"] == later["ln"], "left").select("node", F.coalesce("lc", "to").alias("component"))
    return out
