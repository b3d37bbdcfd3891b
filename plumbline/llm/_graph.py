"""Connected components of an edge table by hooking and jumping labels, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import discard, keep, salted_join


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, comp) for every end of the edges (a, b); comp is the smallest vertex reachable.

    Each round hooks every vertex to the smallest label among its neighbours and
    then lets labels jump to their label's label.  All tables stay distributed;
    hot vertices are reduced by partial aggregates before any shuffle.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).where("v <> w")
    links = keep(both.union(both.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "links")
    labels = keep(links.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("comp")), "labels")
    for _ in range(rounds):
        around = links.join(labels.select(F.col("v").alias("w"), "comp"), "w").groupBy("v").agg(F.min("comp").alias("near"))
        hooked = labels.join(around, "v").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # what a label's own vertex has learnt from any of its members
        up = hooked.groupBy(F.col("old").alias("comp")).agg(F.min("comp").alias("up")).where("comp <> up")
        nxt = salted_join(hooked, up, "comp", "v", "left").select("v", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        nxt = keep(nxt, "labels")
        jump = nxt.select(F.col("v").alias("comp"), F.col("comp").alias("top")).where("comp <> top")
        nxt2 = keep(salted_join(nxt, jump, "comp", "v", "left").select("v", "old", F.coalesce("top", "comp").alias("comp")), "labels")
        changed = nxt2.where("comp <> old").limit(1).count()
        discard(labels, nxt)
        labels = nxt2.select("v", "comp")
        labels._kept_at = nxt2._kept_at
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(links)
    return labels
