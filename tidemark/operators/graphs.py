"""Strongly connected components and greedy leaders, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rounds import cut


def _settle(state: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(id, label): the least label that reaches each node along edges (id, next)."""
    changed = state
    for _ in range(rounds):
        sent = changed.join(edges, "id").groupBy(F.col("next").alias("id")).agg(F.min("label").alias("sent"))
        step = cut(state.join(sent, "id", "left").withColumn("moved", F.coalesce(F.col("sent") < F.col("label"), F.lit(False))).select("id", F.least("label", "sent").alias("label"), "moved"))
        state, changed = step.select("id", "label"), step.where("moved").select("id", "label")
        if changed.isEmpty():
            return state
    raise ValueError(f"not settled after {rounds} rounds")


def strong_components(edges: DataFrame, rounds: int = 10000) -> DataFrame:
    """(id, component): the components of more than one node of edges (id, next), named by a member.

    Each pass settles the least label that reaches a node; a label's own node and what reaches it inside the label are one component,
    which leaves the graph. Nodes without a way in or out leave before each pass. Nulls and loops are no edges."""
    edges = cut(edges.select("id", "next").where("id is not null and next is not null and id <> next").distinct())
    done = None
    for _ in range(rounds):
        while True:
            kept = cut(edges.join(edges.select(F.col("next").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("id", "next"))
            if kept.count() == edges.count():
                break
            edges = kept
        if edges.isEmpty():
            break
        nodes = edges.select("id").union(edges.select("next")).distinct().withColumn("label", F.col("id"))
        label = _settle(cut(nodes), edges, rounds)
        inside = edges.join(label, "id").join(label.select(F.col("id").alias("next"), F.col("label").alias("other")), "next").where("label = other")
        back = cut(inside.select(F.col("next").alias("id"), F.col("id").alias("next"), "label"))
        found = front = cut(label.where("id = label"))
        while not front.isEmpty():
            step = front.join(back, ["id", "label"]).select(F.col("next").alias("id"), "label").distinct()
            front = cut(step.join(found, ["id", "label"], "left_anti"))
            found = cut(found.union(front))
        done = found if done is None else cut(done.union(found))
        gone = found.select("id")
        edges = cut(edges.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("next")), "next", "left_anti").select("id", "next"))
    if done is None:
        return edges.select("id", F.col("next").alias("component"))
    many = done.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return done.join(many, "label").select("id", F.col("label").alias("component"))


def leaders(rows: DataFrame, alike: DataFrame, rounds: int = 10000) -> DataFrame:
    """(id, leader): going through ids in order, a row that no earlier leader is like becomes one; the others follow the first such leader.

    ``alike`` has (a, b), a < b, of like rows. A row whose earlier rows are all settled settles; many do at once, so rounds are few."""
    pairs = cut(alike.select("a", "b"))
    state = cut(rows.select("id", F.lit(None).cast("boolean").alias("leads")))
    for _ in range(rounds):
        known = pairs.join(state.select(F.col("id").alias("a"), "leads"), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("leads", F.lit(False))).alias("hit"), F.max(F.col("leads").isNull()).alias("open"))
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut(state.join(known, "id", "left").select("id", leads.alias("leads")))
        if state.where("leads is null").isEmpty():
            first = pairs.join(state.where("leads").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))
            return state.join(first, "id", "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("first")).alias("leader"))
    raise ValueError(f"not settled after {rounds} rounds")
