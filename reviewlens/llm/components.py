"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize


def _total(labels: DataFrame):
    """Labels only ever fall, so an unchanged sum means that none has changed."""
    return labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]


def _contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``links`` between the labels of their ends; those within one label are done."""
    ends = links.join(labels.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
    ends = ends.join(labels.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x")
    return materialize(ends.filter("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())


def connected_components(links: DataFrame) -> DataFrame:
    """``links(x, y)`` -> ``(node, root)``: the smallest node id reachable.

    Rounds of "links join the labels of their ends, a label falls to the
    smallest one that it is linked with", each followed by pointer jumping (my
    label's label), until no link is left and nothing changes. A link whose ends
    have one label is dropped, so later rounds do not read all links again.
    Every round is a written table, so a lost executor costs its own tasks.
    A node with many links is combined map-side by the ``min``.
    """
    links = materialize(links.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    labels = materialize(links.select(F.col("x").alias("node"), F.col("x").alias("m")).union(links.select(F.col("y"), F.col("x")))
                         .groupBy("node").agg(F.min("m").alias("root")))
    total = _total(labels)
    while total is not None:
        links, old = _contracted(links, labels), links
        free(old)
        falls = links.groupBy(F.col("y").alias("root")).agg(F.min("x").alias("low"))
        step = labels.join(falls, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
        jump = labels.join(falls, "root", "left").select(F.col("node").alias("root"), F.coalesce("low", "root").alias("r2"))
        new = materialize(step.join(jump, "root", "left").select("node", F.coalesce("r2", "root").alias("root")))
        before, total = total, _total(new)
        free(labels)
        labels = new
        if total == before:
            break
    free(links)
    return labels
