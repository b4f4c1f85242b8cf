"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _roots(step: DataFrame) -> DataFrame:
    """Follow ``step (id, to)``, where ``to`` is never larger than ``id``, to its end.

    Each round doubles the hops a vertex has made, so a chain takes as many
    rounds as its length has binary digits.
    """
    while True:
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = written(step.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "step")
        step = jumped.select("id", "to")
        if jumped.where("moved").isEmpty():
            return step


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges (a, b)``; the component is its smallest id.

    Each round points every vertex to the smallest id among itself and its
    neighbours, follows these pointers to their ends and contracts the edges
    to those. A vertex that points nowhere else has a neighbour that does, so
    at least half of the vertices go in a round, and the chain of any order
    takes logarithmically many jumps. All tables of a round are written, so
    lost executors cost no earlier round. Hot vertices only meet partial minima
    and plain joins.
    """
    spark = edges.sparkSession
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("to")))
        step = _roots(written(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")), "step"))
        if labels is None:
            labels = step.select("id", F.col("to").alias("component"))
        else:
            moved = step.withColumnRenamed("id", "component")
            labels = written(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        a, b = step.select(F.col("id").alias("a"), F.col("to").alias("x")), step.select(F.col("id").alias("b"), F.col("to").alias("y"))
        contracted = left.join(a, "a").join(b, "b").where("x <> y")
        left = written(contracted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return spark.createDataFrame([], "id long, component long") if labels is None else labels
