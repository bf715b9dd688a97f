"""Connected components of a graph that is only ever held as a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b), root being the smallest vertex that v reaches.

    Alternates two rewritings of the edges: every vertex sends its larger neighbours, then itself and its smaller
    ones, to its smallest neighbour. Both keep what is connected, and the graph ends as stars around the smallest
    vertices, after a number of rounds that grows with the logarithm of the longest path. A vertex with very many
    neighbours is reduced by a partial minimum, then met in a join that Spark may split. Every round is written to
    the shared folder, so no plan grows and a lost executor rereads files. An edge from a vertex to itself, or one
    with a null end, says nothing and is dropped; no edges give no rows.
    """
    ends = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = materialize(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        # large star: v > its neighbour x; x's smallest neighbour (or x) takes v
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a vertex and its smaller neighbours hang on the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        e = materialize(small.filter("v != u").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select("u").distinct()
    return e.select("v", F.col("u").alias("root")).union(roots.select(F.col("u").alias("v"), F.col("u").alias("root")))
