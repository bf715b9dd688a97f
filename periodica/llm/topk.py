"""Exact top-k search over binary codes by incremental multi-index hashing.

Every code of ``bits`` bits is cut into segments, each with an index of its own: (segment, value) to codes. Equal codes
are one entry that keeps its ``k`` smallest ids, so copies cost nothing, and ``k`` ids always suffice. A query looks up
all values within radius 0 of each of its segments, then those at radius 1, 2, ...; every code it meets is verified by its
whole Hamming distance. Once radius r is done in all m segments, every code at distance below m * (r + 1) has been
met; a query is finished when its kth verified distance is below that. With a kth distance d in hand, the first
d - m * r + 1 segments suffice at radius r, and only those are looked up; a code further than d is refused inside the join
on (segment, value), so that only codes that can still be an answer become rows. The segment length follows the number of codes
(at most about one code per bucket), so buckets stay small as the table grows. Values at a radius are made by one more flip of
those at the radius before, above their highest flipped bit, in place. All joins are sort-merge joins on (segment, value)
or on the query: probes grow with the queries and the radius, so nothing is broadcast and no mask passes through the
driver. The loop ends at the longest segment at the latest.

Ties go to the smaller id. Ids that repeat are entries each. A query takes no part in its own answer. Rows with a null
id or code are left out. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from periodica.llm.common import table
from periodica.session import materialize

K = 10
BITS = 64
#: Fewest and most bits of a segment.
SEGMENT_BITS = (8, 22)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def sign_code(vector: Column, start: int = 0, bits: int = BITS) -> Column:
    """Bit i is 1 where component ``start + i`` is positive; null, NaN and missing components count as not positive."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        value = F.get(vector, F.lit(start + i))
        out = out.bitwiseOR(F.when((value > 0) & ~F.isnan(value), F.lit(_signed(1 << i)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def segments(n_codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, length) of each segment: as many as are no shorter than log2 of the number of codes, within bounds."""
    least = min(max(SEGMENT_BITS[0], math.log2(max(2, n_codes))), SEGMENT_BITS[1], bits)
    m = max(1, int(bits // least))
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _values(code: Column, cuts: list[tuple[int, int]]) -> Column:
    """(segment, its bits, value, highest bit flipped so far) of every segment of a code."""
    parts = [(F.lit(n), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << n) - 1))) for at, n in cuts]
    return F.array(*[F.struct(F.lit(i).alias("segment"), n.alias("n"), p.alias("value"), F.lit(-1).alias("top")) for i, (n, p) in enumerate(parts)])


def _flipped(probes: DataFrame) -> DataFrame:
    """Every probe with one more bit flipped, above those already flipped; each set of bits comes up once."""
    more = F.explode(F.when(F.col("top") + 1 < F.col("n"), F.sequence(F.col("top") + 1, F.col("n") - 1)))
    wider = probes.select("query_code", "within", "segment", "n", "value", more.alias("top"))
    return wider.withColumn("value", F.expr("value ^ shiftleft(1L, top)"))


def _met(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(query_code, code, ids, distance) of the codes in the probed buckets that are no further than ``within``.

    The distance is a condition of the join: codes of a bucket that are too far are compared, but make no row.
    """
    distance = F.bit_count(F.col("query_code").bitwiseXOR(F.col("code")))
    met = probes.select("query_code", "within", "segment", "value").join(index.hint("merge"), ["segment", "value"]).filter(distance <= F.col("within"))
    return met.select("query_code", "code", "ids", distance.alias("distance"))


def hamming_top_k(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest of ``rows`` (id, code) for each of ``queries`` (id, code)."""
    held = rows.filter(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code")
    # k + 1 ids: the query's own may be among them
    order = Window.partitionBy("code").orderBy("id")
    few = held.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    codes = materialize(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    cuts = segments(codes.count(), bits)
    index = codes.select("code", "ids", F.explode(_values(F.col("code"), cuts)).alias("at")).select("at.segment", "at.value", "code", "ids")
    index = materialize(index)
    asking = queries.filter(F.col("id").isNotNull() & F.col("code").isNotNull())
    m, longest = len(cuts), max(n for _, n in cuts)
    left = asking.select(F.col("id").alias("query_id"), F.col("code").alias("query_code"), F.lit(None).cast("int").alias("kth")).distinct()
    left = materialize(left)
    nearest = Window.partitionBy("query_code").orderBy("distance", F.element_at("ids", 1))
    best, done = None, []
    for radius in range(longest + 1):
        need = F.coalesce(F.least(F.lit(m), F.col("kth") - m * radius + 1), F.lit(m))
        within = F.coalesce(F.col("kth"), F.lit(64))
        asked = left.groupBy("query_code").agg(F.max(need).alias("need"), F.max(within).alias("within"))
        probes = asked.select("query_code", "need", "within", F.explode(_values(F.col("query_code"), cuts)).alias("at")).select("query_code", "need", "within", "at.*")
        probes = probes.filter(F.col("segment") < F.col("need"))
        for _ in range(radius):
            probes = _flipped(probes)
        near = _met(probes, index)
        if best is not None:
            near = near.unionByName(best.join(asked.hint("merge"), "query_code", "left_semi"))
        # k + 1 codes hold k ids besides the query's own
        once = near.groupBy("query_code", "code", "distance").agg(F.first("ids").alias("ids"))
        best = materialize(once.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).drop("n"))
        met_ids = left.withColumn("need", need).join(best.hint("merge"), "query_code")
        own = met_ids.select("query_id", "query_code", "need", "distance", F.explode("ids").alias("id")).filter("id != query_id")
        query = Window.partitionBy("query_id", "query_code")
        ranked = own.withColumn("rank", F.row_number().over(query.orderBy("distance", "id"))).filter(F.col("rank") <= k)
        ranked = ranked.withColumn("kth", F.max("distance").over(query)).withColumn("held", F.count("*").over(query))
        # beyond the longest segment every code has been met
        covered = (F.col("held") >= k) & (F.col("kth") < m * radius + F.col("need")) | F.lit(radius == longest)
        ranked = materialize(ranked.withColumn("covered", covered))
        done.append(ranked.filter("covered").select("query_id", "rank", "id", "distance"))
        if radius < longest:
            known = ranked.filter("rank = 1").select("query_id", "query_code", F.when(F.col("held") >= k, F.col("kth")).alias("kth"), "covered")
            met_before = left.drop("kth").join(known.hint("merge"), ["query_id", "query_code"], "left")
            left = materialize(met_before.filter(~F.coalesce("covered", F.lit(False))).drop("covered"))
            if left.isEmpty():
                break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of all vectors; queries are those whose vec_id is divisible by 100."""
    codes = materialize(table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")))
    found = hamming_top_k(codes, codes.filter(F.col("id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


_BITS = " + ".join(f"CASE WHEN coalesce(embedding[{i + 1}] > 0 AND NOT isnan(embedding[{i + 1}]), false) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(BITS))
TOP_K_SQL = f"""
WITH c AS (SELECT vec_id, {_BITS} AS code FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
h AS (
  SELECT vec_id, (code % 4294967296)::BIGINT AS lo, (code // 4294967296)::BIGINT AS hi FROM c
),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id, (bit_count(xor(q.lo, r.lo)) + bit_count(xor(q.hi, r.hi)))::BIGINT AS distance
  FROM h q JOIN h r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM d QUALIFY rank <= {K}
"""
