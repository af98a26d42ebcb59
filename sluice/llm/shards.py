"""Contiguous shards of least largest size over atomic groups of equal texts.

Rows with equal texts form an atomic group. Groups are ordered by the hash of
their text, and the order is cut into a fixed number of hash slots, the atoms
of the partition. So the list that is searched has a proven length however
many rows there are, and equal texts never part. On that list a binary search
finds the smallest capacity for which greedy filling needs no more shards than
there are. Cuts are then placed within that capacity as near to equal shares
as the rest allows: no shard is larger than the capacity.

Everything is DataFrame and SQL functions; the list is one row of at most
``SLOTS`` numbers.

Null text: as empty, size ``overhead`` only. Null ids and repeated rows get
slots of their own. With fewer groups than shards some shards stay empty. An
empty table gives no rows. Other columns are unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.common import written
from sluice.llm.registry import query

SLOTS = 1 << 16
CELLS = 512
OVERHEAD = 8

#: Shards that greedy filling to capacity ``cap`` needs for ``sizes``.
_NEEDED = """aggregate(sizes, struct(1L AS n, 0L AS used), (s, v) -> IF(s.used + v <= {cap}, struct(s.n AS n, s.used + v AS used),
    struct(s.n + 1 AS n, v AS used)), s -> s.n)"""

#: Smallest capacity between the mean (and largest atom) and the total.
_CAPACITY = f"""aggregate(sequence(1, 64), struct(greatest(total div {{shards}}, largest) AS lo, total AS hi), (b, i) ->
    IF(b.lo >= b.hi, b, IF({_NEEDED.format(cap='(b.lo + (b.hi - b.lo) div 2)')} <= {{shards}},
    struct(b.lo AS lo, b.lo + (b.hi - b.lo) div 2 AS hi), struct(b.lo + (b.hi - b.lo) div 2 + 1 AS lo, b.hi AS hi))), b -> b.hi)"""

#: From the right, the first atom of the longest end that fits into 1, 2, ... shards.
_ENDS = """aggregate(reverse(sizes), struct(array(CAST(size(sizes) AS INT)) AS at, 0L AS used), (s, v) ->
    IF(s.used + v <= capacity, struct(concat(slice(s.at, 1, size(s.at) - 1), array(s.at[size(s.at) - 1] - 1)) AS at, s.used + v AS used),
    struct(concat(s.at, array(s.at[size(s.at) - 1] - 1)) AS at, v AS used)), s -> s.at)"""

#: Walk from the left. A shard closes when the next atom would pass the capacity, or when the rest
#: fits into the shards left and closing now is nearer to an equal share of what is left.
_CUTS = """aggregate(sizes, struct(CAST(array() AS ARRAY<INT>) AS cuts, 0L AS used, 0L AS before, 0 AS i), (s, v) ->
    IF(s.i > 0 AND size(s.cuts) < {shards} - 1 AND (s.used + v > capacity
        OR (s.i >= coalesce(get(ends, {shards} - 2 - size(s.cuts)), 0)
            AND 2 * s.used + v > 2 * ((total - s.before) / ({shards} - size(s.cuts))))),
      struct(concat(s.cuts, array(s.i)) AS cuts, v AS used, s.before + s.used AS before, s.i + 1 AS i),
      struct(s.cuts AS cuts, s.used + v AS used, s.before AS before, s.i + 1 AS i)), s -> s.cuts)"""


def minimax(atoms: DataFrame, order: str, size: str, shards: int) -> DataFrame:
    """One row: the least capacity and the ``order`` values at which shards 1, 2, ... begin.

    ``atoms`` has one row per atom and a proven bound on their number.
    """
    listed = atoms.agg(F.expr(f"array_sort(collect_list(struct({order} AS k, CAST({size} AS LONG) AS v)))").alias("list")).selectExpr(
        "list.k AS keys", "list.v AS sizes", "aggregate(list.v, 0L, (a, v) -> a + v) AS total", "array_max(list.v) AS largest")
    # Generated rows are a barrier: else each step of a walk would hold the whole search before it.
    found = listed.selectExpr(f"inline(array(struct(*, {_CAPACITY.format(shards=shards)} AS capacity)))")
    found = found.selectExpr(f"inline(array(struct(*, {_ENDS} AS ends)))")
    return found.selectExpr(f"inline(array(struct(*, {_CUTS.format(shards=shards)} AS cuts)))").selectExpr(
        "capacity", "transform(cuts, i -> keys[i]) AS starts")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Shard of each row, its size, and its place in the shard.

    The text is read once; what goes on is 28 bytes a row. Places are numbered
    in cells of a shard that depend on the id, so copies do not meet in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                               F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.expr(f"pmod(xxhash64(coalesce(CAST({text_col} AS STRING), '')), {SLOTS})").cast("int").alias("atom")), "sizes")
    cuts = minimax(rows.groupBy("atom").agg(F.sum("size").alias("bytes")), "atom", "bytes", shards)
    placed = rows.withColumn("starts", cuts.select("starts").scalar()).selectExpr(
        "doc_id", "size", "text_crc32", "size(filter(starts, c -> c <= atom)) AS shard",
        f"CAST(pmod(xxhash64(doc_id, 7), {CELLS}) AS INT) AS cell")
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.selectExpr("shard", "cell", "sum(n) OVER (PARTITION BY shard ORDER BY cell) - n AS base")
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, cell ORDER BY doc_id, text_crc32, size) - 1 AS nth")
    return numbered.join(bases, ["shard", "cell"]).selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "base + nth AS slot", "CAST(NULL AS INT) AS grown_shard")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
