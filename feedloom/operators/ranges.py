"""Closed id ranges against row ids by rank: counts (J2, A5, A10) and owners (W5, J3), without a nested loop.

*Rank.* Ids fall into blocks of 2**BLOCK_BITS. How many ids lie at or below a
point is the number of ids in all earlier blocks plus the number in its own block up to
it. The first part is an exclusive running sum over the block counts (blocks
are summed to groups of 2**GROUP_BITS blocks, groups have their own running sum),
so no id is moved for it: ids are counted map-side first. The second is a running
count inside a block, and only the ids of blocks that hold a point take part. A
range then holds rank(end) - rank(start - 1) ids, whatever its width. Every window
partition is bounded: 2**BLOCK_BITS ids and as many points in a block,
2**GROUP_BITS blocks in a group, and one row per group (2**21 for ids below 2**53).

*Owners.* All starts and all ends + 1, ranked, cut the ids into elementary
intervals, and a range is a stretch of these ranks. It is cut into dyadic nodes over the
ranks (at most two per level), each node keeps its least owner, and an interval takes the
least of the nodes above it. (Nodes above NODE_BITS levels are met once per 2**NODE_BITS
intervals, so the few top nodes don't gather one row per interval.) What is
left is a step function from ids to owners, one row per elementary
interval. A row finds its owner by its block: the steps inside the block (binary
search) and the owner that holds where the block begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import search

BLOCK_BITS = 12
GROUP_BITS = 20
NODE_BITS = 10
TOP_LEVEL = 45  # of the dyadic nodes: more elementary intervals than ids of 2**44 ranges


_EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _block(x: Column) -> Column:
    return F.shiftright(x, BLOCK_BITS)


def _ranks(points: str, ids: str) -> str:
    """Common table expressions that end in ranks(b, x, rank): per point the number of ids at or below it.

    ``points``: a query of (b, x), repeats allowed; ``ids``: a query of (b, x)."""
    return f"""
points AS (SELECT DISTINCT b, x FROM (SELECT /*+ REPARTITION(b) */ b, x FROM ({points}))),
own AS ({ids}),
edge AS (SELECT DISTINCT b FROM points),
counts AS (SELECT b, shiftright(b, {GROUP_BITS}) AS g, sum(n) AS n
           FROM (SELECT b, 1L AS n FROM own UNION ALL SELECT b, 0L FROM edge) GROUP BY b),
outside AS (SELECT g, coalesce(sum(n) OVER (PARTITION BY 0 ORDER BY g {_EARLIER}), 0L) AS n
            FROM (SELECT g, sum(n) AS n FROM counts GROUP BY g)),
inside AS (SELECT b, g, coalesce(sum(n) OVER (PARTITION BY g ORDER BY b {_EARLIER}), 0L) AS n FROM counts),
before AS (SELECT b, inside.n + outside.n AS n FROM inside JOIN outside USING (g)),
near AS (SELECT b, x, 1 AS w FROM own LEFT SEMI JOIN edge USING (b) UNION ALL SELECT b, x, 0 FROM points),
within AS (SELECT b, x, w, sum(w) OVER (PARTITION BY b ORDER BY x, w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM near),
ranks AS (SELECT b, x, c + n AS rank FROM within JOIN before USING (b) WHERE w = 0)"""


def _placed(query: str) -> str:
    return f"SELECT shiftright(x, {BLOCK_BITS}) AS b, x FROM {query}"


def count_in_ranges(ranges: DataFrame, rows: DataFrame, key: str = "id", start: str = "feedback_id_start",
                    end: str = "feedback_id_end", id_col: str = "id", out: str = "covered_count") -> DataFrame:
    """For every range row, the number of ``rows`` with start <= id <= end (0 when none).

    Returns (key, out) for every row of ``ranges`` (left outer semantics). Equal ranges are counted once. An end that very
    many ranges share is one join key; adaptive execution splits it.
    """
    own = ranges.select(F.col(key).alias("key"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    counted = ranges.sparkSession.sql(f"""
WITH spans AS (SELECT DISTINCT s, e FROM {{own}} WHERE s <= e),
ends AS (SELECT s, e, shiftright(x, {BLOCK_BITS}) AS b, x, sign
         FROM spans LATERAL VIEW stack(2, s - 1, -1, e, 1) v AS x, sign),
{_ranks("SELECT b, x FROM ends", _placed("{ids}"))},
total AS (SELECT s, e, sum(sign * rank) AS n FROM ends JOIN ranks USING (b, x) GROUP BY s, e)
SELECT key, coalesce(n, 0L) AS n FROM {{own}} LEFT JOIN total USING (s, e)
""", own=own, ids=rows.select(F.col(id_col).cast("long").alias("x")))
    return counted.select(F.col("key").alias(key), F.col("n").alias(out))


def _nodes(a: Column, b: Column) -> Column:
    """The dyadic nodes (level, node of 2**level ranks) that tile the ranks [a, b) exactly, at most two per level:
    on the way up one is cut off where the left bound is odd and one where the right bound is."""
    def level(k):
        up = lambda x: F.call_function("shiftright", x, k)
        right = up(b)
        left = -up(-a)  # rounded up
        odd = F.pmod(left, 2) == 1
        inner = left + F.pmod(left, 2)
        return F.array(F.when(odd & (left < right), F.struct(k.alias("level"), left.alias("node"))),
                       F.when((F.pmod(right, 2) == 1) & (inner < right), F.struct(k.alias("level"), (right - 1).alias("node"))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), level)), lambda p: p.isNotNull())


def owner_steps(ranges: DataFrame, owner: Column, start: str = "feedback_id_start", end: str = "feedback_id_end") -> DataFrame:
    """(_x, _rank, _own): from id ``_x`` up to the next row's, ``_own`` is the least owner of the ranges that cover it
    (NULL where none does). One row per distinct start or end + 1."""
    from ..session import shared_dir

    spark = ranges.sparkSession
    shared_dir(spark)  # the cluster's checkpoint folder
    keyed = (ranges.select(F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), owner.alias("_own"))
             .filter("_s <= _e").groupBy("_s", "_e").agg(F.min("_own").alias("_own")))
    ends = keyed.select("_s", "_e", "_own", F.explode(F.array("_s", F.col("_e") + 1)).alias("_x"))
    points = ends.select(F.col("_x").alias("x")).distinct()
    ranks = (spark.sql(f"WITH {_ranks(_placed('{points}'), _placed('{points}'))} SELECT x AS _x, rank AS _rank FROM ranks", points=points)
             .checkpoint(eager=True))  # 1, 2, ...; of the ranges' side, met four times below
    spans = (ends.join(ranks, "_x").groupBy("_s", "_e")
             .agg(F.min("_rank").alias("_a"), F.max("_rank").alias("_z"), F.first("_own").alias("_own")))
    nodes = (spans.select(F.explode(_nodes(F.col("_a"), F.col("_z"))).alias("_p"), "_own")
             .groupBy("_p.level", "_p.node").agg(F.min("_own").alias("_own")))

    def least(of: DataFrame, col: str, low: int, high: int, out: str) -> DataFrame:
        """The least owner of the nodes of levels low to high above each place of ``col``, counted in 2**low ranks."""
        up = F.call_function("shiftright", F.col(col), F.col("level") - low)
        return (of.select(col, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("level"))
                .select(col, "level", up.alias("node")).join(nodes, ["level", "node"]).groupBy(col).agg(F.min("_own").alias(out)))

    placed = ranks.withColumn("_chunk", F.shiftright("_rank", NODE_BITS))
    low = least(placed, "_rank", 0, NODE_BITS - 1, "_low")
    high = least(placed.select("_chunk").distinct(), "_chunk", NODE_BITS, TOP_LEVEL, "_high")
    return (placed.join(low, "_rank", "left").join(high, "_chunk", "left")
            .select("_x", "_rank", F.least("_low", "_high").alias("_own")).checkpoint(eager=True))


def first_owner(rows: DataFrame, ranges: DataFrame, owner: Column, start: str = "feedback_id_start",
                end: str = "feedback_id_end", id_col: str = "id", out: str = "owner") -> DataFrame:
    """Every row of ``rows`` (ids unique) with the least ``owner`` value among the ranges
    covering its id (NULL when none covers it). ``owner`` is an orderable expression over
    ``ranges`` (e.g. struct(purged_at, mr_id)).
    """
    return owner_at(rows, owner_steps(ranges, owner, start, end), id_col, out)


def owner_at(rows: DataFrame, steps: DataFrame, id_col: str = "id", out: str = "owner") -> DataFrame:
    """``rows`` with the owner that the steps give at their ids.

    The rows meet one row per block, by equality of the block: where the ranges are few that table is broadcast (by its
    measured size) and the rows are not shuffled at all. A block holds at most 2**BLOCK_BITS rows.
    """
    steps = steps.select(_block(F.col("_x")).alias("_b"), "_x", "_own")
    listed = (steps.groupBy(F.col("_b").alias("b")).agg(F.sort_array(F.collect_list(F.struct("_x", "_own"))).alias("l"),
                                                        F.max_by(F.struct("_own"), F.col("_x")).alias("last"))
              .select("b", "last", F.col("l._x").alias("xs"), F.col("l._own").alias("owns")))
    base = rows.withColumn("_b", _block(F.col(id_col).cast("long")))
    table = rows.sparkSession.sql(f"""
WITH blocks AS (SELECT b, last, xs, owns, shiftright(b, {GROUP_BITS}) AS g
                FROM (SELECT DISTINCT _b AS b FROM {{occupied}}) FULL JOIN {{listed}} USING (b)),
outside AS (SELECT g, last(last, true) OVER (PARTITION BY 0 ORDER BY g {_EARLIER}) AS carried
            FROM (SELECT g, max_by(last, CASE WHEN last IS NOT NULL THEN b END) AS last FROM blocks GROUP BY g)),
inside AS (SELECT b, g, xs, owns, last(last, true) OVER (PARTITION BY g ORDER BY b {_EARLIER}) AS carried FROM blocks)
SELECT b AS _b, xs AS _xs, owns AS _owns, coalesce(inside.carried, outside.carried)._own AS _before
FROM inside JOIN outside USING (g) WHERE xs IS NOT NULL OR coalesce(inside.carried, outside.carried)._own IS NOT NULL
""", occupied=base.select("_b"), listed=listed)
    found = base.join(table, "_b", "left").withColumn("_at", search(F.col("_xs"), F.col(id_col).cast("long"), 1 << BLOCK_BITS))
    own = F.when(F.col("_at") > 0, F.get("_owns", F.col("_at") - 1)).otherwise(F.col("_before"))
    return found.withColumn(out, own).drop("_b", "_xs", "_owns", "_at", "_before")


def count_by_owner(ids: DataFrame, steps: DataFrame, id_col: str = "id", out: str = "n") -> DataFrame:
    """A10: (_own, out): the number of ``ids`` each owner of the steps has, from ranks alone: a step adds the ids below it to the
    owner that ends there and takes them from the one that begins."""
    return ids.sparkSession.sql(f"""
WITH moved AS (
  SELECT s._x - 1 AS x, shiftright(s._x - 1, {BLOCK_BITS}) AS b, own, sign
  FROM {{steps}} AS s LEFT JOIN {{steps}} AS p ON s._rank = p._rank + 1
       LATERAL VIEW stack(2, p._own, 1, s._own, -1) v AS own, sign
  WHERE own IS NOT NULL),
{_ranks("SELECT b, x FROM moved", _placed("{ids}"))}
SELECT own AS _own, CAST(sum(sign * rank) AS BIGINT) AS {out} FROM moved JOIN ranks USING (b, x) GROUP BY own
""", steps=steps, ids=ids.select(F.col(id_col).cast("long").alias("x")))
