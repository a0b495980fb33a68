"""Peak concurrency by a sweep over dyadic time nodes.

Time is counted in units from the first moment on, and the axis is a binary tree: a leaf for each unit, a node for each aligned
span of 2, 4, 8 ... of them, numbered as in a heap (the root is 1, the parent of i is i // 2). An interval is the disjoint union of
at most two nodes a level; the nodes' counts and sums are added up, and the state at a moment is the sum over its leaf's
ancestors, found by equi-join.

No key of a join is hot, whatever the group: the levels are joined in tiers of a few at a time, and below a tier's node there are
at most 2 ** levels points of the tier below, which take the tier's sum on. The running maximum is scanned in blocks of moments:
each block's own maxima first, then a scan over one row a block. So nothing that grows with the rows, only what grows with the
length of the time axis (a row for 1,024 units and key), lies in one task.

Cases: intervals without a start, or that don't end after it, take no part; no end means open for ever; a null value counts as 0; a
null key counts for `everything` only; equal rows count each; moments at which nothing changes in sum are left out; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .common import materialize

#: Levels of the first tier and of the others, and the bits of a block of the scan.
FIRST_TIER, TIER, BLOCK_BITS = 4, 8, 10


def minutes(df: DataFrame, column: str) -> Column:
    """Whole minutes since 1970 of a time, UTC; a time without a zone is read as UTC whatever the session's zone is."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, TimestampNTZType):
        return F.unix_date(F.to_date(c)).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return F.floor(F.unix_seconds(c) / 60).cast("long")


def node_sums(intervals: DataFrame, height: int) -> DataFrame:
    """key, node, n, value: the sums of the intervals (key, first, last, value; last is excluded and may be null) by dyadic node."""
    end = F.coalesce("last", F.lit(1 << height))
    levels = F.sequence(F.lit(0), F.least(F.lit(height), F.floor(F.log2(end - F.col("first"))).cast("int") + 1))
    rows = intervals.select("key", "value", "first", end.alias("last"), F.explode(levels).alias("l"))
    # what a level is left to cover: from the first whole span on to the last one; an odd border goes to this level's node
    rows = rows.selectExpr("key", "value", f"shiftleft(1L, {height} - l) AS base", "shiftright(first + shiftleft(1L, l) - 1, l) AS a", "shiftright(last, l) AS b").where("a < b")
    both = F.array(F.expr("if(a % 2 = 1, base + a, null)"), F.expr("if(b % 2 = 1, base + b - 1, null)"))
    return rows.select("key", "value", F.explode(both).alias("node")).where("node IS NOT NULL").groupBy("key", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def ancestor_sums(points: DataFrame, nodes: DataFrame, level: int, height: int) -> DataFrame:
    """key, node, n, value: for each point (key, node; of one level) the sums over itself and all nodes above it."""
    tier = min(FIRST_TIER if level == 0 else TIER, height + 1 - level)
    up = points.select("key", F.col("node").alias("point"), F.explode(F.sequence(F.lit(0), F.lit(tier - 1))).alias("l")).selectExpr("key", "point", "shiftright(point, l) AS node")
    low, high = 1 << (height - level - tier + 1), 1 << (height - level + 1)
    met = up.join(nodes.where((F.col("node") >= low) & (F.col("node") < high)).hint("merge"), ["key", "node"]).select("key", F.col("point").alias("node"), "n", "value")
    zero = F.lit(0).cast("long")  # a point without any node has a row too
    sums = met.unionByName(points.select("key", "node", zero.alias("n"), zero.alias("value")))
    if level + tier <= height:
        over = F.expr(f"shiftright(node, {tier})").alias("over")
        above = ancestor_sums(points.select("key", over).distinct().withColumnRenamed("over", "node"), nodes, level + tier, height)
        inherited = points.select("key", "node", over).join(above.withColumnRenamed("node", "over").hint("merge"), ["key", "over"])
        sums = sums.unionByName(inherited.select("key", "node", "n", "value"))
    return sums.groupBy("key", "node").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def with_all(sums: DataFrame, by: str, everything: int | None) -> DataFrame:
    """The sums by (key, `by`), and those of all keys together under the key `everything`."""
    if everything is None:
        return sums
    whole = sums.groupBy(by).agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    return sums.unionByName(whole.select(F.lit(everything).cast(sums.schema["key"].dataType).alias("key"), by, "n", "value"))


def concurrency(intervals: DataFrame, everything: int | None = None) -> DataFrame:
    """intervals (key, start, end, value: longs but the key; end excluded, null: for ever) -> key, at, n, value, next_at, high_n, is_peak.

    A row for each key and moment at which the number of open intervals or the sum of their values changes, with both after the
    change; next_at: the key's next row; high_n: the largest n of the key so far; is_peak: value is the key's largest. The key
    `everything`, if given, stands for all intervals together."""
    value = F.coalesce(F.col("value"), F.lit(0)).cast("long")
    rows = intervals.where("start IS NOT NULL AND (end IS NULL OR end > start)").select("key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), value.alias("value"))
    rows = materialize(rows, "sweep-intervals")
    origin, last = rows.agg(F.min("start"), F.max(F.greatest("start", F.coalesce("end", "start")))).first()
    origin, last = origin or 0, last or 0
    height = max(1, (last - origin).bit_length())
    placed = rows.select("key", (F.col("start") - origin).alias("first"), (F.col("end") - origin).alias("last"), "value")

    steps = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n"), F.col("value")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("n"), (-F.col("value")).alias("value")))
    steps = placed.select("key", F.inline(steps)).where("at IS NOT NULL").groupBy("key", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    leaf = (F.col("at") + (1 << height)).alias("node")
    points = materialize(with_all(steps, "at", everything).where("n <> 0 OR value <> 0").select("key", leaf), "sweep-moments").where("key IS NOT NULL")
    nodes = materialize(with_all(node_sums(placed, height), "node", everything), "sweep-nodes").where("key IS NOT NULL")

    state = ancestor_sums(points, nodes, 0, height).select("key", (F.col("node") - (1 << height) + origin).alias("at"), "n", "value")
    return scan(materialize(state, "sweep-states"))


def scan(state: DataFrame) -> DataFrame:
    """The rows (key, at, n, value) with next_at, high_n and is_peak, by blocks."""
    rows = state.withColumn("block", F.expr(f"shiftright(at, {BLOCK_BITS})"))
    block = rows.groupBy("key", "block").agg(F.max("n").alias("most"), F.max("value").alias("top"), F.min("at").alias("first_at"))
    order = Window.partitionBy("key").orderBy("block")
    before = F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1))
    block = block.select("key", "block", before.alias("before"), F.lead("first_at").over(order).alias("after"), F.max("top").over(Window.partitionBy("key")).alias("peak"))
    within = Window.partitionBy("key", "block").orderBy("at")
    rows = rows.withColumns({"next_in": F.lead("at").over(within), "high_in": F.max("n").over(within)})
    both = rows.join(block.hint("merge"), ["key", "block"])
    return both.select("key", "at", "n", "value", F.coalesce("next_in", "after").alias("next_at"), F.greatest("high_in", "before").alias("high_n"), (F.col("value") == F.col("peak")).alias("is_peak"))


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, hold_days: int = 7) -> DataFrame:
    """The intervals of concurrency(), in minutes: a sale is open from sold_at until hold_days after its earliest shipped line.
    key: the nation of its client, -1 if unknown; of several rows of a client the smallest nation. value: its total in cents; a
    total that is no finite number counts as 0."""
    shipped = lines.select("sale_id", minutes(lines, "shipped_at").alias("shipped")).where("shipped IS NOT NULL AND sale_id IS NOT NULL").groupBy("sale_id").agg(F.min("shipped").alias("shipped"))
    # written, so that the join reads both sides from a shuffle of their own and a hot client's part can be split
    nations = materialize(clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("nation_id").alias("nation")), "sweep-nations")
    cents = F.floor(F.lit(100.0) * F.col("total") + 0.5)
    sold = sales.select("sale_id", "client_id", minutes(sales, "sold_at").alias("start"), F.when(F.abs("total") < 9e16, cents).cast("long").alias("value")).where("start IS NOT NULL")
    both = sold.join(shipped.hint("merge"), "sale_id", "left").withColumn("end", F.col("shipped") + hold_days * 1440).where("end IS NULL OR end > start")
    named = both.join(nations.hint("merge"), "client_id", "left")
    return named.select(F.coalesce("nation", F.lit(-1)).cast("int").alias("key"), "start", "end", "value")
