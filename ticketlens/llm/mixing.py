"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in a shuffled order. A document's virtual finish time is the number of its source's words up to and
including it, divided by the source's target; a second round of the source queues behind the first. Sorted by finish time, all
sources advance in proportion to their targets, and the mix is the beginning of that global order up to the total budget.

No queue and no order is ever one task: running sums are taken within ranges of the shuffle order, whose totals are summed
first; the place where the budget ends is found by two histograms of the finish times and a sort of the one narrow range
that holds it. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.frames import fresh, shuffled
from ticketlens.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
_CELLS = 4096
_FAR = 4 * _CELLS


@dataclass(frozen=True)
class MixPlan:
    """``weights`` are given to the sources in code point order, again and again; ``share`` of all words is the budget;
    no source and no document is taken more than ``rounds`` times. ``seed`` fixes the shuffle."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    rounds: int = 2
    seed: str = "mix"


def targets(sizes: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """From source and size: source, source_size, target. The budget is shared by weight; a target stops at ``plan.rounds``
    times its source's size, and what is left over is shared among the others, until none is above.

    Sources are ordered by the level at which they stop. Each is offered the level that those not yet stopped would
    reach; the first that does not stop there gives the final level. There is one row per source here.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.get(F.array(*[F.lit(w) for w in plan.weights]), (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(plan.weights))
    caps = sources.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * plan.rounds)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offered = caps.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(plan.share) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    open_ = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))
    final = offered.withColumn("final", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")), F.col("cap").cast("double"))
    return final.select("source", "source_size", target.alias("target"))


def _cell(finish: Column) -> Column:
    return F.least(F.floor(finish * _CELLS), F.lit(_FAR)).cast("bigint")


def _fine(finish: Column) -> Column:
    return F.least(F.floor((finish * _CELLS - _cell(finish)) * _CELLS), F.lit(_FAR)).cast("bigint")


def _ends_in(entries: DataFrame, cell: Column, done: int, budget: float) -> tuple[int, int] | None:
    """The first cell with which the budget is exceeded and the words before it; None if all fits."""
    sums = entries.groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"))
    running = sums.withColumn("upto", F.sum("words").over(Window.orderBy("cell")) + F.lit(done))
    row = running.filter(F.col("upto") > budget).orderBy("cell").select("cell", F.col("upto") - F.col("words")).first()
    return None if row is None else (row[0], row[1])


def queue(documents: DataFrame, plan: MixPlan = MixPlan(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of ``documents``: doc_id, source, size, source_size, target, copies (how often the mix takes it).

    Size is the number of words (runs without ASCII blanks); null, empty and blank texts have none and are never taken. Null is
    a source like others and the last one. Rows with equal id, source and size stand side by side in the queue and are
    taken alike. A null doc_id is shuffled like an id of its own. The mix ends before the first document that would exceed
    the budget. An empty table gives no rows. Other columns are ignored.
    """
    key = F.md5(F.concat(F.lit(plan.seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    docs = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        key.alias("key"),
    )
    docs = materialise(docs, "mix-sizes").withColumn("range", F.substring("key", 1, 3))
    ranges = docs.groupBy("source", "range").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    aims = targets(ranges, plan)
    starts = ranges.select("source", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").select(
        F.col("source").alias("s"), F.col("range").alias("r"), "start", "source_size", "target"
    )
    within = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "size"))
    queued = docs.withColumn("within", within).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    queued = materialise(
        queued.select("doc_id", "source", "size", "source_size", "target", "key", (F.col("start") + F.col("within")).alias("upto")), "mix-queue"
    )
    rounds = [((F.col("source_size") * i + F.col("upto")) / F.col("target")) for i in range(plan.rounds)]
    entries = queued.filter("size > 0").select("size", "key", F.posexplode(F.array(*rounds)).alias("round", "finish"))
    budget = (queued.agg(F.sum("size")).first()[0] or 0) * plan.share

    cell = _ends_in(entries, _cell(F.col("finish")), 0, budget)
    if cell is None:
        taken = F.lit(plan.rounds)
    else:
        inside = entries.filter(_cell(F.col("finish")) == cell[0])
        fine = _ends_in(inside, _fine(F.col("finish")), cell[1], budget)
        last = inside.filter(_fine(F.col("finish")) == fine[0])
        running = last.withColumn("upto", F.sum("size").over(Window.orderBy("finish", "key", "round")) + F.lit(fine[1]))
        fits = running.filter(F.col("upto") <= budget).agg(F.max(F.struct("finish", "key", "round")).alias("m")).first().m

        def is_taken(finish: Column, number: int) -> Column:
            before = (_cell(finish) < cell[0]) | ((_cell(finish) == cell[0]) & (_fine(finish) < fine[0]))
            if fits is None:
                return before
            here = (_cell(finish) == cell[0]) & (_fine(finish) == fine[0])
            own = F.struct(finish, F.col("key"), F.lit(number))
            return before | here & (own <= F.struct(F.lit(fits.finish), F.lit(fits.key), F.lit(fits.round)))

        taken = sum((is_taken(f, i).cast("int") for i, f in enumerate(rounds)), F.lit(0))
    copies = F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("int")
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(documents: DataFrame, plan: MixPlan = MixPlan(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows of ``documents``, all its columns, each as often as the mix takes it."""
    places = queue(documents, plan, doc_id, text, source).filter("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    ).distinct()
    docs = documents.alias("d")
    size = F.regexp_count(F.col(f"d.{text}"), F.lit(WORD)).cast("bigint")
    joined = docs.join(
        shuffled(places).alias("p"),
        F.col(f"d.{doc_id}").eqNullSafe(F.col("p._id")) & F.col(f"d.{source}").eqNullSafe(F.col("p._source")) & (size == F.col("p._size")),
    )
    again = F.explode(F.sequence(F.lit(1), F.col("p._copies"))).alias(fresh("_copy", documents.columns))
    return joined.select("d.*", again).select(*[F.col(f"`{c}`") for c in documents.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM l WHERE cap::DOUBLE / weight > level ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT final FROM f) * weight), cap::DOUBLE) AS target FROM l),
q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, size) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT doc_id, key, size, 0 AS round, upto::DOUBLE / target AS finish FROM q WHERE size > 0
  UNION ALL SELECT doc_id, key, size, 1, (source_size + upto)::DOUBLE / target FROM q WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, key, round) AS total FROM e),
x AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM g WHERE total <= (SELECT sum(size) * 1.5::DOUBLE FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN x USING (doc_id)
"""
