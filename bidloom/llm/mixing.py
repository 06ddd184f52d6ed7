"""Mixing sources to target weights along a curriculum.

Sources in code-point order (null last) weigh ``weights`` in turn and share all words; a target
stops at ``most`` times its source's size, and what is left over is shared again by weight.  Each
source also has a schedule: how much of its demand falls at which time of the training, as straight
lines between knots.  The schedule's integral is the source's cumulative demand; each copy of a
document begins where its source's supply stands at its turn, and the inverse of the demand gives
the time at which the training asks for it.  All copies are then range-sorted by time.

Supply: within a source documents come in the order of a hash of id and text, all once, then all
again, until the target is met.  The copy that crosses the target is cut there, so a source's words
equal its target rounded to a whole word, and no document is taken more than ``most`` times.

Skew: the running sums are those of range partitions of (source, hash), so a source with a third of
all rows spans many tasks.  Per source and partition one row of totals gives each partition its
start.  The driver sees only sums.

Defined edge cases: a null text has no words; a document without words is in the order nowhere and
takes nothing; null and repeated ids and repeated rows are rows of their own (equal rows are
interchangeable, so reruns agree); a null source is a source, after all others; very long texts
count whole and may be cut once; further columns pass through in the struct ``kept``; an empty
table gives an empty table; without any words all targets are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.common import whole_row, with_row_id
from bidloom.sources.shared import Workspace

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Schedule:
    """Weight over time as straight lines between knots (time from 0 to 1, weight); only its shape counts."""

    knots: tuple[tuple[float, float], ...]

    def pieces(self) -> list[tuple[float, float, float, float]]:
        """Per line: its start in time, the share of all demand before it, the weight there, its slope."""
        area, out = 0.0, []
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False):
            out.append((t0, area, w0, (w1 - w0) / (t1 - t0)))
            area += (t1 - t0) * (w0 + w1) / 2
        return [(t, a / area, w / area, m / area) for t, a, w, m in out]

    def time_of(self, share: Column) -> Column:
        """When a share of all demand has been asked for: the inverse of the integral."""
        lines, out = self.pieces(), None
        for k, (t0, before, w, m) in reversed(list(enumerate(lines))):
            y = F.greatest(share - before, F.lit(0.0))
            # The integral of a line is w*x + m*x*x/2; this root also holds for m = 0.
            x = F.when(y > 0, 2 * y / (w + F.sqrt(F.greatest(w * w + 2 * m * y, F.lit(0.0))))).otherwise(0.0)
            out = t0 + x if out is None else F.when(share < lines[k + 1][1], t0 + x).otherwise(out)
        return F.least(out, F.lit(1.0))


#: Steady, then early and late: general sources throughout, others at the start or the end.
CURRICULUM = (
    Schedule(((0.0, 1.0), (1.0, 1.0))),
    Schedule(((0.0, 1.5), (0.6, 1.0), (1.0, 0.25))),
    Schedule(((0.0, 0.25), (0.4, 1.0), (1.0, 1.5))),
)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``turn``, ``weight`` and ``target`` to sources (src, source_size).

    Each round shares what is left by weight and closes the sources that would pass their limit; only
    sums come to the driver.  A round closes one source or is the last.
    """
    n = sizes.withColumn("turn", F.row_number().over(W.orderBy("src")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long")
    n = n.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    total = n.agg(F.sum("source_size")).first()[0] or 0
    full, left, heavy = F.lit(False), total, None
    while True:
        sums = n.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("cap")))).first()
        if not sums[0] or sums[0] == heavy:
            break
        left, heavy = total - (sums[1] or 0), sums[0]
        full = F.col("weight") * F.lit(left) > F.col("cap") * F.lit(heavy)
    share = F.lit(0.0) if not heavy else F.col("weight") * F.lit(float(left)) / F.lit(float(heavy))
    return n.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(share)).drop("cap")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), curriculum: tuple[Schedule, ...] = CURRICULUM, most: int = 3,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(rows, order)``.

    ``rows`` has one row per document: rid, doc_id, size, source_size, target.  ``order`` has one
    per copy that the mix takes, sorted by ``time``: rid, doc_id, copy (from 0), words, time, and
    the named columns in ``kept``.
    """
    work = Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    label = F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    source = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    rows = with_row_id(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(label).alias("h"), *([whole_row(keep, "kept")] if keep else []),
    ))
    # Written once, so that the ranges that follow are those of the rows that are summed.
    rows = work.write(rows, "rows")
    ranges = rows.drop("kept").repartitionByRange("src", "h", "rid").withColumn("range", F.spark_partition_id())
    ranges = work.write(ranges, "ranges")
    totals = ranges.groupBy("src", "range").agg(F.sum("size").alias("words"))
    totals = work.write(totals, "totals")
    goals = work.write(targets(totals.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most), "goals")
    before = F.sum("words").over(W.partitionBy("src").orderBy("range")) - F.col("words")
    starts = totals.withColumn("before", before).join(goals, "src").drop("words")
    own = ranges.join(starts, ["src", "range"])
    at = F.sum("size").over(W.partitionBy("src", "range").orderBy("h", "rid")) - F.col("size") + F.col("before")
    own = work.write(own.withColumn("at", at).drop("h", "range", "before"), "supply")
    work.drop("ranges", "totals", "goals", *(() if keep else ("rows",)))
    goal = F.round("target").cast("long")
    copies = own.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("at", F.col("at") + F.col("copy") * F.col("source_size")).filter(F.col("at") < goal)
    share = F.col("at") / F.col("target")
    time = None
    for k, s in enumerate(curriculum):
        own_time = s.time_of(share)
        time = own_time if time is None else F.when(F.col("turn") % len(curriculum) == k, own_time).otherwise(time)
    order = copies.select("rid", "doc_id", "copy", F.least("size", goal - F.col("at")).alias("words"), time.alias("time"))
    order = order.join(rows.select("rid", "kept"), "rid") if keep else order
    order = order.repartitionByRange("time", "rid").sortWithinPartitions("time", "rid", "copy")
    return own.select("rid", "doc_id", "size", "source_size", "target"), order


def taken(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Per document the words that the mix takes, repeats counted."""
    none = F.lit(None)
    asked = order.select("rid", none.cast("long").alias("doc_id"), none.cast("long").alias("size"), none.cast("long").alias("source_size"),
                         none.cast("double").alias("target"), "words")
    both = rows.withColumn("words", F.lit(0).cast("long")).unionByName(asked)
    firsts = [F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return both.groupBy("rid").agg(*firsts, F.sum("words").alias("taken")).drop("rid")
