"""Batches of changes applied to stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.functions import patterns as P
from bidloom.functions import text as T
from bidloom.sources.shared import Workspace


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last version of each key; an aggregation, so old and new partial results combine map-side."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new.select(old.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose group is not in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def valid_decisions(rows: DataFrame) -> DataFrame:
    """Adds ``ok``: the bidder id is a UUID and the criterion is not empty."""
    ok = F.col("bidder_id").rlike(P.UUID) & (F.coalesce("criterion_id", F.lit("")) != "")
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


class NoValidDecisions(ValueError):
    """A batch without one valid decision; its rows are in ``quarantine``."""

    def __init__(self, rows: int, quarantine: DataFrame):
        super().__init__(f"none of {rows} decisions is valid")
        self.quarantine = quarantine


def admit_decisions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)`` of a batch, written and counted in one pass; without a good row an error.

    Nothing is stored where later steps look until the counts are in, so a refused batch changes
    nothing, and its rows can be looked into.
    """
    seen = Observation("decisions")
    marked = valid_decisions(rows).observe(seen, F.count("*").alias("rows"), F.count_if("ok").alias("good"))
    stored = Workspace(rows.sparkSession).write(marked, "decisions")
    good, bad = (stored.filter(c).drop("ok") for c in ("ok", "not ok"))
    if not seen.get["good"]:
        raise NoValidDecisions(seen.get["rows"], bad)
    return good, bad


def patch(base: DataFrame, patches: DataFrame, key: str, version: str, columns: list[str], named: str | None = None) -> DataFrame:
    """All patches of each row merged in order of ``version``: of each column the latest value that a patch sets.

    A patch sets the columns that the array column ``named`` lists, null included; without it those
    that are not null.  The key stays.  One aggregation, so many patches of one row combine map-side.
    """

    def last(c: str):
        says = F.array_contains(named, c) if named else F.col(c).isNotNull()
        return F.max_by(F.struct(F.col(c).alias("x")), F.when(says, F.col(version))).alias(c)

    merged = patches.groupBy(key).agg(*[last(c) for c in columns]).select(key, F.struct(*columns).alias("p"))
    return base.join(merged, key, "left").select(
        *[F.when(F.col(f"p.{c}").isNotNull(), F.col(f"p.{c}.x")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    )


def patch_extras(base: DataFrame, patches: DataFrame, key: str, version: str, extras: str) -> DataFrame:
    """Shallow merge of a map column: of each map key the latest value that any patch or the row has."""
    entries = lambda df, v: df.select(key, v.alias("v"), F.explode(extras).alias("k", "x"))
    both = entries(base, F.lit(None).cast(patches.schema[version].dataType)).unionByName(entries(patches, F.col(version)))
    last = both.groupBy(key, "k").agg(F.max_by(F.struct("x"), F.struct("v")).alias("x"))
    made = last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "x.x")))).alias("made"))
    return base.join(made, key, "left").withColumn(extras, F.coalesce("made", extras)).drop("made")


def same_value(number, text):
    """Numbers compare as numbers, anything else as text; null is the empty text."""
    return F.coalesce(number.try_cast("double").cast("string"), text, F.lit(""))


def new_criteria(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch that are stored nowhere and first of their kind in the batch."""
    keys = ["tender_id", "field", "operator", "v"]
    form = lambda df: df.withColumn("v", same_value(F.col("value"), F.col("value"))).withColumn(
        "field", F.coalesce("field", F.lit(""))).withColumn("operator", F.coalesce("operator", F.lit("")))
    first = form(batch).groupBy(*keys).agg(F.min_by(F.struct("id", "value"), "id").alias("r"))
    return first.join(form(stored).select(*keys).distinct(), keys, "left_anti").select("r.id", "tender_id", "field", "operator", "r.value")


def manual_criteria(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Criteria that officers enter: a confidence that is none counts as 1; ``accepted`` is false where the rule is there already."""
    c = F.col("confidence")
    rows = batch.withColumn("confidence", F.when((c <= 0) | (c > 1) | c.isNull(), 1.0).otherwise(c))
    new = new_criteria(batch, stored).select("id", F.lit(True).alias("new"))
    return rows.join(new, "id", "left").withColumn("accepted", F.coalesce("new", F.lit(False))).drop("new")


def audit_rows(log: DataFrame) -> DataFrame:
    """Redacted payload and checksum of each entry, over JSON of fixed field order; empty ids become null."""
    payload = F.to_json(F.struct("action", T.redact(F.col("note")).alias("note")))
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")).cast(log.schema[c].dataType).alias(c) for c in ("tender_id", "user_id")]
    return log.select("id", *ids, "action", payload.alias("payload"), T.checksum(payload).alias("checksum"), "created_at")


def page(df: DataFrame, key: str, order: list, limit: int = 50, offset: int = 0, total: bool = True) -> DataFrame:
    """A page of every key, with the key's total if asked: limit 0 is 50, at most 200, nothing negative.

    Ranks are cut to the page before the shuffle and totals are an aggregation of their own, so no
    task sorts a whole key.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    limit = min(limit or 50, 200)
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    out = out.filter(F.col("rank") <= offset + limit).filter(F.col("rank") > offset)
    if not total:
        return out
    n = df.groupBy(F.col(key).alias("page_key")).agg(F.count("*").alias("total"))
    return out.join(n, F.col(key).eqNullSafe(F.col("page_key")), "left").drop("page_key")


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None = None, limit: int = 50) -> DataFrame:
    """The page of the whole table that follows the row ``after`` in ``order`` (column, descending), with the total.

    ``after`` has that row's values of the order columns; without it the first page.  Each task keeps
    its own first rows only, so a page costs one pass wherever it lies, and nothing is ranked.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = df
    if after is not None:
        tests, same = F.lit(False), F.lit(True)
        for (c, descending), x in zip(order, after, strict=True):
            tests = tests | (same & (F.col(c) < F.lit(x) if descending else F.col(c) > F.lit(x)))
            same = same & (F.col(c) == F.lit(x))
        rows = df.filter(tests)
    page_ = rows.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).limit(min(limit or 50, 200))
    return page_.join(F.broadcast(df.agg(F.count("*").alias("total"))))
