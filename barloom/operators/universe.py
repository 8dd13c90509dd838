"""Membership of an index over time, as validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def intervals(constituents: DataFrame, changes: DataFrame) -> DataFrame:
    """symbol, valid_from, valid_to (exclusive; null: open) from today's constituents(symbol) and dated changes(date, added, removed).

    Stays are read backward from today: a member without an addition after its last removal has been one from the start (valid_from null).
    """
    moves = changes.select("date", C("added").alias("symbol"), F.lit(1).alias("step")).union(changes.select("date", C("removed").alias("symbol"), F.lit(-1).alias("step"))).where("symbol is not null")
    order = Window.partitionBy("symbol").orderBy("date", "step")
    seen = moves.withColumn("next", F.lead(F.struct("date", "step")).over(order)).withColumn("nth", F.row_number().over(order))
    stays = seen.where("step = 1").select("symbol", C("date").alias("valid_from"), F.when(C("next.step") == -1, C("next.date")).alias("valid_to"))
    early = seen.where("nth = 1 and step = -1").select("symbol", F.lit(None).cast("date").alias("valid_from"), C("date").alias("valid_to"))
    always = constituents.select("symbol").distinct().join(moves.select("symbol"), "symbol", "left_anti").select("symbol", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return stays.unionByName(early).unionByName(always)


def _on_dates(membership: DataFrame, dates: DataFrame) -> DataFrame:
    """Stays and the dates that lie in them. Both sides are dealt out by month, so that neither must be sent whole."""
    days = dates.select("date").distinct().withColumn("_month", F.trunc("date", "month"))
    lo, hi = (F.lit(x).cast("date") for x in days.agg(F.min("date"), F.max("date")).first())
    span = F.sequence(F.trunc(F.greatest(F.coalesce("valid_from", lo), lo), "month"), F.least(F.coalesce("valid_to", hi), hi), F.expr("interval 1 month"))
    some = membership.where((F.coalesce("valid_from", lo) <= hi) & (F.coalesce("valid_to", hi) >= lo) & (F.coalesce("valid_from", lo) <= F.coalesce("valid_to", hi)))
    on = (C("valid_from").isNull() | (C("valid_from") <= C("date"))) & (C("valid_to").isNull() | (C("date") < C("valid_to")))
    return some.withColumn("_month", F.explode(span)).join(days, "_month").where(on).drop("_month")


def members(membership: DataFrame, dates: DataFrame) -> DataFrame:
    """date, symbol of the members on each of dates(date)."""
    return _on_dates(membership, dates).select("date", "symbol").distinct()


def detail(membership: DataFrame, dates: DataFrame, delisted: DataFrame) -> DataFrame:
    """Members with active_from, active_to and the delisting (symbol, delisting_date, reason) known on the date."""
    out = _on_dates(membership, dates).join(delisted, "symbol", "left")
    return out.select("date", "symbol", C("valid_from").alias("active_from"), C("valid_to").alias("active_to"), "delisting_date", "reason", F.coalesce(C("delisting_date") <= C("date"), F.lit(False)).alias("is_delisted"))
