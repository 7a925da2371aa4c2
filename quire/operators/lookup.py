"""Lines by id, by place and by neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.schema import HIT


def get_line(lines: DataFrame, line_id: str) -> DataFrame:
    return lines.where(F.col("line_id") == line_id).withColumn("score", F.lit(0.0)).orderBy("seq").limit(1).select(*HIT)


def get_context(lines: DataFrame, line_id: str, radius: int) -> DataFrame:
    """The line and up to ``radius`` neighbours each side, by id inside its work and chapter; ``role`` says which."""
    center = lines.where(F.col("line_id") == line_id).orderBy("seq").limit(1).select(F.col("work_id").alias("_w"), F.col("juan").alias("_j"))
    same = lines.join(F.broadcast(center), (F.col("work_id") == F.col("_w")) & (F.col("juan") == F.col("_j")))  # one row
    place = Window.partitionBy("work_id", "juan").orderBy("line_id")
    ranked = same.withColumn("rn", F.row_number().over(place))
    middle = F.min(F.when(F.col("line_id") == line_id, F.col("rn"))).over(Window.partitionBy("work_id", "juan"))
    near = ranked.withColumn("middle", middle).where(F.abs(F.col("rn") - F.col("middle")) <= radius)
    role = F.when(F.col("line_id") < line_id, "before").when(F.col("line_id") == line_id, "hit").otherwise("after")
    return near.withColumn("role", role).withColumn("score", F.lit(0.0)).select("role", *HIT)


def contexts(lines: DataFrame, radius: int) -> DataFrame:
    """For every line the ids around it, in one windowed pass."""
    place = Window.partitionBy("work_id", "juan").orderBy("line_id")
    before, after = place.rowsBetween(-radius, -1), place.rowsBetween(1, radius)
    return lines.select("line_id", F.collect_list("line_id").over(before).alias("before"), F.collect_list("line_id").over(after).alias("after"))


def read_juan(lines: DataFrame, work_id: str, juan: int) -> DataFrame:
    return lines.where((F.col("work_id") == work_id) & (F.col("juan") == juan)).withColumn("score", F.lit(0.0)).orderBy("line_id").select(*HIT)


def read_work(lines: DataFrame, work_id: str, juan: int | None = None) -> DataFrame:
    kept = lines.where(F.col("work_id") == work_id)
    return (kept if juan is None else kept.where(F.col("juan") == juan)).orderBy("juan", "line_id")


def cite(lines: DataFrame, line_id: str) -> DataFrame:
    return get_line(lines, line_id).select("line_id", "citation")
