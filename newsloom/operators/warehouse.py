"""Idempotent loads, references, rules and row-level filters of the warehouse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.ranking import with_rank


def _one_a_key(source: DataFrame, key: str) -> DataFrame:
    """One row of each key: the one whose columns, as JSON, come first. Rows that repeat a key would be inserted twice."""
    row = F.struct(*[F.col(f"`{c}`") for c in source.columns])
    return source.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.to_json(row)).alias("one")).select("one.*")  # combined before the shuffle


def insert_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target and those rows of source whose key it lacks, one row a key. Null keys equal no other and are one key among themselves."""
    return target.unionByName(_one_a_key(source, key).join(target, key, "left_anti").select(target.columns))


def upsert(target: DataFrame, source: DataFrame, key: str, update: list[str]) -> DataFrame:
    """As K02, and `update` columns of keys that both have come from source."""
    one = _one_a_key(source, key)
    s = one.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in update], F.lit(True).alias("_hit"))
    kept = target.join(s, target[key] == s["_k"], "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns])
    return kept.unionByName(one.join(target, key, "left_anti").select(target.columns))


def touched(target: DataFrame, source: DataFrame, key: str, update: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """K03 whose updated rows also get `now` in their stamp, as the update trigger sets it; inserted rows keep their own."""
    return upsert(target, source.withColumn(stamp, now), key, [*update, stamp])


def insert_returning(target: DataFrame, rows: DataFrame, order: list, now: Column, key: str = "id", stamp: str = "created_at") -> DataFrame:
    """The rows as they are inserted: ids go on from target's largest, in `order`, and `now` is their time. Union them with target to store them."""
    largest = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
    return with_rank(rows, order, "_place").crossJoin(F.broadcast(largest)).select((F.col("_top") + F.col("_place") + 1).alias(key), *rows.columns, now.alias(stamp))


def new_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """(id, display_name) for users (id, email, meta: JSON) without a profile: the name given, else what stands before the @."""
    name = F.coalesce(F.get_json_object("meta", "$.display_name"), F.split_part("email", F.lit("@"), F.lit(1)))
    return _one_a_key(users, "id").join(profiles.select("id"), "id", "left_anti").select("id", name.alias("display_name"))


# States of a job, and where each may lead.
JOB_STEPS = (("pending", "processing"), ("processing", "completed"), ("processing", "failed"))


def advanced(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Jobs (id, status) and steps (id, to) -> id, status, moved: allowed steps are taken, others leave the job as it is.

    One step a job at a time; of several for an id the smallest `to` that is allowed counts.
    """
    allowed = F.lit(False)
    for a, b in JOB_STEPS:
        allowed = allowed | ((F.col("status") == a) & (F.col("to") == b))
    wanted = jobs.join(steps, "id", "left").withColumn("ok", F.coalesce(allowed, F.lit(False)))
    g = wanted.groupBy("id", "status").agg(F.min(F.when(F.col("ok"), F.col("to"))).alias("to"))
    return g.select("id", F.coalesce("to", "status").alias("status"), F.col("to").isNotNull().alias("moved"))


def text_vector(*columns: str) -> Column:
    """The different lower-cased words of the columns, in order of the alphabet; null columns are empty."""
    words = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose reference is set and found nowhere."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")).distinct(), F.col(fk) == F.col("_pk"), "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """a row for every rule that a row of df breaks; a rule that is null holds."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def visible(df: DataFrame, *policies: Column) -> DataFrame:
    """rows that any of the permissive policies lets through."""
    any_ = F.lit(False)
    for p in policies:
        any_ = any_ | F.coalesce(p, F.lit(False))
    return df.where(any_)
