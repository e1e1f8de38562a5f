"""Keyed merges, deduplication, latest rows and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row per key under a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_by_max(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As ``latest`` with ascending columns and the last row per key, by one aggregate that combines
    before the shuffle; rows that tie in all of ``order`` must be equal."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of equal key and are added otherwise."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def append_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """J21, U5, U10 (do nothing): only source rows of new keys are added."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_filled(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Per column the source's value, or the target's where that is null or ''."""
    rest = [c for c in target.columns if c not in keys]
    filled = lambda c: F.nullif(F.col(f"s.{c}"), F.lit("")) if dict(source.dtypes).get(c) == "string" else F.col(f"s.{c}")
    return target.alias("t").join(source.alias("s"), keys, "full_outer").select(*keys, *[F.coalesce(filled(c), F.col(f"t.{c}")).alias(c) for c in rest])


def replace_date(target: DataFrame, source: DataFrame, date: str, day: str) -> DataFrame:
    """All rows of one date give way to the source's."""
    return target.where(F.col(date) != F.lit(day).cast("date")).unionByName(source)


#: Key and cast columns of the concrete merges.
MERGES = {
    "structured": ("report_id", {}),
    "embeddings": ("report_id", {}),
    "material_event": ("event_id", {"amount": "long", "is_latest": "boolean"}),
    "financial_statement": ("fact_id", {}),
    "ownership": ("ownership_fact_id", {}),
    "regular_structured": ("fact_id", {}),
}


def truthy(c: Column) -> Column:
    """A flag that arrives as boolean or text; null is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1"), F.lit(False))


def merge_table(name: str, target: DataFrame, source: DataFrame, order: list[Column]) -> DataFrame:
    """The source deduplicated under ``order`` and cast, then merged."""
    key, casts = MERGES[name]
    for c, t in casts.items():
        if c in source.columns:
            source = source.withColumn(c, truthy(F.col(c)) if t == "boolean" else F.expr(f"try_cast(try_cast({c} AS double) AS {t})"))
    return merge(target, latest(source, [key], order), [key])


def union_by_priority(sources: list[DataFrame], keys: list[str], fallback: list[str], order: list[Column]) -> DataFrame:
    """Rows of earlier sources win; a row without the key is identified by the fallback columns."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    own = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    other = F.concat_ws("|", F.lit("?"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fallback])
    return latest(union.withColumn("_key", F.when(own != "", own).otherwise(other)), ["_key"], [F.col("_source"), *order]).drop("_key", "_source")


def distinct_in_order(values: Column) -> Column:
    """A list without repeats, empty texts and nulls, in the order of first occurrence."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")))


def claim(queue: DataFrame, n: int, now: Column) -> DataFrame:
    """The n jobs that are due next, by priority, time and id; who runs them must lock the rows elsewhere."""
    return queue.where((F.col("status") == "pending") & (F.col("scheduled_at") <= now)).orderBy(F.desc("priority"), "scheduled_at", "job_id").limit(n)


def reject_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """U7, Q3."""
    if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"duplicate keys {keys}")
    return df


def lineage(filings: DataFrame) -> DataFrame:
    """Original and latest receipt, amendment number and latest flag within a group;
    a filing without a group is its own."""
    key = F.coalesce(F.col("group_id").cast("string"), F.col("rcept_no").cast("string"))
    order = [F.col("rcept_dt"), F.col("rcept_no")]
    group = Window.partitionBy("_group")
    ordered = group.orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filings.withColumn("_group", key).withColumns(
        {
            "original_rcept_no": F.first("rcept_no").over(whole),
            "latest_rcept_no": F.last("rcept_no").over(whole),
            "amendment_seq": F.row_number().over(ordered) - 1,
            "version_count": F.count(F.lit(1)).over(group),
        }
    ).withColumn("is_latest", F.col("rcept_no") == F.col("latest_rcept_no")).drop("_group")


def latest_ownership(rows: DataFrame, position: str) -> DataFrame:
    """The latest row per company and holder; rows without a holder stay, each by itself."""
    day = F.substring(F.regexp_replace(F.coalesce(F.col("rcept_dt").cast("string"), F.lit("")), r"\D", ""), 1, 8)
    holder = F.when(F.coalesce(F.trim("repror"), F.lit("")) == "", F.concat(F.lit("?"), F.col(position).cast("string"))).otherwise(F.concat(F.lit("="), F.trim("repror")))
    return latest(rows, ["corp_code", holder], [day.desc(), F.col("rcept_no").desc_nulls_last(), F.col(position).desc()])


def roster_diff(old: DataFrame, new: DataFrame, fields: list[str], key: str = "stock_code") -> DataFrame:
    """LISTED, RELISTED, INFO_CHANGED, DELISTED or UNCHANGED per code."""
    o, n = old.alias("o"), new.alias("n")
    gone = F.coalesce(F.col("o.status") == "DELISTED", F.lit(False))
    changed = reduce(lambda a, b: a | b, [~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in fields])
    state = (
        F.when(F.col("_o").isNull(), "LISTED")
        .when(F.col("_n").isNull(), F.when(gone, "UNCHANGED").otherwise("DELISTED"))
        .when(gone, "RELISTED")
        .when(changed, "INFO_CHANGED")
        .otherwise("UNCHANGED")
    )
    joined = o.withColumn("_o", F.lit(1)).alias("o").join(n.withColumn("_n", F.lit(1)).alias("n"), key, "full_outer")
    return joined.select(key, state.alias("change"), *[F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).alias(f) for f in fields])


def resolve_names(mentions: DataFrame, companies: DataFrame, key: Column, name: Column) -> DataFrame:
    """A name that one company has, or one listed company, resolves to it; else to null."""
    unique = (
        companies.withColumn("_key", key)
        .where("_key <> ''")
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_all"), F.count_if("is_listed").alias("_listed"), F.min_by("corp_code", F.struct(~F.col("is_listed"), F.col("corp_code"))).alias("_code"))
        .select("_key", F.when((F.col("_all") == 1) | (F.col("_listed") == 1), F.col("_code")).alias("resolved_code"))
    )
    return mentions.withColumn("_key", name).join(unique, "_key", "left").drop("_key")


def find_company(asked: str, companies: DataFrame) -> DataFrame:
    """By alias, else by code, else by name prefix in either direction; one row at most."""
    q = F.lit(asked.strip())
    tier = (
        F.when(F.array_contains(F.array_compact(F.array("corp_name", "stock_name", "corp_code", "stock_code")), q), 1)
        .when((F.ltrim("corp_code", F.lit("0")) == F.ltrim(q, F.lit("0"))) | (F.ltrim("stock_code", F.lit("0")) == F.ltrim(q, F.lit("0"))), 2)
        .when(F.startswith(F.col("corp_name"), q) | F.startswith(q, F.col("corp_name")), 3)
    )
    return companies.withColumn("_tier", tier).where("_tier IS NOT NULL").orderBy("_tier", "position").limit(1).drop("_tier")


def with_latest_value(roster: DataFrame, filings: DataFrame, key: str, value: str) -> DataFrame:
    """The roster with the value of each key's latest filing that has one, in order of date and receipt number."""
    last = filings.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct("rcept_dt", "rcept_no")).alias(value))
    return roster.join(last, key, "left")


def alias_dimension(companies: DataFrame) -> DataFrame:
    """One row per padded or stripped key and company."""
    keys = F.array_distinct(F.array_compact(F.array("corp_code", F.ltrim("corp_code", F.lit("0")), "stock_code", F.ltrim("stock_code", F.lit("0")), "corp_name")))
    return companies.select(F.explode(keys).alias("alias"), "corp_code", "corp_name").distinct()


def todo(complete: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is complete and not yet done."""
    return complete.join(done.select(*keys), keys, "left_anti")


def missing_calls(needed: DataFrame, existing: DataFrame, combos: DataFrame) -> DataFrame:
    """Names that are needed and absent, for every combination."""
    return needed.exceptAll(existing).crossJoin(combos)


def completion(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Per key whether every expected path is there."""
    return expected.join(present.select(*keys, "path", F.lit(True).alias("_there")).distinct(), [*keys, "path"], "left").groupBy(*keys).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("complete"), F.count_if(F.col("_there").isNull()).alias("missing"))


def request_hash(df: DataFrame, columns: list[str]) -> Column:
    """Equal requests hash alike, whatever the order of their columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def compact(df: DataFrame, keys: list[str], file: str) -> DataFrame:
    """K8: of equal keys the row in the last file by name stays."""
    return latest(df, keys, [F.col(file).desc()])
