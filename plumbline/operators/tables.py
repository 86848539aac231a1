"""Sinks as DataFrame transformations, and keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks of a join whose pairs far outnumber its rows, parts of a key at most, pairs of a part, and rows of a left and a right bundle.
SPREAD_TASKS, SPREAD_PARTS, SPREAD_PAIRS, SPREAD_BUNDLES = 256, 16, 8_000_000, (512, 128)


def _bundles(df: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Rows dealt over tasks by their keys, in arrays of `size` rows of one key and a last, shorter one."""
    rows = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name)).repartition(SPREAD_TASKS, *keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return rows.withColumn("__bundle", F.floor((number - 1) / size)).groupBy(*keys, "__bundle").agg(F.collect_list(name).alias(name)).drop("__bundle")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on `keys` of few keys with many rows each: the left rows of a key with many pairs are dealt over parts, the right
    ones copied to each; rows of other keys are not copied. The number of tasks is fixed, as it would follow the rows read, not the
    pairs made.

    Bundles of rows are joined, and pairs are put together last: each right row beside a whole left bundle, so its columns are runs
    of one value and the others repeat a bundle. Written, such pairs take a small part of a byte each. The coalesce changes no
    partition; without it a join's generated code would keep all pairs of a left bundle until it is done with it."""
    rest = [[c for c in df.columns if c not in keys] for df in (left, right)]
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(n))
    parts = F.least(F.lit(SPREAD_PARTS), F.ceil(F.col("__n") * F.col("__m") / SPREAD_PAIRS)).cast("int")
    heavy = F.broadcast(count(left, "__n").join(count(right, "__m"), keys).select(*keys, parts.alias("__parts")).where("__parts > 1"))
    known = F.coalesce("__parts", F.lit(1))
    dealt = left.join(heavy, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), known).cast("int")).drop("__parts")
    copied = right.join(heavy, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), known - 1))).drop("__parts")
    at = [*keys, "__part"]
    met = _bundles(dealt, at, SPREAD_BUNDLES[0], "__left").join(_bundles(copied, at, SPREAD_BUNDLES[1], "__right").hint("merge"), at).coalesce(SPREAD_TASKS)
    beside = met.select(*keys, "__left", F.explode("__right").alias("__r")).select(*keys, F.explode("__left").alias("__l"), "__r")
    return beside.select(*keys, *[F.col("__l")[c].alias(c) for c in rest[0]], *[F.col("__r")[c].alias(c) for c in rest[1]])


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key, the one whose other columns are least in order."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__one"))
    return kept.select(*[F.col("__one")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-01: rows of `new`, one for each key, replace those of `old` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(one_per_key(new, keys))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-02: rows of `new`, one for each key, whose key is not there yet."""
    return old.unionByName(one_per_key(new, keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-03: all rows of the groups in `new` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def cascade(df: DataFrame, on: str, tables: list[tuple[DataFrame, str, str]], out: str) -> DataFrame:
    """JN-14: the first table that knows the value wins. tables: (rows, key column, value column), keys unique."""
    names = []
    for n, (rows, key, value) in enumerate(tables):
        side = rows.select(F.col(key).alias(on), F.col(value).alias(f"__v{n}"))
        df = df.join(side, on, "left")
        names.append(f"__v{n}")
    return df.withColumn(out, F.coalesce(*names)).drop(*names)


def overlap_counts(df: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """JN-07, DT-09: how many other windows of the group share a day with each window, both ends included.

    Others that begin by this end, less those that ended before this start. Begins and ends are counted per day before they
    are summed up, so no pair is listed and a hot group is one row a day."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    per_day = lambda c, name: rows.groupBy(group, F.col(c).alias("d")).agg(F.count(F.lit(1)).alias(name))
    begins, ends = per_day(start, "__b"), per_day(end, "__e")
    days = begins.join(ends, [group, "d"], "full").fillna(0, ["__b", "__e"])
    run = Window.partitionBy(group).orderBy("d")
    begun = F.sum("__b").over(run)
    gone = F.coalesce(F.sum("__e").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = days.select(group, "d", begun.alias("__begun"), gone.alias("__gone"))
    out = rows.join(sums.select(group, F.col("d").alias(end), "__begun"), [group, end]).join(sums.select(group, F.col("d").alias(start), "__gone"), [group, start])
    return out.select(key, group, (F.col("__begun") - F.col("__gone") - 1).alias("n_overlaps"))


def sample_ordinals(total: Column, limit: int) -> Column:
    """SRT-06: up to `limit` evenly spaced numbers of 1..total, both ends among them."""
    step = (total - 1) / F.lit(float(max(1, limit - 1)))
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: (F.bround(i * step, 0) + 1).cast("bigint")))
    return F.when(total <= limit, F.sequence(F.lit(1).cast("bigint"), F.greatest(total, F.lit(1)).cast("bigint"))).otherwise(spaced)


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: str = "s") -> DataFrame:
    """SRT-07, SRT-08: of each stratum its share of `size`, one row at least, in order of a keyed digest.

    Rows are cut by their digest before they are ranked: about four times the wanted rows, and 100 more, stay of each stratum; a
    stratum in which fewer than wanted would stay keeps all its rows."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    want = F.greatest(F.lit(1), F.bround(F.lit(float(size)) * F.col("__n") / total, 0)).cast("bigint")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    share = F.lit(float(1 << 32)) * (4.0 * F.col("__want") + 100) / F.col("__n")
    low = F.conv(F.substring("__d", 1, 8), 16, 10).cast("double") <= F.col("__cut")
    cut = df.withColumn("__d", digest).join(counts.withColumn("__want", want).withColumn("__cut", share), stratum).withColumn("__low", low)
    enough = cut.where("__low").groupBy(stratum).agg((F.count(F.lit(1)) >= F.max("__want")).alias("__enough"))
    kept = cut.join(enough, stratum, "left").where(F.col("__low") | ~F.coalesce("__enough", F.lit(False)))
    ranked = kept.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__d", key)))
    return ranked.where(F.col("__r") <= F.col("__want")).select(*df.columns)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """SRC-04, SRT-09: rows in order behind an offset; a limit of 0 is none."""
    rows = df.orderBy(*order).offset(offset)
    return rows.limit(limit) if limit else rows


def after_key(df: DataFrame, key: str, last: int | None, limit: int) -> DataFrame:
    """SRC-02, SRC-03: the next page of rows by key, behind the last one seen."""
    rows = df if last is None else df.where(F.col(key) > last)
    return rows.orderBy(key).limit(limit)


def load_partitions(df: DataFrame, path: str, dataset: str) -> None:
    """SRC-08: write rows so that the datasets among them are replaced and others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(dataset).parquet(path)


def lookup(wanted: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-02: a point lookup of many keys at once: every wanted row with the columns of the row of its key, null where there is none,
    and `found`. Null keys find nothing; the rows' keys are unique. Each side is hashed once on the keys."""
    return wanted.join(rows.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def citable_page(df: DataFrame, key: str, last: int | None, limit: int, citable: Column) -> DataFrame:
    """SRC-03: of the next page of rows by key, those that may be cited: the page is cut first, so it can hold fewer."""
    return after_key(df, key, last, limit).where(citable)
