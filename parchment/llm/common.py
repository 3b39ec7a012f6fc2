"""What the operators of this package share: tables, scratch tables in the shared folder, and joins that hold under skew.

Operators keep the columns of their input in one struct, packed(), while they work. So no name that they give to a column
of their own can clash with one of the input, and out() unpacks the struct at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: this cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of this name, whatever signs it has."""
    return F.col(quoted(name))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but for names, whatever the case."""
    gone = {n.lower() for n in names}
    return [column(c) for c in df.columns if c.lower() not in gone]


def packed(df: DataFrame, *new: str) -> Column:
    """One struct, named row, of the columns of df but for those that new ones of these names replace."""
    return F.struct(*without(df, *new)).alias("row")


def inside(name: str) -> Column:
    """A column that packed() put into row."""
    return F.col(f"row.{quoted(name)}")


def unpacked(df: DataFrame) -> list[Column]:
    """The columns that packed() put into row, to be selected again."""
    return [inside(c).alias(c) for c in df.schema["row"].dataType.names]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, spread: Column, how: str = "left", shuffle: bool = False) -> DataFrame:
    """Join rows to one-row-per-key groups without sending a large group to one task.

    size_col of groups has the number of rows of each key. A group of more than a quarter of an average
    partition is heavy. The sizes add up to at most the number of rows, so there are fewer than
    4 x spark.sql.shuffle.partitions heavy groups whatever the data: they are broadcast. The other groups are
    joined by a shuffle, in which the rows that found their heavy group are dealt out by spread.
    groups is read three times, so it should be a written table. how is "left" or "inner". With shuffle, the other groups are never
    broadcast, however few they are, so that large rows cost the same share at every size. Besides the keys, rows and
    groups have no names in common; columns of any other name are safe.
    """
    taken = {c.lower() for c in [*rows.columns, *groups.columns]}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    heavy_col, light_col, salt, group = map(free, ("heavy", "light", "salt", "group"))
    parts = shuffle_partitions(rows.sparkSession)
    total = groups.agg(F.sum(column(size_col)).cast("long")).first()[0] or 0
    others = [c for c in groups.columns if c not in keys]
    is_heavy = column(size_col) * (4 * parts) > F.lit(total)
    found = F.struct(*map(column, others))
    heavy = groups.filter(is_heavy).select(*map(column, keys), found.alias(heavy_col))
    light = groups.filter(~is_heavy).select(*map(column, keys), F.lit(0).cast("long").alias(salt), found.alias(light_col))
    light = light.hint("merge") if shuffle else light
    met = rows.join(F.broadcast(heavy), keys, "left")
    met = met.withColumn(salt, F.when(column(heavy_col).isNotNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    met = met.join(light, [*keys, salt], "left").withColumn(group, F.coalesce(column(heavy_col), column(light_col)))
    if how == "inner":
        met = met.filter(column(group).isNotNull())
    return met.select(*map(column, rows.columns), *[F.col(f"{quoted(group)}.{quoted(c)}").alias(c) for c in others])


def one_each(rows: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """rows with n, the number of rows that one stands for. Of rows with the keys of repeated (the keys and n, written) one is left.

    The others have n = 1. Copies go before anything is shuffled by key, so a key may have any number. keys aren't null.
    """
    if repeated.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long"))
    met = join_groups(rows, repeated, keys, "n", F.monotonically_increasing_id())
    others = [c for c in rows.columns if c not in keys]
    one = met.filter(F.col("n").isNotNull()).groupBy(*map(column, keys)).agg(*[F.first(column(c)).alias(c) for c in [*others, "n"]])
    return met.filter(F.col("n").isNull()).withColumn("n", F.lit(1).cast("long")).unionByName(one.select(*map(column, met.columns)))
