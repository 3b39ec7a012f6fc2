"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket by itself.

Everything here is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import column, join_groups, packed, unpacked, write_table


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard, of so many, that gives the key its highest hash; with one more shard, a key stays or goes to that one.

    Null keys have one shard, as keys that are equal have; texts are keys too.
    """
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("hash"), F.lit(k).alias("shard")) for k in range(shards)]))["shard"]


def fisher_yates(items: Column, n: Column, draw) -> Column:
    """An array of n numbers in random order: from the last place to the second, each swaps with one of those up to it.

    draw(i) is a number of 64 random bits for place i. The fold copies the array for each place, so it is for short ones.
    """

    places = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sequence(n, F.least(n, F.lit(2)), F.lit(-1)))
    swaps = F.transform(places, lambda i: F.struct(i.alias("i"), (F.pmod(draw(i), i) + 1).cast("int").alias("j")))

    def swap(done: Column, s: Column) -> Column:
        return F.transform(done, lambda x, at: F.when(at + 1 == s["i"], F.element_at(done, s["j"])).when(at + 1 == s["j"], F.element_at(done, s["i"])).otherwise(x))

    return F.aggregate(swaps, items, swap)


def _hashable(docs: DataFrame, *but: str) -> list[Column]:
    """All columns of docs, each with whether it is null, which xxhash64 skips; maps, which it doesn't take, as JSON."""
    kinds = {c: f.dataType.simpleString() for c, f in zip(docs.columns, docs.schema, strict=True) if c.lower() not in but}
    return [x for c, kind in kinds.items() for x in (column(c).isNull(), F.to_json(F.struct(column(c))) if "map<" in kind or "variant" in kind else column(c))]


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with copy, from 1 on among those of equal a and b; which row gets which number is left open.

    Rows are written as they lie. Each task's rows of a group are numbered by themselves, after those of the tasks before.
    """
    rows = write_table(rows.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "copies")
    before = Window.partitionBy("a", "b").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("a", "b", "task").agg(F.count("*").alias("own")).select("a", "b", "task", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("a", "b", "task").orderBy("at")))
    return own.join(counts, ["a", "b", "task"]).withColumn("copy", (F.col("before") + F.col("own")).cast("long"))


def shuffle_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 20, bucket_bytes: int = 16 << 20, bucket_rows: int = 256) -> DataFrame:
    """All columns of docs, and size, shard, bucket, slot and grown_shard; a row has its place in a random order of its shard.

    First pass: the id alone decides the shard, and a seeded hash of the row scatters the rows of a shard evenly
    over buckets of about bucket_bytes, or bucket_rows rows if that is less. Second pass: each bucket is put in the order of another hash,
    shuffled by Fisher and Yates with draws hashed from seed, shard, bucket and place, and its rows take the slots after those
    of the buckets before it. So a row's slot depends on the seed and the table's rows, not on files, partitions or tries.
    size is the UTF-8 bytes of the text plus 1; grown_shard is the shard if there were one shard more.

    A null text has size 1, null ids share a shard. Ties in the hash go to the highest shard number. Shards may be empty, then
    they have no rows. Each row travels as it is. Rows whose hashes over all columns agree are counted, and where there are more than
    a quarter of bucket_rows they are written and numbered, so that they are scattered like other rows. Columns of docs with the new names are replaced; other names are free.
    """
    new = ("size", "shard", "bucket", "slot", "grown_shard")
    rows = docs.select(
        packed(docs, *new),
        (F.coalesce(F.octet_length(column(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        shard_of(column(id_col), shards, seed).alias("shard"),
        shard_of(column(id_col), shards + 1, seed).alias("grown_shard"),
        *[F.xxhash64(F.lit(seed + k), *_hashable(docs, *new)).alias(name) for k, name in ((1, "a"), (2, "b"))],
    )
    counted = write_table(rows.groupBy("a", "b").agg(F.first("shard").alias("shard"), F.count("*").alias("n"), F.sum("size").alias("bytes")), "row-hashes")
    total = counted.agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("n").cast("long").alias("n")).first()
    buckets = max(1, -(-(total["bytes"] or 0) // (shards * bucket_bytes)), -(-(total["n"] or 0) // (shards * bucket_rows)))
    often = F.col("n") > max(1, bucket_rows // 4)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 3), "a", "b", "copy"), F.lit(buckets)).cast("int").alias("bucket")

    scattered = rows.withColumn("copy", F.lit(0).cast("long"))
    repeated = write_table(counted.filter(often).select("a", "b", "n"), "repeated-rows")
    if not repeated.isEmpty():
        met = join_groups(rows, repeated, ["a", "b"], "n", F.monotonically_increasing_id())
        scattered = met.filter(F.col("n").isNull()).withColumn("copy", F.lit(0).cast("long")).select(*scattered.columns).unionByName(_numbered(met.filter(F.col("n").isNotNull())).select(*scattered.columns))
    cells = counted.select("shard", "a", "b", F.explode(F.when(often, F.sequence(F.lit(1).cast("long"), "n")).otherwise(F.array(F.lit(0).cast("long")))).alias("copy"), F.when(often, 1).otherwise(F.col("n")).alias("n"))
    places = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", bucket, "n").groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(places), F.lit(0)).alias("offset"))

    entry = F.struct(F.xxhash64(F.lit(seed + 4), "a", "b", "copy").alias("order"), "row", "size", "grown_shard")
    full = scattered.select("shard", bucket, entry.alias("entry")).groupBy("shard", "bucket").agg(F.collect_list("entry").alias("entries"))
    full = full.join(offsets, ["shard", "bucket"]).sortWithinPartitions("shard", "bucket")
    in_order = F.transform(F.array_sort(F.transform("entries", lambda e, i: F.struct(e["order"].alias("order"), (i + 1).alias("at")))), lambda e: e["at"])
    places = fisher_yates(in_order, F.size("entries"), lambda i: F.xxhash64(F.lit(seed), "shard", "bucket", i))
    out = full.select("shard", "bucket", "offset", F.posexplode(F.transform(places, lambda p: F.element_at("entries", p))).alias("at", "entry"))
    out = out.select(F.col("entry.row").alias("row"), "entry.size", "shard", "bucket", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "entry.grown_shard")
    return out.select(*unpacked(out), "size", "grown_shard", "shard", "bucket", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders shard=0, shard=1 and so on; the rows of a bucket lie in one file, in order of slot.

    Null and empty texts are rows like others. No rows give a folder without shards.
    """
    sharded.write.partitionBy("shard").parquet(path)
