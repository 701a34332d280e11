"""Exact deduplication with an extendible-hash index on shared files. DataFrame functions only.

Every text is normalised (A-Z lower-cased; null counts as empty) and hashed to a key of 64 bits. Rows get a number of their own
and are written to the shared folder, so every later step sees the same rows, also after a lost executor.

1. The index holds an entry for each different key, with the number of its rows; keys are counted within tasks first.
2. The directory starts with one slot for all keys. Buckets with more than `bucket_keys` keys are split by their next bit, and
   the directory doubles, until none is overfull; other buckets keep their smaller local depth. A round counts DOUBLINGS further
   bits of the keys that lie in overfull buckets, so no depth is fixed beforehand.
3. The directory gives every entry its bucket. The entries are laid out by bucket in files of the shared folder, with the number
   of the task that wrote them, their owner; as buckets are prefixes of keys, an owner has a range of keys.
4. Rows whose entry has more than one row go to the entry's owner, which compares their bytes: equal texts become a group, and
   different texts with one key are chained. Where an entry has COMBINE_FROM rows or more, those with equal bytes are combined
   before, COMBINERS apart, so an owner gets few rows of a large group of copies. A row whose entry stands alone is its own group
   and its text is shipped nowhere.
5. Groups come back to the rows by key, and where a key has a chain, by the bytes of the text. Keys with a large share of the rows
   are joined apart from the others, by a broadcast of a few keys for each partition.

Every input row gives one output row, whether ids repeat or not. Of equal texts the row with the largest id stays; if several
rows have that id, one of them; where all ids are null, one of those rows. An empty table gives an empty result. Other columns
of the input may have any names and don't matter to `exact_copies`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import join_counted, lower_ascii, n_partitions, small_side, staged

#: Different keys that a bucket may hold before it splits, and bits that a round looks ahead.
BUCKET_KEYS, DOUBLINGS = 4096, 8
#: Rows of 16 to 40 bytes up to which a side is broadcast.
BROADCAST_KEYS = 500_000
#: Rows of a key from which they are combined before they go to the owner, and the parts in which that is done.
COMBINE_FROM, COMBINERS = 64, 64


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text.cast("string"), F.lit("")))


def numbered(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    """(uid, row, doc_id, key): the rows of docs as they are, each with a number of its own, in the shared folder."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.xxhash64(normalised(F.col("row")[text_col]))
    if key_bits < 64:
        key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    return staged(row.select(F.monotonically_increasing_id().alias("uid"), "row", F.col("row")[id_col].alias("doc_id"), key.alias("key")), "rows")


def slot_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory_of(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, doublings: int = DOUBLINGS) -> tuple[DataFrame, int]:
    """(slot, local_depth, bucket) for the slots of all buckets in use, and the global depth. keys: a row for each different key.

    A bucket's number is its first slot, so buckets are in the order of the keys (as unsigned numbers)."""
    depth, still, leaves = 0, keys.select("key"), []
    while True:
        ahead = min(64, depth + doublings)
        filled = staged(still.groupBy(slot_of(F.col("key"), ahead).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "filled")
        # what each bucket would hold at every depth of this round; the least depth that fits is its local depth
        steps = filled.select("slot", "n", F.explode(F.sequence(F.lit(depth), F.lit(ahead))).alias("local_depth"))
        steps = steps.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {ahead} - local_depth)"))
        held = steps.groupBy("local_depth", "prefix").agg(F.sum("n").alias("held"))
        fits = steps.join(held, ["local_depth", "prefix"]).filter(F.col("held") <= bucket_keys)
        first = fits.groupBy("slot").agg(F.min(F.struct("local_depth", "prefix")).alias("x"))
        leaves.append(first.select("x.*").distinct())
        if ahead == 64:
            break
        over = filled.join(first, "slot", "left_anti").select("slot")
        there = over.count()
        if not there:
            break
        still = still.withColumn("slot", slot_of(F.col("key"), ahead)).join(small_side(over, there, BROADCAST_KEYS), "slot", "left_semi").select("key")
        depth = ahead
    buckets = staged(reduce(DataFrame.unionByName, leaves), "buckets")
    deepest = buckets.agg(F.max("local_depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {deepest} - local_depth)")
    each = buckets.select("local_depth", first.alias("bucket"), F.explode(F.expr(f"sequence(0L, shiftleft(1L, {deepest} - local_depth) - 1)")).alias("i"))
    return staged(each.select((F.col("bucket") + F.col("i")).alias("slot"), "local_depth", "bucket"), "directory"), deepest


def index_of(rows: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(owner, bucket, key, n): the entries, laid out by bucket in the shared folder; owners are tasks that hold whole buckets."""
    entries = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "entries")
    directory, depth = directory_of(entries, bucket_keys)
    placed = entries.withColumn("slot", slot_of(F.col("key"), depth)).join(small_side(directory, directory.count(), BROADCAST_KEYS), "slot")
    owned = placed.select("bucket", "key", "n").repartitionByRange(n_partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "key")
    return staged(owned.select(F.spark_partition_id().alias("owner"), "bucket", "key", "n"), "index")


def on_key(rows: DataFrame, table: DataFrame, counted: str) -> DataFrame:
    """rows joined with table (a row for each key). Beyond a broadcast both are shuffled by key, but for the keys that `counted` tells to have a
    large share of the rows: these few come as a broadcast of their own, so no task gets all copies of a text."""
    if table.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), "key")
    told = table.withColumns({"there_": F.lit(True), "counted_": F.col(counted)})
    return join_counted(rows, told, "key", "counted_").where("there_").drop("there_")


def groups_of(rows: DataFrame, index: DataFrame, text_col: str) -> DataFrame:
    """(bucket, key, chain, chained, norm, keep_id, keep_uid, group_size) for the keys with more than one row: a row for each
    different text. norm is null where the key has that text alone."""
    many = index.filter("n > 1")
    entry, text = ["owner", "bucket", "key"], normalised(F.col("row")[text_col]).alias("norm")
    members = on_key(rows, many, "n").select(*entry, text, F.struct("doc_id", (-F.col("uid")).alias("back")).alias("top"), F.lit(1).cast("long").alias("size"), "n", "uid")
    merged = [F.max("top").alias("top"), F.sum("size").alias("size")]
    part = F.shiftright("uid", 33) % COMBINERS  # by the task that numbered the row
    sent = members.filter(F.col("n") < COMBINE_FROM).select(*entry, "norm", "top", "size")
    if not many.filter(F.col("n") >= COMBINE_FROM).isEmpty():
        combined = members.filter(F.col("n") >= COMBINE_FROM).groupBy(*entry, "norm", part.alias("part")).agg(*merged)
        sent = sent.unionByName(combined.drop("part"))
    # each owner is one task from here on: nothing below is shuffled again
    owned = sent.repartitionById(n_partitions(rows.sparkSession), F.col("owner")).groupBy(*entry, "norm").agg(*merged).withColumnRenamed("size", "group_size")
    of_key = Window.partitionBy(*entry).orderBy("norm")
    chained = F.count(F.lit(1)).over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    linked = owned.withColumn("chain", F.row_number().over(of_key)).withColumn("chained", chained)
    norm = F.when(F.col("chained") > 1, F.col("norm"))
    return staged(linked.select("bucket", "key", "chain", "chained", norm.alias("norm"), F.col("top.doc_id").alias("keep_id"), (-F.col("top.back")).alias("keep_uid"), "group_size"), "groups")


def _resolved(docs: DataFrame, id_col: str, text_col: str, bucket_keys: int, key_bits: int) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and for those that are not alone (uid, keep_id, group_size, kept, bucket, chain)."""
    rows = numbered(docs, id_col, text_col, key_bits)
    groups = groups_of(rows, index_of(rows, bucket_keys), text_col)
    found = ["keep_id", "keep_uid", "group_size", "bucket", "chain"]
    plain = groups.filter("chained = 1").select("key", *found)
    placed = on_key(rows.select("uid", "key"), plain, "group_size").select("uid", *found)
    chains = groups.filter("chained > 1").select("key", "norm", *found)
    if not chains.isEmpty():
        texts = rows.select("uid", "key", normalised(F.col("row")[text_col]).alias("norm"))
        placed = placed.unionByName(texts.join(chains, ["key", "norm"]).select("uid", *found))
    return rows, placed.select("uid", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "bucket", "chain")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain for every row, dropped ones too.

    bucket and chain are null where the key of the text occurs once. key_bits below 64 make keys collide, for tests."""
    rows, placed = _resolved(docs.select(id_col, text_col), id_col, text_col, bucket_keys, key_bits)
    own = rows.select("uid", "doc_id", F.sha2(normalised(F.col("row")[text_col]), 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    return own.join(placed, "uid", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
        "bucket",
        "chain",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each group of equal texts."""
    rows, placed = _resolved(docs, id_col, text_col, bucket_keys, key_bits)
    gone = staged(placed.filter("not kept").select("uid"), "gone")
    return rows.join(small_side(gone, gone.count(), BROADCAST_KEYS), "uid", "left_anti").select("row.*")
