"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses the bucket boundaries for which the padding is least: a document
is padded to the upper boundary of its bucket. Lengths up to the budget are counted exactly, so the histogram has at most
`budget` rows whatever the corpus, and the boundaries are the best of all. Inside each bucket, documents are numbered and
consecutive ones form batches of at most `budget` padded tokens. A document longer than the budget can share no batch: it is a
batch of its own in one bucket more, without padding, and is marked; no text is cut.

Numbering a bucket needs no task that sees the whole bucket: rows are dealt to slots by a number that each got when lengths
were written, numbered within the slot, and shifted by the sizes of the slots before it (a small table). Null texts count as
empty; a row with length 0 is padded like the others. Null and repeated ids are kept: every input row gives one output row,
and an empty table none. Other columns of the input may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import staged

BUCKETS, BUDGET, SLOT_ROWS, MOST_SLOTS = 16, 8192, 2_000, 65_536


def word_tokens(text_col: str = "text") -> Column:
    """Words and one end, counted as a token."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long") + 1


def best_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries, ascending, of at most `buckets` buckets with the least padding; lengths are different and ascending.

    Least total padded length is the same as least padding, as the unpadded total is fixed. cost[j], of the first j lengths in k
    buckets, is the least over i < j of cost'[i] + lengths[j - 1] * (n[j] - n[i]): for a given i a line in lengths[j - 1], whose
    slope -n[i] falls with i while the lengths grow, so the best lines stand in a queue and a round takes linear time. Whole
    numbers all through, so nothing is rounded."""
    m = len(lengths)
    n = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).tolist()
    cost: list[int | None] = [0] + [None] * m
    back = []
    for _ in range(min(buckets, m)):
        new: list[int | None] = [None] * (m + 1)
        came = [0] * (m + 1)
        queue: list[int] = []
        at = 0
        for j in range(m + 1):
            if j and queue:
                x = lengths[j - 1]
                at = min(at, len(queue) - 1)
                while at + 1 < len(queue) and cost[queue[at + 1]] - x * n[queue[at + 1]] < cost[queue[at]] - x * n[queue[at]]:
                    at += 1
                i = queue[at]
                new[j], came[j] = cost[i] + x * (n[j] - n[i]), i
            if cost[j] is not None:
                while len(queue) - at >= 2 and (cost[j] - cost[queue[-2]]) * (n[queue[-1]] - n[queue[-2]]) <= (cost[queue[-1]] - cost[queue[-2]]) * (n[j] - n[queue[-2]]):
                    queue.pop()
                queue.append(j)
        back.append(came)
        cost = new
        if m == 1:
            break
    found, j = [], m
    for came in reversed(back):
        if j == 0:
            break
        found.append(lengths[j - 1])
        j = came[j]
    return found[::-1]


def length_buckets(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> list[int]:
    """The boundaries for the column n_tokens of lengths, from the histogram over all rows whose length is within the budget."""
    rows = lengths.filter(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # budget + 1 rows at most
    rows = sorted((r["n_tokens"], r["n"]) for r in rows)
    return best_boundaries([a for a, _ in rows], [b for _, b in rows], buckets) if rows else []


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, batch, place, over_budget for every row. batch is numbered from 0 within a bucket."""
    length = word_tokens() if length is None else length
    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n_tokens"), F.monotonically_increasing_id().alias("uid")), "lengths")
    ends = length_buckets(rows, buckets, budget)
    slots = min(MOST_SLOTS, max(1, -(-rows.count() // slot_rows)))
    bucket, padded = F.lit(len(ends)), F.col("n_tokens")
    for k in range(len(ends) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
        padded = F.when(F.col("n_tokens") <= ends[k], ends[k]).otherwise(padded)
    dealt = rows.select("doc_id", "n_tokens", "uid", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded_to"), F.pmod(F.xxhash64("uid"), F.lit(slots)).cast("int").alias("slot"))
    sizes = dealt.groupBy("bucket", "slot").agg(F.count(F.lit(1)).alias("n"))  # buckets * slots rows
    earlier = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("bucket", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("bucket", "slot").orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id", "n_tokens", "uid")
    numbered = dealt.withColumn("r", F.row_number().over(within)).join(ahead, ["bucket", "slot"])
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_to"))).cast("long")
    at = F.col("ahead") + F.col("r") - 1
    return numbered.select(
        "doc_id", "n_tokens", F.col("bucket"), "padded_to", F.floor(at / each).cast("long").alias("batch"), F.pmod(at, each).cast("long").alias("place"), (F.col("n_tokens") > budget).alias("over_budget")
    )
