"""Filter interaction audit: what each filter removes after every set of other filters, for every order in which they can be applied.

1. Every row gets its verdicts once, in one pass over its whole text: whether it fails A to E, and whether its label says good or
   toxic. They are written to the shared folder, so no text is read again and a lost executor costs a narrow scan.
2. The orders form a trie of prefixes. It is walked depth first: at a node the survivors of the prefix are a persisted DataFrame,
   their failures are counted, and each child filters them further; they are released when the walk turns back, so the frames
   of one path (filters + 1) are held at a time. Survivors don't depend on the order of a prefix: its unordered set is the state,
   each state is visited once (2^filters of them), and other prefixes share what it has counted.
3. Every edge of the trie (state, filter) then has the rows that its filter actually removed, by part; the orders read off theirs.

Counts stay in tables: nothing but the orders (filters! * filters rows) comes from the driver, whatever the number of parts.

Rows: null text is empty (no words: fails A, not B, C or D); a null part is the empty string, as one that is empty; a null id is
never smaller than another and no smaller id for others, and has no label. Repeated ids: each row counts; equal ids aren't smaller
than each other; where a label is repeated, one row with 1 makes it 1. Other columns don't matter. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import join_counted, staged

#: Fixed values of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: A too few words, B too few different ones, C too many capitals, D signs."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": F.regexp_like(text, F.lit(SIGNS)),
    }


def with_repeats(rows: DataFrame, digest: str, id_col: str, name: str) -> DataFrame:
    """rows with whether a row with a smaller id has the same digest. Digests are counted within tasks before they are shuffled; those
    with a large share of the rows come as a bounded broadcast."""
    first = rows.groupBy(digest).agg(F.min(id_col).alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    found = join_counted(rows, staged(first, "repeats"), digest, "n_")
    return found.withColumn(name, F.coalesce(F.col("first_") < F.col(id_col), F.lit(False))).drop("first_", digest)


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str, names: tuple[str, ...]) -> DataFrame:
    """rows with booleans: whether a label of their id is 1. Rows without an id are joined with nothing, so they gather nowhere."""
    each = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(id_col)).agg(*(F.max(F.col(n) == 1).alias(n) for n in names))
    told = rows.where(F.col(id_col).isNotNull()).join(each, id_col, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    return told.unionByName(rows.where(F.col(id_col).isNull()).withColumns({n: F.lit(False) for n in names}))


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row, in the shared folder."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    judged = own.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *(c.alias(k) for k, c in text_failures(F.col("t")).items()))
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("good"), F.col("toxic").alias("toxic"))
    told = with_labels(with_repeats(staged(judged, "judged"), "digest", "id", "E"), marks, "id", ("good", "toxic"))
    return staged(told.select("part", *"ABCDE", "good", "toxic"), "verdicts")


def count_states(rows: DataFrame, filters: str, losses: Mapping[str, str]) -> DataFrame:
    """(part, state, left, letter, failing, and the losses among the failing) for every set of filters applied and each other filter.

    state is the set as a number (bit k: filter k). The last state has no other filter: its letter is null. A part without
    survivors has no row."""
    memo: dict[int, DataFrame] = {}

    def visit(state: int, survivors: DataFrame) -> None:
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        rest = [(k, x) for k, x in enumerate(filters) if not state >> k & 1]
        told = [F.struct(F.lit(x).alias("letter"), F.count_if(x).alias("failing"), *(F.count_if(F.col(x) & F.col(c)).alias(n) for n, c in losses.items())) for _, x in rest]
        none = F.struct(F.lit(None).cast("string").alias("letter"), *(F.lit(0).cast("long").alias(n) for n in ("failing", *losses)))
        counted = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("left"), F.array(*(told or [none])).alias("edges"))
        memo[state] = staged(counted.select("part", F.lit(state).alias("state"), "left", F.inline("edges")), f"state-{state}")
        for k, x in rest:
            if state | 1 << k not in memo:
                visit(state | 1 << k, survivors.where(~F.col(x)))
        survivors.unpersist()

    visit(0, rows)
    return reduce(DataFrame.unionByName, memo.values())


def audit(rows: DataFrame, filters: str, losses: Mapping[str, str]) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, the losses, shapley: all orders of the filters, for each part.

    rows: part, a boolean for each letter of filters (fails), and the columns that losses names (boolean)."""
    counts = count_states(rows, filters, losses)
    bit = {x: 1 << k for k, x in enumerate(filters)}
    every = sum(bit.values())
    # each edge of the trie for each part, also where nothing has survived
    grid = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(x).alias("letter"), F.lit(s | bit[x]).alias("after")) for s in range(every) for x in filters if not s & bit[x]))
    edges = counts.where("state = 0").select("part").distinct().select("part", F.inline(grid))
    left = counts.select("part", F.col("state").alias("after"), F.col("left").alias("kept")).distinct()
    found = edges.join(counts.drop("left"), ["part", "state", "letter"], "left").join(left, ["part", "after"], "left")
    found = staged(found.fillna(0, ["failing", "kept", *losses]), "edges")
    alone = found.where(F.expr(f"state + {'case letter ' + ' '.join(f'when {x!r} then {b}' for x, b in bit.items())} end") == every).select("part", "letter", F.col("failing").alias("unique_fails"))
    total = found.where("state = 0").select("part", "letter", F.col("failing").alias("total"))
    orders = [("".join(o), k + 1, o[k], sum(bit[x] for x in o[:k])) for o in permutations(filters) for k in range(len(filters))]
    steps = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, letter string, state int")
    rates = found.join(F.broadcast(steps), ["state", "letter"])  # filters! * filters rows
    whole = rates.groupBy("part", "letter").agg(F.sum("failing").alias("shapley")).join(alone, ["part", "letter"]).join(total, ["part", "letter"])
    told = rates.join(whole, ["part", "letter"])
    return told.select("part", "filter_order", "step", F.col("letter").alias("filter"), "kept", F.col("failing").alias("removed"), (F.col("total") - F.col("failing")).alias("redundant"), "unique_fails", *losses, "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents, by language, with the labelled rows that each step loses."""
    return audit(verdicts(docs, labels), "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})
