"""Merkle manifest of a dataset: a hash tree over the rows of each group, a tree over the groups, and proofs for single rows.

A row's leaf is the hash of its columns. Leaves of a group stand in the order of their ids; every `fanout` consecutive nodes become
their hash, the last run of a level as many as there are, without padding; what remains is the group's root. The roots of the
groups, in the order of the groups, are the leaves of the dataset's tree, built by the same steps.

1. Leaves are hashed in one pass over whole rows and written to the shared folder.
2. They are sorted by group, id and leaf over range partitions and numbered within them; counts of each partition and group give
   every leaf its index. A group that holds most rows lies in many partitions.
3. Every task runs a mountain range over its rows: a stack holds, for each level, the nodes of the run that is open; a full run
   carries into the level above, as digits to the base of the fanout do. Completed nodes are emitted as records. Runs that begin
   or end in another partition can't be completed there: their nodes are emitted as edges, at most two runs a level.
4. Edges of MERGED neighbouring stretches are merged by one task, level by level, and what is still open goes on to the next
   round, until each group is one stretch. A task holds the edges of MERGED stretches, whatever the size of a group.
5. For proofs, a group's leaves are cut into aligned blocks. A block's own levels are rebuilt from its leaves; the siblings on the
   path above it are joined from the records, once for each block. The path above a group comes from the tree of groups.

Rows: null columns are told from empty ones; leaves of equal ids (null ids first) are ordered by their hashes; repeated rows are
leaves of their own; a group may be null (it is first). An empty table has no leaf, no group and no root. Other columns don't
matter. Hashes are lower-case hexadecimal SHA-256, and digests enter a hash as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import n_partitions, small_side, staged

#: Nodes that a run has, leaves of a block at most, stretches that one task merges.
FANOUT, BLOCK, MERGED = 2, 1024, 64
#: Rows of some 100 bytes up to which a side is broadcast.
BROADCAST_ROWS = 100_000
NODES = "grp string, n long, level int, idx long, hash string, part long, edge boolean"
_SCHEMA = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("part", pa.int64()), ("edge", pa.bool_())])


def field(c: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows run into the same bytes; null is a dash."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def group_key(c: Column) -> Column:
    """A key that is never null, in the same order: null before all others."""
    return F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit(""))


def joined(hashes: Sequence[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def sizes_of(n: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def placed(leaves: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(grp, id, leaf, n, pos, and the columns to keep): each leaf with its index in its group, of n leaves; in the shared folder,
    in order. leaves: grp (no null), id, leaf, in the shared folder."""
    p = n_partitions(leaves.sparkSession)
    own = leaves.select("grp", "id", "leaf", *keep).withColumn("tie", F.monotonically_increasing_id())
    order = ["grp", "id", "leaf", "tie"]  # the tie only lets equal rows lie in several partitions
    dealt = own.repartitionByRange(p, *order).sortWithinPartitions(*order).drop("tie")
    dealt = staged(dealt.withColumn("uid", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("uid", 33))
    parts = staged(dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here"), F.min("uid").alias("first")), "parts")
    of_group = Window.partitionBy("grp")  # a row for each partition, not for each leaf
    before = F.coalesce(F.sum("here").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("grp", "part", "first", before.alias("before"), F.sum("here").over(of_group).alias("n"))
    told = dealt.join(small_side(starts, parts.count(), BROADCAST_ROWS), ["grp", "part"])
    told = told.select("grp", "id", "leaf", *keep, "n", (F.col("uid") - F.col("first") + F.col("before")).alias("pos"))
    return staged(told, "placed")


class Range:
    """The mountain range over a stretch of consecutive leaves of a group of n. Nodes enter in order; `nodes` gets the completed ones."""

    def __init__(self, n: int, fanout: int):
        self.sizes, self.fanout, self.nodes = sizes_of(n, fanout), fanout, []
        self.edges: list[tuple[int, int, str]] = []
        self.open: list[list[str]] = [[] for _ in self.sizes]
        self.first = [0] * len(self.sizes)

    def add(self, level: int, idx: int, hash: str) -> None:
        while level < len(self.sizes) - 1:
            run, at = self.open[level], idx // self.fanout
            if not run:
                self.first[level] = idx
            run.append(hash)
            if idx + 1 < min((at + 1) * self.fanout, self.sizes[level]):
                return
            # the run is at its end: it carries, if it began here
            if self.first[level] != at * self.fanout:
                self._edge(level)
                return
            hash, level, idx = joined(run), level + 1, at
            run.clear()
            self.nodes.append((level, idx, hash))

    def _edge(self, level: int) -> None:
        self.edges += [(level, self.first[level] + k, h) for k, h in enumerate(self.open[level])]
        self.open[level].clear()

    def close(self) -> list[tuple[int, int, str]]:
        """The nodes of the runs that this stretch can't complete."""
        for level in range(len(self.sizes)):
            self._edge(level)
        return self.edges


def merge_edges(n: int, fanout: int, edges: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(completed nodes, edges that are still open), of the edges of neighbouring stretches."""
    sizes, by_level = sizes_of(n, fanout), {}
    for level, idx, hash in edges:
        by_level.setdefault(level, {})[idx] = hash
    done, still = [], []
    for level, size in enumerate(sizes[:-1]):
        here = by_level.get(level, {})
        for run in sorted({idx // fanout for idx in here}):
            members = range(run * fanout, min((run + 1) * fanout, size))
            if all(i in here for i in members):
                done.append((level + 1, run, joined([here[i] for i in members])))
                by_level.setdefault(level + 1, {})[run] = done[-1][2]
            else:
                still += [(level, i, here[i]) for i in members if i in here]
    return done, still


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)


def nodes_of(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, n, level, idx, hash): all nodes above the leaves, in the shared folder. leaves: what `placed` gives."""

    def mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, stretch, due, start = [], None, None, -1, 0

        def told(edges: bool) -> None:
            out.extend((*key, *x, start, False) for x in stretch.nodes)
            stretch.nodes.clear()
            if edges:
                out.extend((*key, *x, start, True) for x in stretch.close())

        for batch in batches:
            for grp, n, pos, leaf in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "pos", "leaf")), strict=True):
                if pos != due or (grp, n) != key:  # another stretch begins
                    if stretch:
                        told(True)
                    key, stretch, start = (grp, n), Range(n, fanout), pos
                stretch.add(0, pos, leaf)
                due = pos + 1
                if len(stretch.nodes) >= 4096:
                    told(False)
                    yield _batch(out)
                    out.clear()
        if stretch:
            told(True)
        yield _batch(out)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows:
            return _SCHEMA.empty_table()
        grp, n, start = rows[0]["grp"], rows[0]["n"], min(r["part"] for r in rows)
        done, still = merge_edges(n, fanout, [(r["level"], r["idx"], r["hash"]) for r in rows])
        return pa.Table.from_batches([_batch([(grp, n, *x, start, False) for x in done] + [(grp, n, *x, start, True) for x in still])])

    found = staged(leaves.select("grp", "n", "pos", "leaf").mapInArrow(mountains, NODES), "mountains")
    rounds = [found.where("not edge")]
    while not (edges := found.where("edge")).isEmpty():
        # stretches by their first leaf: a row for each, not for each node
        starts = edges.groupBy("grp", "part").agg(F.lit(1).alias("one"))
        numbered = starts.select("grp", "part", F.floor((F.row_number().over(Window.partitionBy("grp").orderBy("part")) - 1) / MERGED).alias("lot"))
        found = staged(edges.join(numbered, ["grp", "part"]).groupBy("grp", "lot").applyInArrow(merge, NODES), "merged")
        rounds.append(found.where("not edge"))
    nodes = rounds[0]
    for x in rounds[1:]:
        nodes = nodes.unionByName(x)
    return nodes.select("grp", "n", "level", "idx", "hash")


def tops_of(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, n, root) for each group; the root over a single leaf is the leaf."""
    top = nodes.where("idx = 0").groupBy("grp", "n").agg(F.max_by("hash", "level").alias("root"))
    return top.unionByName(leaves.where("n = 1").select("grp", "n", F.col("leaf").alias("root")))


STEP = "struct<before:string,after:string>"


def _siblings(members: list[str | None], at: int) -> dict[str, str]:
    """The others of a run, as the text before and after the node's own hash."""
    return {"before": "".join(members[:at]), "after": "".join(members[at + 1 :])}


def with_proofs(leaves: DataFrame, nodes: DataFrame, fanout: int = FANOUT, block: int = BLOCK, ends: DataFrame | None = None) -> DataFrame:
    """leaves, with all their columns, and `path`: for each level of the group's tree, the siblings before and after the node above the
    leaf. ends: (grp, subroot, root, rest), a row for each group, whose columns come along and whose `rest` continues the path."""
    deep, size = 0, 1
    while size * fanout <= max(block, fanout):
        deep, size = deep + 1, size * fanout
    cut = leaves.withColumn("block", F.floor(F.col("pos") / size))
    blocks = cut.groupBy("grp", "n", "block").agg(F.lit(1).alias("one")).drop("one")
    # the runs on the path from a block to the top: level deep + k has the node block / fanout^k; levels above the top have no run
    levels = F.expr(f"transform(sequence(0, greatest(0, cast(ceil(log(n) / log({fanout})) as int) - {deep} + 1)), k -> struct({deep} + k as level, cast(floor(block / pow({float(fanout)}, k)) as long) as own))")
    wanted = blocks.select("grp", "block", F.inline(levels)).withColumn("run", F.floor(F.col("own") / fanout))
    above = nodes.where(F.col("level") >= deep).select("grp", "level", F.floor(F.col("idx") / fanout).alias("run"), "idx", "hash")
    runs = above.groupBy("grp", "level", "run").agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("members"))  # fanout at most
    outer = wanted.join(runs, ["grp", "level", "run"]).groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("level", "own", "members"))).alias("outer"))
    frame = blocks.drop("n").join(outer, ["grp", "block"], "left")
    if ends is not None:
        frame = frame.join(small_side(ends, ends.count(), BROADCAST_ROWS), "grp")
    frame = staged(frame, "frames")
    told = [] if ends is None else ["subroot", "root"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields), *(f"{c} string" for c in told), f"path array<{STEP}>"])
    paths = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def prove(inner: pa.Table, frame: pa.Table) -> pa.Table:
        inner = inner.drop_columns("block").sort_by("pos")
        x = frame.to_pylist()[0]
        sizes = sizes_of(inner.column("n")[0].as_py(), fanout)
        own = min(deep, len(sizes) - 1)  # levels whose runs lie inside the block
        levels = [inner.column("leaf").to_pylist()]
        while len(levels) < own:
            levels.append([joined(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        rest = []
        for level in x["outer"] or []:
            if level["level"] < len(sizes) - 1:
                at = [m["idx"] for m in level["members"]].index(level["own"])
                rest.append(_siblings([m["hash"] for m in level["members"]], at))
        rest += x.get("rest") or []
        out = []
        for k in range(inner.num_rows):
            steps = []
            for low in levels[:own]:
                run = k // fanout * fanout
                steps.append(_siblings(low[run : run + fanout], k - run))
                k //= fanout
            out.append(steps + rest)
        for c in told:
            inner = inner.append_column(c, pa.array([x[c]] * inner.num_rows, pa.string()))
        return inner.append_column("path", pa.array(out, paths))

    return cut.groupBy("grp", "block").cogroup(frame.groupBy("grp", "block")).applyInArrow(prove, schema)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to: what a reader of the manifest computes to verify a row."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.concat(x["before"], own, x["after"]), 256))


def path_text(path: Column) -> Column:
    """All siblings on a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


@dataclass
class Manifest:
    """leaves: grp, id, leaf, n, pos and kept columns; nodes: all nodes above them; groups: grp, its root (leaf), the root of the dataset
    and the path from the one to the other."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    fanout: int

    def proofs(self) -> DataFrame:
        """The leaves with subroot, root, path: all siblings from the leaf to the root of the dataset."""
        ends = self.groups.select("grp", F.col("leaf").alias("subroot"), "root", F.col("path").alias("rest"))
        return with_proofs(self.leaves, self.nodes, self.fanout, ends=ends)


def manifest(leaves: DataFrame, keep: Sequence[str] = (), fanout: int = FANOUT) -> Manifest:
    """leaves: grp (no null), id, leaf and columns to keep, in the shared folder."""
    own = placed(leaves, keep)
    nodes = nodes_of(own, fanout)
    tops = staged(tops_of(own, nodes).select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf")), "tops")
    groups = placed(tops)
    above = nodes_of(groups, fanout)
    root = tops_of(groups, above).select("grp", "root")
    told = with_proofs(groups, above, fanout).join(F.broadcast(root), "grp")  # one row
    return Manifest(own, nodes, staged(told.drop("grp", "n", "pos").withColumnRenamed("id", "grp"), "groups"), fanout)


def document_leaves(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(grp, id, leaf, changed) of rows, in the shared folder. changed: the leaf with other values for some columns, in the rows that
    `where` names; else null."""
    other = leaf_of([(tampered or {}).get(c, F.col(c)) for c in columns])
    changed = F.when(where, other) if where is not None else F.lit(None).cast("string")
    return staged(docs.select(group_key(F.col(group)).alias("grp"), F.col(id_col).alias("id"), leaf_of([F.col(c) for c in columns]).alias("leaf"), changed.alias("changed")), "leaves")


def verify_documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row: the manifest of docs, and whether rows are told to
    be in it where the n_chars of those whose id's crc32 `every` divides is one more than it was."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    found = manifest(document_leaves(docs, tampered={"n_chars": F.col("n_chars") + 1}, where=hit), ["changed"]).proofs()
    told = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return told.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(path_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
