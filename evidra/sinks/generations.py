"""An event log with an index of it, both replaced at once.

Every append writes a generation: a folder of new events and a folder with the index of all events so far. Neither counts until a
manifest names them, and a manifest counts once it is renamed to the next number, which only one writer can. Readers resolve the
highest whole manifest, so they see a log and the index of exactly this log, whatever dies between. Folders that no manifest names
are what dead writers left; `swept` removes them."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Appends of others that a writer goes behind before it gives up.
TRIES = 5


@dataclass
class Generation:
    """A resolved manifest: its number, the folders of the log's events, oldest first, and the folder of the index."""

    number: int
    log: list[str]
    index: str


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/manifests") if n.removesuffix(".json").isdigit())


def current(spark: SparkSession, path: str) -> Generation | None:
    """The newest whole generation; a manifest that was cut short is passed over."""
    for number in reversed(_numbers(spark, path)):
        text = "\n".join(r[0] for r in spark.read.text(f"{path}/manifests/{number:012d}.json", wholetext=True).collect())  # one small file
        try:
            told = json.loads(text)
            body = told["body"]
            if told["sha256"] == _digest(body):
                return Generation(number, body["log"], body["index"])
        except (ValueError, KeyError, TypeError):
            continue
    return None


def _commit(spark: SparkSession, path: str, number: int, body: dict) -> bool:
    """Gives a whole manifest the name of this number, or tells that another writer has it. The file system must refuse to rename over a
    file that is there, as distributed ones do."""
    jvm, (fs, target) = spark._jvm, _fs(spark, f"{path}/manifests/{number:012d}.json")
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"body": body, "sha256": _digest(body)}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception as e:  # noqa: BLE001  Py4J wraps the file system's own exception
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise e
    return True


def indexed(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, revision, and the columns of the last event) of each key's events."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("revision"), F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "revision", "x.*")


def merged(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The index of two parts of a log from their indexes."""
    rest = [c for c in old.columns if c not in (key, "revision")]
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.sum("revision").alias("revision"), F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "revision", "x.*")


def append(events: DataFrame, path: str, key: str, order: list[str], event: str = "event_id") -> Generation | None:
    """Appends the events that the log doesn't have yet, and replaces the index with it. None if there is nothing to append to nothing.

    The index grows by merging, so the log isn't read again but for the ids of its events. A writer that another one overtook begins
    anew behind it."""
    spark = events.sparkSession
    for _ in range(TRIES):
        before = current(spark, path)
        fresh = events.dropDuplicates([event])
        if before:
            fresh = fresh.join(spark.read.json(before.log, schema=events.schema).select(event), event, "left_anti").select(*events.columns)
        own = uuid.uuid4().hex
        part = f"{path}/log/{own}"
        fresh.write.json(part, ignoreNullFields=False)
        written = spark.read.json(part, schema=events.schema)
        if written.isEmpty():
            return before
        index = indexed(written, key, order)
        if before:
            index = merged(spark.read.parquet(before.index), index, key, order)
        index.write.parquet(f"{path}/index/{own}")
        number = max([0, *_numbers(spark, path)]) + 1  # beyond half-written ones, too
        body = {"log": [*(before.log if before else []), part], "index": f"{path}/index/{own}"}
        if before and current(spark, path).number != before.number:
            continue
        if _commit(spark, path, number, body):
            return Generation(number, body["log"], body["index"])
    raise RuntimeError(f"{path}: other writers were always first")


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    now = current(spark, path)
    return spark.read.json(now.log, schema=schema) if now else spark.createDataFrame([], schema)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    now = current(spark, path)
    return spark.read.parquet(now.index) if now else None


def swept(spark: SparkSession, path: str) -> int:
    """Removes what no manifest names any more: folders of dead writers and indexes that were replaced. To be called when nobody writes.
    Returns how many folders went."""
    now = current(spark, path)
    kept = {x.rsplit("/", 1)[1] for x in [*now.log, now.index]} if now else set()
    gone = 0
    for kind in ("log", "index"):
        for name in _names(spark, f"{path}/{kind}"):
            used = name in kept and (kind == "log" or now.index.endswith(name))
            if not used:
                fs, target = _fs(spark, f"{path}/{kind}/{name}")
                fs.delete(target, True)
                gone += 1
    return gone
