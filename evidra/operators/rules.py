"""Rules of a domain as a table, checked by a query that names each fault, and versioned by what they say.

A row is one value of a rule: section (version, trigger, topics, phrases, sections), entry (its place in the section), field, value.
Lists have a row for each member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.facts import Rules

SCHEMA = "section string, entry int, field string, value string"
# Fields that an entry of a section needs, fields of which it needs one value at least, and how facts may be shown.
NEEDED = (("version", "version"), ("topics", "topic_id"), ("topics", "presentation"), ("topics", "failure_code"), ("sections", "section_id"))
LISTS = (("trigger", "menu_names"), ("sections", "labels"))
SECTIONS, SHOWN, UNIQUE = ("version", "trigger", "topics", "sections"), ("table", "section", "section_or_table"), (("topics", "topic_id"), ("sections", "section_id"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from files of JSON lines."""
    return spark.read.schema(SCHEMA).json(path)


def violations(rules: DataFrame, sections: tuple[str, ...] = SECTIONS, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """(section, entry, field, problem): sections that aren't there, entries without what they need, blank values, unknown ways of showing,
    and ids that an earlier entry has."""
    entries = rules.select("section", "entry").distinct()
    filled = rules.where(F.trim("value") != "").select("section", "entry", "field").distinct()
    needed = rules.sparkSession.createDataFrame([*NEEDED, *LISTS], "section string, field string")
    said = lambda rows, problem: rows.select("section", "entry", "field", F.lit(problem).alias("problem"))
    found = [said(entries.join(F.broadcast(needed), "section").join(filled, ["section", "entry", "field"], "left_anti"), "missing")]  # a row for each need
    every = rules.sparkSession.createDataFrame([(s,) for s in sections], "section string")
    found.append(said(every.join(entries, "section", "left_anti").withColumns({"entry": F.lit(None).cast("int"), "field": F.lit("")}), "missing_section"))
    found.append(said(rules.where(F.coalesce(F.trim("value"), F.lit("")) == ""), "blank"))
    found.append(said(rules.where((F.col("field") == "presentation") & (F.trim("value") != "") & ~F.trim("value").isin(*shown)), "unknown_presentation"))
    ids = rules.where(reduce(lambda a, b: a | b, [(F.col("section") == s) & (F.col("field") == f) for s, f in UNIQUE])).withColumn("id", F.trim("value")).where("id <> ''")
    first = ids.groupBy("section", "field", "id").agg(F.min("entry").alias("first"))
    found.append(said(ids.join(first, ["section", "field", "id"]).where("entry > first"), "repeated"))
    return reduce(DataFrame.unionByName, found)


def version_of(rules: DataFrame) -> Column:
    """sha256 of all rows in their order: the same rules have the same version wherever they lie. To be used in an aggregate."""
    row = F.struct("section", "entry", "field", F.coalesce("value", F.lit("")).alias("value"))
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.concat_ws("\x1f", x["section"], x["entry"].cast("string"), x["field"], x["value"])), "\x1e"), 256)


def checked(rules: DataFrame) -> tuple[Rules, str]:
    """The rules as a value, and their version; an error that names the faults, if there are some. Rules are a few hundred rows."""
    wrong = [f"{r['section']}[{r['entry']}].{r['field']}: {r['problem']}" for r in violations(rules).orderBy("section", "entry", "field", "problem").collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    held: dict[tuple, dict[str, list[str]]] = {}
    for r in rules.orderBy("section", "entry", "field", "value").collect():
        held.setdefault((r["section"], r["entry"]), {}).setdefault(r["field"], []).append(r["value"].strip())
    of = lambda section: [x for (s, _), x in sorted(held.items()) if s == section]
    topics = tuple((x["topic_id"][0], tuple(x.get("labels", x["topic_id"]))) for x in of("topics"))
    needed = tuple((x["section_id"][0], tuple(x["labels"])) for x in of("sections"))
    phrases = tuple(v for x in of("phrases") for v in x.get("phrase", []))
    return Rules(topics=topics, forbidden=phrases, sections=needed), rules.agg(version_of(rules).alias("v")).first()["v"]
