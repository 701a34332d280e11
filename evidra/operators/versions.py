"""Packs of several versions in one column of JSON, brought to evidence items of the newest version, and what each of them loses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import collapse_space
from evidra.operators.evidence import item_id

NEWEST = 2
#: Where version 2 keeps its items, and how they are read.
ITEMS = "array<struct<level:string,kind:string,value:string,mandatory:boolean>>"
MATERIAL = "array<struct<title:string,content_text:string,summary:string,content_summary:string,key_facts:array<struct<name:string,value:string>>,attachments:array<struct<filename:string,summary:string,warnings:array<string>>>>>"
# What version 1 keeps, by its names, and the level, kind and importance that it gets: main text of materials, fields, summaries.
MATERIALS = (("primary_materials", True), ("auxiliary_materials", False))
FIELDS = (("content_text", "A", "article_text"), ("title", "A", "article_field"), ("summary", "C", "summary"), ("content_summary", "C", "summary"))
#: Names of version 1 that are read; all others of a pack are lost.
KNOWN = (*(m for m, _ in MATERIALS), "warnings", "generation_guidance", "evidence_schema_version", "pack_id", "pack_version")


def parsed(packs: DataFrame, pack: str, document: str) -> DataFrame:
    """(pack, doc, version, problem, lost): the document as a variant; its version, 1 where it names none; why it can't be read; and the
    names of version 1 that no item comes from."""
    doc = F.try_parse_json(F.col(document))
    rows = packs.select(F.col(pack).alias("pack"), doc.alias("doc"))
    names = F.map_keys(F.try_variant_get("doc", "$", "map<string,variant>"))
    version = F.coalesce(F.try_variant_get("doc", "$.evidence_schema_version", "int"), F.when(names.isNotNull(), 1))
    problem = F.when(names.isNull(), "not_an_object").when(~version.isin(1, NEWEST), "unknown_version").when((version == NEWEST) & F.try_variant_get("doc", "$.evidence_items", ITEMS).isNull(), "no_items")
    lost = F.when(version == 1, F.sort_array(F.array_except(names, F.array(*map(F.lit, KNOWN)))))
    return rows.select("pack", "doc", version.alias("version"), problem.alias("problem"), F.coalesce(lost, F.expr("cast(array() as array<string>)")).alias("lost"))


def _item(level: str | Column, kind: str | Column, value: Column, mandatory: bool | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(level).alias("level"), lit(kind).alias("kind"), value.cast("string").alias("value"), lit(mandatory).alias("mandatory"))


def _of_material(m: Column, primary: bool) -> Column:
    """Items of one material of version 1. A fact that its text says is derived from it; another one only sums up."""
    own = F.array(*(_item(level, kind, F.trim(m[name]) if name != "content_text" else m[name], primary and name == "content_text") for name, level, kind in FIELDS))
    text = collapse_space(F.coalesce(m["content_text"], F.lit("")))

    def fact(x: Column) -> Column:
        said = (F.trim(x["value"]) != "") & F.contains(text, collapse_space(x["value"]))
        return _item(F.when(said, "B").otherwise("C"), F.when(said, "derived_fact").otherwise("summary"), F.trim(x["value"]), False)

    facts = F.transform(F.coalesce(m["key_facts"], F.array()), fact)
    files = F.coalesce(m["attachments"], F.array())
    sums = F.transform(files, lambda a: _item("C", "summary", F.trim(a["summary"]), False))
    warnings = F.flatten(F.transform(files, lambda a: F.transform(F.coalesce(a["warnings"], F.array()), lambda w: _item("C", "warning", w, False))))
    return F.concat(own, facts, sums, warnings)


def items(packs: DataFrame) -> DataFrame:
    """(pack, from_version, item, level, kind, value, mandatory) from what `parsed` gives: blank values bring nothing, and equal items of a
    pack are one, mandatory if one of them is."""
    good = packs.where("problem is null")
    newest = good.where(F.col("version") == NEWEST).select("pack", "version", F.try_variant_get("doc", "$.evidence_items", ITEMS).alias("found"))
    old = good.where("version = 1")
    warnings = F.transform(F.coalesce(F.try_variant_get("doc", "$.warnings", "array<string>"), F.array()), lambda w: _item("C", "warning", w, False))
    guidance = F.array(_item("C", "guidance", F.try_variant_get("doc", "$.generation_guidance", "string"), False))

    def of(name: str, primary: bool) -> Column:
        return F.flatten(F.transform(F.coalesce(F.try_variant_get("doc", f"$.{name}", MATERIAL), F.array()), lambda m: _of_material(m, primary)))

    parts = [of(name, primary) for name, primary in MATERIALS]
    adapted = old.select("pack", "version", reduce(lambda a, b: F.concat(a, b), [*parts, guidance, warnings]).alias("found"))
    each = newest.unionByName(adapted).select("pack", F.col("version").alias("from_version"), F.inline("found")).where("trim(value) <> ''")
    named = each.withColumn("item", item_id(F.col("level"), F.col("kind"), F.col("value")))
    return named.groupBy("pack", "from_version", "item", "level", "kind", "value").agg(F.bool_or(F.coalesce("mandatory", F.lit(False))).alias("mandatory"))


def supporting(found: DataFrame) -> DataFrame:
    """The items that can support a fact: those that are direct, and those that are derived."""
    return found.where(F.col("level").isin("A", "B"))
