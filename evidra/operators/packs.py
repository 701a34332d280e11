"""Packs of evidence as fields, and how they are brought below a limit.

A pack is a tree: its materials, their attachments, and lists of texts in each. Here it is a table with a row for each text: pack,
role and number of the material, number of the attachment (-1: the material's own), field, place in the field's list, text. Limits
are rows of small tables; they are joined with the fields, so a pack of any size is cut without being gathered, and only what is
left is folded back into structs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.text import truncate_head_tail
from evidra.operators.budgets import running_total, water_levels
from evidra.sources.staging import staged

FIELDS = ("pack", "role", "material", "attachment", "field", "i", "text")
#: A limit that isn't one.
ANY = 1 << 30
# Materials of a role; items and characters of a field for each role and strategy; * stands for all others.
MATERIALS = (("primary", 3), ("auxiliary", 10))
LISTS = ("policy_rules", "price_rules", "time_requirements", "product_scope", "enterprise_requirements", "execution_requirements")
MATERIAL_LIMITS = (
    ("*", "primary", "summary", 1, 500), ("*", "primary", "content_summary", 1, 700), ("*", "primary", "content_text", 1, 5200), ("safe_compact", "primary", "content_text", 1, 12_000), ("table_heavy", "primary", "content_text", 1, 9_000),
    ("*", "primary", "key_facts", 16, ANY), ("*", "primary", "warnings", 6, 220), ("*", "primary", "important_passages", 8, ANY), *(("*", "primary", x, 6, 300) for x in LISTS),
    ("*", "auxiliary", "summary", 1, 500), ("*", "auxiliary", "content_summary", 1, 700), ("*", "auxiliary", "content_text", 1, 900), ("safe_compact", "auxiliary", "content_text", 1, 600), ("attachment_led", "auxiliary", "content_text", 1, 700),
    ("table_heavy", "auxiliary", "content_text", 1, 700), ("*", "auxiliary", "key_facts", 16, ANY), ("*", "auxiliary", "warnings", 6, 220), ("*", "auxiliary", "usable_points", 8, ANY), ("*", "auxiliary", "relevant_snippets", 6, ANY),
)
ATTACHMENTS = (("*", "primary", 8), ("*", "auxiliary", 4), ("safe_compact", "auxiliary", 2), ("attachment_led", "auxiliary", 2), ("table_heavy", "auxiliary", 2))
#: Strategies that keep details whole.
WHOLE = ("full_input", "attachment_led")
# Fixed values of the second pass: least characters of a summary by tier; profiles in their order: least summary, key facts and their characters, sections and theirs.
LEAST_SUMMARY = (("light", 1_000), ("medium", 900), ("strong", 700))
PROFILES = (("light_structure", 220, 4, 180, 2, 160), ("medium_structure", 700, 8, 180, 4, 260), ("strong_structure", 360, 6, 180, 3, 220))
LADDERS = (("light", ("light_structure", "medium_structure", "strong_structure")), ("medium", ("medium_structure", "strong_structure")), ("strong", ("medium_structure", "strong_structure")))
SUMMARIES, ROOM, MARK = 8, 700, " [...] "


def _limits(fields: DataFrame, limits: Sequence[tuple], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """fields with the columns of the limit rows that match all keys, those of the strategy before those of all strategies."""
    rows = fields.sparkSession.createDataFrame(list(limits), ", ".join(f"{n} {'string' if n in ('strategy', *keys) else 'long'}" for n in names))
    told = [n for n in names if n not in ("strategy", *keys)]
    own, rest = rows.where("strategy <> '*'"), rows.where("strategy = '*'").drop("strategy")
    out = fields.join(F.broadcast(own), ["strategy", *keys], "left")  # some 30 rows
    out = out.join(F.broadcast(rest.withColumnsRenamed({n: f"all_{n}" for n in told})), list(keys), "left")
    return out.withColumns({n: F.coalesce(n, f"all_{n}") for n in told}).drop(*(f"all_{n}" for n in told))


def material_profiles(fields: DataFrame, strategies: DataFrame, attachment_limits: Sequence[tuple] = ATTACHMENTS, limits: Sequence[tuple] = MATERIAL_LIMITS, attachment_fields: Sequence[tuple[str, int, int]] = (("summary", 1, 500), ("key_facts", 16, 180), ("sections", 8, 300))) -> DataFrame:
    """The first pass: the fields of the first materials of each role, cut by the limits of their role and the pack's strategy.

    strategies: (pack, strategy). Material and attachment numbers and places count from 0 in the order that holds, core attachments
    first, so nothing is ranked here. With a strategy that keeps details whole, only the number of materials is limited, and fields
    without a limit stay as they are."""
    most = F.coalesce(*(F.when(F.col("role") == r, n) for r, n in MATERIALS))
    told = fields.where(F.col("material") < most).join(strategies, "pack")
    whole = F.col("strategy").isin(*WHOLE)
    told = _limits(told, attachment_limits, ("strategy", "role", "attachments"), ("role",)).where(whole | (F.col("attachment") < F.coalesce("attachments", F.lit(ANY)))).drop("attachments")
    own = _limits(told.where("attachment < 0"), limits, ("strategy", "role", "field", "items", "chars"), ("role", "field"))
    theirs = _limits(told.where("attachment >= 0"), [("*", *x) for x in attachment_fields], ("strategy", "field", "items", "chars"), ("field",))
    cut = own.unionByName(theirs)
    kept = cut.where(whole | (F.col("i") < F.coalesce("items", F.lit(ANY))))
    limit = F.coalesce(F.when(~whole, F.col("chars")), F.lit(ANY)).cast("int")
    return kept.select(*FIELDS[:-1], truncate_head_tail(F.col("text"), limit).alias("text"), "strategy")


def folded(fields: DataFrame) -> DataFrame:
    """(pack, materials): the fields as nested structs, everything in its order. What a pack holds after its limits is small."""
    ordered = lambda key, *value: F.transform(F.sort_array(F.collect_list(F.struct(*key, *value))), lambda x: F.struct(*(x[v].alias(v) for v in value)))
    lists = fields.groupBy("pack", "role", "material", "attachment", "field").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))
    files = lists.groupBy("pack", "role", "material", "attachment").agg(ordered((), "field", "texts").alias("fields"))
    materials = files.groupBy("pack", "role", "material").agg(F.filter(F.sort_array(F.collect_list(F.struct("attachment", "fields"))), lambda x: x["attachment"] < 0)[0]["fields"].alias("fields"), F.filter(F.sort_array(F.collect_list(F.struct("attachment", "fields"))), lambda x: x["attachment"] >= 0).alias("attachments"))
    place = F.when(F.col("role") == "primary", 0).otherwise(1)
    return materials.withColumn("place", place).groupBy("pack").agg(ordered(("place",), "role", "material", "fields", "attachments").alias("materials"))


def trimmed_summaries(fields: DataFrame, packs: DataFrame, summary: Column) -> DataFrame:
    """The first step of the second pass: (the fields, chars). The longest summaries are cut first, none below the least of the tier, until the pack's
    excess over its target is gone. packs: (pack, tier, total, target), for those above their limit."""
    least = F.coalesce(*(F.when(F.col("tier") == t, n) for t, n in LEAST_SUMMARY))
    told = fields.withColumn("chars", F.length("text").cast("long")).join(packs.select("pack", "tier", (F.col("total") - F.col("target")).alias("excess")), "pack")
    told = told.withColumn("room", F.when(summary, F.greatest(F.col("chars") - least, F.lit(0))).otherwise(0).cast("long")).withColumn("shorter", -F.col("chars"))
    key = ["material", "role", "attachment", "field", "i"]
    ranked = running_total(staged(told, "summaries"), "pack", "shorter", key, "room")
    cut = F.least(F.col("room"), F.greatest(F.col("excess") - (F.col("running") - F.col("room")), F.lit(0)))
    return ranked.withColumn("chars", (F.col("chars") - cut).cast("long")).select(*fields.columns, "chars")


def profile_ladder(fields: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, step, profile, summary_limit, chars): for each pack above its limit, the first profile of its tier's ladder under which it
    fits its target, and the largest limit of a summary with which it does; null profile: none fits.

    packs: (pack, tier, target). The first SUMMARIES attachments of a material stay; a profile's summaries get a common limit, from
    its least to the longest, which is a water level with the least as everyone's floor."""
    rungs = [(t, k + 1, *p) for t, names in LADDERS for k, n in enumerate(names) for p in PROFILES if p[0] == n]
    steps = fields.sparkSession.createDataFrame(rungs, "tier string, step int, profile string, least long, facts long, fact_chars long, sections long, section_chars long")
    tried = packs.join(F.broadcast(steps), "tier")  # 7 rungs: at most 3 rows for each pack
    told = fields.where(F.col("attachment") < SUMMARIES).withColumn("chars", F.length("text").cast("long")).join(tried, "pack")
    fact, section, summary = F.col("field") == "key_facts", F.col("field") == "sections", F.col("field") == "summary"
    kept = told.where(~(fact & (F.col("i") >= F.col("facts"))) & ~(section & (F.col("i") >= F.col("sections"))))
    size = F.when(fact, F.least("chars", "fact_chars")).when(section, F.least("chars", "section_chars")).otherwise(F.col("chars"))
    rest = kept.where(~summary).groupBy("pack", "step").agg(F.sum(size).alias("rest"))
    sums = staged(kept.where(summary).select("pack", "step", "chars", F.least("chars", "least").alias("floor")), "rungs")
    wanted = tried.join(rest, ["pack", "step"], "left").select("pack", "step", "profile", "least", "target", F.coalesce("rest", F.lit(0)).alias("rest"))
    wanted = staged(wanted, "wanted")
    levels = water_levels(sums, ["pack", "step"], "chars", "floor", wanted.select("pack", "step", (F.col("target") - F.col("rest")).cast("long").alias("budget")))
    fits = levels.join(wanted, ["pack", "step"]).where(F.col("level").isNotNull()).withColumn("limit", F.greatest("level", "least"))
    used = sums.join(fits.select("pack", "step", "limit", "rest"), ["pack", "step"]).groupBy("pack", "step").agg((F.sum(F.least("chars", "limit")) + F.max("rest")).alias("chars"))
    first = fits.join(used, ["pack", "step"]).groupBy("pack").agg(F.min(F.struct("step", "profile", F.col("limit").alias("summary_limit"), "chars")).alias("x"))
    return packs.select("pack").join(first, "pack", "left").select("pack", "x.*")


def shared_out(strings: DataFrame, path: Sequence[str], size: str, floor: str, budgets: DataFrame) -> DataFrame:
    """strings with `left`, what each keeps of a budget that is shared out down a tree: path names the columns of the nodes from the top
    (whose budgets are given: path[0], budget) to the last above the strings.

    The children of a node are filled to a common level: small ones stay whole, and the larger ones get the same, but never less than
    the floors below them. Where even the floors exceed a budget, its strings keep their floors."""
    share = budgets.select(path[0], F.col("budget").cast("long").alias("budget"))
    for depth in range(1, len(path) + 1):
        here = list(path[:depth])
        if depth < len(path):
            children = strings.groupBy(*here, path[depth]).agg(F.sum(size).cast("long").alias("size_"), F.sum(floor).cast("long").alias("floor_"))
        else:
            children = strings.withColumn("size_", F.col(size).cast("long")).withColumn("floor_", F.col(floor).cast("long"))
        children = staged(children, "children")
        levels = water_levels(children, here, "size_", "floor_", share)
        given = F.least("size_", F.greatest(F.col("floor_"), F.coalesce("level", F.lit(0))))
        told = children.join(levels.select(*here, "level"), here, "left").withColumn("given", F.coalesce(given, F.col("size_")))
        if depth == len(path):
            return told.withColumnRenamed("given", "left").drop("size_", "floor_", "level")
        share = staged(told.select(*here, path[depth], F.col("given").alias("budget")), "shares")
    raise ValueError("a path names one node at least")


def shortened(c: Column, left: Column, mark: str = MARK) -> Column:
    """A text of exactly `left` characters, the mark included; one that fits is whole."""
    n = F.greatest(left - len(mark), F.lit(0)).cast("int")
    return F.when(F.length(c) <= left, c).otherwise(F.substring(truncate_head_tail(c, n, mark), 1, 1 << 30).substr(F.lit(1), F.greatest(left, F.lit(0)).cast("int")))


def hard_limit(strings: DataFrame, protected: Column, least: int, ceilings: DataFrame, path: Sequence[str] = ("pack", "material", "attachment")) -> DataFrame:
    """strings with their text cut so that each pack is below its ceiling, `left` (its characters) and `whole`. Protected strings and
    those up to `least` characters stay whole. A pack whose protected strings alone exceed its ceiling keeps them and its floors: its
    rows say `over`."""
    n = F.length("text").cast("long")
    told = strings.withColumn("chars_", n).withColumn("least_", F.when(protected, n).otherwise(F.least(n, F.lit(least))))
    told = staged(told, "strings")
    over = told.groupBy(path[0]).agg(F.sum("least_").alias("must")).join(ceilings, path[0]).select(path[0], (F.col("must") > F.col("budget")).alias("over"))
    out = shared_out(told, path, "chars_", "least_", ceilings).join(over, path[0])
    return out.withColumn("whole", F.col("left") == F.col("chars_")).withColumn("text", shortened(F.col("text"), F.col("left"))).drop("chars_", "least_")


# The parts of a pack that a model is shown, and which fields each list of a part is made of.
STAGES = (
    ("primary_evidence", "key_facts", "primary", "key_facts"), ("primary_evidence", "important_passages", "primary", "important_passages"), ("primary_evidence", "attachment_summaries", "primary", "summary"),
    ("auxiliary_evidence", "summaries", "auxiliary", "content_summary"), ("auxiliary_evidence", "relevant_snippets", "auxiliary", "relevant_snippets"), ("auxiliary_evidence", "comparison_points", "auxiliary", "usable_points"),
    ("attachment_evidence", "parsed_summaries", "*", "summary"), ("attachment_evidence", "table_summaries", "*", "sections"), ("attachment_evidence", "warnings", "*", "warnings"),
)


def stage_lists(fields: DataFrame, stages: Sequence[tuple[str, str, str, str]] = STAGES, of_files: Sequence[str] = ("attachment_summaries", "parsed_summaries", "table_summaries")) -> DataFrame:
    """(pack, stage, name, texts, from_materials): the lists of each part of a pack, in the order of its materials (primary ones first), their
    attachments and places. Texts are first folded by material and then put together, so a pack with very many of them is never one
    group of single texts; each list is a row of its own. Blank texts bring nothing."""
    rows = fields.sparkSession.createDataFrame(list(stages), "stage string, name string, of_role string, field string")
    told = fields.where(F.trim("text") != "").join(F.broadcast(rows), "field")  # some ten rows
    told = told.where((F.col("of_role") == "*") | (F.col("of_role") == F.col("role"))).where(F.col("name").isin(*of_files) == (F.col("attachment") >= 0))
    place = F.when(F.col("role") == "primary", 0).otherwise(1).alias("first")
    one = told.groupBy("pack", "stage", "name", place, "material").agg(F.transform(F.sort_array(F.collect_list(F.struct("attachment", "i", "text"))), lambda x: x["text"]).alias("texts"))
    whole = F.sort_array(F.collect_list(F.struct("first", "material", "texts")))
    return one.groupBy("pack", "stage", "name").agg(F.flatten(F.transform(whole, lambda x: x["texts"])).alias("texts"), F.count(F.lit(1)).alias("from_materials"))


def fidelity_catalog(fields: DataFrame, sources: Sequence[str], summary_chars: int = 160) -> DataFrame:
    """(pack, role, material, attachment, summary, key_facts, table_headers): what is kept whole of every attachment, however a pack is cut.

    fields have a `source` beside their other columns (the attachment itself or its summary in the material), in the order of sources:
    the longest summary (of equal ones the first) is shortened; facts and headers are united, each once, in the order in which they come."""
    key, order = ("pack", "role", "material", "attachment"), F.struct(F.array_position(F.array(*map(F.lit, sources)), F.col("source")).alias("s"), F.col("i"))
    rows = fields.where((F.col("attachment") >= 0) & F.col("field").isin("summary", "key_facts", "headers") & ((F.col("field") == "summary") | (F.trim("text") != "")))
    # equal texts are one before they are gathered
    each = rows.groupBy(*key, "field", "text").agg(F.min(order).alias("at"))
    of = lambda field: F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == field, F.struct("at", "text")))), lambda x: x["text"])
    back = F.struct(F.length("text").alias("n"), (-F.col("at.s")).alias("s"), (-F.col("at.i")).alias("i"))
    longest = F.max_by(F.when(F.col("field") == "summary", F.col("text")), F.when(F.col("field") == "summary", back))
    return each.groupBy(*key).agg(truncate_head_tail(F.coalesce(longest, F.lit("")), summary_chars).alias("summary"), of("key_facts").alias("key_facts"), of("headers").alias("table_headers"))
