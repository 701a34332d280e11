"""Queries over tables of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import grids
from evidra.plans.registry import query, quoted
from evidra.sources import table

#: Kinds of columns that the given tables have.
_KINDS = {"key": ("key",), "name": ("name", "brand"), "price": ("price", "acctbal", "value"), "quantity": ("quantity", "size"), "time": ("date", "ts"), "status": ("status", "flag", "priority", "type")}
_SQL_KINDS = ", ".join(f"{{'kind': '{k}', 'words': [{quoted(w)}]}}" for k, w in _KINDS.items())


@query(f"""
with h as (select 'part' as tbl, p_partkey as group_key, unnest(['part key', 'Name ' || p_brand, p_type || ' status', 'size', 'retail price']) as header from part union all select 'orders', o_orderkey, unnest([o_orderpriority, 'order date', 'total price ' || o_orderstatus]) from orders),
k as (select unnest([{_SQL_KINDS}], recursive := true)), f as (select tbl, group_key, header, kind from h, k where len(list_filter(words, lambda w: contains(lower(header), w))) > 0)
select tbl, kind, count(*) as headers, count(distinct header) as different from f group by 1, 2""")
def column_semantics(spark, d):
    """Kinds of columns by their headers: header rows made of each part and order; all headers of both tables are read."""
    t = lambda n: table(spark, d, n)
    of_part = F.array(F.lit("part key"), F.concat(F.lit("Name "), "p_brand"), F.concat("p_type", F.lit(" status")), F.lit("size"), F.lit("retail price"))
    of_order = F.array(F.col("o_orderpriority"), F.lit("order date"), F.concat(F.lit("total price "), "o_orderstatus"))
    rows = t("part").select(F.lit("part").alias("tbl"), F.explode(of_part).alias("header")).unionByName(t("orders").select(F.lit("orders").alias("tbl"), F.explode(of_order).alias("header")))
    found = rows.groupBy("tbl", "header").agg(F.count(F.lit(1)).alias("n")).select("tbl", "header", "n", F.explode(grids.kinds_of(F.col("header"), _KINDS)).alias("kind"))
    return found.groupBy("tbl", "kind").agg(F.sum("n").alias("headers"), F.count(F.lit(1)).alias("different"))


_CELLS = ("p_name", "p_brand", "p_type", "p_size")


@query(f"""
with v as (select p_partkey, case field when 'p_name' then 'name' when 'p_brand' then 'name' when 'p_type' then 'status' else 'quantity' end as kind, field, trim(value) as v from (select p_partkey, p_name, p_brand, p_type, cast(p_size as varchar) as p_size from part)
 unpivot (value for field in (p_name, p_brand, p_type, p_size))),
e as (select kind, v, count(*) as n, min((p_partkey, field)) as pos, try_cast(nullif(regexp_extract(v, '-?[0-9]+(?:\\.[0-9]+)?'), '') as double) as x from v where v <> '' group by 1, 2),
s as (select kind, string_agg(v, '|' order by r) as samples from (select *, row_number() over (partition by kind order by pos) as r from e) where r <= 5 group by 1)
select kind, cast(sum(n) as bigint) as non_empty, count(*) as unique_values, min(x) as least, max(x) as most, samples from e join s using (kind) group by kind, samples""")
def pooled_field_stats(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size")).unpivot("p_partkey", list(_CELLS), "field", "value")
    known = rows.withColumn("kind", F.explode(grids.kinds_of(F.col("field"), _KINDS)))
    return grids.pooled_stats(known, "kind", "value", ["p_partkey", "field"])


@query("""
select n_name, count(*) as n_rows, count(distinct c_name) as companies, count(distinct c_mktsegment) as segments, round(min(o_totalprice), 4) as least, round(max(o_totalprice), 4) as most, round(avg(o_totalprice), 6) as mean,
 count(*) filter (o_orderkey is null) as missing, (select string_agg(c_mktsegment || '=' || n, ',' order by n desc, first_at) from (select c_mktsegment, count(*) as n, min(c_custkey) as first_at from customer x where x.c_nationkey = n_nationkey group by 1)) as categories
from nation join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_nationkey, n_name""")
def table_summary_legacy(spark, d):
    customers = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = customers.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    price = F.col("o_totalprice")
    stats = rows.groupBy("n_nationkey", "n_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("c_name").alias("companies"), F.countDistinct("c_mktsegment").alias("segments"), F.round(F.min(price), 4).alias("least"),
        F.round(F.max(price), 4).alias("most"), F.round(F.avg(price), 6).alias("mean"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"),
    )
    of = customers.groupBy("n_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_at"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "first_at", "c_mktsegment", "n"))), 1, 30)
    top = of.groupBy("n_nationkey").agg(F.array_join(F.transform(ranked, lambda x: F.concat(x.c_mktsegment, F.lit("="), x.n)), ",").alias("categories"))
    return stats.join(top, "n_nationkey").drop("n_nationkey")


@query("""
with r as (select o_orderkey, l_linenumber - 1 as row_no, [l_returnflag, l_linestatus, case when l_quantity > 40 then 'price' when l_quantity > 30 then 'Price key' when l_quantity > 20 then '' else cast(l_quantity as varchar) end] as cells, l_partkey, l_suppkey, l_extendedprice
 from orders join lineitem on l_orderkey = o_orderkey),
u as (select o_orderkey, row_no, cells, row_number() over (partition by o_orderkey, row_no order by l_partkey, l_suppkey, l_extendedprice) as one from r),
s as (select o_orderkey, row_no, cells, len(list_filter(cells, lambda c: contains(c, 'key'))) as keys, len(list_filter(cells, lambda c: c <> '')) as filled,
 case when contains(lower(array_to_string(cells, ' ')), 'price') then 1 else 0 end + case when contains(lower(array_to_string(cells, ' ')), 'key') then 1 else 0 end as kinds from u where one = 1 and row_no < 25)
select o_orderkey, cast(row_no as bigint) as header_row, array_to_string(cells, '|') as header, cast(10 * keys + 4 * kinds + least(filled, 12) as bigint) as score from s
qualify row_number() over (partition by o_orderkey order by 10 * keys + 4 * kinds + least(filled, 12) desc, keys desc, filled desc, row_no) = 1""")
def header_rows(spark, d):
    q = F.col("l_quantity")
    third = F.when(q > 40, "price").when(q > 30, "Price key").when(q > 20, "").otherwise(F.regexp_replace(q.cast("string"), "", ""))
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("row_no"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("by"), F.array("l_returnflag", "l_linestatus", third).alias("cells"))
    one = lines.groupBy("l_orderkey", "row_no").agg(F.min_by("cells", "by").alias("cells")).withColumnRenamed("l_orderkey", "o_orderkey")
    found = grids.headers(one, "o_orderkey", "row_no", "cells", keys=("key",), kinds={"price": ("price",), "key": ("key",)})
    return found.select("o_orderkey", "header_row", F.array_join("header", "|").alias("header"), "score")


@query("""
with c as (select conv_id, turn, list_transform(regexp_split_to_array(trim(text), ' +'), lambda x: trim(regexp_replace(x, '[ \t\n\r\x0b\x0c]+', ' ', 'g'))) as c from conversations)
select conv_id, turn, array_to_string(case when len(c) <= 4 then list_resize(c, 4, '') else list_append(c[1:3], array_to_string(list_filter(c[4:], lambda x: x <> ''), '；')) end, '|') as fitted from c""")
def fitted_rows(spark, d):
    cells = F.split(F.trim("text"), " +")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(grids.fitted(cells, 4), "|").alias("fitted"))


@query("""
with p as (select p_brand, p_partkey, p_type, p_size from part),
r as (select *, row_number() over (partition by p_brand order by p_partkey) as pos, count(*) over (partition by p_brand) as n, row_number() over (partition by p_brand, p_type order by p_partkey) as it from p),
a as (select *, pos = 1 or pos = n or it = 1 as mine from r), a2 as (select *, count(*) filter (mine) over (partition by p_brand) as m, count(*) filter (mine) over (partition by p_brand order by pos) - 1 as place from a),
a3 as (select *, least(8, m) as take from a2), a4 as (select *, case when mine and (m <= take or list_contains(list_transform(range(take), lambda i: cast(round_even(i * (m - 1) / greatest(take - 1, 1.0), 0) as bigint)), place)) then 0 end as tier, 8 - take as left1 from a3),
b as (select p_brand, p_partkey, p_size, pos, n, tier, left1, tier is null and p_size >= 30 as mine from a4), b2 as (select *, count(*) filter (mine) over (partition by p_brand) as m, count(*) filter (mine) over (partition by p_brand order by pos) - 1 as place from b),
b3 as (select *, least(left1, m) as take from b2), b4 as (select *, case when tier is not null then tier when mine and take > 0 and (m <= take or list_contains(list_transform(range(take), lambda i: cast(round_even(i * (m - 1) / greatest(take - 1, 1.0), 0) as bigint)), place)) then 1 end as tier2, left1 - take as left2 from b3),
c as (select p_brand, p_partkey, pos, n, tier2, left2, tier2 is null as mine from b4), c2 as (select *, count(*) filter (mine) over (partition by p_brand) as m, count(*) filter (mine) over (partition by p_brand order by pos) - 1 as place from c),
c3 as (select *, least(left2, m) as take from c2)
select p_brand, p_partkey, cast(case when tier2 is not null then tier2 when mine and take > 0 and (m <= take or list_contains(list_transform(range(take), lambda i: cast(round_even(i * (m - 1) / greatest(take - 1, 1.0), 0) as bigint)), place)) then 2 end as bigint) as tier from c3
where n <= 8 or tier2 is not null or (mine and take > 0 and (m <= take or list_contains(list_transform(range(take), lambda i: cast(round_even(i * (m - 1) / greatest(take - 1, 1.0), 0) as bigint)), place)))""")
def cell_budget(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_type", "p_size")
    return grids.cell_budget(rows, "p_brand", "p_partkey", "p_type", F.col("p_size") >= 30, 8).select("p_brand", "p_partkey", F.col("tier").cast("long").alias("tier"))


@query("""
with t as (select s_suppkey % 7 as t, s_nationkey as r, 1 as c, s_name as v from supplier), p as (select o_orderkey, l_returnflag || l_linestatus as v, l_linenumber as r from orders join lineitem on l_orderkey = o_orderkey),
f as (select o_orderkey, sha256(string_agg(r || chr(31) || 1 || chr(31) || v, chr(30) order by r, v)) as fingerprint from p group by 1)
select o_orderkey, fingerprint, count(*) over (partition by fingerprint) as copies, o_orderkey = min(o_orderkey) over (partition by fingerprint) as kept from f""")
def unique_tables(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("r"), F.lit(1).alias("c"), F.concat("l_returnflag", "l_linestatus").alias("v"))
    known = cells.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return grids.unique_tables(known, ["o_orderkey"], "r", "c", "v")


@query("""
select r_name, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(n_name, '|', '\\|') || ' | ' || n_nationkey || ' |', chr(10) order by n_nationkey) as markdown from region join nation on n_regionkey = r_regionkey group by 1""")
def markdown_tables(spark, d):
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    rows = both.groupBy("r_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x.n_name, x.n_nationkey.cast("string"))).alias("rows"))
    return rows.select("r_name", grids.markdown_table(F.array(F.lit("nation"), F.lit("key")), F.col("rows")).alias("markdown"))
