"""The queries of the driver contract for the reference operators, each with the SQL that gives the same rows.

The tables hold no source code, so operators are bound to tables of keys and references here; refgraph.plans.project binds
the same operators to source trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.functions.globs import ignored, rules
from refgraph.functions.paths import normalize_path, package_name, route_stem
from refgraph.operators import reference as ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select o_orderkey, o_orderstatus from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unreferenced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("select o_orderkey, o_orderstatus from orders o where o_orderstatus <> 'P' and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def orphan_orders_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return ops.unreferenced(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", exempt=F.col("o_orderstatus") == "P")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unreferenced(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("select l_partkey, l_orderkey, l_linenumber from lineitem l where not exists (select 1 from part p where p.p_partkey = l.l_partkey and p.p_size <= 45)")
def dangling_part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "part").where("p_size <= 45")
    return ops.dangling(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), declared, "l_partkey", "p_partkey")


@query("select l_partkey, l_orderkey, l_linenumber from lineitem l where exists (select 1 from part p where p.p_partkey = l.l_partkey and p.p_size <= 5)")
def resolved_part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "part").where("p_size <= 5")
    return ops.resolved(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), declared, "l_partkey", "p_partkey")


@query("select p_partkey, count(distinct l_orderkey) as imported_by from part left join lineitem on l_partkey = p_partkey group by p_partkey")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.in_degree(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey", "l_orderkey")


@query("select l_orderkey, count(distinct l_partkey) as targets, count(*) as imports from lineitem group by l_orderkey")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.out_degree(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("""
select distinct o_custkey, o_orderpriority from orders
where (o_custkey, o_orderpriority) not in (select (o_custkey, o_orderpriority) from orders where o_orderkey % 3 = 0) and o_custkey not in (select o_custkey from orders where o_orderkey % 16 = 5)""")
def dead_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (priorities) of customers: every third order uses one, every 16th all of a customer's."""
    orders, keys = table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]
    return ops.dead_members(orders.select(*keys).distinct(), orders.where("o_orderkey % 3 = 0").select(*keys).distinct(), keys, orders.where("o_orderkey % 16 = 5").select("o_custkey").distinct())


@query("""
select user_id, string_agg(distinct event_type, ',' order by event_type) as used, bool_or(event_type = 'error') as uses_namespace, bool_or(event_type = 'signup') as uses_unknown
from events group by user_id""")
def usage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = ops.usage(table(spark, sf_dir, "events"), "user_id", kind, kind == "error", kind == "signup")
    return found.withColumn("used", F.array_join(F.array_sort("used"), ","))


@query("""
select o_orderkey, case when o_orderpriority = '1-URGENT' then 'user-entry' when o_orderstatus = 'P' then 'package-entry'
  when o_totalprice > 400000 then 'app-entry' when o_orderpriority = '2-HIGH' and o_orderstatus = 'F' then 'tooling-entry' end as kind from orders""")
def entry_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = ops.cascade([(priority == "1-URGENT", "user-entry"), (status == "P", "package-entry"), (F.col("o_totalprice") > 400000, "app-entry"), ((priority == "2-HIGH") & (status == "F"), "tooling-entry")])
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@query("""
select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem l
where not exists (select 1 from (values ('A', null), ('R', 'O')) r(flag, status) where r.flag = l.l_returnflag and (r.status is null or r.status = l.l_linestatus))""")
def suppressed_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("A", None), ("R", "O")], "l_returnflag string, l_linestatus string")
    return ops.suppressed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), known, ["l_returnflag"], ["l_linestatus"])


_SIDES = """
with b as (select l_partkey, l_linenumber, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' group by all),
a as (select l_partkey, l_linenumber, count(*) as n from lineitem where l_shipdate >= timestamp '1998-01-01' group by all),
sides as (select l_partkey, l_linenumber, coalesce(b.n, 0) as was, coalesce(a.n, 0) as now from b full join a using (l_partkey, l_linenumber))
"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_shipdate")
    old = F.col("l_shipdate") < F.expr("timestamp_ntz '1998-01-01'")
    return ops.bag_diff(lines.where(old), lines.where(~old), ["l_partkey", "l_linenumber"])


@query(_SIDES + "select l_partkey, l_linenumber from sides, range(now - was) where now > was")
def bag_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bag_rows(_diff(spark, sf_dir), "introduced")


@query(_SIDES + "select l_partkey, l_linenumber from sides, range(was - now) where was > now")
def bag_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bag_rows(_diff(spark, sf_dir), "resolved")


@query(_SIDES + "select l_partkey, l_linenumber from sides, range(least(was, now)) where was > 0 and now > 0")
def bag_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bag_rows(_diff(spark, sf_dir), "persisted")


@query(_SIDES + """, n as (select sum(greatest(now - was, 0))::bigint as i, sum(greatest(was - now, 0))::bigint as r, sum(least(was, now))::bigint as p from sides)
select 'introduced' as change, i as n from n union all select 'resolved', r from n union all select 'persisted', p from n union all select 'total', i + r + p from n""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.diff_summary(_diff(spark, sf_dir))


@query("select c_custkey, ((c_acctbal + 1000) / 11000)::float as confidence, ((c_acctbal + 1000) / 11000)::float >= 0.88::float as eligible from customer")
def threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 11000).cast("float").alias("confidence"))
    return ops.threshold_split(rows, "confidence", 0.88)


_PATH = r"regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@query(rf"""
with p as (select page_id, {_PATH} as path from pages)
select page_id, path, case when regexp_matches(path, '^(?:.*/)?(?:[^/]*7)(?:/.*)?$') then false
  when regexp_matches(path, '^(?:.*/)?(?:[^/]*[^/]7[^/]*)(?:/.*)?$') then true when regexp_matches(path, '^(?:(?:.*/)?[^/]*1[^/]*)(?:/.*)?$') then true else false end as ignored from p""")
def glob_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("ignored", ignored(F.col("path"), rules(["**/*1*", "*?7*", "!*7"])))


@query(rf"select page_id, case when {_PATH} = '' then '.' else regexp_replace({_PATH}, '/+$', '') end as path from pages")
def url_path_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ./x/../ in front of each path goes again
    path = F.concat(F.lit("./x/../"), F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""))
    return table(spark, sf_dir, "pages").select("page_id", normalize_path(path).alias("path"))


@query(r"""
with links as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages),
known as (select distinct regexp_extract(url, '([0-9]+)[^0-9]*$', 1) as number from pages where page_id % 2 = 0),
asked as (select page_id, href, regexp_extract(href, '([0-9]+)[^0-9]*$', 1) as number from links)
select page_id, href, case when number <> '' and number in (select number from known) then number when page_id % 3 = 0 then 'index' end as path from asked""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to numbered pages, by number: as it is, or else, in every third page, by an index."""
    pages, number = table(spark, sf_dir, "pages"), lambda c: F.regexp_extract(c, "([0-9]+)[^0-9]*$", 1)
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = pages.where("page_id % 2 = 0").select(number("url").alias("number")).union(spark.createDataFrame([("index",)], "number string"))
    tried = F.filter(F.array(number("href"), F.when(F.col("page_id") % 3 == 0, "index")), lambda x: x.isNotNull() & (x != ""))
    return ops.first_match(links, tried, known, "number").select("page_id", "href", "path")


@query("""
select l_orderkey, l_linenumber, case when exists (select 1 from part where p_partkey = l_partkey and p_size < 10) then l_partkey
  when exists (select 1 from part where p_partkey = l_partkey + 1 and p_size < 10) then l_partkey + 1
  when exists (select 1 from part where p_partkey = l_partkey + 2 and p_size < 10) then l_partkey + 2 end as path from lineitem""")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    tried = F.array(*(F.col("l_partkey") + k for k in range(3)))
    return ops.first_match(lines, tried, table(spark, sf_dir, "part").where("p_size < 10"), "p_partkey").select("l_orderkey", "l_linenumber", "path")


@query("""
select p_partkey, case when name like 'part 1%9' then 'nine/' || substr(name, 7, length(name) - 7) when name like 'part 1%' then 'one/' || substr(name, 7)
  when name like 'part%' then 'any/' || substr(name, 5) end as target from (select p_partkey, case when p_size > 40 then p_type else 'part ' || p_partkey end as name from part) p""")
def prefix_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.concat(F.lit("part "), F.col("p_partkey").cast("string")))
    aliases = [("part*", "any/*"), ("part 1*", "one/*"), ("part 1*9", "nine/*")]
    return table(spark, sf_dir, "part").select("p_partkey", ops.alias_match(name, aliases).alias("target"))


@query("select text, min(doc_id) as doc_id from documents group by text")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_occurrence(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 5")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.preview(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 5)


@query("select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)) as excerpt from documents")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ops.excerpt(F.col("text"), 20).alias("excerpt"))


@query("select page_id, url, row_number() over (order by string_split(url, '/'), page_id)::int as place from pages")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return ops.placed(pages, [F.split("url", "/"), F.col("page_id")]).withColumn("place", F.col("place").cast("int"))


@query("select event_type, count(*) as n, sum(cast(props->>'$.k' as bigint))::bigint as k from events group by event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("""
select (select count(*) from orders) as files, (select count(*) from orders where o_orderstatus = 'P') as entrypoints,
  (select count(*) from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)) as orphans,
  (select count(*) from lineitem l where not exists (select 1 from part where p_partkey = l_partkey and p_size <= 45)) as broken""")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = orders.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("o_orderstatus") == "P").alias("entrypoints"))
    orphans = orphan_orders(spark, sf_dir).agg(F.count(F.lit(1)).alias("orphans"))
    broken = dangling_part_refs(spark, sf_dir).agg(F.count(F.lit(1)).alias("broken"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(counts).join(one(orphans), "one").join(one(broken), "one").drop("one")


@query("select distinct c_nationkey as nation from customer union select distinct s_nationkey from supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(r"""
select page_id, split_part(p, '/', 1) as package, regexp_extract(list_extract(string_split(p, '/'), -1), '^([^./]+)\.([^./]+)$', 1) as stem
from (select page_id, """ + _PATH + " as p from pages)")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("p"))
    return pages.select("page_id", package_name(F.col("p")).alias("package"), route_stem(F.element_at(F.split("p", "/", -1), -1)).alias("stem"))
