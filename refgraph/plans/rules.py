"""Queries over tables of rules: aliases, ignore lists and suppressions made from the keys of `part` and `orders`, several owners
each, against addresses of pages and lines of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.operators import rules as ops
from refgraph.plans.catalogue import query, table

#: Languages in addresses, and sites by the last part of their names.
LANGUAGES, SITES = ["en", "fr", "de", "es"], ["com", "net", "org"]


def _pick(values: list[str], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, root, request): the site, and the rest of the address."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"^[a-z]+://[^/]*\.([a-z]+)/", 1).alias("root"), F.regexp_extract(url, "^[a-z]+://[^/]*/(.*)$", 1).alias("request"))


_ADDRESSES = r"select page_id, regexp_extract(url, '^[a-z]+://[^/]*\.([a-z]+)/', 1) as root, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) as request from pages"


@query(rf"""
with aliases as (
  select p_partkey as ord, ['com', 'net', 'org'][(k % 3 + 1)::int] as root,
    case k % 5 when 0 then l || '/' || (k % 97) || '*' when 1 then l || '/*' || (k % 10) || '.html' when 2 then l || '/*/' when 3 then l || '/' || (k % 1000) else '*/' || (k % 100) || '*' end as alias,
    case k % 4 when 0 then 'p' || k when 1 then 'p' || k || '/*' when 2 then 'src/*/p' || k || '*' else 'q' || k || '/*.ts' end as target
  from (select p_partkey, p_partkey // 7 as k, ['en', 'fr', 'de', 'es'][(p_partkey % 4 + 1)::int] as l from part)),
asked as ({_ADDRESSES}),
split as (select *, contains(alias, '*') as star, split_part(alias, '*', 1) as head, substr(alias, length(split_part(alias, '*', 1)) + 2) as tail from aliases),
hits as (
  select page_id, a.root, request, ord, alias, target, star, substr(request, length(head) + 1, length(request) - length(head) - length(tail)) as capture
  from asked a join split s on a.root = s.root and case when star then starts_with(request, head) and ends_with(request, tail) and length(request) >= length(head) + length(tail) else request = alias end),
best as (select *, row_number() over (partition by page_id order by strlen(alias) desc, ord) as n from hits)
select page_id, a.root, a.request, alias,
  case when not star then target when contains(target, '*') then split_part(target, '*', 1) || capture || substr(target, length(split_part(target, '*', 1)) + 2)
    when capture = '' then target else target || '/' || capture end as alias_target
from asked a left join (select page_id, alias, target, star, capture from best where n = 1) using (page_id)""")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses through the aliases of their site, thousands a site."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 7).alias("k"), _pick(LANGUAGES, F.col("p_partkey") % 4).alias("l"))
    k, text = F.col("k"), lambda c: c.cast("string")
    alias = (
        F.when(k % 5 == 0, F.concat("l", F.lit("/"), text(k % 97), F.lit("*"))).when(k % 5 == 1, F.concat("l", F.lit("/*"), text(k % 10), F.lit(".html"))).when(k % 5 == 2, F.concat("l", F.lit("/*/")))
        .when(k % 5 == 3, F.concat("l", F.lit("/"), text(k % 1000))).otherwise(F.concat(F.lit("*/"), text(k % 100), F.lit("*")))
    )
    target = F.when(k % 4 == 0, F.concat(F.lit("p"), text(k))).when(k % 4 == 1, F.concat(F.lit("p"), text(k), F.lit("/*"))).when(k % 4 == 2, F.concat(F.lit("src/*/p"), text(k), F.lit("*"))).otherwise(F.concat(F.lit("q"), text(k), F.lit("/*.ts")))
    aliases = part.select(_pick(SITES, k % 3).alias("root"), F.col("p_partkey").alias("ord"), alias.alias("alias"), target.alias("target"))
    return ops.alias_lookup(_addresses(spark, sf_dir), aliases)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, list, path): an address as a path, site first; five ignore lists share the pages."""
    host, rest = F.regexp_extract("url", "^[a-z]+://([^/]*)/", 1), F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    path = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"), F.rtrim(rest, F.lit("/")))
    return table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("list"), path.alias("path"))


_PATHS = r"""select page_id, page_id % 5 as list, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]*)/', 1), '.')), '/') || '/' || rtrim(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/') as path from pages"""

#: Lines of ignore lists, by a number, of which N, L and S in a line become a part's number, its language and its site.
LINES = ["/S/example/**/L/N*", "L/", "!**/N?", "*.html", "!S/example/*/L/N*", "**/N?5*", "!*.html", "/S/**/blog/", "N", "!N", "?N*", "!/S/example/m/**"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = _pick(LINES, k % len(LINES))
    for letter, value in (("N", (k % 89).cast("string")), ("L", _pick(LANGUAGES, F.floor(k / 5) % 4)), ("S", _pick(SITES, F.floor(k / 3) % 3))):
        line = F.replace(line, F.lit(letter), value)
    return table(spark, sf_dir, "part").where("p_size % 10 = 3").select((k % 5).alias("list"), k.alias("ord"), line.alias("line"))


_LINES = f"""select p_partkey % 5 as list, p_partkey as ord, replace(replace(replace([{", ".join(f"'{x}'" for x in LINES)}][(p_partkey % {len(LINES)} + 1)::int],
  'N', (p_partkey % 89)::varchar), 'L', ['en', 'fr', 'de', 'es'][(p_partkey // 5 % 4 + 1)::int]), 'S', ['com', 'net', 'org'][(p_partkey // 3 % 3 + 1)::int]) as line from part where p_size % 10 = 3"""

#: A glob as a regular expression; {} stands for a column.
_GLOB = r"""replace(replace(replace(replace(replace(regexp_replace({}, '([.\\+^$|(){{}}\[\]])', '\\\1', 'g'), '?', '[^/]'), '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), chr(1), '(?:.*/)?')"""
_RULES = rf"""
parsed as (select list, ord, starts_with(line, '!') as negated, ltrim(line, '!') as body from ({_LINES})),
shaped as (select *, rtrim(ltrim(body, '/'), '/') as pattern, ends_with(body, '/') as folder_only, contains(rtrim(body, '/'), '/') as deep from parsed),
rules as (
  select *, '^' || case when deep then '' else '(?:.*/)?' end || '(?:' || replace({_GLOB.format("pattern")}, chr(2), '.*') || ')'
    || case when folder_only then case when negated then null else '/.*$' end when deep and negated then '$' else '(?:/.*)?$' end as file_regex,
    '^' || case when deep then '' else '(?:.*/)?' end || '(?:' || replace({_GLOB.format("pattern")}, chr(2), '.*') || ')' || case when deep then '$' else '(?:/.*)?$' end as dir_regex
  from shaped),
files as ({_PATHS})"""


@query(rf"""
with {_RULES}
select page_id, f.list, path, coalesce(arg_max(not negated, ord), false) as ignored
from files f left join rules r on f.list = r.list and regexp_matches(path, file_regex) group by page_id, f.list, path""")
def ignore_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under the ignore list of their owner: the last line that matches decides."""
    return ops.ignored_paths(_paths(spark, sf_dir), ops.compiled_rules(_lines(spark, sf_dir), "list"), "list")


@query("""
with named as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipmode from (select *, ['air', 'sea', 'rail'][(l_suppkey % 3 + 1)::int] as l_shipmode from lineitem)),
rules as (
  select o_orderkey as l_orderkey, case when o_custkey % 2 = 0 then ['A', 'N', 'R'][(o_custkey % 3 + 1)::int] end as flag, case when o_custkey % 3 = 0 then ['O', 'F'][(o_custkey // 6 % 2 + 1)::int] end as status,
    case when o_custkey % 5 = 0 then ['air', 'sea', 'rail'][(o_custkey // 4 % 3 + 1)::int] end as mode from orders where o_orderkey % 3 <> 0)
select * from named l where not exists (
  select 1 from rules r where r.l_orderkey = l.l_orderkey and (flag is null or flag = l_returnflag) and (status is null or status = l_linestatus) and (mode is null or mode = l_shipmode))""")
def suppression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no rule of their order covers; rules name any of three more fields, or none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", _pick(["air", "sea", "rail"], F.col("l_suppkey") % 3).alias("l_shipmode"))
    k = F.col("o_custkey")
    rules = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("l_orderkey"), F.when(k % 2 == 0, _pick(["A", "N", "R"], k % 3)).alias("l_returnflag"), F.when(k % 3 == 0, _pick(["O", "F"], F.floor(k / 6) % 2)).alias("l_linestatus"),
        F.when(k % 5 == 0, _pick(["air", "sea", "rail"], F.floor(k / 4) % 3)).alias("l_shipmode"),
    )
    return ops.suppressed_by_table(lines, rules, ["l_orderkey"], ["l_returnflag", "l_linestatus", "l_shipmode"])


#: Names of folders that are ignored unless a line opens them by a literal path.
NAMES = ["blog", "fr", "m"]


@query(rf"""
with {_RULES.replace("parsed as (select list, ord,", "parsed as (select list, ord, false as by_name,").replace(f"from ({_LINES})),", f"from ({_LINES}) union all select l, k - 10, true, false, n || '/' from (values {', '.join(f"({k}, '{n}')" for k, n in enumerate(NAMES))}) v(k, n), range(5) r(l)),")},
folders as (select distinct list, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') as folder from files, range(1, 9) r(k) where k < len(string_split(path, '/'))),
asked as (select list, folder as p, true as dir from folders union select list, folder || '/__probe__', false from folders),
state as (
  select a.list, p, dir, arg_max(not negated, ord) as ignored, bool_or(by_name) as named from asked a join rules r on a.list = r.list and regexp_matches(p, case when dir then dir_regex else file_regex end) group by all),
shut as (
  select f.list, folder, coalesce(d.named, false) as named from folders f left join state d on d.list = f.list and d.p = folder and d.dir left join state b on b.list = f.list and b.p = folder || '/__probe__'
  where coalesce(d.ignored, false) or coalesce(b.ignored, false)),
negated as (select *, trim(regexp_extract(pattern, '^([^*?]*)', 1), '/') as prefix, string_split(pattern, '/') as parts from rules where negated),
pairs as (
  select s.list, folder, n.ord, n.pattern, n.parts, n.folder_only, n.deep, n.file_regex, n.dir_regex, folder_only and regexp_matches(folder, dir_regex) as here from shut s join negated n on n.list = s.list
  where (not named or (contains(pattern, '/') and prefix <> ''))
    and (not contains(pattern, '/') or prefix = '' or prefix = folder or starts_with(prefix, folder || '/') or starts_with(folder, prefix || '/') or regexp_matches(folder, dir_regex))),
ends as (select *, unnest(range(0, len(parts) + 1)) as p from pairs where deep and not here),
fits as (
  select *, list_filter(list_slice(parts, p + 1, len(parts)), lambda x: x <> '**') as names from (
    select *, array_to_string(list_slice(parts, 1, p), '/') as head from ends where p = 0 or parts[p] <> '**')
  where regexp_matches(folder, '^' || replace({_GLOB.format("head")}, chr(2), '.*') || case when coalesce(parts[p + 1], '') = '**' then case when p = 0 then '.*' else '(?:/.*)?' end else '' end || '$')),
samples as (
  select list, folder, ord, folder_only as dir, file_regex, dir_regex, folder as sample from pairs where here
  union all select list, folder, ord, folder_only, file_regex, dir_regex, folder || '/' || replace(replace(pattern, '*', 'sample'), '?', 'x') from pairs where not deep and not here
  union all select list, folder, ord, folder_only, file_regex, dir_regex, arg_max(folder || case when len(names) > 0 then '/' || replace(replace(array_to_string(names, '/'), '*', 'sample'), '?', 'x') when folder_only then '' else '/sample' end, p)
    from fits where len(names) > 0 or folder_only or p < len(parts) group by all),
opened as (
  select s.list, folder, s.ord from samples s left join rules r on r.list = s.list and regexp_matches(sample, case when dir then r.dir_regex else r.file_regex end)
  where regexp_matches(sample, case when dir then s.dir_regex else s.file_regex end) group by s.list, folder, s.ord having not coalesce(arg_max(not r.negated, r.ord), false)),
pruned as (select list, folder from shut except select list, folder from opened),
ignored as (select page_id from files f join rules r on r.list = f.list and regexp_matches(path, file_regex) group by page_id having arg_max(not negated, ord))
select page_id, list, path from files f
where page_id not in (select page_id from ignored) and not exists (select 1 from pruned p where p.list = f.list and starts_with(path, folder || '/'))""")
def walked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that a walk finds, whose folders are pruned by each owner's list and by names that all ignore."""
    lines = _lines(spark, sf_dir).withColumn("name", F.lit(False))
    names = spark.range(5).select(F.col("id").alias("list"), F.posexplode(F.array(*(F.lit(f"{n}/") for n in NAMES))).alias("at", "line")).select("list", (F.col("at") - 10).cast("long").alias("ord"), "line", F.lit(True).alias("name"))
    return ops.walked_files(_paths(spark, sf_dir), ops.compiled_rules(lines.unionByName(names), "list", by_name="name"), "list")
