"""Rules as tables: path aliases, ignore lists and suppressions of many owners at once, with any number of rows.

Nothing here is built per rule: rules are compiled by native columns, found by equi-joins on what they have in common with the
strings that they can match, and only then tested. A rule without such a literal part is met by every string of its owner, in
SALTS parts, so no owner's strings have to meet in a task. Strings are looked up once each.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Parts of what all strings of an owner, or all findings of a hot key, would otherwise meet in.
SALTS = 16
#: A key is hot with more than one in so many of all rows, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Rules of a key that a finding looks through.
MANY = 1000


# Aliases


def alias_lookup(requests: DataFrame, aliases: DataFrame, owner: str = "root", request: str = "request") -> DataFrame:
    """requests with alias and alias_target: the longest alias of its owner that fits a request, of equals the one with the smallest
    ord; nulls where none does.

    aliases: (owner, ord, alias, target). One `*` of an alias stands for what is between its ends, which takes the place of the
    target's first `*`; a target without one is a folder. Of equal aliases of an owner only the one with the smallest ord is looked at. A request is cut at each length that a head of its owner's aliases has, and
    the heads are joined by equality. Null requests, owners and aliases fit nothing; repeated requests stay repeated."""
    head, star = F.substring_index("alias", "*", 1), F.contains(F.col("alias"), F.lit("*"))
    known = first_aliases(aliases, owner).select(F.col(owner).alias("__o"), "ord", "alias", "target", head.alias("__head"), star.alias("__star"))
    known = known.withColumn("__tail", F.when(F.col("__star"), F.substring("alias", F.char_length("__head") + 2, F.char_length("alias"))))
    asked = requests.select(F.col(owner).alias("__o"), F.col(request).alias("__r")).where("__r is not null").distinct()

    lengths = known.where("__star").groupBy("__o").agg(F.collect_set(F.char_length("__head")).alias("__lengths"))
    cut = asked.join(lengths, "__o").withColumn("__n", F.explode(F.filter("__lengths", lambda n: n <= F.char_length("__r"))))
    cut = cut.select("__o", "__r", F.expr("left(__r, __n)").alias("__head"), "__n")
    fits = F.endswith(F.col("__r"), F.col("__tail")) & (F.char_length("__r") >= F.col("__n") + F.char_length("__tail"))
    starred = cut.join(known.where("__star").drop("__star"), ["__o", "__head"]).where(fits)
    capture = F.substring("__r", F.col("__n") + 1, F.char_length("__r") - F.col("__n") - F.char_length("__tail"))
    before = F.substring_index("target", "*", 1)
    filled = F.concat(before, capture, F.substring("target", F.char_length(before) + 2, F.char_length("target")))
    target = F.when(F.contains(F.col("target"), F.lit("*")), filled).when(capture == "", F.col("target")).otherwise(F.concat("target", F.lit("/"), capture))
    found = starred.select("__o", "__r", "ord", "alias", target.alias("target"))
    exact = asked.join(known.where("not __star").select("__o", F.col("alias").alias("__r"), "ord", "alias", "target"), ["__o", "__r"])

    first = F.struct(F.octet_length("alias"), -F.col("ord"))
    best = found.unionByName(exact).groupBy("__o", "__r").agg(F.max_by(F.struct("alias", F.col("target").alias("alias_target")), first).alias("__best"))
    best = best.select(F.col("__o").alias(owner), F.col("__r").alias(request), "__best.*")
    return requests.join(best, [owner, request], "left")


def first_aliases(aliases: DataFrame, owner: str = "root") -> DataFrame:
    """(owner, alias, ord, target): of equal aliases of an owner the one with the smallest ord, which hides the others."""
    first = F.max_by(F.struct("ord", "target"), F.struct(-F.col("ord"))).alias("__first")
    return aliases.where("alias is not null").groupBy(owner, "alias").agg(first).select(owner, "alias", "__first.ord", "__first.target")


# Ignore lists


def _regex(pattern: Column, crossing: bool) -> Column:
    """A glob as a regular expression without anchors, as functions.globs.glob_regex makes it of a string."""
    out = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    out = F.replace(out, F.lit("?"), F.lit("[^/]"))
    out = F.regexp_replace(out, r"(?<!\*)\*\*/", "\x01")
    out = F.replace(out, F.lit("**"), F.lit("\x02"))
    out = F.replace(out, F.lit("*"), F.lit("[^/]*"))
    wide, inner = (".*", "(?:.*/)?") if crossing else ("[^/]*", "(?:[^/]*/)?")
    return F.replace(F.replace(out, F.lit("\x01"), F.lit(inner)), F.lit("\x02"), F.lit(wide))


def compiled_rules(lines: DataFrame, owner: str = "root", order: str = "ord", line: str = "line", by_name: str | None = None) -> DataFrame:
    """One row per rule: (owner, ord, pattern, negated, folder_only, deep, by_name, prefix, file_regex, dir_regex, kind, key).

    Blank lines are no rules. file_regex and dir_regex say what the rule matches as a file and as a folder; kind and key are the
    literal part by which it is found: `path`, a leading path; `name`, a whole segment; `ext`, a segment's last extension; `any`,
    nothing. prefix is the pattern up to its first wildcard. by_name: a boolean column of lines, true for names of folders that a tool
    ignores by itself. Of equal lines of an owner only the last is a rule: it matches what the others do and decides after them."""
    text = F.trim(F.col(line))
    negated = F.startswith(text, F.lit("!"))
    body = F.replace(F.trim(F.when(negated, F.substring(text, 2, 1 << 30)).otherwise(text)), F.lit("\\"), F.lit("/"))
    named = F.coalesce(F.col(by_name), F.lit(False)) if by_name else F.lit(False)
    rows = lines.select(F.col(owner).alias("owner"), F.col(order).alias("ord"), negated.alias("negated"), body.alias("__body"), named.alias("by_name"))
    rows = rows.groupBy("owner", "negated", "__body", "by_name").agg(F.max("ord").alias("ord"))
    rows = rows.withColumns({"folder_only": F.endswith("__body", F.lit("/")) | F.col("by_name"), "anchored": F.col("__body").rlike(r"^(?:/|\./)")})
    rows = rows.withColumn("pattern", F.regexp_replace(F.regexp_replace("__body", r"^(?:\./|/+(?:\./)?)", ""), "^/+|/+$", "")).where("pattern <> ''")
    rows = rows.withColumn("deep", F.col("anchored") | F.contains("pattern", F.lit("/")))

    g = F.when(F.col("deep"), _regex(F.col("pattern"), True)).otherwise(_regex(F.col("pattern"), False))
    start = F.when(F.col("deep"), "^").otherwise("^(?:.*/)?")
    below = F.when(F.col("folder_only"), F.when(~F.col("negated"), "/.*$")).when(F.col("deep") & F.col("negated"), "$").otherwise("(?:/.*)?$")
    of_dir = F.when(F.col("deep"), "$").otherwise("(?:/.*)?$")
    whole = lambda end: F.concat(F.lit("(?s)"), start, F.lit("(?:"), g, F.lit(")"), end)

    wild = F.col("pattern").rlike("[*?]")
    leading = F.when(wild, F.rtrim(F.regexp_extract("pattern", "^((?:[^/*?]+/)*)", 1), F.lit("/"))).otherwise(F.col("pattern"))
    kind = F.when(F.col("deep"), F.when(leading != "", "path").otherwise("any")).when(~wild, "name").when(F.col("pattern").rlike(r"^\*\.[^.*?]+$"), "ext").otherwise("any")
    key = F.when(kind == "path", leading).when(kind == "name", F.col("pattern")).when(kind == "ext", F.substring("pattern", 3, 1 << 30)).otherwise("")
    prefix = F.when(F.col("deep"), F.trim(F.regexp_extract("pattern", "^([^*?]*)", 1), F.lit("/"))).otherwise("")
    return rows.select("owner", "ord", "pattern", "negated", "folder_only", "deep", "by_name", prefix.alias("prefix"), whole(below).alias("file_regex"), whole(of_dir).alias("dir_regex"), kind.alias("kind"), key.alias("key"))


def _ancestors(path: Column, itself: bool) -> Column:
    """The folders above a path, from the top; and the path."""
    n = F.size(F.split(path, "/", -1)) - (0 if itself else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("substring_index", path, F.lit("/"), k))).otherwise(F.array().cast("array<string>"))


def _salted(rules: DataFrame) -> DataFrame:
    """Rules of kind any once for each part of the strings that they meet."""
    parts = F.when(F.col("kind") == "any", F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: k.cast("string"))).otherwise(F.array("key"))
    return rules.withColumn("key", F.explode(parts))


def _salt(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("string")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in as many parts as shuffles have, by a hash of keys. Few bytes cost much time here, as each string meets many rules, so
    the parts are not put together by their bytes; the hash keeps Spark from taking a shuffle by the keys themselves for this one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def matches(paths: DataFrame, rules: DataFrame, regex: str = "file_regex") -> DataFrame:
    """(owner, path, ord, negated, by_name): every rule of rules that matches a path of its owner, from paths (owner, path)."""
    segments = F.split("path", "/", -1)
    one = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    ext = F.transform(F.filter(segments, lambda s: F.contains(s, F.lit("."))), lambda s: F.substring_index(s, ".", -1))
    keys = F.concat(F.transform(_ancestors(F.col("path"), True), one("path")), F.transform(segments, one("name")), F.transform(ext, one("ext")), F.array(F.struct(F.lit("any").alias("kind"), _salt(F.col("path")).alias("key"))))
    asked = _spread(paths, "owner", "path").select("owner", "path", F.explode(F.array_distinct(keys)).alias("k")).select("owner", "path", "k.kind", "k.key")
    tested = _salted(rules.where(F.col(regex).isNotNull())).select("owner", "kind", "key", "ord", "negated", "by_name", F.col(regex).alias("regex"))
    return asked.join(tested, ["owner", "kind", "key"]).where(F.regexp_like("path", F.col("regex"))).select("owner", "path", "ord", "negated", "by_name")


def last_match(paths: DataFrame, rules: DataFrame, regex: str = "file_regex") -> DataFrame:
    """(owner, path, ignored, named) of the paths that a rule matches: whether the last rule is not negated, and whether a rule by
    name is among them."""
    found = matches(paths, rules, regex).groupBy("owner", "path")
    return found.agg(F.max_by(~F.col("negated"), "ord").alias("ignored"), F.bool_or(F.col("by_name") & ~F.col("negated")).alias("named"))


def ignored_paths(paths: DataFrame, rules: DataFrame, owner: str = "root", path: str = "path") -> DataFrame:
    """paths with `ignored`, false where no rule matches. rules: of compiled_rules. A null path is not ignored."""
    asked = paths.select(F.col(owner).alias("owner"), F.col(path).alias("path")).where("path is not null").distinct()
    found = last_match(asked, rules).select(F.col("owner").alias(owner), F.col("path").alias(path), F.col("ignored").alias("__ignored"))
    return paths.join(found, [owner, path], "left").withColumn("ignored", F.coalesce("__ignored", F.lit(False))).drop("__ignored")


# Pruned folders


def _sample_name(pattern: Column) -> Column:
    return F.replace(F.replace(pattern, F.lit("*"), F.lit("sample")), F.lit("?"), F.lit("x"))


def _samples(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """(owner, folder, named, sample, is_dir): for folders (owner, folder, named) and negated rules that may match in them, a path at
    or below the folder that the rule matches."""
    cols = ["pattern", "folder_only", "deep", "prefix", "file_regex", "dir_regex", "ord"]
    folders, rules = _spread(folders, "owner", "folder"), rules.where("negated")
    literal = rules.where("prefix <> '' and contains(pattern, '/')").select("owner", *cols)
    up = folders.withColumn("prefix", F.explode(_ancestors(F.col("folder"), True)))
    below = up.join(literal, ["owner", "prefix"]).select("owner", "folder", "named", *cols)
    above = literal.withColumn("folder", F.explode(_ancestors(F.col("prefix"), False))).join(folders, ["owner", "folder"]).select("owner", "folder", "named", *cols)
    itself = matches(folders.select("owner", F.col("folder").alias("path")), rules.where("prefix <> '' and contains(pattern, '/')"), "dir_regex")
    itself = itself.select("owner", F.col("path").alias("folder"), "ord").join(literal, ["owner", "ord"]).join(folders, ["owner", "folder"]).select("owner", "folder", "named", *cols)
    loose = rules.where("prefix = '' or not contains(pattern, '/')").withColumn("salt", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: k.cast("string"))))
    every = folders.withColumn("salt", _salt(F.col("folder"))).join(loose, ["owner", "salt"]).where("not named").select("owner", "folder", "named", *cols)
    pairs = below.unionByName(above).unionByName(itself).unionByName(every).distinct()

    parts = F.split("pattern", "/", -1)
    here = F.col("folder_only") & F.regexp_like("folder", F.col("dir_regex"))
    ends = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda p: (p == 0) | (F.get(parts, p - 1) != "**"))
    placed = pairs.withColumn("__p", F.explode(F.when(here | ~F.col("deep"), F.array(F.lit(-1))).otherwise(ends)))
    head, rest = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("__p"), F.lit(0))), "/"), F.slice(parts, F.greatest(F.col("__p"), F.lit(0)) + 1, F.size(parts) + 1)
    wide = F.get(parts, F.col("__p")) == "**"
    prefix = F.concat(F.lit("(?s)^"), _regex(head, True), F.when(F.coalesce(wide, F.lit(False)), F.when(F.col("__p") == 0, ".*$").otherwise("(?:/.*)?$")).otherwise("$"))
    names = F.transform(F.filter(rest, lambda s: s != "**"), _sample_name)
    suffix = F.when(F.size(names) > 0, F.array_join(names, "/")).when(F.col("folder_only"), "").when(F.size(rest) > 0, "sample")
    sample = F.when(here, F.col("folder")).when(~F.col("deep"), F.concat("folder", F.lit("/"), _sample_name(F.col("pattern")))).when(F.regexp_like("folder", prefix), F.rtrim(F.concat("folder", F.lit("/"), suffix), F.lit("/")))
    made = placed.withColumn("sample", sample).where("sample is not null").groupBy("owner", "folder", "named", "ord").agg(F.max_by(F.struct("sample", F.col("folder_only").alias("is_dir"), F.when(F.col("folder_only"), F.col("dir_regex")).otherwise(F.col("file_regex")).alias("regex")), "__p").alias("s"))
    return made.where(F.regexp_like("s.sample", F.col("s.regex"))).select("owner", "folder", "named", "s.sample", "s.is_dir")


#: A name that no rule is written for: what happens to it happens to everything else below a folder.
PROBE = "__probe__"


def pruned_folders(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(owner, folder) of the folders above files (owner, path) that a walk does not enter: ignored ones, or such that ignore what
    is below them, unless a negated rule has a path there that is not ignored. Folders ignored by name are opened only by rules that
    begin with a literal path."""
    folders = written(files.select("owner", F.explode(F.array_distinct(_ancestors(F.col("path"), False))).alias("folder")).distinct(), "walk-folders")
    as_dir = last_match(folders.withColumnRenamed("folder", "path"), rules, "dir_regex").withColumnsRenamed({"path": "folder", "ignored": "as_dir"})
    probes = last_match(folders.select("owner", F.concat("folder", F.lit(f"/{PROBE}")).alias("path")), rules)
    probes = probes.select("owner", F.expr(f"left(path, char_length(path) - {len(PROBE) + 1})").alias("folder"), F.col("ignored").alias("below"))
    state = folders.join(as_dir, ["owner", "folder"], "left").join(probes, ["owner", "folder"], "left")
    shut = state.where("coalesce(as_dir, false) or coalesce(below, false)").select("owner", "folder", F.coalesce("named", F.lit(False)).alias("named"))
    shut = written(shut, "walk-shut")

    samples = written(_samples(shut, rules), "walk-samples")
    asked = samples.select("owner", F.col("sample").alias("path"), "is_dir").distinct()
    hit = last_match(asked.where("is_dir").drop("is_dir"), rules, "dir_regex").withColumn("is_dir", F.lit(True)).unionByName(last_match(asked.where("not is_dir").drop("is_dir"), rules).withColumn("is_dir", F.lit(False)))
    hit = hit.where("ignored").select("owner", F.col("path").alias("sample"), "is_dir")
    opened = samples.join(hit, ["owner", "sample", "is_dir"], "left_anti").select("owner", "folder").distinct()
    return shut.select("owner", "folder").join(opened, ["owner", "folder"], "left_anti")


def walked_files(files: DataFrame, rules: DataFrame, owner: str = "root", path: str = "path") -> DataFrame:
    """The files that a walk finds: not ignored, and below no pruned folder. Null paths are left out. What several joins read (rules,
    folders, those shut, samples) is written once."""
    rules = written(rules, "walk-rules")
    asked = files.select(F.col(owner).alias("owner"), F.col(path).alias("path")).where("path is not null").distinct()
    above = asked.select("owner", "path", F.explode(_ancestors(F.col("path"), False)).alias("folder"))
    lost = above.join(pruned_folders(asked, rules), ["owner", "folder"], "left_semi").select("owner", "path")
    lost = lost.union(last_match(asked, rules).where("ignored").select("owner", "path")).distinct()
    return files.where(F.col(path).isNotNull()).join(lost.select(F.col("owner").alias(owner), F.col("path").alias(path)), [owner, path], "left_anti")


# Suppressions


def hot_keys(findings: DataFrame, exact: list[str]) -> DataFrame:
    """(exact, __hot): keys with more than one in HOT_SHARE of all findings. Counted by a hash first, so only few keys are dealt out."""
    share = findings.agg(F.greatest(F.count(F.lit(1)) / HOT_SHARE, F.lit(HOT_SHARE)).alias("__share")).scalar()
    hashed = findings.select(*exact, F.pmod(F.xxhash64(*exact), F.lit(4 * HOT_SHARE)).alias("__part"))
    full = hashed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share).select("__part")
    every = hashed.join(F.broadcast(full), "__part", "left_semi").groupBy(*exact).agg(F.count(F.lit(1)).alias("__n"))
    return every.where(F.col("__n") > share).select(*exact, F.lit(True).alias("__hot"))


def suppressed_by_table(findings: DataFrame, rules: DataFrame, exact: list[str], optional: list[str]) -> DataFrame:
    """The findings that no rule covers. A rule covers equal exact fields, and equal optional fields where it names them (not null).

    One join for each set of optional fields that a rule may name. Keys with at most MANY rules are joined by their exact fields, so
    findings are shuffled once for all sets, and a finding looks through the rules of its key; keys with more are joined by the named
    fields too. Neither side has to fit into a task or a broadcast. Exact keys with more than one in HOT_SHARE of all findings, which
    are fewer than that, are dealt out in SALTS parts. Null exact fields are covered by nothing, repeated findings are kept or covered
    together. Hot keys and those with many rules are written."""
    hot = F.broadcast(written(hot_keys(findings, exact), "hot-keys"))
    many = written(rules.groupBy(*exact).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MANY).select(*exact, F.lit(True).alias("__many")), "many-rules")
    alike = all(findings.schema[c].dataType == rules.schema[c].dataType for c in optional)
    if many.isEmpty():
        return _uncovered(findings, rules, exact, optional, hot, alike)
    split = lambda df, which: df.join(many, exact, "left").where(F.coalesce("__many", F.lit(False)) == which).drop("__many").select(*df.columns)
    few, more = (_uncovered(split(findings, which), split(rules, which), exact, optional, hot, alike and not which) for which in (False, True))
    return few.unionByName(more)


def _uncovered(findings: DataFrame, rules: DataFrame, exact: list[str], optional: list[str], hot: DataFrame, gathered: bool) -> DataFrame:
    """gathered: the rules of a key that name the same fields come as one row."""
    part = F.pmod(F.xxhash64(*findings.columns) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    left = findings.join(hot, exact, "left").withColumn("__salt", F.when(F.col("__hot"), part).otherwise(-1)).drop("__hot")
    known = rules.select(*exact, *optional).distinct().join(hot, exact, "left")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    known = known.withColumn("__salt", F.explode(salts)).drop("__hot")
    for n in range(len(optional) + 1):
        for named in combinations(optional, n):
            here = reduce(lambda a, c: a & (F.col(c).isNotNull() if c in named else F.col(c).isNull()), optional, F.lit(True))  # noqa: B023
            keys = [*exact, "__salt"]
            if not gathered or not named:
                left = left.join(known.where(here).select(*keys, *named), [*keys, *named], "left_anti")
                continue
            lists = known.where(here).groupBy(*(F.col(c).alias(f"__of_{c}") for c in keys)).agg(F.collect_set(F.struct(*named)).alias("__rules"))
            fits = F.array_contains("__rules", F.struct(*named))
            left = left.join(lists, reduce(lambda a, c: a & (F.col(c) == F.col(f"__of_{c}")), keys, fits), "left_anti")
    return left.select(*findings.columns)
