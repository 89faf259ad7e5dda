"""Reports of many roots as tables: read from documents in bulk, compared, previewed, rendered, and written as documents.

A report is a row of `reports` (root, generatedAt, configPath, filesScanned, entrypoints, suppressedFindings); what it found is rows
of `findings` (root, section, ord, file, source, kind, local, imported, exportName, reason, confidence, safe), with nulls in fields
that its section does not have. ord sorts a section's findings and may be of any type. Roots are unique, and not null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refgraph.sources.report import COUNTS, ENUMS, LABELS, PREVIEW, SECTIONS, VERSION

from .reference import placed
from .tables import written

FIELDS = ["file", "source", "kind", "local", "imported", "exportName", "reason", "confidence", "safe"]
TYPES = dict.fromkeys(FIELDS, "string") | {"confidence": "float", "safe": "boolean"}
ITEM = f"struct<section: string, ord: int, {', '.join(f'{f}: {t}' for f, t in TYPES.items())}>"
MODULE = "struct<file: string, relativePath: string, entrypointKind: string, importedByCount: bigint, importCount: bigint, exportCount: bigint>"
#: What a field of an old document falls back to; fields without one cannot be missing.
FALLBACKS = {
    "brokenImports": {"kind": "unknown"}, "orphanFiles": {"kind": "orphan-module", "reason": "", "confidence": 0.0}, "deletionCandidates": {"reason": "", "confidence": 0.0, "safe": False},
}


# Reading


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _typed(value: Column, path: str, kind: type | str) -> Column:
    """The value at the path if it has this JSON type, else null."""
    leaf = F.schema_of_variant(_at(value, path))
    if kind in (str, bool):
        return F.when(leaf == ("STRING" if kind is str else "BOOLEAN"), _at(value, path, "string" if kind is str else "boolean"))
    if kind == "count":
        return F.when((leaf == "BIGINT") & (_at(value, path, "long") >= 0), _at(value, path, "long"))
    return F.when(leaf.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), _at(value, path, "double"))


def _optional_text_is_bad(value: Column, path: str) -> Column:
    leaf = F.schema_of_variant(_at(value, path))
    return F.coalesce(~leaf.isin("STRING", "VOID"), F.lit(False))


def _known(section: str, field: str, value: Column) -> Column:
    """Null for values that the field cannot have."""
    allowed = ENUMS.get((section, field))
    return F.when(value.isin(*sorted(allowed)), value) if allowed else value


def _items(document: Column, section: str, strict: Column) -> tuple[Column, Column]:
    """Of a section: its findings, an array of ITEM, and the number of the first that is wrong."""
    array = _at(document, f"$.findings.{section}", "array<variant>")
    spec, fallback = SECTIONS[section], FALLBACKS.get(section, {})
    read = lambda x, f: _known(section, f, _typed(x, f"$.{f}", spec[f]))
    whole = lambda x: reduce(lambda a, f: a & read(x, f).isNotNull(), spec, F.lit(True))
    usable = lambda x: reduce(lambda a, f: a & read(x, f).isNotNull(), [f for f in spec if f not in fallback], F.lit(True))

    def made(x: Column) -> Column:
        fields = [(F.coalesce(read(x, f), F.lit(fallback[f])) if f in fallback else read(x, f)).cast(TYPES[f]).alias(f) if f in spec else F.lit(None).cast(TYPES[f]).alias(f) for f in FIELDS]
        return F.struct(F.lit(section).alias("section"), F.lit(0).alias("ord"), *fields)

    found = F.transform(F.filter(F.coalesce(array, F.array().cast("array<variant>")), usable), made)
    numbered = F.transform(found, lambda x, k: x.withField("ord", k))
    first_bad = F.when(strict, F.array_position(F.transform(array, whole), F.lit(False)))
    return numbered.cast(f"array<{ITEM}>"), F.when(first_bad > 0, first_bad - 1)


def _modules(document: Column, strict: Column) -> tuple[Column, Column]:
    array = F.coalesce(_at(document, "$.graph.modules", "array<variant>"), F.when(~strict & _at(document, "$.graph.modules").isNull(), _at(document, "$.modules", "array<variant>")))
    counts = ["importedByCount", "importCount", "exportCount"]
    kind = lambda x: _known("routeEntrypoints", "kind", _typed(x, "$.entrypointKind", str))
    none = lambda x: F.coalesce(F.schema_of_variant(_at(x, "$.entrypointKind")) == "VOID", F.lit(True))
    whole = lambda x: reduce(lambda a, c: a & _typed(x, f"$.{c}", "count").isNotNull(), counts, _typed(x, "$.file", str).isNotNull() & _typed(x, "$.relativePath", str).isNotNull() & (kind(x).isNotNull() | none(x)))
    made = lambda x: F.struct(_typed(x, "$.file", str).alias("file"), F.coalesce(_typed(x, "$.relativePath", str), F.lit("")).alias("relativePath"), kind(x).alias("entrypointKind"), *(F.coalesce(_typed(x, f"$.{c}", "count"), F.lit(0)).alias(c) for c in counts))
    found = F.transform(F.filter(F.coalesce(array, F.array().cast("array<variant>")), lambda x: _typed(x, "$.file", str).isNotNull()), made)
    first_bad = F.when(strict, F.array_position(F.transform(array, whole), F.lit(False)))
    return found.cast(f"array<{MODULE}>"), F.when(first_bad > 0, first_bad - 1)


@dataclass
class Reports:
    #: (id, version, root, generatedAt, configPath, filesScanned, entrypoints, the six counts, suppressedFindings)
    reports: DataFrame
    #: (id, root, section, ord, FIELDS)
    findings: DataFrame
    #: (id, root, ord, file, relativePath, entrypointKind, importedByCount, importCount, exportCount)
    modules: DataFrame
    #: (id, problem): documents that are no reports, and why
    rejects: DataFrame


def read_reports(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> Reports:
    """Documents in bulk, each parsed once. From VERSION on every field must be there and of its type; older documents are read as
    far as they go, and become VERSION; later versions keep their number.

    A null or broken text, or one with a key twice, is no JSON. Ids are not looked at and may repeat. A document that is rejected
    gives no findings."""
    value = F.try_parse_json(F.col("__text"))
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text")).withColumn("__v", value)
    v = F.col("__v")
    rows = rows.withColumn("version", F.when(_at(v, "$.schemaVersion").isNotNull(), _typed(v, "$.schemaVersion", "count")).otherwise(_typed(v, "$.version", "count")))
    strict = F.col("version") >= VERSION
    sections = {s: _items(v, s, strict) for s in SECTIONS}
    modules, bad_module = _modules(v, strict)
    root = F.when(strict | _at(v, "$.project.root").isNotNull(), _typed(v, "$.project.root", str)).otherwise(_typed(v, "$.root", str))

    missing = lambda path, kind, what: (strict & _at(v, path, kind).isNull(), F.lit(f"{path[2:]} is missing or no {what}"))
    checks = [(v.isNull(), F.lit("no JSON")), (F.col("version").isNull(), F.lit("no version")), (_optional_text_is_bad(v, "$.generatedAt"), F.lit("generatedAt is no text"))]
    checks += [missing("$.project", "map<string,variant>", "object"), missing("$.summary", "map<string,variant>", "object"), missing("$.findings", "map<string,variant>", "object"), missing("$.graph.modules", "array<variant>", "array")]
    checks += [(root.isNull(), F.lit("no root")), (_optional_text_is_bad(v, "$.project.configPath"), F.lit("project.configPath is no text"))]
    checks += [(strict & _typed(v, f"$.summary.{c}", "count").isNull(), F.lit(f"summary.{c} is missing or no count")) for c in COUNTS]
    hidden = _at(v, "$.summary.suppressedFindings")
    checks += [(strict & hidden.isNotNull() & ~F.is_variant_null(hidden) & _typed(v, "$.summary.suppressedFindings", "count").isNull(), F.lit("summary.suppressedFindings is no count"))]
    for s, (_, bad) in sections.items():
        checks += [missing(f"$.findings.{s}", "array<variant>", "array"), (bad.isNotNull(), F.concat(F.lit(f"findings.{s}["), bad.cast("string"), F.lit("] is wrong")))]
    checks += [(bad_module.isNotNull(), F.concat(F.lit("graph.modules["), bad_module.cast("string"), F.lit("] is wrong")))]
    problem = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in checks))

    count = lambda c: F.coalesce(_typed(v, f"$.summary.{c}", "count"), F.lit(0).cast("long")).alias(c)
    parsed = rows.select(
        "id", problem.alias("problem"), F.greatest("version", F.lit(VERSION)).alias("version"), root.alias("root"), _typed(v, "$.generatedAt", str).alias("generatedAt"), _typed(v, "$.project.configPath", str).alias("configPath"),
        *map(count, [*COUNTS, "suppressedFindings"]), F.concat(*(found for found, _ in sections.values())).alias("items"), modules.alias("modules"),
    )
    parsed = written(parsed, "reports")
    good = parsed.where("problem is null")
    findings = good.select("id", "root", F.explode("items").alias("i")).select("id", "root", "i.*")
    mods = good.select("id", "root", F.posexplode("modules").alias("ord", "m")).select("id", "root", "ord", "m.*")
    return Reports(good.drop("problem", "items", "modules"), findings, mods, parsed.where("problem is not null").select("id", "problem"))


# Comparing


def relative_file(file: Column, root: Column) -> Column:
    return F.when(F.startswith(file, F.concat(root, F.lit("/"))), F.substring(file, F.char_length(root) + 2, F.char_length(file))).otherwise(file)


def finding_key(root: str = "root") -> Column:
    """What makes a finding the same in two reports: the fields of its section, the file without the root, confidence by its 32
    bits."""
    bits = F.call_function("java_method", F.lit("java.lang.Float"), F.lit("floatToIntBits"), F.col("confidence")).cast("long")
    shown = {f: F.col(f).cast("string") for f in FIELDS} | {"file": relative_file(F.col("file"), F.col(root)), "confidence": F.pmod(bits, F.lit(1 << 32)).cast("string")}
    out = F.lit(None).cast("string")
    for section, spec in SECTIONS.items():
        out = F.when(F.col("section") == section, F.concat_ws("|", *(shown[f] for f in spec))).otherwise(out)
    return out


def changes(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(by, section, key, change, occurrence, place, FIELDS): findings of two sides, by key, as bags: the n-th of a key on both sides
    persists, as after has it. place numbers a change's findings of a section by key, then occurrence; a section may be of any size."""
    keys = [*by, "section", "key"]

    def side(df: DataFrame, name: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
        return df.withColumn("key", finding_key()).withColumn("occurrence", number).select(*keys, "occurrence", F.struct(*FIELDS).alias(name))

    both = side(before, "was").join(side(after, "now"), [*keys, "occurrence"], "full")
    change = F.when(F.col("was").isNull(), "introduced").when(F.col("now").isNull(), "resolved").otherwise("persisted")
    rows = both.select(*keys, change.alias("change"), "occurrence", F.coalesce("now", "was").alias("i"))
    rows = placed(rows.select(*keys, "change", "occurrence", "i.*"), [F.col("key"), F.col("occurrence")], "place", [*by, "section", "change"])
    return rows.select(*keys, "change", "occurrence", F.col("place").cast("int").alias("place"), *FIELDS)


# Rendering


def finding_line(code: bool = False, root: str = "root") -> Column:
    """A finding as a line of text; code: of Markdown."""
    c, tick, file = F.col, F.lit("`" if code else ""), relative_file(F.col("file"), F.col(root))
    name = F.when(c("local") == c("imported"), c("local")).otherwise(F.concat("imported", F.lit(" as "), "local"))
    sure = F.concat(F.lit("confidence "), F.format_string("%.2f", F.round(c("confidence").cast("double"), 2)))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lines = {
        "brokenImports": text(file, " -> ", tick, c("source"), tick), "orphanFiles": text(file, " (", c("reason"), ")") if code else file,
        "deadExports": text(file, " -> `", c("exportName"), "`") if code else text(file, "#", c("exportName")),
        "unusedImports": text(file, " -> ", tick, name, tick, " from ", tick, c("source"), tick), "routeEntrypoints": text(file, " (", c("kind"), ")"),
        "deletionCandidates": text(file, " (", c("reason"), ", ", sure, ")") if code else text(file, " (", sure, ", ", c("reason"), ")"),
    }
    out = F.lit(None).cast("string")
    for section, line in lines.items():
        out = F.when(c("section") == section, line).otherwise(out)
    return F.concat(F.lit("- "), out)


def previews(rows: DataFrame, by: list[str], order: list[Column], line: Column, most: int = PREVIEW) -> DataFrame:
    """(by, place, line): the first lines of each group, and after them how many more there are. Rows beyond `most` of a group leave
    before the shuffle; what is counted is summed before it."""
    top = rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("place"), line.alias("line")).where(F.col("place") <= most)
    more = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return top.unionByName(more.select(*by, F.lit(most + 1).alias("place"), F.concat(F.lit("- ... "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line")))


def counted(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """reports with the number of findings of each section, by its name."""
    found = findings.groupBy("root").agg(*(F.count_if(F.col("section") == s).alias(s) for s in SECTIONS))
    return reports.join(found, "root", "left").withColumns({s: F.coalesce(s, F.lit(0).cast("long")) for s in SECTIONS})


# The texts of a report.
#: What counts as actionable, in the order of the moves it asks for.
ACTIONS = {
    "brokenImports": ("broken import", "Fix broken imports before deleting files."), "deletionCandidates": ("cleanup candidate", "Run the cleanup preview and remove unused files of high confidence."),
    "deadExports": ("dead export", "Remove dead exports or confirm that they are public API."), "unusedImports": ("unused import", "Remove unused imports."),
}


def _plural(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))


def impact() -> tuple[Column, Column]:
    """The headline of a counted report, and the move that helps most."""
    total = reduce(lambda a, s: a + F.col(s), ACTIONS, F.lit(0))
    listed = F.concat_ws(", ", *(F.when(F.col(s) > 0, _plural(F.col(s), what)) for s, (what, _) in ACTIONS.items()))
    headline = F.when(total > 0, F.concat(_plural(total, "actionable finding"), F.lit(": "), listed, F.lit("."))).otherwise(F.concat(F.lit("No actionable findings in "), _plural(F.col("filesScanned"), "scanned file"), F.lit(".")))
    move = F.coalesce(*(F.when(F.col(s) > 0, move) for s, (_, move) in ACTIONS.items()), F.lit("Keep the JSON report as a baseline for later diffs."))
    return headline, move


def _quoted(path: Column) -> Column:
    return F.when(path.rlike("^[A-Za-z0-9/._-]+$"), path).otherwise(F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def _texts(lines: DataFrame) -> DataFrame:
    """(root, text) of lines (root, block, place, line): in the order of block and place; nulls are left out."""
    return lines.groupBy("root").agg(F.expr("listagg(line, '\n') within group (order by block, place)").alias("text"))


def _stacked(rows: DataFrame, block: int, lines: list[str | Column | None]) -> DataFrame:
    """Lines that each report has once, null ones left out."""
    made = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    return rows.select("root", F.lit(block).alias("block"), F.posexplode(made).alias("place", "line")).where("line is not null")


def _counts(prefix: str) -> list[Column]:
    named = [(c, F.col(c)) for c in COUNTS] + [("suppressedFindings", F.when(F.col("suppressedFindings") > 0, F.col("suppressedFindings")))]
    return [F.concat(F.lit(f"{prefix}{LABELS[c]}: "), n.cast("string")) for c, n in named]


#: The sections of a summary, in order, and what they are called there.
SHOWN = {"brokenImports": "Broken imports", "deletionCandidates": "Top cleanup candidates"} | {s: LABELS[s] for s in ("orphanFiles", "deadExports", "unusedImports", "routeEntrypoints")}


def summary_texts(reports: DataFrame, findings: DataFrame, path: Column, title: str = "Report.", tool: str = "refgraph") -> DataFrame:
    """(root, text): each report for people, sections as previews. path: where the report is, a column of reports."""
    rows = counted(reports, findings).withColumn("__path", path)
    headline, move = impact()
    saved = _quoted(F.col("__path"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    head = _stacked(rows, 0, [
        title, "", say("Impact: ", headline), say("Best next move: ", move), "", say("Root: ", F.col("root")), *_counts(""), "", say("Saved report: ", F.col("__path")), "", "Next steps:",
        say(f"- Preview cleanup: {tool} clean ", saved), say(f"- Shareable markdown: {tool} report ", saved, " --format md"),
    ])
    block = F.lit(None).cast("int")
    titles = None
    for k, (s, label) in enumerate(SHOWN.items(), 1):
        block = F.when(F.col("section") == s, k).otherwise(block)
        own = _stacked(rows.where(F.col(s) > 0), k, ["", f"{label}:"]).withColumn("place", F.col("place") - 2)
        titles = own if titles is None else titles.unionByName(own)
    shown = previews(findings.select("*"), ["root", "section"], [F.col("ord")], finding_line()).select("root", block.alias("block"), "place", "line")
    return _texts(head.unionByName(titles).unionByName(shown))


def markdown_texts(reports: DataFrame, findings: DataFrame, path: Column, tool: str = "refgraph") -> DataFrame:
    """(root, text): each report in Markdown, with all of its findings."""
    rows = counted(reports, findings).withColumn("__path", path)
    headline, move = impact()
    saved = _quoted(F.col("__path"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    lines = _stacked(rows, 0, [
        "# Report", "", say("> ", headline), "", say("- Generated at: ", F.coalesce("generatedAt", F.lit("unknown"))), say("- Root: ", F.col("root")), say("- Report: ", F.col("__path")), "", "## Summary", "", *_counts("- "),
        "", "## Impact", "", say("- ", headline), say("- Best next move: ", move), say(f"- Preview cleanup: `{tool} clean ", saved, "`"), say(f"- Refresh markdown: `{tool} report ", saved, " --format md`"),
    ])
    block = F.lit(None).cast("int")
    for k, s in enumerate(SECTIONS, 1):
        block = F.when(F.col("section") == s, k).otherwise(block)
        lines = lines.unionByName(_stacked(rows, k, ["", f"## {LABELS[s]}", "", F.when(F.col(s) == 0, "- none")]).withColumn("place", F.col("place") - 4))
    number = F.row_number().over(Window.partitionBy("root", "section").orderBy("ord"))
    return _texts(lines.unionByName(findings.select("root", block.alias("block"), number.alias("place"), finding_line(code=True).alias("line"))))


# Writing


def _array(section: str) -> Column:
    """The findings of a section, in order, as JSON; confidence with two decimals."""
    spec = SECTIONS[section]
    shown = [(F.round(F.col(f).cast("double") * 100) / 100 if f == "confidence" else F.col(f)).alias(f) for f in spec]
    rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("ord", F.struct(*shown).alias("i")))))
    return F.to_json(F.transform(rows, lambda x: x["i"]), {"ignoreNullFields": "false"})


def documents(reports: DataFrame, findings: DataFrame, modules: DataFrame) -> DataFrame:
    """(root, report): the document of each report, as JSON. modules: (root, ord, file, relativePath, entrypointKind, the counts).

    One shuffle by root for each of the three relations. A document holds all of its root's findings, so it must be below 2 GB;
    where a root may have more, write the findings themselves, which write_findings does without gathering them."""
    found = findings.groupBy("root").agg(*(_array(s).alias(f"__{s}") for s in SECTIONS), *(F.count_if(F.col("section") == s).alias(s) for s in SECTIONS))
    fields = ["file", "relativePath", "entrypointKind", "importedByCount", "importCount", "exportCount"]
    graph = modules.groupBy("root").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("i")))), lambda x: x["i"]), {"ignoreNullFields": "false"}).alias("__modules"))
    rows = reports.join(found, "root", "left").join(graph, "root", "left").withColumns({s: F.coalesce(s, F.lit(0).cast("long")) for s in SECTIONS})
    json = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    hidden = F.col("suppressedFindings") > 0
    summary = F.when(hidden, json(*COUNTS, "suppressedFindings")).otherwise(json(*COUNTS))
    none = lambda c: F.coalesce(c, F.lit("[]"))
    sections = F.concat_ws(",", *(F.concat(F.lit(f'"{s}":'), none(f"__{s}")) for s in SECTIONS))
    head = json(F.lit(VERSION).alias("schemaVersion"), "generatedAt", F.struct("root", "configPath").alias("project"))
    whole = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"summary":'), summary, F.lit(',"findings":{'), sections, F.lit('},"graph":{"modules":'), none("__modules"), F.lit("}}"))
    return rows.select("root", whole.alias("report"))


def write_documents(made: DataFrame, path: str, by: Column | None = None) -> None:
    """Documents as lines of JSON files, in folders `part=...` of by (of 256 hashes of the root by default)."""
    part = F.pmod(F.xxhash64("root"), F.lit(256)) if by is None else by
    made.select(F.col("report").alias("value"), part.alias("part")).write.partitionBy("part").text(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as lines of JSON files, in a folder for each section, where they are."""
    findings.write.partitionBy("section").json(path)
