"""Scanning a source tree: a fixed plan of relations from files to findings.

The driver reads the configuration and lists the tree; executors parse files (one Python pass, the only one); everything
after it is joins and aggregates over the parsed relation, which is written once because six findings read it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refgraph.functions.globs import ignored, rules
from refgraph.functions.paths import normalize_path, package_name
from refgraph.operators import classify
from refgraph.operators import reference as ops
from refgraph.operators.rules import SALTS, hot_keys
from refgraph.operators.tables import written
from refgraph.sources import jsparse, jstokens, listing
from refgraph.sources.config import DEPENDENCIES, EXTENSIONS, ProjectConfig, load_config, read_jsonc
from refgraph.sources.jsonc import field
from refgraph.sources.jsparse import parse_module

for module in (jsparse, jstokens):  # executors get the parser as it is, so the package needn't be installed there
    cloudpickle.register_pickle_by_value(module)

SPECIFIERS = "array<struct<kind:string,imported:string,local:string>>"
PARSED = (
    f"file string, imports array<struct<source:string,kind:string,specifiers:{SPECIFIERS}>>, exports array<struct<name:string,kind:string>>, "
    "unused array<struct<source:string,local:string,imported:string>>, barrel boolean"
)
# Modules that the runtime brings along.
BUILTINS = [
    "_http_agent", "_http_client", "_http_common", "_http_incoming", "_http_outgoing", "_http_server", "_stream_duplex", "_stream_passthrough", "_stream_readable", "_stream_transform",
    "_stream_wrap", "_stream_writable", "_tls_common", "_tls_wrap", "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring",
    "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
]
FINDINGS = ["brokenImports", "orphanFiles", "deadExports", "unusedImports", "routeEntrypoints", "deletionCandidates"]


class Written(Mapping):
    """Relations by name, each written when it is first asked for."""

    def __init__(self, plans: dict[str, DataFrame], prefix: str):
        self.plans, self.prefix, self.done = plans, prefix, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.done:
            self.done[name] = written(self.plans[name], f"{self.prefix}-{name}")
        return self.done[name]

    def __iter__(self):
        return iter(self.plans)

    def __len__(self) -> int:
        return len(self.plans)


@dataclass
class Scan:
    """The relations of one scan. findings: by the names in FINDINGS, after suppressions; before: without these."""

    config: ProjectConfig
    modules: DataFrame
    edges: DataFrame
    findings: Mapping[str, DataFrame]
    before: dict[str, DataFrame]
    counts: DataFrame

    @cached_property
    def summary(self) -> DataFrame:
        """One row: files, entries, findings of each kind, and how many a suppression hides."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1))
        out, dropped = self.counts.withColumn("one", F.lit(1)), F.lit(0).cast("long")
        for name in FINDINGS:
            out = out.join(count(self.findings[name], name), "one")
        for name, df in self.before.items():
            out = out.join(count(df, f"all_{name}"), "one")
            dropped = dropped + F.col(f"all_{name}") - F.col(name)
        return out.withColumn("suppressedFindings", dropped).select("filesScanned", "entrypoints", *FINDINGS, "suppressedFindings")

    def register(self, prefix: str = "refgraph_") -> None:
        """Temporary views of all relations, for SQL."""
        for name, df in {"modules": self.modules, "edges": self.edges, "summary": self.summary, **self.findings}.items():
            df.createOrReplaceTempView(prefix + name)


def parse_sources(sources: DataFrame) -> DataFrame:
    """sources: (file, content). One row per file; files that cannot be parsed have empty arrays."""

    def parse(batches):
        for batch in batches:
            found = [parse_module(f, c) for f, c in zip(batch["file"], batch["content"], strict=True)]
            yield pd.DataFrame({"file": batch["file"], **{k: [r[k] for r in found] for k in ("imports", "exports", "unused", "barrel")}})

    return sources.select("file", "content").mapInPandas(parse, PARSED)


def _bare(base: Column) -> Column:
    """Whether the name has no extension."""
    return ~classify.file_name(base).rlike(r"[^/]\.[^/]*$")


def tried_paths(base: Column, dotted: bool = False) -> Column:
    """The files that a path without `.` and `..` can mean, in order: itself, with an extension if it has none, an index below it.
    dotted: what follows a dot is no extension, so one is tried there too."""
    bare = F.lit(True) if dotted else _bare(base)
    none = F.array().cast("array<string>")
    tried = F.concat(F.array(base), F.when(bare, F.array(*(F.concat(base, F.lit(f".{e}")) for e in EXTENSIONS))).otherwise(none), F.array(*(F.concat(base, F.lit(f"/index.{e}")) for e in EXTENSIONS)))
    return F.when(base.isNull(), none).otherwise(tried)


def found_paths(rows: DataFrame, base: str, disk: DataFrame, path: str, out: str, dotted: bool = False) -> DataFrame:
    """Adds out: the first of tried_paths(base) that is a path of disk, else null.

    Lists of paths are not compared: each file offers itself to the bases that can mean it, of which there are three at most, with
    its place in their order, so a request and an offer are one short row each. They are merged: the optimizer can take a disk whose
    paths are made from a small table for small, and broadcast it. Hot bases, of which there are fewer than HOT_SHARE, are dealt out
    in SALTS parts, and so are null ones."""
    suffixes = ["", *(f".{e}" for e in EXTENSIONS), *(f"/index.{e}" for e in EXTENSIONS)]
    file = F.col("__file")
    ext = F.substring_index(file, ".", -1)
    stem = F.when(F.endswith(file, F.concat(F.lit("."), ext)), F.left(file, F.char_length(file) - F.char_length(ext) - 1))
    at = F.array_position(F.array(*map(F.lit, EXTENSIONS)), ext).cast("int")  # from 1; 0: none of them
    bare = F.lit(True) if dotted else _bare(stem)
    offer = lambda to, place, holds: F.when(holds, F.struct(to.alias("base"), place.alias("place")))
    offers = F.array(
        offer(file, F.lit(0), F.lit(True)), offer(stem, at, (at > 0) & bare),
        offer(F.left(stem, F.char_length(stem) - len("/index")), at + len(EXTENSIONS), (at > 0) & F.endswith(stem, F.lit("/index"))),
    )
    offered = disk.select(F.col(path).alias("__file")).where("__file is not null").select(F.explode(F.filter(offers, lambda x: x.isNotNull())).alias("o"))
    best = offered.groupBy(F.col("o.base").alias(base)).agg(F.min("o.place").alias("__place"))

    hot = F.broadcast(written(hot_keys(rows, [base]), "hot-bases"))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    asked = rows.join(hot, base, "left").withColumn("__salt", F.when(F.col("__hot") | F.col(base).isNull(), part).otherwise(-1)).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    best = best.join(hot, base, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    found = asked.join(best.hint("merge"), [base, "__salt"], "left")
    return found.select(*rows.columns, F.concat(base, F.get(F.array(*map(F.lit, suffixes)), F.col("__place"))).alias(out))


def _candidates(imports: DataFrame, config: ProjectConfig) -> DataFrame:
    """Adds __inner (names a file of the project) and __base (the path that a request means, see tried_paths) to rows (file, source, ...)."""
    request = F.col("source")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    alias = ops.alias_match(request, [(a, t) for a, t in config.aliases])
    relative, rooted = request.startswith("."), request.startswith("/")
    inner = F.when(relative, F.concat_ws("/", folder, request)).when(rooted, F.concat(F.lit(config.root), request)).when(alias.isNotNull(), alias)
    based = F.concat(F.lit(config.base_url), F.lit("/"), request) if config.base_url else F.lit(None).cast("string")
    rows = imports.withColumn("__base", F.when(request.startswith("node:"), None).otherwise(normalize_path(F.coalesce(inner, based))))
    return rows.withColumn("__inner", inner.isNotNull() & ~request.startswith("node:"))


def with_unlisted(disk: DataFrame, parsed: DataFrame, config: ProjectConfig) -> DataFrame:
    """disk and the files that imports can mean but the listing lacks: outside the root, or behind linked folders."""
    imports = parsed.select("file", F.explode("imports.source").alias("source"))
    asked = _candidates(imports, config).select("__base").distinct().select(F.explode(tried_paths(F.col("__base"))).alias("path")).distinct()
    return written(disk.select("path").unionByName(listing.existing(asked.join(disk, "path", "left_anti"))), "scan-disk")


def resolve(imports: DataFrame, disk: DataFrame, config: ProjectConfig, packages: dict[str, set[str]]) -> DataFrame:
    """Adds res_kind (source, asset, external, missing) and res_path to rows (file, source, ...). disk: (path) of every file.
    packages: declared dependencies by folder."""
    request = F.col("source")
    rows = written(_candidates(imports, config), "scan-candidates")  # long expressions that several joins refer to
    name = package_name(request)
    asked = rows.select("file", name.alias("__name"))
    rows = found_paths(rows, "__base", disk, "path", "res_path")

    declared = name.isin(sorted(config.external_packages)) if config.external_packages else F.lit(False)
    nested = [(at, n) for at, names in sorted(packages.items()) if at != config.root for n in sorted(names)]
    rows = rows.withColumn("__name", name)
    if nested and config.base_url:  # a package declared in a folder above the file
        above = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/")) - 1), lambda k: F.array_join(F.slice(F.split("file", "/"), F.lit(1), k), "/"))
        held = F.broadcast(rows.sparkSession.createDataFrame(nested, "__at string, __name string"))  # the driver holds it
        asked = asked.join(held.select("__name"), "__name", "left_semi").withColumn("__at", F.explode(above))
        rows = rows.join(asked.join(held, ["__at", "__name"], "left_semi").select("file", "__name", F.lit(True).alias("__nested")).distinct(), ["file", "__name"], "left")
        declared = declared | F.coalesce("__nested", F.lit(False))
    outside = F.lit(True) if not config.base_url else name.isin(BUILTINS) | declared
    is_source = F.col("res_path").rlike(rf"[^/]\.(?:{'|'.join(EXTENSIONS)})$")
    kind = F.when(F.col("res_path").isNotNull(), F.when(is_source, "source").otherwise("asset")).when(F.col("__inner"), "missing").when(request.startswith("node:") | outside, "external").otherwise("missing")
    return rows.withColumn("res_kind", kind).drop("__base", "__inner", "__name", "__nested")


def nested_packages(paths: list[str]) -> dict[str, set[str]]:
    """The dependencies that each package.json declares, by its folder. Unreadable files declare none."""
    out = {}
    for path in paths:
        if path.endswith("/package.json") and "/node_modules/" not in path:
            try:
                package = read_jsonc(path)
            except ValueError:
                continue
            out[path.rpartition("/")[0]] = {n for kind in DEPENDENCIES if isinstance(field(package, kind), dict) for n in field(package, kind)}
    return out


def analyze(parsed: DataFrame, disk: DataFrame, config: ProjectConfig, packages: dict[str, set[str]] | None = None) -> Scan:
    """The plan after parsing. parsed: rows of PARSED; disk: (path) of every file that imports can resolve to."""
    spark, root = parsed.sparkSession, config.root
    path = F.substring("file", len(root) + 2, 1 << 30)
    listed = lambda names: F.col("file").isin(names) if names else F.lit(False)
    kind = classify.entry_kind(path, listed(config.explicit_entries), listed(config.package_entries))
    modules = written(parsed.withColumns({"relative_path": path, "entrypointKind": kind, "kept": ignored(path, rules(config.keep_patterns))}), "scan-modules")

    imports = modules.select("file", F.posexplode("imports").alias("pos", "i")).select("file", "pos", "i.source", "i.kind", "i.specifiers")
    imports = written(resolve(imports, disk, config, packages or {}), "scan-imports")
    sources = imports.where("res_kind = 'source'").select("file", "pos", "source", "kind", "specifiers", F.col("res_path").alias("target"))
    edges = ops.resolved(sources, modules, "target", "file")
    broken = imports.where("res_kind = 'missing'").select("file", "source", "kind")

    plain = modules.select("file", "relative_path", "entrypointKind", "kept", "barrel")
    orphans = ops.unreferenced(plain, edges, "file", "target", exempt=F.col("entrypointKind").isNotNull() | F.col("barrel") | F.col("kept"))
    orphans = orphans.withColumn("kind", classify.orphan_kind(F.col("relative_path")))
    orphans = orphans.select("file", "kind", classify.orphan_reason(F.col("kind")).alias("reason"), classify.orphan_confidence(F.col("kind")).alias("confidence"))

    taken = edges.select("target", "kind", F.explode_outer("specifiers").alias("s")).select("target", "kind", F.col("s.kind").alias("s_kind"), "s.imported")
    named = taken.where("s_kind in ('Default', 'Named')").select(F.col("target").alias("file"), F.col("imported").alias("exportName"))
    whole = taken.where("s_kind in ('Namespace', 'Unknown') or (kind = 'dynamic' and s_kind is null)").select(F.col("target").alias("file")).distinct()
    exports = modules.select("file", "relative_path", "entrypointKind", "barrel", F.posexplode(F.array_distinct("exports")).alias("pos", "e")).withColumn("exportName", F.col("e.name"))
    spared = F.coalesce(F.col("entrypointKind").isin(classify.KEEPS_EXPORTS), F.lit(False)) | F.col("barrel") | (F.col("exportName") == "*")
    spared = spared | classify.framework_consumes(F.col("entrypointKind"), F.col("relative_path"), F.col("exportName"))
    dead = ops.dead_members(exports.where(~spared), named.distinct(), ["file", "exportName"], whole).select("file", "exportName")

    unused = modules.select("file", F.explode("unused").alias("u")).select("file", "u.source", "u.local", "u.imported")
    routes = modules.where("entrypointKind in ('next-app-route', 'next-pages-route')").select("file", F.col("entrypointKind").alias("kind"))
    candidates = orphans.select("file", "reason", "confidence", F.lit(True).alias("safe"))

    before = dict(zip(FINDINGS, (broken, orphans, dead, unused, routes, candidates), strict=True))
    known = spark.createDataFrame([tuple(r[k] for k in ("kind", "file", "source", "local", "export")) for r in config.suppressions], "rule string, file string, source string, local string, exportName string")
    optional = {"brokenImports": ["source"], "orphanFiles": [], "deadExports": ["exportName"], "unusedImports": ["source", "local"], "deletionCandidates": []}
    findings = dict(before)
    if config.suppressions:
        for name, fields in optional.items():
            findings[name] = ops.suppressed(before[name], known.where(F.col("rule") == name[:-1]), ["file"], fields)
    counts = plain.agg(F.count(F.lit(1)).alias("filesScanned"), F.count("entrypointKind").alias("entrypoints"))

    degrees = ops.in_degree(plain.select("file"), edges, "file", "target", "file").withColumnRenamed("imported_by", "importedByCount")
    outgoing = edges.groupBy("file").agg(F.count(F.lit(1)).alias("importCount"))
    counted = modules.join(degrees, "file").join(outgoing, "file", "left").withColumn("importCount", F.coalesce("importCount", F.lit(0).cast("long")))
    counted = counted.withColumn("exportCount", F.size(F.array_distinct("exports")).cast("long"))
    return Scan(config, counted, edges, Written(findings, "scan"), {k: before[k] for k in optional} if config.suppressions else {}, counts)


def scan(spark: SparkSession, root: str, config: ProjectConfig | None = None) -> Scan:
    config = config or load_config(root)
    found, files = listing.source_files(config), listing.all_files(config.root)
    disk = spark.createDataFrame([(p,) for p in files], "path string")
    parsed = written(parse_sources(listing.read_sources(spark, found)), "scan-parsed")
    return analyze(parsed, with_unlisted(disk, parsed, config), config, nested_packages(files))


def report(scanned: Scan, now: datetime | None = None) -> dict:
    """The scan as one document, findings and modules by path component. A report is made to be read, so this collects it."""
    by_path = lambda df, *more: df.orderBy(F.split("file", "/", -1), *more)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    rounded = lambda r: {k: round(round(v * 100) / 100, 2) if k == "confidence" else v for k, v in r.items()}
    now = now or datetime.now(timezone.utc)
    summary = scanned.summary.first().asDict()
    if not summary["suppressedFindings"]:
        del summary["suppressedFindings"]
    modules = by_path(scanned.modules).select("file", F.col("relative_path").alias("relativePath"), "entrypointKind", "importedByCount", "importCount", "exportCount")
    return {
        "schemaVersion": 2,
        "generatedAt": now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z",
        "project": {"root": scanned.config.root, "configPath": scanned.config.config_path},
        "summary": summary,
        "findings": {name: [rounded(r) for r in rows(by_path(scanned.findings[name]))] for name in FINDINGS},
        "graph": {"modules": rows(modules)},
    }
