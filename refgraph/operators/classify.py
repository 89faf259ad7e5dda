"""What kind of entry a module is, what kind of orphan, and which exports a framework consumes: native columns over relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refgraph.functions.paths import route_stem

from .reference import cascade

# Names that frameworks and tools give a meaning.
APP_ROUTE_STEMS = [
    "page", "route", "layout", "loading", "error", "not-found", "global-not-found", "forbidden", "unauthorized", "default", "template", "global-error",
    "robots", "sitemap", "icon", "apple-icon", "opengraph-image", "twitter-image", "manifest",
]
TOOLS = ["next", "eslint", "vite", "webpack", "rollup", "vitest", "jest", "postcss", "tailwind", "babel", "playwright", "cypress"]
APP_ENTRY_STEMS = ["main", "index", "bootstrap", "cli"]
SCRIPT_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "sh"]
SOURCE_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"]
FRAMEWORK_STEMS = ["middleware", "instrumentation"]
PAGES_EXPORTS = ["default", "config", "getInitialProps", "getStaticProps", "getStaticPaths", "getServerSideProps"]
IMAGE_STEMS, ICON_STEMS = ["opengraph-image", "twitter-image"], ["icon", "apple-icon"]
METADATA_FILES = ["robots", "sitemap", "manifest"]
# The exports that files of these names give to the framework.
APP_EXPORTS = [
    (["default"], [s for s in APP_ROUTE_STEMS if s != "route"]),
    (["metadata", "generateMetadata", "viewport", "generateViewport"], ["page", "layout", "global-not-found"]),
    (["generateImageMetadata"], ICON_STEMS + IMAGE_STEMS),
    (["generateSitemaps"], ["sitemap"]),
    (["alt"], IMAGE_STEMS),
    (["size", "contentType"], IMAGE_STEMS + ICON_STEMS),
    (["generateStaticParams"], ["page", "layout", "route"]),
    (["revalidate", "dynamic", "dynamicParams", "fetchCache", "runtime", "preferredRegion", "maxDuration"], ["page", "layout", "route", *METADATA_FILES, *ICON_STEMS, *IMAGE_STEMS]),
    (["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"], ["route"]),
]
# Kinds of orphans, their reasons and confidence, and the reasons as they are displayed in Korean.
ORPHANS = {
    "orphan-component": ("Component-like module has no inbound references.", 0.92),
    "orphan-route-module": ("Route-like module is not connected to any router entry.", 0.84),
    "orphan-module": ("Module has no inbound references and is not treated as an entrypoint.", 0.88),
}
KOREAN = {
    "Component-like module has no inbound references.": "컴포넌트로 보이는 모듈에 참조가 없습니다.",
    "Route-like module is not connected to any router entry.": "라우트로 보이는 모듈이 어떤 라우터 진입점에도 연결되지 않았습니다.",
    "Module has no inbound references and is not treated as an entrypoint.": "모듈에 참조가 없고 진입점으로 취급되지 않습니다.",
}
KEEPS_EXPORTS = ["user-entry", "package-entry", "app-entry", "tooling-entry", "framework-entry"]


def _any(names: list[str]) -> str:
    return "|".join(n.replace(".", r"\.") for n in names)


def _placed(path: Column, segment: str) -> Column:
    """Below a folder of that name at the root, in src, or two below packages or apps."""
    return path.rlike(rf"^{segment}/") | path.rlike(rf"(?:^|/)src/{segment}/") | path.rlike(rf"(?:^|/)(?:packages|apps)/[^/]*/{segment}/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def entry_kind(path: Column, explicit: Column, package: Column) -> Column:
    """explicit, package: whether the configuration or the package names the file."""
    name, lower = file_name(path), F.lower(path)
    low_name = file_name(lower)
    return cascade([
        (explicit, "user-entry"),
        (package, "package-entry"),
        (_placed(path, "app") & route_stem(name).isin(APP_ROUTE_STEMS), "next-app-route"),
        (_placed(path, "pages") & name.rlike(r"^.+\.[^.]+$"), "next-pages-route"),
        (path.rlike(rf"^(?:|(?:.*/)?src/)(?:{_any(APP_ENTRY_STEMS)})\.[^./]+$"), "app-entry"),
        (name.rlike(rf"^(?:{_any(TOOLS)})\.config\.[^.]+$"), "tooling-entry"),
        (lower.rlike(r"(?:^|/)__tests__/") | low_name.rlike(rf"\.(?:test|spec)\.(?:{_any(SOURCE_EXTENSIONS)})$"), "tooling-entry"),
        (lower.startswith("scripts/") & low_name.rlike(rf"[^/]\.(?:{_any(SCRIPT_EXTENSIONS)})$") & (low_name.startswith("verify-") | low_name.contains("smoke") | low_name.contains("validation")), "tooling-entry"),
        (path.rlike(rf"^(?:{_any(FRAMEWORK_STEMS)})\.(?:{_any(SOURCE_EXTENSIONS)})$"), "framework-entry"),
    ])


def orphan_kind(path: Column) -> Column:
    name, lower = file_name(path), F.lower(path)
    base = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    routed = F.exists(F.split(base, "[^A-Za-z0-9]"), lambda t: F.lower(t).isin("page", "route"))
    return cascade([(lower.contains("/components/") | name.rlike(r"^\p{IsUppercase}"), "orphan-component"), (lower.contains("/routes/") | routed, "orphan-route-module"), (F.lit(True), "orphan-module")])


def orphan_reason(kind: Column) -> Column:
    return cascade([(kind == k, reason) for k, (reason, _) in ORPHANS.items()])


def displayed_reason(reason: Column, texts: dict[str, str] = KOREAN) -> Column:
    """A reason in another language; reasons that are not known stay as they are."""
    return F.coalesce(cascade([(reason == known, text) for known, text in texts.items()]), reason)


def orphan_confidence(kind: Column) -> Column:
    out = F.lit(None).cast("float")
    for k, (_, sure) in ORPHANS.items():
        out = F.when(kind == k, F.lit(sure).cast("float")).otherwise(out)
    return out


def framework_consumes(kind: Column, path: Column, export: Column) -> Column:
    stem = route_stem(file_name(path))
    app = F.lit(False)
    for names, stems in APP_EXPORTS:
        app = app | (export.isin(names) & stem.isin(stems))
    return F.coalesce(((kind == "next-pages-route") & export.isin(PAGES_EXPORTS)) | ((kind == "next-app-route") & app), F.lit(False))
