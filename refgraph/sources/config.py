"""A project's configuration, read on the driver: package.json, tsconfig.json or jsconfig.json, the tool's own file, .gitignore."""

from __future__ import annotations

import os
from dataclasses import dataclass, field as dataclass_field
from pathlib import Path

import numpy as np

from refgraph.functions.paths import normalize

from . import commands, jsonc
from .jsonc import field

CONFIG_NAME, SUPPRESSIONS_NAME, REPORT_NAME = "refgraph.config.json", ".refgraph/suppressions.json", ".refgraph/latest-report.json"

# Extensions in the order they are tried, and folders that are ignored by name.
EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts"]
ENTRY_EXTENSIONS = [*EXTENSIONS, "d.ts", "d.mts", "d.cts"]
TYPES_EXTENSIONS = ["d.ts", "d.mts", "d.cts", "ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
IGNORED_FOLDERS = [
    ".git", ".next", ".nuxt", ".output", ".parcel-cache", ".svelte-kit", ".turbo", ".vercel", ".yarn", "build", "coverage", "dist", "examples", "fixtures",
    "node_modules", "out", "storybook-static", "test", "tests", "__fixtures__",
]
DEPENDENCIES = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
SUPPRESSED = {"brokenImport": "source", "orphanFile": None, "deadExport": "export", "unusedImport": "local", "deletionCandidate": None}


class ConfigError(ValueError):
    """A configuration file has a value of the wrong kind."""


@dataclass
class ProjectConfig:
    root: str
    config_path: str | None = None
    base_url: str | None = None
    roots: list[str] = dataclass_field(default_factory=list)
    ignored_folders: list[str] = dataclass_field(default_factory=lambda: list(IGNORED_FOLDERS))
    ignore_patterns: list[str] = dataclass_field(default_factory=list)
    keep_patterns: list[str] = dataclass_field(default_factory=list)
    explicit_entries: list[str] = dataclass_field(default_factory=list)
    package_entries: list[str] = dataclass_field(default_factory=list)
    #: (alias, target with at most one `*`), longest alias first.
    aliases: list[tuple[str, str]] = dataclass_field(default_factory=list)
    external_packages: set[str] = dataclass_field(default_factory=set)
    #: kind, file, source, local, export, reason; None stands for any.
    suppressions: list[dict] = dataclass_field(default_factory=list)


def absolute(path: str) -> str:
    return normalize(os.path.abspath(path))


def joined(base: str, path: str) -> str:
    return normalize(path if path.startswith("/") else f"{base}/{path}")


def read_jsonc(path: str) -> object:
    """The file's value, None if there is no file."""
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        try:
            return jsonc.loads(f.read())
        except ValueError as e:
            raise ConfigError(f"{path}: {e}") from e


def entry_path(root: str, value: str, types: bool) -> str | None:
    """The file that an entry stands for: itself, the index of a folder, or with an extension."""
    path, order = joined(root, value), TYPES_EXTENSIONS if types else ENTRY_EXTENSIONS
    if os.path.isfile(path):
        return path
    tried = [f"{path}/index.{e}" for e in order] if os.path.isdir(path) else [f"{path}.{e}" for e in order] if not os.path.splitext(path)[1] else []
    return next((t for t in tried if os.path.isfile(t)), None)


def _exports(value: object, types: bool):
    """The (path, wants types) of an exports value, however nested."""
    if isinstance(value, str):
        yield value, types
    elif isinstance(value, list):
        for v in value:
            yield from _exports(v, types)
    elif isinstance(value, dict):
        for key, v in value.items():
            yield from _exports(v, types or key == "types")


def package_entries(root: str, package: object) -> list[str]:
    found: list[str] = []

    def add(value: object, types: bool = False) -> None:
        if isinstance(value, str):
            found.append(entry_path(root, value, types) or joined(root, value))

    add(field(package, "main"))
    add(field(package, "module"))
    add(field(package, "types"), True)
    bins = field(package, "bin")
    for value in bins.values() if isinstance(bins, dict) else [bins]:
        add(value)
    for value, types in _exports(field(package, "exports"), False):
        add(value, types)

    scripts = field(package, "scripts")
    scripts = scripts if isinstance(scripts, dict) else {}

    def scan(command: str, folder: str) -> None:
        def script(path: str, in_package: bool) -> None:
            base, path = root if in_package else folder, path.strip("\"'`")
            found.append(entry_path(base, path, False) or joined(base, path))

        commands.command_scripts(command, scripts, script)

    for command in scripts.values():
        if isinstance(command, str):
            scan(command, root)
    for path, action in workflow_files(root):
        with open(path, encoding="utf-8") as f:
            steps = commands.run_steps(f.read())
        for command, folder in steps:
            own = os.path.dirname(path)
            if action:
                command, folder = (commands.with_action_path(x, own) if x else x for x in (command, folder))
            scan(command, joined(root, folder) if folder else root)
    return list(dict.fromkeys(found))


def workflow_files(root: str) -> list[tuple[str, bool]]:
    """(path, is an action) of workflows and composite actions."""
    out = []
    for folder, action in ((".github/workflows", False), (".github/actions", True)):
        for at, folders, names in os.walk(f"{root}/{folder}"):
            folders.sort()
            for name in sorted(names):
                if name in ("action.yml", "action.yaml") if action else name.endswith((".yml", ".yaml")):
                    out.append((f"{at}/{name}", action))
    return out


def gitignore_lines(root: str) -> list[str]:
    path = f"{root}/.gitignore"
    if not os.path.isfile(path):
        return []
    lines = (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return [line for line in lines if line and not line.startswith("#")]


def suppression_rules(root: str, value: object) -> list[dict]:
    """The valid rules of a list; others are dropped."""
    out = []
    for rule in value if isinstance(value, list) else []:
        kind, file, reason = (field(rule, k) for k in ("kind", "file", "reason"))
        optional = {k: field(rule, k) for k in ("source", "local", "export")}
        if kind in SUPPRESSED and isinstance(file, str) and isinstance(reason, str) and reason.strip() and all(v is None or isinstance(v, str) for v in optional.values()):
            out.append({"kind": kind, "file": joined(root, file), "reason": reason, **optional})
    return out


def load_config(root: str) -> ProjectConfig:
    root = absolute(root)
    package = read_jsonc(f"{root}/package.json")
    compiler = read_jsonc(f"{root}/tsconfig.json")
    compiler = field(compiler if compiler is not None else read_jsonc(f"{root}/jsconfig.json"), "compilerOptions")
    own = read_jsonc(f"{root}/{CONFIG_NAME}")
    try:
        base = field(compiler, "baseUrl")
        base = joined(root, base) if isinstance(base, str) else None
        roots = [joined(root, r) for r in jsonc.required_strings(field(own, "roots"), "roots")]
        aliases = []
        paths = field(compiler, "paths")
        for alias, targets in paths.items() if isinstance(paths, dict) else ():
            for target in targets if isinstance(targets, list) else ():
                if not isinstance(target, str):
                    raise ConfigError(f"compilerOptions.paths[{alias!r}] must hold strings only")
                aliases.append((alias, joined(base or root, target)))
        extra = read_jsonc(f"{root}/{SUPPRESSIONS_NAME}")
        return ProjectConfig(
            root=root,
            config_path=f"{root}/{CONFIG_NAME}" if os.path.exists(f"{root}/{CONFIG_NAME}") else None,
            base_url=base,
            roots=list(dict.fromkeys(roots)) or [root],
            ignored_folders=list(dict.fromkeys([*IGNORED_FOLDERS, *jsonc.strings(field(own, "ignore"))])),
            ignore_patterns=[*gitignore_lines(root), *jsonc.required_strings(field(own, "ignorePatterns"), "ignorePatterns")],
            keep_patterns=jsonc.required_strings(field(own, "keepPatterns"), "keepPatterns"),
            explicit_entries=[joined(root, e) for e in jsonc.required_strings(field(own, "entry"), "entry")],
            package_entries=package_entries(root, package),
            aliases=sorted(aliases, key=lambda a: -len(a[0])),
            external_packages={name for kind in DEPENDENCIES for name in (field(package, kind) or {} if isinstance(field(package, kind), dict) else {})},
            suppressions=suppression_rules(root, field(own, "suppressions")) + suppression_rules(root, field(extra, "suppressions")),
        )
    except ValueError as e:
        raise e if isinstance(e, ConfigError) else ConfigError(str(e)) from e


def clean_threshold(root: str) -> float:
    """thresholds.cleanMinConfidence as a 32-bit float; 0 if the file has no thresholds."""
    own = read_jsonc(f"{absolute(root)}/{CONFIG_NAME}")
    thresholds = field(own, "thresholds")
    if thresholds is None:
        return 0.0
    value = field(thresholds, "cleanMinConfidence")
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value <= 1:
        raise ConfigError("thresholds.cleanMinConfidence must be a number from 0 to 1")
    return float(np.float32(value))
