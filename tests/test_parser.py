import pytest

from refgraph.sources.jsparse import parse_module


def imports(source, path="a.tsx"):
    return [(i["source"], i["kind"], [(s["kind"], s["imported"], s["local"]) for s in i["specifiers"]]) for i in parse_module(path, source)["imports"]]


def exports(source, path="a.ts"):
    return [(e["name"], e["kind"]) for e in parse_module(path, source)["exports"]]


def unused(source, path="a.tsx"):
    return [u["local"] for u in parse_module(path, source)["unused"]]


def test_import_declarations():
    assert imports("import a, {b as c, default as d} from 'x'; import * as n from 'n'; import 'side'; import {} from 'none'") == [
        ("x", "static", [("Default", "default", "a"), ("Named", "b", "c"), ("Default", "default", "d")]),
        ("n", "static", [("Namespace", "*", "n")]), ("side", "side-effect", []), ("none", "side-effect", []),
    ]


def test_reexports():
    assert imports("export {a, default as b} from './x'; export * from './y'; export * as z from './z'") == [
        ("./x", "reexport", [("Named", "a", "a"), ("Default", "default", "b")]), ("./y", "reexport-all", [("Unknown", "*", "*")]), ("./z", "reexport-namespace", [("Namespace", "*", "z")]),
    ]


def test_requires():
    assert imports("const {a, b: c} = require('m'); const p = require('z').k; require('s'); x = require('w'); f(require('no')); const {...r} = require('rest')", "a.js") == [
        ("m", "require", [("Named", "a", "a"), ("Named", "b", "c")]), ("z", "require", [("Unknown", None, "p")]), ("s", "require", []), ("w", "require", []),
        ("rest", "require", [("Unknown", None, None)]),
    ]
    assert imports("function f(require) { const x = require('m'); }", "a.js") == []
    assert imports("import foo = require('foo');", "a.ts") == [("foo", "require", [("Unknown", None, "foo")])]


def test_dynamic_imports():
    assert imports("import('./a'); import(name); async () => { await import(`./t`) }") == [("./a", "dynamic", [])]
    lazy = "import {lazy} from 'react'; const A = lazy(() => import('./A')); const B = lazy(() => import('./B').then(m => ({ default: m.Named })));"
    assert imports(lazy)[1:] == [("./A", "dynamic", [("Default", "default", None)]), ("./B", "dynamic", [("Named", "Named", None)])]
    assert imports("const load = () => import('./x');") == []
    assert imports("const load = () => import('./x'); load();") == [("./x", "dynamic", [])]
    assert imports("import dynamic from 'next/dynamic'; const load = () => import('./x'); dynamic(load);")[1:] == [("./x", "dynamic", [("Default", "default", None)])]
    assert imports("import React from 'react'; React.lazy(async () => { return import('./x').then(({ X }) => ({ default: X })) })")[1:] == [("./x", "dynamic", [("Named", "X", None)])]


def test_exports():
    assert exports("export default 1; export const {a, b: [c, ...d]} = v, e = 2; export function f() {} export class G {} export type H = a; export interface I {} export enum J {A}") == [
        ("default", "Default"), *((n, "Named") for n in "acdefGHIJ"),
    ]
    assert exports("const a = 1, b = 2; export {a, b as c}") == [("a", "Named"), ("c", "Named")]
    assert exports("export * from './x'; export * as y from './y'; export {z} from './z'") == [("*", "ReexportAll"), ("y", "ReexportNamespace"), ("z", "Reexport")]
    assert exports("exports.a = 1; module.exports.b = 2; exports['c'] = 3; exports.d += 1; module.exports = {e, 'f': 1, get g() {}, [h]: 1, i() {}}", "a.js") == [
        ("a", "Named"), ("b", "Named"), ("c", "Named"), ("default", "Default"), ("e", "Named"), ("f", "Named"), ("i", "Named"),
    ]
    assert exports("export = x;") == [("default", "Default")]
    assert exports("export as namespace Lib;") == [("Lib", "ReexportNamespace")]


@pytest.mark.parametrize(("source", "want"), [("export * from './a'; export {b} from './b'", True), ("'use client'; export * from './a'", True), ("export * from './a'; const x = 1", False), ("import './a'", False), ("", False)])
def test_barrels(source, want):
    assert parse_module("a.ts", source)["barrel"] is want


@pytest.mark.parametrize("source", ["import {a from 'x'; export const y = 1", "export const = 1", "const a = (", "import x from 'x'; `${", "export {a b} from 'x'"])
def test_errors_leave_an_empty_module(source):
    assert parse_module("a.ts", source) == {"imports": [], "exports": [], "unused": [], "barrel": False}


def test_unused_imports():
    assert unused("import {a, b, c, d} from 'x'; a(); const o = {b: 1}; const p = {c}; o.d") == ["b", "d"]
    assert unused("import {x} from 'm'; function g(x) { return x }") == ["x"]
    assert unused("import {x} from 'm'; function g(y) { return x }") == []
    assert unused("import Foo from 'f'; import bar from 'b'; const e = <div><Foo/><bar/></div>") == ["bar"]
    assert unused("import * as ui from 'ui'; const e = <ui.Button/>") == []
    assert unused("import {T} from 't'; let x: T; export {y} from 'y'") == []
    assert unused("import {a} from 'x'; export {a as b}") == []


def test_text_is_no_code():
    assert imports("// import 'a'\n/* require('b') */ const s = \"import('c')\"; const t = `${import('d')}`; const r = /import('e')/;") == [("d", "dynamic", [])]


def test_a_loader_in_a_block_below_another_binding_of_its_name():
    """The innermost binding decides; no module that a loader imports is lost."""
    found = imports(
        """
        import React from "react";
        const pick = () => import("./outer");
        function make() {
          const pick = 1;
          {
            const pick = () => import("./inner");
            return React.lazy(pick);
          }
        }
        function other(pick) { return pick(); }
        const alias = pick;
        alias();
        """
    )
    assert ("./inner", "dynamic", [("Default", "default", None)]) in found and "./outer" in {source for source, *_ in found}
