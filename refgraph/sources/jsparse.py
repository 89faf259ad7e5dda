"""What one JavaScript or TypeScript file imports, exports and imports without using.

A file with a syntax error has no imports and no exports, but stays a file. Records come in source order:
imports (source, kind, specifiers of (kind, imported, local)), exports (name, kind), unused (source, local, imported), and
whether the file is nothing but re-exports.
"""

from __future__ import annotations

from .jstokens import SourceError, Token, tokens

REEXPORTS = ("reexport", "reexport-all", "reexport-namespace")
_DECLARES = ("const", "let", "var")
_CONTROL = ("if", "for", "while", "switch", "catch", "with")
_MODIFIERS = frozenset("get set async static public private protected readonly abstract override declare accessor *".split())
_STATEMENT = frozenset("import export const let var function class return if for while do switch try throw type interface enum declare async break continue".split())
#: Wrappers that take a loader: module, exported name.
_WRAPPERS = (("react", "lazy"), ("next/dynamic", "default"))


def parse_module(path: str, source: str) -> dict:
    name = path.rsplit("/", 1)[-1]
    types = name.endswith((".ts", ".tsx", ".mts", ".cts"))
    jsx = not name.endswith((".ts", ".mts", ".cts"))
    try:
        return _Module(tokens(source, jsx, types)).result()
    except (SourceError, IndexError, RecursionError):
        return {"imports": [], "exports": [], "unused": [], "barrel": False}


class _Module:
    def __init__(self, found: list[Token]):
        self.t, self.n = found, len(found)
        self.close: dict[int, int] = {}
        self.outer = [-1] * self.n
        stack: list[int] = []
        for k, t in enumerate(found):
            self.outer[k] = stack[-1] if stack else -1
            if t.kind == "p":
                if t.text in ("(", "[", "{", "${"):
                    stack.append(k)
                elif t.text in (")", "]", "}"):
                    self.outer[k] = self.outer[stack[-1]]
                    self.close[stack.pop()] = k
        self.open = {b: a for a, b in self.close.items()}
        self.imports: list[tuple[int, str, str, list]] = []
        self.exports: list[tuple[str, str]] = []
        self.skip: set[int] = set()  # tokens that are no references
        self.bindings: set[int] = set()
        self.shadows: dict[str, list[tuple[int, int]]] = {}
        #: Loaders by the place of their binding, and the bindings by name.
        self.loaders: dict[int, tuple[str, list]] = {}
        self.named: dict[str, list[int]] = {}
        self.wrappers: set[str] = set()
        self.namespaces: set[str] = set()
        self.no_edge: set[int] = set()  # `import` tokens that make no edge of their own

    # -- tokens ---------------------------------------------------------------------------------------------------

    def p(self, k: int, text: str) -> bool:
        return 0 <= k < self.n and self.t[k].kind == "p" and self.t[k].text == text

    def word(self, k: int, *texts: str) -> bool:
        return 0 <= k < self.n and self.t[k].kind == "id" and (not texts or self.t[k].text in texts)

    def string(self, k: int) -> bool:
        return 0 <= k < self.n and self.t[k].kind == "str"

    def member(self, k: int) -> bool:
        return self.p(k - 1, ".") or self.p(k - 1, "?.")

    def name_at(self, k: int) -> str:
        if not (self.word(k) or self.string(k)):
            raise SourceError(f"name expected at token {k}")
        return self.t[k].text

    # -- declarations ---------------------------------------------------------------------------------------------

    def clause(self, k: int) -> tuple[list[tuple[str, str]], int]:
        """The pairs (name, as) in braces at k, and the index past them."""
        end, out = self.close[k], []
        k += 1
        while k < end:
            if self.word(k, "type") and (self.word(k + 1) or self.string(k + 1)) and not (self.word(k + 1, "as") and (self.p(k + 2, ",") or k + 2 == end or self.word(k + 2, "as") is False and self.word(k + 2))):
                k += 1
            first = second = self.name_at(k)
            k += 1
            if self.word(k, "as"):
                second = self.name_at(k + 1)
                k += 2
            out.append((first, second))
            if k < end and not self.p(k, ","):
                raise SourceError(f"comma expected at token {k}")
            k += 1
        return out, end + 1

    def source_at(self, k: int) -> tuple[str, int]:
        if not (self.word(k, "from") and self.string(k + 1)):
            raise SourceError(f"source expected at token {k}")
        end = k + 2
        if self.word(end, "with", "assert") and self.p(end + 1, "{"):
            end = self.close[end + 1] + 1
        return self.t[k + 1].text, end

    def import_declaration(self, k: int) -> int:
        start = k
        k += 1
        if self.string(k):
            self.imports.append((start, self.t[k].text, "side-effect", []))
            end = k + 1
            if self.word(end, "with", "assert") and self.p(end + 1, "{"):
                end = self.close[end + 1] + 1
        elif end := self.import_equals(k, start):
            pass
        else:
            if self.word(k, "type", "defer") and not self.word(k + 1, "from") and not self.p(k + 1, ","):
                k += 1
            found: list[tuple[str, str | None, str | None]] = []
            if self.word(k):
                found.append(("Default", "default", self.t[k].text))
                k += 1
                if self.p(k, ","):
                    k += 1
                    if not (self.p(k, "{") or self.p(k, "*")):
                        raise SourceError("bad import clause")
            if self.p(k, "*"):
                if not self.word(k + 1, "as"):
                    raise SourceError("bad import clause")
                found.append(("Namespace", "*", self.name_at(k + 2)))
                k += 3
            elif self.p(k, "{"):
                pairs, k = self.clause(k)
                found += [("Default" if a == "default" else "Named", a, b) for a, b in pairs]
            source, end = self.source_at(k)
            self.imports.append((start, source, "static" if found else "side-effect", found))
            self.wrapper_bindings(source, found)
        self.skip.update(range(start, end))
        return end

    def import_equals(self, k: int, start: int) -> int:
        """`x = require("y")` or `x = A.B` after import; the index past it, 0 if it is another form."""
        only_types = self.word(k, "type") and self.word(k + 1) and self.p(k + 2, "=")
        k += only_types
        if not (self.word(k) and self.p(k + 1, "=")):
            return 0
        if self.word(k + 2, "require") and self.p(k + 3, "(") and self.string(k + 4):
            if not only_types:
                self.imports.append((start, self.t[k + 4].text, "require", [("Unknown", None, self.t[k].text)]))
                self.wrapper_bindings(self.t[k + 4].text, [("Unknown", None, self.t[k].text)])
            return self.close[k + 3] + 1
        self.bindings.add(k)
        return k + 2  # what follows are references

    def export_declaration(self, k: int) -> tuple[int, bool]:
        """The index to go on from, and whether it re-exports."""
        start = k
        k += 1
        if self.p(k, "="):
            self.add_export("default", "Default")
            return k + 1, False
        if self.word(k, "as") and self.word(k + 1, "namespace"):
            self.add_export(self.name_at(k + 2), "ReexportNamespace")
            self.skip.update(range(start, k + 3))
            return k + 3, False
        if self.word(k, "default"):
            self.add_export("default", "Default")
            k += 1
            while self.word(k, "async", "abstract"):
                k += 1
            if self.word(k, "function", "class", "interface"):
                name = k + 1 + self.p(k + 1, "*")
                if self.word(name) and not self.word(name, "extends", "implements"):
                    self.bindings.add(name)
            return k, False
        if self.word(k, "type") and (self.p(k + 1, "{") or self.p(k + 1, "*")):
            k += 1
        if self.p(k, "*"):
            if self.word(k + 1, "as"):
                name = self.name_at(k + 2)
                source, end = self.source_at(k + 3)
                self.imports.append((start, source, "reexport-namespace", [("Namespace", "*", name)]))
                self.add_export(name, "ReexportNamespace")
            else:
                source, end = self.source_at(k + 1)
                self.imports.append((start, source, "reexport-all", [("Unknown", "*", "*")]))
                self.add_export("*", "ReexportAll")
            self.skip.update(range(start, end))
            return end, True
        if self.p(k, "{"):
            opened = k
            pairs, k = self.clause(k)
            if self.word(k, "from") and self.string(k + 1):
                source, end = self.source_at(k)
                self.imports.append((start, source, "reexport", [("Default" if a == "default" else "Named", a, b) for a, b in pairs]))
                for _, b in pairs:
                    self.add_export(b, "Reexport")
                self.skip.update(range(start, end))
                return end, True
            for _, b in pairs:
                self.add_export(b, "Named")
            for j in range(opened, k):  # `as name` is no reference
                if self.word(j, "as"):
                    self.skip.update((j, j + 1))
            return k, False
        if self.word(k, "import"):
            if self.word(k + 1) and self.p(k + 2, "="):
                self.add_export(self.t[k + 1].text, "Named")
            return self.import_declaration(k), False
        while self.word(k, "declare", "abstract", "async") or (self.word(k, "const") and self.word(k + 1, "enum")):
            k += 1
        if self.word(k, *_DECLARES):
            for j in self.declared(k):
                self.add_export(self.t[j].text, "Named")
        elif self.word(k, "function", "class", "type", "interface", "enum", "namespace", "module"):
            name = k + 1 + self.p(k + 1, "*")
            if self.word(name):
                if not self.word(k, "namespace", "module"):
                    self.add_export(self.t[name].text, "Named")
                self.bindings.add(name)
        else:
            raise SourceError(f"bad export at token {k}")
        return k, False

    def add_export(self, name: str, kind: str) -> None:
        if (name, kind) not in self.exports:
            self.exports.append((name, kind))

    # -- bindings and scopes --------------------------------------------------------------------------------------

    def pattern(self, k: int) -> tuple[list[int], int]:
        """The tokens that a pattern at k binds, and the index past it."""
        if self.p(k, "..."):
            return self.pattern(k + 1)
        if self.word(k):
            return [k], k + 1
        if not (self.p(k, "{") or self.p(k, "[")):
            return [], k + 1
        end, out, braces = self.close[k], [], self.p(k, "{")
        k += 1
        while k < end:
            if braces and not self.p(k, "..."):
                after = self.close[k] + 1 if self.p(k, "[") else k + 1
                if self.p(after, ":"):
                    if self.word(k):
                        self.skip.add(k)
                    k = after + 1
            if self.p(k, ","):
                k += 1
                continue
            names, k = self.pattern(k)
            out += names
            while k < end and not self.p(k, ","):  # a default
                k = self.close.get(k, k) + 1
            k += 1
        return out, end + 1

    def declared(self, k: int) -> list[int]:
        """The tokens that the const, let or var at k binds."""
        out, outer = [], self.outer[k]
        k += 1
        while k < self.n:
            names, k = self.pattern(k)
            out += names
            while k < self.n and not self.p(k, ","):
                if self.p(k, ";") or self.outer[k] != outer or (k in self.open) or (self.t[k].fresh and self.word(k, *_STATEMENT)):
                    return out
                k = self.close.get(k, k) + 1
            if k >= self.n or self.outer[k] != outer:
                return out
            k += 1
        return out

    def scope_end(self, k: int) -> int:
        o = self.outer[k]
        while o >= 0 and not self.p(o, "{"):
            o = self.outer[o]
        return self.close[o] if o >= 0 else -1

    def bind(self, k: int, end: int | None = None) -> None:
        self.bindings.add(k)
        end = self.scope_end(k) if end is None else end
        if end >= 0:
            self.shadows.setdefault(self.t[k].text, []).append((k, end))

    def parameters(self, k: int, end: int) -> None:
        """Binds the parameters in the parentheses at k up to the end of the function."""
        stop = self.close[k]
        j = k + 1
        while j < stop:
            while self.word(j, "public", "private", "protected", "readonly", "override") and (self.word(j + 1) or self.p(j + 1, "{")):
                j += 1
            names, j = self.pattern(j)
            for x in names:
                self.bind(x, end)
            while j < stop and not self.p(j, ","):
                j = self.close.get(j, j) + 1
            j += 1

    def body_end(self, k: int) -> int:
        """The end of a function whose parameters end before k: past a return type to the body."""
        while k < self.n and not self.p(k, "{") and not self.p(k, ";") and not (self.t[k].fresh and self.word(k, *_STATEMENT)):
            k = self.close.get(k, k) + 1
        return self.close.get(k, k)

    def expression_end(self, k: int) -> int:
        outer = self.outer[k]
        while k < self.n and self.outer[k] == outer and not (self.t[k].kind == "p" and self.t[k].text in (",", ";", ")", "]", "}")):
            k = self.close.get(k, k) + 1
        return k

    def scopes(self) -> None:
        for k in range(self.n):
            t = self.t[k]
            if t.kind == "id" and not self.member(k) and k not in self.skip:
                if t.text in _DECLARES and not (self.word(k + 1, "enum")) and (self.word(k + 1) or self.p(k + 1, "{") or self.p(k + 1, "[")):
                    for j in self.declared(k):
                        self.bind(j)
                elif t.text == "function":
                    name = k + 1 + self.p(k + 1, "*")
                    if self.word(name):
                        self.bind(name)
                        name += 1
                    opened = self.next_paren(name)
                    if opened is not None:
                        self.parameters(opened, self.body_end(self.close[opened] + 1))
                elif t.text in ("class", "enum", "interface") and self.word(k + 1) and not self.word(k + 1, "extends", "implements"):
                    self.bind(k + 1)
                elif t.text == "type" and self.word(k + 1) and (self.p(k + 2, "=") or self.p(k + 2, "<")):
                    self.bind(k + 1)
                elif t.text == "catch" and self.p(k + 1, "("):
                    self.parameters(k + 1, self.body_end(self.close[k + 1] + 1))
            elif t.kind == "p" and t.text == "=>":
                self.arrow(k)
            elif t.kind == "p" and t.text == "(" and self.method_here(k):
                self.parameters(k, self.body_end(self.close[k] + 1))

    def next_paren(self, k: int) -> int | None:
        while k < self.n and not self.p(k, "("):
            if self.p(k, "{") or self.p(k, ";"):
                return None
            k += 1
        return k if k < self.n else None

    def arrow(self, k: int) -> None:
        end = self.close[k + 1] if self.p(k + 1, "{") else self.expression_end(k + 1)
        if self.p(k - 1, ")"):
            self.parameters(self.open[k - 1], end)
        elif self.word(k - 1) and not self.p(k - 2, ":"):
            self.bind(k - 1, end)
        else:  # with a return type
            j = k - 1
            while j > 0 and not self.p(j, ")") and not self.p(j, ";"):
                j = self.open.get(j, j) - 1
            if self.p(j, ")") and self.p(j + 1, ":"):
                self.parameters(self.open[j], end)

    def method_here(self, k: int) -> bool:
        """Whether the parentheses at k are the parameters of a method."""
        if self.outer[k] < 0 or not self.p(self.outer[k], "{") or not (self.p(self.close[k] + 1, "{") or self.p(self.close[k] + 1, ":")):
            return False
        name = k - 1
        if not (self.word(name) or self.string(name) or self.p(name, "]")) or self.word(name, *_CONTROL, "function") or self.member(name):
            return False
        before = name - 1
        return self.p(before, "{") or self.p(before, ",") or self.p(before, ";") or self.p(before, "}") or (0 <= before and self.t[before].text in _MODIFIERS) or (self.t[name].fresh and self.p(self.close[k] + 1, "{"))

    def shadowed(self, name: str, k: int) -> bool:
        return any(a <= k <= b for a, b in self.shadows.get(name, ()))

    # -- requires and dynamic imports -----------------------------------------------------------------------------

    def require_at(self, k: int) -> tuple[str, int] | None:
        """The source of `require("x")` at k, in parentheses or with members after it, and the index past it."""
        if self.p(k, "("):
            inner = self.require_at(k + 1)
            return (inner[0], self.members(self.close[k] + 1)) if inner and inner[1] == self.close[k] else None
        if self.word(k, "require") and not self.member(k) and self.p(k + 1, "(") and self.string(k + 2) and (self.close[k + 1] == k + 3 or self.p(k + 3, ",")):
            if not self.shadowed("require", k) and "require" not in self.top_names:
                return self.t[k + 2].text, self.members(self.close[k + 1] + 1)
        return None

    def members(self, k: int) -> int:
        while True:
            if self.p(k, ".") and self.word(k + 1):
                k += 2
            elif self.p(k, "[") and not self.t[k].fresh:
                k = self.close[k] + 1
            else:
                return k

    def ends(self, k: int) -> bool:
        """Whether an expression that stops before k is at its end."""
        return k >= self.n or (self.t[k].kind == "p" and self.t[k].text in (",", ";", ")", "]", "}")) or (self.t[k].fresh and not (self.t[k].kind == "p" and self.t[k].text in (".", "?.", "(", "[", "`", "+", "-", "*", "/", "=", "&&", "||", "??", "?")))

    def requires(self) -> None:
        for k in range(self.n):
            if k in self.skip:
                continue
            if self.p(k, "="):
                found = self.require_at(k + 1)
                if found and self.ends(found[1]):
                    names = self.declarator(k)
                    self.imports.append((k, found[0], "require", self.required(names, found[0]) if names is not None else []))
            elif self.word(k, "require") or self.p(k, "("):
                starts = k == 0 or self.p(k - 1, ";") or self.p(k - 1, "}") or self.p(k - 1, "{") or (self.t[k].fresh and not (self.t[k - 1].kind == "p" and self.t[k - 1].text not in (")", "]", "}")))
                found = self.require_at(k) if starts and self.object_free(k) else None
                if found and self.ends(found[1]):
                    self.imports.append((k, found[0], "require", []))

    def object_free(self, k: int) -> bool:
        return self.outer[k] < 0 or self.p(self.outer[k], "{")

    def declarator(self, k: int) -> int | None:
        """The start of the pattern that the `=` at k initialises in a declaration; None for an assignment."""
        j = k - 1
        if j in self.bindings or j in self.open:
            start = self.open.get(j, j)
            before = start - 1
            while self.p(before, ","):  # further declarators
                before -= 1
                while before >= 0 and not self.p(before, ",") and not self.word(before, *_DECLARES):
                    before = self.open.get(before, before) - 1
            if self.word(before, *_DECLARES):
                return start
        while j > 0 and not self.p(j, ":") and not self.p(j, ";"):
            j = self.open.get(j, j) - 1
        if self.p(j, ":") and (j - 1 in self.bindings or j - 1 in self.open) and self.word(self.open.get(j - 1, j - 1) - 1, *_DECLARES):
            return self.open.get(j - 1, j - 1)
        return None

    def required(self, k: int, source: str) -> list:
        """The specifiers of a pattern that takes what is required."""
        if self.word(k):
            found = [("Unknown", None, self.t[k].text)]
            self.wrapper_bindings(source, found)
            return found
        unknown = [("Unknown", None, None)]
        if not self.p(k, "{"):
            return unknown
        end, out = self.close[k], []
        k += 1
        while k < end:
            if not (self.word(k) or self.string(k)):
                return unknown
            imported = local = self.t[k].text
            k += 1
            if self.p(k, ":"):
                if not self.word(k + 1):
                    return unknown
                local = self.t[k + 1].text
                k += 2
            out.append(("Named", imported, local))
            while k < end and not self.p(k, ","):
                k = self.close.get(k, k) + 1
            k += 1
        self.wrapper_bindings(source, out)
        return out

    def wrapper_bindings(self, source: str, found: list) -> None:
        for module, name in _WRAPPERS:
            if source != module:
                continue
            for kind, imported, local in found:
                if local and (imported == name or (kind == "Unknown" and name == "default")):
                    self.wrappers.add(local)
                elif local and kind in ("Default", "Namespace", "Unknown"):
                    self.namespaces.add(local)

    def wrapper_call(self, k: int) -> int | None:
        """The index of the parentheses of a wrapper call whose name starts at k."""
        if not self.word(k) or self.member(k) or k in self.skip or k in self.bindings or self.shadowed(self.t[k].text, k):
            return None
        name = self.t[k].text
        if name in self.wrappers:
            after = k + 1
        elif name in self.namespaces and self.p(k + 1, ".") and self.word(k + 2, "lazy", "default"):
            after = k + 3
        else:
            return None
        if self.p(after, "<"):  # type arguments
            while after < self.n and not self.p(after, "("):
                after += 1
        return after if self.p(after, "(") else None

    def import_call(self, k: int) -> tuple[str, list, int] | None:
        """`import("x")` and a `.then(pick)` after it: source, specifiers, index past it."""
        if self.p(k, "("):
            inner = self.import_call(k + 1)
            return (inner[0], inner[1], self.close[k] + 1) if inner and inner[2] == self.close[k] else None
        if self.word(k, "await"):
            return self.import_call(k + 1)
        if not (self.word(k, "import") and self.p(k + 1, "(") and self.string(k + 2)):
            return None
        source, end, found = self.t[k + 2].text, self.close[k + 1] + 1, [("Default", "default", None)]
        while self.p(end, ".") and self.word(end + 1, "then", "catch", "finally") and self.p(end + 2, "("):
            if self.word(end + 1, "then"):
                found = self.picked(end + 3)
            end = self.close[end + 2] + 1
        return source, found, end

    def picked(self, k: int) -> list:
        """What a `.then` callback at k takes of a module, as specifiers."""
        unknown = [("Unknown", None, None)]
        taken: dict[str, str] = {}
        name = None
        if self.word(k) and self.p(k + 1, "=>"):
            name, k = self.t[k].text, k + 2
        elif self.p(k, "(") and self.p(self.close[k] + 1, "=>"):
            if self.word(k + 1):
                name = self.t[k + 1].text
            elif self.p(k + 1, "{"):
                j, end = k + 2, self.close[k + 1]
                while j < end:
                    if not self.word(j):
                        return unknown
                    if self.p(j + 1, ":"):
                        taken[self.t[j + 2].text] = self.t[j].text
                        j += 3
                    else:
                        taken[self.t[j].text] = self.t[j].text
                        j += 1
                    j += self.p(j, ",")
            k = self.close[k] + 2
        elif self.word(k, "function"):
            opened = self.next_paren(k + 1)
            if opened is None or not self.word(opened + 1):
                return unknown
            name, k = self.t[opened + 1].text, self.close[opened] + 1
        else:
            return unknown
        if self.p(k, "{"):
            k += 1
            while self.word(k, *_DECLARES) and self.word(k + 1) and self.p(k + 2, "=") and self.word(k + 3, name or "") and self.p(k + 4, ".") and self.word(k + 5):
                taken[self.t[k + 1].text] = self.t[k + 5].text
                k += 6 + self.p(k + 6, ";")
            if not self.word(k, "return"):
                return unknown
            k += 1
        while self.p(k, "("):
            k += 1
        if self.p(k, "{") and (self.word(k + 1, "default") or (self.string(k + 1) and self.t[k + 1].text == "default")) and self.p(k + 2, ":"):
            k += 3
        if self.word(k) and self.t[k].text == name:
            if self.p(k + 1, ".") and self.word(k + 2):
                field = self.t[k + 2].text
            elif self.p(k + 1, "[") and self.string(k + 2):
                field = self.t[k + 2].text
            elif self.p(k + 1, ".") is False and not self.p(k + 1, "["):
                field = "default"
            else:
                return unknown
        elif self.word(k) and self.t[k].text in taken:
            field = taken[self.t[k].text]
        else:
            return unknown
        return [("Default" if field == "default" else "Named", field, None)]

    def loader(self, k: int) -> tuple[str, list, int] | None:
        """A function at k that does nothing but import: source, specifiers, index past it."""
        if self.p(k, "(") and self.close[k] > k + 1 and not self.p(self.close[k] + 1, "=>"):
            inner = self.loader(k + 1)
            return (inner[0], inner[1], self.close[k] + 1) if inner and inner[2] == self.close[k] else None
        k += self.word(k, "async")
        if self.p(k, "(") and self.p(self.close[k] + 1, "=>"):
            k = self.close[k] + 2
        elif self.word(k, "function"):
            opened = self.next_paren(k + 1)
            if opened is None:
                return None
            k = self.close[opened] + 1
        else:
            return None
        if self.p(k, "{"):
            if not self.word(k + 1, "return"):
                return None
            found = self.import_call(k + 2)
            if not found or found[2] + self.p(found[2], ";") != self.close[k]:
                return None
            return found[0], found[1], self.close[k] + 1
        return self.import_call(k)

    def dynamic(self) -> None:
        def keep(binding: int, found: tuple[str, list]) -> None:
            self.loaders[binding] = found
            self.named.setdefault(self.t[binding].text, []).append(binding)

        spans: dict[int, tuple[int, int]] = {}
        for k in range(self.n):  # loaders by name come first: they may be used before
            if self.p(k, "=") and k - 1 in self.bindings and (self.word(k - 2, *_DECLARES) or self.p(k - 2, ",")):
                if found := self.loader(k + 1):
                    keep(k - 1, found[:2])
                    spans[k - 1] = (k + 1, found[2])
                elif self.word(k + 1) and self.ends(k + 2):
                    if (other := self.loader_of(k + 1)) is not None:
                        keep(k - 1, self.loaders[other])
                        self.no_edge.add(k + 1)
                        spans[k - 1] = spans[other]
                    elif self.t[k + 1].text in self.wrappers:
                        self.wrappers.add(self.t[k - 1].text)
                elif self.word(k + 1) and self.t[k + 1].text in self.namespaces and self.p(k + 2, ".") and self.word(k + 3, "lazy", "default"):
                    self.wrappers.add(self.t[k - 1].text)
            elif self.word(k, "function") and self.word(k + 1) and self.p(k + 2, "(") and not self.p(k - 1, "(") and not self.p(k - 1, "=") and not self.p(k - 1, ","):
                if found := self.loader(k):
                    keep(k + 1, found[:2])
                    spans[k + 1] = (k, found[2])
        uses = [k for k in range(self.n) if self.word(k) and k not in self.no_edge and k not in self.bindings and not self.member(k) and k not in self.skip and self.loader_of(k) is not None]
        known = set(uses)
        for span in spans.values():  # what a loader imports counts where it is used
            self.no_edge.update(range(*span))
        for k in range(self.n):
            opened = self.wrapper_call(k)
            if opened is not None:
                if found := self.loader(opened + 1):
                    self.imports.append((k, found[0], "dynamic", found[1]))
                    self.no_edge.update(range(opened + 1, found[2]))
                elif self.word(opened + 1) and (binding := self.loader_of(opened + 1)) is not None:
                    source, found = self.loaders[binding]
                    self.imports.append((k, source, "dynamic", found))
                    self.no_edge.add(opened + 1)
            elif self.word(k, "import") and self.p(k + 1, "(") and self.string(k + 2) and k not in self.no_edge:
                self.imports.append((k, self.t[k + 2].text, "dynamic", []))
            elif k in known and k not in self.no_edge:
                argument = self.outer[k] >= 0 and self.p(self.outer[k], "(") and (self.p(k - 1, "(") or self.p(k - 1, ",")) and (self.p(k + 1, ")") or self.p(k + 1, ","))
                if self.p(k + 1, "(") or argument:
                    self.imports.append((k, self.loaders[self.loader_of(k)][0], "dynamic", []))

    def loader_of(self, k: int) -> int | None:
        """The binding of the loader that the name at k stands for: of the bindings of that name whose scope holds k, the innermost
        one, if it is a loader."""
        name = self.t[k].text
        found = self.named.get(name)
        if not found:
            return None
        inner = [(b - a, a) for a, b in self.shadows.get(name, ()) if a <= k <= b]
        if inner:
            binding = min(inner)[1]
            return binding if binding in self.loaders else None
        scoped = {a for a, _ in self.shadows.get(name, ())}
        return next((a for a in reversed(found) if a not in scoped), None)

    # -- exports by assignment ------------------------------------------------------------------------------------

    def assigned_exports(self) -> list[tuple[int, str, str]]:
        out = []
        for k in range(self.n):
            if self.member(k):
                continue
            after = k + 1 if self.word(k, "exports") else k + 3 if self.word(k, "module") and self.p(k + 1, ".") and self.word(k + 2, "exports") else 0
            if not after:
                continue
            if self.p(after, ".") and self.word(after + 1) and self.p(after + 2, "="):
                out.append((k, self.t[after + 1].text, "Named"))
            elif self.p(after, "[") and self.string(after + 1) and self.close[after] == after + 2 and self.p(after + 3, "="):
                out.append((k, self.t[after + 1].text, "Named"))
            elif self.p(after, "=") and self.word(k, "module"):
                out.append((k, "default", "Default"))
                j = after + 1
                while self.p(j, "("):
                    j += 1
                if self.p(j, "{"):
                    out += [(k, name, "Named") for name in self.keys(j)]
        return out

    def keys(self, k: int) -> list[str]:
        """The plain keys of the object literal at k."""
        end, out = self.close[k], []
        k += 1
        while k < end:
            accessor = self.word(k, "get", "set") and (self.word(k + 1) or self.string(k + 1)) and self.p(k + 2, "(")
            while (self.word(k, "async") or self.p(k, "*")) and (self.word(k + 1) or self.string(k + 1) or self.p(k + 1, "*")):
                k += 1
            if (self.word(k) or self.string(k)) and not accessor and self.t[k].text not in out:
                out.append(self.t[k].text)
            while k < end and not self.p(k, ","):
                k = self.close.get(k, k) + 1
            k += 1
        return out

    # -- references -----------------------------------------------------------------------------------------------

    def used(self, watched: set[str]) -> set[str]:
        out: set[str] = set()
        for k, t in enumerate(self.t):
            if t.kind == "tag":
                root = t.text.split(".")[0]
                if root in watched and (root != t.text or not root[:1].islower()) and not self.shadowed(root, k):
                    out.add(root)
                continue
            if t.kind != "id" or t.text not in watched or k in self.skip or k in self.bindings or self.member(k) or self.shadowed(t.text, k):
                continue
            o = self.outer[k]
            if o >= 0 and self.p(o, "{"):
                starts = self.p(k - 1, "{") or self.p(k - 1, ",") or self.p(k - 1, ";") or (self.p(k - 1, "}") and self.t[k].fresh)
                if starts and self.p(k + 1, ":"):
                    continue  # a key
                if (starts or self.t[k - 1].text in _MODIFIERS) and self.p(k + 1, "(") and self.method_here(k + 1):
                    continue  # a method's name
            out.add(t.text)
        return out

    # -- all ------------------------------------------------------------------------------------------------------

    def result(self) -> dict:
        barrel, reexports, k = True, 0, 0
        while k < self.n and self.string(k) and (k + 1 >= self.n or self.p(k + 1, ";") or self.t[k + 1].fresh):  # directives
            k += 1 + self.p(k + 1, ";")
        while k < self.n:
            if self.word(k, "import") and not self.member(k) and not self.p(k + 1, "(") and not self.p(k + 1, "."):
                k, barrel = self.import_declaration(k), False
            elif self.word(k, "export") and not self.member(k):
                k, again = self.export_declaration(k)
                barrel, reexports = barrel and again, reexports + again
                k += barrel and self.p(k, ";")
            else:
                barrel = False
                k = self.close.get(k, k) + 1
        self.scopes()
        self.top_names = {self.t[b].text for b in self.bindings if self.scope_end(b) < 0 and self.outer[b] < 0}
        self.requires()
        self.dynamic()
        exports = list(self.exports)
        for _, name, kind in self.assigned_exports():
            if (name, kind) not in exports:
                exports.append((name, kind))
        self.imports.sort(key=lambda r: r[0])
        watched = {local for _, _, kind, found in self.imports if kind not in REEXPORTS for _, _, local in found if local}
        used = self.used(watched)
        unused = [
            {"source": source, "local": local, "imported": imported}
            for _, source, kind, found in self.imports if kind not in REEXPORTS
            for s, imported, local in found if local and imported and s != "Unknown" and local not in used
        ]
        return {
            "imports": [{"source": source, "kind": kind, "specifiers": [{"kind": s, "imported": i, "local": x} for s, i, x in found]} for _, source, kind, found in self.imports],
            "exports": [{"name": name, "kind": kind} for name, kind in exports], "unused": unused, "barrel": barrel and reexports > 0,
        }
