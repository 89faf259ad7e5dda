"""A tokenizer for JavaScript, TypeScript and JSX that fails on what it cannot read.

Tokens are (kind, text, start). Kinds: id, str (decoded), num, tmpl, regex, tag (a JSX element's name), p (punctuation). The
expressions of templates and of JSX attributes and children come out in line, between `${` or `{` and `}`.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class SourceError(ValueError):
    """The source has a syntax error."""


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    #: A line break stands before it.
    fresh: bool


_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\u2028\u2029]*|/\*.*?\*/)+", re.S)
_NAME = re.compile(r"#?(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))+")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*\"""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: After these words an operand follows, so `/` starts a regular expression and `<` may start an element.
OPERAND_NEXT = frozenset("return typeof case do else in of instanceof new void delete throw await yield default extends".split())
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if len(e) > 1 and e[0] in "ux":
            return chr(int(e.strip("ux{}"), 16))
        return _SIMPLE.get(e, e)

    return _ESCAPE.sub(one, text)


class _Reader:
    def __init__(self, text: str, jsx: bool, types: bool):
        self.text, self.jsx, self.types, self.at, self.out = text, jsx, types, 0, []
        self.parens: list[bool] = []
        self.control_closed = False

    def fail(self, why: str) -> SourceError:
        return SourceError(f"{why} at {self.at}")

    def add(self, kind: str, text: str, fresh: bool) -> None:
        self.out.append(Token(kind, text, self.at, fresh))

    def operand_next(self) -> bool:
        """Whether an operand, not an operator, can follow the last token."""
        if not self.out:
            return True
        last = self.out[-1]
        if last.kind == "p":
            if last.text == ")":
                return self.control_closed
            return last.text not in ("]", "}", "++", "--") or (last.text == "}" and self.block_closed())
        if last.kind == "id":
            return last.text in OPERAND_NEXT and not (len(self.out) > 1 and self.out[-2].text in (".", "?."))
        return False

    def block_closed(self) -> bool:
        """Whether the `}` just read closes a block: then a line break and a new statement follow."""
        depth = 0
        for k in range(len(self.out) - 1, -1, -1):
            t = self.out[k]
            if t.kind == "p" and t.text == "}":
                depth += 1
            elif t.kind == "p" and t.text in ("{", "${"):
                depth -= 1
                if depth == 0:
                    before = self.out[k - 1] if k else None
                    return before is None or before.text in (")", ";", "{", "}", "else", "do", "try", "finally", "=>") or (before.kind == "id" and before.text not in OPERAND_NEXT)
        return False

    def space(self) -> bool:
        m = _SPACE.match(self.text, self.at)
        if not m:
            return False
        if self.text.startswith("/*", self.at) and "*/" not in self.text[self.at + 2 :]:
            raise self.fail("open comment")
        self.at = m.end()
        return "\n" in m[0]

    def run(self, end: str | None = None) -> None:
        """Reads to the end of the text, or past the bracket end that closes what the caller opened."""
        stack: list[str] = []
        while True:
            fresh = self.space()
            if self.at >= len(self.text):
                if end or stack:
                    raise self.fail("open bracket")
                return
            c = self.text[self.at]
            if self.text.startswith("/*", self.at):
                raise self.fail("open comment")
            if c in "'\"":
                m = _STRING.match(self.text, self.at)
                if not m:
                    raise self.fail("open string")
                self.add("str", unescaped(m[0][1:-1]), fresh)
                self.at = m.end()
            elif c == "`":
                self.template(fresh)
            elif c.isdigit() or (c == "." and self.text[self.at + 1 : self.at + 2].isdigit()):
                m = _NUMBER.match(self.text, self.at)
                self.add("num", m[0], fresh)
                self.at = m.end()
                if _NAME.match(self.text, self.at):
                    raise self.fail("name after number")
            elif m := _NAME.match(self.text, self.at):
                self.add("id", unescaped(m[0]) if "\\" in m[0] else m[0], fresh)
                self.at = m.end()
            elif c == "/" and self.operand_next():
                m = _REGEX.match(self.text, self.at)
                if not m:
                    raise self.fail("open regular expression")
                self.add("regex", m[0], fresh)
                self.at = m.end()
            elif c == "<" and self.jsx and self.operand_next() and self.element_here():
                self.element(fresh)
            else:
                m = _PUNCT.match(self.text, self.at)
                if not m:
                    raise self.fail("unknown character")
                text = m[0]
                if text in ("(", "[", "{"):
                    if text == "(":
                        before = self.out[-1] if self.out else None
                        self.parens.append(bool(before and before.kind == "id" and before.text in ("if", "while", "for", "with") and not (len(self.out) > 1 and self.out[-2].text == ".")))
                    stack.append({"(": ")", "[": "]", "{": "}"}[text])
                elif text in (")", "]", "}"):
                    if stack:
                        if stack.pop() != text:
                            raise self.fail("wrong bracket")
                        if text == ")":
                            self.control_closed = self.parens.pop()
                    elif text == end:
                        self.add("p", text, fresh)
                        self.at = m.end()
                        return
                    else:
                        raise self.fail("bracket too many")
                self.add("p", text, fresh)
                self.at = m.end()

    def template(self, fresh: bool) -> None:
        self.add("tmpl", "`", fresh)
        self.at += 1
        begin = self.at
        while True:
            if self.at >= len(self.text):
                raise self.fail("open template")
            c = self.text[self.at]
            if c == "\\":
                self.at += 2
            elif c == "`":
                if self.out[-1].kind == "tmpl":
                    self.out[-1] = self.out[-1]._replace(text="`" + self.text[begin : self.at])
                self.at += 1
                # what follows a template follows an operand
                self.out.append(Token("tmpl", "end", self.at, False))
                return
            elif self.text.startswith("${", self.at):
                self.add("p", "${", False)
                self.at += 2
                self.run("}")
            else:
                self.at += 1

    def element_here(self) -> bool:
        m = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*|>)").match(self.text, self.at)
        if not m:
            return False
        if self.types and m[1] != ">":  # <T,>(x) => and <T extends U>(x) => are type parameters
            rest = self.text[m.end() :].lstrip()
            return not (rest.startswith(",") or re.match(r"extends\b", rest) or rest.startswith("="))
        return True

    def element(self, fresh: bool) -> None:
        self.at += 1
        self.space()
        m = _JSX_NAME.match(self.text, self.at)
        name = m[0] if m else ""
        if m:
            self.add("tag", name, fresh)
            self.at = m.end()
        if not self.attributes():
            self.children(name)
        self.out.append(Token("tag", "", self.at, False))

    def attributes(self) -> bool:
        """Reads up to the end of an opening tag; whether it closes itself."""
        while True:
            self.space()
            rest = self.text[self.at : self.at + 2]
            if rest == "/>":
                self.at += 2
                return True
            if rest[:1] == ">":
                self.at += 1
                return False
            if rest[:1] == "{":
                self.expression()
            elif rest[:1] in ("'", '"'):
                close = self.text.find(rest[0], self.at + 1)
                if close < 0:
                    raise self.fail("open attribute")
                self.at = close + 1
            elif rest[:1] == "=":
                self.at += 1
            elif rest[:1] == "<":
                if self.out and self.out[-1].kind == "tag" and not self.jsx:
                    raise self.fail("element")
                depth = 0  # type arguments, or an element as a value
                m = re.compile(r"<[^<>]*>").match(self.text, self.at)
                if m and not self.text[self.at - 1] == "=":
                    self.at = m.end()
                else:
                    self.element(False)
                del depth
            elif m := _JSX_NAME.match(self.text, self.at):
                self.at = m.end()
            else:
                raise self.fail("bad attribute")

    def expression(self) -> None:
        self.add("p", "{", False)
        self.at += 1
        self.run("}")

    def children(self, name: str) -> None:
        while True:
            k = self.at
            while k < len(self.text) and self.text[k] not in "<{":
                if self.text[k] in ">}":
                    self.at = k
                    raise self.fail("bad text in element")
                k += 1
            self.at = k
            if k >= len(self.text):
                raise self.fail("open element")
            if self.text[k] == "{":
                self.expression()
                continue
            m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(self.text, k)
            if m:
                if (m[1] or "") != name:
                    raise self.fail("element closed by another name")
                self.at = m.end()
                return
            self.element(False)


def tokens(text: str, jsx: bool = True, types: bool = True) -> list[Token]:
    reader = _Reader(text, jsx, types)
    if text.startswith("#!"):
        reader.at = text.find("\n") if "\n" in text else len(text)
    reader.run()
    return reader.out
