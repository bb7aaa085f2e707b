"""Rust symbols from a token stream: comments, strings, lifetimes and raw strings are told apart, braces give scopes."""

from __future__ import annotations

import re

from srcgraph.extract import extractor

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hash>\#*)")|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.)|[^'\\])')|(?P<life>'\w+)|(?P<word>(?:r\#)?[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<sign>::|->|=>|&&|\|\||==|.)""",
    re.S | re.X,
)
#: Words that end neither a callee nor start one.
KEYWORDS = frozenset("if while for match loop return in let mut ref move unsafe else as fn impl struct enum trait use mod pub where dyn await async const static type break continue crate".split())


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, line); block comments nest."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, end = m.lastgroup if m.lastgroup != "hash" else "raw", m.end()
        if m["block"]:
            depth = 1
            while depth and end < len(text):
                if text.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif text.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
        elif m["raw"]:
            close = text.find('"' + m["hash"], end)
            end = len(text) if close < 0 else close + 1 + len(m["hash"])
            kind = "str"
        if kind not in ("skip", "block"):
            out.append((kind, text[at:end], at, line))
        line += text.count("\n", at, end)
        at = end
    return out


class Reader:
    def __init__(self, text: str):
        self.text, self.t = text, tokens(text)
        self.functions, self.classes, self.variables, self.imports, self.calls, self.impls = [], [], [], [], [], []

    def word(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i][1] in texts

    def closing(self, i: int) -> int:
        """The place of the bracket that closes the one at i."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
        for j in range(i, len(self.t)):
            if self.t[j][0] == "sign":
                depth += self.t[j][1] in pairs
                depth -= self.t[j][1] in pairs.values()
                if not depth:
                    return j
        return len(self.t) - 1

    def past_generics(self, i: int) -> int:
        if not self.word(i, "<"):
            return i
        depth = 0
        for j in range(i, len(self.t)):
            depth += (self.t[j][1] == "<") - (self.t[j][1] == ">")
            if not depth:
                return j + 1
        return i

    def span(self, i: int, j: int) -> str:
        return self.text[self.t[i][2] : self.t[j - 1][2] + len(self.t[j - 1][1])] if j > i else ""

    def parts(self, i: int, j: int) -> list[str]:
        """Texts between commas of the bracket from i to j."""
        out, depth, first = [], 0, i + 1
        for k in range(i + 1, j + 1):
            x = self.t[k][1]
            depth += x in "([{<" and self.t[k][0] == "sign"
            depth -= x in ")]}>" and self.t[k][0] == "sign" and k < j
            if k == j or x == "," and not depth:
                if k > first:
                    out.append(re.sub(r"\s+", " ", self.span(first, k)))
                first = k + 1
        return out

    def line_of_end(self, j: int) -> int:
        return self.t[j][3] + self.t[j][1].count("\n")

    def until(self, i: int, *texts: str) -> int:
        while i < len(self.t) and self.t[i][1] not in texts:
            i = self.closing(i) + 1 if self.t[i][1] in ("(", "[") else i + 1
        return i

    def complexity(self, i: int, j: int) -> int:
        n = 1 + sum(self.t[k][0] == "word" and self.t[k][1] in ("if", "for", "while", "match") for k in range(i, j))
        return n + sum(self.t[k][1] == "=>" for k in range(i, j))

    def read(self) -> dict:
        scopes: list[tuple[int, str, str, int]] = []  # closing place, name, kind, line
        i = 0
        while i < len(self.t):
            while scopes and i > scopes[-1][0]:
                scopes.pop()
            kind, x, start, line = self.t[i]
            context = scopes[-1] if scopes else (0, None, None, None)
            cls = next((s[1] for s in reversed(scopes) if s[2] in ("impl_item", "trait_item")), None)
            if kind != "word":
                i += 1
            elif x == "fn" and i + 1 < len(self.t) and self.t[i + 1][0] == "word":
                name, at = self.t[i + 1][1], self.past_generics(i + 2)
                close = self.closing(at)
                body = self.until(close + 1, "{", ";")
                if self.word(body, "{"):
                    end = self.closing(body)
                    is_async = any(self.word(k, "async") for k in range(max(0, i - 3), i))
                    self.functions.append({"name": name, "line_number": self.t[i + 1][3], "end_line": self.line_of_end(end), "args": self.parts(at, close), "cyclomatic_complexity": self.complexity(body, end), "context": context[1], "context_type": context[2], "class_context": cls, "decorators": [], "is_async": is_async, "source": self.span(i, end + 1), "docstring": None})
                    scopes.append((end, name, "function_item", self.t[i + 1][3]))
                i = body + 1
            elif x in ("struct", "enum", "trait") and i + 1 < len(self.t) and self.t[i + 1][0] == "word":
                body = self.until(i + 2, "{", ";")
                end = self.closing(body) if self.word(body, "{") else min(body, len(self.t) - 1)
                self.classes.append({"name": self.t[i + 1][1], "line_number": self.t[i + 1][3], "end_line": self.line_of_end(end), "bases": [], "context": context[1], "decorators": [], "kind": x, "source": self.span(i, end + 1), "docstring": None})
                if x == "trait" and self.word(body, "{"):
                    scopes.append((end, self.t[i + 1][1], "trait_item", line))
                i = body + 1
            elif x == "impl":
                at = self.past_generics(i + 1)
                body = self.until(at, "{", ";")
                where = next((k for k in range(at, body) if self.word(k, "where")), body)
                cut = next((k for k in range(at, where) if self.word(k, "for")), None)
                bare = lambda a, b: re.sub(r"<.*", "", self.span(a, b), flags=re.S).strip().lstrip("&!").split("::")[-1].strip()
                name = bare(cut + 1, where) if cut is not None else bare(at, where)
                if cut is not None:
                    self.impls.append({"type_name": name, "trait_name": bare(at, cut), "line_number": line})
                if self.word(body, "{"):
                    scopes.append((self.closing(body), name, "impl_item", line))
                i = body + 1
            elif x == "use":
                end = self.until(i, ";")
                path = re.sub(r"\s+", " ", self.span(i + 1, end))
                alias = re.search(r" as (\w+)$", path)
                last = re.sub(r" as \w+$", "", path)
                name = last[last.index("{") :] if "{" in last else last.split("::")[-1].strip()
                self.imports.append({"name": name, "full_import_name": self.span(i, min(end + 1, len(self.t))), "line_number": line, "alias": alias[1] if alias else None})
                i = end + 1
            elif x == "let":
                k = i + 1 + self.word(i + 1, "mut")
                if k + 1 < len(self.t) and self.t[k][0] == "word" and self.word(k + 1, "=", ":"):
                    eq = self.until(k + 1, "=", ";")
                    end = eq
                    while end < len(self.t) and self.t[end][1] != ";":
                        end = self.closing(end) + 1 if self.t[end][1] in "([{" else end + 1
                    self.variables.append({"name": self.t[k][1], "line_number": line, "value": self.span(eq + 1, end) if self.word(eq, "=") else None, "type": self.span(k + 2, eq) if self.word(k + 1, ":") else None, "context": context[1], "class_context": cls})
                i = k + 1
            elif x not in KEYWORDS and (self.word(i + 1, "(") or self.word(i + 1, "!") and self.word(i + 2, "(", "[", "{") or self.word(i + 1, "::") and self.word(i + 2, "<")):
                macro = self.word(i + 1, "!")
                at = i + 1 if self.word(i + 1, "(") else i + 2 if macro else self.past_generics(i + 2)
                if macro or self.word(at, "("):
                    first = i
                    while first >= 2 and self.word(first - 1, ".", "::") and (self.t[first - 2][0] == "word" or self.t[first - 2][1] in ")]>"):
                        first -= 2
                        if self.t[first][1] in ")]>":
                            depth = 0
                            while first > 0:
                                depth += (self.t[first][1] in ")]>") - (self.t[first][1] in "([<")
                                if not depth:
                                    break
                                first -= 1
                            first -= self.t[first - 1][0] == "word"
                    close = self.closing(at)
                    full = self.span(i, close + 1) if macro else re.sub(r"\s+", "", self.span(first, i + 1))
                    name = x + "!" if macro else x
                    self.calls.append({"name": name, "full_name": full, "line_number": line, "args": [] if macro else self.parts(at, close), "inferred_obj_type": None, "context": {"name": context[1], "kind": context[2], "line": context[3]}, "class_context": cls, "is_indirect_call": False})
                i += 1
            else:
                i += 1
        return {"functions": self.functions, "classes": self.classes, "variables": self.variables, "imports": self.imports, "function_calls": self.calls, "impls": self.impls}


@extractor("rust")
def rust(text: str) -> dict:
    return Reader(text).read()
