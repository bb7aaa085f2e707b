"""Text to clauses. Clauses and expressions are tuples that start with their kind."""

from __future__ import annotations

import re

TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<sign><>|<=|>=|\.\.|->|<-|[-()\[\]{}:,.|*+/%=<>!])""")
#: Words of clauses that would change a graph.
WRITES = ("CREATE", "MERGE", "DELETE", "SET", "REMOVE", "DROP", "APOC", "DETACH", "FOREACH", "LOAD")


class QueryError(ValueError):
    """What the language does not allow."""


def guard(query: str) -> None:
    """Refuses a query with a writing word outside its strings."""
    bare = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", "''", query)
    if m := re.search(r"\b(" + "|".join(WRITES) + r")\b", bare, re.I):
        raise QueryError(f"only reading is allowed, not {m[1].upper()}")


def tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query):
        m = TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unexpected {query[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0].strip("`") if m.lastgroup == "name" else m[0]))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, query: str, params: dict | None = None):
        guard(query)
        self.t, self.i, self.params = tokens(query), 0, params or {}

    def peek(self, *words: str, ahead: int = 0) -> bool:
        kind, x = self.t[min(self.i + ahead, len(self.t) - 1)]
        return kind in ("name", "sign") and (x.upper() if kind == "name" else x) in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, word: str) -> str:
        found = self.take(word)
        if found is None:
            raise QueryError(f"expected {word}, not {self.t[self.i][1]!r}")
        return found

    def name(self) -> str:
        kind, x = self.t[self.i]
        if kind != "name":
            raise QueryError(f"expected a name, not {x!r}")
        self.i += 1
        return x

    def number(self) -> int | None:
        if self.t[self.i][0] != "num":
            return None
        self.i += 1
        return int(self.t[self.i - 1][1])

    def query(self) -> list[tuple]:
        out = []
        while self.t[self.i][0] != "end":
            if self.take("OPTIONAL"):
                self.need("MATCH")
                out.append(("match", True, *self.match()))
            elif self.take("MATCH"):
                out.append(("match", False, *self.match()))
            elif self.take("WITH"):
                out.append(("project", *self.projection(), self.expression() if self.take("WHERE") else None))
            elif self.take("CALL"):
                out.append(("procedure", *self.procedure()))
            elif self.take("RETURN"):
                out.append(("project", *self.projection(), None))
            else:
                raise QueryError(f"unsupported clause at {self.t[self.i][1]!r}")
        return out

    def procedure(self) -> tuple:
        """(dotted name, arguments, {yielded: variable} or None for all, condition)."""
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        args, found = [], None
        self.need("(")
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        if self.take("YIELD"):
            found = {}
            while True:
                own = self.name()
                found[own] = self.name() if self.take("AS") else own
                if not self.take(","):
                    break
        return name, args, found, self.expression() if self.take("WHERE") else None

    def match(self) -> tuple:
        patterns = [self.path()]
        while self.take(","):
            patterns.append(self.path())
        return patterns, self.expression() if self.take("WHERE") else None

    def path(self) -> tuple:
        """(variable, nodes, relationships)."""
        var = None
        if self.t[self.i][0] == "name" and self.t[self.i + 1][1] == "=":
            var = self.name()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.peek("-", "<-"):
            rels.append(self.relationship())
            nodes.append(self.node())
        return var, nodes, rels

    def labels(self) -> list[str]:
        out = []
        while self.take(":", "|") if not out else self.take("|"):
            self.take(":")
            out.append(self.name())
        return out

    def properties(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out[key] = self.expression()
                self.take(",")
        return out

    def node(self) -> tuple:
        self.need("(")
        var = self.name() if self.t[self.i][0] == "name" else None
        found = (var, self.labels(), self.properties())
        self.need(")")
        return found

    def relationship(self) -> tuple:
        """(variable, types, properties, direction, least and most hops or None)."""
        back = self.take("<-") is not None
        if not back:
            self.need("-")
        var, types, props, hops = None, [], {}, None
        if self.take("["):
            var = self.name() if self.t[self.i][0] == "name" else None
            types = self.labels()
            if self.take("*"):
                low = self.number()
                hops = (1 if low is None else low, self.number()) if self.take("..") else (1, None) if low is None else (low, low)
            props = self.properties()
            self.need("]")
        forth = self.take("->") is not None
        if not forth:
            self.need("-")
        return var, types, props, "in" if back else "out" if forth else "both", hops

    def projection(self) -> tuple:
        """(distinct, [(expression, name)], order, limit)."""
        distinct, items, order, limit = self.take("DISTINCT") is not None, [], [], None
        while True:
            start = self.i
            e = ("star",) if self.take("*") else self.expression()
            items.append((e, self.name() if self.take("AS") else "".join(x for _, x in self.t[start : self.i])))
            if not self.take(","):
                break
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expression()
                order.append((e, bool(self.take("DESC", "DESCENDING"))))
                self.take("ASC", "ASCENDING")
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            limit = self.expression()
        return distinct, items, order, limit

    def expression(self) -> tuple:
        left = self.xand()
        while self.take("OR"):
            left = ("or", left, self.xand())
        return left

    def xand(self) -> tuple:
        left = self.xnot()
        while self.take("AND"):
            left = ("and", left, self.xnot())
        return left

    def xnot(self) -> tuple:
        return ("not", self.xnot()) if self.take("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            if op := self.take("=", "<>", "<", ">", "<=", ">="):
                left = (op, left, self.sum())
            elif self.take("IN"):
                left = ("in", left, self.sum())
            elif self.take("CONTAINS"):
                left = ("contains", left, self.sum())
            elif self.peek("STARTS", "ENDS") and self.peek("WITH", ahead=1):
                op = self.name().lower()
                self.need("WITH")
                left = (op, left, self.sum())
            elif self.take("IS"):
                left = ("isnotnull", left) if self.take("NOT") and self.need("NULL") else ("isnull", left) if self.take("NULL") else left
            elif left[0] == "name" and self.peek(":"):
                left = ("haslabel", left[1], self.labels())
            else:
                return left

    def sum(self) -> tuple:
        left = self.product()
        while op := self.take("+", "-"):
            left = (op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.postfix()
        while op := self.take("*", "/", "%"):
            left = (op, left, self.postfix())
        return left

    def postfix(self) -> tuple:
        left = self.atom()
        while True:
            if self.take("."):
                left = ("property", left, self.name())
            elif self.take("["):
                left = ("index", left, self.expression())
                self.need("]")
            else:
                return left

    def is_pattern(self) -> bool:
        """Whether the bracket here opens a node that a relationship follows."""
        depth = 0
        for j in range(self.i, len(self.t)):
            depth += (self.t[j][1] == "(") - (self.t[j][1] == ")")
            if not depth:
                nxt = self.t[j + 1][1], self.t[min(j + 2, len(self.t) - 1)][1]
                return nxt[0] == "<-" or nxt[0] == "-" and nxt[1] in ("[", "-", "->")
        return False

    def atom(self) -> tuple:
        kind, x = self.t[self.i]
        if self.peek("(") and self.is_pattern():
            return ("exists", self.path())
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expression())
                self.take(",")
            return ("list", items)
        if self.peek("{"):
            return ("map", self.properties())
        if self.take("-"):
            return ("-", ("value", 0), self.atom())
        self.i += 1
        if kind == "str":
            return ("value", re.sub(r"\\(.)", r"\1", x[1:-1]))
        if kind == "num":
            return ("value", float(x) if "." in x else int(x))
        if kind == "param":
            if x[1:] not in self.params:
                raise QueryError(f"no value for {x}")
            return ("value", self.params[x[1:]])
        if kind != "name":
            raise QueryError(f"unexpected {x!r}")
        word = x.upper()
        if word in ("TRUE", "FALSE", "NULL"):
            return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[word])
        if word == "CASE":
            whens, other = [], ("value", None)
            while self.take("WHEN"):
                c = self.expression()
                self.need("THEN")
                whens.append((c, self.expression()))
            if self.take("ELSE"):
                other = self.expression()
            self.need("END")
            return ("case", whens, other)
        if self.take("("):
            if word in ("ALL", "ANY", "NONE") and self.peek("IN", ahead=1):
                var = self.name()
                self.need("IN")
                items = self.expression()
                self.need("WHERE")
                test = self.expression()
                self.need(")")
                return ("quantifier", word, var, items, test)
            distinct = self.take("DISTINCT") is not None
            args = []
            while not self.take(")"):
                args.append(("star",) if self.take("*") else self.expression())
                self.take(",")
            return ("call", x.lower(), distinct, args)
        return ("name", x)
