"""Clauses to a DataFrame: patterns are joins of node and edge tables, results are projections and aggregates."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph.graph import EDGE_COLUMNS, PropertyGraph
from srcgraph.operators import search
from srcgraph.operators.traverse import cut, drop
from srcgraph.pattern.parser import Parser, QueryError

AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
FUNCTIONS = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": F.size, "coalesce": F.coalesce, "abs": F.abs, "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "split": lambda a, b: F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E"))), "replace": F.replace, "substring": lambda s, i, n: F.substring(s, i + 1, n), "exists": lambda c: c.isNotNull()}
COMPARE = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__", "-": "__sub__", "*": "__mul__", "/": "__truediv__", "%": "__mod__"}

#: How many ways a row stands for, where ways are counted and not listed.
TIMES = "_times"


def has_aggregate(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
        return True
    return isinstance(e, (tuple, list)) and any(has_aggregate(x) for x in e)


class Plan:
    """frame: a column for each variable; kinds: what it is, of node, rel, rels, steps, path and value.

    props: what is read of each variable (needed()); None for everything. ties: conditions of the pattern that is being bound.
    counting: whether ways are only counted, by length. Then a row stands for as many ways as TIMES says.
    """

    def __init__(self, g: PropertyGraph, props: dict | None = None):
        self.g, self.frame, self.kinds, self.fresh = g, None, {}, 0
        self.props, self.ties, self.counting, self.after = props, [], False, {}

    def name(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # expressions

    def column(self, e, local: dict | None = None) -> Column:
        kind, local = e[0], local or {}
        rec = lambda x: self.column(x, local)
        if kind == "value":
            return F.array(*map(F.lit, e[1])) if isinstance(e[1], (list, tuple)) else F.lit(e[1])
        if kind == "name":
            if e[1] not in local and e[1] not in self.kinds:
                raise QueryError(f"unknown variable {e[1]}")
            return local.get(e[1], F.col(e[1]))
        if kind == "property":
            own = rec(e[1])
            if e[1][0] == "name" and self.kinds.get(e[1][1]) in ("node", "rel"):
                fields = self.frame.schema[e[1][1]].dataType.names
                return own[e[2]] if e[2] in fields else F.lit(None).cast("string")
            return own[e[2]]
        if kind == "index":
            return F.get(rec(e[1]), rec(e[2]).cast("int"))
        if kind in ("and", "or"):
            a, b = rec(e[1]), rec(e[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~rec(e[1])
        if kind == "+":
            a, b = rec(e[1]), rec(e[2])
            text = any(x[0] == "value" and isinstance(x[1], str) or x[0] == "+" for x in e[1:]) or any(x[0] == "property" and x[2] in ("name", "path", "source", "docstring", "context") for x in e[1:])
            return F.concat(a, b) if text else a + b
        if kind in COMPARE:
            a, b = rec(e[1]), rec(e[2])
            if all(x[0] == "name" and self.kinds.get(x[1]) in ("node",) for x in e[1:]):
                a, b = a["id"], b["id"]
            return getattr(a, COMPARE[kind])(b)
        if kind == "in":
            return F.array_contains(rec(e[2]), rec(e[1]))
        if kind in ("contains", "starts", "ends"):
            return {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[kind](rec(e[1]), rec(e[2]))
        if kind in ("isnull", "isnotnull"):
            return rec(e[1]).isNull() if kind == "isnull" else rec(e[1]).isNotNull()
        if kind == "haslabel":
            return F.col(e[1])["label"].isin(*e[2])
        if kind == "list":
            return F.array(*map(rec, e[1]))
        if kind == "map":
            return F.struct(*[rec(v).alias(k) for k, v in e[1].items()])
        if kind == "case":
            out = reduce(lambda c, w: c.when(rec(w[0]), rec(w[1])), e[1][1:], F.when(rec(e[1][0][0]), rec(e[1][0][1])))
            return out.otherwise(rec(e[2]))
        if kind == "quantifier":
            test = lambda x: self.column(e[4], local | {e[2]: x})
            items = rec(e[3])
            return F.forall(items, test) if e[1] == "ALL" else F.exists(items, test) if e[1] == "ANY" else ~F.exists(items, test)
        if kind == "call":
            return self.call(e, rec)
        raise QueryError(f"unsupported expression {kind}")

    def call(self, e, rec) -> Column:
        _, name, distinct, args = e
        if name in AGGREGATES:
            if args == [("star",)]:
                return F.coalesce(F.sum(F.coalesce(F.col(TIMES), F.lit(1))), F.lit(0)) if TIMES in self.kinds else F.count(F.lit(1))
            x = rec(args[0])
            if args[0][0] == "name" and self.kinds.get(args[0][1]) in ("node", "rel") and name == "count":
                x = x["id"] if self.kinds[args[0][1]] == "node" else x["src"]
            if name == "count":
                return F.count_distinct(x) if distinct else F.count(x)
            if name == "collect":
                return F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))
            return getattr(F, name)(x)
        if name in ("labels", "type", "id") and args[0][0] == "name":
            x = rec(args[0])
            return F.array(x["label"]) if name == "labels" else x[name]
        if name in ("length", "nodes", "relationships"):
            return rec(args[0])[name]
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name}")
        return FUNCTIONS[name](*map(rec, args))

    # patterns

    def read_of(self, var: str, columns: list[str], always: tuple[str, ...], more: dict) -> list[str]:
        """The columns of a variable that the query reads."""
        used = True if self.props is None else self.props.get(var, set())
        return columns if used is True else [c for c in columns if c in always or c in used or c in more]

    def nodes(self, var: str, labels: list[str], props: dict | None = None, whole: bool = False) -> DataFrame:
        df = self.g.all_nodes(tuple(x for x in labels if x in self.g.nodes) or None if labels else None)
        df = df.where(F.col("label").isin(*labels)) if labels else df
        return df.select(F.struct(*(df.columns if whole else self.read_of(var, df.columns, ("id", "label"), props or {}))).alias(var))

    def plain_edges(self, types: list[str]) -> DataFrame:
        e = self.g.all_edges(tuple(x for x in types if x in self.g.edges) or None if types else None)
        return e.where(F.col("type").isin(*types)) if types else e

    def edges(self, types: list[str], direction: str, columns: list[str] | None = None) -> DataFrame:
        """a, b, r: where an edge leads from and to as the pattern goes, and the edge."""
        e = self.plain_edges(types)
        e = e.select(*columns) if columns else e
        out, back = (e.select(F.col(x).alias("_a"), F.col(y).alias("_b"), F.struct(*e.columns).alias("_r")) for x, y in (("src", "dst"), ("dst", "src")))
        return {"out": out, "in": back}.get(direction) or out.unionByName(back.where("_a <> _b"))

    def bind_node(self, node: tuple) -> str:
        var, labels, props = node
        var = var or self.name()
        if var not in self.kinds:
            df = self.nodes(var, labels, props)
            self.frame = df if self.frame is None else self.frame.crossJoin(df)
            self.kinds[var] = "node"
        elif labels:
            self.frame = self.frame.where(F.col(var)["label"].isin(*labels))
        self.filter_properties(var, props)
        return var

    def filter_properties(self, var: str, props: dict) -> None:
        for k, v in props.items():
            self.frame = self.frame.where(F.col(var)[k] == self.column(v))

    def step(self, at: str, rel: tuple, node: tuple, lean: bool = False) -> tuple[str, str]:
        """lean: nothing compares this relationship with others of its path."""
        var, types, props, direction, hops = rel
        var, to = var or self.name(), node[0] or self.name()
        known = to in self.kinds
        if hops is not None and self.counting and (frame := self.counted(at, types, direction, hops, to, node)) is not None:
            self.frame = frame
            self.kinds |= {var: "steps", TIMES: "value"} | ({to: "node"} if to in frame.columns else {})
            self.frame = self.frame.withColumnRenamed("_steps", var)
            return var, to
        edges = self.edges(types, direction, self.read_of(var, list(EDGE_COLUMNS), ("src", "dst", "type"), props) if lean and hops is None else None)
        if hops is None and not known and (ties := self.ties_of(to)):
            # the far node is looked up first, so that its conditions on what is bound decide about rows before they multiply
            held = edges.withColumnRenamed("_r", var).join(self.nodes(to, node[1], node[2]), F.col("_b") == F.col(to)["id"]).drop("_b")
            self.frame = self.frame.crossJoin(held).where(F.col(at)["id"] == F.col("_a"))
            self.kinds |= {var: "rel", to: "node"}
            self.frame = reduce(lambda f, c: f.where(self.column(c)), ties, self.frame).drop("_a")
            self.filter_properties(var, props)
            self.filter_properties(to, node[2])
            return var, to
        if hops is None:
            self.frame = self.frame.join(edges, F.col(at)["id"] == F.col("_a")).withColumnRenamed("_r", var).drop("_a")
            self.kinds[var] = "rel"
            self.filter_properties(var, props)
        else:
            self.frame, self.kinds[var] = self.walk(at, edges, hops, var), "rels"
        if known:
            self.frame = self.frame.where(F.col(to)["id"] == F.col("_b")).drop("_b")
            self.frame = self.frame.where(F.col(to)["label"].isin(*node[1])) if node[1] else self.frame
        else:
            self.frame = self.frame.join(self.nodes(to, node[1], node[2]), F.col("_b") == F.col(to)["id"]).drop("_b")
            self.kinds[to] = "node"
        self.filter_properties(to, node[2])
        return var, to

    def ties_of(self, to: str) -> list[tuple]:
        """Conditions that a property of this node equals one of a bound variable."""
        def tied(c: tuple) -> bool:
            ends = {x[1][1] for x in c[1:] if x[0] == "property" and x[1][0] == "name"} if c[0] == "=" else set()
            return len(ends) == 2 and to in ends and all(x == to or self.kinds.get(x) in ("node", "rel") for x in ends)

        return [c for c in self.ties if tied(c)]

    def counted(self, at: str, types: list[str], direction: str, hops: tuple, to: str, node: tuple) -> DataFrame | None:
        """The frame with how many trails (TIMES) of each length (_steps) lead on, where that is worked out without listing them; else None.

        Without a bound: numbers of ways are summed from their ends backwards, if the relation has no cycle and nothing else is
        read of the ends. Of at most two hops: numbers of ways less those that use one edge twice.
        """
        least, most = hops
        far = () if to in self.kinds else (to,)
        if most is None and direction in ("out", "in") and far and to not in self.after and not node[2]:
            ends = self.nodes(to, node[1]).select(F.col(to)["id"].alias("id")).distinct()
            pair = ("src", "dst") if direction == "out" else ("dst", "src")
            ways = ways_back(self.plain_edges(types).select(*[F.col(x).alias(y) for x, y in zip(pair, ("src", "dst"))]), ends, least)
            return None if ways is None else self.frame.join(ways, F.col(at)["id"] == F.col("_from")).drop("_from")
        if most is None or most > 2 or not far:
            return None
        edges = cut(self.plain_edges(types).select("src", "dst"))
        out, back = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")), edges.select(F.col("dst").alias("_a"), F.col("src").alias("_b"))
        step = {"out": out, "in": back}.get(direction)
        step = out.unionByName(back.where("_a <> _b")) if step is None else step
        now = cut(self.frame.select(F.col(at)["id"].alias("_from")).distinct()).select("_from", F.col("_from").alias("_at"), F.lit(1).cast("long").alias(TIMES))
        levels = [now]
        for n in range(1, most + 1):
            new = now.join(step, F.col("_at") == F.col("_a")).select("_from", F.col("_b").alias("_at"), TIMES)
            if n == 2:  # back along the edge of the first hop, which is a loop where edges have a direction
                again = now if direction == "both" else now.where("_from = _at")
                new = new.unionByName(again.select("_from", F.col("_from").alias("_at"), (-F.col(TIMES)).alias(TIMES)))
            now = cut(new.groupBy("_from", "_at").agg(F.sum(TIMES).alias(TIMES)).where(f"{TIMES} > 0"))
            levels.append(now)
        ways = reduce(DataFrame.unionByName, [x.withColumn("_steps", F.lit(n)) for n, x in enumerate(levels) if n >= least])
        frame = ways.join(self.nodes(to, node[1], node[2]), F.col("_at") == F.col(to)["id"]).drop("_at")
        frame = self.frame.join(frame, F.col(at)["id"] == F.col("_from")).drop("_from")
        for k, v in node[2].items():
            frame = frame.where(F.col(to)[k] == self.column(v))
        return frame

    def walk(self, at: str, edges: DataFrame, hops: tuple, var: str) -> DataFrame:
        """Trails, no edge twice, of so many hops; _b: where they end. Without an upper bound a table a round, until no trail goes on."""
        least, most = hops
        kind = edges.schema["_r"].dataType.simpleString()
        now = self.frame.withColumns({"_b": F.col(at)["id"], var: F.array().cast(f"array<{kind}>")})
        found, steps = [now] if least == 0 else [], edges.withColumnRenamed("_b", "_to")
        for n in count(1) if most is None else range(1, most + 1):
            now = now.join(steps, F.col("_b") == F.col("_a")).where(~F.array_contains(F.col(var), F.col("_r")))
            now = now.select(*self.frame.columns, F.col("_to").alias("_b"), F.concat(F.col(var), F.array("_r")).alias(var))
            now = cut(now) if most is None else now
            over = most is None and now.isEmpty()
            if n >= least or over:
                found.append(now)
            if over:
                break
        return reduce(DataFrame.unionByName, found)

    def start_of(self, nodes: list) -> int:
        """The node that a path is planned from: one that is bound, else the one with most conditions."""
        bound = [i for i, n in enumerate(nodes) if n[0] in self.kinds]
        return bound[0] if bound else max(range(len(nodes)), key=lambda i: (len(nodes[i][2]), len(nodes[i][1]) == 1, -i))

    def bind_path(self, path: tuple) -> None:
        var, nodes, rels = path
        start, lean = self.start_of(nodes), var is None and len(rels) == 1
        used: list[str] = [""] * len(rels)
        passed: list[str] = [""] * len(nodes)
        passed[start] = self.bind_node(nodes[start])
        for i in range(start, len(rels)):
            used[i], passed[i + 1] = self.step(passed[i], rels[i], nodes[i + 1], lean)
        for i in range(start - 1, -1, -1):
            used[i], passed[i] = self.step(passed[i + 1], flipped(rels[i]), nodes[i], lean)
            if self.kinds[used[i]] == "rels":
                self.frame = self.frame.withColumn(used[i], F.reverse(used[i]))
        single = [u for u in used if self.kinds[u] == "rel"]
        for i, u in enumerate(single):  # a relationship is used once in a pattern
            for r in single[i + 1 :]:
                self.frame = self.frame.where(F.col(u) != F.col(r))
        if var and "steps" in [self.kinds[u] for u in used]:
            self.frame, self.kinds[var] = self.frame.withColumn(var, F.struct(F.col(used[0]).alias("length"))), "path"
        elif var:
            parts = [F.col(r) if self.kinds[r] == "rels" else F.array(F.col(r)) for r in used]
            rel = F.concat(*parts) if parts else F.array()
            self.frame = self.frame.withColumn(var, F.struct(F.size(rel).alias("length"), rel.alias("relationships"), F.array(*[F.col(n)["id"] for n in passed]).alias("nodes")))
            self.kinds[var] = "path"

    def bind_paths(self, paths: list, conditions: list) -> None:
        """Paths in an order in which each hangs together with what is bound. What does not is planned apart, and joined by the conditions between the two."""
        rest = list(paths)

        def connected(plan: Plan) -> tuple | None:
            i = next((i for i, p in enumerate(rest) if any(n[0] in plan.kinds for n in p[1])), None)
            return None if i is None else rest.pop(i)

        while rest:
            if self.frame is None:
                self.bind_path(rest.pop(0))
            elif path := connected(self):
                self.bind_path(path)
            else:
                other = Plan(self.g, self.props)
                other.fresh, other.ties = self.fresh, self.ties
                other.bind_path(rest.pop(0))
                while path := connected(other):
                    other.bind_path(path)
                self.fresh = other.fresh
                self.join(other, conditions)

    def join(self, other: Plan, conditions: list) -> None:
        mine, theirs = set(self.kinds), set(other.kinds)
        between = [c for c in conditions if not is_pattern(c) and (used := variables(c)) <= mine | theirs and used & mine and used & theirs]
        left, self.kinds = self.frame, self.kinds | other.kinds
        self.frame = left.crossJoin(other.frame)  # kept only where no condition ties the two
        if between:
            self.frame = left.join(other.frame, reduce(lambda a, b: a & b, [self.column(c) for c in between]))

    def procedure(self, name: str, args: list, found: dict | None, where) -> None:
        """Calls that read the graph's own facts: labels, relationship types, and nodes by full text."""
        known = name.lower()
        if known == "db.labels":
            rows, kinds = self.g.all_nodes().select("label").distinct(), {"label": "value"}
        elif known == "db.relationshiptypes":
            rows, kinds = self.g.all_edges().select(F.col("type").alias("relationshipType")).distinct(), {"relationshipType": "value"}
        elif known == "db.index.fulltext.querynodes" and len(args) == 2 and args[1][0] == "value":
            term, _, edits = str(args[1][1]).partition("~")
            hits = search.full_text(self.g, term, int(edits) if edits.isdigit() else 2 if "~" in str(args[1][1]) else 0, n=None)
            rows = self.nodes("node", [], whole=True).join(hits.select(F.col("id").alias("_hit"), "score"), F.col("node")["id"] == F.col("_hit")).select("node", "score")
            kinds = {"node": "node", "score": "value"}
        else:
            raise QueryError(f"unknown procedure {name}")
        found = {k: k for k in kinds} if found is None else found
        if unknown := set(found) - set(kinds):
            raise QueryError(f"{name} yields no {', '.join(sorted(unknown))}")
        rows = rows.select(*[F.col(k).alias(v) for k, v in found.items()])
        self.frame = rows if self.frame is None else self.frame.crossJoin(rows)
        self.kinds |= {v: kinds[k] for k, v in found.items()}
        if where:
            self.where(where)

    def where(self, e: tuple) -> None:
        for part in conjuncts(e):
            negated = part[0] == "not" and part[1][0] == "exists"
            if part[0] == "exists" or negated:
                self.exists(part[1] if part[0] == "exists" else part[1][1], negated)
            else:
                self.frame = self.frame.where(self.column(part))

    def exists(self, path: tuple, negated: bool) -> None:
        """A pattern as a condition: a semi or anti join on its bound nodes."""
        sub = Plan(self.g, {})
        sub.bind_path((None, [(n[0] or sub.name(), n[1], n[2]) for n in path[1]], path[2]))
        bound = [n[0] for n in path[1] if n[0] in self.kinds]
        keys = sub.frame.select(*[F.col(b)["id"].alias(f"_k{i}") for i, b in enumerate(bound)]).distinct()
        on = reduce(lambda a, b: a & b, [F.col(b)["id"] == F.col(f"_k{i}") for i, b in enumerate(bound)])
        self.frame = self.frame.join(keys, on, "left_anti" if negated else "left_semi")

    def match(self, optional: bool, paths: list, where) -> None:
        before, kinds = self.frame, dict(self.kinds)
        self.ties = [c for c in conjuncts(where) if not is_pattern(c)] if where else []
        self.bind_paths(paths, conjuncts(where) if where else [])
        if where:
            self.where(where)
        self.frame = self.frame.select(*[k for k in self.kinds if k in self.frame.columns])
        if optional and before is not None:
            key = [v for v, k in kinds.items() if k == "node"]
            hit = self.frame.select(*[F.col(v)["id"].alias(f"_h{i}") for i, v in enumerate(key)]).distinct()
            on = reduce(lambda a, b: a & b, [F.col(v)["id"].eqNullSafe(F.col(f"_h{i}")) for i, v in enumerate(key)])
            self.frame = self.frame.unionByName(before.join(hit, on, "left_anti"), allowMissingColumns=True)

    def project(self, distinct: bool, items: list, order: list, limit, where) -> None:
        items = [x for e, n in items for x in ([(("name", k), k) for k in self.kinds if not k.startswith("_")] if e == ("star",) else [(e, n)])]
        kinds = {n: self.kinds.get(e[1], "value") if e[0] == "name" else "value" for e, n in items}
        source = self.frame if self.frame is not None else self.g.spark.range(1).drop("id")
        self.frame = source
        names = {e: n for e, n in items if isinstance(e, tuple) and not has_unhashable(e)}
        if any(has_aggregate(e) for e, _ in items):
            keys = [self.column(e).alias(n) for e, n in items if not has_aggregate(e)]
            out = source.groupBy(*keys).agg(*[self.column(e).alias(n) for e, n in items if has_aggregate(e)])
            extra: list[str] = []
        else:
            more = [(e, f"_o{i}") for i, (e, _) in enumerate(order) if not distinct and (has_unhashable(e) or e not in names) and not (e[0] == "name" and e[1] in kinds)]
            out = source.select(*[self.column(e).alias(n) for e, n in [*items, *more]])
            names |= {e: n for e, n in more if not has_unhashable(e)}
            extra = [n for _, n in more]
        out = out.select(*[n for _, n in items], *extra)
        out = out.distinct() if distinct else out
        self.frame, self.kinds = out, kinds
        if order:
            by = []
            for e, desc in order:
                c = F.col(names[e]) if not has_unhashable(e) and e in names else self.column(e)
                by.append(c.desc_nulls_first() if desc else c.asc_nulls_last())
            self.frame = self.frame.orderBy(*by)
        if limit:
            self.frame = self.frame.limit(int(limit[1]))
        self.frame = self.frame.drop(*extra) if extra else self.frame
        if where:
            self.where(where)


def ways_back(edges: DataFrame, ends: DataFrame, least: int) -> DataFrame | None:
    """(_from, _steps, TIMES): how many ways of each length, least or more, lead from a node along edges (src, dst) to ends (id). None if the edges have a cycle.

    A round holds a row for each node that a way of its length starts at, whether it ends well or not: a node of one round is one
    of the round before, so rounds that no longer shrink go round a cycle. Edges that lead nowhere further are dropped with them.
    Merge joins: broadcasts of every round would pass through the driver.
    """
    edges, ends = cut(edges), cut(ends)
    one = F.lit(1).cast("long")
    level = edges.select(F.col("dst").alias("id")).distinct().join(ends.withColumn(TIMES, one), "id", "left").withColumn(TIMES, F.coalesce(TIMES, F.lit(0)))
    found = [ends.select(F.col("id").alias("_from"), F.lit(0).alias("_steps"), one.alias(TIMES))] if least == 0 else []
    before, rest = None, edges
    for n in count(1):
        level = cut(rest.join(level.withColumnRenamed("id", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(TIMES).alias(TIMES)))
        size = level.count()
        if size == before:
            return None
        if n >= least:
            found.append(level.where(f"{TIMES} > 0").select(F.col("id").alias("_from"), F.lit(n).alias("_steps"), TIMES))
        if not size:
            return reduce(DataFrame.unionByName, found)
        old, rest, before = rest, cut(rest.join(level.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi")), size
        drop(old)


def has_unhashable(e) -> bool:
    return isinstance(e, (list, dict)) or isinstance(e, tuple) and any(has_unhashable(x) for x in e)


def flipped(rel: tuple) -> tuple:
    """A relationship as it is met from its other end."""
    return (*rel[:3], {"in": "out", "out": "in"}.get(rel[3], rel[3]), rel[4])


def variables(e) -> set[str]:
    """The variables that an expression reads, without those of its own."""
    if isinstance(e, dict):
        return set().union(*map(variables, e.values()))
    if not isinstance(e, (tuple, list)) or not e:
        return set()
    if e[0] == "name":
        return {e[1]}
    if e[0] == "haslabel":
        return {e[1]}
    if e[0] == "quantifier":
        return variables(e[3]) | (variables(e[4]) - {e[2]})
    return set().union(*map(variables, e[1:] if isinstance(e[0], str) else e))


def is_pattern(e: tuple) -> bool:
    """Whether a condition is a pattern, or denies one."""
    return e[0] == "exists" or e[0] == "not" and e[1][0] == "exists"


def conjuncts(e: tuple) -> list[tuple]:
    return [*conjuncts(e[1]), *conjuncts(e[2])] if e[0] == "and" else [e]


def needed(clauses: list) -> dict:
    """What a query reads of its variables: names of properties, or True for all of a variable that stands alone anywhere."""
    found: dict = {}

    def one(var: str, prop: str) -> None:
        if found.get(var) is not True:
            found.setdefault(var, set()).add(prop)

    def expression(e) -> None:
        if isinstance(e, dict):
            for v in e.values():
                expression(v)
        elif isinstance(e, (list, tuple)) and e:
            if e[0] == "property" and e[1][0] == "name":
                one(e[1][1], e[2])
            elif e[0] == "call" and e[1] in ("labels", "type", "id") and e[3][0][0] == "name":
                one(e[3][0][1], {"labels": "label"}.get(e[1], e[1]))
            elif e[0] == "name" and len(e) == 2 and isinstance(e[1], str):
                found[e[1]] = True
            elif e[0] != "value":
                for x in e[1:] if isinstance(e[0], str) else e:
                    expression(x)

    for kind, *rest in clauses:
        if kind == "match":
            for _, nodes, rels in rest[1]:
                for var, _, props, *_ in [*nodes, *rels]:
                    for k, v in props.items():
                        one(var, k)
                        expression(v)
            expression(rest[2] or ())
        else:
            expression(rest)
    return found


def everything(clauses: list) -> bool:
    """Whether a clause hands on all variables, by a star that is no count's."""
    return any(kind == "project" and any(e == ("star",) for e, _ in rest[1]) for kind, *rest in clauses)


def only_counted(clauses: list) -> bool:
    """Whether the last pattern is one path with a variable number of hops, of which the result has nothing but the length and how many there are."""
    if len(clauses) < 2 or clauses[-2][0] != "match" or len(clauses[-2][2]) != 1:
        return False
    (var, nodes, rels), where, (_, distinct, items, order, _, last) = clauses[-2][2][0], clauses[-2][3], clauses[-1]
    if len(rels) != 1 or rels[0][4] is None or rels[0][0] or rels[0][2] or where or last:
        return False
    counts = [e for e, _ in items if has_aggregate(e)]
    if not counts or any(e != ("call", "count", False, [("star",)]) for e in counts) or any(has_aggregate(e) for e, _ in order):
        return False

    def stands(e) -> bool:
        """Whether the path is read otherwise than by its length."""
        if isinstance(e, dict):
            return any(map(stands, e.values()))
        if not isinstance(e, (list, tuple)) or not e or e[0] == "value" or e[0] == "call" and e[1] == "length" and e[3] == [("name", var)]:
            return False
        return tuple(e) == ("name", var) or any(map(stands, e))

    return var is None or not stands(items) and not stands(order)


def run(g: PropertyGraph, query: str, params: dict | None = None) -> DataFrame:
    """The rows of a read-only query, with its RETURN names as columns."""
    plan = Plan(g)
    clauses = Parser(query, params).query()
    if not clauses or clauses[-1][0] != "project":
        raise QueryError("a query ends with RETURN")
    plan.props = None if everything(clauses) else needed(clauses)
    for i, (kind, *rest) in enumerate(clauses):
        plan.counting, plan.after = i == len(clauses) - 2 and only_counted(clauses), needed(clauses[i + 1 :])
        getattr(plan, kind)(*rest)
    return plan.frame
