"""One entry for all questions about a symbol's relations, by kind of question or one of its other names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.graph import PropertyGraph
from srcgraph.operators import quality, relations, search, traverse

#: Kinds of questions and their other names.
ALIASES = {
    "find_callers": (),
    "find_callees": (),
    "find_importers": (),
    "find_functions_by_argument": (),
    "find_functions_by_decorator": (),
    "find_trait_implementors": ("find_trait_impls", "trait_impls"),
    "who_modifies": ("modifies", "mutations", "changes", "variable_usage"),
    "class_hierarchy": ("inheritance", "extends"),
    "overrides": ("implementations", "polymorphism"),
    "dead_code": ("unused", "unreachable"),
    "find_complexity": (),
    "find_all_callers": (),
    "find_all_callees": (),
    "call_chain": ("path", "chain"),
    "module_dependencies": ("module_deps", "module_usage"),
    "variable_scope": ("var_scope", "variable_usage_scope"),
}
KIND_OF = {name: kind for kind, others in ALIASES.items() for name in (kind, *others)}
CHAIN_DEPTH, MOST_COMPLEX = 5, 10


class UnknownQuestion(ValueError):
    """The kind of question is none of ALIASES, or its target can't be read."""


@dataclass
class Answer:
    """kind: of the question, under its first name; sections: tables by name, of which most kinds have one, results."""

    kind: str
    target: str
    sections: dict[str, DataFrame]
    wording: Callable[[dict[str, int]], str]

    @property
    def results(self) -> DataFrame:
        return next(iter(self.sections.values()))

    def summary(self) -> str:
        """A sentence with the counts of rows; runs a count for each section."""
        return self.wording({name: df.count() for name, df in self.sections.items()})


def _number(context: str | None, default: int) -> int:
    return int(context) if context and context.isdigit() else default


def analyze(g: PropertyGraph, kind: str, target: str = "", context: str | None = None, repo: str | None = None) -> Answer:
    """The answer to a question about a target. context: a file's path; for find_complexity how many, for call_chain how deep.

    call_chain takes 'start->end'. Letter case and blanks around the kind don't matter.
    """
    asked = KIND_OF.get(kind.lower().strip())
    if asked is None:
        raise UnknownQuestion(f"unknown kind of question {kind!r}; known are {', '.join(ALIASES)}")

    def one(df: DataFrame, words: str) -> Answer:
        return Answer(asked, target, {"results": df}, lambda n: words.format(n=n["results"], t=target))

    if asked == "find_callers":
        return one(relations.callers(g, target, context, repo), "Found {n} functions that call '{t}'")
    if asked == "find_callees":
        return one(relations.callees(g, target, context, repo), "Function '{t}' calls {n} other functions")
    if asked == "find_importers":
        return one(relations.importers(g, target, repo), "Found {n} files that import '{t}'")
    if asked == "find_functions_by_argument":
        return one(search.by_argument(g, target, context, repo), "Found {n} functions that take '{t}' as an argument")
    if asked == "find_functions_by_decorator":
        found = search.by_decorator(g, target, context, repo).where("label = 'Function'")
        return one(found, "Found {n} functions decorated with '{t}'")
    if asked == "find_trait_implementors":
        return one(search.implementors(g, target, repo), "Found {n} types that implement trait '{t}'")
    if asked == "who_modifies":
        return one(relations.modifiers(g, target, repo), "Found {n} containers that hold variable '{t}'")
    if asked == "overrides":
        return one(relations.overrides(g, target, repo), "Found {n} implementations of function '{t}'")
    if asked == "dead_code":
        return one(quality.dead_code(g, repo=repo), "Found {n} potentially unused functions")
    if asked == "find_complexity":
        return one(quality.most_complex(g, _number(context, MOST_COMPLEX), repo), "Found the top {n} most complex functions")
    if asked == "find_all_callers":
        return one(traverse.all_callers(g, target, context, repo), "Found {n} direct and indirect callers of '{t}'")
    if asked == "find_all_callees":
        return one(traverse.all_callees(g, target, context, repo), "Found {n} direct and indirect callees of '{t}'")
    if asked == "call_chain":
        start, arrow, end = (x.strip() for x in target.partition("->"))
        if not arrow:
            raise UnknownQuestion("a call chain is asked for as 'start->end', as in 'main->process_data'")
        depth = _number(context, CHAIN_DEPTH)
        words = f"Found {{n}} call chains from '{start}' to '{end}' (max depth: {depth})"
        return one(traverse.call_chains(g, start, end, depth, repo=repo), words)
    if asked == "class_hierarchy":
        every = relations.hierarchy(g, target, context, repo)
        parts = {"parent": "parent_classes", "child": "child_classes", "method": "methods"}
        sections = {name: every.where(F.col("section") == s).drop("section") for s, name in parts.items()}
        words = f"Class '{target}' has {{parent_classes}} parents, {{child_classes}} children, and {{methods}} methods"
        return Answer(asked, target, sections, lambda n: words.format(**n))
    if asked == "module_dependencies":
        sections = {"importers": relations.module_importers(g, target, repo), "imports": relations.co_imports(g, target)}
        return Answer(asked, target, sections, lambda n: f"Module '{target}' is imported by {n['importers']} files")
    found = relations.variable_scope(g, target, repo=repo)
    return Answer(asked, target, {"instances": found}, lambda n: f"Variable '{target}' has {n['instances']} instances across different scopes")


def scopes(g: PropertyGraph, variable: str, path: str | None = None, repo: str | None = None) -> DataFrame:
    """The instances of a variable by kind of scope: how many, and where they are."""
    found = relations.variable_scope(g, variable, path, repo)
    place = F.struct("path", "line_number", "scope_name")
    return found.groupBy("scope_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(place)).alias("places")).orderBy("scope_type")
