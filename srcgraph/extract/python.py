"""Python symbols by the standard library's parser."""

from __future__ import annotations

import ast
import re

from srcgraph.extract import extractor

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Kinds of nodes that each add one to the complexity.
BRANCHES = (ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.ListComp, ast.GeneratorExp, ast.match_case)


def complexity(node: ast.AST) -> int:
    """1 and one for each branch, nested functions included; an elif adds nothing, 'a and b and c' two."""
    n = 1
    elifs = {id(x.orelse[0]) for x in ast.walk(node) if isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and x.orelse[0].col_offset == x.col_offset}
    for x in ast.walk(node):
        if isinstance(x, BRANCHES) or isinstance(x, ast.If) and id(x) not in elifs:
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def params(a: ast.arguments) -> list[str]:
    found = [(x.lineno, x.col_offset, x.arg) for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
    found += [(x.lineno, x.col_offset, stars + x.arg) for x, stars in ((a.vararg, "*"), (a.kwarg, "**")) if x]
    return [f[2] for f in sorted(found)]


class Reader(ast.NodeVisitor):
    def __init__(self, text: str):
        self.text, self.scopes = text, []
        self.functions, self.classes, self.variables, self.imports, self.calls = [], [], [], [], []

    def source(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ast.unparse(node)

    def context(self, kinds: tuple[str, ...] = ("function_definition", "class_definition")):
        return next((s for s in reversed(self.scopes) if s[1] in kinds), (None, None, None))

    def inside(self, name: str, kind: str, node: ast.AST) -> None:
        self.scopes.append((name, kind, node.lineno))
        for x in node.body:
            self.visit(x)
        self.scopes.pop()

    def visit_FunctionDef(self, node) -> None:
        name, kind, _ = self.context()
        decorators = ["@" + self.source(d) for d in node.decorator_list]
        self.functions.append({"name": node.name, "line_number": node.lineno, "end_line": node.end_lineno, "args": params(node.args), "cyclomatic_complexity": complexity(node), "context": name, "context_type": kind, "class_context": self.context(("class_definition",))[0], "decorators": decorators, "is_async": isinstance(node, ast.AsyncFunctionDef), "source": self.source(node), "docstring": ast.get_docstring(node, clean=False)})
        for x in (*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d)):
            self.visit(x)
        self.inside(node.name, "function_definition", node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [self.source(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        self.classes.append({"name": node.name, "line_number": node.lineno, "end_line": node.end_lineno, "bases": bases, "context": self.context()[0], "decorators": ["@" + self.source(d) for d in node.decorator_list], "kind": "class", "source": self.source(node), "docstring": ast.get_docstring(node, clean=False)})
        for x in (*node.decorator_list, *node.bases, *(k.value for k in node.keywords)):
            self.visit(x)
        self.inside(node.name, "class_definition", node)

    def assigned(self, target: ast.AST, value: ast.AST | None, kind: str | None, node: ast.AST) -> None:
        if isinstance(value, ast.Dict):
            for v in value.values:
                if isinstance(v, ast.Attribute):
                    self.call(v, v.lineno, [], True)
        if not isinstance(target, ast.Name):
            return
        name, scope, _ = self.context()
        cls = self.context(("class_definition",))[0]
        if isinstance(value, ast.Lambda):
            self.functions.append({"name": target.id, "line_number": target.lineno, "end_line": node.end_lineno, "args": params(value.args), "cyclomatic_complexity": 1, "context": name, "context_type": scope, "class_context": cls, "decorators": [], "is_async": False, "source": self.source(node), "docstring": None})
        else:
            self.variables.append({"name": target.id, "line_number": target.lineno, "value": self.source(value) if value else None, "type": kind, "context": name, "class_context": cls})

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.assigned(t, node.value, None, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.assigned(node.target, node.value, self.source(node.annotation), node)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.imports += [{"name": a.name, "full_import_name": a.name, "line_number": node.lineno, "alias": a.asname} for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.imports += [{"name": a.name, "full_import_name": f"{module}.{a.name}" if module.strip(".") else f"{module}{a.name}", "line_number": node.lineno, "alias": a.asname} for a in node.names]

    def call(self, target: ast.AST, line: int, args: list[str], indirect: bool) -> None:
        full = self.source(target)
        name, kind, at = self.context()
        self.calls.append({"name": target.id if isinstance(target, ast.Name) else target.attr, "full_name": full, "line_number": line, "args": args, "inferred_obj_type": None, "context": {"name": name, "kind": kind, "line": at}, "class_context": self.context(("class_definition",))[0], "is_indirect_call": indirect})

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.call(node.func, node.lineno, [self.source(a) for a in node.args] + [f"{k.arg}={self.source(k.value)}" if k.arg else f"**{self.source(k.value)}" for k in node.keywords], False)
        self.generic_visit(node)


def salvage(text: str) -> dict:
    """def and class lines of a file that can't be parsed."""
    lines = [(i, m) for i, line in enumerate(text.splitlines(), 1) if (m := re.match(r"\s*(async\s+def|def|class)\s+(\w+)", line))]
    f = [{"name": m[2], "line_number": i, "end_line": i, "args": [], "cyclomatic_complexity": 1, "context": None, "context_type": None, "class_context": None, "decorators": [], "is_async": m[1].startswith("async"), "source": None, "docstring": None} for i, m in lines if m[1] != "class"]
    c = [{"name": m[2], "line_number": i, "end_line": i, "bases": [], "context": None, "decorators": [], "kind": "class", "source": None, "docstring": None} for i, m in lines if m[1] == "class"]
    return {"functions": f, "classes": c}


@extractor("python")
def python(text: str) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return salvage(text) | {"error": f"SyntaxError: {e}"}
    r = Reader(text)
    r.visit(tree)
    seen: dict[str, dict] = {}
    for i in r.imports:  # the first of a full name stays
        seen.setdefault(i["full_import_name"], i)
    return {"functions": r.functions, "classes": r.classes, "variables": r.variables, "imports": list(seen.values()), "function_calls": r.calls}
