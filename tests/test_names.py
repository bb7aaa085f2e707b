"""Names of languages without an extractor of their own."""

import pytest

from srcgraph.extract import names

TEXTS = {
    "a.js": ("import x from 'lib';\nclass Cat extends Animal { meow() { return purr(1); } }\nfunction purr(n) { return n; } // hidden()\nconst run = (a) => purr(a);\n", {"meow", "purr", "run"}, {"Cat"}, {"lib"}, {("Cat", "Animal")}),
    "b.ts": ("import { y } from './y';\ninterface Shape { }\nclass Box extends Shape { }\nfunction area(s: Shape): number { return 1; }\n", {"area"}, {"Shape", "Box"}, {"./y"}, {("Box", "Shape")}),
    "C.java": ("import java.util.List;\nclass Dog extends Animal {\n  public int bark(int n) throws Oops { return helper(n); }\n}\n", {"bark"}, {"Dog"}, {"java.util.List"}, {("Dog", "Animal")}),
    "d.c": ('#include "d.h"\nstruct Point { int x; };\nstatic int add(int a, int b) {\n  return a + b;\n}\n', {"add"}, {"Point"}, {"d.h"}, set()),
    "e.cpp": ("#include <vector>\nclass Base { };\nclass Child : public Base { };\nint main() {\n  return 0;\n}\n", {"main"}, {"Base", "Child"}, {"vector"}, {("Child", "Base")}),
    "f.go": ('package f\nimport "fmt"\ntype Server struct { }\nfunc (s *Server) Start() { fmt.Println(1) }\nfunc helper(a int) int { return a }\n', {"Start", "helper"}, {"Server"}, {"fmt"}, set()),
    "g.rb": ("require 'json'\nclass Cat < Animal\n  def meow\n    purr(1) # hidden\n  end\nend\n", {"meow"}, {"Cat"}, {"json"}, {("Cat", "Animal")}),
    "h.php": ("<?php\nuse App\\Base;\nclass Home extends Base { function show($x) { return view($x); } }\n", {"show"}, {"Home"}, {"App\\Base"}, {("Home", "Base")}),
    "i.kt": ("import a.b\nclass Cat(val n: Int) : Animal() { fun meow() { purr() } }\nfun purr() = 1\n", {"meow", "purr"}, {"Cat"}, {"a.b"}, {("Cat", "Animal")}),
    "j.dart": ("import 'pkg:x';\nclass Cat extends Animal { int meow(int n) { return n; } }\n", {"meow"}, {"Cat"}, {"pkg:x"}, {("Cat", "Animal")}),
    "k.cs": ("using System;\nclass Cat : Animal { public int Meow(int n) { return n; } }\n", {"Meow"}, {"Cat"}, {"System"}, {("Cat", "Animal")}),
    "l.swift": ("import UIKit\nclass Cat: Animal { func meow() { purr() } }\n", {"meow"}, {"Cat"}, {"UIKit"}, {("Cat", "Animal")}),
    "m.pl": ("use Data::Dumper;\npackage Cat;\nsub meow { purr(1); } # hidden()\n", {"meow"}, {"Cat"}, {"Data::Dumper"}, set()),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f"/r/{p}", t[0]) for p, t in TEXTS.items()] + [("/r/none.txt", "class No { }"), ("/r/empty.js", None)], "path string, text string").repartition(1)


def test_names_of_every_language(files):
    got = {r["path"][3:]: r for r in names.names(files).collect()}
    assert set(got) == set(TEXTS) | {"empty.js"} and got["empty.js"]["functions"] == []
    for path, (_, functions, classes, imports, bases) in TEXTS.items():
        r = got[path]
        assert ({*r["functions"]}, {*r["classes"]}, {*r["imports"]}, {(b["child"], b["parent"]) for b in r["bases"]}) == (functions, classes, imports, bases), path
        assert "hidden" not in r["calls"]


def test_graph_of_names(files):
    g = names.names_graph(files)
    label = {r["id"]: (r["name"], r["path"][3:]) for r in g.all_nodes(("Function", "Class", "File")).collect()}
    calls = {(label[r["src"]][1], label[r["dst"]]) for r in g.edge("CALLS").collect()}
    assert ("a.js", ("purr", "a.js")) in calls and ("i.kt", ("purr", "i.kt")) in calls and ("g.rb", ("purr", "a.js")) in calls
    assert {(label[r["src"]][0], label[r["dst"]][0]) for r in g.edge("INHERITS").collect()} == {("Box", "Shape"), ("Child", "Base"), ("Home", "Base")}


def test_loose_resolution_prefers_the_only_then_the_own_then_the_first(spark):
    symbols = spark.createDataFrame([("f1", "Function", "f", "/a", 1), ("f2", "Function", "f", "/b", 2), ("c1", "Class", "f", "/c", 0), ("g1", "Class", "g", "/a", 3), ("v1", "Variable", "v", "/a", 4)], "id string, label string, name string, path string, ord int")
    calls = spark.createDataFrame([("x", "f", "/b"), ("y", "f", "/z"), ("z", "g", "/q"), ("w", "v", "/q"), ("f1", "f", "/a"), ("u", "none", "/a")], "caller string, name string, path string")
    assert {tuple(r) for r in names.resolve_loosely(calls, symbols).collect()} == {("x", "f2"), ("y", "f1"), ("z", "g1"), ("w", "v1")}
