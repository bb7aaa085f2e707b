"""Jobs, settings, contexts, ignore files, packages, snapshots' archives."""

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import analyze, registry
from srcgraph.service import contexts, jobs, settings
from srcgraph.sources import bundle, files, packages


def test_jobs_are_known_by_their_latest_event(spark, tmp_path):
    now = [1000.0]
    log = jobs.JobLog(spark, str(tmp_path / "jobs"), clock=lambda: now[0])
    assert log.jobs().isEmpty()
    log.tell("a", "pending", "/r", total=10)
    now[0] = 1010
    log.tell("a", "running", done=4, current="x.py")
    r = log.status("a").first()
    assert (r["state"], r["path"], r["progress"], r["seconds"], r["seconds_left"], r["current_file"]) == ("running", "/r", 40.0, 10.0, 15.0, "x.py")
    assert log.active("/r/").first()["job_id"] == "a" and log.active("/s").isEmpty()
    with pytest.raises(ValueError):
        log.start("/r", lambda progress: None)
    now[0] = 1195
    log.tell("a", "failed", error="E: no")
    r = log.status("a").first()
    assert (r["state"], r["errors"], r["took"], r["seconds_left"]) == ("failed", ["E: no"], "3m 15s", None)
    log.tell("b", "running", "/s")
    now[0] += 25 * 3600
    assert log.purge() == 1 and [x["job_id"] for x in log.jobs().collect()] == ["b"]


def test_jobs_run_in_the_background(spark, tmp_path):
    log = jobs.JobLog(spark, str(tmp_path / "jobs"))
    good = log.start("/r", lambda progress: progress(1), total=2)
    bad = log.start("/s", lambda progress: 1 / 0)
    log.close()
    assert log.status(good).first()["state"] == "completed" and log.status(good).first()["progress"] == 100
    assert log.status(bad).first()["errors"] == ["ZeroDivisionError: division by zero"]


def test_settings_in_layers(tmp_path):
    s = settings.Settings(tmp_path / "home", tmp_path / "repo", {"COMPLEXITY_THRESHOLD": "12"})
    assert s.get("MAX_FILE_SIZE_MB") == "10" and s.get("COMPLEXITY_THRESHOLD") == "12"
    s.set("MAX_FILE_SIZE_MB", "5")
    s.set("IGNORE_TEST_FILES", "TRUE")
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / ".env").write_text("# own\nMAX_FILE_SIZE_MB=7\nOTHER=1\n")
    assert s.get("MAX_FILE_SIZE_MB") == "7" and s.flag("IGNORE_TEST_FILES") and s.scan_options()["tests"] is False
    for name, value in (("INDEX_SOURCE", "maybe"), ("MAX_FILE_SIZE_MB", "many"), ("NONE", "1"), ("MAX_DEPTH", "deep")):
        with pytest.raises(ValueError):
            s.set(name, value)
    s.reset()
    assert not s.flag("IGNORE_TEST_FILES")


def test_contexts_hold_in_turn(tmp_path):
    c = contexts.Contexts(tmp_path / "home")
    repo, other = tmp_path / "repo", tmp_path / "other"
    (repo / "sub").mkdir(parents=True)
    (other / contexts.LOCAL).mkdir(parents=True)
    assert c.resolve(repo).mode == "global"
    assert c.create("team") and not c.create("team") and c.register("team", str(repo)) and not c.register("none", str(repo))
    assert c.set_mode("named") and not c.set_mode("odd") and c.set_default("team") and not c.set_default("none")
    assert c.resolve(repo).name == "team" and c.resolve(repo).repos == [str(repo)]
    c.switch(repo, other)
    assert c.resolve(repo).graph == str(other / contexts.LOCAL / "graph")
    (repo / contexts.LOCAL).mkdir()
    assert c.resolve(repo / "sub").graph == str(repo / contexts.LOCAL / "graph") and c.resolve(repo, "team").mode == "named"
    assert [x.repos for x in c.discover(tmp_path, 0)] == [[str(other)], [str(repo)]]
    assert c.delete("team") and not c.delete("team") and c.list() == []


def test_ignore_files_are_found_upwards(spark, tmp_path):
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a" / "b").mkdir(parents=True)
    (tmp_path / "r" / files.IGNORE_FILE).write_text("# note\nskip.py\n\n")
    extra = tmp_path / "extra"
    extra.write_text("more.py\n")
    assert files.find_ignore_file(tmp_path / "r" / "a" / "b") == tmp_path / "r" / files.IGNORE_FILE
    assert files.ignore_patterns(tmp_path / "r" / "a", extra)[:2] == ["skip.py", "more.py"]
    (tmp_path / "free").mkdir()
    assert files.ignore_patterns(tmp_path / "free")[0] == files.DEFAULT_PATTERNS[0] and (tmp_path / "free" / files.IGNORE_FILE).is_file()
    for name in ("skip.py", "more.py", "a/keep.py", "a/b/deep.py"):
        (tmp_path / "r" / name).write_text("x = 1\n")
    found = files.scan(spark, str(tmp_path / "r"), files.ignore_patterns(tmp_path / "r", extra), max_depth=1)
    assert {r["relative_path"] for r in found.collect()} == {"a/keep.py"}
    assert files.file_text(spark, str(tmp_path / "r" / "a" / "keep.py")) == "x = 1\n"
    assert jobs.estimate(spark, str(tmp_path / "r")) == (4, 0.2)


def test_packages_and_projects(spark, tmp_path):
    assert packages.package_path("json").endswith("json") and packages.package_path("no_such_package") is None
    (tmp_path / "node_modules" / "left").mkdir(parents=True)
    (tmp_path / "src").mkdir()
    assert packages.package_path("left", "JavaScript", tmp_path / "src") == str(tmp_path / "node_modules" / "left")
    with pytest.raises(ValueError):
        packages.package_path("x", "cobol")
    for name in ("one", "group/two"):
        (tmp_path / "p" / name).mkdir(parents=True)
        (tmp_path / "p" / name / "pyproject.toml").write_text("")
        (tmp_path / "p" / name / "m.py").write_text("def f():\n    return 1\n")
    rows = packages.index_projects(spark, tmp_path / "p", str(tmp_path / "graphs")).collect()
    assert [(r["name"], r["files"], r["functions"]) for r in rows] == [("two", 1, 1), ("one", 1, 1)]


def test_archive_round_trip(spark, repo, tmp_path):
    root = repo.node("Repository").first()["path"]
    bundle.export(repo, str(tmp_path / "s"), root)
    back = bundle.unpack(bundle.archive(str(tmp_path / "s"), str(tmp_path / "s.cgc")), str(tmp_path / "t"))
    g = bundle.load(spark, back)
    assert {r["id"] for r in g.node("Function").collect()} == {r["id"] for r in repo.node("Function").collect()}
    meta = spark.read.json(f"{back}/metadata").first()
    assert meta["name"] == "sample" and spark.read.json(f"{back}/schema").where("name = 'Function'").first()["key"] == ["name", "path", "line_number"]
    assert any(r["value"].startswith("node Function: ") for r in spark.read.text(f"{back}/README").collect())
    assert bundle.clear(g, root).node("Function").isEmpty()
    got = bundle.download((tmp_path / "s.cgc").as_uri(), str(tmp_path / "copy"))
    assert open(got, "rb").read() == (tmp_path / "s.cgc").read_bytes()
    with pytest.raises(Exception):
        bundle.download((tmp_path / "none").as_uri(), str(tmp_path / "left"))
    assert not list(tmp_path.glob("left*"))


def test_listing_of_bundles(spark):
    manifest = spark.createDataFrame([("flask", "flask-1", "1", None)], "name string, full_name string, version string, commit string")
    release = spark.createDataFrame([("numpy-2.0-ab12.cgc", 3 << 20), ("note.txt", 1)], "bundle_name string, size_bytes long")
    rows = registry.listing(manifest, release, {"numpy": "science"}).collect()
    assert [(r["name"], r["version"], r["commit"], r["source"], r["category"]) for r in rows] == [("flask", "1", "unknown", "manifest", "other"), ("numpy", "2.0", "ab12", "release", "science")]


def test_one_entry_for_questions(repo):
    a = analyze.analyze(repo, " Find_Callees", "main")
    assert a.kind == "find_callees" and a.summary() == f"Function 'main' calls {a.results.count()} other functions"
    h = analyze.analyze(repo, "inheritance", "Square")
    assert h.summary().startswith("Class 'Square' has 1 parents, 0 children")
    chain = analyze.analyze(repo, "path", "main -> format_value", "4")
    assert chain.summary() == "Found 1 call chains from 'main' to 'format_value' (max depth: 4)"
    kinds = {analyze.analyze(repo, k, "main->main" if analyze.KIND_OF[k] == "call_chain" else "x").kind for k in analyze.KIND_OF}
    assert kinds == set(analyze.ALIASES)
    for kind, target in (("nothing", "x"), ("chain", "main")):
        with pytest.raises(analyze.UnknownQuestion):
            analyze.analyze(repo, kind, target)
    assert registry.by_language(repo.all_nodes(), "function", "Rust").where(F.col("name") == "helper").count() == 1


def test_indexing_jobs_add_to_a_stored_graph(spark, tmp_path):
    from srcgraph.service import indexing

    root = tmp_path / "code"
    root.mkdir()
    (root / "m.py").write_text('x = 1\n\n\ndef f():\n    """Doc."""\n    return g()\n\n\ndef g():\n    return 2\n')
    log, store = jobs.JobLog(spark, str(tmp_path / "jobs")), indexing.Store(spark, str(tmp_path / "store"))
    s = settings.Settings(tmp_path / "home", environment={"INDEX_VARIABLES": "false", "INDEX_SOURCE": "false"})
    job = indexing.add_code(log, store, str(root), settings=s)
    log.close()
    assert (job["files"], job["seconds"]) == (1, 0.05) and log.status(job["job_id"]).first()["state"] == "completed"
    g = store.graph()
    assert {r["name"] for r in g.node("Function").collect()} == {"f", "g"} and g.edge("CALLS").count() == 1
    assert g.node("Variable").isEmpty() and g.node("Function").where("source is not null or docstring is not null").isEmpty()
    assert g.violations().isEmpty()
    with pytest.raises(ValueError):
        indexing.add_code(log, store, str(root))
    with pytest.raises(FileNotFoundError):
        indexing.add_code(log, store, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        indexing.add_package(log, store, "no_such_package")
    bundle.export(g, str(tmp_path / "s"))
    again = indexing.load_bundle(indexing.Store(spark, str(tmp_path / "other")), bundle.archive(str(tmp_path / "s"), str(tmp_path / "s.cgc")), str(tmp_path / "t"))
    assert {r["id"] for r in again.node("Function").collect()} == {r["id"] for r in g.node("Function").collect()}


def test_values_get_the_type_that_most_have(spark):
    from srcgraph.operators import quality

    rows = [("a", "Integer", "5"), ("a", "Integer", "7"), ("a", "String", "x"), ("a", "Boolean", "true"), ("a", None, None), ("b", "Boolean", "false"), ("b", "Boolean", "true"), ("b", "Integer", "3"), ("b", "String", ""), ("c", "String", "t"), ("c", None, None), ("d", "Float", "1.5"), ("d", None, None)]
    got = quality.coerced(spark.createDataFrame(rows, "key string, kind string, value string").coalesce(1), "key", "kind", "value").orderBy("key", "kind", "value").collect()
    assert sorted((r["key"], r["value"] or "", r["coerced"]) for r in got) == [("a", "", "0"), ("a", "5", "5"), ("a", "7", "7"), ("a", "true", "1"), ("a", "x", "0"), ("b", "", "false"), ("b", "3", "true"), ("b", "false", "false"), ("b", "true", "true"), ("c", "", ""), ("c", "t", "t"), ("d", "", "0.0"), ("d", "1.5", "1.5")]
