"""Settings, their overlay, and the working-copy adapter."""
import subprocess

import pytest

from tessella.sources import config, diff, git, specs

TEXT = """# settings
version: 1
block_on: warning
languages:
  - go
  - "python"   
analyzers:
  imports: false
  security: true
ignore: ["vendor/", a]
custom_rules:
  - id: own
    pattern: "x: y"
    files: '*.go'
  - id: two
"""


def test_reading_and_merging():
    s = config.load(TEXT, "block_on: error\nlanguages: []\nanalyzers:\n  tests: true\ncompliance:\n  packs: [t]\n", {"TESSELLA_BLOCK_ON": "none"})
    assert s["languages"] == ["go", "python"] and s["ignore"] == ["vendor/", "a"] and s["block_on"] == "none"
    assert s["analyzers"] == {"tests": True} and s["compliance"]["packs"] == []
    assert [r.pattern for r in config.custom_rules(s)] == ["x: y", ""] and config.enabled(s) == {"tests", "custom"}
    assert config.load()["languages"] == [n for n in config.LANGUAGES if n != "java"]
    assert config.read_yaml(None) == {} and config.read_yaml("- a\n- b: 1\n  c: 2\n") == ["a", {"b": 1, "c": 2}]


def test_validation():
    assert config.validate(config.load()) == []
    assert len(config.validate({"block_on": "x", "languages": ["klingon"], "watch": {"debounce": "soon"}})) == 3
    assert config.seconds("1m30s") == 90 and config.seconds("200ms") == 0.2
    with pytest.raises(ValueError):
        config.seconds("5 minutes")


def test_working_copy(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "first: a")
    (tmp_path / "a.py").write_text("x = 2\n")
    files = diff.parse_diff(git.diff_text(str(tmp_path)))
    assert [(f["path"], f["status"], len(f["hunks"][0]["lines"])) for f in files] == [("a.py", "modified", 2)]
    assert diff.parse_diff(git.diff_text(str(tmp_path), "tree"))[0]["status"] == "added"
    name = git._git(str(tmp_path), "ls-files").split()[0]
    assert git.content(str(tmp_path), name, "HEAD") == git._git(str(tmp_path), "show", f"HEAD:{name}") and git.content(str(tmp_path), "none", "HEAD") is None and git.content(str(tmp_path), "none") is None
    assert [(r.file, r.content) for r in git.contents(spark, str(tmp_path), ["none", name], "HEAD").collect()] == [(name, git.content(str(tmp_path), name, "HEAD"))]
    assert git.contents(spark, str(tmp_path), [name]).first().content == (tmp_path / name).read_text() and git.contents(spark, str(tmp_path), [], "HEAD").count() == 0
    assert [(r.author, r.subject) for r in specs.commits(git.commit_lines(spark, str(tmp_path))).collect()] == [("a", "first: a")]


SPEC = """version: 1
title: Payments
requirements:
  - id: REQ-1
    description: "Charge once"
    priority: high
    targets: ["src/pay/", lib/*]
  - id: REQ-2
    description: Refund
    status: planned
    tags:
      - slow
"""


def test_specifications_in_yaml_and_markdown(spark):
    told, wrong = specs.parse_yaml_spec(SPEC)
    assert wrong == "" and [(r["id"], r["priority"], r["status"], r["targets"], r["tags"]) for r in told] == [("REQ-1", "high", None, ["src/pay/", "lib/*"], []), ("REQ-2", None, "planned", [], ["slow"])]
    for bad, why in (("version: 2", "version"), (SPEC.replace("REQ-2", "REQ-1"), "duplicate"), (SPEC.replace("REQ-2", "two"), "malformed"), (SPEC.replace("high", "urgent"), "priority"), (SPEC.replace("planned", "done"), "status"), (SPEC.replace("    description: Refund\n", ""), "description"), ("version: 1\n", "title"), (None, "version")):
        assert specs.parse_yaml_spec(bad)[0] == [] and why in specs.parse_yaml_spec(bad)[1]
    rows = specs.requirements(spark.createDataFrame([(1, SPEC), (2, "## One\n\ntext"), (3, None)], "k int, text string"), "k").collect()
    assert sorted((r.k, r.req_id, r.title, r.description) for r in rows) == [(1, "REQ-1", None, "Charge once"), (1, "REQ-2", None, "Refund"), (2, "SEC-1", "One", "text")]


def test_baseline_of_a_specification(spark, tmp_path):
    held = spark.createDataFrame([("implemented", "REQ-2"), ("implemented", "REQ-1"), ("implemented", "REQ-1"), ("accepted_unexpected", "x")], "kind string, item string")
    specs.write_spec_baseline(held, str(tmp_path / "b"), "spec.yaml")
    back = specs.spec_baseline(spark, str(tmp_path / "b"))
    assert sorted((r.spec_file, r.kind, r.item) for r in back.collect()) == [("spec.yaml", "accepted_unexpected", "x"), ("spec.yaml", "implemented", "REQ-1"), ("spec.yaml", "implemented", "REQ-2")]
    found = spark.createDataFrame([("implemented", "REQ-1"), ("implemented", "REQ-9")], "kind string, item string")
    assert [tuple(r) for r in specs.beyond_spec_baseline(found, back).collect()] == [("implemented", "REQ-9")]


def test_settings_make_the_context(spark):
    from tessella.plans import pipeline
    from tests.test_lines import files

    diff = files(spark, ("a.py", ["+hashlib.md5(b)"]), ("vendor/b.py", ["+hashlib.md5(b)"]), ("c.go", ["+_ = f.Close()"]), ("d.sql", ["+x"]))
    settings = config.load("languages: [python]\nignore: [vendor/]\nanalyzers:\n  security: true\n  errorhandling: true\ncustom_rules:\n  - id: own/x\n    pattern: md5\n")
    got = sorted((r.file, r.id) for r in pipeline.analyse(pipeline.configured(diff, settings)).collect())
    assert got == [("a.py", "own/x"), ("a.py", "security/insecure-crypto")]


def test_an_analyzer_that_fails_costs_only_its_own_issues(spark, monkeypatch):
    from tessella.plans import pipeline
    from tests.test_lines import files

    def broken(ctx):
        raise ValueError("no plan")

    monkeypatch.setitem(pipeline.CHECKS, "spec", (broken,))
    got = pipeline.analyse(pipeline.Context(files(spark, ("a.py", ["+hashlib.md5(b)"]))), ["security", "spec"]).collect()
    assert sorted((r.id, r.severity) for r in got) == [("internal-spec-error", "info"), ("security/insecure-crypto", "warning")]


def test_settings_are_found_above(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert config.discover(str(deep))["block_on"] == "error"
    (tmp_path / config.SETTINGS).write_text("block_on: warning\n")
    assert config.discover(str(deep))["block_on"] == "warning"
    (tmp_path / "a" / config.SETTINGS).write_text("block_on: info\n")
    assert config.discover(str(deep))["block_on"] == "info" and config.discover(str(tmp_path))["block_on"] == "warning"
    (deep / config.TEAM_SETTINGS).write_text("block_on: none\n")
    assert config.discover(str(deep))["block_on"] == "none" and config.discover(str(deep), {"TESSELLA_BLOCK_ON": "error"})["block_on"] == "error"


def test_an_index_is_kept_while_its_files_stay(spark, tmp_path):
    from tessella.sources import tree

    listing = lambda *rows: spark.createDataFrame(list(rows), "path string, size int, changed int")
    a, b, folder = ("a", 1, 1), ("b", 2, 2), str(tmp_path / "i")
    assert tree.load_index(spark, listing(a), folder) is None
    tree.save_index(spark.createDataFrame([("a", "f")], "path string, name string"), listing(a, b), folder)
    assert [tuple(r) for r in tree.load_index(spark, listing(b, a), folder).collect()] == [("a", "f")]
    for other in ((a,), (a, ("b", 2, 3)), (a, b, ("c", 1, 1))):
        assert tree.load_index(spark, listing(*other), folder) is None
