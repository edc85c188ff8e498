"""Files that nobody wrote, by rules and by shared subtrees."""
import pytest

from tessella.llm import provenance as P

CODE = ["def f(x):", "    return x + 1", ""]
MINI = ["!function(e,t){" + "var a=e.b(1);t.c=function(n){return n?a:d(n)};" * 20 + "}"]


@pytest.mark.parametrize(("path", "flag", "lines", "kind"), [
    ("src/a.py", False, CODE, None), (None, None, CODE, None), (None, None, [], None), ("a.png", True, [], "binary"), ("a.py", True, CODE, None), ("a.dat", None, ["\x00\x01\x02" * 50], "binary"), ("x/logo.png", None, [], "binary"),
    ("web/package-lock.json", False, ["{"], "generated"), ("x\\go.sum", False, ["a v1 h1:x="], "generated"), ("api/a.pb.go", False, CODE, "generated"), ("src/__snapshots__/a.tsx.snap", False, CODE, "generated"), ("a/b.js.map", False, ["{}"], "generated"),
    ("a.go", False, ["// Code generated by protoc. DO NOT EDIT.", "package a"], "generated"), ("w.go", False, ['const banner = "// Code generated by %s. DO NOT EDIT."'], None), ("a.go", False, ["// Edit freely; this package is not generated."], None),
    ("a.py", False, ["# Automatisch erzeugt durch x, nicht von Hand bearbeiten", *CODE], "generated"), ("node_modules/x/a.js", False, CODE, "third party"), ("src/vendors/a.js", False, CODE, None), ("lib/min_max.py", False, CODE, None),
    ("a.js", False, ["// Imported from left@1.2.3, local patches: none", *CODE], "third party"), ("a.js", False, ["// Copyright (c) our own company. Licensed under the MIT licence."], None), ("s/app.js", False, MINI, "minified"), ("s/app.min.js", False, CODE, "minified"),
    ("q.ts", False, ["const q = `SELECT " + "aa.bbbbbbb_cc, " * 60 + "`;", *CODE * 5], None), ("d.c", False, ["static const unsigned char D[] = {", *["  0x01, 0xfe, 0x33, 0x04, 0x05,"] * 9, "};"], "data"), ("d.py", False, ["STEPS = [", "    1, 2, 3, 4,", "]", *CODE * 6], None),
    ("rows.json", False, ["[", *['  {"id": 1, "w": 0.5, "k": "ab"},'] * 9, "]"], "data"), ("seed.sql", False, ["INSERT INTO t VALUES (1, 'a');"] * 9, "data"), ("k.pem", False, ["-----BEGIN CERTIFICATE-----", *["QUJD" * 16] * 9], None), ("c.yaml", False, ["a: 1"], None), ("a.py", False, [None, "", "x" * 100_000], None),
])
def test_rules(path, flag, lines, kind):
    assert P.judge(path, flag, lines) == kind


SHAPE = "file_id long, run_id string, path string, is_binary boolean, hunks array<struct<lines:array<struct<content:string,type:string>>>>, kind string, owner string"


def row(i, run, path, texts):
    return (i, run, path, False, [([(t, "added") for t in texts],)], "clash", "clash")


def test_subtrees_shared_by_unrelated_owners(spark):
    lib = {"lib/u/a.py": ["a = 1"], "lib/u/b/c.py": ["c = 3"]}
    rows = [row(10 * n + k, f"r{n}", (f"top{n}/" if n else "") + p, t) for n in range(3) for k, (p, t) in enumerate(lib.items())]
    rows += [row(90, "r0", "src/own.py", ["x"]), row(91, "r1", "src/same.py", ["y"]), row(92, "r2", "src/same.py", ["y"]), row(93, "r3", "lib/u/a.py", ["a = 1"]), row(94, None, "p", ["q"]), row(95, "r1", None, ["q"])]
    owners = spark.createDataFrame([("r0", "o0"), ("r1", "o1"), ("r2", "o2"), ("r3", "o3")], "run_id string, owner string")
    assert sorted(r.file_id for r in P.shared_subtrees(spark.createDataFrame(rows, SHAPE), owners).collect()) == [0, 1, 10, 11, 20, 21]
    one_owner = spark.createDataFrame([(f"r{n}", "same") for n in range(4)], "run_id string, owner string")
    assert P.shared_subtrees(spark.createDataFrame(rows, SHAPE), one_owner).count() == 0


def test_equal_children_do_not_cancel(spark):
    rows = []
    for n in range(3):  # three owners, each with a file delivered twice beside it: nothing is shared
        rows += [row(10 * n, f"r{n}", "lib/own.py", [f"own = {n}"]), row(10 * n + 1, f"r{n}", "lib/own.py", [f"own = {n}"])]
    owners = spark.createDataFrame([(f"r{n}", f"o{n}") for n in range(4)], "run_id string, owner string")
    assert P.unwritten_files(spark.createDataFrame(rows, SHAPE), owners).count() == 0


def test_removed_lines_are_no_part_of_the_tree(spark):
    rows = []
    for n in range(3):
        for k, name in enumerate(("a.py", "b.py")):
            rows.append((10 * n + k, f"r{n}", f"lib/u/{name}", False, [([("x = 1", "added"), (f"old {n}", "removed")],)], "c", "c"))
    owners = spark.createDataFrame([(f"r{n}", f"o{n}") for n in range(3)], "run_id string, owner string")
    assert P.shared_subtrees(spark.createDataFrame(rows, SHAPE), owners).count() == 6


def test_hunks_without_lines_are_no_text(spark):
    rows = [(n, f"r{n}", f"t{n}/a.js", False, [(None,), ([("x", "added")],)], "c", "c") for n in range(2)] + [(9, "r0", "b.js", False, [(None,)], "c", "c"), (8, "r1", "c.js", False, [([(None, None)],)], "c", "c")]
    assert sorted(r.file_id for r in P.shown_files(spark.createDataFrame(rows, SHAPE)).collect()) == [0, 1]


def test_licence_line_needs_a_shared_file(spark):
    header = ["// SPDX-License-Identifier: MIT", "// Copyright (c) 2024 The Kestrel Authors", *CODE]
    assert P.judge("src/a.go", False, header) is None
    rows = [row(1, "r0", "src/a.go", header), row(2, "r1", "lib/a.go", header), row(3, "r2", "x/b.go", [*header, "own"]), row(4, "r0", "p/c.go", CODE), row(5, "r1", "p/c.go", CODE)]
    owners = spark.createDataFrame([(f"r{n}", f"o{n}") for n in range(3)], "run_id string, owner string")
    got = {(r.file_id, r.kind, r.evidence) for r in P.weighed(spark.createDataFrame(rows, SHAPE), owners).collect()}
    assert got == {(1, "third party", "shared file"), (2, "third party", "shared file")}


def test_operator_repeats_and_empty(spark):
    owners = spark.createDataFrame([], "run_id string, owner string")
    rows = [row(1, "r", "node_modules/a.js", ["x"]), row(1, "r", "node_modules/a.js", ["x"]), row(None, "r", "go.sum", ["x"]), (2, None, None, None, None, None, None)]
    assert [tuple(r) for r in P.unwritten_files(spark.createDataFrame(rows, SHAPE), owners).collect()] == [(1, "third party")]
    assert P.unwritten_files(spark.createDataFrame([], SHAPE), owners).count() == 0


def test_very_deep_paths(spark):
    deep = "/".join(["d"] * 40)
    rows = [row(10 * n + k, f"r{n}", f"top{n}/{deep}/{name}", CODE) for n in range(3) for k, name in enumerate(("f.py", "g.py"))]
    owners = spark.createDataFrame([(f"r{n}", f"o{n}") for n in range(3)], "run_id string, owner string")
    assert P.unwritten_files(spark.createDataFrame(rows, SHAPE), owners).count() == 6
