"""Smaller derivations that have no query of their own over the driver's tables."""

from pyspark.sql import functions as F

from graphloam.operators import merge, rules, search
from graphloam.operators import views as vw


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_innermost_by_line_and_column(spark):
    ranges = frame(spark, "file string, id string, s_line int, s_col int, e_line int, e_col int", ("f", "out", 1, 1, 9, 1), ("f", "in", 2, 5, 2, 20), ("f", "late", 2, 8, 3, 1))
    points = frame(spark, "p int, file string, line int, col int", (1, "f", 2, 6), (2, "f", 2, 3), (3, "f", 2, 9), (4, "f", 9, 2))
    assert {r.p: r.id for r in vw.innermost_at(points, ranges, ["p"]).collect()} == {1: "in", 2: "out", 3: "in"}


def test_containers_and_entries(spark):
    rows = frame(spark, "c string, f string, want boolean", ("repo", "a/b", True), ("dir:a", "a/b", True), ("dir:a", "ab/c", False), ("file:a/b", "a/b", True), ("grp:x", "a/b", False))
    assert all(r[0] == r[1] for r in rows.select(vw.contains_code(F.col("c"), F.col("f")), "want").collect())
    paths = frame(spark, "p string, l string, t string", ("src/main.go", "go", ""), ("vite.config.ts", "typescript", ""), ("x/util.py", "python", "a\nif __name__ == '__main__':\n"), ("x/util.py", "python", "a"), ("bin/t.rb", "ruby", ""))
    assert [r[0] for r in paths.select(vw.is_entry(F.col("p"), F.col("l"), F.col("t"))).collect()] == [True, True, True, False, True]


def test_comments_and_imports(spark):
    lines = frame(spark, "file string, line int, line_text string", ("a", 1, "// First"), ("a", 2, "// second"), ("a", 3, "code()"), ("a", 4, "// later"), ("b", 1, "x = 1"), ("b", 2, "from os.path import join"), ("b", 3, "import { a } from './m'"), ("b", 4, "const fs = require('fs')"))
    assert {r.file: r.comment for r in vw.header_comment(lines).collect()} == {"a": "First second"}
    assert {(r.line, r.module) for r in vw.imports_of(lines).collect()} == {(2, "os.path"), (3, "./m"), (4, "fs")}
    typed = frame(spark, "l string, n string", ("  name: string;", "name"), ("count int", "count"), ("x = 3", "x"))
    assert [r[0] for r in typed.select(vw.member_type(F.col("l"), F.col("n"))).collect()] == ["string", "int", None]


def test_kinds_with_their_containers(spark):
    syms = frame(spark, "id string, kind string", ("f", "other"), ("A", "class"), ("A.m", "method"), ("B", "class"))
    up = frame(spark, "node string, ancestor string, level int", ("A.m", "A.m", 0), ("A.m", "A", 1), ("A.m", "f", 2), ("B", "B", 0), ("A", "A", 0))
    assert {r.id for r in vw.of_kinds(syms, ["method"], up).collect()} == {"f", "A", "A.m"}


def test_sites_that_nobody_knew(spark):
    sites = frame(spark, "site int, file string, line int, src string, dst string", (1, "f", 3, "a", "b"), (2, "f", 3, "a", "c"), (3, "f", 99, "a", "d"))
    ranges = frame(spark, "file string, id string, start_line int, end_line int", ("f", "big", 1, 10), ("f", "small", 2, 4))
    known = frame(spark, "src string, dst string", ("a", "b"))
    assert [(r.site, r.inside) for r in vw.keep_blind(sites, known, ranges).collect()] == [(2, "small")]


def test_anchors_of_a_document(spark):
    kind = "id string, anchors array<struct<file:string,start_line:int>>"
    got = vw.collect_anchors(frame(spark, kind, ("n", [("f", 1), ("g", 2)])), frame(spark, kind, ("e", [("f", 3)]), ("none", [])))
    assert {tuple(r) for r in got.collect()} == {("node:n", 0, "f", 1), ("node:n", 1, "g", 2), ("edge:e", 0, "f", 3)}


def test_patches_respect_owners(spark):
    old = frame(spark, "id int, user_fields array<string>, a string, b string", (1, ["a"], "mine", "x"), (2, [], "p", "q"))
    new = frame(spark, "id int, clear_fields array<string>, a string, b string", (1, [], "theirs", "y"), (2, ["a"], None, None), (3, [], "n", None))
    assert {tuple(r) for r in merge.apply_patch(old, new, "id", ["a", "b"]).select("id", "a", "b").collect()} == {(1, "mine", "y"), (2, None, "q"), (3, "n", None)}


def test_wording_rules_skip_code(spark):
    fields = frame(spark, "element int, field string, text string", (1, "note", "It is `very` done"), (2, "note", "TODO write"), (3, "title", "a b c d e f g h i"))
    found = {(r.rule, r.element) for r in rules.lint_wording(fields).collect()}
    assert ("bare-it", 1) in found and ("todo-left", 2) in found and ("filler-word", 1) not in found
    assert {(r.rule, r.element) for r in rules.lint_lengths(fields).collect()} == {("long-title", 3)}


def test_pages_and_catalogue(spark):
    hits = frame(spark, "file string, line int", *[("f", i) for i in range(20)])
    assert [r.place for r in search.page(hits, ["file", "line"], 5, 3).orderBy("place").collect()] == [6, 7, 8]
    assert search.page(hits, ["file", "line"], 18, 0).count() == 2
    guides = frame(spark, "guide string, views array<string>, questions array<string>, roots array<string>", ("g", ["v"], ["q", "q"], ["b", "a"]))
    assert tuple(search.guide_catalog(guides).first()) == ("g", "single", ["q"], ["a", "b"])
