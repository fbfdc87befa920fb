"""Rules over guides, by hand."""

from graphloam.operators import guide_lint as gl


def test_summaries(spark):
    long, mid = "word " * 46, "word " * 45
    rows = [("a", "summary", long), ("b", "summary", mid), ("c", "summary", "One. Two. Three."), ("d", "summary", "TODO " + long), ("e", "summary", "# Top\nsee [the file](./x.md)"), ("f", "summary", None), ("g", "summary", "  "), ("h", "summary", "`one. two. three.` is code"), ("i", "detail", "w " * 81), ("j", "detail", "w " * 50 + "\n\n" + "w " * 50), ("k", "detail", "w " * 50 + "\n- " + "w " * 50), ("l", "detail", "# Top " + "w " * 90), ("m", "summary", "#no heading, a[x](y)")]
    got = {tuple(r) for r in gl.lint_summaries(spark.createDataFrame(rows, "element string, field string, text string")).collect()}
    assert got == {("long-summary", "a", "summary", 46), ("long-summary", "c", "summary", 3), ("markdown-in-summary", "e", "summary", 2), ("long-detail", "i", "detail", 81), ("long-detail", "l", "detail", 92)}


def test_steps(spark):
    rows = [("t", 1, "### Good\nText.", True), ("t", 2, None, None), ("t", 3, "Short one. " + "More. " * 40, False), ("t", 4, "x" * 81, False), ("t", 5, "\n### T\n" + "y" * 281, True), ("t", 6, "### only", True), ("t", 7, "z" * 300, None)]
    got = {tuple(r) for r in gl.lint_steps(spark.createDataFrame(rows, "tour string, step int, note string, talk boolean")).collect()}
    assert got == {("untitled-step", "t", 2, 0), ("note-heading", "t", 3, 10), ("untitled-step", "t", 4, 81), ("long-talk-note", "t", 5, 281), ("untitled-step", "t", 7, 300)}


def test_far_ranges(spark):
    schema = "step string, ord int, file string, start_line int, end_line int"
    ranges = [("s", i, "f", 100 * i, 100 * i + 5) for i in range(4)] + [("s", 9, "a", 100 * i, 100 * i + 5) for i in range(5)] + [("u", i, "f", 40 * i, 40 * i) for i in range(9)] + [("v", 0, "f", 0, 900), ("v", 1, "f", 100, 101), ("v", 2, "f", 500, 501), ("v", 3, "f", 941, 950)]
    assert [tuple(r) for r in gl.far_ranges(spark.createDataFrame(ranges, schema)).collect()] == [("s", "f", 4)]
    assert gl.far_ranges(spark.createDataFrame([], schema)).count() == 0
