"""A change on the maps of a guide, against a plain recursion over random guides."""

import random

from graphloam.operators import placement as pl


def _frames(spark, guide):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    changed = df([(p, *v) for p, v in guide["changed"].items()], "path string, status string, added long, removed long")
    files = df([(p,) for p in guide["files"]], "path string")
    members, opens = df(guide["members"], "box string, member string"), df(guide["opens"], "box string, view string")
    includes = df(guide["includes"], "view string, ord int, element string")
    return changed, files, members, opens, includes


def _plain(guide, box, seen):
    """The changed files a box holds."""
    if box in seen:
        return set()
    seen.add(box)
    kind, _, path = box.partition(":")
    out = set(guide["changed"]) if box == "repo" else {p for p in guide["changed"] if kind == "file" and p == path or kind == "dir" and p.startswith(path + "/")}
    inner = [m for b, m in guide["members"] if b == box]
    for view in [v for b, v in guide["opens"] if b == box]:
        inner += [e for v, _, e in guide["includes"] if v == view]
        parents = {e.partition(":")[2].rpartition("/")[0] for v, _, e in guide["includes"] if v == view and e.startswith(("file:", "dir:"))}
        for gone in (p for p, (s, *_) in guide["changed"].items() if s == "deleted"):
            at = gone
            while at and at.rpartition("/")[0] not in parents:
                at = at.rpartition("/")[0]
            if at and (at == gone or not any(f.startswith(at + "/") for f in guide["files"])):
                out.add(gone)
    return out.union(*[_plain(guide, m, seen) for m in inner])


def _random(rng):
    paths = sorted({"/".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3]))) + rng.choice([".py", ".go"]) for _ in range(25)})
    changed = {p: (rng.choice(["added", "changed", "deleted"]), rng.randrange(9), rng.randrange(9)) for p in paths if rng.random() < 0.6}
    files = [p for p in paths if changed.get(p, ("",))[0] != "deleted"]
    code = [f"file:{p}" for p in paths] + [f"dir:{d}" for d in ("a", "b", "a/b", "c/a", "b/c")]
    groups, views = [f"grp:{i}" for i in range(6)], [f"view:{i}" for i in range(4)]
    members = sorted({(rng.choice(groups), rng.choice(code + groups)) for _ in range(12)})
    opens = sorted({b: (b, rng.choice(views)) for b in rng.sample(groups + code, 7)}.values())
    includes = [(v, i, e) for v in views for i, e in enumerate(rng.sample(code + groups, 3))]
    return {"changed": changed, "files": files, "members": members, "opens": opens, "includes": includes, "boxes": groups + code + ["repo"]}


def test_held_files_and_status(spark):
    rng = random.Random(2)
    for _ in range(2):
        guide = _random(rng)
        changed, files, members, opens, includes = _frames(spark, guide)
        gone = pl.deleted_on(includes, changed, files)
        edges = pl.holding(members, opens, includes, gone)
        touched = spark.createDataFrame([], "element string, path string, status string")
        boxes = spark.createDataFrame([(x,) for x in guide["boxes"]] * 2 + [(None,)], "element string")
        held = pl.held_files(boxes, edges, touched, changed).collect()
        assert len(held) == len(set(held)) and set(map(tuple, held)) == {(x, p) for x in guide["boxes"] for p in _plain(guide, x, set())}
        now, fresh = guide["files"], {p for p, v in guide["changed"].items() if v[0] == "added"}
        under = lambda d: [p for p in now if p.startswith(d + "/")]  # noqa: E731, B023
        whole = lambda e: e[5:] in fresh if e.startswith("file:") else e.startswith("dir:") and bool(under(e[4:])) and set(under(e[4:])) <= fresh  # noqa: E731, B023
        want = {}
        for x in guide["boxes"]:
            mine = [guide["changed"][p] for p in _plain(guide, x, set())]
            inner = [m for b, m in guide["members"] if b == x]
            states = {s for s, *_ in mine}
            if x.startswith("file:"):
                status = None if states == {"deleted"} else "new" if states == {"added"} else "changed"
            elif x.startswith("grp:") and not inner and states == {"deleted"}:
                status = "removed"
            else:
                status = "new" if x.startswith("dir:") and whole(x) or x.startswith("grp:") and inner and all(map(whole, inner)) and states == {"added"} else "inside"
            if mine and status:
                want[x] = (status, len(mine), sum(v[1] for v in mine), sum(v[2] for v in mine))
        got = pl.lift_opened(boxes, members, edges, touched, files, changed)
        assert {r.element: tuple(r)[1:] for r in got.collect()} == want


def test_ranges_parts_and_places(spark):
    df = spark.createDataFrame
    changed = df([("m.py", "changed", 3, 1), ("new.py", "added", 9, 0), ("old.py", "deleted", 0, 4), (None, "added", 1, 1)], "path string, status string, added long, removed long")
    hunks = df([("m.py", 10, 3, 0), ("m.py", 40, 1, 1)], "path string, new_start int, new_lines int, old_lines int")
    ranges = df(
        [("sym:m.py#f", "m.py", 10, 12, False), ("sym:m.py#g", "m.py", 38, 45, None), ("sym:m.py#h", "m.py", 60, 70, False), ("sym:new.py#n", "new.py", 1, 9, False), ("grp:a", "m.py", 61, 62, False), ("grp:b", "old.py", None, None, True), ("grp:c", "m.py", None, None, False), ("grp:a", "m.py", 41, 44, True)],
        "element string, path string, start_line int, end_line int, base boolean",
    )
    touched = pl.touched_ranges(ranges, changed, hunks)
    assert {tuple(r) for r in touched.collect()} == {("sym:m.py#f", "m.py", "new"), ("sym:m.py#g", "m.py", "changed"), ("sym:new.py#n", "new.py", "new"), ("grp:b", "old.py", "changed"), ("grp:c", "m.py", "changed")}
    none = df([], "box string, member string")
    boxes = df([(e,) for e in ("sym:m.py#f", "sym:m.py#h", "grp:b", "grp:c", "dir:x")], "element string")
    got = pl.lift_opened(boxes, none, df([], "src string, dst string"), touched, df([("m.py",), ("new.py",)], "path string"), changed)
    assert {tuple(r) for r in got.collect()} == {("sym:m.py#f", "new", 1, 3, 1), ("grp:b", "removed", 1, 0, 4), ("grp:c", "inside", 1, 3, 1)}

    views = df([("view:design", "graph", 0), ("view:x", "graph", 1), ("view:top", "graph", 2), ("view:in", "graph", 3), ("view:flow", "flow", 4)], "view string, type string, ord int")
    includes = df([("view:top", 0, "b1"), ("view:top", 1, "b2"), ("view:in", 0, "file:m.py"), ("view:top", 2, "file:m.py"), ("view:top", 3, "b3")], "view string, ord int, element string")
    opens = df([("b1", "view:in"), ("b2", "view:x"), ("b3", "view:in"), ("b3", "view:flow")], "box string, view string")
    assert [tuple(r) for r in pl.part_views(views, includes, opens).orderBy("ord").collect()] == [("view:in", 0), ("view:x", 1)]
    assert [r.view for r in pl.part_views(views, includes, opens.limit(0)).collect()] == ["view:x"] and pl.part_views(views.limit(0), includes, opens).count() == 0
    depth = df([("view:top", 0, 2), ("view:in", 1, 3)], "view string, depth int, ord int")
    assert [tuple(r) for r in pl.drawn_on(includes, depth, changed).collect()] == [("m.py", "view:in")]
    held = pl.held_files(boxes, df([], "src string, dst string"), touched, changed)
    assert {r.path for r in pl.elsewhere(changed.filter("path is not null"), held, boxes).collect()} == {"new.py"}

    files = df([("a/x.py", "python"), ("a/x_test.py", "python"), ("b/y.py", "python"), ("c/z.json", "json"), ("d/w.py", None), ("e/v.py", "python")], "path string, language string")
    fresh = files.selectExpr("path", "'added' as status").unionByName(files.selectExpr("path", "'added' as status"))
    assert {r.path for r in pl.unassigned_files(fresh, df([("design:1", "dir:b"), ("design:1", "dir:a/x")], "box string, member string"), files, ("e/**",)).collect()} == {"a/x.py"}


def test_boxes_that_open_nothing_need_no_closure(spark, monkeypatch):
    df, seen = spark.createDataFrame, []
    real = pl.closure
    monkeypatch.setattr(pl, "closure", lambda edges, seeds, *a, **k: seen.append(sorted(r.seed for r in seeds.collect())) or real(edges, seeds, *a, **k))
    changed = df([("a/b/x.py",), ("a/y.py",), ("a/y.py",), (None,)], "path string")
    touched = df([("sym:f", "a/y.py", "new"), ("sym:f", "a/y.py", "new"), ("file:a/y.py", "a/y.py", "changed")], "element string, path string, status string")
    boxes = df([("file:a/y.py",), ("dir:a",), ("dir:a",), ("dir:a/b",), ("grp:g",), ("sym:f",), ("gone:a/y.py",), (None,)], "element string")
    edges = df([("grp:g", "dir:a/b"), ("grp:g", "sym:f"), ("grp:g", "dir:a"), ("other", "dir:a")], "src string, dst string")
    held = sorted(tuple(r) for r in pl.held_files(boxes, edges, touched, changed).collect())
    assert held == [("dir:a", "a/b/x.py"), ("dir:a", "a/y.py"), ("dir:a/b", "a/b/x.py"), ("file:a/y.py", "a/y.py"), ("gone:a/y.py", "a/y.py"), ("grp:g", "a/b/x.py"), ("grp:g", "a/y.py"), ("sym:f", "a/y.py")]
    assert seen == [["grp:g"]]
    whole = pl.held_files(df([("repo",)], "element string"), edges, touched, changed)
    assert sorted(tuple(r) for r in whole.collect()) == [("repo", "a/b/x.py"), ("repo", "a/y.py")]
