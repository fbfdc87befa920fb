"""Graph operators against plain versions on random worlds."""

import inspect
import random
from collections import Counter, defaultdict

import pytest

from graphloam.functions import diff as df
from graphloam.operators import change as ch
from graphloam.operators import closure as cl
from graphloam.operators import drift
from graphloam.operators import hierarchy as hi
from graphloam.operators import projection as pr
from graphloam.operators import resolve as rs
from graphloam.operators import view as vw
from graphloam.operators import views


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- components and trees --------------------------------------------------------------


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: reach(x) for x in nodes}
    return sorted((x, min([x] + [y for y in far[x] if x in far[y]])) for x in nodes)


@pytest.mark.parametrize("seed", [2, 3])
def test_strong_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range([30, 45, 60, 90, 140, 55][seed])}
    edges |= {(f"w{i}", f"w{i + 1}") for i in range(9)} | {("w9", "v01"), ("v02", "w0")}
    found = cl.strong_components(spark.createDataFrame(sorted(edges), "src string, dst string"))
    assert rows(found) == plain_components({e for e in edges if e[0] != e[1]})


def test_strong_components_of_rings_and_chains(spark):
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    tail = [(i, i + 1) for i in range(5000, 7000)] + [(7000, 10), (20, 9000)] + [(i, i + 1) for i in range(9000, 9500)]
    found = dict(rows(cl.strong_components(spark.createDataFrame(ring + tail, "src long, dst long"))))
    assert all(found[i] == 0 for i in range(3000)) and all(found[i] == i for i in (5000, 6000, 7000, 9000, 9500))
    assert cl.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_tree(refs, hops, root, depth, children):
    edges = Counter(refs)
    out, opened, frontier = [], {root}, [(root, (root,))]
    has = {a for a, _ in edges} | {a for a, _ in hops}

    def meet(found, taken, last, hop, level):
        new = {}
        for parent, node, n, path in sorted(found, key=lambda f: f[0]):
            note = "cycle" if node in path else "seen" if node in taken else "seen" if node in new and not last else None
            if note is None:
                new.setdefault(node, path + (node,)) if not last else new.setdefault((parent, node), path + (node,))
            out.append((root, parent, node, level, hop, None if note == "seen" and node not in has else note, n))
        return [(k if not last else k[1], p) for k, p in new.items()]

    for level in range(1, depth + 1):
        last, found = level == depth, []
        for node, path in frontier:
            kids = sorted(((-n, b) for (a, b), n in edges.items() if a == node))
            found += [(node, b, -n, path) for n, b in kids[:children]]
            if len(kids) > children:
                out.append((root, node, None, level, False, "more", len(kids) - children))
        step = meet(found, opened, last, False, level)
        new, taken = list(step), set(opened) if last else opened | {x for x, _ in step}
        while step:
            step = meet([(a, b, 0, path) for node, path in step for a, b in set(hops) if a == node], taken, last, True, level)
            new += step
            taken = taken if last else taken | {x for x, _ in step}
        frontier, opened = new, taken
    return out


@pytest.mark.parametrize("seed", [0])
def test_ref_tree_against_a_plain_one(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"s{rng.randrange(14):02}"
    refs, hops = [(name(), name()) for _ in range(40)], [(name(), name()) for _ in range(6)]
    roots = ["s00", "s01", "s02"]
    expected = [r for root in roots for r in plain_tree(refs, hops, root, 3, 2)]
    got = cl.ref_tree(spark.createDataFrame(refs, "src string, dst string"), spark.createDataFrame(hops, "src string, dst string"), spark.createDataFrame([(r,) for r in roots], "seed string"), 3, 2)
    assert rows(got) == sorted(expected, key=str)


def test_chains_of_any_length(spark):
    tree = [("0000", None)] + [(f"{i:04}", f"{i - 1:04}") for i in range(1, 140)] + [("leaf a", "0139"), ("leaf b", "0139")]
    parents = spark.createDataFrame(tree, "node string, parent string")
    assert dict(rows(hi.single_child_chain(parents)))["0000"] == "0139"
    folders = spark.createDataFrame([(f"{i:04}",) for i in range(50)], "node string")
    found = dict(rows(hi.single_child_chain(parents, folders)))
    assert found["0000"] == "0049" and found["0100"] == "0100"
    paths = spark.createDataFrame([("g", "/".join(["x"] + ["p"] * 20)), ("g", "/".join(["y"] + ["p"] * 20)), ("g", "p"), ("h", "a/b"), ("h", "c/b")], "g string, path string")
    labels = {(r.g, r.path): r.label for r in pr.distinguish(paths, "g", "path").collect()}
    assert len(set(labels.values())) == 5 and labels["h", "a/b"] == "a/b" and labels["g", "p"] == "p"


def test_names_through_eight_more_files(spark):
    exports = spark.createDataFrame([(f"f{i}", "n", f"f{i + 1}", "n") for i in range(9)], "file string, name string, from_file string, from_name string")
    stars = spark.createDataFrame([], "file string, from_file string")
    for last, found in ((8, 1), (9, 0)):
        direct = spark.createDataFrame([(f"f{last}", "n", "target")], "file string, name string, target string")
        assert rs.exported_names(spark.createDataFrame([("f0", "n")], "file string, name string"), direct, exports, stars).count() == found


def test_overrides_and_groups_without_a_bound(spark):
    n = 7
    assert inspect.signature(rs.overridden_by).parameters["max_depth"].default is None
    bases = spark.createDataFrame([(f"t{i}", f"t{i + 1}", True) for i in range(n)], "type string, base string, precise boolean")
    methods = spark.createDataFrame([("low", "t0", "m"), ("high", f"t{n}", "m")], "id string, type string, name string")
    assert rows(rs.overridden_by(methods, bases)) == [("low", "high", True, n)]


def test_implementations_of_members(spark):
    symbols = [
        ("I", "a/i.go", "I", "interface"), ("I.run", "a/i.go", "I.run", "method"), ("J", "a/i.go", "J", "interface"), ("J.stop", "a/j.go", "J.stop", "method"),
        ("T", "b/t.go", "T", "class"), ("T.run", "b/t.go", "T.run", "method"), ("T.stop", "b/other.go", "T.stop", "method"), ("T.stop2", "c/t.go", "T.stop", "method"),
        ("U", "b/u.py", "U", "class"), ("U.run", "b/u2.go", "U.run", "method"), ("V", "b/v.go", "V", "class"), ("V.run", "b/v.go", "V.run", "method"),
    ]
    world = spark.createDataFrame([(i, f, f.split("/")[0], f.split(".")[-1], p, k) for i, f, p, k in symbols], "id string, file string, folder string, language string, path string, kind string")
    refs = [("J", "I", "extends", "precise"), ("T", "J", "implements", "precise"), ("U", "I", "implements", "heuristic"), ("V.run", "I.run", "implements", "heuristic"), ("T", "I", "implements", "heuristic")]
    got = rows(rs.implementations(world, spark.createDataFrame(refs, "src string, dst string, kind string, resolution string")))
    assert got == sorted([("I", "T", "precise"), ("I", "U", "heuristic"), ("J", "T", "precise"), ("I.run", "T.run", "precise"), ("J.stop", "T.stop", "precise"), ("I.run", "V.run", "heuristic")], key=str)


# ---- differences -----------------------------------------------------------------------


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [10**8, 0])
def test_hunks_turn_one_text_into_the_other(monkeypatch, cells):
    monkeypatch.setattr(df, "ANCHOR_CELLS", cells)
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = df.matched(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if cells:
            assert len(pairs) == longest(a, b)
        out, at = [], 0
        for old, n, new, m in df.hunks(a, b):
            begin = old - 1 if n else old
            out += a[at:begin] + b[new - 1 : new - 1 + m] * bool(m)
            at = begin + n
        assert out + a[at:] == b


def test_words_beyond_the_table_are_still_aligned(monkeypatch):
    old, new = [f"w{i % 50}" for i in range(900)], [f"w{i % 50}" for i in range(900) if i % 9]
    removed, added = df.changed_words(" ".join(old), " ".join(new))
    assert len(removed) == 100 and not added


def test_rewritten_lines(spark):
    pairs = spark.createDataFrame([(1, "keep\n  total = add(a, b)\nold line\nkeep", "keep\n    total = add(a, c)\nkeep"), (2, "x", "y"), (3, None, "a\nb"), (4, "same", "same"), (5, "p\nq", None)], "k int, old string, new string")
    assert rows(ch.rewritten_lines(pairs, "k", "old", "new")) == [(1, 2, 2), (2, 1, 1)]
    assert rows(ch.diff_hunks(pairs, "k", "old", "new")) == [(1, 2, 2, 2, 1), (2, 1, 1, 1, 1), (3, 1, 1, 1, 2), (5, 1, 2, 1, 1)]
    assert df.aligned(["a"] * 81, ["a"] * 81) == []


# ---- a view ----------------------------------------------------------------------------


def plain_view(world, include, hidden, excluded, dispatch, stored, most):
    """The rules of a view one reference at a time, over dictionaries."""
    kind, parent, file, members = world["kind"], world["parent"], world["file"], world["members"]
    inc = {i for i in include if i in kind}
    groups = defaultdict(set)
    for g, m in members:
        groups[m].add(g)

    def up(x):
        while x is not None:
            yield x
            x = parent.get(x)

    def group_of(x):
        seen, front = {x}, sorted(groups[x])
        while front:
            hit = [g for g in front if g in inc]
            if hit:
                return hit[0]
            nxt = set()
            for g in front:
                seen.add(g)
                nxt |= groups[g] - seen
            front = sorted(nxt)
        return None

    def walk(x, skip):
        for cur in up(x):
            if cur in inc and not (skip and cur == x):
                return cur
            g = group_of(cur)
            if g is not None and g != x:
                return g
        return None

    rep = lambda x: walk(x, False)
    over = {i: walk(i, True) for i in inc}
    for start in sorted(inc):
        path, cur = set(), start
        while cur is not None:
            if cur in path:
                over[cur] = None
                break
            path.add(cur)
            cur = over[cur]

    def above(x):
        out, x = [], over.get(x)
        while x is not None:
            out.append(x)
            x = over.get(x)
        return out

    nested = lambda a, b: b in above(a) or a in above(b)
    cover, todo, done = set(), list(inc), set()
    while todo:
        x = todo.pop()
        if x not in done:
            done.add(x)
            cover |= set(up(x))
            todo += [m for g, m in members if g == x]
    named = {file[x] for x in done if file.get(x)}
    out_of = lambda x: file.get(x) in excluded and file.get(x) not in named

    def target(x):
        best = x
        if kind[x] != "group":
            for a in list(up(x))[1:]:
                if a == "repo" or a in cover:
                    break
                best = a
        return best

    def holds(outer, inner):
        seen, front = set(), list(up(inner))
        while front:
            y = front.pop()
            if y not in seen:
                seen.add(y)
                front += list(up(y)) + list(groups[y])
        return outer in seen

    arrows, stubs = defaultdict(list), defaultdict(lambda: [0, set()])

    def stub(way, inside, outside, k):
        t = target(outside)
        if not holds(t, inside) and not holds(inside, t):
            stubs[way, inside, t][0] += 1
            stubs[way, inside, t][1].add(k)

    through = defaultdict(set)
    for s in stored:
        a, b = rep(s["src"]), rep(s["dst"])
        if a and b:
            through[a] |= set(s["via"])
            through[b] |= set(s["via"])
    for src, dst, k, res in world["refs"]:
        if out_of(src) or out_of(dst):
            continue
        a, b = rep(src), rep(dst)
        if a and k == "calls" and len(dispatch.get(dst, [])) == 1:
            to, trust = dispatch[dst][0]
            c = rep(to)
            if c and not out_of(to) and c not in (a, b) and not nested(a, c):
                arrows[k, a, c].append(res if trust == "precise" else "heuristic")
        if a and b:
            if (a == b and not (k == "calls" and src == dst == a)) or nested(a, b):
                continue
            arrows[k, a, b].append(res)
        elif a and not any(holds(v, dst) for v in through[a]):
            stub("out", a, dst, k)
        elif b and not a and not any(holds(v, src) for v in through[b]):
            stub("in", b, src, k)
    edges = {f"edge:derived:{k}:{a}->{b}": [k, a, b, len(r), r[0] if len(set(r)) == 1 else "mixed", False, None] for (k, a, b), r in arrows.items()}
    lifted = {}
    for s in sorted(stored, key=lambda s: s["id"]):
        if s["id"] in edges and not edges[s["id"]][5]:
            edges[s["id"]][5:] = [True, s["label"]]
            continue
        a, b = rep(s["src"]), rep(s["dst"])
        own = a == s["src"] and b == s["dst"]
        if a and b:
            if (a == b and not own) or nested(a, b):
                continue
            key = (s["kind"], a, b)
            if not own and key in lifted:
                first = edges[lifted[key]]
                first[3] += 1
                first[6] = first[6] if first[6] == s["label"] else None
                continue
            if not own:
                lifted[key] = s["id"]
            edges[s["id"]] = [s["kind"], a, b, 1, s["origin"] if s["origin"] in ("llm", "user") else "static", True, s["label"]]
        elif a:
            stub("out", a, s["dst"], s["kind"])
        elif b:
            stub("in", b, s["src"], s["kind"])
    items = []
    for (way, inside, t), (n, kinds) in stubs.items():
        key = f"rest:{file[t]}" if kind[t] in ("symbol", "file") and file[t] in cover else t
        if not {inside, t, key} & hidden:
            items.append((way, inside, key, n, kinds))
    total = Counter()
    for _, _, key, n, _ in items:
        total[key] += n
    top = {k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]}
    final = defaultdict(lambda: [0, set()])
    for way, inside, key, n, kinds in items:
        row = final[way, inside, key if key in top else f"more:{way}"]
        row[0] += n
        row[1] |= kinds

    def visible(x):
        return next((p for p in above(x) if p not in hidden), None)

    boxes = {i: visible(i) for i in inc - hidden}
    return (
        sorted(((i, p, i in boxes.values()) for i, p in boxes.items()), key=str),
        sorted(((i, *e) for i, e in edges.items() if not {i, e[1], e[2]} & hidden), key=str),
        sorted(((*k, n, sorted(kinds)) for k, (n, kinds) in final.items()), key=str),
    )


def random_world(rng):
    kind, parent, file = {"repo": "repo"}, {}, {}
    for d in range(4):
        kind[f"dir:{d}"], parent[f"dir:{d}"] = "dir", "repo" if d < 3 else "dir:0"
        for f in range(2):
            x = f"file:{d}{f}"
            kind[x], parent[x], file[x] = "file", f"dir:{d}", x
            for s in range(3):
                y = f"sym:{d}{f}{s}"
                kind[y], parent[y], file[y] = "symbol", x if s < 2 else f"sym:{d}{f}0", x
    members = set()
    for g in ("group:a", "group:b", "group:c"):
        kind[g] = "group"
        members |= {(g, rng.choice([x for x in kind if x != g and x != "repo"])) for _ in range(2)}
    members |= {("group:a", "group:b")} if rng.random() < 0.5 else set()
    members |= {("group:b", "group:a")} if rng.random() < 0.5 else set()
    syms = [x for x in kind if kind[x] in ("symbol", "file")]
    refs = [(rng.choice(syms), rng.choice(syms), rng.choice(["calls", "references"]), rng.choice(["precise", "heuristic"])) for _ in range(120)]
    return {"kind": kind, "parent": parent, "file": file, "members": members, "refs": refs}


@pytest.mark.parametrize("seed", [0, 4])
def test_view_against_the_rules_one_by_one(spark, seed):
    rng = random.Random(seed)
    w = random_world(rng)
    ids = sorted(w["kind"])
    include = set(rng.sample([x for x in ids if x != "repo"], 8)) | {"no such"}
    hidden = set(rng.sample(sorted(include), 1)) | {rng.choice(ids)}
    excluded = set(rng.sample([x for x in ids if x.startswith("file:")], 2))
    syms = [x for x in ids if x.startswith("sym:")]
    dispatch = {s: [(rng.choice(syms), rng.choice(["precise", "heuristic"])) for _ in range(rng.choice([1, 1, 2]))] for s in rng.sample(syms, 8)}
    dispatch = {s: list({t: (t, r) for t, r in v}.values()) for s, v in dispatch.items()}
    pick = [x for x in ids if x != "repo"]
    stored = [{"id": f"e{i}", "src": rng.choice(pick), "dst": rng.choice(pick), "kind": "flow", "origin": rng.choice(["llm", "user", "file"]), "label": rng.choice(["x", "y"]), "via": rng.sample(pick, rng.choice([0, 1]))} for i in range(12)]
    a = sorted(include - {"no such"})
    stored += [{"id": f"edge:derived:calls:{x}->{y}", "src": x, "dst": y, "kind": "calls", "origin": "user", "label": "over", "via": []} for x in a[:4] for y in a[4:]]
    expected = plain_view(w, include, hidden, excluded, dispatch, stored, 3)

    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    ancestors = []
    for x in ids:
        y, level = x, 0
        while y is not None:
            ancestors.append((x, y, level))
            y, level = w["parent"].get(y), level + 1
    groups = defaultdict(set)
    for g, m in w["members"]:
        groups[m].add(g)
    reach = []
    for m in ids:
        seen, front, depth = {m}, groups[m], 1
        while front:
            reach += [(m, g, depth) for g in front]
            seen |= front
            front, depth = {h for g in front for h in groups[g]} - seen, depth + 1
    got = vw.derive_graph(
        frame([(x, w["kind"][x], w["file"].get(x)) for x in ids], "id string, kind string, file string"),
        frame(ancestors, "node string, ancestor string, level int"),
        frame([(*r, w["file"][r[0]], w["file"][r[1]]) for r in w["refs"]], "src string, dst string, kind string, resolution string, src_file string, dst_file string"),
        frame([(x,) for x in include], "element string"),
        memberships=frame(reach, "member string, grp string, sub_level int"),
        hidden=frame([(x,) for x in hidden], "element string"),
        excluded=frame([(x,) for x in excluded], "file string"),
        dispatch=frame([(s, t, r, w["file"][t]) for s, v in dispatch.items() for t, r in v], "dst string, target string, resolution string, target_file string"),
        stored=frame([tuple(s[c] for c in ("id", "src", "dst", "kind", "origin", "label", "via")) for s in stored], "id string, src string, dst string, kind string, origin string, label string, via array<string>"),
        most=3,
    )
    assert rows(got.nodes) == expected[0]
    assert rows(got.edges) == expected[1]
    assert rows(got.stubs) == expected[2]


def test_view_makes_what_is_asked_for(spark, monkeypatch):
    frame = spark.createDataFrame
    nodes = frame([("repo", "dir", None), ("file:a", "file", "file:a"), ("file:b", "file", "file:b"), ("file:c", "file", "file:c")], "id string, kind string, file string")
    above = frame([(f"file:{x}", *y) for x in "abc" for y in ((f"file:{x}", 0), ("repo", 1))] + [("repo", "repo", 0)], "node string, ancestor string, level int")
    refs = frame([("file:a", "file:b", "calls", "precise", "file:a", "file:b"), ("file:a", "file:b", "calls", "heuristic", "file:a", "file:b"), ("file:a", "file:c", "calls", None, "file:a", "file:c")], "src string, dst string, kind string, resolution string, src_file string, dst_file string")
    include = frame([("file:a",), ("file:b",)], "element string")
    unread = refs.withColumn("kind", vw.F.raise_error(vw.F.lit("references were read")).cast("string"))
    assert rows(vw.derive_graph(nodes, above, unread, include).nodes) == [("file:a", None, False), ("file:b", None, False)]
    got = vw.derive_graph(nodes, above, refs, include)
    with monkeypatch.context() as patch:
        patch.delattr(vw, "ghost_targets_of")
        assert [r[1:6] for r in rows(got.edges)] == [("calls", "file:a", "file:b", 2, "mixed")]
    assert rows(got.stubs) == [("out", "file:a", "file:c", 1, ["calls"])]


def test_default_view_and_stubs_that_open(spark):
    tree = [("repo", None), ("dir:src", "repo"), ("dir:src/app", "dir:src"), ("dir:src/app/a", "dir:src/app"), ("file:x", "dir:src/app"), ("file:y", "dir:src/app/a"), ("sym:y.f", "file:y")]
    parents = spark.createDataFrame(tree, "node string, parent string")
    folders = spark.createDataFrame([(n,) for n, _ in tree if n == "repo" or n.startswith("dir:")], "node string")
    found = lambda depth, root="repo": [r[0] for r in rows(vw.default_include(parents, folders, depth, root))]
    assert found(0) == ["repo"] and found(1) == ["dir:src/app/a", "file:x"] and found(2) == ["file:x", "file:y"] and found(3) == ["file:x", "sym:y.f"]
    assert found(1, "file:x") == ["file:x"] and found(1, "none") == []
    include = spark.createDataFrame([("file:x",)], "element string")
    assert rows(vw.expand_stub(include, "dir:src")) == [("dir:src",), ("file:x",)] and rows(vw.expand_stub(include, "rest:file:y")) == [("file:x",)]
    assert views.type_groups(spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")).select("grp").distinct().count() == 1


def test_file_suggestions_against_all_pairs(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    files = sorted({f"{rng.choice('xyz')}/{name()}.{rng.choice(['ts', 'py'])}" for _ in range(300)}) + [".env", "a/.env"]
    wanted = [f"q/{name()}.ts" for _ in range(60)] + ["q/.env"]
    expected = []
    for w in set(wanted):
        base = w.split("/")[-1]
        stem = base.rsplit(".", 1)[0]
        tiers = sorted((0 if f.split("/")[-1] == base else 1, f) for f in files if f.split("/")[-1] == base or (stem and stem in f.split("/")[-1]))
        expected += [(w, f, t) for t, f in tiers[:5]]
    got = drift.suggest_files(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame([(f,) for f in files], "file string"))
    assert rows(got.select("wanted", "file", "tier")) == sorted(expected, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_states_inside_blocks(spark):
    rng = random.Random(12)
    lines, uses, expected = [], [], Counter()
    for f in range(4):
        own = [(f, n, rng.randrange(4) * 2, rng.choice("abc"), rng.choice(["test", "set", "none"])) for n in range(1, 120) if rng.random() < 0.9]
        lines += [r[:3] for r in own]
        uses += [(r[0], r[1], r[3], r[4]) for r in own if r[4] != "none"]
        for i, (_, n, _, state, action) in enumerate(own):
            if action == "set":
                for j in range(i - 1, -1, -1):
                    _, _, level, before, what = own[j]
                    if what == "test" and all(r[2] > level for r in own[j + 1 : i + 1]):
                        if before != state:
                            expected[before, state, f] += 1
                        break
    got = views.block_transitions(spark.createDataFrame(lines, "file int, line int, indent int"), spark.createDataFrame(uses, "file int, line int, state string, action string"))
    assert rows(got) == sorted(((*k, n) for k, n in expected.items()), key=str)


def test_method_order_is_that_of_python(spark):
    rng = random.Random(21)
    made, bases, expected = {"object": object}, [], {"object": ["object"]}
    for i in range(60):
        name, own = f"t{i}", rng.sample(sorted(set(made) - {"object"}), min(rng.randrange(4), len(made) - 1)) or ["object"]
        bases += [(name, b, n) for n, b in enumerate(own)]
        try:
            made[name] = type(name, tuple(made[b] for b in own), {})
            expected[name] = [c.__name__ for c in made[name].__mro__]
        except TypeError:
            expected[name] = None
    bases += [("bad", "loop", 0), ("loop", "bad", 0), ("over", "loop", 0)]
    expected |= {"bad": None, "loop": None, "over": None, "alone": ["alone"]}
    assert None in [v for k, v in expected.items() if k.startswith("t")]
    got = rs.method_order(spark.createDataFrame([("alone",)], "type string"), spark.createDataFrame(bases, "type string, base string, ord int"))
    assert {r.type: r.order for r in got.collect()} == expected


def test_types_with_the_same_bases_are_merged_once(spark, monkeypatch):
    shared = [(f"x{i}", b, n) for i in range(40) for n, b in enumerate(("left", "right"))]
    bases = shared + [("left", "mid", 0), ("mid", "top", 0), ("right", "top", 0), ("odd", None, 0), (None, "top", 0), ("twice", "top", 0), ("twice", "top", 1)]
    stages = []
    real = rs.settle
    monkeypatch.setattr(rs, "settle", lambda df: stages.append(real(df)) or stages[-1])
    got = rs.method_order(spark.createDataFrame([("alone",), (None,)], "type string"), spark.createDataFrame(bases, "type string, base string, ord int"))
    out = [(r.type, r.order) for r in got.collect()]
    expected = {f"x{i}": [f"x{i}", "left", "mid", "right", "top"] for i in range(40)}
    expected |= {"left": ["left", "mid", "top"], "mid": ["mid", "top"], "right": ["right", "top"], "top": ["top"], "alone": ["alone"], "odd": None, None: None}
    assert dict(out) == expected | {"twice": dict(out)["twice"]} and len(out) == len(expected) + 1
    merged = [df for df in stages if "tail" in df.columns or ("order" in df.columns and "type" in df.columns)]
    assert sum(df.count() for df in merged) <= 5  # [top], [mid], [left, right], [top, top]; before, a row for each of the 40


def test_rounds_of_a_contraction_go_by_length_not_by_nodes(spark):
    ring = [(f"r{r:03}{i}", f"r{r:03}{(i + 1) % 6}") for r in range(200) for i in range(6)]
    left, merged = cl._contract(spark.createDataFrame(ring + [(f"c{i}", f"c{i + 1}") for i in range(6)], "src string, dst string"))
    assert left.isEmpty() and len(merged.jumps) <= 4
    roots = dict(rows(merged.roots))
    assert roots == {a: a[:4] + "0" for a, _ in ring if a[4] != "0"} | {f"c{i}": "c6" for i in range(6)}


def test_ref_tree_writes_only_what_was_joined(spark, monkeypatch):
    written, settle = [], cl.settle
    monkeypatch.setattr(cl, "settle", lambda df: written.append(settle(df)) or written[-1])
    refs, hops = [("a", "b"), ("a", "c"), ("b", "d"), ("x", "d"), ("d", "e")], [("b", "x")]
    tree = cl.ref_tree(spark.createDataFrame(refs, "src string, dst string"), spark.createDataFrame(hops, "src string, dst string"), spark.createDataFrame([("a",)], "seed string"), 2)
    # the three inputs, two for each level, and one for each round of hops: two on the first level, one on the second
    assert len(written) == 3 + 2 * 2 + 3
    assert {(r.parent, r.node, r.level, r.hop) for r in tree.collect()} == {("a", "b", 1, False), ("a", "c", 1, False), ("b", "x", 1, True), ("b", "d", 2, False), ("x", "d", 2, False)}


def test_type_groups_make_their_links_once(spark):
    made = spark.sparkContext.accumulator(0)

    def next_of(i):
        made.add(1)
        return i + 1

    links = spark.range(0, 60, 2).select(vw.F.col("id").alias("src"), vw.F.udf(next_of, "long").asNondeterministic()("id").alias("dst"))
    assert rows(views.type_groups(links)) == sorted(((i + j, i) for i in range(0, 60, 2) for j in (0, 1)), key=str) and made.value == 30


def plain_trail(views, most=None):
    """Views above each view by level, nearest level last; of several ways the shortest."""
    up = defaultdict(set)
    for v, p in views:
        up[v] |= {p} - {None}
    out = []
    for v in {v for v, _ in views}:
        seen, level, trail, depth = {v}, {v} - {None}, [], 0
        while level and (most is None or depth < most):
            level, depth = {p for x in level for p in up[x]} - seen, depth + 1
            seen |= level
            trail = sorted(level) + trail
        out.append((v, trail))
    return sorted(out, key=str)


def test_trails_by_doubling(spark, monkeypatch):
    chain = [(f"v{i}", f"v{i - 1}" if i else None) for i in range(20)]
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("self", "self"), ("below", "self")]
    odd = [("out", "unknown"), (None, "a"), ("v3", None), ("a", "b")]
    for seed in range(3):
        rng = random.Random(seed)
        worlds = chain + ring + odd + [(f"r{i}", f"r{rng.randrange(12)}") for i in range(12)]
        for most in (None, 1, 3):
            df = spark.createDataFrame(worlds, "view string, parent string")
            with monkeypatch.context() as m:
                m.setattr(views, "closure", None)  # one parent each: no set of all pairs is made
                assert sorted(((r.view, r.trail) for r in views.zoom_trail(df, most).collect()), key=str) == plain_trail(worlds, most)
    two = [("x", "y"), ("x", "z"), ("y", "top"), ("z", "top"), ("top", None), ("end", "x")]
    got = views.zoom_trail(spark.createDataFrame(two, "view string, parent string")).collect()
    assert sorted(((r.view, r.trail) for r in got), key=str) == plain_trail(two)


def test_changes_are_counted_without_a_distinct(spark):
    touched = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("gone", 9)], "node string, lines long")
    chains = spark.createDataFrame([("a", ["a", "d", "top", "d"]), ("b", ["b", "top"]), ("c", ["c", "d"])], "node string, chain array<string>")
    got = ch.lift_change(touched, chains)
    assert rows(got) == [("a", 1, 5), ("b", 1, 1), ("d", 1, 5), ("top", 2, 6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the chain is unfolded after the join: a row for a node is shuffled and sorted, not one for each box
    assert "Generate" in plan.split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]


def test_tests_of_starts_from_the_tests(spark, monkeypatch):
    kept, settle = [], ch.settle
    monkeypatch.setattr(ch, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(30)]
    refs = [(rng.choice(nodes), rng.choice(nodes), rng.choice(["call", "call", "read"])) for _ in range(200)]
    changed, tests = nodes[:12], nodes[9:18]
    calls = {(a, b) for a, b, k in refs if k == "call"}
    expected = {(c, a): None for a, c, _ in refs if a in tests and c in changed}
    for c in changed:
        for t in set(tests):
            via = [v for v in nodes if v != c and v not in tests and (v, c) in calls and (t, v) in calls]
            if via and (c, t) not in expected:
                expected[c, t] = min(via)
    one = lambda names: spark.createDataFrame([(n,) for n in names], "id string")
    got = ch.tests_of(one(changed), spark.createDataFrame(refs, "src string, dst string, kind string"), one(tests + tests[:2]))
    assert rows(got) == sorted(((c, t, v) for (c, t), v in expected.items()), key=str)
    assert {r.src for df in kept for r in df.collect()} <= set(tests)


def plain_implementations(symbols, refs):
    known = {s[0] for s in symbols}
    refs = [r for r in refs if r[0] in known]
    interfaces = {s[0] for s in symbols if s[5] == "interface"}
    up = defaultdict(set)
    for a, b, k, _ in refs:
        if k == "extends" and a in interfaces:
            up[a].add(b)
    types, out = defaultdict(set), defaultdict(set)
    for a, b, k, how in refs:
        if k == "implements":
            todo, seen = [b], {b}
            while todo:
                for y in up[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            for t in seen:
                types[t, a].add(how)
            if b in known:
                out[b, a].add(how)

    def near(file, folder, language, path):
        found = [(f != file, f, i) for i, f, d, g, p, _ in symbols if (d, g, p) == (folder, language, path)]
        return min(found)[2] if found else None

    for i, f, d, g, p, k in symbols:
        member = k in ("method", "variable")
        for (t, a), how in types.items():
            if t == i and not member:
                out[i, a] |= how
            if member and "." in p and near(f, d, g, p.rpartition(".")[0]) == t:
                name = p.rpartition(".")[2].split("~")[0]
                for s in symbols:
                    if s[0] == a and (x := near(*s[1:4], f"{s[4]}.{name}")):
                        out[i, x] |= how
    return [(i, x, "precise" if "precise" in how else "heuristic") for (i, x), how in out.items() if i != x]


@pytest.mark.parametrize("seed", [1, 2])
def test_implementations_look_only_for_what_is_implemented(spark, monkeypatch, seed):
    rng, asked, near = random.Random(seed), [], rs._near
    monkeypatch.setattr(rs, "_near", lambda wanted, members: asked.append(wanted.count()) or near(wanted, members))
    monkeypatch.setattr("graphloam.session.TASK_ROWS", 2, raising=False)
    symbols, paths = [], ["A", "B", "C", "A.m", "B.m", "C.m", "A.n", "B.n", "A.m~2", "A.B", "A.B.m", ".m", "D."]
    for i in range(70):
        path, folder = rng.choice(paths), rng.choice("ab")
        kind = rng.choice(["method", "variable"] if path[-1] in "mn2" else ["interface", "class", "class", "method"])
        symbols.append((f"s{min(i, 67):02}", f"{folder}/{rng.choice('xyz')}", folder, rng.choice(["go", "go", "py"]), path, kind))
    name = lambda: f"s{rng.randrange(72):02}"
    refs = [(name(), name(), rng.choice(["implements", "implements", "extends", "call"]), rng.choice(["precise", "heuristic"])) for _ in range(90)]
    idle = [(f"t{i}.m", "c/x", "c", "go", f"T{i}.m", "method") for i in range(300)] + [(f"t{i}", "c/x", "c", "go", f"T{i}", "class") for i in range(300)]
    world = spark.createDataFrame(symbols + idle, "id string, file string, folder string, language string, path string, kind string")
    got = rs.implementations(world, spark.createDataFrame(refs, "src string, dst string, kind string, resolution string"))
    assert rows(got) == sorted(plain_implementations(symbols, refs), key=str)
    # members of types that nothing implements are not looked for, and many rows are not left to a few tasks
    assert sum(asked) <= 70
    assert got.rdd.getNumPartitions() >= got.count() / 2
