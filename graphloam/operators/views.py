"""Smaller derivations on symbols, references and views."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.operators.closure import closure
from graphloam.operators.intervals import innermost, point_in_range
from graphloam.session import settle_round as settle

#: Columns of a line in one position: line * LINE + column.
LINE = 1 << 20
#: Lines that a range and a point meet by.
BUCKET = 64


def file_of(ids: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, file: of a symbol, or of a module scope (a file and '#'); null for what is neither."""
    scope = F.when(F.col("id").endswith("#"), F.expr("substr(id, 1, length(id) - 1)"))
    known = ids.select("id").distinct().withColumn("_scope", scope)
    joined = known.join(symbols.select("id", F.col("file").alias("_of")), "id", "left").join(files.select(F.col("file").alias("_scope"), F.col("file").alias("_is")), "_scope", "left")
    return joined.select("id", F.coalesce("_of", "_is").alias("file"))


def contains_code(container: Column, file: Column) -> Column:
    """Whether a container id (repo, dir:, file:) holds a file."""
    path = F.regexp_replace(container, "^(?:dir|file):", "")
    return F.when(container == "repo", True).when(container.startswith("file:"), file == path).when(container.startswith("dir:"), F.startswith(file, F.concat(path, F.lit("/")))).otherwise(False)


def via_hops(paths: DataFrame, key: str, via: str) -> DataFrame:
    """key, hop, src, dst: the consecutive pairs of each path (array)."""
    p = F.col(via)
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))).alias("src"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("dst"))
    return paths.select(key, F.posexplode(pairs).alias("hop", "_p")).select(key, "hop", F.col("_p.src").alias("src"), F.col("_p.dst").alias("dst"))


def hop_refs(refs: DataFrame, hops: DataFrame, inside: DataFrame) -> DataFrame:
    """References from inside a hop's source to inside its target. hops(hop, a, b); inside(element, node): closure of containment."""
    a = hops.join(inside.select(F.col("element").alias("a"), F.col("node").alias("src")), "a")
    found = refs.join(a, "src").join(inside.select(F.col("element").alias("b"), F.col("node").alias("dst")), ["b", "dst"])
    return found.select("hop", *refs.columns)


def of_kinds(symbols: DataFrame, kinds: list[str], ancestors: DataFrame) -> DataFrame:
    """Symbols of some kinds and all that contain them. symbols(id, kind); ancestors(node, ancestor)."""
    wanted = symbols.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("node"))
    up = ancestors.join(wanted, "node", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return symbols.join(up, "id", "left_semi")


# Names of files and folders that a runtime loads by convention.
ENTRY_STEMS = ("main", "index", "cli", "server", "app", "__main__", "__init__", "mod", "lib", "build", "setup", "manage", "wsgi", "asgi", "middleware", "page", "layout", "route")
ENTRY_DIRS = ("scripts", "bin", "cmd", "pages", "routes", "migrations")
#: What a text must have, all of it, to start a program by itself.
ENTRY_TEXT = {
    "go": (r"(?m)^package +main\b", r"(?m)^func +main *\( *\)"),
    "java": (r"\bstatic\b[\w\s]*\bvoid +main *\(",),
    "python": (r"(?m)^if +__name__ *== *.__main__. *:",),
    "rust": (r"(?m)^(?:[ \w]+ )?fn +main *\(",),
}


def is_entry(path: Column, language: Column | None = None, text: Column | None = None) -> Column:
    """Whether nothing needs to refer to a file: by its name, its folders, or a main function in its text."""
    base = F.substring_index(path, "/", -1)
    folders = F.split(F.substring(path, F.lit(1), F.length(path) - F.length(base)), "/")
    # the parts of the name after its first: a settings file has one of them, a file of types ends in two
    parts = F.split(base, r"\.")
    rest = F.slice(parts, 2, F.size(parts))
    kinds = F.exists(rest, lambda p: p.startswith("config-")) | F.array_contains(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), "config")
    settings = (F.get(parts, 0) == "") | kinds | (F.slice(rest, F.greatest(F.size(rest) - 1, F.lit(1)), F.lit(2)) == F.array(F.lit("d"), F.lit("ts")))
    out = settings | F.substring_index(base, ".", 1).isin(*ENTRY_STEMS) | F.arrays_overlap(folders, F.array(*[F.lit(d) for d in ENTRY_DIRS]))
    if language is not None and text is not None:
        for name, patterns in ENTRY_TEXT.items():
            mine = language == name
            for pattern in patterns:
                mine = mine & text.rlike(pattern)
            out = out | mine
    return out


def resource_join(resources: DataFrame, files: DataFrame) -> DataFrame:
    """id, file: files that a resource names, by path or by a pattern. resources(id, path, prefix, regex).

    ``prefix`` is the literal start of a pattern up to its last slash; it narrows the join, so
    patterns are tried on files of that folder only.
    """
    literal = resources.filter("path is not null").select("id", F.col("path").alias("file")).join(files.select("file"), "file")
    pattern = resources.filter("regex is not null")
    dirs = files.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("file", "/")) - 1), lambda i: F.array_join(F.slice(F.split("file", "/"), F.lit(1), i), "/"))).alias("prefix"))
    found = pattern.join(dirs, "prefix").filter(F.expr("file rlike regex")).select("id", "file")
    return literal.select("id", "file").unionByName(found).distinct()


def innermost_at(points: DataFrame, ranges: DataFrame, ids: list[str]) -> DataFrame:
    """The innermost range around a (line, col): ranges(file, id, s_line, s_col, e_line, e_col)."""
    placed = points.withColumn("pos", F.col("line").cast("long") * LINE + F.col("col"))
    spans = ranges.select("file", "id", (F.col("s_line").cast("long") * LINE + F.col("s_col")).alias("start_line"), (F.col("e_line").cast("long") * LINE + F.col("e_col")).alias("end_line"))
    # buckets of 64 lines, not of positions: a position is a line and a column in it
    bucket = lambda line: F.floor(line / BUCKET).cast("long")
    left = placed.withColumn("_b", bucket(F.col("line")))
    right = spans.withColumn("_b", F.explode(F.sequence(bucket(F.floor(F.col("start_line") / LINE)), bucket(F.floor(F.col("end_line") / LINE)))))
    found = left.join(right, ["file", "_b"]).filter(F.col("pos").between(F.col("start_line"), F.col("end_line")))
    best = F.max(F.struct((F.col("start_line") - F.col("end_line")).alias("k"), F.col("start_line"), F.col("id")))
    return found.groupBy(*ids, "file", "line", "col").agg(best["id"].alias("id"))


def keep_blind(sites: DataFrame, known: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sites (site, file, line, src, dst) in the smallest range around their line whose edge is not known yet."""
    found = innermost(sites.select("site", "file", "line"), ranges.select("file", "id", "start_line", "end_line"), "file", "line", ["site"])
    joined = sites.join(found.select("site", F.col("id").alias("inside")), "site")
    return joined.join(known.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def row_order(members: DataFrame, owner: str, start: str, ident: str) -> DataFrame:
    """The place of each member of its owner in order of declaration, from 0."""
    return members.withColumn("row", F.row_number().over(Window.partitionBy(owner).orderBy(start, ident)) - 1)


def zoom_trail(views: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """view, trail: the views above each view (view, parent), outermost first.

    Where each view has one parent, trails are doubled: a trail of n views takes log2(n) rounds, and
    only views that are parents take part in them. A ring ends when a trail meets itself. Views with
    more than one parent go level by level.
    """
    up = settle(views.filter("view is not null and parent is not null").select("view", "parent").distinct())
    every = views.select("view").distinct()
    if not up.groupBy("view").count().filter("count > 1").isEmpty():
        edges = up.select(F.col("view").alias("src"), F.col("parent").alias("dst"))
        found = closure(edges, edges.select(F.col("src").alias("seed")), max_rounds).filter("seed <> node")
        trail = found.groupBy(F.col("seed").alias("view")).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "node"))).alias("t"))
        joined = every.join(trail, "view", "left")
        return joined.select("view", F.coalesce(F.transform("t", lambda x: x["node"]), F.array().cast("array<string>")).alias("trail"))
    # nearest first; done: nothing is above the last one, or it is a ring
    inner = settle(up.join(up.select(F.col("parent").alias("view")).distinct(), "view", "left_semi").select("view", F.array("parent").alias("trail"), F.lit(False).alias("done")))
    for round_no in count():
        if inner.filter("not done").isEmpty() or (max_rounds is not None and 2**round_no >= max_rounds):
            break
        above = inner.select(F.col("view").alias("last"), F.col("trail").alias("more"))
        left = inner.filter("not done").withColumn("last", F.element_at("trail", -1)).join(above, "last", "left")
        both = left.select("view", F.concat("trail", F.coalesce("more", F.array().cast("array<string>"))).alias("trail"), F.col("more").isNull().alias("done"))
        both = both.withColumn("done", F.col("done") | (F.size(F.array_distinct("trail")) < F.size("trail")))
        inner = settle(inner.filter("done").unionByName(both))
    joined = every.join(up, "view", "left").join(inner.select(F.col("view").alias("parent"), F.col("trail").alias("more")), "parent", "left")
    trail = F.concat(F.array("parent"), F.coalesce("more", F.array().cast("array<string>")))
    trail = trail if max_rounds is None else F.slice(trail, 1, max_rounds)
    trail = F.filter(F.array_distinct(trail), lambda x: x != F.col("view"))
    return joined.select("view", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.reverse(trail)).alias("trail"))


def expand_in_place(include: DataFrame, opened: DataFrame) -> DataFrame:
    """A view with the opened boxes (box, member) replaced by their members."""
    boxes = opened.select(F.col("box").alias("element")).distinct()
    inner = opened.join(include.select(F.col("element").alias("box")).distinct(), "box", "left_semi").select(F.col("member").alias("element"))
    return include.select("element").join(boxes, "element", "left_anti").union(inner).distinct()


def removed_boxes(before: DataFrame, after: DataFrame) -> DataFrame:
    """dir, n: how many files (column file) are gone from each folder."""
    from graphloam.functions.ids import dir_of

    return before.select("file").distinct().join(after.select("file").distinct(), "file", "left_anti").groupBy(dir_of(F.col("file")).alias("dir")).agg(F.count("*").alias("n"))


def type_groups(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, grp: connected types share the least of their names. links(src, dst). Labels flow until none changes; ``max_rounds`` that do not suffice are an error."""
    from graphloam.operators.closure import rounds
    from graphloam.session import settle_round as settle

    # both ways in one pass: a union would make the links twice
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = settle(links.select(F.explode(ways).alias("w")).select("w.src", "w.dst").distinct())
    label = both.select(F.col("src").alias("node"), F.col("src").alias("grp")).distinct()
    for _ in rounds(max_rounds):
        near = both.join(label, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("grp").alias("_g"))
        nxt = label.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("grp", F.coalesce("_g", "grp")).alias("_n"), "grp")
        # a label is itself a node: its own label is at least as small
        jump = nxt.select(F.col("node").alias("_k"), F.col("_n").alias("_j"))
        nxt = settle(nxt.join(jump, F.col("_n") == F.col("_k"), "left").select("node", F.least("_n", F.coalesce("_j", "_n")).alias("to"), "grp"))
        label = nxt.select("node", F.col("to").alias("grp"))
        if nxt.filter("to <> grp").isEmpty():
            break
    return label


def state_transitions(uses: DataFrame) -> DataFrame:
    """src_state, dst_state, function, n: a state that is tested and the next one set after it in the same function.

    uses(function, line, state, action), action being test or set. Each set follows the last
    test before it.
    """
    by = Window.partitionBy("function").orderBy("line", F.when(F.col("action") == "test", 0).otherwise(1), "state").rowsBetween(Window.unboundedPreceding, -1)
    tested = F.last(F.when(F.col("action") == "test", F.col("state")), ignorenulls=True).over(by)
    found = uses.withColumn("src_state", tested).filter("action = 'set' and src_state is not null and src_state <> state")
    return found.groupBy("src_state", F.col("state").alias("dst_state"), "function").agg(F.count("*").alias("n"))


def block_ends(lines: DataFrame) -> DataFrame:
    """file, line, end_line: where the block under each line ends: before the next line that is indented no further.

    lines(file, line, indent), without blank lines. A line looks for the next one at each level of
    indentation that its file has from its own up, so rows are lines times the depth of nesting,
    and each window holds the lines of one level. The block under a line without deeper lines is the line itself.
    """
    levels = lines.select("file", F.col("indent").alias("level")).distinct()
    # a line stops the blocks of all levels from its own indentation up
    each = lines.join(levels, "file").filter("level >= indent")
    nxt = F.lead("line").over(Window.partitionBy("file", "level").orderBy("line"))
    stops = each.withColumn("_next", nxt).filter("level = indent").select("file", "line", "_next")
    last = lines.groupBy("file").agg(F.max("line").alias("_last"))
    return stops.join(last, "file").select("file", "line", F.coalesce(F.col("_next") - 1, "_last").alias("end_line"))


def block_transitions(lines: DataFrame, uses: DataFrame) -> DataFrame:
    """src_state, dst_state, file, n: states that are set inside the block of a test of another state.

    lines(file, line, indent) as for ``block_ends``; uses(file, line, state, action), action being test or set.
    Blocks nest, so the test that counts is the last one whose block still holds the set; a set
    on the line of a test is not in its block.
    """
    tests = uses.filter("action = 'test'").groupBy("file", "line").agg(F.min("state").alias("src_state"))
    held = tests.join(block_ends(lines), ["file", "line"]).filter("end_line > line").select("file", (F.col("line") + 1).alias("start_line"), "end_line", "src_state")
    sets = uses.filter("action = 'set'").select("file", "line", F.col("state").alias("dst_state"))
    found = innermost(sets.distinct(), held, "file", "line", ["dst_state"], order="start_line")
    counted = sets.groupBy("file", "line", "dst_state").agg(F.count("*").alias("_times"))
    joined = found.join(counted, ["file", "line", "dst_state"]).filter("src_state <> dst_state")
    return joined.groupBy("src_state", "dst_state", "file").agg(F.sum("_times").alias("n"))


def type_hierarchy(bases: DataFrame, roots: DataFrame, down: int = 2) -> DataFrame:
    """root, type, depth: all ancestors of each root (negative depths) and descendants ``down`` levels deep. bases(type, base)."""
    up = bases.select(F.col("type").alias("src"), F.col("base").alias("dst"))
    above = closure(up, roots).filter("seed <> node").select(F.col("seed").alias("root"), F.col("node").alias("type"), (-F.col("depth")).alias("depth"))
    below = closure(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, down).filter("seed <> node").select(F.col("seed").alias("root"), F.col("node").alias("type"), "depth")
    return above.unionByName(below)


def process_flow(steps: DataFrame) -> DataFrame:
    """flow, src, dst, decision: transitions of steps (flow, n, step, next array); without next, the step that follows.

    A step with more than one way on is a decision.
    """
    after = F.lead("step").over(Window.partitionBy("flow").orderBy("n"))
    ways = F.when(F.size("next") > 0, F.col("next")).otherwise(F.filter(F.array(after), lambda x: x.isNotNull()))
    out = steps.withColumn("_w", ways)
    return out.select("flow", F.col("step").alias("src"), F.explode("_w").alias("dst"), (F.size("_w") > 1).alias("decision"))


def code_focus(elements: DataFrame, anchors: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """element, file, start_line, end_line: the code of an element: its anchors, else its symbol, else its file.

    elements(element); anchors(element, file, start_line, end_line); symbols(element, ...);
    files(element, file, lines). Only the first kind that an element has is given.
    """
    a = anchors.select("element", "file", "start_line", "end_line")
    s = symbols.select("element", "file", "start_line", "end_line").join(a.select("element").distinct(), "element", "left_anti")
    f = files.select("element", "file", F.lit(1).alias("start_line"), F.col("lines").alias("end_line")).join(a.select("element").union(s.select("element")).distinct(), "element", "left_anti")
    return a.unionByName(s).unionByName(f).join(elements.select("element").distinct(), "element", "left_semi")


def collect_anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """owner, place, file, start_line: every anchor of a document with its owner. Both have id and anchors (array of struct)."""
    flat = lambda df, name: df.select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("owner"), F.posexplode("anchors").alias("place", "_a")).select("owner", "place", "_a.file", "_a.start_line")
    return flat(nodes, "node").unionByName(flat(edges, "edge"))


def header_comment(lines: DataFrame, most: int = 100) -> DataFrame:
    """file, comment: the first block of comment lines of a file, cut to ``most`` characters.

    Only lines up to the first line of code are gathered.
    """
    body = F.regexp_replace(F.trim("line_text"), r"^(?://+|#+!?|/\*+|\*+/?|\"\"\"|--)\s*|\*/$", "")
    comment = F.trim("line_text").rlike(r"^(?://|#|/\*|\*|\"\"\"|--)")
    marked = lines.withColumn("_c", comment).withColumn("_blank", F.trim("line_text") == "")
    first_code = marked.filter("not _c and not _blank").groupBy("file").agg(F.min("line").alias("_code"))
    head = marked.join(first_code, "file", "left").filter("_c and (_code is null or line < _code)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("b")))), lambda x: x["b"]), " ")
    return head.groupBy("file").agg(F.substring(F.trim(joined), 1, most).alias("comment"))


def imports_of(lines: DataFrame) -> DataFrame:
    """file, line, module: the module of import lines of the usual forms."""
    t = F.col("line_text")
    patterns = (r"^\s*import\s+(?:[^'\"]*\sfrom\s+)?['\"]([^'\"]+)['\"]", r"^\s*(?:const|let|var)\s.*\brequire\(['\"]([^'\"]+)['\"]\)", r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+(?:static\s+)?([\w.]+)", r"^\s*use\s+([\w:]+)")
    module = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    return lines.filter(t.rlike(r"^\s*(?:import|from|use|const|let|var)\b")).select("file", "line", module.alias("module")).filter("module is not null")


def coverage_report(coverage: DataFrame, changed: DataFrame) -> DataFrame:
    """file, reason of changed files that no provider has analysed; coverage(file, status)."""
    best = coverage.groupBy("file").agg(F.max(F.when(F.col("status") == "supported", 2).when(F.col("status") == "partial", 1).otherwise(0)).alias("_s"))
    joined = changed.select("file").distinct().join(best, "file", "left")
    return joined.select("file", F.when(F.col("_s").isNull(), "not analysed").when(F.col("_s") == 0, "unsupported").when(F.col("_s") == 1, "partial").alias("reason")).filter("reason is not null")


def inside_points(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """How many points (file, line) lie in each range (file, id)."""
    return point_in_range(points, ranges, "file", "line", "start_line", "end_line").groupBy("file", "id").agg(F.count("*").alias("n"))


def member_type(line: Column, name: Column) -> Column:
    """The type after a field's name on its declaration line: name: Type, or Type after the name."""
    rest = F.substring(line, F.position(name, line) + F.length(name), F.length(line))
    return F.nullif(F.trim(F.regexp_extract(rest, r"^\??\s*:?\s*([A-Za-z_\[\]<>.*|, ]+?)\s*(?:[=;,{]|$)", 1)), F.lit(""))
