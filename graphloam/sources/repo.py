"""Scanning a folder of source text, and reading and writing snapshots."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloam.functions.ids import dir_of
from graphloam.functions.text import hash_text, lines
from graphloam.session import settle

MAX_BYTES = 1024 * 1024
SNIFF_BYTES = 8192
# Folders that a walk leaves out, reasons in report order, languages by extension.
SKIPPED_DIRS = (".git", "node_modules", "dist", "build", "out", "vendor", "target", "__pycache__", ".venv", "venv")
REASONS = ("generated", "dependency", "lockfile", "oversized", "binary", "non-file", "unreadable")
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "py": "python", "pyi": "python", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "php": "php", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
}


def language_of(path: Column) -> Column:
    """The language by extension, any case; text for the rest."""
    base = F.substring_index(path, "/", -1)
    extension = F.lower(F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise(""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension], F.lit("text"))


def path_exclusion(path: Column, generated: str = r"(?i)\.patch\.json$") -> Column:
    """generated, dependency or lockfile by path alone; null for a path that may be read."""
    base = F.substring_index(path, "/", -1)
    lock = base.endswith("-lock.json") | base.endswith(".lock") | base.isin("go.sum", "pnpm-lock.yaml", "npm-shrinkwrap.json")
    return F.when(path.endswith("/") | path.rlike(r"(?:^|/)(?:node_modules|\.git)(?:/|$)"), "dependency").when(lock, "lockfile").when(path.rlike(generated), "generated")


def content_exclusion(content: Column, size: Column) -> Column:
    """oversized or binary by content (bytes); null for text."""
    return F.when(size > MAX_BYTES, "oversized").when(F.instr(F.hex(F.substring(content, 1, SNIFF_BYTES)), "00").cast("boolean") & F.hex(F.substring(content, 1, SNIFF_BYTES)).rlike("^(?:..)*?00"), "binary")


def _store(root: str):
    """(file system, folder) of a path or address, as tasks open it."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else re.sub("^file:/*", "/", root))
    return store, folder.rstrip("/")


def _children(root: str):
    """Arrow batches of folders below ``root`` to path, size, kind (folder, file, non-file, unreadable) of what is in them."""

    def listing(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = _store(root)
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                try:
                    infos = store.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top or "/"))
                except OSError:
                    if not folder:
                        raise
                    rows.append((folder, 0, "unreadable"))
                    continue
                for info in infos:
                    link = isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path)
                    kind = "non-file" if link else {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(info.type, "non-file")
                    rows.append((f"{folder}/{info.base_name}" if folder else info.base_name, info.size or 0, kind))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10_000]], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "size", "kind"])

    return listing


def _contents(root: str):
    """Arrow batches of path, size, reason to the same with content where there is no reason; a file that cannot be read is unreadable."""

    def reading(batches):
        import pyarrow as pa

        store, top = _store(root)
        for batch in batches:
            paths, sizes, reasons = (c.to_pylist() for c in batch.columns)
            held, room = [], 0
            for i, path in enumerate(paths):
                data, reason = None, reasons[i]
                if reason is None:
                    try:
                        with store.open_input_stream(f"{top}/{path}") as f:
                            data = f.read()
                    except OSError:
                        reason = "unreadable"
                held.append((path, sizes[i], data, reason))
                room += len(data or b"")
                if room > 8 * MAX_BYTES or i == len(paths) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.string()))], ["path", "size", "content", "reason"])
                    held, room = [], 0

    return reading


def walk(spark: SparkSession, root: str, opened: Callable[[Column], Column]) -> DataFrame:
    """path, size, kind of everything below a folder, in folders for whose path ``opened`` holds.

    One round for each level: tasks list the folders that the round before found, so that a folder
    that is left out is never opened and no task walks a whole tree. Links are not followed. Spark's own
    listing cannot be used: it passes over names that begin with a dot or an underscore.
    """
    frontier, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = settle(frontier.mapInArrow(_children(root), "path string, size long, kind string"))
        levels.append(found.filter("kind <> 'folder'"))
        frontier = found.filter("kind = 'folder'").select("path").filter(opened(F.col("path")))
        n = frontier.count()
        if not n:
            return reduce(DataFrame.unionByName, levels)
        frontier = frontier.repartition(min(-(-n // 16), spark.sparkContext.defaultParallelism * 8))


def scan(spark: SparkSession, root: str, rules: bool = False, ignore_file: str = ".gitignore") -> DataFrame:
    """path, size, content and reason (null if it is read) of every file below a folder of any store that Arrow opens.

    Without ``rules`` this is a walk: folders that a walk skips and those with a dot in front are
    left out. With ``rules`` the ignore files of the folder decide instead, and only what belongs to
    the version control itself is left out. Content is read only where path and size allow it.
    """
    from graphloam.sources.ignore import ignore_rules, not_ignored

    name = lambda path: F.substring_index(path, "/", -1)
    found = walk(spark, root, (lambda p: name(p) != ".git") if rules else (lambda p: ~name(p).isin(*SKIPPED_DIRS) & ~name(p).startswith(".")))
    other = F.when(F.col("kind") != "file", F.col("kind"))
    named = found.select("path", "size", F.coalesce(other, path_exclusion(F.col("path")), F.when(F.col("size") > MAX_BYTES, "oversized")).alias("reason"))
    read = lambda df: df.mapInArrow(_contents(root), "path string, size long, content binary, reason string")
    if rules:
        texts = read(named.filter(name(F.col("path")) == ignore_file)).select("path", F.decode("content", "utf-8").alias("text"))
        named = not_ignored(named, ignore_rules(texts))
    return read(named).select("path", "size", "content", F.coalesce("reason", content_exclusion(F.col("content"), F.col("size"))).alias("reason"))


def source_files(scanned: DataFrame) -> DataFrame:
    """path, language, hash, lines, text of the files that are read."""
    text = F.decode("content", "utf-8")
    return scanned.filter("reason is null").select("path", language_of(F.col("path")).alias("language"), text.alias("text")).withColumn("hash", hash_text(F.col("text"))).withColumn("lines", F.size(lines(F.col("text"))))


def exclusion_report(excluded: DataFrame, examples: int = 3) -> DataFrame:
    """reason, n, examples in report order: the first paths of each reason. Only the examples are gathered."""
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("path"))
    some = excluded.withColumn("_r", rank).filter(F.col("_r") <= examples).groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    counts = excluded.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.join(some, "reason").withColumn("ord", F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))).orderBy("ord").drop("ord")


def commit_id(files: DataFrame) -> DataFrame:
    """commit: wt- and 10 hex digits that the paths and hashes of all files decide.

    Files are hashed by folder first and the folders then, so that no task holds all files.
    """
    line = F.concat("path", F.lit("\0"), "hash", F.lit("\n"))
    dirs = files.groupBy(dir_of(F.col("path")).alias("dir")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"))
    tops = dirs.groupBy(F.substring_index("dir", "/", 1).alias("top")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("dir", F.lit("\0"), "h"))), ""), 256).alias("h"))
    return tops.agg(F.concat(F.lit("wt-"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("top", F.lit("\0"), "h"))), ""), 256), 1, 10)).alias("commit"))


def write_snapshot(table: DataFrame, folder: str, name: str, commit: str) -> None:
    """A table of one snapshot, readable by commit; a snapshot that is there is replaced as a whole."""
    table.withColumn("commit", F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str, name: str, commit: str) -> DataFrame:
    """The rows of one commit: a partition filter, so other snapshots are not opened."""
    return spark.read.parquet(f"{folder}/{name}").filter(F.col("commit") == commit).drop("commit")


def pack(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with numbers for the values of a column, dictionary value -> number). Numbers follow the order of values.

    Ranges of values are counted first, so numbering is not a sort in one task.
    """
    values = rows.select(F.col(column).alias("value")).distinct()
    ranged = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = settle(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    offsets = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = ranged.join(F.broadcast(offsets), "_p").select("value", (F.col("_o") + F.col("_i") - F.col("_first")).alias("number"))
    return rows.join(numbered, F.col(column).eqNullSafe(F.col("value"))).drop("value", column).withColumnRenamed("number", column), numbered


def unpack(rows: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    return rows.join(dictionary, F.col(column) == F.col("number")).drop("number", column).withColumnRenamed("value", column)


def key_paths(texts: DataFrame, max_depth: int = 6, max_keys: int = 2000) -> DataFrame:
    """path, key, line: dotted key paths of JSON, YAML and TOML texts (path, language, text) as symbols.

    JSON goes through the parser; YAML and TOML by the indents and tables of their lines. A
    text that does not parse gives no keys. At most ``max_keys`` keys of a file.
    """
    import json
    import re

    import pandas as pd

    def walk(value, prefix: tuple, out: list) -> None:
        if len(prefix) >= max_depth or len(out) >= max_keys:
            return
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in items:
            if len(out) >= max_keys:
                return
            out.append((".".join((*prefix, str(k))), 0))
            walk(v, (*prefix, str(k)), out)

    def yaml_keys(text: str) -> list:
        out, stack, counts = [], [], {}
        for n, line in enumerate(text.split("\n"), 1):
            m = re.match(r"^(\s*)(- )?\s*([\w.\-/]+)\s*:(?:\s|$)", line)
            item = re.match(r"^(\s*)-\s", line)
            if not (m or item) or line.lstrip().startswith("#"):
                continue
            indent = len((m or item)[1])
            while stack and stack[-1][0] >= indent + (1 if item and stack[-1][2] and stack[-1][0] == indent else 0):
                stack.pop()
            base = tuple(s[1] for s in stack)
            if item:
                i = counts.get((base, indent), 0)
                counts[base, indent] = i + 1
                stack.append((indent, str(i), True))
                base = (*base, str(i))
                out.append((".".join(base), n)) if len(base) <= max_depth else None
                if not m:
                    continue
                indent += 2
            key = (*base, m[3])
            stack.append((indent, m[3], False))
            if len(key) <= max_depth and len(out) < max_keys:
                out.append((".".join(key), n))
        return out

    def toml_keys(text: str) -> list:
        out, base, counts = [], (), {}
        for n, line in enumerate(text.split("\n"), 1):
            table = re.match(r"^\s*(\[\[?)([^\]]+)\]\]?", line)
            if table:
                base = tuple(p.strip().strip('"') for p in table[2].split("."))
                if table[1] == "[[":
                    counts[base] = counts.get(base, -1) + 1
                    base = (*base, str(counts[base]))
                out.append((".".join(base), n))
                continue
            m = re.match(r"^\s*([\w.\-\"]+)\s*=", line)
            if m and len(out) < max_keys:
                out.append((".".join((*base, *m[1].replace('"', "").split("."))[:max_depth]), n))
        return out

    def run(batches):
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True):
                keys: list = []
                if text is not None and language == "json":
                    try:
                        walk(json.loads(text), (), keys)
                    except ValueError:
                        keys = []
                elif text is not None:
                    keys = yaml_keys(text) if language == "yaml" else toml_keys(text)
                rows += [(path, k, n) for k, n in keys]
            yield pd.DataFrame(rows, columns=["path", "key", "line"])

    given = texts.filter(F.col("language").isin("json", "yaml", "toml")).select("path", "language", "text")
    return given.mapInPandas(run, "path string, key string, line long")


def python_facts(texts: DataFrame) -> DataFrame:
    """path, fact, name, start_line, end_line, parent, detail of Python texts: symbols, imports, calls and bases.

    The parser of the standard library runs inside the tasks, one text at a time; texts that
    do not parse give one row with the fact `syntax-error`.
    """
    import ast

    import pandas as pd

    def facts(path: str, text: str) -> list:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError) as e:
            return [(path, "syntax-error", "", getattr(e, "lineno", 1) or 1, getattr(e, "lineno", 1) or 1, None, str(e)[:80])]
        out: list = []

        def visit(node, scope: tuple) -> None:
            for child in ast.iter_child_nodes(node):
                inner = scope
                at = (getattr(child, "lineno", 0), getattr(child, "end_lineno", 0) or 0)
                up = ".".join(scope) or None
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if scope and out and any(f[1] == "class" and f[2] == ".".join(scope) for f in out) else "function"
                    inner = (*scope, child.name)
                    out.append((path, kind, ".".join(inner), *at, up, None))
                    for base in getattr(child, "bases", []):
                        out.append((path, "extends", ast.unparse(base), *at, ".".join(inner), None))
                elif isinstance(child, (ast.Import, ast.ImportFrom)):
                    module = getattr(child, "module", None)
                    for a in child.names:
                        out.append((path, "import", a.asname or a.name, *at, up, f"{'.' * getattr(child, 'level', 0)}{module + '.' if module else ''}{a.name}"))
                elif isinstance(child, ast.Call):
                    out.append((path, "call", ast.unparse(child.func)[:200], *at, up, None))
                visit(child, inner)

        visit(tree, ())
        return out

    def run(batches):
        for pdf in batches:
            rows = [f for path, text in zip(pdf["path"], pdf["text"], strict=True) if text is not None for f in facts(path, text)]
            yield pd.DataFrame(rows, columns=["path", "fact", "name", "start_line", "end_line", "parent", "detail"])

    return texts.select("path", "text").mapInPandas(run, "path string, fact string, name string, start_line long, end_line long, parent string, detail string")
