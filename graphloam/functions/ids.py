"""Element ids: what an id names, and the parts of paths.

Ids carry their kind as a prefix: repo, dir:, file:, sym:, grp:, edge:. Parsing is total: an
id of no known form is `unknown`, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of stored references and the arrows they become, kinds of symbols, and (below) the kinds of
# reference that count as a use of a symbol, by its kind; calls for the kinds not named.
EDGE_KINDS = {"call": "calls", "import": "imports", "extends": "extends", "implements": "implements", "type-ref": "references", "read": "reads", "write": "writes", "request": "requests"}
SYMBOL_KINDS = ("class", "interface", "function", "method", "type", "variable", "enum", "key", "other")
USE_KINDS = {"variable": ("read", "write"), "key": ("read", "write"), "type": ("type-ref", "extends", "implements", "read"), "interface": ("type-ref", "extends", "implements", "read"), "enum": ("type-ref", "extends", "implements", "read"), "other": ("call", "read", "write", "type-ref", "extends", "implements")}
CONSTRUCTORS = ("__init__", "__new__", "constructor")
DEFAULT_EDGE_KINDS = ("calls", "extends", "implements")


def node_kind(element: Column) -> Column:
    """repo, dir, file, symbol, group, edge or unknown."""
    body = F.length(F.substring_index(element, ":", -1)) > 0
    return (
        F.when(element == "repo", "repo")
        .when(element.startswith("dir:") & body, "dir")
        .when(element.startswith("file:") & body, "file")
        .when(element.rlike("^sym:[^#]+#."), "symbol")
        .when(element.startswith("grp:") & body, "group")
        .when(element.rlike("^edge:[^:]+:.+->.+"), "edge")
        .otherwise("unknown")
    )


def parse_id(element: Column) -> Column:
    """struct(kind, file, path, edge_kind, src, dst): the parts an id names.

    A symbol is cut at its first '#'; an edge at the first '->'.
    """
    kind = node_kind(element)
    none = F.lit(None).cast("string")
    rest = F.regexp_replace(element, "^[a-z]+:", "")
    edge = F.regexp_replace(rest, "^[^:]+:", "")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "symbol", F.substring_index(rest, "#", 1)).when(kind.isin("file", "dir"), rest).otherwise(none).alias("file"),
        F.when(kind == "symbol", F.regexp_extract(rest, "^[^#]*#(.*)$", 1)).otherwise(none).alias("path"),
        F.when(kind == "edge", F.substring_index(rest, ":", 1)).otherwise(none).alias("edge_kind"),
        F.when(kind == "edge", F.substring_index(edge, "->", 1)).otherwise(none).alias("src"),
        F.when(kind == "edge", F.regexp_extract(edge, "->(.*)$", 1)).otherwise(none).alias("dst"),
    )


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), kind, F.lit(":"), src, F.lit("->"), dst)


def edge_kind(ref_kind: Column) -> Column:
    """The arrow kind of a reference kind; null for kinds that draw no arrow."""
    out = F.lit(None).cast("string")
    for ref, edge in reversed(EDGE_KINDS.items()):
        out = F.when(ref_kind == ref, edge).otherwise(out)
    return out


def is_use(symbol_kind: Column, ref_kind: Column) -> Column:
    """Whether a reference of this kind uses a symbol of that kind."""
    out = ref_kind == "call"
    for kind, uses in USE_KINDS.items():
        out = F.when(symbol_kind == kind, ref_kind.isin(*uses)).otherwise(out)
    return out


def dir_of(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def directories(path: Column) -> Column:
    """Every folder above a path, outermost first, the top excluded."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def last_segment(path: Column) -> Column:
    """The name at the end of a dotted path, without its duplicate number."""
    return F.regexp_replace(F.substring_index(path, ".", -1), r"~\d+$", "")


def parent_path(path: Column) -> Column:
    """The dotted path above; null at the top."""
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", ""))


def symbol_label(path: Column, kind: Column) -> Column:
    """The name as it is shown: functions and methods with brackets."""
    return F.when(kind.isin("function", "method"), F.concat(last_segment(path), F.lit("()"))).otherwise(last_segment(path))


def normalize_id(text: Column) -> Column:
    """A loosely written id in its stored form: blanks and ./ removed, back slashes turned, a bare path named a file or symbol."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"\\", "/"), r"(^|:)(?:\./)+", "$1")
    t = F.regexp_replace(t, "/+$", "")
    return (
        F.when(t.isin("", ".", "/", "repo"), "repo")
        .when(t.rlike("^(?:dir|file|sym|group|edge):"), t)
        .when(t.rlike("^symbol:"), F.regexp_replace(t, "^symbol:", "sym:"))
        .when(t.contains("#"), F.concat(F.lit("sym:"), t))
        .when(t.rlike(r"\.[A-Za-z0-9]+$"), F.concat(F.lit("file:"), t))
        .otherwise(F.concat(F.lit("dir:"), t))
    )
