"""Web routes: one form for the paths of routes and requests, and how well they match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Hosts whose URLs stay inside a repository: this machine and names that are reserved for tests.
LOCAL_HOST = r"^(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|.*\.(?:localhost|local|test|example)|(?:.*\.)?example\.(?:com|org|net))$"


def normalize_route(path: Column) -> Column:
    """A route or request path with parameters as {} and a catch-all as {*}; null for another host.

    Query and fragment are dropped, and so are empty segments. A path without a leading slash
    is none.
    """
    p = F.trim(path)
    host = F.regexp_extract(p, r"(?i)^(?:[a-z]+:)?//([^/?#]*)", 1)
    absolute = p.rlike(r"(?i)^(?:[a-z]+:)?//")
    local = F.lower(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")).rlike(LOCAL_HOST)
    rest = F.when(absolute, F.regexp_replace(p, r"(?i)^(?:[a-z]+:)?//[^/?#]*", "")).otherwise(p)
    rest = F.when(absolute & (rest == ""), "/").otherwise(rest)
    segment = lambda s: F.when(s.rlike(r"^\*|^\{\w*(?:\.\.\.|:path)\}$|^<path:\w+>$|^\[\[?\.\.\."), "{*}").when(s.rlike(r"^:|[{<\[]"), "{}").otherwise(s)
    parts = F.transform(F.filter(F.split(F.regexp_replace(rest, r"[?#].*$", ""), "/"), lambda s: (s != "") & (s != "{$}")), segment)
    return F.when((~absolute | local) & rest.startswith("/"), F.concat(F.lit("/"), F.array_join(parts, "/")))


def join_route(prefix: Column, path: Column) -> Column:
    return F.when(prefix.isin("", "/"), path).when(path == "/", prefix).otherwise(F.concat(prefix, path))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def match_literals(route: Column, request: Column) -> Column:
    """How many literal segments agree if a route takes a request (arrays of segments); null if it does not.

    {*} takes one or more remaining segments, {} takes any one, a literal only itself.
    """
    rest = F.array_position(route, "{*}")
    n = F.when(rest > 0, rest - 1).otherwise(F.size(route)).cast("int")
    long_enough = F.when(rest > 0, F.size(request) > n).otherwise(F.size(request) == n)
    step = lambda s, x: F.when((s < 0) | (x < 0), -1).otherwise(s + x)
    taken = F.zip_with(F.slice(route, F.lit(1), n), F.slice(request, F.lit(1), n), lambda r, q: F.when(r == "{}", 0).when(r == q, 1).otherwise(-1))
    literal = F.aggregate(taken, F.lit(0), step)
    return F.when(long_enough & (literal >= 0), literal)
