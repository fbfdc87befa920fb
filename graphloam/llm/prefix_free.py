"""Repeated passages by prefix-free parsing.

A hash of every few bytes triggers the ends of phrases, so that equal text is cut into equal
phrases wherever it stands. A window of text is then a suffix of a phrase, the phrases that
follow in the parse, and a prefix of the last one. Windows are told apart in that order:

* each trigger stands for the windows whose first trigger it is, some widths of the phrase
  suffix at a time; what all of these have in common (``core``) is counted over the corpus, and
  only triggers whose core is there twice go on;
* where all that share a core are equal to the last byte, their windows repeat;
* the others differ at an end of the core. Their phrase suffixes are put into suffix order of
  the dictionary (read backwards from the trigger), what follows into suffix order of the
  parse, and the longest common prefixes of neighbours in both orders give, for each width,
  the runs of equal windows of the corpus order.

Windows without a trigger are inside one phrase and are counted whole. Texts do not move: keys
of 64 bits do, then places, and at last the texts whose phrases differ at an end or which lose a part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm.common import BROADCAST_ROWS, settle, shield, small_batches
from graphloam.session import stored

LENGTH = 400
#: Bytes of a trigger, and the mean bytes from one to the next (a power of two).
TRIGGER, PHRASE = 8, 64
#: Widths of phrase suffixes that share a core.
WIDTHS = 134
#: Rows of one key that a task may take; keys with more, and never more than 50,000 of them, are broadcast.
HOT_ROWS = 1000
#: Members of a core that are put in order in one task; a core with more is counted window by window.
MOST_MEMBERS = 50_000
#: Members that are put in order at once.
BLOCK = 8192
#: Places in one row of the parse.
PLACES = 65_536
#: Bytes of texts that go to or come from Python at once; one longer text goes alone.
BATCH_BYTES = 1 << 22
_INSIDE = 15

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def triggers(data: bytes, phrase: int = PHRASE) -> np.ndarray:
    """Where the triggers of a text start."""
    found, piece, shift = [], 1 << 20, np.uint64(64 - (phrase.bit_length() - 1))
    for at in range(0, len(data) - TRIGGER + 1, piece):
        n = min(piece, len(data) - TRIGGER + 1 - at)
        x = np.ndarray((n,), "<u8", data, at, (1,)) * _MIX  # each place's next eight bytes as a number
        x ^= x >> np.uint64(29)
        x *= _MIX2
        found.append(np.flatnonzero(x >> shift == 0) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def pack(pos: int, bucket: int, least: int, most: int) -> int:
    """A place: a trigger, which of its buckets, and the least and most width of its windows."""
    return pos << 32 | bucket << 28 | least << 14 | most


def places(data: bytes, length: int = LENGTH, phrase: int = PHRASE, widths: int = WIDTHS) -> Iterator[tuple[int, int, int]]:
    """(first, last, place) for each place: the union of its windows is ``data[first:last]``.

    Width d of trigger a is the window that starts at a - d. Windows inside a phrase are places
    of their own, with the window's start for a trigger.
    """
    n, before, reach = len(data), 0, length - TRIGGER
    if n < length:
        return
    for a in [*triggers(data, phrase).tolist(), n + length]:
        most = min(a - before, reach)
        least = max(1, a + length - n)
        for bucket in range((least - 1) // widths, (most - 1) // widths + 1) if least <= most else ():
            lo, hi = max(least, bucket * widths + 1), min(most, (bucket + 1) * widths)
            yield a - hi, a - lo + length, pack(a, bucket, lo, hi)
        for i in range(before, min(a - reach, n - length + 1)):
            yield i, i + length, pack(i, _INSIDE, 0, 0)
        before = a


def core_of(place: int, length: int, widths: int) -> tuple[int, int]:
    """The bytes that all windows of a trigger's bucket have in common, whatever their least and most width."""
    pos, bucket = place >> 32, place >> 28 & 15
    return pos - bucket * widths - 1, pos + length - (bucket + 1) * widths


def _parse(length: int, phrase: int, widths: int):
    """mapInArrow function over (id, hash, text): the places of each text with a hash of their core and of all their bytes.

    Of texts that a task sees more than twice, two are enough to show that they repeat.
    """
    schema = ["id", "hash", "size", "place", "core", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            for i in range(len(batch)):
                key = hashes[i].as_py()
                seen[key] += 1
                if seen[key] > 2:
                    continue
                data = texts[i].as_buffer().to_pybytes()
                found, digests = [], []

                def rows():
                    sums = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    m = len(found)
                    hashed = pa.DictionaryArray.from_arrays(pa.array(np.zeros(m, np.int32)), pa.array([key], pa.binary())).dictionary_decode()
                    return pa.RecordBatch.from_arrays([pa.array(np.full(m, ids[i].as_py())), hashed, pa.array(np.full(m, len(data))), pa.array(np.array(found, np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], schema)

                for first, last, place in places(data, length, phrase, widths):
                    found.append(place)
                    if place >> 28 & 15 == _INSIDE:
                        digests.append(blake2b(data[first:last], digest_size=16).digest())
                    else:
                        a, b = core_of(place, length, widths)
                        tail = (place & 0xFFFFFFFF).to_bytes(4, "little")
                        digests.append(blake2b(data[a:b] + tail[3:], digest_size=8).digest() + blake2b(data[first:last] + tail, digest_size=8).digest())
                    if len(found) == PLACES:
                        yield rows()
                        found, digests = [], []
                if found:
                    yield rows()

    return run


def _joined(rows: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with a settled table that has each key once and, as ``n``, how many rows have it. Keys with many rows are broadcast."""
    total = unique.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_ROWS, total // 50_000)
    hot = unique.filter(F.col("n") > most)  # fewer than total / most
    if hot.limit(1).count() == 0:
        return rows.join(unique, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(unique.filter(F.col("n") <= most), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def _cut(length: int, widths: int):
    """mapInArrow function over (text, edges): for each edge a 128-bit hash of its core and the bytes on both sides of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data, out = batch.column(0)[i].as_buffer().to_pybytes(), []
                for e in batch.column(1)[i].as_py():
                    place = e["place"]
                    a, b = core_of(place, length, widths)
                    pos, lo, hi = place >> 32, place >> 14 & 0x3FFF, place & 0x3FFF
                    out.append((blake2b(data[a:b] + bytes([place >> 28 & 15]), digest_size=16).digest(), data[pos - hi : a], data[b : pos - lo + length], e["n"], e["id"], place))
                    if len(out) == PLACES:
                        yield _edges(out)
                        out = []
                yield _edges(out)

    return run


_EDGE = "core binary, left binary, right binary, n long, id long, place long"


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["core", "left", "right", "n", "id", "place"])


def _ordered(group: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of (group, bytes), and how many bytes each has in common with the one before; -1 at the start of a group."""
    table = np.frombuffer(b"".join(int(g).to_bytes(4, "big") + p.ljust(width, b"\0") for g, p in zip(group, parts, strict=True)), np.uint8).reshape(len(parts), width + 4)
    order = np.argsort(np.ascontiguousarray(table).view(f"S{width + 4}").ravel(), kind="stable")
    table = table[order]
    differs = table[1:] != table[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width + 4)
    return order, np.concatenate([[-1], np.where(common < 4, -1, common - 4)])


def repeats(group: np.ndarray, left: list[bytes], right: list[bytes], weight: np.ndarray, widths: int) -> np.ndarray:
    """For each member and each number u below ``widths``: whether another of its group has the same last u bytes of ``left`` and the same first widths - 1 - u bytes of ``right``.

    ``left`` in the order of its bytes from the end is the suffix order of the dictionary, ``right``
    in order is that of the parse: members with a common end are runs of the one, members with
    a common continuation runs of the other.
    """
    many = len(left)
    by_left, left_common = _ordered(group, [x[::-1] for x in left], widths)
    by_right, right_common = _ordered(group, right, widths)
    long_left, long_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out = np.zeros((many, widths), bool)
    run_left, run_right = np.zeros(many, np.int64), np.zeros(many, np.int64)
    for u in range(widths):
        fits = np.flatnonzero((long_left >= u) & (long_right >= widths - 1 - u))
        if len(fits) < 2:
            continue
        run_left[by_left] = np.cumsum(left_common < u)
        run_right[by_right] = np.cumsum(right_common < widths - 1 - u)
        _, of = np.unique(run_left[fits] * (many + 1) + run_right[fits], return_inverse=True)
        out[fits, u] = np.bincount(of, weight[fits])[of] >= 2
    return out


def _spans_of(place: np.ndarray, hit: np.ndarray, widths: int, length: int) -> tuple[list[int], list[int], list[int]]:
    """Row, first and last byte of each run of repeated windows."""
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)  # u below end
    width0 = (place >> 28 & 15) * widths + 1
    return row.tolist(), ((place >> 32)[row] - (width0[row] + end - 1)).tolist(), ((place >> 32)[row] - (width0[row] + begin) + length).tolist()


def _order(length: int, widths: int):
    """mapInArrow function over edges in order of core: the spans of repeated windows."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        core = rows.column("core").to_pylist()
        group = np.cumsum([0] + [a != b for a, b in zip(core, core[1:], strict=False)]) if core else np.zeros(0, np.int64)
        ids, place = rows.column("id").to_numpy(), rows.column("place").to_numpy()
        # a text that came from several tasks is there several times
        _, once = np.unique(np.stack([group, ids, place]), axis=1, return_index=True)
        once.sort()
        left, right = (rows.column(c).take(pa.array(once)).to_pylist() for c in ("left", "right"))
        weight = rows.column("n").to_numpy()[once]
        hit = repeats(group[once], left, right, weight, widths)
        hit[weight > 1] = False  # these are known to repeat
        row, first, last = _spans_of(place[once], hit, widths, length)
        return pa.RecordBatch.from_arrays([pa.array(ids[once][row], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["id", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and sum(map(len, held)) >= BLOCK:
                core = batch.column(0)
                last = held[-1].column(0)[-1]
                at = next((i for i in range(len(batch)) if core[i] != last), len(batch))  # whole cores only
                held.append(batch.slice(0, at))
                if at == len(batch):
                    continue
                yield solve(pa.Table.from_batches(held))
                held, batch = [], batch.slice(at)
            held.append(batch)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _by_windows(edges: DataFrame, widths: int, length: int) -> DataFrame:
    """The same for cores of any number of members: each window is a row, and equal ones are counted before they are shuffled."""
    once = edges.dropDuplicates(["id", "place"])
    each = once.withColumn("u", F.explode(F.sequence(F.greatest(F.lit(0), widths - 1 - F.octet_length("right")), F.least(F.octet_length("left"), F.lit(widths - 1)))))
    window = F.expr(f"unhex(md5(concat(core, substring(left, length(left) - u + 1, u), substring(right, 1, {widths - 1} - u))))")
    each = each.select("id", "place", "n", "u", window.alias("window"))
    found = settle(each.groupBy("window", "u").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1").select("window", "u", F.col("rows").alias("n")))
    again = _joined(each.filter("n = 1").drop("n"), found, ["window", "u"])
    start = F.expr(f"(place >> 32) - ((place >> 28) & 15) * {widths} - 1 - u")
    return again.select("id", start.alias("first"), (start + length).alias("last"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over (id, spans): spans that touch or overlap made one."""
    for batch in batches:
        firsts, lasts, cut = [], [], [0]
        for i in range(len(batch)):
            x = batch.column(1)[i].values
            first, last = (x.field(k).to_numpy() for k in (0, 1))
            order = np.argsort(first, kind="stable")
            first, last = first[order], np.maximum.accumulate(last[order])
            start = np.concatenate([[True], first[1:] > last[:-1]])
            firsts.append(first[start])
            lasts.append(last[np.concatenate([start[1:], [True]])])
            cut.append(cut[-1] + len(firsts[-1]))
        both = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (firsts, lasts)], ["first", "last"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), both)], ["id", "spans"])


_SPANS = "array<struct<first:long,last:long>>"
_KEY = "unhex(md5(text))"


def _holding(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those rows of ``texts`` (hash, text) whose hash is in ``wanted``, which has each hash once; few hashes are broadcast, so that the other texts stay where they are."""
    keys = settle(wanted.select("hash"))
    return texts.join(F.broadcast(keys), "hash", "left_semi") if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else texts


def _small_batches(spark: SparkSession) -> None:
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def repeated_spans(docs: DataFrame, length: int = LENGTH, phrase: int = PHRASE, widths: int = WIDTHS, most_members: int = MOST_MEMBERS) -> DataFrame:
    """hash, size, spans, copies: for each distinct text (by MD5) with repeated strings of ``length`` bytes, the bytes that they cover.

    ``docs`` has text. A string repeats if it starts at another place too, in any document.
    Spans are half-open, in order, and do not touch. Null, empty and shorter texts have none.
    ``length`` must be more than 2 * TRIGGER and at most 16,000; 15 times ``widths`` must reach it.
    """
    _small_batches(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("id"), F.expr(_KEY).alias("hash"), "text").filter(F.octet_length("text") >= length)
    # ids are drawn once, here: the stored table is all that is read from now on
    parse = stored(given.mapInArrow(_parse(length, phrase, widths), "id long, hash binary, size long, place long, core long, whole long"), "parse")
    rows = parse.select("id", "place", "core", "whole")
    cores = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).filter("n > 1")
    cores = stored(cores.select("core", "n", F.col("least").eqNullSafe(F.col("most")).alias("alike")), "cores")
    again = stored(_joined(rows, cores, ["core"]).drop("n"), "again")
    union = [F.expr("(place >> 32) - (place & 16383)").alias("first"), F.expr(f"(place >> 32) - ((place >> 14) & 16383) + {length}").alias("last")]
    found = again.filter("alike").select("id", *union)
    mixed = again.filter("NOT alike")
    classes = stored(mixed.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one")), "classes")
    found = found.unionByName(_joined(mixed.drop("alike"), classes.filter("n > 1").drop("one"), ["core", "whole"]).select("id", *union))
    texts = parse.select("id", "hash", "size").distinct()
    edges = classes.select("one.id", "one.place", "n").filter(f"((place >> 28) & 15) < {_INSIDE}").join(texts, "id")
    wanted = settle(edges.groupBy("hash").agg(F.collect_list(F.struct("place", "n", "id")).alias("edges")))  # as many as the text has places
    with_text = docs.select(F.expr(_KEY).alias("hash"), "text").filter(F.octet_length("text") >= length)
    edges = stored(_once(_holding(with_text, wanted)).join(wanted, "hash").select("text", "edges").mapInArrow(_cut(length, widths), _EDGE), "edges")
    large = settle(edges.groupBy("core").count().filter(F.col("count") > most_members).select("core"))
    ordered = edges
    if large.limit(1).count():
        # fewer than all edges divided by most_members; broadcast only if that is few
        side = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
        ordered = edges.join(side, "core", "left_anti")
        found = found.unionByName(_by_windows(edges.join(side, "core", "left_semi"), widths, length))
    ordered = ordered.repartition("core").sortWithinPartitions("core").mapInArrow(_order(length, widths), "id long, first long, last long")
    spans = found.unionByName(ordered).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # as many as the text has places
    spans = spans.mapInArrow(_merged, f"id long, spans {_SPANS}")
    # texts that came from several tasks have the same spans
    return settle(spans.join(texts, "id").groupBy("hash").agg(F.first("size").alias("size"), F.first("spans").alias("spans")))


def _once(texts: DataFrame) -> DataFrame:
    """Each text once in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return texts.select("hash", "text").mapInArrow(run, "hash binary, text string")


def _kept(text: int, spans: int):
    """mapInArrow function: the columns, and the bytes of the column ``text`` outside the spans in column ``spans``, a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, held = 0, [], 0
            for i, (one, lost) in enumerate(zip(batch.column(text), batch.column(spans), strict=True)):
                data, parts, begin = one.as_buffer().to_pybytes(), [], 0
                for s in lost.as_py():
                    parts.append(data[begin : s["first"]])
                    begin = s["last"]
                out.append(b"".join([*parts, data[begin:]]))
                held += len(data)
                if held >= BATCH_BYTES or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(out)).columns, pa.array(out, pa.binary())], [*batch.schema.names, "kept"])
                    at, out, held = i + 1, [], 0

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, **parts: int) -> DataFrame:
    """Add n_bytes, spans (half-open, of bytes) and kept (the bytes outside them) to the rows of ``docs``.

    ``docs`` has text; null counts as empty. Rows with equal texts are documents of their own,
    so texts of ``length`` bytes and more that are there twice lose all. Kept bytes may cut
    a character. Columns of the same names as the added ones are replaced. Texts without spans,
    and those that lose all, stay where they are as long as the distinct ones with spans are few.
    """
    inner, restore = shield(docs, ("text",))
    spans = repeated_spans(docs, length, **parts).withColumn("whole", F.expr("size(spans) = 1 AND spans[0].first = 0 AND spans[0].last = size"))
    given = inner.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "hash": F.expr(_KEY)})
    few = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = spans.select("hash", F.col("whole").alias("_whole"))
    flagged = given.join(F.broadcast(side) if few else side, "hash", "left")
    untouched = flagged.filter("coalesce(_whole, true)")
    all_bytes = F.when(F.col("_whole"), F.lit(b"")).otherwise(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    no_spans = F.expr(f"CASE WHEN _whole THEN array(named_struct('first', 0L, 'last', n_bytes)) ELSE cast(array() AS {_SPANS}) END")
    untouched = untouched.select(*inner.columns, "n_bytes", no_spans.alias("spans"), all_bytes.alias("kept"))
    counts = given.groupBy("hash").agg(F.count("*").alias("n")).join(spans.filter("NOT whole").select("hash", "spans"), "hash")
    cut = _joined(flagged.filter("NOT _whole"), settle(counts), ["hash"])
    cut = cut.select(*inner.columns, "n_bytes", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    cut = cut.mapInArrow(_kept(inner.columns.index("text"), len(inner.columns) + 1), f"{schema}, kept binary")
    return restore(untouched.unionByName(cut), "n_bytes", "spans", "kept")


def digest(docs: DataFrame, length: int = LENGTH, **parts: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the kept bytes of each document."""
    out = remove_repeats(docs.select("doc_id", "text"), length, **parts)
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return out.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
