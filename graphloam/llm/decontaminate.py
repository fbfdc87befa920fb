"""Benchmark decontamination: windows of test words found in training texts.

The windows of all benchmark items become a set of hashes that every task gets, if the set is
within its bound. Tasks slide the same windows over whole texts, check each hit word by word,
and mark the words. A larger set is not broadcast: texts then meet the windows in a shuffle
join by hash, after a filter of fixed size has removed nearly all windows that are in no item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.llm import wordbytes as wb
from graphloam.llm.common import ascii_lower, join_salted, settle, shield, small_batches

WIDTH = 10
#: Windows that may be broadcast: about 500 bytes each on the driver and in a task.
MOST_WINDOWS = 200_000
#: log2 of the bits of the filter for a larger set.
FILTER_BITS = 27
SALTS = 8

_WINDOWS = "hash long, width int, words binary, item string"


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, width, words and item of each window of each item. Null texts and items without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, out = batch.column(0).to_pylist(), []
            for at, run in wb.batched(batch.column(1)):
                data, s, e, h, bounds = wb.run_words(run, wb.ALNUM)
                for i in range(len(run)):
                    a, b = bounds[i], bounds[i + 1]
                    w = min(width, int(b - a))
                    for k, x in enumerate(wb.windows(h[a:b], w) if w else ()):
                        out.append((int(x.view(np.int64)), w, b" ".join(data[s[j] : e[j]].tobytes() for j in range(a + k, a + k + w)), items[at + i]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.string()))], ["hash", "width", "words", "item"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, _WINDOWS).distinct()


def _lookup(rows: list) -> dict:
    """Windows by width: sorted hashes and, by hash, the words and items."""
    out: dict = {}
    for r in rows:
        _, by_hash = out.setdefault(r["width"], (None, {}))
        by_hash.setdefault(np.int64(r["hash"]).view(np.uint64).item(), {}).setdefault(bytes(r["words"]), []).append(r["item"])
    return {w: (np.array(sorted(d), np.uint64), d) for w, (_, d) in out.items()}


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Positions of the values that are in a sorted array; a filter by 16 bits comes first."""
    seen = np.zeros(1 << 16, bool)
    seen[(ordered >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(seen[(values >> np.uint64(48)).astype(np.int64)])
    near = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    return at[ordered[near] == values[at]]


def _inside(positions: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that end in the text they start in, and their texts."""
    text = np.searchsorted(bounds, positions, "right") - 1
    good = positions + width <= bounds[text + 1]
    return positions[good], text[good]


_HITS = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def _scan(held, columns: int):
    """mapInArrow function: the last column is the text, the ones before are passed on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = held.value
        for batch in batches:
            n_words, hits, found_items = [], [], []
            for _, run in wb.batched(batch.column(columns)):
                data, s, e, h, bounds = wb.run_words(run, wb.ALNUM)
                marks: list[list] = [[] for _ in run]
                items: list[set] = [set() for _ in run]
                for width, (ordered, by_hash) in lookup.items():
                    at, text = _inside(_member(wb.windows(h, width), ordered) if len(h) >= width else np.zeros(0, np.int64), bounds, width)
                    if not len(at):
                        continue
                    for k, i, x in zip(at.tolist(), text.tolist(), wb.windows(h, width)[at].tolist(), strict=True):
                        words = b" ".join(data[s[j] : e[j]].tobytes() for j in range(k, k + width))
                        if words in by_hash[x]:
                            marks[i].append((k - int(bounds[i]), k - int(bounds[i]) + width))
                            items[i].update(item for item in by_hash[x][words] if item is not None)
                n_words += np.diff(bounds).tolist()
                hits += [merged(m) for m in marks]
                found_items += [sorted(x) for x in items]
            spans = pa.array([[{"first": a, "last": b} for a, b in x] for x in hits], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(n_words, pa.int64()), spans, pa.array(found_items, pa.list_(pa.string()))], [*batch.schema.names[:columns], "n_words", "hits", "items"])

    return scan


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Add n_words, hits (half-open spans of word numbers), items and contaminated to the rows of ``docs``.

    Items of fewer than ``width`` words are one window. Null and empty texts have no words and
    no hits. The words of an item with a null id are hit as others are, but it has no id to
    name; equal ids count as one item. Columns of the same names as the added ones are
    replaced. An empty benchmark marks nothing.
    """
    small_batches(docs.sparkSession)
    inner, restore = shield(docs, ("text",))
    windows = settle(benchmark_windows(benchmark, width))
    rows = windows.limit(most_windows + 1).collect()
    if len(rows) <= most_windows:
        held = docs.sparkSession.sparkContext.broadcast(_lookup(rows))
        given = inner.select(*inner.columns, F.col("text").alias("_scanned"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
        out = given.mapInArrow(_scan(held, len(inner.columns)), f"{schema}, {_HITS}")
    else:
        out = _joined(inner, windows, width)
    return restore(out.withColumn("contaminated", F.size("hits") > 0), "n_words", "hits", "items", "contaminated")


def _joined(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """As the scan, for a set of windows of any size: only windows that pass a fixed-size filter are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(windows))
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # width values at most

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            key, out = batch.column(0).to_pylist(), []
            for at, run in wb.batched(batch.column(1)):
                data, s, e, h, bounds = wb.run_words(run, wb.ALNUM)
                for w in widths:
                    x = wb.windows(h, w)
                    slot = x >> np.uint64(64 - FILTER_BITS)
                    may = np.flatnonzero(table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    for k, i in zip(*(y.tolist() for y in _inside(may, bounds, w)), strict=True):
                        out.append((key[at + i], k - int(bounds[i]), w, int(x[k].view(np.int64)), b" ".join(data[s[j] : e[j]].tobytes() for j in range(k, k + w))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["key", "first", "width", "hash", "words"])

    given = docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    # equal texts are one key; a window that very many texts have is dealt to SALTS tasks
    seen = given.select("_key", "text").mapInArrow(candidates, "key binary, first long, width int, hash long, words binary").distinct()
    seen = seen.withColumn("_salt", F.pmod(F.xxhash64("key", "first"), F.lit(SALTS)).cast("int"))
    every = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = seen.join(every, ["hash", "width", "words", "_salt"]).groupBy("key").agg(F.collect_set(F.struct("first", (F.col("first") + F.col("width")).alias("last"))).alias("_spans"), F.sort_array(F.collect_set("item")).alias("items"))
    joined = join_salted(given, settle(hits), "_key", "key", F.spark_partition_id(), SALTS, "left")
    empty = F.array().cast("array<struct<first:long,last:long>>")
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["last"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))),
    ).otherwise(F.concat(acc, F.array(x)))
    spans = F.aggregate(F.sort_array(F.coalesce("_spans", empty)), empty, step)
    counted = F.regexp_count(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    return joined.select(*docs.columns, counted.cast("long").alias("n_words"), spans.alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _filter(windows: DataFrame) -> bytes:
    """A bit for each window hash, gathered as one bitmap of 2**FILTER_BITS bits, at most, from each task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [np.unique(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)) for b in batches]
        if slots:
            all_slots = np.unique(np.concatenate(slots)).astype(np.int64)
            byte, first = np.unique(all_slots >> 3, return_index=True)
            value = np.bitwise_or.reduceat((1 << (all_slots & 7)).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([pa.array(byte, pa.int64()), pa.array(value, pa.int64())], ["byte", "value"])

    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in windows.select("hash").mapInArrow(part, "byte long, value long").groupBy("byte").agg(F.bit_or("value").alias("value")).toLocalIterator():
        table[row["byte"]] = row["value"]
    return table.tobytes()


def remove_spans(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """``found`` with the words of its hits cut out of ``text``, with what stands between them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hits = batch.schema.names, batch.column(batch.schema.names.index("hits")).to_pylist()
            at, out = names.index("text"), []
            for data, spans in zip(wb.texts(batch.column(at)), hits, strict=True):
                if not spans:
                    out.append(None if data is None else data.tobytes().decode())
                    continue
                s, e, _ = wb.words(wb.lower_bytes(data), wb.ALNUM)
                whole, keep, last = data.tobytes(), [], 0
                for x in spans:
                    keep.append(whole[last : int(s[x["first"]])])
                    last = int(e[x["last"] - 1])
                out.append(b"".join([*keep, whole[last:]]).decode())
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(cut, found.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit, with their own columns."""
    return find_contamination(docs, benchmark, width).filter(~F.col("contaminated")).select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of words, hit words and items of each document, and the sha256 of its items."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), "contaminated")
