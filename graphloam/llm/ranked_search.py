"""Ranked lexical search: all documents against every item, by sort-based accumulation.

Documents are read once into their postings: for each term of the items that a document has,
the term's number and its count. Tasks then turn each posting into (item, document, impact)
entries for all items with that term, put them end to end, sort them by a packed key of item
and document with a radix sort, add up runs of equal keys, and keep the best of each item on
a heap. Only what is on the heaps is shuffled. Items beyond the bounds of a broadcast meet the
postings in a join by term, and the entries are dealt by ranges of (item, document) to tasks
that add up runs and select in the same way.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.llm import wordbytes as wb
from graphloam.llm.common import settle, small, small_batches
from graphloam.session import stored

TOP = 50
#: Entries that are sorted at once; a document has at most ``MOST_PAIRS``.
ENTRIES = 1 << 21
#: Pairs of item and term that may be broadcast, about 100 bytes each, and items that may have a heap in every task, about 10 KB each.
MOST_PAIRS, MOST_ITEMS = 1_000_000, 10_000
#: Words longer than this are compared by their bytes and not by two hashes.
LONG_WORD = 64

#: log2 of the bits of the filter that words pass before they are shuffled.
FILTER_BITS = 27
SALTS = 32

_POSTINGS = "doc long, doc_id long, n long, terms array<int>, counts array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, word: the distinct words of each item's whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, word = [], []
            for at, run in wb.batched(batch.column(1)):
                data, s, e, _, bounds = wb.run_words(run, wb.ALNUM)
                for i in range(len(run)):
                    found = {data[s[j] : e[j]].tobytes() for j in range(bounds[i], bounds[i + 1])}
                    item += [batch.column(0)[at + i].as_py()] * len(found)
                    word += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(word, pa.binary())], ["item", "word"])

    return items.select("item", "text").mapInArrow(cut, "item long, word binary")


def _check(data: np.ndarray) -> np.ndarray:
    """A second hash of a word's bytes, by another base than the first one's; the bytes are given one row a word."""
    out = np.zeros(len(data), np.uint64)
    for column in data.T:
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + column.astype(np.uint64) + np.uint64(1)
    return out


def _equal(data: np.ndarray, s: np.ndarray, e: np.ndarray, number: np.ndarray, words: list[bytes], checks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether word i of ``data`` is term ``number[i]``, whose hash it has."""
    good = (e - s) == lengths[number]
    for n in np.unique((e - s)[good]).tolist():
        rows = np.flatnonzero(good & (e - s == n))
        if n <= LONG_WORD:
            good[rows] = _check(data[s[rows][:, None] + np.arange(n)]) == checks[number[rows]]
        else:
            good[rows] = [data[s[r] : e[r]].tobytes() == words[number[r]] for r in rows]
    return good


def _scan(held):
    """mapInArrow function over (doc, doc_id, text): the number of words and the postings of the terms in ``held``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, order, hashes, checks, lengths = held.value
        look, many = wb.Lookup(hashes), max(1, len(words))
        for batch in batches:
            n, terms, counts = [], [], []
            for _, run in wb.batched(batch.column(2)):
                data, s, e, h, bounds = wb.run_words(run, wb.ALNUM)
                at = look.find(h)
                hit = np.flatnonzero(at >= 0)
                number = order[at[hit]]
                good = _equal(data, s[hit], e[hit], number, words, checks, lengths)
                hit, number = hit[good], number[good]
                text = np.searchsorted(bounds, hit, "right") - 1
                keys, times = np.unique(text * many + number, return_counts=True)
                cut = np.searchsorted(keys, np.arange(1, len(run)) * many)
                terms += np.split((keys % many).astype(np.int32), cut)
                counts += np.split(times.astype(np.int32), cut)
                n += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc", "doc_id", "n", "terms", "counts"])

    return scan


def _vocabulary(words: list[bytes]) -> tuple:
    """The terms with what a scan needs to find them: hashes in order, their numbers, second hashes, lengths."""
    joined = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    hashes = wb.hash_spans(joined, ends - lengths, ends)
    checks = np.zeros(len(words), np.uint64)
    for n in np.unique(lengths[lengths <= LONG_WORD]).tolist():
        rows = np.flatnonzero(lengths == n)
        checks[rows] = _check(joined[(ends - lengths)[rows][:, None] + np.arange(n)])
    order = np.argsort(hashes, kind="stable")
    return words, order, hashes[order], checks, lengths


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, 16 bits at a time from the lowest."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # numpy sorts 16 bits by radix
    top = int(keys.max(initial=0))
    for shift in range(16, top.bit_length(), 16):
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def summed(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, doc and sum of impacts of each distinct pair; ``doc`` is below ``docs``."""
    keys = item.astype(np.int64) * docs + doc
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    score = np.add.reduceat(impact[order], first) if len(first) else np.zeros(0, np.int64)
    return keys[first] // docs, keys[first] % docs, score


_BEST = "item long, doc long, doc_id long, score long"


class Best:
    """The ``top`` best rows of each item so far: greatest score, then least doc_id with null last, then least doc."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}

    def add(self, item: np.ndarray, score: np.ndarray, where: np.ndarray, ids: list, doc: np.ndarray) -> None:
        """Rows in order of item, each with its place in ``ids`` and ``doc``; those that can still get on a heap are looked at one by one."""
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else []
        for a, b in zip(starts, [*starts[1:], len(item)], strict=False):
            heap, part = self.heaps.setdefault(int(item[a]), []), score[a:b]
            least = heap[0][0] if len(heap) == self.top else 1
            if b - a > self.top:
                least = max(least, int(np.partition(part, b - a - self.top)[b - a - self.top]))
            for i in (a + np.flatnonzero(part >= max(1, least))).tolist():
                at = int(where[i])
                entry = (int(score[i]), ids[at] is not None, -(ids[at] or 0), -int(doc[at]))
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def batch(self, names: np.ndarray | None = None) -> pa.RecordBatch:
        rows = [(int(item if names is None else names[item]), -e[3], -e[2] if e[1] else None, e[0]) for item, heap in self.heaps.items() for e in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["item", "doc", "doc_id", "score"])


_ITEM_BITS = 32


def _accumulate(held, top: int):
    """mapInArrow function over (doc, doc_id, norm, terms, counts): the best of each item in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pairs, names = held.value  # pairs: term and place of item in one number, in order
        first = np.searchsorted(pairs, np.arange(len(weight) + 1) << _ITEM_BITS)
        best = Best(top)
        for batch in batches:
            doc, ids, norm = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column(3).offsets.to_numpy()))
            term, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (3, 4))
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[row]))
            n = first[term + 1] - first[term]
            block = np.cumsum(np.bincount(row, n, len(batch)).astype(np.int64)) // ENTRIES  # whole documents
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
            for d0, d1 in zip(edges, edges[1:], strict=False):
                a, b = np.searchsorted(row, (d0, d1))
                m = n[a:b]
                entry = np.repeat(first[term[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                item, where, score = summed(pairs[entry] & ((1 << _ITEM_BITS) - 1), np.repeat(row[a:b] - d0, m), np.repeat(impact[a:b], m), d1 - d0)
                best.add(item, score, where + d0, ids, doc)
        yield best.batch(names)

    return run


def _merge(top: int):
    """mapInArrow function over (item, doc, doc_id, impact) in order of item and doc: the best of each item in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(top), None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            item, doc, impact = (batch.column(i).to_numpy() for i in (0, 1, 3))
            first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])) if len(batch) else np.zeros(0, np.int64)
            held = batch.slice(int(first[-1])) if len(first) else None  # a run may go on in the next batch
            if len(first) > 1:
                score = np.add.reduceat(impact[: first[-1]], first[:-1])
                best.add(item[first[:-1]], score, first[:-1], batch.column(2).to_pylist(), doc)
        if held is not None:
            best.add(held.column(0).to_numpy()[:1], np.array([sum(held.column(3).to_pylist())]), np.zeros(1, np.int64), held.column(2).to_pylist(), held.column(1).to_numpy())
        yield best.batch()

    return run


def _norm(docs: int, words: int) -> Column:
    """50 + (50 * n * docs) div words, in numbers that cannot overflow."""
    return F.expr(f"50L + (cast(50 AS decimal(3, 0)) * cast(n AS decimal(17, 0)) * cast({docs} AS decimal(15, 0))) div {max(words, 1)}")


def _weight(docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * held + 1)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_pairs: int = MOST_PAIRS, most_items: int = MOST_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each row of ``items``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Null
    and empty texts have no terms: such documents are found by nothing, such items find
    nothing. Rows of ``items`` are items of their own, also with equal or null ids. Rows of
    ``docs`` with equal ids are found each by itself; equal scores go by ascending doc_id,
    null last. A term that nearly all documents hold weighs 0. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    # a settled table keeps its order, so its row numbers do too
    asked = settle(items.select("item_id", "text")).withColumn("item", F.monotonically_increasing_id())
    pairs = settle(item_terms(asked))
    given = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")
    few = asked.limit(most_items + 1).count() <= most_items and pairs.limit(most_pairs + 1).count() <= most_pairs
    found = _by_broadcast(given, pairs, top) if few else _by_ranges(given, pairs, top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "doc"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(small(asked.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")


def _by_broadcast(given: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """The best of each item in each partition; the items and their terms go to every task."""
    spark, rows = given.sparkSession, pairs.collect()  # at most the bound of pairs
    words = sorted({bytes(r["word"]) for r in rows})
    place, names = {w: i for i, w in enumerate(words)}, np.unique(np.array([r["item"] for r in rows], np.int64))
    packed = np.sort((np.array([place[bytes(r["word"])] for r in rows], np.int64) << _ITEM_BITS) + np.searchsorted(names, np.array([r["item"] for r in rows], np.int64)))
    found = given.mapInArrow(_scan(spark.sparkContext.broadcast(_vocabulary(words))), _POSTINGS)
    postings = stored(found.filter("n > 0"), "postings")
    size = postings.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    held = {r["t"]: r["n"] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row for each term
    weight = np.array([_weight(size["docs"], held.get(t, 0)) for t in range(len(words))], np.int64)
    index = spark.sparkContext.broadcast((weight, packed, names))
    return postings.select("doc", "doc_id", _norm(size["docs"], size["words"]).alias("norm"), "terms", "counts").mapInArrow(_accumulate(index, top), _BEST)


def _words(held):
    """mapInArrow function over (doc, doc_id, text): number of words, and the distinct words that pass a filter with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            n, words, counts = [], [], []
            for _, texts in wb.batched(batch.column(2)):
                data, s, e, h, bounds = wb.run_words(texts, wb.ALNUM)
                bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero(seen[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                cut = np.searchsorted(hit, bounds)
                for i in range(len(texts)):
                    found = Counter(data[s[j] : e[j]].tobytes() for j in hit[cut[i] : cut[i + 1]])
                    words.append(list(found))
                    counts.append(list(found.values()))
                n += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))], ["doc", "doc_id", "n", "words", "counts"])

    return run


def _filter_bits(pairs: DataFrame) -> bytes:
    """A bit for the top bits of each word's hash: fixed size, whatever the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = set()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                bits.add(int(_vocabulary([word])[2][0] >> np.uint64(64 - FILTER_BITS)))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bits), pa.int64())], ["bit"])

    seen = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    packed = pairs.select("word").distinct().mapInArrow(run, "bit long").groupBy(F.expr("bit div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 AS int)))").alias("bits"))
    for r in packed.toLocalIterator():  # at most one row for each byte of the filter
        seen[r["byte"]] = r["bits"]
    return seen.tobytes()


def _by_ranges(given: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """The same for any number of items: postings meet items in a join by term, entries are dealt by ranges of (item, doc)."""
    spark = given.sparkSession
    found = stored(given.mapInArrow(_words(spark.sparkContext.broadcast(_filter_bits(pairs))), "doc long, doc_id long, n long, words array<binary>, counts array<long>").filter("n > 0"), "postings")
    size = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    postings = found.select("doc", "doc_id", _norm(size["docs"], size["words"]).alias("norm"), F.explode(F.arrays_zip("words", "counts")).alias("p")).select("doc", "doc_id", "norm", "p.words", "p.counts")
    held = postings.groupBy("words").agg(F.count("*").alias("df"))
    terms = pairs.join(held, F.col("word") == F.col("words")).select("item", "word", F.floor(1000 * F.log((F.lit(2.0) * size["docs"] + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    # a term may be in many documents and many items, so both sides are dealt by a salt as well
    each = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = postings.withColumn("salted", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    impact = F.expr("w * ((1000000000L * counts) div (1000L * counts + 20L * norm))")
    entries = mine.join(each, (F.col("words") == F.col("word")) & (F.col("salted") == F.col("salt"))).select("item", "doc", "doc_id", impact.alias("impact"))
    return entries.repartitionByRange("item", "doc").sortWithinPartitions("item", "doc").mapInArrow(_merge(top), _BEST)
