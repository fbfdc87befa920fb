"""Near-duplicate groups by Order MinHash and banded alignment.

The k-mers of a text are its runs of five words, each labelled with the number of its earlier
occurrences, so that a text with repeats is a set. Each sketch entry takes the ``tuple_size``
labelled k-mers with the least hashes and keeps them in text order: two texts agree on an entry
only if they share those k-mers in that order, which follows their edit similarity. Texts that
agree on an entry are candidates; a banded alignment of their words decides. Of texts whose
words were replaced at random places, 96 entries of two five-word k-mers give (measured on 200
pairs each) 94 % of the pairs of 100 words at similarity 0.80 and 98 % of those of 200 and 600,
and at least 99.5 % from 0.85 on. Texts of SHORT words and less hold too few k-mers for that:
all their runs of four words (of two or three in the shortest) are entries, so that all of
their similar pairs are candidates.

Equal texts are one node. Buckets with the same members are one bucket. In each bucket the
members are paired with a representative first (the least of a random order). Then members of a bucket that are not yet in one component are compared, in blocks of
bounded size inside the tasks: with all texts of the largest component of their bucket until
one is similar, and all among themselves. Lengths and word counts rule out most pairs before
an alignment, and nothing but links leaves the comparison. So the components are those of all similar pairs that share a
bucket.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloam.llm import wordbytes as wb
from graphloam.llm.common import join_salted, packed, settle, shield, small, small_batches
from graphloam.llm.components import connected_components

KMER, ENTRIES, TUPLE, SIMILARITY = 5, 96, 2, 0.8
#: Texts up to so many words go by all their runs of words, and by the sketch only where a partner may be longer.
SHORT = 80
#: Members of a bucket, and texts of a component, in a block, about; a task holds a block and another one that it is compared with.
BLOCK, WORD_BLOCK = 512, 256
#: Bins of the word counts of a text: their differences bound the edit distance from below.
BINS = 256
#: Rows of a table of 64-bit keys that may be broadcast: about 40 bytes each.
KEYS = 400_000
#: Words of the longer text up to which an alignment holds the places of every word as one integer each.
PLACES = 8_000
#: Texts of a task of the table of words, about.
TEXTS = 4_000
#: Hash values that a sketch holds at a time.
_CELLS = 1 << 21


def _labelled(kmers: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with the number of earlier occurrences of the same k-mer."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    out = np.empty_like(kmers)
    out[order] = wb.mix(ordered + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def sketch(words: np.ndarray, kmer: int = KMER, entries: int = ENTRIES, tuple_size: int = TUPLE) -> np.ndarray:
    """The Order MinHash sketch of a sequence of word hashes: ``entries`` 64-bit values."""
    if not len(words):
        return np.zeros(0, np.uint64)
    kmers = _labelled(wb.windows(words, min(kmer, len(words))))
    multipliers = wb.mix(np.arange(1, entries + 1, dtype=np.uint64)) | np.uint64(1)
    size, rows = min(tuple_size, len(kmers)), max(1, _CELLS // len(kmers))
    out = np.arange(entries, dtype=np.uint64)
    for j in range(0, entries, rows):
        hashed = kmers[None, :] * multipliers[j : j + rows, None]
        line = np.arange(len(hashed))
        least = np.empty((len(hashed), size), np.int64)
        for t in range(size):
            least[:, t] = hashed.argmin(axis=1)
            hashed[line, least[:, t]] = np.iinfo(np.uint64).max
        least.sort(axis=1)  # text order
        for t in range(size):
            out[j : j + rows] = wb.mix(out[j : j + rows] * np.uint64(0xD6E8FEB86659FD93) + kmers[least[:, t]])
    return out


def entries_of(words: np.ndarray) -> np.ndarray:
    """The entries of a text: its sketch, and of a short text all runs of two, three or four words.

    d <= 0.2 n edits leave one of d + 1 pieces of the longer text whole, of ceil((n - d) / (d + 1))
    words at least: four from 16 words on, three from 6, two in 5; shorter texts are similar
    only if equal or to one of 5 words. A text has partners of 0.8 to 1.25 times as many words,
    so those near a limit have the entries of both sides.
    """
    n, found = len(words), []
    if n <= SHORT * 1.25:
        for width, least, most in ((2, 4, 5), (3, 5, 15), (4, 13, n)):
            if least <= n <= most:
                found.append(wb.mix(np.unique(wb.windows(words, width)) + np.uint64(width)))
    if n > SHORT:
        found.append(sketch(words))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class _Places:
    """The places of each word of a text inside a window, as the bits of an integer; bit 0 is the window's first place."""

    def __init__(self, words: list):
        self.whole: dict | None = {} if len(words) <= PLACES else None
        if self.whole is not None:
            for i, x in enumerate(words):
                self.whole[x] = self.whole.get(x, 0) | 1 << i
            return
        held = np.array(words, np.int64)
        order = np.argsort(held, kind="stable")
        value, first = np.unique(held[order], return_index=True)
        self.at = dict(zip(value.tolist(), np.split(order, first[1:]), strict=True))

    def bits(self, word: int, start: int, width: int) -> int:
        """The places of ``word`` from ``start`` (which may be negative) on."""
        if self.whole is not None:
            held = self.whole.get(word, 0)
            return (held >> start if start >= 0 else held << -start) & ((1 << width) - 1)
        places = self.at.get(word)
        if places is None:
            return 0
        near = places[np.searchsorted(places, start) : np.searchsorted(places, start + width)] - start
        if len(near) <= 4:
            return sum(1 << int(p) for p in near)
        marks = np.zeros(width, np.uint8)
        marks[near] = 1
        return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def banded_distance(a: list, b: list, most: int) -> int:
    """The edit distance of two sequences if it is at most ``most``, else most + 1.

    Columns of the alignment table are vectors of bits, one integer each, that hold only the
    diagonals within ``most`` of the main one. Memory is linear in the texts.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    most = min(most, n)
    # bit k of a column stands for row j - most + k of the table, for column j of b
    width = 2 * most + 1
    mask = (1 << width) - 1
    places = _Places(a)
    top = 1 << (width - 1)
    plus, minus = mask ^ ((1 << most) - 1), 0  # vertical differences of the column before; none above row 0
    # distance on the diagonal through the last row of the band
    score = most
    for j in range(m):
        match = places.bits(b[j], j - most, width)
        d0 = (((match & plus) + plus) ^ plus) | match | minus
        d0 &= mask
        hp = minus | ~(d0 | plus) & mask
        hn = d0 & plus
        if j + most < n:
            score += not d0 & top
        else:
            bit = 1 << (n - 1 - j + most)
            if hp & bit:
                score += 1
            elif hn & bit:
                score -= 1
        x = d0 >> 1
        plus = hn | ~(x | hp) & mask
        minus = x & hp
    return score if score <= most else most + 1


def distance(a: list, b: list) -> int:
    """The edit distance by the whole table; for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least ``similarity``."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) <= most


def _names(run: list, hashes: np.ndarray, bounds: np.ndarray) -> list:
    """16 bytes for the words of each text: equal for equal words only. Texts without words go by their bytes; null has none."""
    out = []
    for i, data in enumerate(run):
        if data is None:
            out.append(None)
            continue
        words = hashes[bounds[i] : bounds[i + 1]]
        out.append(hashlib.blake2b(words.tobytes() if len(words) else b"\0" + data.tobytes(), digest_size=16).digest())
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, run in wb.batched(batch.column(1)):
            _, _, _, h, bounds = wb.run_words(run, wb.ALNUM)
            found = [entries_of(h[bounds[i] : bounds[i + 1]]) for i in range(len(run))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            entries = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), pa.array(_names(run, h, bounds), pa.binary()), entries, pa.array(np.diff(bounds), pa.int32())], ["doc_id", "node", "entries", "n_words"])


def _bag(words: np.ndarray) -> bytes:
    """How many words fall into each of BINS bins by their hash, 255 at most."""
    return np.minimum(np.bincount(words % np.uint32(BINS), minlength=BINS), 255).astype(np.uint8).tobytes()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as 32-bit values: enough to align with, at less than the bytes of the text."""
    for batch in batches:
        for at, run in wb.batched(batch.column(1)):
            _, _, _, h, bounds = wb.run_words(run, wb.ALNUM)
            short = (h >> np.uint64(32)).astype(np.uint32)
            each = [short[bounds[i] : bounds[i + 1]] for i in range(len(run))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(run)), pa.array(_names(run, h, bounds), pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())],
                ["doc_id", "node", "words"],
            )


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.frombuffer(x, np.uint32).tolist(), np.frombuffer(y, np.uint32).tolist(), similarity) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node, entries and n_words of each row of ``docs``: one pass over the texts, settled."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(docs.select("doc_id", "text").mapInArrow(_sketches, f"doc_id {kind}, node binary, entries array<long>, n_words int"))


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """entry, node of each member of a bucket of several nodes (columns node, entries), settled; of buckets with the same members, one."""
    entries = nodes.select("node", F.explode("entries").alias("entry"))
    counted = entries.groupBy("entry").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    several = settle(counted.groupBy("n", "members").agg(F.min("entry").alias("_entry")).select("_entry"))
    return packed(entries.join(small(several, KEYS), F.col("entry") == F.col("_entry")).select("entry", "node"))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """a, b: members of buckets (columns entry, node) with the representative of their bucket: the least of one random order.

    One order for all buckets, so that buckets of nearly the same members mostly have the same
    representative, and a text few of them.
    """
    buckets = rows.groupBy("entry").agg(F.min_by("node", F.xxhash64("node")).alias("head"))
    buckets = settle(buckets.select(F.col("entry").alias("_entry"), "head"))
    pairs = join_salted(rows, buckets, "entry", "_entry", F.xxhash64("node")).filter("node <> head")
    return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _apart(bag: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance from the bags of words of one text and of others, row by row."""
    apart = bag.astype(np.int16) - other
    more = np.maximum(apart, 0).sum(1)
    return np.maximum(more, more - apart.sum(1))


def _cells(keys: tuple[str, ...], compare):
    """mapInArrow function over rows sorted by ``keys``: ``compare`` gets the rows of one key at a time and gives lists of (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of a cell that the next batch may continue
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not len(held):
                continue
            values = [held.column(c).to_numpy() for c in keys]
            starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in values], axis=0)]))
            ends = np.append(starts[1:], len(held))
            found = []
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b < len(held) or batch is None:
                    found += compare(held.slice(a, b - a))
            held = held.slice(starts[-1]).combine_chunks()
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _bags(words: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(_bag(w) for w in words), np.uint8).reshape(len(words), BINS)


def _new_links(similarity: float):
    """The pairs of a cell that align and are not yet joined there.

    Two texts may share many buckets (``entries``); their own hashes choose the one in which they
    are compared, so that they are compared once.
    """

    def links(cell: pa.Table) -> list:
        node, comp, i, j, block = (cell.column(c).to_numpy() for c in ("node", "comp", "i", "j", "block"))
        words, entries = [np.frombuffer(w, np.uint32) for w in cell.column("words").to_pylist()], [np.array(e, np.int64) for e in cell.column("entries").to_pylist()]
        n, bag, entry, chosen = np.array([len(w) for w in words]), _bags(words), cell.column("entry")[0].as_py(), wb.mix(node.astype(np.uint64))
        left, right, alone = np.flatnonzero(block == i), np.flatnonzero(block == j), i[0] == j[0]
        joined: dict = {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        a, b = [], []
        for x in left:
            near = right[(comp[right] != comp[x]) & (np.minimum(n[x], n[right]) >= similarity * np.maximum(n[x], n[right]))]
            near = near[node[near] > node[x]] if alone else near
            near = near[_apart(bag[x], bag[near]) <= np.floor((1 - similarity) * np.maximum(n[x], n[near]) + 1e-9)]
            for y in near:
                if root(comp[x]) == root(comp[y]):
                    continue
                shared = np.intersect1d(entries[x], entries[y], assume_unique=True)
                if shared[int((chosen[x] ^ chosen[y]) % np.uint64(len(shared)))] == entry and similar(words[x].tolist(), words[y].tolist(), similarity):
                    joined[root(comp[x])] = root(comp[y])
                    a.append(node[x])
                    b.append(node[y])
        return [(np.array(a, np.int64), np.array(b, np.int64))]

    return links


def _first_links(similarity: float):
    """For each left row of a cell the first right row, from the nearest bag on, that aligns with it."""

    def links(cell: pa.Table) -> list:
        node, right = cell.column("node").to_numpy(), cell.column("right").to_numpy()
        words = [np.frombuffer(w, np.uint32) for w in cell.column("words").to_pylist()]
        n, bag = np.array([len(w) for w in words]), _bags(words)
        others, a, b = np.flatnonzero(right), [], []
        for x in np.flatnonzero(~right):
            near = others[np.minimum(n[x], n[others]) >= similarity * np.maximum(n[x], n[others])]
            apart = _apart(bag[x], bag[near])
            good = apart <= np.floor((1 - similarity) * np.maximum(n[x], n[near]) + 1e-9)
            for y in near[good][np.argsort(apart[good], kind="stable")]:
                if similar(words[x].tolist(), words[y].tolist(), similarity):
                    a.append(node[x])
                    b.append(node[y])
                    break
        return [(np.array(a, np.int64), np.array(b, np.int64))]

    return links


def _deal(left: DataFrame, right: DataFrame, key: str, g: str, h: str, what: list[str]) -> DataFrame:
    """Both sides dealt to blocks: a left row of block i meets a right row of block j in the cell (key, i, j) alone."""
    cells = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    x = left.select(key, block(g).alias("i"), cells(h).alias("j"), F.lit(False).alias("right"), *what)
    y = right.select(key, cells(g).alias("i"), block(h).alias("j"), F.lit(True).alias("right"), *what)
    return x.unionByName(y).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def remaining_links(rows: DataFrame, words: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links between texts that share a bucket and that no component (node, component) has yet.

    In buckets of two the representative has met the other: they are left out. A member
    outside the largest component of its bucket meets all texts of that component, once, until
    one is similar: a link to it is a link to all. The members outside, and the largest component where
    it has one member there, are compared among themselves.
    """
    large = rows.groupBy("entry").agg(F.count("*").alias("n")).filter("n > 2").select(F.col("entry").alias("_entry"))
    rows = join_salted(rows, settle(large), "entry", "_entry", F.xxhash64("node")).select("entry", "node")
    inside = packed(classes.select(F.col("node").alias("_n"), "component"))
    rows = packed(rows.join(small(inside, KEYS), F.col("node") == F.col("_n"), "left").select("entry", "node", F.coalesce("component", "node").alias("comp")))
    parts = rows.groupBy("entry", "comp").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("entry").agg(F.max(F.struct("n", "comp")).alias("_top"), F.sum("n").alias("_all"), F.count("*").alias("_parts")).filter("_parts > 1")
    loners = F.col("_all") - F.col("_top.n") + F.when(F.col("_top.n") == 1, 1).otherwise(0)
    buckets = settle(buckets.select(F.col("entry").alias("_entry"), F.col("_top.comp").alias("_main"), (F.col("_top.n") > 1).alias("_has"), F.ceil(loners / BLOCK).cast("int").alias("_g")))
    outside = join_salted(rows, buckets, "entry", "_entry", F.xxhash64("node")).filter(~F.col("_has") | (F.col("comp") != F.col("_main")))
    outside = packed(outside.select("entry", "node", "comp", "_has", "_main", "_g"))

    whole = words.select(F.col("node").alias("_n"), "words")
    left = outside.filter("_has").select(F.col("_main").alias("key"), "node").distinct()
    met = settle(left.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / WORD_BLOCK).cast("int").alias("_x")))
    right = join_salted(inside.select(F.col("_n").alias("node"), F.col("component").alias("key")), met, "key", "_key", F.xxhash64("node")).select("key", "node", "_x")
    sizes = settle(right.groupBy(F.col("key").alias("_key"), "_x").agg(F.ceil(F.count("*") / WORD_BLOCK).cast("int").alias("_y")))
    blocks = lambda side: join_salted(side.select("key", "node"), sizes, "key", "_key", F.xxhash64("node")).join(whole, F.col("node") == F.col("_n"))
    linked = _deal(blocks(left), blocks(right), "key", "_x", "_y", ["node", "words"]).mapInArrow(_cells(("key", "i", "j"), _first_links(similarity)), "a long, b long")

    buckets_of = outside.groupBy(F.col("node").alias("_of")).agg(F.collect_list("entry").alias("entries"))  # no more than a text has entries
    among = outside.join(whole, F.col("node") == F.col("_n")).join(buckets_of, F.col("node") == F.col("_of")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_g")).cast("int"))
    # every two blocks of a bucket meet once, in the cell of the smaller and the larger number
    among = among.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).select("entry", F.least("block", "_k").alias("i"), F.greatest("block", "_k").alias("j"), "block", "node", "comp", "words", "entries")
    found = among.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j").mapInArrow(_cells(("entry", "i", "j"), _new_links(similarity)), "a long, b long")
    return settle(linked).unionByName(settle(found))


def verified_pairs(words: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose words (node, words) align with at least the given similarity."""
    side = lambda x: words.select(F.col("node").alias(x), F.col("words").alias(f"{x}_words"))
    share = lambda x, y: F.least(F.length(x), F.length(y)) >= similarity * F.greatest(F.length(x), F.length(y))
    sizes = words.select("node", F.length("words").alias("n"))
    near = pairs.join(sizes.toDF("a", "_n"), "a").join(sizes.toDF("b", "_m"), "b").filter(F.least("_n", "_m") >= similarity * F.greatest("_n", "_m")).select("a", "b")
    both = near.join(side("a"), "a").join(side("b"), "b").filter(share("a_words", "b_words"))
    return both.select("a", "b", "a_words", "b_words").mapInArrow(_verify(similarity), "a long, b long")


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node, class_node, class_id and class_size of each row of ``docs``.

    ``node`` stands for the words of the text, ``class_node`` for the group; ``class_id`` is
    the least doc_id of the group. A null text is equal to nothing: its node is null and it is
    alone. Texts without words are equal if they are the same. Null doc_ids never name a group
    that has others; a group of null doc_ids only has a null class_id. Columns beside doc_id
    and text are ignored.
    """
    given = sketched(docs)
    nodes = settle(given.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("_carrier"), F.first("entries").alias("entries")))
    # a settled table keeps its order, so its row numbers do too: 8 bytes stand for a text from here on
    numbered = nodes.withColumn("_number", F.monotonically_increasing_id())
    buckets = bucket_rows(numbered.select(F.col("_number").alias("node"), "entries"))
    pairs = packed(candidate_pairs(buckets))
    # of each text in a bucket of several, one document gives the words to align
    names = numbered.select("_number", F.col("node").alias("_node"), "_carrier")
    wanted = settle(buckets.select(F.col("node").alias("_number")).distinct().join(names, "_number"))
    ids = wanted.select(F.col("_carrier").alias("_id")).distinct()
    chosen = docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = chosen.mapInArrow(_tokens, f"doc_id {kind}, node binary, words binary").join(small(wanted), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_carrier")))
    words = packed(words.select(F.col("_number").alias("node"), "words").dropDuplicates(["node"]), TEXTS)
    classes = settle(connected_components(settle(verified_pairs(words, pairs, similarity))))
    rest = remaining_links(buckets, words, classes, similarity)
    # a component stands for the links in it
    classes = connected_components(classes.toDF("a", "b").unionByName(rest))
    named = classes.join(names.select("_number", F.col("_node").alias("_of")), F.col("node") == F.col("_number")).drop("_number")
    heads = settle(named.select("component").distinct().join(names.select("_number", F.col("_node").alias("_class_name")), F.col("component") == F.col("_number")).select("_number", "_class_name"))
    spread = F.xxhash64("doc_id")
    classes = settle(join_salted(named, heads, "component", "_number", F.xxhash64("node")).select("_of", F.col("_class_name").alias("component")))
    out = join_salted(given.select("doc_id", "node"), classes, "node", "_of", spread, how="left").select("doc_id", "node", F.coalesce("component", "node").alias("class_node"))
    sizes = out.filter("class_node is not null").groupBy(F.col("class_node").alias("_class")).agg(F.min("doc_id").alias("_id"), F.count("*").alias("_size"))
    # groups of one need no join: only the others are looked up
    joined = join_salted(out, settle(sizes.filter("_size > 1")), "class_node", "_class", spread, how="left")
    return joined.select("doc_id", "node", "class_node", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("_id")).alias("class_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group: the one with the least doc_id.

    Of rows with that doc_id in the group, one stays. Rows with null texts all stay. Rows of a
    group whose doc_ids are all null: one stays.
    """
    groups = near_duplicate_groups(docs, similarity).filter("node is not null and class_size > 1")
    keepers = settle(groups.filter("doc_id <=> class_id").groupBy(F.col("class_node").alias("_c")).agg(F.min(F.struct("doc_id", "node")).alias("_keep")))
    dropped = join_salted(groups, keepers, "class_node", "_c", F.xxhash64("doc_id")).filter(~(F.col("doc_id").eqNullSafe(F.col("_keep.doc_id")) & (F.col("node") == F.col("_keep.node"))))
    gone = settle(dropped.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct())
    repeated = settle(groups.groupBy("doc_id", "node").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")))
    inner, restore = shield(docs, ("doc_id", "text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    named = inner.select(*inner.columns, F.col("text").alias("_text")).mapInArrow(_name_rows, f"{kind}, _name binary")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_name") == F.col("_node"))
    kept = named.join(small(gone), match, "left_anti")
    if not repeated.isEmpty():
        again = kept.join(small(repeated), match, "left_semi").dropDuplicates(["doc_id", "_name"])
        kept = kept.join(small(repeated), match, "left_anti").unionByName(again)
    return restore(kept)


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the name of their text (the last column) in its place."""
    for batch in batches:
        names = []
        for _, run in wb.batched(batch.column(batch.num_columns - 1)):
            _, _, _, h, bounds = wb.run_words(run, wb.ALNUM)
            names += _names(run, h, bounds)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.binary())], [*batch.schema.names[:-1], "_name"])
