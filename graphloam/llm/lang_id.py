"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each language has a filter of the n-grams that are typical of it. The filters lie across each
other: slot i of one table holds a bit for each language, so one probe tells every language
that may contain an n-gram. A text counts, for each language, how many of its n-grams that
language contains; the counts are corrected for the false positives that the fill of its
filter explains, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloam.llm import wordbytes as wb
from graphloam.llm.common import id_text, shield, small_batches

SIZES = (2, 3, 4)
#: Labelled documents of each language that filters are fitted on: those with the least hashes.
SAMPLE = 2000
#: n-grams of each language, the most frequent first, and what makes one typical.
GRAMS, LEAST_COUNT, LEAST_RATE = 30_000, 3, 0.5
SLOT_BITS, HASHES = 19, 2
#: A text is in a learned language if its score is at least this part of the median score of the documents that language was learned from.
LEAST_PART = 0.5
UNKNOWN = "und"


def grams(run: list) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, text numbers) of a run of texts.

    A-Z is lower-cased, all other ASCII but a-z separates words, and one space stands at both
    ends of each word. An n-gram is 2 to 4 bytes of a word with its spaces.
    """
    gap = np.array([32], np.uint8)
    joined = wb.lower_bytes(np.concatenate([x for data in run for x in ((data if data is not None else gap[:0]), gap)]))
    joined[(joined < 97) | ((joined > 122) & (joined < 128))] = 32
    number = np.repeat(np.arange(len(run)), [1 + (0 if data is None else len(data)) for data in run])
    blank = joined == 32
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))
    joined, number = joined[keep], number[keep]
    joined = np.concatenate([gap, joined])
    number = np.concatenate([number[:1], number])
    wide, inner = joined.astype(np.uint64), joined != 32
    values, texts = [], []
    for size in SIZES:
        n = len(joined) - size + 1
        if n <= 0:
            continue
        value, good = np.full(n, size << 56, np.uint64), np.ones(n, bool)
        for i in range(size):
            value |= wide[i : i + n] << np.uint64(8 * i)
            if 0 < i < size - 1:
                good &= inner[i : i + n]
        if size == 2:
            good &= inner[:n] | inner[1 : n + 1]
        # a gram belongs to the text of its second byte: the first may be the space before the word
        values.append(value[good])
        texts.append(number[1 : n + 1][good])
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(texts)


@dataclass
class Filters:
    """languages, table (slots, words of 64 languages), the false-positive rate of each language, and the median scores of what they were learned from."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    usual: int
    medians: dict[str, float] = field(default_factory=dict)

    def counts(self, run: list) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected counts and the number of n-grams of each text."""
        found, texts = grams(run)
        total = np.bincount(texts, minlength=len(run)).astype(float)
        out = np.zeros((len(run), len(self.languages)))
        mask = None
        for slot in _slots(found):
            mask = self.table[slot] if mask is None else mask & self.table[slot]
        if mask is not None:
            for i in range(len(self.languages)):
                has = (mask[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)).astype(bool)
                out[:, i] = np.bincount(texts[has], minlength=len(run))
        return np.clip((out - total[:, None] * self.false) / np.maximum(1 - self.false, 1e-9), 0, None), total


def _slots(values: np.ndarray):
    for k in range(HASHES):
        yield (wb.mix(values * np.uint64(2) + np.uint64(k)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def build_filters(chosen: dict[str, np.ndarray], usual: str | None = None) -> Filters:
    """Filters of the given n-grams of each language."""
    languages = sorted(chosen)
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    for i, lang in enumerate(languages):
        for slot in _slots(chosen[lang]):
            table[np.unique(slot), i >> 6] |= np.uint64(1) << np.uint64(i & 63)
    fill = [float((table[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)).mean()) for i in range(len(languages))]
    return Filters(languages, table, np.array(fill) ** HASHES, languages.index(usual) if usual in languages else 0)


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE, most_grams: int = GRAMS, calibrate: bool = False) -> Filters:
    """Filters from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds.

    Fitted on at most ``sample`` documents of each language, those with the least hashes of
    doc_id and text (more if hashes tie, as those of copies do). An n-gram is typical of a language if it was seen at
    least LEAST_COUNT times and its rate is at least LEAST_RATE of its highest rate anywhere.
    With ``calibrate`` the same documents are scored to know each language's median.
    """
    small_batches(docs.sparkSession)
    place = F.substring(F.md5(F.concat_ws(":", F.lit("lang"), id_text(F.col("doc_id")), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).cast("string"))), 1, 15)
    rows = docs.filter(learn & F.col("lang").isNotNull()).withColumn("_place", place)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not sizes:
        return build_filters({})
    # hashes are uniform: of a large language, four times the sample lies below this share
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 4 * sample / n)))])
    near = rows.filter(F.conv("_place", 16, 10).cast("double") / float(16**15) <= share[F.col("lang")]).select("lang", "_place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place"))
    ends = near.withColumn("_rank", rank).filter(F.col("_rank") <= sample).groupBy("lang").agg(F.max("_place").alias("_end"))
    ends = {r["lang"]: r["_end"] for r in ends.collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            held: dict[str, list] = {}
            for at, run in wb.batched(batch.column(1)):
                found, texts = grams(run)
                for lang in set(langs[at : at + len(run)]):
                    held.setdefault(lang, []).append(found[np.isin(texts, np.flatnonzero(langs[at : at + len(run)] == lang))])
            for lang, parts in held.items():
                value, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    ends_map = F.create_map(*[x for lang, end in ends.items() for x in (F.lit(lang), F.lit(end))])
    chosen = rows.filter(F.col("text").isNotNull() & (F.col("_place") <= ends_map[F.col("lang")])).select("lang", "text")
    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("_rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    counted = counted.withColumn("_most", F.max("_rate").over(Window.partitionBy("gram")))
    typical = counted.filter((F.col("n") >= LEAST_COUNT) & (F.col("_rate") >= LEAST_RATE * F.col("_most")))
    typical = typical.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_rank") <= most_grams)
    found = typical.select("lang", "gram").toArrow()  # at most `most_grams` for each language
    langs, values = found.column("lang").to_numpy(), found.column("gram").to_numpy().view(np.uint64)
    usual = max(sorted(sizes), key=lambda x: sizes[x])
    filters = build_filters({lang: values[langs == lang] for lang in ends}, usual)
    if calibrate:
        own = predict(chosen, filters).filter("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("score", 0.5, 1000).alias("median"))
        filters.medians = {r["lang"]: r["median"] for r in own.collect()}
    return filters


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Add lang_pred and score to the rows of ``docs``; whole texts, from nothing but the text.

    The score is the corrected share of the text's n-grams that the language contains, 0 to 1.
    ``und`` with score 0 if the text is null, has no letter, or no language was learned. A text
    with letters but without a known n-gram gets the most usual language and score 0. Ties go
    to the first language by name. Columns of the same names as the added ones are replaced.
    """
    small_batches(docs.sparkSession)
    inner, restore = shield(docs, ("text",))
    held = docs.sparkSession.sparkContext.broadcast(filters)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = inner.select(*inner.columns, F.when(letter, F.col("text")).alias("_lettered"))
    names = [*inner.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = held.value
        for batch in batches:
            langs, scores = [], []
            for _, part in wb.batched(batch.column(batch.num_columns - 1)):
                counts, total = filters.counts(part) if filters.languages else (None, None)
                for i, data in enumerate(part):
                    if data is None or counts is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(counts[i])) if counts[i].max() > 0 else filters.usual
                    langs.append(filters.languages[best])
                    scores.append(float(min(1.0, counts[i, best] / max(total[i], 1.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    return restore(given.mapInArrow(run, f"{schema}, lang_pred string, score double"), "lang_pred", "score")


def held_out(folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.crc32(id_text(F.col("doc_id")).cast("binary")) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    filters = train(docs.select("doc_id", "text", "lang"), ~held_out())
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), filters)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least_part: float = LEAST_PART) -> DataFrame:
    """The rows of ``docs`` that are in a learned language; the others are rejected.

    Rejected are null texts, texts without letters, and texts that hold less of the best
    language than ``least_part`` of what its own documents hold at the median: junk and
    languages that were not learned. With no language learned all are rejected.
    """
    filters = train(docs.select("doc_id", "text", "lang"), ~held_out(), calibrate=True)
    inner, restore = shield(docs, ("text",))
    floor = F.create_map(*[F.lit(x) for lang, m in filters.medians.items() for x in (lang, m * least_part)]) if filters.medians else F.lit(None).cast("map<string,double>")
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= floor[F.col("lang_pred")])
    return restore(predict(inner, filters).filter(good))
