"""A hidden Markov language model over words, beside a smoothed unigram base.

All training tokens are counted, with no limit on the vocabulary. The states of the model emit
the frequent words directly (LEAST_DIRECT times and more, SYMBOLS of them at most) and all other
words through classes by length; inside its class a word has its smoothed share, so the model is
normalised over all words. Baum-Welch runs over all training texts, whole: each segment gives
the product of its scaled step matrices, the products carry the state forward and backward
through the text, and forward and backward passes inside the segments start from there. Expected
counts are summed by Spark, so that the driver sees one table of states by symbols a round.
Scoring carries the same products through the whole text and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloam.llm import wordbytes as wb
from graphloam.llm.common import count_rank, id_text, rank_edge, small_batches
from graphloam.session import settle, stored

STATES, ROUNDS, SEGMENT = 4, 4, 64
#: Words that states emit directly: those seen so often, and so many at most (4 numbers each in every task).
LEAST_DIRECT, SYMBOLS = 20, 65_536
#: Steps between two scalings of a product of step matrices.
_SCALED = 8
#: Words whose counts every task holds (16 bytes each); the others meet their counts in a join.
HEAD = 500_000
SMOOTH = 0.1
#: Upper ends of the lengths in bytes of the classes of other words.
CLASS_ENDS = np.array([3, 5, 7, 9, 12, 16, 24])
CLASSES = len(CLASS_ENDS) + 1
#: The hash of the end of a text; its last bits say class 0.
END = np.uint64(0x5851F42D4C957F28)
#: Tokens of a batch of segments.
_TOKENS = 1 << 19


def _tokens(run: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of texts and their bounds. The last three bits hold the class."""
    _, s, e, h, bounds = wb.run_words(run, wb.UNBLANK)
    return (h & ~np.uint64(7)) | np.searchsorted(CLASS_ENDS, e - s).astype(np.uint64), bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, n of the words of training texts, added up over as many texts as fit."""
    held, size, ends = [], 0, 0

    def flush():
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([n for _, n in held])
        if not len(keys):
            return keys, counts
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def out(keys, counts):
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(counts[i : i + 100_000])], ["hash", "n"])

    for batch in batches:
        ends += len(batch)
        for _, run in wb.batched(batch.column(0)):
            found, n = np.unique(_tokens(run)[0], return_counts=True)
            held.append((found, n))
            size += len(found)
            if size > 2_000_000:
                held = [flush()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*flush())
    if ends:
        yield from out(np.array([END]), np.array([ends]))


@dataclass
class Vocabulary:
    """Totals of the training tokens, and the head: sorted hashes, counts and model symbols (-1: none)."""

    tokens: int
    words: int
    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_symbols: int

    def class_logs(self) -> np.ndarray:
        """log10 of the denominators inside each class."""
        return np.log10(self.class_tokens + SMOOTH * (self.class_words + 1))


def vocabulary(counts: DataFrame, head: int = HEAD, symbols: int = SYMBOLS, least: int = LEAST_DIRECT) -> Vocabulary:
    """The head and the totals of a table of hash, n. At most ``head`` rows, and the end, reach the driver.

    The head is all words of at least that count at which there are no more than ``head``:
    found from the number of words of each rank, so no task sorts or holds the vocabulary.
    """
    edge = rank_edge(counts, head)
    top = counts.filter((count_rank(F.col("n")) >= edge) | (F.col("hash") == int(END.view(np.int64)))).select("hash", "n").toArrow()
    hashes, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((hashes, -n))
    words = order[(hashes[order] != END) & (n[order] >= least)][:symbols]
    number = np.full(len(hashes), -1, np.int64)
    number[words] = np.arange(1, len(words) + 1)  # symbol 0 is the end
    number[hashes == END] = 0
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    kind = F.col("hash").bitwiseAND(F.lit(7))
    by_class = np.zeros((2, CLASSES))
    for r in counts.filter(F.col("hash") != int(END.view(np.int64))).groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        by_class[:, r["k"]] = r["n"], r["v"]
    kinds = (hashes[words] & np.uint64(7)).astype(np.int64)
    by_class[0] -= np.bincount(kinds, weights=n[words], minlength=CLASSES)
    by_class[1] -= np.bincount(kinds, minlength=CLASSES)
    order = np.argsort(hashes)
    return Vocabulary(total["n"], total["v"], hashes[order], n[order], number[order], by_class[0], by_class[1], len(words) + 1)


_ENCODED = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, head_log double, other_log double, symbols binary, tail binary"


def _encode(held, keep: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        look, logs = wb.Lookup(v.hashes), np.log10(v.counts + SMOOTH)
        end = int(look.find(np.array([END]))[0])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, run in wb.batched(batch.column(2)):
                tokens, bounds = _tokens(run)
                found = look.find(tokens)
                kind = (tokens & np.uint64(7)).astype(np.int64)
                in_head = found >= 0
                symbol = np.where(in_head, v.symbols[found] if len(v.symbols) else -1, -1)
                own = symbol >= 0  # words that states emit directly
                symbol = np.where(own, symbol, v.n_symbols + kind).astype(np.uint32)
                log = np.where(in_head, logs[found] if len(logs) else 0.0, 0.0)
                add = lambda x: np.concatenate([[0.0], np.cumsum(x)])[bounds]  # noqa: E731, B023
                head_log, known = np.diff(add(log)), np.diff(add(in_head.astype(float)))
                other = np.diff(add(np.where(own, 0.0, log - v.class_logs()[kind])))
                texts, tails = [], []
                for i in range(len(run)):
                    a, b = bounds[i], bounds[i + 1]
                    texts.append(np.append(symbol[a:b], np.uint32(0)).tobytes())
                    tails.append(tokens[a:b][~in_head[a:b]].tobytes())
                n = np.diff(bounds) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(run))), batch.column(0).slice(at, len(run)), batch.column(1).slice(at, len(run)), pa.array(n, pa.int64()),
                        pa.array(known.astype(np.int64) + (1 if end >= 0 else 0)), pa.array(head_log + (logs[end] if end >= 0 else np.log10(SMOOTH))), pa.array(other), pa.array(texts, pa.binary()), pa.array(tails, pa.binary()),
                    ],
                    [f.split()[0] for f in keep.split(", ")],
                )
                row += len(run)

    return encode


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, hash, times of the words outside the head."""
    for batch in batches:
        rows, hashes, times = [], [], []
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h, n = np.unique(np.frombuffer(data.as_buffer(), np.int64), return_counts=True)
            rows.append(np.full(len(h), row))
            hashes.append(h)
            times.append(n)
        if rows:
            columns = [np.concatenate(x) for x in (rows, hashes, times)]
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], ["row", "hash", "times"])


@dataclass
class Hmm:
    """start (S), step (S, S) and emit (symbols, S), all probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_guess(counts: np.ndarray, states: int = STATES, seed: int = 11) -> Hmm:
    """Sticky states whose emissions are the counts, tilted at random."""
    rng = np.random.default_rng(seed)
    emit = (counts[:, None] + SMOOTH) * rng.uniform(0.2, 1.8, (len(counts), states))
    step = np.full((states, states), 0.3 / max(states - 1, 1))
    np.fill_diagonal(step, 0.7 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), step, emit / emit.sum(0))


def _segments(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in rows of SEGMENT symbols, with the length and the text number of each row; long rows first."""
    n = np.array([len(x) for x in symbols])
    rows = -(-n // SEGMENT)
    text = np.repeat(np.arange(len(n)), rows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    length = np.minimum(n[text] - place * SEGMENT, SEGMENT)
    out = np.zeros((len(text), SEGMENT), np.uint32)
    out[np.arange(SEGMENT)[None, :] < length[:, None]] = np.concatenate(symbols)
    return out, length, text


def _products(x: np.ndarray, length: np.ndarray, head: np.ndarray, model: Hmm) -> tuple[np.ndarray, np.ndarray]:
    """The scaled product of the step matrices of each segment, and the log10 of its scale.

    The first step of a text (``head``) has no transition: its start is applied when products are chained.
    """
    n, states = len(x), len(model.start)
    order = np.argsort(-length, kind="stable")
    ranked, sizes, first = x[order], length[order], head[order]
    matrix, logs = np.tile(np.eye(states), (n, 1, 1)), np.zeros(n)
    for t in range(SEGMENT):
        k = int(np.searchsorted(-sizes, -t, "left"))
        if not k:
            break
        moved = (matrix[:k].reshape(-1, states) @ model.step).reshape(k, states, states)
        if t == 0:
            moved[first[:k]] = np.eye(states)
        moved *= model.emit[ranked[:k, t]][:, None, :]
        matrix[:k] = moved
        if t % _SCALED == _SCALED - 1 or t == SEGMENT - 1:
            # rows that ended since the last scaling are scaled with the others: the factor goes to their logs
            peak = matrix.reshape(n, -1).max(1)
            matrix /= peak[:, None, None]
            logs += np.log10(peak)
    peak = matrix.reshape(n, -1).max(1, initial=0)
    matrix, logs = matrix / peak[:, None, None], logs + np.log10(peak)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return matrix[back], logs[back]


def _ends(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last segment of each text."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return first, np.append(first[1:], len(text))


def expectations(symbols: list[np.ndarray], model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts (S), steps (S, S), emissions (symbols, S) of whole texts, and their log10 likelihood."""
    x, length, text = _segments(symbols)
    n, states = len(x), len(model.start)
    first, last = _ends(text)
    head = np.zeros(n, bool)
    head[first] = True
    before, after = np.tile(model.start, (n, 1)), np.ones((n, states))  # at the edges of each segment
    if n > len(first):
        matrix, _ = _products(x, length, head, model)
        most = int((last - first).max())
        for j in range(most - 1):
            on = first[first + j + 1 < last] + j
            moved = np.einsum("ns,nst->nt", before[on], matrix[on])
            before[on + 1] = moved / moved.sum(1, keepdims=True)
        for j in range(most - 1):
            on = last[last - j - 2 >= first] - j - 1
            moved = np.einsum("nst,nt->ns", matrix[on], after[on])
            after[on - 1] = moved / moved.sum(1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    x, length, head, before, beta = x[order], length[order], head[order], before[order], after[order]
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(SEGMENT)]  # rows longer than t
    alpha, scale = np.zeros((SEGMENT, n, states)), np.ones((SEGMENT, n))
    likelihood = 0.0
    for t in range(SEGMENT):
        k = live[t]
        if not k:
            break
        moved = (before if t == 0 else alpha[t - 1, :k]) @ model.step
        if t == 0:
            moved[head] = model.start
        a = moved * model.emit[x[:k, t]]
        scale[t, :k] = a.sum(1)
        alpha[t, :k] = a / scale[t, :k, None]
        likelihood += float(np.log10(scale[t, :k]).sum())
    # alpha and beta of a token multiply to its share of each state
    beta /= (alpha[length - 1, np.arange(n)] * beta).sum(1, keepdims=True)
    starts, steps = np.zeros(states), np.zeros((states, states))
    weights, places = [], []
    for t in range(SEGMENT - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        weights.append(alpha[t, :k] * beta[:k])
        places.append(x[:k, t])
        onward = model.emit[x[:k, t]] * beta[:k] / scale[t, :k, None]
        if t:
            steps += alpha[t - 1, :k].T @ onward
            beta[:k] = onward @ model.step.T
        else:
            steps += before[~head].T @ onward[~head]
            starts = weights[-1][head].sum(0)
    gamma, at = np.concatenate(weights), np.concatenate(places)
    emits = np.stack([np.bincount(at, weights=gamma[:, s], minlength=len(model.emit)) for s in range(states)], 1)
    return starts, steps * model.step, emits, likelihood


def likelihoods(symbols: list[np.ndarray], model: Hmm) -> np.ndarray:
    """log10 of the exact probability of each text."""
    x, length, text = _segments(symbols)
    first, last = _ends(text)
    head = np.zeros(len(x), bool)
    head[first] = True
    matrix, logs = _products(x, length, head, model)
    state, total = np.tile(model.start, (len(first), 1)), np.zeros(len(first))
    for j in range(int((last - first).max(initial=0))):
        on = np.flatnonzero(first + j < last)
        at = first[on] + j
        moved = np.einsum("ns,nst->nt", state[on], matrix[at])
        norm = moved.sum(1)
        state[on] = moved / norm[:, None]
        total[on] += logs[at] + np.log10(norm)
    return total


def _runs(symbols: list[np.ndarray]):
    """Lists of texts of about _TOKENS symbols in segments, so that short texts take no more memory than long ones."""
    run, size, at = [], 0, 0
    for i, x in enumerate(symbols):
        room = -(-len(x) // SEGMENT) * SEGMENT
        if run and size + room > _TOKENS:
            yield at, run
            run, size, at = [], 0, i
        run.append(x)
        size += room
    if run:
        yield at, run


def baum_welch(encoded: DataFrame, guess: Hmm, rounds: int = ROUNDS) -> Hmm:
    """The model after ``rounds`` rounds over all rows of ``encoded`` that are not held out."""
    model, states = guess, len(guess.start)
    names = [f"s{i}" for i in range(states)]
    training = encoded.filter("not held_out").select("symbols")
    for _ in range(rounds):
        held = encoded.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, total = held.value, None
            for batch in batches:
                for _, run in _runs([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(0)]):
                    start, step, emit, _ = expectations(run, model)
                    table = np.concatenate([start[None], step, emit])
                    total = table if total is None else total + table
            if total is not None:
                # rows: -1 - S for the start, -S .. -1 for steps, then the symbols
                key = np.arange(len(total)) - 1 - states
                seen = total.any(1)
                yield pa.RecordBatch.from_arrays([pa.array(key[seen]), *[pa.array(total[seen, s]) for s in range(states)]], ["key", *names])

        rows = training.mapInArrow(expect, "key long, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # symbols + states + 1 rows at most
        if not len(rows):
            return model
        table = np.full((1 + states + len(model.emit), states), 1e-3)
        table[rows.column("key").to_numpy() + 1 + states] += np.stack([rows.column(n).to_numpy() for n in names], 1)
        start, step, emit = table[0], table[1 : 1 + states], table[1 + states :]
        model = Hmm(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
        held.unpersist()
    return model


def held_out(folds: int = 10) -> Column:
    return F.crc32(id_text(F.col("doc_id")).cast("binary")) % folds == 0


def score_documents(docs: DataFrame, folds: int = 10, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, symbols: int = SYMBOLS, least: int = LEAST_DIRECT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    A null text is empty: one token, its end. Learning uses the rows that are not held out;
    with none of them every count is 0. Other columns than doc_id and text are ignored. Words
    are told apart by 61-bit hashes and their class of length.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("string"), held_out(folds).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(given.filter("not held_out").select("text").mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    v = vocabulary(counts, head, symbols, least)
    held = docs.sparkSession.sparkContext.broadcast(v)
    encoded = stored(given.mapInArrow(_encode(held, _ENCODED), _ENCODED), "encoded")

    by_symbol = np.zeros(v.n_symbols + CLASSES)
    np.add.at(by_symbol, v.symbols[v.symbols >= 0], v.counts[v.symbols >= 0])
    by_symbol[v.n_symbols :] = v.class_tokens
    model = baum_welch(encoded, first_guess(by_symbol, states), rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    tail = encoded.select("row", "tail").mapInArrow(_tail, "row long, hash long, times long")
    rare = tail.join(counts, "hash", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("tail_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [likelihoods(run, sent.value) for _, run in _runs([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(6)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.concatenate(out) if out else np.zeros(0)), *batch.columns[7:]], ["row", "doc_id", "held_out", "n_tokens", "n_known", "head_log", "forward", "other_log"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "head_log", "symbols", "other_log").mapInArrow(forward, "row long, doc_id string, held_out boolean, n_tokens long, n_known long, head_log double, forward double, other_log double")
    joined = scored.join(rare, "row", "left")
    tail_log, base = F.coalesce("tail_log", F.lit(0.0)), float(np.log10(v.tokens + SMOOTH * (v.words + 1)))
    return joined.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(v.tokens)).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("forward") + F.col("other_log") + tail_log).alias("score"),
    )
