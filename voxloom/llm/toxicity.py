"""Toxicity: a convolutional text classifier over hashed word embeddings, written in numpy.

Model.  A word is a run of letters, digits and bytes from 0x80 up, case-folded for A-Z and the
accented capitals of Latin-1.  Its vector is the sum of the embeddings of four hashed features: the
word, and its first 4, 5 and 6 bytes, so that inflected and compound forms share weight.  Filters of
several widths slide over the vectors of a text, each is max-pooled over the whole text, and a
logistic layer on the rectified maxima gives a logit.

Calibration.  On training rows that were kept apart, a threshold on the logit is chosen for each
language, where a text's language is read from the text (votes of common function words), never from
a column.  The score is sigmoid(logit - threshold of the text's language), so 0.5 is the calibrated
cut everywhere.

Scale.  The model is fitted on the driver on a bounded sample of labelled rows (``MOST_TOXIC`` and
``MOST_CLEAN``, taken in the order of a hash of the id).  It is a few MB whatever the input, so it is
sent to each executor; scoring is one narrow pass over whole texts in bounded chunks.  Because a
convolution is linear, embeddings are multiplied by the filters once, and a word then costs four
table look-ups.

Edge cases.  Null and empty texts have no words: every pooled value is 0 and the score is that of the
bias.  Rows are scored one by one, so repeated rows, null ids and extra columns do no harm.  Labels
that are null, that belong to no document or that are held out are not learnt from; with no toxic or
no clean training row the model is constant (score 0 without toxic rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import textkernels as tk
from voxloom.llm.common import small_batches

#: Bounds of the sample that the classifier is fitted on, in rows.
MOST_TOXIC, MOST_CLEAN = 2000, 4000
#: Longer texts stay out of the sample that goes to the driver (they are scored whole like all others).
LONGEST_SAMPLE = 200_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 16, 8, (1, 2, 3)
PREFIXES = (None, 4, 5, 6)
#: A feature is learnt if so many sampled documents have it.
LEAST_DOCUMENTS = 5
STEPS, BATCH, RATE = 150, 48, 0.05

#: Common function words by language, for the language votes.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be by this are from at not have which",
    "de": "der die und das nicht ist ein eine zu mit sich auf für von dem den im auch als werden",
    "fr": "le la les et des un une que est pour dans qui sur pas du au avec par elle il ce",
    "es": "el los las de que y en un una por con para no se del lo su al como es",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[128:] = False
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _fold(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals that UTF-8 writes as C3 80 to C3 9E, in lower case."""
    data = tk.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 0x20, data).astype(np.uint8)


def _features(words: tk.Words) -> np.ndarray:
    """(words, 4) hashed feature buckets."""
    shift = tk.U64(64 - 18)
    out = np.empty((len(words), len(PREFIXES)), np.int32)
    for k, prefix in enumerate(PREFIXES):
        salt = tk.U64(k * 0x51ED270B) if prefix else tk.U64(0)
        out[:, k] = (tk.mix(words.hashes(prefix) ^ salt) >> shift).astype(np.int32)
    return out


def _words(offsets: np.ndarray, data: np.ndarray) -> tk.Words:
    return tk.Words(offsets, _fold(data), _SEPARATORS, None)


def _language_table() -> np.ndarray:
    """The language whose function word falls into a bucket (words of two languages vote for none)."""
    votes: dict[int, set[int]] = {}
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        for word in listed.split():
            raw = np.frombuffer(word.encode(), np.uint8)
            bucket = int(_features(_words(np.array([0, len(raw)]), raw))[0, 0])
            votes.setdefault(bucket, set()).add(k)
    out = np.full(BUCKETS, len(FUNCTION_WORDS), np.int8)
    for bucket, langs in votes.items():
        if len(langs) == 1:
            out[bucket] = langs.pop()
    return out


@dataclass
class Model:
    """row: bucket -> row of table (row 0 is the unknown feature); table: rows x (sum of widths x filters)."""

    row: np.ndarray
    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray

    def logits(self, offsets: np.ndarray, data: np.ndarray, languages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text."""
        words = _words(offsets, data)
        n = len(offsets) - 1
        pooled = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        step = 32_768
        reach = max(WIDTHS) - 1
        features = _features(words)
        text = np.repeat(np.arange(n), np.diff(words.ptr))
        votes = np.bincount(text * len(LANGUAGES) + languages[features[:, 0]], minlength=n * len(LANGUAGES)).reshape(n, -1)
        for start in range(0, len(words), step):
            end = min(len(words), start + step)
            ids = self.row[features[start : min(len(words), end + reach)]]
            projected = self.table[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                projected += self.table[ids[:, k]]
            here = text[start : start + len(ids)]
            at = 0
            for f, width in enumerate(WIDTHS):
                last = len(ids) - width + 1
                if last <= 0:
                    at += width * FILTERS
                    continue
                last = min(last, end - start)
                value = projected[:last, at : at + FILTERS].copy()
                for j in range(1, width):
                    value += projected[j : j + last, at + j * FILTERS : at + (j + 1) * FILTERS]
                whole = here[:last] == here[width - 1 : width - 1 + last]
                value, owner = value[whole], here[:last][whole]
                if len(owner):
                    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    best = np.maximum.reduceat(value, first)
                    span = slice(f * FILTERS, (f + 1) * FILTERS)
                    pooled[owner[first], span] = np.maximum(pooled[owner[first], span], best)
                at += width * FILTERS
        hidden = np.where(np.isfinite(pooled), np.maximum(pooled + self.bias, 0), 0)
        votes[:, -1] = 0
        language = np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGES) - 1)
        return hidden @ self.out + self.out_bias, language

    def scores(self, offsets: np.ndarray, data: np.ndarray, languages: np.ndarray) -> np.ndarray:
        logit, language = self.logits(offsets, data, languages)
        return 1 / (1 + np.exp(-np.clip(logit - self.thresholds[language], -30, 30)))


def _constant(toxic: bool) -> Model:
    wide = sum(WIDTHS) * FILTERS
    return Model(np.zeros(BUCKETS, np.int32), np.zeros((1, wide), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 30.0 if toxic else -30.0, np.zeros(len(LANGUAGES)))


def train(texts: list[str], labels: np.ndarray, seed: int = 0) -> Model:
    """Fit the classifier and its thresholds; a fifth of the rows only calibrates."""
    labels = np.asarray(labels, bool)
    if labels.all() or not labels.any():
        return _constant(bool(len(labels)) and bool(labels[0]))
    rng = np.random.Generator(np.random.PCG64(seed))
    docs = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        docs.append(_features(_words(np.array([0, len(raw)]), raw)))
    apart = np.zeros(len(docs), bool)
    for value in (False, True):
        own = rng.permutation(np.flatnonzero(labels == value))
        apart[own[: len(own) // 5]] = True
    fit = np.flatnonzero(~apart)

    # Features by how surprisingly often toxic documents have them: the first embedding dimension starts there.
    seen, toxic_seen = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for i in fit:
        own = np.unique(docs[i])
        seen[own] += 1
        if labels[i]:
            toxic_seen[own] += 1
    known = np.flatnonzero(seen >= min(LEAST_DOCUMENTS, 2 + len(fit) // 200))
    row = np.zeros(BUCKETS, np.int32)
    row[known] = np.arange(1, len(known) + 1)
    expected = seen[known] * labels[fit].mean()
    surprise = (toxic_seen[known] - expected) / np.sqrt(expected + 3)
    embed = np.zeros((len(known) + 1, DIM), np.float32)
    embed[1:] = rng.normal(0, 0.05, (len(known), DIM))
    embed[1:, 0] = np.clip(surprise / 8, -0.5, 1.0)
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, 0] = 1.0
        f[:, 0, 1] = 0.7
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out[::FILTERS] = out[1::FILTERS] = 0.5
    out_bias = np.float32(-1.0)
    docs = [row[d] for d in docs]

    columns = np.arange(FILTERS)
    state = [np.full_like(x, 1e-3) for x in (embed, *filters, bias, out)]
    bias_state = 1e-3
    by_label = [fit[labels[fit] == v] for v in (False, True)]
    for _ in range(STEPS):
        chosen = np.concatenate([rng.choice(own, BATCH // 2) for own in by_label])
        grads = [np.zeros_like(x) for x in (*filters, bias, out)]
        touched: list[tuple[np.ndarray, np.ndarray]] = []
        slope_sum = 0.0
        joined = np.concatenate([kernel[j] for kernel in filters for j in range(len(kernel))], 1)
        for i in chosen:
            ids = docs[i]
            vectors = embed[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                vectors += embed[ids[:, k]]
            projected = vectors @ joined
            hidden = np.zeros(len(bias), np.float32)
            where: list[np.ndarray | None] = []
            at = 0
            for f, width in enumerate(WIDTHS):
                last = len(vectors) - width + 1
                if last <= 0:
                    where.append(None)
                    at += width * FILTERS
                    continue
                value = projected[:last, at : at + FILTERS].copy()
                for j in range(1, width):
                    value += projected[j : j + last, at + j * FILTERS : at + (j + 1) * FILTERS]
                at += width * FILTERS
                best = value.argmax(0)
                where.append(best)
                hidden[f * FILTERS : (f + 1) * FILTERS] = value[best, columns] + bias[f * FILTERS : (f + 1) * FILTERS]
            active = hidden > 0
            hidden = np.where(active, hidden, 0)
            slope = 1 / (1 + np.exp(-float(np.clip(hidden @ out + out_bias, -30, 30)))) - float(labels[i])
            slope_sum += slope
            grads[-1] += slope * hidden
            back = np.where(active, slope * out, 0).astype(np.float32)
            for f, (width, kernel) in enumerate(zip(WIDTHS, filters, strict=True)):
                if where[f] is None:
                    continue
                g = back[f * FILTERS : (f + 1) * FILTERS]
                grads[len(filters)][f * FILTERS : (f + 1) * FILTERS] += g
                for j in range(width):
                    at = where[f] + j
                    grads[f][j] += vectors[at].T * g
                    touched.append((ids[at], (kernel[j] * g).T))
        for k, (x, g) in enumerate(zip((*filters, bias, out), grads, strict=True), 1):
            g = g / BATCH + 1e-4 * x
            state[k] += g * g
            x -= RATE * g / np.sqrt(state[k])
        slope_sum /= BATCH
        bias_state += slope_sum**2
        out_bias -= RATE * slope_sum / np.sqrt(bias_state)
        if touched:
            at = np.concatenate([ids for ids, _ in touched])
            g = np.concatenate([g for _, g in touched])[:, None, :] / BATCH
            grad = np.zeros_like(embed)
            np.add.at(grad, at, np.broadcast_to(g, (len(at), at.shape[1], DIM)))
            grad[0] = 0
            own = np.unique(at)
            state[0][own] += grad[own] ** 2
            embed[own] -= 0.2 * RATE * grad[own] / np.sqrt(state[0][own])
    embed[0] = 0
    table = np.concatenate([embed @ kernel[j] for kernel in filters for j in range(len(kernel))], 1)
    model = Model(row, np.ascontiguousarray(table), bias, out, float(out_bias), np.zeros(len(LANGUAGES)))
    calibrate(model, [texts[i] for i in np.flatnonzero(apart)], labels[apart])
    return model


def calibrate(model: Model, texts: list[str], labels: np.ndarray) -> None:
    """The threshold of each language that errs least (of equals the middle); few toxic rows: that of all languages."""
    languages = _language_table()
    if not len(texts):
        return
    offs, data = tk.buffers(pa.array(texts, pa.large_string()))
    logit, language = model.logits(offs - offs[0], data[offs[0] : offs[-1]], languages)

    def best(own: np.ndarray) -> float:
        value, toxic = logit[own], labels[own]
        order = np.argsort(value)
        value, toxic = value[order], toxic[order]
        cuts = np.concatenate([[value[0] - 1], (value[1:] + value[:-1]) / 2, [value[-1] + 1]])
        wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([[(~toxic).sum()], (~toxic).sum() - np.cumsum(~toxic)])
        least = np.flatnonzero(wrong == wrong.min())
        return float(cuts[least[len(least) // 2]])

    everything = np.ones(len(labels), bool)
    overall = best(everything) if labels.any() and not labels.all() else 0.0
    for k in range(len(LANGUAGES)):
        own = language == k
        model.thresholds[k] = best(own) if labels[own].sum() >= 10 and (~labels[own]).sum() >= 10 else overall


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learnt from: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """The classifier of the labelled rows that are not held out; at most so many of each label, by the order of a hash."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST_SAMPLE)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).toArrow()
    rows = rows.sort_by("doc_id")
    return train(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), int) == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row: the probability, calibrated by language, that its whole text is toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, _language_table()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, languages = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, end, offs, data in tk.chunks(batch.column(1)):
                out[row:end] = own.scores(offs, data, languages)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
