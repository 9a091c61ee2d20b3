"""Language identification as a mixture over languages, fitted to each document by expectation-maximisation.

A language is a distribution over letter trigrams (of bytes, within words), counted over all training documents. A
document is a mixture: each of its words comes from one language, with the document's proportions. For one, two and
more languages, EM fits the proportions; the set with the best likelihood, less a penalty for each language's
proportion, is the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm.common import by_bytes, held_out, small
from somatrix.tables import table

#: Trigram buckets, added to each bucket's count, EM steps for each set, the most languages in a set, and the penalty for
#: a further language in units of half the logarithm of the number of words.
BUCKETS, SMOOTHING, STEPS, MOST, PENALTY = 1 << 16, 0.05, 6, 3, 3.0
UNKNOWN = "und"
#: Bytes of text at a time, and tables of counts that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 32
NOT_LETTER = re.compile(rb"[^a-z\x80-\xff]")

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def trigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased text: each letter byte's place, its trigram's bucket, and whether it begins a word. What isn't a
    letter counts as a word's edge."""
    a = np.frombuffer(raw, np.uint8)
    letter = _LETTER[a]
    codes = np.zeros(len(a) + 2, np.uint32)
    codes[1:-1] = np.where(letter, a, 0)
    at = np.flatnonzero(letter)
    mixed = codes[at] * np.uint32(0x9E3779B1) + codes[at + 1] * np.uint32(0x85EBCA77) + codes[at + 2] * np.uint32(0xC2B2AE3D)
    return at, ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(16), codes[at] == 0


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def lowered(column: pa.Array) -> list[bytes]:
    return [(x or "").lower().encode("utf-8", "replace") for x in column.to_pylist()]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in small(batches):
            texts, langs = lowered(batch.column("text")), batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [x for x, y in zip(texts, langs, strict=True) if y == lang]
                if lang not in held and len(held) >= HELD:
                    yield from rows()
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a, b in by_bytes(own, PIECE):
                    counts += np.bincount(trigrams(b" ".join(own[a:b]))[1], minlength=BUCKETS)
        yield from rows()

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Languages and the logarithms of their trigram probabilities, one row a language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        self.log = np.log(share).astype(np.float32)

    def word_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (language, word), and each text's number of words."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                found = NOT_LETTER.search(text, at + PIECE) if at + PIECE < len(text) else None
                end = found.start() + 1 if found else len(text)
                parts.append(text[at:end])
                owner.append(i)
                at = end
        scores, counts = [np.empty((len(self.languages), 0), np.float32)], np.zeros(len(texts), np.int64)
        for a, b in by_bytes(parts, PIECE):
            at, bucket, begins = trigrams(b" ".join(parts[a:b]))
            first = np.flatnonzero(begins)
            if not len(first):
                continue
            scores.append(np.stack([np.add.reduceat(row[bucket], first) for row in self.log]))
            ends = np.cumsum([len(x) + 1 for x in parts[a:b]])
            which = np.searchsorted(ends, at[first], side="right")
            counts += np.bincount(np.array(owner[a:b])[which], minlength=len(texts))
        return np.concatenate(scores, axis=1), counts

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Of lower-cased texts with a word or more: the main language of the chosen set, and its proportion. For a set
        of one, the score is that language's probability against each other one."""
        log, counts = self.word_scores(texts)
        n_lang, n_docs = len(self.languages), len(texts)
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        filled = np.flatnonzero(counts)
        top = log.max(axis=0)
        like = np.exp(log - top)

        def by_doc(x: np.ndarray) -> np.ndarray:
            out = np.zeros(n_docs)
            out[filled] = np.add.reduceat(x, starts[filled], dtype=np.float64)
            return out

        alone = np.stack([by_doc(row) for row in log])
        base = by_doc(top)

        def fit(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """EM from these proportions (language, document); the proportions and the log-likelihood."""
            for step in range(STEPS + 1):
                mixed, parts = np.zeros(log.shape[1], np.float32), []
                for k in range(n_lang):
                    parts.append(np.repeat(shares[k].astype(np.float32), counts) * like[k])
                    mixed += parts[k]
                mixed = np.maximum(mixed, np.float32(1e-30))
                if step == STEPS:
                    return shares, base + by_doc(np.log(mixed))
                shares = np.stack([by_doc(parts[k] / mixed) for k in range(n_lang)]) / np.maximum(counts, 1)

        main = alone.argmax(axis=0)
        best = alone.max(axis=0)
        single = 1 / np.exp(np.maximum(alone - best, -700)).sum(axis=0)
        value, lang, score = best.copy(), main, single
        if n_lang > 1:
            full, _ = fit(np.full((n_lang, n_docs), 1 / n_lang))
            order = np.argsort(-full, axis=0, kind="stable")
            for size in range(2, min(MOST, n_lang) + 1):
                inside = np.zeros(full.shape, bool)
                np.put_along_axis(inside, order[:size], True, axis=0)
                start = np.where(inside, np.maximum(full, 1e-3), 0)
                shares, reached = fit(start / start.sum(axis=0))
                reached -= PENALTY * (size - 1) * 0.5 * np.log(np.maximum(counts, 2))
                better = reached > value
                value = np.where(better, reached, value)
                lang = np.where(better, shares.argmax(axis=0), lang)
                score = np.where(better, shares.max(axis=0), score)
        return [self.languages[k] for k in lang], np.clip(score, 0, 1)


def fit_mixture(training: DataFrame) -> Mixture | None:
    """The model of ``training`` (text, lang). What comes to the driver is one count a language and bucket, whatever the
    number of documents; the model, here and in each task, has a row of ``BUCKETS`` numbers a language."""
    counts = trigram_counts(training).orderBy("lang").toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    whole = np.zeros((len(languages), BUCKETS))
    whole[np.searchsorted(languages, counts["lang"]), counts["bucket"]] = counts["n"]
    return Mixture(languages, whole)


def predict_languages(docs: DataFrame, model: Mixture | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id, text, ``lang_pred`` and ``score`` (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a model; ties go to the
    language that sorts first. A very long text is read whole, in pieces of bounded size. Repeated rows each get their row; ids may be null; an empty table gives no rows; further
    columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        piece = max(PIECE // 8, PIECE * 4 // max(4, len(model.languages))) if model else PIECE
        for batch in small(batches):
            texts, letters = lowered(batch.column("text")), [has_letter(x.as_py()) for x in batch.column("text")]
            for a, b in by_bytes(texts, piece):
                lang, score = model.predict(texts[a:b]) if model else ([UNKNOWN] * (b - a), np.zeros(b - a))
                known = letters[a:b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], batch.column("text")[a:b], pa.array([x if k else UNKNOWN for x, k in zip(lang, known, strict=True)], pa.string()), pa.array([float(x) if k else 0.0 for x, k in zip(score, known, strict=True)], pa.float64())],
                    ["id", "text", "lang_pred", "score"],
                )

    return slim.mapInArrow(run, f"id {kind}, text string, lang_pred string, score double").withColumnRenamed("id", id_col)


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of the rows that languages may be learned from."""
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def keep_identified(docs: DataFrame, model: Mixture | None, least: float = 0.4) -> DataFrame:
    """``docs`` (text, ...) without the rows that are ``und`` or whose main language has less than ``least`` of their
    words; all columns stay as they are, whatever their names. A null or empty text goes, and everything without a model;
    a very long text is judged whole, by pieces of bounded size; repeated rows and rows of one id are each judged by
    themselves; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            texts, letters = lowered(batch.column("text")), [has_letter(x.as_py()) for x in batch.column("text")]
            keep = np.zeros(batch.num_rows, bool)
            for a, b in by_bytes(texts, PIECE) if model else ():
                keep[a:b] = model.predict(texts[a:b])[1] >= least
            yield batch.filter(pa.array(keep & np.array(letters, bool)))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_mixture(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
