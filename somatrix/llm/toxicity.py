"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labels; all others are unlabelled text, of which the class prior's share is
toxic too. The risk of the negative class on unlabelled text, less the prior times that risk on toxic text, estimates
its risk on clean text; where that estimate is below zero, the step goes the other way until it isn't.

All training documents are in the risk: Spark stores their features once and sums the gradient over them in each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm.common import held_out, small
from somatrix.tables import materialise, release, table

#: About how many confirmed toxic documents the candidate features come from and the classifier is fitted on, drawn by a
#: hash of the id; the most features; and the word starts that are features besides whole words.
MAX_TOXIC, FEATURES, STARTS = 4000, 4096, (3, 4, 5, 6, 7, 8)
STEPS, RATE, DECAY, CUT = 40, 0.25, 4e-3, 0.3
#: Sums of tasks that the driver gets at most in one step.
SUMS = 32
#: A feature is in this many confirmed toxic documents, and by this many standard errors, and this many times, more
#: frequent there than in unlabelled text, of which the prior's share is toxic too.
FEWEST, SURE, LIFT = 3, 4.0, 3.0
#: What stands between words.
BETWEEN = r"\P{L}+"


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in STARTS if len(word) > n)]


class Places:
    """Looks up the features of many texts at once; a word is looked up once a batch."""

    def __init__(self, names: list[str]):
        self.place = {x: i for i, x in enumerate(names)}
        self.width = len(names)

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature): each feature of each text once, by text and then feature."""
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
        parts = pc.split_pattern_regex(lowered, BETWEEN)
        owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
        coded = parts.flatten().dictionary_encode()
        found = [[self.place[f] for f in word_features(w) if f in self.place] if w else [] for w in coded.dictionary.to_pylist()]
        ends = np.cumsum([0] + [len(x) for x in found])
        codes = coded.indices.to_numpy()
        has = np.flatnonzero(np.diff(ends)[codes] > 0)
        seen = np.unique(owner[has].astype(np.int64) * max(len(found), 1) + codes[has])
        text, word = np.divmod(seen, max(len(found), 1))
        n = np.diff(ends)[word]
        flat = np.array([f for x in found for f in x], np.int64)
        at = flat[np.repeat(ends[word] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else np.empty(0, np.int64)
        both = np.unique(np.repeat(text, n) * max(self.width, 1) + at)
        return tuple(np.divmod(both, max(self.width, 1)))


def toxic_features(texts: DataFrame) -> DataFrame:
    """(feature, p): in how many rows of ``texts`` (text) each feature is, where it is in ``FEWEST`` or more."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), BETWEEN)), lambda w: w != "")

    def with_starts(w: Column) -> Column:
        return F.array_compact(F.array(w, *(F.when(F.char_length(w) > n, F.concat(F.substring(w, 1, n), F.lit("~"))) for n in STARTS)))

    each = texts.select(F.explode(F.array_distinct(F.flatten(F.transform(words, with_starts)))).alias("feature"))
    return each.groupBy("feature").agg(F.count("*").alias("p")).filter(F.col("p") >= FEWEST)


def unlabelled_counts(texts: DataFrame, names: list[str]) -> np.ndarray:
    """In how many rows of ``texts`` (text) each of ``names`` is, over all of them."""
    shared = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        counts = np.zeros(places.width, np.int64)
        for batch in small(batches):
            counts += np.bincount(places.rows(batch.column("text"))[1], minlength=places.width)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["at", "u"])

    each = texts.select("text").mapInArrow(run, "at long, u long").groupBy("at").agg(F.sum("u").alias("u")).toPandas()
    out = np.zeros(len(names), np.int64)
    out[each["at"].to_numpy(np.int64)] = each["u"].to_numpy(np.int64)
    return out


def feature_sets(rows: DataFrame, names: list[str]) -> DataFrame:
    """(toxic, at, n): how many of ``rows`` (toxic, text) have exactly the features at these places of ``names``."""
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        for batch in small(batches):
            text, at = places.rows(batch.column("text"))
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "at"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, at array<int>").groupBy("toxic", "at").agg(F.count("*").alias("n"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def part_of_risk(toxic: np.ndarray, n: np.ndarray, row: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over rows of weights ``n``, for unlabelled and for toxic ones (lines 0 and 1): the sum of the loss of calling them
    clean, its gradient, and the gradient of the loss of calling them toxic; of features and, last, the bias."""
    width, out = len(w), np.zeros((2, 2 * len(w) + 1))
    z = np.bincount(row, w[at], minlength=len(n)) + w[-1]
    for kind in (0, 1):
        mine = np.where(toxic == kind, n, 0)
        out[kind, 0] = (mine * np.logaddexp(0, z)).sum()
        for k, slope in enumerate((mine * sigmoid(z), -mine * sigmoid(-z))):
            grad = np.bincount(at, slope[row], minlength=width).astype(float)  # of nothing it is of integers
            grad[-1] = slope.sum()
            out[kind, 1 + k * width : 1 + (k + 1) * width] = grad
    return out


def risk(sets: DataFrame, w: np.ndarray, tasks: int) -> np.ndarray:
    """``part_of_risk`` summed over all of ``sets`` (toxic, at, n), which ``tasks`` tasks read. Their sums are added in
    ``SUMS`` groups first where there are more, so that what comes to the driver doesn't follow their number."""
    shared, size = sets.sparkSession.sparkContext.broadcast(w), 2 * len(w) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros((2, size))
        for batch in batches:
            lists = batch.column("at")
            sizes = np.diff(lists.offsets.to_numpy())
            toxic, n = (batch.column(c).to_numpy() for c in ("toxic", "n"))
            total += part_of_risk(toxic, n, np.repeat(np.arange(len(n)), sizes), lists.flatten().to_numpy(), w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size)
        for batch in group:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = sets.mapInArrow(run, "part binary")
    if tasks > SUMS:
        parts = parts.repartition(SUMS).mapInArrow(added, "part binary")
    parts = parts.collect()  # SUMS at most, of fixed size
    shared.unpersist()
    return sum((np.frombuffer(r["part"]).reshape(2, -1) for r in parts), np.zeros((2, size)))


def nn_pu(of_risk, width: int, n_unlabelled: int, n_toxic: int, prior: float) -> np.ndarray:
    """Weights and, last, the bias of a linear classifier with logistic loss, by Adam on the non-negative risk;
    ``of_risk`` gives the sums of ``part_of_risk`` for given weights."""
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        free, toxic = of_risk(w)
        free, toxic = free / max(n_unlabelled, 1), prior * toxic / n_toxic
        clean_risk, clean = free[0] - toxic[0], free[1 : width + 2] - toxic[1 : width + 2]
        if clean_risk < 0:
            gradient = -clean
        else:
            gradient = clean + toxic[width + 2 :]
            gradient[:-1] += DECAY * w[:-1]
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        rate = RATE * (1 - 0.9 * step / STEPS)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, float] | None:
    """For each chosen feature, and for "" (the bias), its weight. None without a toxic training document.

    Learns from rows outside the held-out fold alone. Prior: the toxic share of their labels. Confirmed toxic documents,
    which are labelled rows, may be a sample of about ``MAX_TOXIC``; unlabelled text is counted and fitted on whole. What
    comes to the driver are candidate features of that sample and sums a feature, whatever the number of documents.
    """
    own = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = own.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not n_toxic:
        return None
    training = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.filter((F.col("toxic") == 1) & (draw < MAX_TOXIC / n_toxic)).select("doc_id")
    confirmed = materialise(training.join(F.broadcast(drawn), "doc_id").select("text"), "toxicity_confirmed")  # about MAX_TOXIC ids
    n_confirmed, n_free = confirmed.count(), training.count()
    if not n_confirmed:
        return None
    counted = toxic_features(confirmed).orderBy("feature").toPandas()
    names, p = counted["feature"].tolist(), counted["p"].to_numpy() / n_confirmed
    u = unlabelled_counts(training, names) / max(n_free, 1)
    chance = np.sqrt(u * (1 - u) / n_confirmed + 1e-12)  # of p, were the feature as frequent in toxic text as in all
    z = np.where(p >= LIFT * u, (p - u) / chance, 0)
    chosen = [names[i] for i in np.argsort(-z, kind="stable") if z[i] >= SURE][:FEATURES]
    rows = training.withColumn("toxic", F.lit(0)).select("toxic", "text").unionByName(confirmed.withColumn("toxic", F.lit(1)))
    sets = materialise(feature_sets(rows, chosen), "toxicity_sets")
    prior = min(max(n_toxic / n, 1e-4), 0.9)
    tasks = sets.rdd.getNumPartitions()
    w = nn_pu(lambda at: risk(sets, at, tasks), len(chosen), n_free, n_confirmed, prior)
    release(sets)
    release(confirmed)
    return dict(zip([*chosen, ""], w.tolist(), strict=True))


def score_toxicity(docs: DataFrame, model: dict[str, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: its id and ``score``, the probability of toxicity, from its whole text alone.

    Null, empty and wordless texts get the score of no features; without a model every score is 0. Very long texts are
    read whole. Repeated rows each get their row, with equal scores; ids may be null; an empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(slim.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [x for x in model or {} if x]
        places, weights = Places(names), np.array([model[x] for x in names]) if model else None
        for batch in small(batches):
            scores = np.zeros(batch.num_rows)
            if model:
                text, at = places.rows(batch.column("text"))
                scores = sigmoid(np.bincount(text, weights[at], minlength=batch.num_rows) + model[""])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
