"""Quality by co-training: a classifier of the text's content and one of the page's metadata teach each other.

Both start from the labelled documents. In each round either one scores all documents and labels those unlabelled ones that
it is surest of, for the other one's next fit. Each view's scores are then calibrated on labelled documents that neither has seen, and
their calibrated log-odds are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somatrix.llm.common import held_out, small
from somatrix.tables import materialise, release, table

#: About how many labelled documents the views are fitted on, and how many of those that a view labels in a round, drawn
#: from all of these; what part of the labelled ones is kept for calibration; rounds, and the share of the
#: documents that a view is sure of in each, for each class in proportion to its frequency.
MAX_LABELLED, MAX_GIVEN, CALIBRATION, ROUNDS, SHARE = 5000, 1000, 5, 4, 0.05
#: Scores are told apart by bins of this width within this distance of zero; those of one bin are labelled together.
BIN, FARTHEST = 1 / 512, 64
#: Buckets of byte trigrams and of metadata values.
TEXT_BUCKETS, META_BUCKETS = 1024, 256
STEPS, RATE, DECAY, CUT = 150, 0.05, 1e-4, 0.5
N_STATS = 8


def text_view(text: str | None) -> np.ndarray:
    """Shares of trigram buckets (their square roots), and figures of the words: of one text, whatever its length."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(TEXT_BUCKETS + N_STATS, np.float32)
    if len(raw) >= 3:
        counts = np.zeros(TEXT_BUCKETS, np.int64)
        for at in range(0, len(raw) - 2, 1 << 20):
            a = raw[at : at + (1 << 20) + 2].astype(np.uint32)
            mixed = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
            counts += np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=TEXT_BUCKETS)
        out[:TEXT_BUCKETS] = np.sqrt(counts / (len(raw) - 2))
    words = (text or "").split()
    if words:
        n, size = len(words), np.bincount(raw, minlength=256) / len(raw)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        upper, lower, digit = size[65:91].sum(), size[97:123].sum(), size[48:58].sum()
        marks = size[33:48].sum() + size[58:65].sum() + size[91:97].sum() + size[123:127].sum()
        out[TEXT_BUCKETS:] = [1, again, len(set(words)) / n, upper / (upper + lower + 1e-9), marks, digit, np.log1p(n) / 10, np.log1p(len(raw) / n) / 5]
    return out


def metadata_view(source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Buckets of a document's metadata: its source, language, both together, length, and shape of lines."""
    n = F.coalesce(n_chars.cast("double"), F.lit(0.0))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    values = [
        F.concat(F.lit("source "), F.coalesce(source.cast("string"), F.lit("?"))),
        F.concat(F.lit("lang "), F.coalesce(lang.cast("string"), F.lit("?"))),
        F.concat(F.lit("both "), F.coalesce(source.cast("string"), F.lit("?")), F.lit(" "), F.coalesce(lang.cast("string"), F.lit("?"))),
        F.concat(F.lit("length "), F.floor(F.log2(F.greatest(n, F.lit(0.0)) + 1) * 2).cast("string")),
        F.concat(F.lit("lines "), F.floor(F.log2(lines.cast("double") + 1)).cast("string")),
        F.concat(F.lit("line length "), F.floor(F.log2(F.octet_length(text) / lines + 1) * 2).cast("string")),
    ]
    return F.array(*[F.pmod(F.xxhash64(x), F.lit(META_BUCKETS)).cast("int") for x in values])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias, by Adam over all rows."""
    w = np.zeros(x.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    weight = weight / max(weight.sum(), 1e-9)
    for step in range(1, STEPS + 1):
        slope = (sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y) * weight
        gradient = np.r_[x.T @ slope.astype(x.dtype) + DECAY * w[:-1], slope.sum()]
        first += 0.1 * (gradient - first)
        second += 0.001 * (gradient**2 - second)
        w -= RATE * 4 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def scale(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept that calibrate scores; none below zero."""
    if y.min(initial=1) == y.max(initial=0):
        return np.array([1.0, 0.0])
    unit = max(float(np.abs(z).mean()), 1e-6)
    w = logistic((z / unit)[:, None], y, np.ones(len(y)))
    return np.array([max(w[0], 0.0) / unit, w[1]])


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + FARTHEST) / BIN), 0, 2 * FARTHEST / BIN - 1).astype(np.int64)


def limits(counts: np.ndarray, rate: float) -> tuple[int, int]:
    """The least bin of those labelled 1 and the greatest of those labelled 0: ``SHARE`` of all that ``counts`` holds, the bin
    that passes it included. One bin is never labelled both ways, and a class without a whole document not at all."""
    total = int(counts.sum())
    high, low = int(total * SHARE * rate), int(total * SHARE * (1 - rate))
    first = len(counts) - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), high)) if high else len(counts)
    last = int(np.searchsorted(np.cumsum(counts), low)) if low else -1
    return first, min(last, first - 1)


def given(stages: list, content: np.ndarray, meta: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents with ``content`` (a row each) and ``meta`` (buckets, of the document ``owner``): which no stage before
    the last one labelled, and the bins of their scores by the last one's views. A stage is both views' weights and limits."""
    free, found = np.ones(len(content), bool), np.zeros((2, len(content)), np.int64)
    for k, (weights, bounds) in enumerate(stages):
        z = content @ weights[0][:-1].astype(np.float32) + weights[0][-1]
        found = np.stack([bins(z), bins(np.bincount(owner, weights[1][meta], len(content)) + weights[1][-1])])
        if k + 1 < len(stages):
            for view, (first, last) in zip(found, bounds, strict=True):
                free &= (view < first) & (view > last)
    return free, found


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float32)
    lists = batch.column("meta")
    return content, lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))


def tally(pool: DataFrame, stages: list) -> np.ndarray:
    """(2, bins): how many of the documents of ``pool`` (content, meta) that no stage was sure of yet each view of the last stage
    puts in each bin. Tasks count; sums, one a bin at most, come to the driver."""
    shared, width = pool.sparkSession.sparkContext.broadcast(stages), int(2 * FARTHEST / BIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, np.int64)
        for batch in batches:
            if batch.num_rows:
                free, found = given(shared.value, *_unpacked(batch))
                total += np.bincount((found[:, free] + np.array([[0], [width]])).ravel(), minlength=2 * width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    out = np.zeros(2 * width, np.int64)
    for r in pool.select("content", "meta").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out.reshape(2, width)


def drawn(pool: DataFrame, stages: list, rates: np.ndarray, labelled: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each view of the last stage: content, metadata and label of documents of ``pool`` (doc_id, content, meta, draw) that it
    labels by its limits, each label's documents drawn at its rate of ``rates`` (2 views, 2 labels); those drawn that have a
    label of their own, in ``labelled`` (doc_id), are left out."""
    shared = pool.sparkSession.sparkContext.broadcast((stages, rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stages, rates = shared.value
        for batch in batches:
            if batch.num_rows:
                free, found = given(stages, *_unpacked(batch))
                draw = batch.column("draw").to_numpy()
                for view, (first, last) in enumerate(stages[-1][1]):
                    for label, sure in enumerate((found[view] <= last, found[view] >= first)):
                        kept = pa.array(np.flatnonzero(free & sure & (draw < rates[view][label])))
                        columns = [batch.column(c).take(kept) for c in ("doc_id", "content", "meta")]
                        yield pa.RecordBatch.from_arrays([pa.array([view] * len(kept), pa.int32()), pa.array([label] * len(kept), pa.int32()), *columns], ["view", "label", "doc_id", "content", "meta"])

    kind = dict(pool.dtypes)["doc_id"]
    rows = pool.select("doc_id", "content", "meta", "draw").mapInArrow(run, f"view int, label int, doc_id {kind}, content binary, meta array<int>").toPandas()
    ids = [(x if isinstance(x, str) else int(x),) for x in rows["doc_id"].dropna().unique()]
    if ids:  # as many as were drawn
        met = labelled.join(F.broadcast(labelled.sparkSession.createDataFrame(ids, f"doc_id {kind}")), "doc_id", "left_semi")
        rows = rows[~rows["doc_id"].isin([r["doc_id"] for r in met.select("doc_id").distinct().collect()])]
    rows = rows.sort_values(["view", "label", "content"], kind="stable")
    return [(*_matrices(rows[rows["view"] == view]), rows.loc[rows["view"] == view, "label"].to_numpy(float)) for view in range(2)]


def _matrices(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    content = np.zeros((len(rows), TEXT_BUCKETS + N_STATS), np.float32)
    meta = np.zeros((len(rows), META_BUCKETS), np.float32)
    for i, (raw, at) in enumerate(zip(rows["content"], rows["meta"], strict=True)):
        content[i], meta[i, at] = np.frombuffer(raw, np.float16), 1
    return content, meta


def co_train(views: list[np.ndarray], label: np.ndarray, pool: DataFrame, labelled: DataFrame) -> dict[str, np.ndarray] | None:
    """Each view's weights, its calibration, and the log-odds of the base rate, from labelled rows and ``pool`` (doc_id,
    content, meta, draw), all documents, which are scored twice a round: to find what is surest, and to draw from it those
    without a label in ``labelled`` (doc_id)."""
    every = np.arange(len(label))
    aside, seed = every[::CALIBRATION], np.setdiff1d(every, every[::CALIBRATION])
    if not len(seed) or label[seed].min() == label[seed].max():
        return None
    rate = label[seed].mean()
    own = [(x[seed], label[seed].astype(float)) for x in views]
    weights, stages = [], []
    for turn in range(ROUNDS + 1):
        weights = [logistic(x, y, np.ones(len(y))) for x, y in own]
        if turn == ROUNDS:
            break
        counts = tally(pool, [*stages, (weights, None)])
        stages.append((weights, [limits(c, rate) for c in counts]))
        rates = np.zeros((2, 2))
        for view, (first, last) in enumerate(stages[-1][1]):
            sure = counts[view][: last + 1].sum(), counts[view][first:].sum()
            rates[view] = [MAX_GIVEN * share / max(int(n), 1) for n, share in zip(sure, (1 - rate, rate), strict=True)]
        if not counts.sum():
            break
        for view, (content, meta, y) in enumerate(drawn(pool, stages, rates, labelled)):  # what one view labels teaches the other
            x, known = own[1 - view]
            own[1 - view] = np.concatenate([x, (meta, content)[view]]), np.r_[known, y]
    fitted = {f"w{k}": w for k, w in enumerate(weights)}
    for k, (x, w) in enumerate(zip(views, weights, strict=True)):
        fitted[f"c{k}"] = scale(x[aside] @ w[:-1] + w[-1], label[aside].astype(float))
    share = min(max(label[aside].mean(), 1e-3), 1 - 1e-3)
    return fitted | {"base": np.array(np.log(share / (1 - share)))}


def _views(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), metadata_view(F.col("source"), F.col("lang"), F.col("n_chars"), text).alias("meta"))


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, meta, content): both views of each document, small enough to be stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            content = [text_view(x).astype(np.float16).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("meta"), pa.array(content, pa.binary())], ["doc_id", "meta", "content"])

    slim = _views(docs).select("doc_id", F.array_distinct("meta").alias("meta"), "text")
    return slim.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, meta array<int>, content binary")


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """The model of ``docs`` (doc_id, text, source, lang, n_chars) and ``labels`` (doc_id, quality), from rows outside the
    held-out fold; unlabelled documents are all others of these, those without an id too. Their features are stored without a
    shuffle. None where labels don't have both classes. What the driver holds is bounded by this module's parameters."""
    own = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    own = materialise(own.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "quality_labels")
    training = docs.filter(~held_out(F.col("doc_id")))
    rows = materialise(_features(training).withColumn("draw", F.rand(24)), "quality_features")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(own.filter(draw < MAX_LABELLED / max(own.count(), 1))), "doc_id")  # some MAX_LABELLED ids
    few = few.filter(F.col("draw") < MAX_LABELLED / max(few.count(), 1))  # fewer where ids repeat
    few = few.select("doc_id", "quality", "content", "meta").toPandas().sort_values(["doc_id", "content"], kind="stable")
    model = co_train(list(_matrices(few)), np.minimum(few["quality"].to_numpy(int), 1), rows, own) if len(few) else None
    release(rows)
    release(own)
    return model


def score_quality(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, source, lang, n_chars): doc_id, ``text_score``, ``meta_score`` and
    ``score``, the combined probability of quality 1.

    Null and empty texts have the content of no trigrams; null metadata are values of their own. Without a model all
    scores are 0.5. Repeated rows each get their row; ids may be null; an empty table gives no rows; further columns
    are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            out = np.full((3, batch.num_rows), 0.5)
            if model and batch.num_rows:
                z = np.array([text_view(x) @ model["w0"][:-1] for x in batch.column("text").to_pylist()]) + model["w0"][-1]
                z = model["c0"][0] * z + model["c0"][1]
                meta = np.array([model["w1"][:-1][np.unique(x)].sum() for x in batch.column("meta").to_pylist()]) + model["w1"][-1]
                meta = model["c1"][0] * meta + model["c1"][1]
                out = sigmoid(np.stack([z, meta, z + meta - float(model["base"])]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "text_score", "meta_score", "score"])

    return _views(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_score double, meta_score double, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "text_score", "meta_score")
