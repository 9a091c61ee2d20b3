"""Splits, recursive feature elimination, and the classifiers it runs on."""

from __future__ import annotations

from decimal import Decimal

from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.tables import free_names, materialise


def exact_split(df: DataFrame, share: float, key: str, seed: int = 24, order: Column | None = None, block: int = 100_000) -> DataFrame:
    """``df`` with ``test``: true for exactly ceil(share * rows) of them, those first by a hash of the key (or ``order``),
    then by key, then by a hash of the row's number.

    The threshold is found by counting: the order's range is cut in parts, several for each ``block`` rows, and the part
    in which the threshold falls is cut again until ``block`` rows are left, which one task ranks. Where one order has
    more rows than that, the hash of the row's number goes on in its place. Columns may have any names but ``test``."""
    if not 0 < share < 1:
        raise ValueError("share is between 0 and 1, both excluded")
    order = F.xxhash64(key, F.lit(seed)) if order is None else order
    mark, tie = free_names(df, "order", "tie")
    number = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    keyed = materialise(df.withColumn(mark, F.coalesce(order.cast("long"), F.lit(0))).withColumn(tie, number), "split")
    n = keyed.count()
    wanted, before, edge, bounds = -(-int(round(share * n * 1e9)) // 10**9), 0, keyed, {}
    for column in (mark, tie):
        low, high, rows = edge.agg(F.min(column), F.max(column), F.count("*")).first()
        while rows > block and low < high:
            step = -(-(high - low + 1) // min(4096, 4 * rows // block + 2))
            part = F.floor((F.col(column).cast("decimal(20,0)") - F.lit(Decimal(low))) / F.lit(Decimal(step)))
            here = None
            for r in edge.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # 4096 at most
                here = r["part"]
                if before + r["n"] >= wanted:
                    break
                before += r["n"]
            edge = edge.filter(part == F.lit(here))
            low, high, rows = edge.agg(F.min(column), F.max(column), F.count("*")).first()
        bounds[column] = (low, high)
        if rows <= block:
            break
    inside, first, by = F.lit(True), F.lit(False), [mark, key, tie]
    for column, (low, high) in bounds.items():
        first = first | (inside & (F.col(column) < low))
        inside = inside & F.col(column).between(low, high)
        by = [mark, tie] if column == tie else by
    ranked = keyed.filter(inside).withColumn("test", F.row_number().over(Window.orderBy(*by)) <= wanted - before)
    return keyed.filter(~inside).withColumn("test", first).unionByName(ranked).drop(mark, tie)


def importances(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> list[tuple[str, float]]:
    vector = VectorAssembler(inputCols=features, outputCol="__x").transform(train)
    model = RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(vector)
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def eliminate(train: DataFrame, features: list[str], label: str, keep: int, score=importances, **options) -> DataFrame:
    """(feature, rank, importance): recursive elimination of the least important feature down to ``keep``; rank 1 is kept,
    the first to go has the highest. The loop runs over features on the driver, each fit over the table in Spark."""
    alive, gone = list(features), []
    table = materialise(train.select(label, *features), "training")
    while True:
        scored = score(table, alive, label, **options)
        if len(alive) <= keep:
            break
        gone.append(scored[-1])
        alive.remove(scored[-1][0])
    rows = [(f, 1, float(v)) for f, v in scored] + [(f, i + 2, float(v)) for i, (f, v) in enumerate(reversed(gone))]
    return train.sparkSession.createDataFrame(rows, "feature string, rank int, importance double")


def one_against_one(train: DataFrame, features: list[str], label: str, iterations: int = 50) -> dict[tuple, tuple[list[float], float]]:
    """For each pair of classes, the coefficients and intercept of a linear SVM; above zero speaks for the second class."""
    classes = sorted(r[0] for r in train.select(label).distinct().collect())
    vector = materialise(VectorAssembler(inputCols=features, outputCol="__x").transform(train).select(label, "__x"), "training")
    out = {}
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            pair = vector.filter(F.col(label).isin(a, b)).withColumn("__y", (F.col(label) == b).cast("double"))
            model = LinearSVC(featuresCol="__x", labelCol="__y", maxIter=iterations, standardization=False).fit(pair)
            out[a, b] = (model.coefficients.toArray().tolist(), float(model.intercept))
    return out


def svm_importances(train: DataFrame, features: list[str], label: str, iterations: int = 50) -> list[tuple[str, float]]:
    """Sums over all pairs of squared coefficients."""
    models = one_against_one(train, features, label, iterations)
    total = [sum(w[k] ** 2 for w, _ in models.values()) for k in range(len(features))]
    return sorted(zip(features, total, strict=True), key=lambda x: (-x[1], x[0]))


def vote(df: DataFrame, features: list[str], models: dict[tuple, tuple[list[float], float]], name: str = "predicted") -> DataFrame:
    """The class with most pairwise votes, the least of equal ones; expressions only."""
    classes = sorted({c for pair in models for c in pair})
    votes = {c: F.lit(0) for c in classes}
    for (a, b), (w, bias) in models.items():
        z = F.lit(bias)
        for f, x in zip(features, w, strict=True):
            z = z + F.col(f) * x
        votes[a] = votes[a] + (z <= 0).cast("int")
        votes[b] = votes[b] + (z > 0).cast("int")
    best = F.greatest(*[F.struct(votes[c].alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    return df.withColumn(name, best["c"])


def forest_predictions(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """``test`` with ``predicted``; labels are strings or numbers."""
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    vector = VectorAssembler(inputCols=features, outputCol="__x")
    model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(vector.transform(index.transform(train)))
    named = F.element_at(F.array(*map(F.lit, index.labels)), (F.col("prediction") + 1).cast("int"))
    return model.transform(vector.transform(test)).withColumn("predicted", named).select(*test.columns, "predicted")
