"""Group summaries and tests, as aggregations and joins of their small results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somatrix.functions.survival import chi_square_survival, normal_survival
from somatrix.tables import materialise


def counts(facts: DataFrame, by: str, of: str) -> DataFrame:
    """(by, of, n)."""
    return facts.filter(F.col(by).isNotNull() & F.col(of).isNotNull()).groupBy(by, of).agg(F.count("*").alias("n"))


def shares(facts: DataFrame, by: str, of: str) -> DataFrame:
    """``counts`` with ``share`` of the group, ``percent`` and ``label``, the percentage with two decimals."""
    whole = counts(facts, by, of).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    percent = F.col("share") * 100
    return whole.withColumn("percent", percent).withColumn("label", F.format_string("%.2f%%", percent))


def pivoted(facts: DataFrame, by: str, of: str, values: list, order: list | None = None) -> DataFrame:
    """One row for each group, one column of counts for each of ``values``; groups in ``order`` that are missing give
    zeros, others go."""
    wide = facts.groupBy(by).pivot(of, values).agg(F.count(F.lit(1))).na.fill(0)
    if order is None:
        return wide
    ranks = facts.sparkSession.createDataFrame(list(enumerate(order)), f"ord int, {by} string")
    return ranks.join(wide, by, "left").na.fill(0)


def z_scores(facts: DataFrame, features: tuple[str, ...], population: bool = False) -> DataFrame:
    """Features less their mean, by their standard deviation: of the sample, or of the population."""
    spread = F.stddev_pop if population else F.stddev_samp
    figures = facts.agg(*[F.avg(f).alias(f"{f}__m") for f in features], *[spread(f).alias(f"{f}__s") for f in features])
    whole = facts.crossJoin(F.broadcast(figures))  # one row of figures
    return whole.select(*[c for c in facts.columns if c not in features], *[F.try_divide(F.col(f) - F.col(f"{f}__m"), F.col(f"{f}__s")).alias(f) for f in features])


def group_means(facts: DataFrame, by: str, features: tuple[str, ...]) -> DataFrame:
    """Means for each group of the rows that have all features."""
    return facts.dropna(how="any", subset=[by, *features]).groupBy(by).agg(*[F.avg(f).alias(f) for f in features])


def clamped(value: Column, least: float = -1.0, most: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(least)), F.lit(most))


def long_form(facts: DataFrame, keys: list[str], features: tuple[str, ...]) -> DataFrame:
    """(keys, feature, value)."""
    return facts.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, list(features), "feature", "value")


def correlations(facts: DataFrame, features: tuple[str, ...], missing: str = "pairwise") -> DataFrame:
    """(f1, f2, r): Pearson's r for each pair of features, in one aggregation.

    ``missing`` says what null and NaN do: pairwise leaves a row out of the pairs that it lacks, complete leaves it out
    of all, propagate makes each pair of an incomplete feature null."""
    facts = facts.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    if missing == "complete":
        facts = facts.dropna(how="any")
    pairs = [(a, b) for a in features for b in features]
    values = []
    for a, b in pairs:
        r = F.corr(a, b)
        if missing == "propagate":
            r = F.when(F.count_if(F.col(a).isNull() | F.col(b).isNull()) == 0, r)
        values.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), r.alias("r")))
    return facts.agg(F.array(*values).alias("all")).select(F.inline("all"))


def expected_counts(observed: DataFrame, by: str, of: str) -> DataFrame:
    """The full table (by, of, n, expected) of a contingency table in long form; pairs that it lacks have n = 0. The
    product of the two sets of values, which is the table itself, is made by joining on a constant key."""
    rows = observed.groupBy(by).agg(F.sum("n").alias("row_n")).withColumn("one", F.lit(1))
    columns = observed.groupBy(of).agg(F.sum("n").alias("column_n")).withColumn("one", F.lit(1))
    total = observed.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    grid = rows.join(columns, "one").join(total, "one").drop("one")
    whole = grid.join(observed, [by, of], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return whole.withColumn("expected", F.col("row_n") * F.col("column_n") / F.col("total"))


def chi_square(observed: DataFrame, by: str, of: str) -> DataFrame:
    """(chi2, df, p) of independence, without continuity correction."""
    whole = expected_counts(observed, by, of)
    sums = whole.agg(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")).alias("chi2"), ((F.countDistinct(by) - 1) * (F.countDistinct(of) - 1)).cast("int").alias("df"))
    return sums.withColumn("p", chi_square_survival("chi2", "df"))


def chi_square_cells(observed: DataFrame, by: str, of: str) -> DataFrame:
    """For each cell its Pearson residual; ``contribution``, its residual's square as a percentage of chi square; and
    ``square_share``, 100 times its squared count by the sum of all counts, to three decimals."""
    whole = expected_counts(observed, by, of).withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))
    sums = whole.agg(F.sum(F.pow("residual", F.lit(2))).alias("__chi2"), F.sum("n").alias("__total"))
    whole = whole.crossJoin(F.broadcast(sums))  # one row
    return whole.select(by, of, "n", "expected", "residual", F.try_divide(100 * F.pow("residual", F.lit(2)), F.col("__chi2")).alias("contribution"), F.round(100 * F.col("n") * F.col("n") / F.col("__total"), 3).alias("square_share"))


def _running(counted: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``counted`` (keys, value, ties, one row a value) with ``before``: how many are smaller within the same keys.

    Rows are dealt by ranges of (keys, value), about ``block`` a range, which Spark bounds by a sample of its own; a running sum
    inside a range goes on from the totals of the ranges before it. No task holds one key whole."""
    counted = materialise(counted, "counted")
    parts = max(1, -(-counted.count() // block))
    dealt = materialise(counted.repartitionByRange(parts, *keys, "value").withColumn("part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "part").agg(F.sum("ties").alias("n"))  # a row for each range and key that meet
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inside", F.coalesce(F.sum("ties").over(within), F.lit(0))).join(starts, [*keys, "part"])
    return summed.select(*keys, "value", "ties", (F.col("start") + F.col("inside")).alias("before"))


def mid_ranks(values: DataFrame, block: int = 100_000) -> DataFrame:
    """``values`` (feature, group, value) counted by distinct value, with ``rank``, the mean of the ranks that equal
    values take, and ``ties``, how many there are. Distinct values are counted first, and those counts ranked."""
    values = values.filter(F.col("value").isNotNull())
    counted = values.groupBy("feature", "value").agg(F.count("*").alias("ties"))
    ranked = _running(counted, ["feature"], block).select("feature", "value", "ties", (F.col("before") + (F.col("ties") + 1) / 2).alias("rank"))
    return values.groupBy("feature", "group", "value").agg(F.count("*").alias("n")).join(ranked, ["feature", "value"])


def quartiles(values: DataFrame, block: int = 100_000) -> DataFrame:
    """(feature, group, n, least, q1, median, q3, most, mean, deviation) from rows (feature, group, value) without null.

    Exact, by running counts of distinct values: a quantile lies between the two values about (n - 1) times its share, in
    proportion. ``deviation`` is the sample's; of one value it is null."""
    keys, values = ["feature", "group"], values.filter(F.col("value").isNotNull())
    runs = _running(values.groupBy(*keys, "value").agg(F.count("*").alias("ties")), keys, block)
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("ties")), F.col("value")))

    found = []
    for share, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        exact = (F.col("n") - 1) * share
        low, high = at(F.floor(exact)), at(F.ceil(exact))
        found.append((low + (high - low) * (F.max(exact) - F.floor(F.max(exact)))).alias(name))
    cut = runs.join(whole.select(*keys, "n"), keys).groupBy(*keys).agg(*found)
    return whole.join(cut, keys).select(*keys, "n", "least", "q1", "median", "q3", "most", "mean", "deviation")


def densities(values: DataFrame, places: int = 512, cut: float = 0.0) -> DataFrame:
    """(feature, group, place, x, density): what a violin draws, a Gaussian kernel density at ``places`` even steps from the
    least to the largest value, ``cut`` bandwidths beyond both.

    The bandwidth is 0.9 n^-0.2 times the lesser of the sample's deviation and the quartiles' distance by 1.34 (of one of them
    where the other is 0); groups of one value or of equal ones have no rows. Values are first counted at the steps, each
    shared between the two next to it, so that a group is ``places`` numbers, whatever its size."""
    found = materialise(quartiles(values), "quartiles")
    spread = (F.col("q3") - F.col("q1")) / 1.34
    width = F.when(F.least("deviation", spread) > 0, F.least("deviation", spread)).otherwise(F.greatest("deviation", spread))
    found = found.withColumn("width", 0.9 * width * F.pow(F.col("n").cast("double"), F.lit(-0.2))).filter("width > 0")
    found = found.withColumn("first", F.col("least") - cut * F.col("width")).withColumn("step", (F.col("most") + cut * F.col("width") - F.col("first")) / (places - 1))
    steps = found.select("feature", "group", "first", "step")
    counted = values.filter(F.col("value").isNotNull()).groupBy("feature", "group", "value").agg(F.count("*").alias("k")).join(steps, ["feature", "group"])
    counted = counted.withColumn("at", (F.col("value") - F.col("first")) / F.col("step")).withColumn("low", F.least(F.floor("at"), F.lit(places - 2)).cast("int"))
    part = F.col("at") - F.col("low")
    shared = counted.select("feature", "group", F.inline(F.array(F.struct(F.col("low").alias("place"), (F.col("k") * (1 - part)).alias("w")), F.struct((F.col("low") + 1).alias("place"), (F.col("k") * part).alias("w")))))
    weights = shared.groupBy("feature", "group", "place").agg(F.sum("w").alias("w")).groupBy("feature", "group").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("at"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0)))

    @F.pandas_udf("array<double>")
    def smooth(weights: pd.Series, step: pd.Series, width: pd.Series, n: pd.Series) -> pd.Series:
        apart, out = np.arange(places), []
        for w, s, h, k in zip(weights, step, width, n, strict=True):
            bell = np.exp(-0.5 * (apart * s / h) ** 2) / (k * h * np.sqrt(2 * np.pi))
            out.append(np.convolve(w, np.r_[bell[:0:-1], bell])[places - 1 : 2 * places - 1])
        return pd.Series(out)

    drawn = found.join(weights, ["feature", "group"]).withColumn("all", smooth(dense, "step", "width", "n"))
    each = drawn.select("feature", "group", "first", "step", F.posexplode("all").alias("place", "density"))
    return each.select("feature", "group", "place", (F.col("first") + F.col("place") * F.col("step")).alias("x"), "density")


def _rank_sums(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature, group, n, rank_sum), and for each feature N and the sum of t^3 - t over its ties."""
    ranked = materialise(mid_ranks(values), "ranks")
    groups = ranked.groupBy("feature", "group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    t = F.col("ties").cast("double")
    ties = ranked.groupBy("feature", "value").agg(F.first("ties").alias("ties")).groupBy("feature").agg(F.sum("ties").cast("double").alias("total"), F.sum(t * t * t - t).alias("tied"))
    return groups, ties


def kruskal_wallis(values: DataFrame) -> DataFrame:
    """(feature, h, df, p) from rows (feature, group, value), corrected for ties. A feature of equal values has null h."""
    groups, ties = _rank_sums(values)
    sums = groups.groupBy("feature").agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), (F.count("*") - 1).cast("int").alias("df")).join(ties, "feature")
    raw = 12 / (F.col("total") * (F.col("total") + 1)) * F.col("s") - 3 * (F.col("total") + 1)
    h = F.try_divide(raw, 1 - F.try_divide(F.col("tied"), F.pow("total", F.lit(3)) - F.col("total")))
    return sums.select("feature", h.alias("h"), "df").withColumn("p", chi_square_survival("h", "df"))


def dunn(values: DataFrame) -> DataFrame:
    """(feature, g1, g2, z, p): Dunn's comparison of each pair of groups, Bonferroni-corrected."""
    groups, ties = _rank_sums(values)
    a = groups.select("feature", F.col("group").alias("g1"), F.col("n").alias("n1"), (F.col("rank_sum") / F.col("n")).alias("m1"))
    b = groups.select("feature", F.col("group").alias("g2"), F.col("n").alias("n2"), (F.col("rank_sum") / F.col("n")).alias("m2"))
    pairs = a.join(b, "feature").filter("g1 < g2").join(ties, "feature")
    variance = (F.col("total") * (F.col("total") + 1) / 12 - F.col("tied") / (12 * (F.col("total") - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    whole = pairs.withColumn("z", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(variance)))
    m = F.count("*").over(Window.partitionBy("feature"))
    return whole.withColumn("m", m).select("feature", "g1", "g2", "z", F.least(F.lit(1.0), 2 * normal_survival(F.abs("z")) * F.col("m")).alias("p"))


def significant(pairs: DataFrame, level: float = 0.05) -> DataFrame:
    """Pairs of groups whose corrected p is below ``level``; those without a p aren't among them."""
    return pairs.filter(F.col("p") < level)


def group_distances(means: DataFrame, by: str, features: tuple[str, ...]) -> DataFrame:
    """(a, b, distance): Euclidean distances between group means, a < b. As many rows as pairs of groups."""
    a = means.select(F.col(by).alias("a"), F.array(*features).alias("x"), F.lit(1).alias("one"))
    b = means.select(F.col(by).alias("b"), F.array(*features).alias("y"), F.lit(1).alias("one"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return a.join(b, "one").filter("a < b").select("a", "b", d.alias("distance"))


def complete_linkage(distances: DataFrame) -> DataFrame:
    """(step, left, right, height): the merges of a hierarchical clustering of at most a few hundred groups. Leaves have
    their names; what step k made is named ``#k``. Equal heights merge in order of names."""
    spark = distances.sparkSession
    rows = distances.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many groups to cluster hierarchically")
    d = {frozenset((r["a"], r["b"])): r["distance"] for r in rows}
    alive, out = sorted({x for pair in d for x in pair}, key=str), []
    while len(alive) > 1:
        height, a, b = min((d[frozenset((x, y))], str(x), str(y)) for i, x in enumerate(alive) for y in alive[i + 1 :])
        names = {str(x): x for x in alive}
        new = f"#{len(out) + 1}"
        for x in alive:
            if x not in (names[a], names[b]):
                d[frozenset((x, new))] = max(d[frozenset((x, names[a]))], d[frozenset((x, names[b]))])
        alive = [x for x in alive if x not in (names[a], names[b])] + [new]
        out.append((len(out) + 1, a, b, float(height)))
    return spark.createDataFrame(out, "step int, left string, right string, height double")


def confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(name, precision, recall, f1, support): a row for each class, and accuracy, macro avg and weighted avg. A ratio
    without a denominator is 0."""
    table = confusion(predictions, label, predicted)
    cast = F.col(label).cast("string"), F.col(predicted).cast("string")
    long = table.select(F.explode(F.array(F.struct(cast[0].alias("name"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(cast[1].alias("name"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))).alias("x")).select("x.*")
    classes = long.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("hit", "support", "said")])

    def zero(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    classes = classes.withColumn("precision", zero(F.col("hit"), F.col("said"))).withColumn("recall", zero(F.col("hit"), F.col("support")))
    classes = classes.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    each = classes.select("name", "precision", "recall", "f1", "support")
    figures = ("precision", "recall", "f1")
    macro = classes.agg(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in figures], F.sum("support").alias("support"))
    weighted = classes.agg(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in figures], F.sum("support").alias("support"))
    right = F.sum("hit") / F.sum("support")
    accuracy = classes.agg(F.lit("accuracy").alias("name"), *[right.alias(c) for c in figures], F.sum("support").alias("support"))
    return each.unionByName(accuracy).unionByName(macro).unionByName(weighted)
