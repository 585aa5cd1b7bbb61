"""Model building and evaluation on Spark ML: features, folds, tuning, metrics, importance."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, PCA, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, discard, small
from .ranks import group_quantiles, with_rank
from .splines import PenalisedSplines


def select_terms(df: DataFrame, patterns: Sequence[str], drop: Sequence[str] = ()) -> list[str]:
    """Columns whose names match a pattern, in the order of the table."""
    return [c for c in df.columns if c not in drop and any(re.search(p, c) for p in patterns)]


def formula(target: str, terms: Sequence[str]) -> str:
    return f"{target} ~ {' + '.join(terms)}"


def standard_steps(terms: Sequence[str], out: str = "features") -> list:
    """Assemble, drop constant features, centre and scale."""
    return [
        VectorAssembler(inputCols=list(terms), outputCol="_raw", handleInvalid="skip"),
        VarianceThresholdSelector(featuresCol="_raw", outputCol="_varied", varianceThreshold=0.0),
        StandardScaler(inputCol="_varied", outputCol=out, withMean=True, withStd=True),
    ]


class MedianImputer(Estimator):
    """Fills unknown (null or NaN) numbers with the column's lower median, exact at any size: equal values are counted, and counts are summed in the order of values."""

    def __init__(self, cols: Sequence[str], into: Sequence[str]):
        super().__init__()
        self.cols, self.into = list(cols), list(into)

    def _fit(self, df: DataFrame) -> MedianModel:
        long = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(self.cols)])).alias("e")
        known = df.select(long).select("e.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
        counts = cut(known.groupBy("i", "v").count())
        # ranges of values: counted whole, then only those that hold a median are summed row by row
        dealt = cut(counts.repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()))
        before = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = dealt.groupBy("i", "part").agg(F.sum("count").alias("held")).withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))
        parts = parts.withColumn("k", F.floor((F.sum("held").over(Window.partitionBy("i")) + 1) / 2))
        parts = parts.filter((F.col("below") < F.col("k")) & (F.col("k") <= F.col("below") + F.col("held")))
        along = F.col("below") + F.sum("count").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        found = dealt.join(F.broadcast(parts), ["i", "part"]).withColumn("upto", along).filter(F.col("upto") >= F.col("k"))
        medians = {r["i"]: r["v"] for r in found.groupBy("i").agg(F.min("v").alias("v")).collect()}
        return MedianModel(self.cols, self.into, [medians.get(i) for i in range(len(self.cols))])


class MedianModel(Model):
    """A MedianImputer's columns with the medians for what is unknown; a column without a known value is refused, as Spark's Imputer does."""

    def __init__(self, cols: Sequence[str], into: Sequence[str], medians: Sequence[float | None]):
        super().__init__()
        if lost := [c for c, m in zip(cols, medians, strict=True) if m is None]:
            raise ValueError(f"no known value in {', '.join(lost)}")
        self.cols, self.into, self.medians = list(cols), list(into), list(medians)

    def _transform(self, df: DataFrame) -> DataFrame:
        known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return df.withColumns({to: F.coalesce(known(c), F.lit(m)) for c, to, m in zip(self.cols, self.into, self.medians, strict=True)})


def mixed_steps(numeric: Sequence[str], categorical: Sequence[str], components: Sequence[str] = (), k: int = 5, out: str = "features") -> list:
    """Median imputation, levels (unseen ones apart) as dummies, and principal components of some columns."""
    filled = [f"{c}_filled" for c in (*numeric, *components)]
    steps: list = [MedianImputer([*numeric, *components], filled)]
    parts = filled[: len(numeric)]
    if categorical:
        index, dummy = [f"{c}_index" for c in categorical], [f"{c}_dummy" for c in categorical]
        steps += [StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep"), OneHotEncoder(inputCols=index, outputCols=dummy)]
        parts = [*parts, *dummy]
    if components:
        steps += [VectorAssembler(inputCols=filled[len(numeric) :], outputCol="_parts"), PCA(k=min(k, len(components)), inputCol="_parts", outputCol="_pca")]
        parts = [*parts, "_pca"]
    return [*steps, VectorAssembler(inputCols=parts, outputCol=out)]


def normalise_by_train(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """Centred and scaled by the training rows; a spread that is 0 or unknown counts as 1."""
    train = F.col(split) == "train"
    stats = df.agg(
        *[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(F.when(train, F.col(c))).alias(f"_s_{c}") for c in cols]
    )
    out = df.crossJoin(F.broadcast(stats))
    spread = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) > 0, F.col(f"_s_{c}")).otherwise(1.0)
    out = out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / spread(c) for c in cols})
    return out.drop(*[f"_{a}_{c}" for c in cols for a in "ms"])


def impute_forest(df: DataFrame, cols: Sequence[str], key: str, trees: int = 50, rounds: int = 2, donors: int = 0, seed: int = 2025) -> DataFrame:
    """Nulls of each column predicted by a forest on the others, in turn, starting from medians.

    With donors, a null takes the value known at one of that many nearest predictions (by a hash of the key); between predictions
    as near, the smaller key counts as nearer.
    """
    known = {c: f"_known_{c}" for c in cols}
    medians = {r["col"]: r["value"] for r in group_quantiles(df, [], cols, [0.5]).collect()}  # a row for each column
    out = df.withColumns({k: F.col(c).isNotNull() for c, k in known.items()})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double")) for c in cols})
    for _ in range(rounds):
        for c in cols:
            others = [o for o in cols if o != c]
            forest = RandomForestRegressor(featuresCol="_x", labelCol=c, predictionCol="_p", numTrees=trees, maxDepth=5, minInstancesPerNode=10, seed=seed)
            model = Pipeline(stages=[VectorAssembler(inputCols=others, outputCol="_x"), forest]).fit(dealt(out.filter(known[c])))
            out = model.transform(out)
            if donors:
                out = cut(_nearest_donors(cut(out), c, known[c], key, donors))
            out = out.withColumn(c, F.when(F.col(known[c]), F.col(c)).otherwise(F.col("_p"))).drop("_x", "_p")
    return out.drop(*known.values())


def _nearest_donors(df: DataFrame, col: str, known: str, key: str, k: int) -> DataFrame:
    """_p of the unknown rows replaced by the known value at one of the k nearest predictions.

    Predictions are dealt to ranges. Each range also gets the k known ones next below and above it, so that the k on either
    side of any prediction lie in its range; of a prediction that many known rows share, k are enough.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy("_p").orderBy("_donor")
    held = df.filter(known).select("_p", F.col(key).alias("_donor"), F.col(col).alias("_value"))
    held = held.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
    asked = df.filter(~F.col(known)).select("_p").distinct()
    cuts = sorted(set(asked.approxQuantile("_p", [i / parts for i in range(1, parts)], 0.2 / parts)))
    range_of = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("_p"))) if cuts else F.lit(0)
    held, asked = cut(held.withColumn("_range", range_of)), asked.withColumn("_range", range_of)

    def ends(order) -> list:
        w = Window.partitionBy("_range").orderBy(order, "_donor")
        rows = held.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n").collect()  # k for each range
        return sorted(sorted(rows, key=lambda r: r["_donor"]), key=lambda r: r["_p"])

    handed, low, high = [], ends(F.asc("_p")), ends(F.desc("_p"))
    for i in range(len(cuts) + 1):
        below = sorted((r for r in high if r["_range"] < i), key=lambda r: -r["_p"])[:k]
        above = [r for r in low if r["_range"] > i][:k]
        handed += [(r["_p"], r["_donor"], r["_value"], i) for r in below + above]
    held = held.unionByName(spark.createDataFrame(handed, held.schema))
    # places in the order of the predictions; a donor's place counts from the side on which it is looked for
    up, down = Window.partitionBy("_range").orderBy("_p", "_donor"), Window.partitionBy("_range").orderBy(F.asc("_p"), F.desc("_donor"))
    placed = held.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    both = held.select("_range", "_p", F.lit(1).alias("_one")).unionByName(asked.select("_range", "_p", F.lit(0).alias("_one")))
    before = Window.partitionBy("_range").orderBy("_p", "_one").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("_less", F.sum("_one").over(before)).filter("_one = 0").select("_range", F.col("_p").alias("_q"), "_less")
    above = at.withColumn("_up", F.explode(F.sequence(F.col("_less") + 1, F.col("_less") + k))).join(placed.drop("_down"), ["_range", "_up"])
    below = at.withColumn("_down", F.explode(F.sequence(F.col("_less") - (k - 1), F.col("_less")))).join(placed.drop("_up"), ["_range", "_down"])
    found = above.drop("_up").unionByName(below.drop("_down"))
    near = F.struct(F.abs(F.col("_p") - F.col("_q")).alias("_far"), "_donor", "_value")
    found = found.groupBy("_q").agg(F.slice(F.sort_array(F.collect_list(near)), 1, k).alias("_near"))
    out = df.join(found, (F.col("_p") == F.col("_q")) & ~F.col(known), "left")
    chosen = F.get("_near", F.pmod(F.xxhash64(key), F.size("_near")).cast("int"))["_value"]
    return out.withColumn("_p", F.coalesce(chosen, F.col("_p"))).drop("_q", "_near")


def boosted_trees(label: str, **params) -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol="features", seed=2025, **params)


def latin_hypercube(ranges: Mapping[str, tuple[float, float]], n: int, seed: int = 2025, whole: Iterable[str] = (), powers: Iterable[str] = ()) -> list[dict]:
    """n parameter sets that fill the ranges evenly on every axis; `powers` are ranges of base-10 exponents."""
    rng = np.random.default_rng(seed)
    axes = {k: (rng.permutation(n) + rng.uniform(size=n)) / n for k in ranges}
    out = []
    for i in range(n):
        row = {k: lo + axes[k][i] * (hi - lo) for k, (lo, hi) in ranges.items()}
        out.append({k: int(round(v)) if k in set(whole) else float(10**v) if k in set(powers) else float(v) for k, v in row.items()})
    return out


def drawn(key: str | Column, seed: int | str) -> Column:
    """A whole number below 2**48 that a key (and a seed) always draws: the first digits of an MD5 sum."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def random_folds(df: DataFrame, key: str, k: int, seed: int = 0, into: str = "fold") -> DataFrame:
    return df.withColumn(into, (drawn(key, seed) % k).cast("int"))


def grouped_folds(df: DataFrame, group: str, into: str = "fold") -> DataFrame:
    """A fold for each group, numbered by its order. A model is fitted for each fold, so groups are few."""
    names = df.select(group).distinct()
    names = names.withColumn(into, F.row_number().over(Window.orderBy(group)) - 1)  # a row for each group
    return df.join(small(names), group)


def block_folds(df: DataFrame, size: float, k: int = 5, x: str = "x", y: str = "y", into: str = "fold") -> DataFrame:
    """Square blocks dealt to folds along a snake through their rows.

    Blocks are numbered within their row of blocks, and rows from the counts of those before, so no task gets all blocks.
    """
    bx, by = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    blocks = df.select(bx.alias("_bx"), by.alias("_by")).distinct()
    along = F.when(F.pmod(F.col("_by"), F.lit(2)) == 0, F.col("_bx")).otherwise(-F.col("_bx"))
    before = Window.orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)  # a row for each row of blocks
    rows = blocks.groupBy("_by").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    snake = F.col("_first") + F.row_number().over(Window.partitionBy("_by").orderBy(along)) - 1
    blocks = cut(blocks.join(rows.select("_by", "_first"), "_by").select("_bx", "_by", (snake % k).alias(into)))
    return df.withColumns({"_bx": bx, "_by": by}).join(small(blocks), ["_bx", "_by"]).drop("_bx", "_by")


def folds(df: DataFrame, how: str | None, key: str, group: str | None = None, size: float = 10_000.0, k: int = 5) -> DataFrame:
    """Spatial or grouped folds, or random ones if there is nothing to group by."""
    if how == "spatial" and {"x", "y"} <= set(df.columns):
        return block_folds(df, size, k)
    if how == "grouped" and group in df.columns:
        return grouped_folds(df, group)
    return random_folds(df, key, k)


def metrics(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, rsq (squared correlation) and n of the rows that have both, overall or by group.

    Aggregates pass over what is unknown. A filter would be moved below the model, and the prediction worked out in it as well.
    """
    e = F.col(truth) - F.col(prediction)
    out = df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.pow(F.corr(truth, prediction), 2).alias("rsq"), F.count(e).alias("n"))
    return out.filter(F.col("n") > 0) if by else out


def masked_loss(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean over targets of the mean squared error where the target is known."""
    terms = [F.sum(F.when(F.col(t).isNotNull(), F.pow(F.col(t) - F.col(p), 2))) / F.greatest(F.count(t), F.lit(1)) for t, p in pairs]
    return df.agg((sum(terms[1:], F.coalesce(terms[0], F.lit(0.0))) / len(pairs)).alias("loss"))


#: Rows of a task of a fit: trees keep them in memory, some 250 bytes each, and read them again in each round.
FIT_ROWS = 50_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows to fit on, dealt out by their values to tasks of about FIT_ROWS, in an order that is always the same; so few as one task holds are left as they are.

    A file of some MB is read by one task, whatever number of rows that is.
    """
    n = -(-df.count() // FIT_ROWS)
    by = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return df.repartition(n, *by).sortWithinPartitions(*by) if n > 1 and by else df


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df kept by the executors, in memory and then on disk, while fits go over it again and again: it is dealt and sorted once."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _with_params(estimator: Estimator, params: Mapping) -> Estimator:
    return estimator.copy({estimator.getParam(k): v for k, v in params.items()})


@contextmanager
def fold_rows(df: DataFrame, steps: Sequence, fold: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The rows outside a fold and those inside, ready for a learner: the steps before it are fitted once, whatever is tried after them."""
    with held(dealt(df.filter(F.col("fold") != fold))) as train:
        ready = Pipeline(stages=list(steps)).fit(train)
        yield ready.transform(train), ready.transform(df.filter(F.col("fold") == fold))


def _score(train: DataFrame, test: DataFrame, estimator: Estimator, params: Mapping, label: str) -> float:
    row = metrics(_with_params(estimator, params).fit(train).transform(test), label, "prediction").first()
    return float(row["rmse"]) if row and row["rmse"] is not None else float("nan")


def fold_scores(df: DataFrame, steps: Sequence, estimator: Estimator, params: Mapping, label: str, fold: int) -> float:
    with fold_rows(df, steps, fold) as (train, test):
        return _score(train, test, estimator, params, label)


def still_racing(scores: Mapping[int, Sequence[float]]) -> list[int]:
    """The configurations whose paired loss against the best isn't beyond doubt: two standard errors above it."""
    best = min(scores, key=lambda i: float(np.mean(scores[i])))
    kept = []
    for i, got in scores.items():
        gap = np.array(got) - np.array(scores[best])
        if i == best or gap.mean() - 2 * gap.std(ddof=1) / np.sqrt(len(gap)) <= 0:
            kept.append(i)
    return kept


def tune(df: DataFrame, steps: Sequence, estimator: Estimator, design: Sequence[Mapping], label: str, k: int, race_after: int | None = 3, at_once: int = 4) -> DataFrame:
    """(config, params, fold, rmse) of every configuration run; df has a column fold from 0 to k - 1.

    With race_after, once so many folds (two at least) are in, configurations that lose beyond doubt drop out. Rows are written
    once and read by all fits, of which at_once run side by side. So do two folds, as long as none can drop out between them.
    """
    import json

    rows_in = cut(df)
    alive, scores = list(range(len(design))), {i: [] for i in range(len(design))}

    def scored(fold: int) -> list[float]:
        with fold_rows(rows_in, steps, fold) as (train, test):
            return pool.map(lambda i: _score(train, test, estimator, design[i], label), alive, chunksize=1)

    opening = min(k, max(2, race_after)) if race_after else k  # folds that all configurations run
    with ThreadPool(at_once) as pool, ThreadPool(2) as pairs:
        for some in (range(opening), *([fold] for fold in range(opening, k))):
            for got in pairs.map(scored, some, chunksize=1):
                for i, s in zip(alive, got, strict=True):
                    scores[i].append(s)
            if race_after and some[-1] + 1 >= max(2, race_after) and len(alive) > 1:
                alive = still_racing({i: scores[i] for i in alive})
    discard(rows_in)
    rows = [(i, json.dumps(dict(design[i]), sort_keys=True), f, float(s)) for i, got in scores.items() for f, s in enumerate(got)]
    return df.sparkSession.createDataFrame(rows, "config int, params string, fold int, rmse double")


def best_config(tuned: DataFrame, k: int) -> dict:
    """The parameters of least mean loss among the configurations that ran all folds."""
    import json

    ran = tuned.groupBy("config", "params").agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    return json.loads(ran.orderBy("rmse", "config").first()["params"])  # a row for each configuration


LEARNERS: dict[str, Callable[[str], Estimator]] = {
    "boosted": lambda label: GBTRegressor(labelCol=label, maxIter=20, maxDepth=4, seed=2025),
    "elastic": lambda label: LinearRegression(labelCol=label, elasticNetParam=0.5, regParam=0.01),
    "forest": lambda label: RandomForestRegressor(labelCol=label, numTrees=100, seed=2025),
    "additive": lambda label: PenalisedSplines(labelCol=label),
    "linear": lambda label: LinearRegression(labelCol=label),
}


def benchmark_models(
    df: DataFrame, targets: Sequence[str], features: Mapping[str, Sequence[str]], date: str, split: str, learners: Sequence[str] = ("boosted", "elastic"), at_once: int = 4
) -> DataFrame:
    """(target, features, learner, rmse, mae, rsq, n) on rows from the date on, of models of the rows before.

    The learners of a target and its features read the same rows, dealt out once, at_once of them side by side.
    """
    parts, known = [], cut(dealt(df))
    for target, (name, terms) in itertools.product(targets, features.items()):
        rows = known.filter(F.col(target).isNotNull()).dropna(subset=list(terms))
        train, test = rows.filter(F.col(date) < F.lit(split).cast("date")), rows.filter(F.col(date) >= F.lit(split).cast("date"))
        with held(dealt(train).select(*dict.fromkeys([target, *terms]))) as train, ThreadPool(at_once) as pool:

            def fitted(learner: str) -> PipelineModel:
                steps = [VectorAssembler(inputCols=list(terms), outputCol="features", handleInvalid="skip" if learner == "additive" else "error")]  # noqa: B023
                return Pipeline(stages=[*steps, LEARNERS[learner](target)]).fit(train)  # noqa: B023

            models = pool.map(fitted, learners, chunksize=1)
        for learner, model in zip(learners, models, strict=True):
            got = metrics(model.transform(test), target, "prediction")
            parts.append(got.select(F.lit(target).alias("target"), F.lit(name).alias("features"), F.lit(learner).alias("learner"), "rmse", "mae", "rsq", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_predict_year(train: DataFrame, grid: DataFrame, year: int, target: str, terms: Sequence[str], estimator: Estimator | None = None, keys: Sequence[str] = ("gid", "x", "y")) -> DataFrame:
    """Predictions on a grid by a model of one year's rows."""
    rows = train.filter((F.col("year") == year) & F.col(target).isNotNull()).dropna(subset=list(terms))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(terms), outputCol="features"), estimator or boosted_trees(target, maxIter=20, maxDepth=4)]).fit(dealt(rows))
    return model.transform(grid.fillna(0.0, list(terms))).select(*keys, F.lit(year).alias("year"), F.col("prediction").alias("value"))


def prediction_difference(corrected: DataFrame, original: DataFrame, keys: Sequence[str] = ("gid",)) -> DataFrame:
    return corrected.join(original.select(*keys, F.col("value").alias("_o")), list(keys)).withColumn("diff", F.col("value") - F.col("_o")).drop("_o")


def relocation_impact(corrected: DataFrame, original: DataFrame, grid: DataFrame, year: int, target: str, terms: Sequence[str], make: Callable[[], Estimator] | None = None) -> DataFrame:
    """How predictions on a grid differ if sites are placed where they were rather than where they are registered."""
    a, b = (fit_predict_year(t, grid, year, target, terms, make() if make else None) for t in (corrected, original))
    return prediction_difference(a, b)


def top_importance(model: PipelineModel, terms: Sequence[str], spark, n: int = 10) -> DataFrame:
    """(variable, importance, rank) of a tree model's most important features."""
    values = model.stages[-1].featureImportances
    rows = sorted(((t, float(values[i])) for i, t in enumerate(terms)), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame([(t, v, i) for i, (t, v) in enumerate(rows, 1)], "variable string, importance double, rank int")


def shuffled_column(df: DataFrame, col: str, key: str, seed: int = 1, parts: int | None = None) -> DataFrame:
    """df with one column's values dealt out anew (in a drawn order), all others as they were.

    The order is one of the whole table, whatever its size: the row at a place in the order of keys gets the value at that place in the drawn order.
    """
    a = with_rank(df, [key], "_i", parts)
    b = with_rank(df.select(F.col(key).alias("_k"), F.col(col).alias("_v")), [drawn("_k", seed), "_k"], "_i", parts)
    return a.join(b.select("_i", "_v"), "_i").withColumn(col, F.col("_v")).drop("_i", "_v")


def permutation_importance(model: PipelineModel, df: DataFrame, terms: Sequence[str], label: str, key: str) -> DataFrame:
    """(variable, base_rmse, rmse, increase): how much worse predictions get without a feature's order."""
    base = metrics(model.transform(df), label, "prediction").select(F.col("rmse").alias("base_rmse"))
    parts = None
    for t in terms:
        got = metrics(model.transform(shuffled_column(df, t, key)), label, "prediction").select(F.lit(t).alias("variable"), "rmse")
        parts = got if parts is None else parts.unionByName(got)
    return parts.crossJoin(F.broadcast(base)).withColumn("increase", F.col("rmse") - F.col("base_rmse"))


def shapley_importance(model: PipelineModel, df: DataFrame, terms: Sequence[str], key: str, samples: int = 8) -> DataFrame:
    """(variable, importance): mean absolute Monte-Carlo Shapley values.

    Each row meets `samples` other rows (drawn from the whole table) and as many feature orders; a feature's
    share is what the prediction changes when it joins those before it in the order.
    """
    a = with_rank(df.select(key, *terms), [key], "_i").withColumn("_n", F.lit(df.count()))
    other = a.select(F.col("_i").alias("_j"), *[F.col(t).alias(f"o_{t}") for t in terms])
    drawn = a.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(samples)])))
    drawn = drawn.withColumn("_j", F.pmod(F.col("_i") + F.pmod(F.xxhash64(key, "_s"), F.col("_n")), F.col("_n"))).join(other, "_j")
    rank = {t: F.xxhash64(F.col(key), F.col("_s"), F.lit(i)) for i, t in enumerate(terms)}
    drawn = drawn.withColumns({f"r_{t}": c for t, c in rank.items()}).withColumn("variable", F.explode(F.array(*[F.lit(t) for t in terms])))
    own = F.lit(None).cast("long")
    for t in terms:
        own = F.when(F.col("variable") == t, F.col(f"r_{t}")).otherwise(own)
    drawn = drawn.withColumn("_own", own).withColumn("_with", F.explode(F.array(F.lit(True), F.lit(False))))
    chosen = {t: F.when((F.col(f"r_{t}") < F.col("_own")) | ((F.col("variable") == t) & F.col("_with")), F.col(t)).otherwise(F.col(f"o_{t}")) for t in terms}
    scored = model.transform(drawn.select(key, "_s", "variable", "_with", *[c.alias(t) for t, c in chosen.items()]))
    gain = F.sum(F.when(F.col("_with"), F.col("prediction")).otherwise(-F.col("prediction")))
    each = scored.groupBy(key, "variable").agg((gain / samples).alias("phi"))
    return each.groupBy("variable").agg(F.avg(F.abs("phi")).alias("importance"))


def moving_window_tuning(
    df: DataFrame, targets: Sequence[str], terms: Sequence[str], test_years: Sequence[int], design: Sequence[Mapping], before: int = 3,
    learner: str | Callable[[str], Estimator] = "boosted", categorical: Sequence[str] = (), components: Sequence[str] = (), block: float = 10_000.0, k: int = 5, least_rows: int = 100, top: int = 10,
) -> DataFrame:
    """(target, test_year, rmse, mae, rsq, n, params, importance): for each target and test year, on the `before` years before it,
    the configuration that wins a race over spatial folds is fitted anew and scored on the test year.

    A window of fewer than least_rows training rows has no row. importance names the `top` features of a tree model with
    their importance, by slots of the assembled features; of other models it is null. rows need x and y for spatial folds.
    """
    import json

    from .series import rolling_origin

    make, parts = LEARNERS[learner] if isinstance(learner, str) else learner, None
    for target, year in itertools.product(targets, test_years):
        rows = cut(rolling_origin(df.filter(F.col(target).isNotNull()), "year", [year], before))
        train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
        if train.count() < least_rows:
            continue
        steps = [*mixed_steps(terms, categorical, components, out="_all"), VarianceThresholdSelector(featuresCol="_all", outputCol="_varied", varianceThreshold=0.0), StandardScaler(inputCol="_varied", outputCol="features", withMean=True, withStd=True)]
        folded = folds(train, "spatial", "id", size=block, k=k)
        won = best_config(tune(folded, steps, make(target), design, target, k), k) if len(design) > 1 else dict(design[0])
        with held(dealt(train)) as fitted_on:
            model = Pipeline(stages=[*steps, _with_params(make(target), won)]).fit(fitted_on)
        weights = getattr(model.stages[-1], "featureImportances", None)
        named = None if weights is None else ", ".join(f"{i}({w:.4f})" for w, i in sorted(((float(w), i) for i, w in enumerate(weights.toArray())), key=lambda r: (-r[0], r[1]))[:top])
        got = metrics(model.transform(test), target, "prediction").select(F.lit(target).alias("target"), F.lit(year).alias("test_year"), "rmse", "mae", "rsq", "n")
        got = got.withColumns({"params": F.lit(json.dumps(won, sort_keys=True)), "importance": F.lit(named).cast("string")})
        parts = got if parts is None else parts.unionByName(got)
    if parts is None:
        return df.sparkSession.createDataFrame([], "target string, test_year int, rmse double, mae double, rsq double, n bigint, params string, importance string")
    return parts


def with_residual(df: DataFrame, truth: str, prediction: str = "prediction") -> DataFrame:
    return df.withColumns({"y_true": F.col(truth), "y_pred": F.col(prediction), "residual": F.col(truth) - F.col(prediction)})
