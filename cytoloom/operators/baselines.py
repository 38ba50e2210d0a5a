"""Baseline estimators: class shares, ridge, logistic regression, trees; fitted by Spark ML or closed form, applied as columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import logit, sigmoid


class Estimator(Protocol):
    """What an estimator of fate and age is: fitted on rows, it gives rows with predictions."""

    def fit(self, train: DataFrame) -> Callable[[DataFrame], DataFrame]: ...


def class_shares(df: DataFrame, by: list[str], y: str, k: int, age: Column) -> DataFrame:
    """by, p0.., mu_age: class frequencies and mean age, the prediction of a model without inputs."""
    shares = [F.avg((F.col(y) == i).cast("double")).alias(f"p{i}") for i in range(k)]
    return df.groupBy(*by).agg(*shares, F.avg(age).alias("mu_age"))


def binned_fit(train: DataFrame, by: list[str], x: str, bucket: Column, y: str, k: int, age: str, mask: str) -> Callable[[DataFrame], DataFrame]:
    """Two least fits for every group of `by` in one aggregate each: class shares by bucket with one row of each class added, and the age as a line of x. Gives p0.. and mu_age; a bucket without rows has equal shares."""
    from .expression import ols

    counts = train.groupBy(*by, bucket.alias("__b")).agg(*(((F.count_if(F.col(y) == i) + 1) / (F.count(y) + k)).alias(f"p{i}") for i in range(k)))
    line = ols(by, train.filter(mask), x, age)

    def predict(df: DataFrame) -> DataFrame:
        bare = df.drop("mu_age", *(f"p{i}" for i in range(k))).withColumn("__b", bucket)
        out = bare.join(F.broadcast(counts), [*by, "__b"], "left").join(F.broadcast(line), by)
        return out.withColumns({**{f"p{i}": F.coalesce(f"p{i}", F.lit(1 / k)) for i in range(k)}, "mu_age": F.col("a") * F.col(x) + F.col("b")}).drop("__b", "a", "b")

    return predict


def _features(cols: list[str]) -> list:
    return [VectorAssembler(inputCols=cols, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)]


def ridge(train: DataFrame, cols: list[str], y: str, alpha: float = 1.0, out: str = "prediction") -> Callable[[DataFrame], DataFrame]:
    """Least squares with alpha |w|^2 on standardised columns.

    The solver divides the loss by rows and works on a label of unit spread, so the penalty is alpha times the label's spread over the rows.
    """
    stats = train.agg(F.count(y).alias("n"), F.stddev_pop(y).alias("sd")).first()
    fit = LinearRegression(labelCol=y, solver="normal", standardization=False, regParam=alpha * (stats["sd"] or 0.0) / max(stats["n"], 1), elasticNetParam=0.0, predictionCol=out)
    model = Pipeline(stages=[*_features(cols), fit]).fit(train)
    return lambda df: model.transform(df).drop("__raw", "features")


def logistic(train: DataFrame, cols: list[str], y: str, weight: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Multinomial logistic regression with unit penalty; gives array column probs."""
    n = train.count()
    fit = LogisticRegression(labelCol=y, family="multinomial", regParam=1.0 / max(n, 1), standardization=False, maxIter=50, **({"weightCol": weight} if weight else {}))
    model = Pipeline(stages=[*_features(cols), fit]).fit(train)
    return lambda df: model.transform(df).withColumn("probs", vector_to_array("probability")).drop("__raw", "features", "rawPrediction", "probability", "prediction")


def balanced_logistic(train: DataFrame, cols: list[str], hit: str) -> Callable[[DataFrame], DataFrame]:
    """Logistic regression of a 0/1 column whose two classes weigh alike in all; gives column fitted, the probability of 1. Raises ValueError where a class has no rows."""
    n = {r[0]: r[1] for r in train.groupBy(hit).count().collect()}
    if not n.get(0) or not n.get(1):
        raise ValueError(f"rows of one class only: {n.get(0, 0)} of 0, {n.get(1, 0)} of 1")
    half = (n[0] + n[1]) / 2
    scored = logistic(train.withColumn("__w", F.when(F.col(hit) == 1, half / n[1]).otherwise(half / n[0])), cols, hit, "__w")
    return lambda df: scored(df).withColumn("fitted", F.col("probs")[1]).drop("probs")


#: what an estimator may see: the state, the perturbation, or both
VIEWS = {"x_only": ["z0", "z1"], "u_only": ["z2", "sigma_age"], "all": ["z0", "z1", "z2", "sigma_age"]}


def view(train: DataFrame, cols: list[str], y: str = "y", age: str = "y_age", mask: str = "age_mask") -> Callable[[DataFrame], DataFrame]:
    """Logistic and ridge regression on a view's columns: gives p0.. and mu_age in place of those of the rows. A single class or no age leaves its share, or the mean."""
    shares = train.agg(F.count_distinct(y).alias("k"), F.max(y).alias("top"), F.count_if(mask).alias("ages"), F.avg(F.when(F.col(mask), F.col(age))).alias("mean")).first()
    fate = logistic(train.select(*cols, y), cols, y) if shares["k"] > 1 else None
    years = ridge(train.filter(mask).select(*cols, age), cols, age, out="__age") if shares["ages"] > 1 else None
    n = (shares["top"] or 0) + 1

    def predict(df: DataFrame) -> DataFrame:
        bare = df.drop("mu_age", "probs", *(f"p{i}" for i in range(n)))
        out = fate(bare) if fate else bare.withColumn("probs", F.array(*(F.lit(float(i == n - 1)) for i in range(n))))
        out = years(out) if years else out.withColumn("__age", F.lit(shares["mean"] or 0.0))
        return out.withColumns({"mu_age": F.col("__age"), **{f"p{i}": F.get("probs", F.lit(i)) for i in range(n)}}).drop("__age", "probs")

    return predict


def fourier_features(df: DataFrame, cols: list[str], n: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """df with k0.., random Fourier features of a Gaussian kernel: ridge on them is kernel ridge, as far as n features go."""
    import numpy as np

    r = np.random.default_rng(seed)
    w, b = r.normal(0, scale, (n, len(cols))), r.uniform(0, 2 * np.pi, n)
    at = lambda i: sum((F.col(c) * float(w[i, j]) for j, c in enumerate(cols)), F.lit(float(b[i])))
    return df.withColumns({f"k{i}": F.cos(at(i)) * float(np.sqrt(2.0 / n)) for i in range(n)})


#: what fits by name: each takes training rows, feature columns and the target, and gives a function of rows to rows with a prediction
REGRESSORS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {"ridge": lambda d, c, y: ridge(d, c, y), "boosted": lambda d, c, y: trees(d, c, y, "boosted"), "forest": lambda d, c, y: trees(d, c, y, "forest"), "kernel": lambda d, c, y: kernel_ridge(d, c, y)}


def kernel_ridge(train: DataFrame, cols: list[str], y: str, n: int = 32) -> Callable[[DataFrame], DataFrame]:
    model = ridge(fourier_features(train, cols, n), [f"k{i}" for i in range(n)], y)
    return lambda df: model(fourier_features(df, cols, n)).drop(*(f"k{i}" for i in range(n)))


def trees(train: DataFrame, cols: list[str], y: str, kind: str = "boosted") -> Callable[[DataFrame], DataFrame]:
    fit = GBTRegressor(labelCol=y, maxIter=10, maxDepth=3, seed=1) if kind == "boosted" else RandomForestRegressor(labelCol=y, numTrees=20, maxDepth=5, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), fit]).fit(train)
    return lambda df: model.transform(df).drop("features")


def ensemble(train: DataFrame, cols: list[str], y: str, age: str, members: int) -> Callable[[DataFrame], DataFrame]:
    """Members fitted on rows weighted by Poisson(1) draws from a hash; gives member, cell_id, probs, mu_age of each."""
    from ..functions.columns import unit_hash

    train = train.drop("mu_age", "probs")  # names of what is predicted
    fitted = []
    for m in range(members):
        u = unit_hash(f"member-{m}", F.col("cell_id"))
        # quantiles of Poisson(1)
        w = F.when(u < 0.3679, 0.0).when(u < 0.7358, 1.0).when(u < 0.9197, 2.0).when(u < 0.981, 3.0).otherwise(4.0)
        drawn = train.withColumn("__w", w).filter("__w > 0")
        fitted.append((m, logistic(drawn, cols, y, "__w"), ridge(drawn.filter(F.col(age).isNotNull()), cols, age, out="mu_age")))

    def predict(df: DataFrame) -> DataFrame:
        bare = df.drop("mu_age", "probs")
        parts = [r(p(bare)).select(F.lit(m).alias("member"), "cell_id", "probs", "mu_age") for m, p, r in fitted]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    return predict


# ---- calibrators: each fits on (p, y) and gives a function from a probability column to a calibrated one ----


def platt_on_logit(df: DataFrame, p: str, y: str) -> tuple[float, float]:
    """slope in [0.01, 100] and intercept in [-100, 100] of a logistic fit on the logit; labels may be soft: a row counts as y of one and 1 - y of the other label."""
    x = df.select(logit(F.col(p)).alias("x"), F.col(y).cast("double").alias("t"))
    rows = x.select("x", F.lit(1.0).alias("label"), F.col("t").alias("w")).unionByName(x.select("x", F.lit(0.0).alias("label"), (1 - F.col("t")).alias("w"))).filter("w > 0")
    if rows.select("label").distinct().count() < 2:
        return 1.0, 0.0
    from pyspark.ml.linalg import Matrices, Vectors

    fit = LogisticRegression(weightCol="w", standardization=False, lowerBoundsOnCoefficients=Matrices.dense(1, 1, [0.01]), upperBoundsOnCoefficients=Matrices.dense(1, 1, [100.0]), lowerBoundsOnIntercepts=Vectors.dense(-100.0), upperBoundsOnIntercepts=Vectors.dense(100.0))
    model = fit.fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    a, b = float(model.coefficients[0]), float(model.intercept)

    def loss(s: float, i: float) -> Column:
        q = F.greatest(F.least(sigmoid(s * F.col("x") + i), F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.avg(-(F.col("t") * F.ln(q) + (1 - F.col("t")) * F.ln(1 - q)))

    fitted, identity = x.agg(loss(a, b), loss(1.0, 0.0)).first()
    return (a, b) if fitted <= identity else (1.0, 0.0)


def calibrators() -> dict[str, Callable[[DataFrame, str, str], Callable[[DataFrame], DataFrame]]]:
    """Families by name: fit(df, p, y) -> (df -> df with column q)."""

    def identity(df, p, y):
        return lambda d: d.withColumn("q", F.col(p))

    def platt(df, p, y):
        a, b = platt_on_logit(df, p, y)
        return lambda d: d.withColumn("q", sigmoid(a * logit(F.col(p)) + b))

    def logistic_on_p(df, p, y):
        n = df.count()
        assemble = VectorAssembler(inputCols=[p], outputCol="features")
        model = LogisticRegression(labelCol=y, regParam=1.0 / max(n, 1), standardization=False).fit(assemble.transform(df))
        return lambda d: d.withColumn("q", sigmoid(F.lit(float(model.coefficients[0])) * F.col(p) + float(model.intercept)))

    def isotonic(df, p, y):
        model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="q").fit(df)
        return lambda d: model.transform(d).withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q"))))

    return {"identity": identity, "platt": platt, "logistic": logistic_on_p, "isotonic": isotonic}


def bakeoff(df: DataFrame, fold: str, p: str, y: str, bins: int = 10) -> DataFrame:
    """family, fold, ece out of fold and in sample, optimism; families and folds are few, rows are never collected."""
    from .metrics import ece_binary

    parts = []
    for f in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train, test = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        for name, fit in calibrators().items():
            apply = fit(train, p, y)
            for role, rows in (("out", test), ("in", train)):
                parts.append(apply(rows).select(F.lit(name).alias("family"), F.lit(f).alias("held_out"), F.lit(role).alias("role"), "q", F.col(y).alias("y")))
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    e = ece_binary(all_, ["family", "held_out", "role"], "q", "y", bins)
    wide = e.groupBy("family", "held_out").pivot("role", ["out", "in"]).agg(F.first("ece"))
    return wide.select("family", "held_out", F.col("out").alias("ece_out"), F.col("in").alias("ece_in"), (F.col("out") - F.col("in")).alias("optimism"))


def external(df: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """Rows scored by a model from outside Spark: predict takes a pandas DataFrame of a batch and gives one of `schema`. For models that no expression can state."""

    def run(batches):
        for pdf in batches:
            yield predict(pdf)

    return df.mapInPandas(run, schema)
