"""Split, scaling, training and scoring on Spark ML.

Data preparation is DataFrame expressions with an SQL oracle; the five
trainers are Spark ML estimators configured to the reference's objectives:

* logistic regression and linear SVC: sklearn minimises
  ``C * sum(w * loss) + |b|^2 / 2``; Spark minimises
  ``sum(w * loss) / sum(w) + regParam * |b|^2 / 2``, so
  ``regParam = 1 / (C * sum(w))`` gives the same optimum (balanced weights
  sum to n); features are scaled here, so ``standardization=False``;
* random forest: ``numTrees``, ``maxDepth`` (absent = unbounded -> 30,
  Spark's maximum), sqrt feature subsets, balanced weights; over
  FOREST_DRIVER_ROWS rows the same forest with trees stored as tables
  (``forest``);
* gradient boosting: ``maxIter``, ``stepSize``, ``maxDepth``, unweighted;
* SVC with the RBF kernel has no Spark equivalent: random Fourier features
  (Rahimi & Recht 2007) with ``gamma = 1 / (d * var(X))`` and D = 200
  seeded components, computed as a column projection, then a linear SVC.
  This is an approximation and documented as such; with ``exact: True`` among
  the hyperparameters the dual itself is solved (``kernel_svc``).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.functions.grouped import group_order_statistics, join_groups
from tidewise.functions.quantiles import order_statistics
from tidewise.operators import forest, kernel_svc
from tidewise.session import checkpoint_dir, materialize

# Models that get standard scaling, and the first-round model.
NEEDS_SCALING = {"LogisticRegression", "SVC"}
DEFAULT_MODEL_CONFIG = {"model_name": "LogisticRegression", "hyperparameters": {"C": 1.0}}
SEED = 42
RFF_COMPONENTS = 200
MAX_TREE_DEPTH = 30
#: Training rows up to which Spark's forest is fitted: its trees grow with their
#: rows and end on the driver. Beyond it, trees are stored as tables (``forest``).
#: Either is fitted on all training rows.
FOREST_DRIVER_ROWS = 200_000
#: Rows in one partition of the fitted rows at most.
FIT_PART_ROWS = 100_000
#: Partitions that a group of a forest's trees goes over its rows in. A tree's
#: deep nodes hold few rows, but every partition sends statistics of every node,
#: so the work of a deep forest grows with its partitions: cores are kept busy by
#: fitting groups of trees side by side instead.
FOREST_PARTS = 2
# Deep (unbounded) trees: a larger node-statistics budget lets one pass over
# the data split more nodes, and cached node ids avoid re-walking every
# tree per level (same trees, ~6x faster at sf 0.1).
TREE_TUNING = {"maxMemoryInMB": 1024, "cacheNodeIds": True}


def vector_columns(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if isinstance(df.schema[c].dataType, VectorUDT)]


def fill_zero(df: DataFrame, features: list[str]) -> DataFrame:
    """Remaining missing feature values -> 0."""
    return df.fillna(0, subset=features)


def split_hash(key: Column, seed: int = SEED) -> Column:
    """Row order for the split: the first 60 bits of md5(seed|key) as a
    number (same order as the hex digest)."""
    hexd = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(hexd, 1, 15), 16, 10).cast("bigint")


#: Up to so many classes, cuts are searched on brackets without a shuffle; more
#: are ranked as a table.
CLASSES_AT_ONCE = 32


def _class_cuts(df: DataFrame, cls: Column, h: Column, h2: Column, frac: float) -> tuple[DataFrame, bool]:
    """_cls, _cut, _cut2: the hashes up to which a class's rows go to test; no
    _cut2 where all rows with the hash _cut do. Also whether the classes are few."""
    few = df.select(cls.alias("c")).filter("c IS NOT NULL").distinct().limit(CLASSES_AT_ONCE + 1).collect()
    if len(few) > CLASSES_AT_ONCE:
        rows = df.select(cls.alias("_cls"), F.struct(h.alias("a"), h2.alias("b")).alias("_h")).filter("_cls IS NOT NULL")
        cuts = group_order_statistics(rows, ["_cls"], "_h", lambda n: {"cut": F.ceil(n * F.lit(frac)) - 1})
        return cuts.select("_cls", F.col("value.a").alias("_cut"), F.col("value.b").alias("_cut2")), False
    classes = sorted(r[0] for r in few)
    wanted: dict[int, int] = {}

    def rank(i, n):
        wanted[i] = math.ceil(frac * n)
        return [wanted[i] - 1]

    found = order_statistics(df, [(h, cls == F.lit(c)) for c in classes], rank, dtype="bigint") if classes else []
    cut = {i: f[0] for i, f in enumerate(found) if f[0] is not None}
    cuts: list[tuple] = []
    if cut:
        tied = {i: (cls == F.lit(classes[i])) & (h == F.lit(int(v))) for i, v in cut.items()}
        row = df.agg(*[F.count_if((cls == F.lit(classes[i])) & (h < F.lit(int(v)))).alias(f"b{i}") for i, v in cut.items()],
                     *[F.count_if(t).alias(f"t{i}") for i, t in tied.items()]).first()
        split = [i for i in cut if row[f"b{i}"] + row[f"t{i}"] > wanted[i]]
        second = dict(zip(split, order_statistics(df, [(h2, tied[i]) for i in split],
                                                  lambda j, n: [wanted[split[j]] - row[f"b{split[j]}"] - 1], dtype="bigint"))) if split else {}
        cuts = [(classes[i], int(v), second[i][0] if i in second else None) for i, v in cut.items()]
    return df.sparkSession.createDataFrame(cuts, "_cls double, _cut bigint, _cut2 bigint"), True


def stratified_split(df: DataFrame, target: str, key: str, frac: float = 0.2,
                     seed: int = SEED) -> DataFrame:
    """Adds ``split`` = test / train: per class exactly ceil(frac * n_class)
    rows go to test, chosen by the seeded hash order of ``key``; rows that
    repeat the key at the cut, and rows without a key among the others, are
    ordered by a hash of the whole row (rows equal in every column stay
    together). The cuts are order statistics
    or, for many classes, ranks in a table; the split joins the table of cuts, and
    no class's rows meet in one task. The rows are written once with their
    hashes (``discard`` removes them), so that the search for the cuts does not
    compute them anew in every pass."""
    if key == target:
        raise ValueError("stratified_split: the key must not be the target")
    cls = F.col(target).cast("double")
    h2 = F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in df.columns])
    h = F.coalesce(split_hash(F.col(key), seed), F.shiftrightunsigned(h2, 4))  # 60 bits as well
    hashed = materialize(df.withColumns({"_h": h, "_h2": h2}), "split")
    table, few = _class_cuts(hashed, cls, F.col("_h"), F.col("_h2"), frac)
    marked = join_groups(hashed, cls, table, "_cls", few)
    test = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("_cut2").isNull() | (F.col("_h2") <= F.col("_cut2"))))
    out = marked.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train").alias("split"))
    out.stored_at = hashed.stored_at
    return out


def balanced_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """weight = n / (k * n_class), joined from the table of class counts."""
    counts = df.groupBy(F.col(target).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    held = counts.limit(CLASSES_AT_ONCE + 1).collect()
    few = len(held) <= CLASSES_AT_ONCE
    if few:
        counts = df.sparkSession.createDataFrame(held, counts.schema)
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select("_cls", (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(name))
    return join_groups(df, F.col(f"`{target}`"), w, "_cls", few).drop("_cls")


@dataclass
class ScalerModel:
    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / std with the population std; a constant column is
        divided by 1, as sklearn does."""
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(self.means[c])) /
               F.lit(self.stds[c] if self.stds[c] else 1.0)
            for c in self.means})


class Scaler:
    def __init__(self, cols: list[str]):
        self.cols = cols

    def fit(self, train: DataFrame) -> ScalerModel:
        row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(self.cols)],
                        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")
                          for i, c in enumerate(self.cols)]).first()
        return ScalerModel({c: row[f"m{i}"] or 0.0 for i, c in enumerate(self.cols)},
                           {c: row[f"s{i}"] or 0.0 for i, c in enumerate(self.cols)})


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


@dataclass
class RffModel:
    """Random Fourier features for the RBF kernel. The map z = sqrt(2/D) *
    cos(X W^T + b) is one matrix product per Arrow batch inside a scalar
    Arrow UDF (a 200 x d projection of column expressions is too large
    for whole-stage codegen); columns and results pass as flat buffers, no
    object per row."""
    omega: np.ndarray  # (D, d)
    phase: np.ndarray  # (D,)
    features: list[str]
    out: str = "rff"

    @property
    def columns(self) -> list[str]:
        return [self.out]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        omega_t = self.omega.T.copy()
        phase = self.phase.copy()
        scale = math.sqrt(2.0 / len(phase))

        @F.arrow_udf("array<double>")
        def rff(*x: pa.Array) -> pa.Array:
            z = np.cos(np.column_stack([c.to_numpy(zero_copy_only=False) for c in x]) @ omega_t + phase) * scale
            return pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * len(phase), z.ravel())

        made = rff(*[F.col(c).cast("double") for c in self.features])
        return df.withColumn(self.out, array_to_vector(made))


def rbf_gamma(train: DataFrame, features: list[str]) -> float:
    """1 / (d * var(X)) over all training values (sklearn 'scale')."""
    d = len(features)
    sq = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    tot = sum((F.col(c) for c in features), F.lit(0.0))
    row = train.agg(F.sum(sq).alias("ss"), F.sum(tot).alias("s"), F.count(F.lit(1)).alias("n")).first()
    m = row["n"] * d
    var = (row["ss"] / m - (row["s"] / m) ** 2) if m else 1.0
    return 1.0 / (d * var) if var > 0 else 1.0


def fit_rff(train: DataFrame, features: list[str], components: int = RFF_COMPONENTS,
            seed: int = SEED) -> RffModel:
    """Components drawn for the kernel with ``rbf_gamma``."""
    d, gamma = len(features), rbf_gamma(train, features)
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(components, d))
    phase = rng.uniform(0.0, 2.0 * math.pi, size=components)
    return RffModel(omega, phase, features)


def make_estimator(model_name: str, hyperparameters: dict | None, n_train: float,
                   weight_col: str | None = "weight"):
    """Spark ML estimator for a (validated) model config; an unknown name
    falls back to a balanced forest of 100 trees."""
    hp = dict(hyperparameters or {})
    common = dict(featuresCol="features", labelCol="label")
    if model_name == "LogisticRegression":
        c = float(hp.get("C", 1.0))
        return LogisticRegression(regParam=1.0 / (c * n_train), elasticNetParam=0.0,
                                  standardization=False, maxIter=1000, tol=1e-8,
                                  weightCol=weight_col, **common)
    if model_name == "GradientBoostingClassifier":
        return GBTClassifier(maxIter=int(hp.get("n_estimators", 150)),
                             stepSize=float(hp.get("learning_rate", 0.1)),
                             maxDepth=int(hp.get("max_depth", 5)), lossType="logistic",
                             seed=SEED, **TREE_TUNING, **common)
    if model_name == "SVC":
        c = float(hp.get("C", 1.0))
        return LinearSVC(regParam=1.0 / (c * n_train), standardization=False, maxIter=1000,
                         weightCol=weight_col, **common)
    if model_name == "RandomForestClassifier":
        depth = hp.get("max_depth")
        depth = MAX_TREE_DEPTH if depth is None else min(int(depth), MAX_TREE_DEPTH)
        return RandomForestClassifier(numTrees=int(hp.get("n_estimators", 100)), maxDepth=depth,
                                      featureSubsetStrategy="sqrt", seed=SEED,
                                      weightCol=weight_col, **TREE_TUNING, **common)
    return RandomForestClassifier(numTrees=100, maxDepth=MAX_TREE_DEPTH, featureSubsetStrategy="sqrt",
                                  seed=SEED, weightCol=weight_col, **TREE_TUNING, **common)


@dataclass
class Forest:
    """Trees fitted in groups, used as one forest: a row's class is the one with
    the largest sum of the votes of all trees, as in a forest fitted at once."""
    groups: list

    @property
    def totalNumNodes(self) -> int:
        return sum(m.totalNumNodes for m in self.groups)

    @property
    def featureImportances(self):
        """The mean over all trees that split at all, as Spark takes it."""
        grown = [sum(t.numNodes > 1 for t in m.trees) for m in self.groups]
        total = sum(n * m.featureImportances.toArray() for n, m in zip(grown, self.groups))
        return Vectors.dense(total / max(1, sum(grown)))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``prediction`` from its vector column ``features``."""
        votes = [f"_votes{i}" for i in range(len(self.groups))]
        for m, v in zip(self.groups, votes):
            df = m.copy({m.rawPredictionCol: v, m.probabilityCol: "", m.predictionCol: ""}).transform(df)
        total = vector_to_array(F.col(votes[0]))
        for v in votes[1:]:
            total = F.zip_with(total, vector_to_array(F.col(v)), lambda x, y: x + y)
        df = df.withColumn("_votes", total).drop(*votes)
        first = F.array_position("_votes", F.array_max("_votes")) - 1
        return df.withColumn("prediction", first.cast("double")).drop("_votes")


def fit_forest(est: RandomForestClassifier, data: DataFrame, parts: int):
    """``est`` fitted on ``data`` (persisted, in ``parts`` partitions): at once
    where these are few, else its trees dealt out to groups that are fitted side by side, each
    over FOREST_PARTS partitions with its own seed."""
    trees = est.getNumTrees()
    groups = min(trees, data.sparkSession.sparkContext.defaultParallelism // FOREST_PARTS)
    if parts <= FOREST_PARTS or groups < 2:
        return est.fit(data)

    def fit(i: int):
        rows = data.repartition(FOREST_PARTS).persist()
        own = est.copy({est.numTrees: trees // groups + (i < trees % groups), est.seed: est.getSeed() + 1000 * i,
                        est.maxMemoryInMB: est.getMaxMemoryInMB() // FOREST_PARTS})
        try:
            return own.fit(rows)
        finally:
            rows.unpersist()

    with ThreadPoolExecutor(groups) as pool:
        return Forest(list(pool.map(fit, range(groups))))


@dataclass
class Trained:
    model_name: str
    hyperparameters: dict
    features: list[str]
    target: str
    key: str
    model: object
    scaler: ScalerModel | None = None
    rff: RffModel | None = None
    n_train: int = 0
    n_test: int = 0
    #: Steps of a linear model's solver; ``converged`` is False where it ran
    #: out of steps. None for other models.
    iterations: int | None = None
    converged: bool | None = None
    split: DataFrame | None = field(default=None, repr=False)

    @property
    def vectors(self) -> list[str]:
        """Features that are vectors (a wide one-hot encoding)."""
        return vector_columns(self.split, self.features)

    @property
    def full_name(self) -> str:
        hp = ", ".join(f"{k}={v}" for k, v in self.hyperparameters.items())
        return f"{self.model_name}({hp})" if hp else self.model_name

    def report(self) -> str:
        text = f"Model: {self.full_name}\nTrain size: {self.n_train}, Test size: {self.n_test}"
        return text if self.converged is not False else f"{text}\nNot converged after {self.iterations} iterations"

    def prepare(self, df: DataFrame) -> DataFrame:
        df = fill_zero(df, self.features)
        if self.scaler is not None:
            df = self.scaler.transform(df)
        df = df.withColumn("label", F.col(self.target).cast("double"))
        if self.rff is not None:
            return self.rff.transform(df).withColumnRenamed(self.rff.out, "features")
        return assemble(df, self.features)

    def predict(self, df: DataFrame) -> DataFrame:
        """Class predictions: (key, label, prediction)."""
        out = self.model.transform(self.prepare(df).select(self.key, "label", "features"))
        return out.select(self.key, "label", "prediction")

    def test_predictions(self) -> DataFrame:
        return self.predict(self.split.filter("split = 'test'"))

    def importance(self, top: int = 15) -> DataFrame:
        """Top features by tree importance or |coefficient|; none for RBF."""
        spark = self.split.sparkSession
        schema = "rank int, feature string, importance double"
        if self.rff is not None:
            return spark.createDataFrame([], schema)
        m = self.model
        if hasattr(m, "featureImportances"):
            vals = m.featureImportances.toArray()
        elif hasattr(m, "coefficients"):
            vals = np.abs(m.coefficients.toArray())
        else:
            return spark.createDataFrame([], schema)
        names = [c for c in self.features if c not in self.vectors]
        if self.vectors:  # one vector of categories, after the others
            names += [f"{self.vectors[0]}[{j}]" for j in range(len(vals) - len(names))]
        order = sorted(range(len(vals)), key=lambda i: (-vals[i], i))[:top]
        return spark.createDataFrame([(r + 1, names[i], float(vals[i])) for r, i in enumerate(order)],
                                     schema)


def fit_partitions(spark, rows: int) -> int:
    """Partitions an estimator goes over the fitted rows in, hundreds of times:
    two a core, none for few rows, and not over FIT_PART_ROWS rows in one."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(2 * cores, rows // 1000), -(-rows // FIT_PART_ROWS))


def train(features: DataFrame, target: str, key: str, config: dict | None = None,
          frac: float = 0.2, seed: int = SEED) -> Trained:
    """split -> fill -> weight -> scale where needed -> fit. Default:
    logistic regression, C = 1, when no recommendation is given. A vector
    column among the features (a wide one-hot encoding) is used as it is,
    unscaled, by every model but SVC with the RBF kernel."""
    checkpoint_dir(features.sparkSession)  # tree training checkpoints node ids there
    if not config or "model_name" not in config:
        config = dict(DEFAULT_MODEL_CONFIG)
    name = config["model_name"]
    hp = dict(config.get("hyperparameters") or {})
    feats = [c for c in features.columns if c not in (target, key)]
    wide = vector_columns(features, feats)
    feats = [c for c in feats if c not in wide] + wide
    split = stratified_split(fill_zero(features, feats), target, key, frac, seed)
    train_df = split.filter("split = 'train'")
    scaler = Scaler([c for c in feats if c not in wide]).fit(train_df) if name in NEEDS_SCALING else None
    rff = None
    prepared = scaler.transform(train_df) if scaler else train_df
    rbf = name == "SVC" and hp.get("kernel", "rbf") == "rbf"
    if rbf and wide:
        raise ValueError("SVC with the RBF kernel takes plain columns, not vectors")
    if rbf and not hp.get("exact"):
        rff = fit_rff(prepared, feats, seed=seed)
    weighted = (balanced_weights(train_df, target) if name != "GradientBoostingClassifier"
                else train_df.withColumn("weight", F.lit(1.0)))
    n_train = weighted.count()
    t = Trained(name, hp, feats, target, key, None, scaler, rff, n_train, split=split)
    if rbf and hp.get("exact"):
        # not persisted: the fit stores its bounded rows itself, and reads the others twice at most
        data = t.prepare(weighted).select("features", "label", "weight")
        t.model = kernel_svc.fit(data, rbf_gamma(prepared, feats), float(hp.get("C", 1.0)))
    else:
        parts = fit_partitions(features.sparkSession, n_train)
        data = t.prepare(weighted.repartition(parts)).select("features", "label", "weight")
        est = make_estimator(name, hp, float(n_train),
                             None if name == "GradientBoostingClassifier" else "weight")
        trees = isinstance(est, RandomForestClassifier)
        stored = trees and n_train > FOREST_DRIVER_ROWS and not wide
        if name not in NEEDS_SCALING and not stored:  # the linear models store their blocks of rows themselves
            data = data.persist()
        if stored:
            t.model = forest.fit(data, est.getNumTrees(), est.getMaxDepth(), est.getSeed())
        else:
            t.model = fit_forest(est, data, parts) if trees else est.fit(data)
        if isinstance(est, (LogisticRegression, LinearSVC)):
            done = t.model.summary if isinstance(est, LogisticRegression) else t.model.summary()
            t.iterations = done.totalIterations
            t.converged = t.iterations < est.getMaxIter()
        else:
            data.unpersist()
    t.n_test = split.filter("split = 'test'").count()
    return t


def logistic_gradient(trained: Trained) -> DataFrame:
    """Certificate of a fitted logistic regression: (term, gradient) of
    ``sum(w * log loss) / sum(w) + regParam * |b|^2 / 2`` at the fitted point,
    a row per coefficient and one for the intercept, from one aggregate over
    the training rows. All are 0 at the optimum, and the coefficients are
    within ``|gradient| / regParam`` of it. Vector features are not covered."""
    if not isinstance(trained.scaler, ScalerModel) or trained.vectors or not hasattr(trained.model, "interceptVector"):
        raise ValueError("logistic_gradient: a logistic regression on plain columns is needed")
    rows = balanced_weights(trained.split.filter("split = 'train'"), trained.target)
    rows = trained.scaler.transform(fill_zero(rows, trained.features))
    coef = [float(v) for v in trained.model.coefficients.toArray()]
    margin = F.lit(float(trained.model.intercept))
    for c, b in zip(trained.features, coef):
        margin = margin + F.col(c) * F.lit(b)
    rows = rows.withColumn("_r", F.col("weight") * (1.0 / (1.0 + F.exp(-margin)) - F.col(trained.target).cast("double")))
    one = rows.agg(F.sum("weight").alias("w"), F.sum("_r").alias("g"),
                   *[F.sum(F.col("_r") * F.col(c)).alias(f"g{i}") for i, c in enumerate(trained.features)])
    reg = 1.0 / (float(trained.hyperparameters.get("C", 1.0)) * trained.n_train)
    terms = [F.struct(F.lit(c).alias("term"), (F.col(f"g{i}") / F.col("w") + reg * b).alias("gradient"))
             for i, (c, b) in enumerate(zip(trained.features, coef))]
    terms.append(F.struct(F.lit("(intercept)").alias("term"), (F.col("g") / F.col("w")).alias("gradient")))
    return one.select(F.explode(F.array(*terms)).alias("t")).select("t.*")


def to_array(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn(col, vector_to_array(F.col(col)))
