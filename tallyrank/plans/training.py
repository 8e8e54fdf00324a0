"""Training: split, scale, balance, fit four base models, stack them, score.

Order matters and is kept: the scaler sees train rows only, only train rows are
oversampled, the isolation forest is grown on the rows as they are, and folds
are cut before oversampling so no synthetic row reaches a fold it is scored in.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import zip_longest
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrank.contract import SEED
from tallyrank.functions.vectors import assembled, names_of
from tallyrank.operators import balancing, boosting, evaluation as ev, forest, isolation, scaling, split
from tallyrank.session import materialize, scratch_path
from tallyrank.sources.store import ModelRegistry, model_entries

LABEL = "class"
BASES = ["logistic_regression", "random_forest", "xgboost", "isolation_forest"]
FOLDS = 5


@dataclass
class Settings:
    """Defaults of the four base models and of the stack."""

    c: float = 1.0
    max_iter: int = 1000
    penalty: str = "l2"
    l1_ratio: float = 0.5
    forest_trees: int = 100
    forest_depth: int = 20
    forest_leaf: int = 5
    forest_bins: int = 256
    forest_bootstrap: bool = True
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    patience: int = 10
    positive_weight: float = 1.0
    validation_share: float = 0.1
    isolation_trees: int = 100
    isolation_sample: int = 256
    contamination: float = 0.002
    folds: int = FOLDS
    parallelism: int = 6
    seed: int = SEED


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def positive(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def penalty_of(rows: int, s: Settings) -> tuple[float, float]:
    """Strength of the penalty and the share of its absolute part.

    ``1 / (C * total weight)`` makes the averaged loss match a summed one.
    """
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": s.l1_ratio, "none": 0.0}[s.penalty]
    return 0.0 if s.penalty == "none" else 1.0 / (s.c * max(rows, 1)), mix


def fit_logistic(balanced: DataFrame, rows: int, s: Settings, weight: str | None = None):
    strength, mix = penalty_of(rows, s)
    lr = LogisticRegression(
        labelCol=LABEL, maxIter=s.max_iter, regParam=strength, elasticNetParam=mix,
        standardization=False,
    )
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(balanced)


def fit_forest(balanced: DataFrame, s: Settings, weight: str | None = None) -> forest.GrownForest:
    """A forest on (x, features, class) rows; ``pyspark.ml`` fits those that are too large to be sent to the tasks."""
    rows, width = balanced.agg(F.count("*"), F.max(F.size("x"))).first()
    if forest.fits(rows, width or 0, s.forest_bins):
        settings = forest.ForestSettings(s.forest_trees, min(s.forest_depth, 30), s.forest_leaf, s.forest_bins, s.forest_bootstrap, s.seed)
        return forest.fit(balanced, settings, LABEL, weight)
    rf = RandomForestClassifier(
        labelCol=LABEL, numTrees=s.forest_trees, maxDepth=min(s.forest_depth, 30),
        minInstancesPerNode=s.forest_leaf, featureSubsetStrategy="sqrt", maxBins=s.forest_bins,
        bootstrap=s.forest_bootstrap, seed=s.seed,
    )
    if weight:
        rf = rf.setWeightCol(weight)
    path = save_path(balanced.sparkSession, "ml-forest")
    rf.fit(balanced).write().save(path)
    return forest.GrownForest.load(balanced.sparkSession, path)


def class_weighted(rows: DataFrame) -> DataFrame:
    """``weight`` beside the rows: their number over that of the classes and of the class."""
    counts = {r[LABEL]: r["count"] for r in rows.groupBy(LABEL).count().collect()}
    n = sum(counts.values())
    pairs = [F.lit(x) for label, c in counts.items() for x in (label, n / (len(counts) * c))]
    return rows.withColumn("weight", F.create_map(*pairs)[F.col(LABEL)] if pairs else F.lit(1.0))


def fit_boosted(rows: DataFrame, s: Settings) -> boosting.BoostedTrees:
    """Boosted trees; rows marked ``held_out`` are kept back and end the rounds."""
    return boosting.fit(rows, boosting.BoostSettings(
        rounds=s.rounds, depth=s.depth, rate=s.rate, row_share=s.row_share, column_share=s.column_share,
        bins=s.bins, patience=s.patience, positive_weight=s.positive_weight, seed=s.seed,
    ), label=LABEL)


def fit_boosted_held_out(rows: DataFrame, s: Settings) -> boosting.BoostedTrees:
    """Boosted trees on (id, x, class) rows, stopped early on a share held out of them."""
    marked = split.StratifiedSplit(LABEL, ["id"], [s.validation_share], s.seed + 2)
    marked = marked.fit(rows).apply(rows, "part")
    held = marked.filter("part = 0").select("x", LABEL, F.lit(True).alias("held_out"))
    used = balancing.balance(marked.filter("part = 1").drop("part"), LABEL, seed=s.seed)
    return fit_boosted(used.withColumn("held_out", F.lit(False)).unionByName(held), s)


@dataclass
class Scaler:
    """Mean and scale of each feature, in the order the models read them."""

    features: list[str]
    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, rows: DataFrame) -> "Scaler":
        state = scaling.vector_state(rows).first()["state"]
        names = names_of(rows) or [f"x[{i}]" for i in range(len(state["mean"]))]
        return cls(names, list(state["mean"]), list(state["scale"]))

    def apply(self, raw: DataFrame) -> DataFrame:
        """Raw rows with ``x`` scaled.

        Without ``x``, the features are taken from the columns of their names.  An ``x`` that
        knows other names, or the same in another order, is refused, naming the first one; a
        row of another number of features stops the job.
        """
        if "x" not in raw.columns:
            raw = assembled(raw, self.features)
        names = names_of(raw)
        if names is not None and names != self.features:
            pairs = zip_longest(names, self.features)
            at, (got, want) = next((i, p) for i, p in enumerate(pairs) if p[0] != p[1])
            raise ValueError(f"position {at} of x is {got}, not {want} as the scaler reads it")
        mean, spread = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.mean, self.scale))
        scaled = F.transform("x", lambda v, i: (v - F.get(mean, i)) / F.get(spread, i))
        wrong = F.raise_error(F.lit(f"x does not hold the {len(self.features)} features of the scaler"))
        fits = F.coalesce(F.size("x"), F.lit(-1)) == len(self.features)
        return raw.withColumn("x", F.when(fits, scaled).otherwise(wrong))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.features)), self.features, self.mean, self.scale))
        names = "position int, feature string, mean double, scale double"
        spark.createDataFrame(rows, names).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scaler":
        rows = sorted(spark.read.parquet(path).select("position", "feature", "mean", "scale").collect())
        return cls([r.feature for r in rows], [r.mean for r in rows], [r.scale for r in rows])


@dataclass
class Bases:
    """The four fitted base models."""

    logistic_regression: LogisticRegressionModel
    random_forest: forest.GrownForest
    xgboost: boosting.BoostedTrees
    isolation_forest: isolation.IsolationForest

    def score(self, df: DataFrame) -> DataFrame:
        """One probability column per base model, beside the input columns."""
        keep = [F.col(c) for c in df.columns]
        model = self.logistic_regression.copy()
        model.setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_logistic")
        out = model.transform(with_features(df)).select(
            *keep, positive("_logistic").alias("logistic_regression"), self.random_forest.probability().alias("random_forest"),
            self.xgboost.probability().alias("xgboost"))
        isolated = self.isolation_forest
        return (
            isolated.score(out, "_raw")
            .withColumn("isolation_forest", isolated.probability("_raw"))
            .drop("_raw")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.logistic_regression.write().save(f"{path}/logistic_regression")
        self.random_forest.save(spark, f"{path}/random_forest")
        self.xgboost.save(spark, f"{path}/xgboost")
        self.isolation_forest.save(spark, f"{path}/isolation_forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Bases":
        return cls(
            LogisticRegressionModel.load(f"{path}/logistic_regression"),
            forest.GrownForest.load(spark, f"{path}/random_forest"),
            boosting.BoostedTrees.load(spark, f"{path}/xgboost"),
            isolation.IsolationForest.load(spark, f"{path}/isolation_forest"),
        )


@dataclass
class Ensemble:
    """The scaler, base models and the logistic model on their scores."""

    bases: Bases
    meta: LogisticRegressionModel
    scaler: Scaler

    def score_raw(self, raw: DataFrame) -> DataFrame:
        """``score`` for rows as they come, before scaling."""
        return self.score(self.scaler.apply(raw))

    def score(self, df: DataFrame) -> DataFrame:
        """Base scores and ``stacking_ensemble`` beside the columns of scaled rows."""
        scored = self.bases.score(df)
        keep = [F.col(c) for c in scored.columns]
        out = self.meta.transform(meta_features(scored))
        return out.select(*keep, positive().alias("stacking_ensemble"))

    def weights(self) -> list[tuple[str, float]]:
        return list(zip(BASES, [float(w) for w in self.meta.coefficients]))

    def save(self, spark: SparkSession, path: str) -> None:
        self.bases.save(spark, path)
        self.meta.write().save(f"{path}/meta")
        self.scaler.save(spark, f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        return cls(Bases.load(spark, path), LogisticRegressionModel.load(f"{path}/meta"),
                   Scaler.load(spark, f"{path}/scaler"))


def meta_features(scored: DataFrame) -> DataFrame:
    return scored.withColumn("features", array_to_vector(F.array(*[F.col(b) for b in BASES])))


def fit_bases(rows: DataFrame, s: Settings) -> Bases:
    """Fit all base models on (id, x, class) rows; the supervised ones balanced.

    Each model is fitted here exactly as it is on the whole train part, so the
    scores of held-out folds tell how the final models behave.
    """
    balanced = with_features(balancing.balance(rows, LABEL, seed=s.seed)).persist()
    n = balanced.count()
    try:
        weighted = class_weighted(balanced)
        return Bases(
            fit_logistic(weighted, n, s, "weight"),
            fit_forest(weighted, s, "weight"),
            fit_boosted_held_out(rows, s),
            isolation.fit(rows, s.isolation_trees, s.isolation_sample, s.contamination, s.seed),
        )
    finally:
        balanced.unpersist()


@dataclass
class TrainingRun:
    """A training run on (id, x, class) rows; every part is fitted once, on first use."""

    data: DataFrame
    settings: Settings = field(default_factory=Settings)

    @property
    def spark(self) -> SparkSession:
        return self.data.sparkSession

    @cached_property
    def split(self) -> split.StratifiedSplit:
        return split.StratifiedSplit(LABEL, ["id"], [0.2], self.settings.seed).fit(self.data)

    @cached_property
    def parts(self) -> DataFrame:
        return with_split(self.data, self.split)

    @cached_property
    def scaler(self) -> Scaler:
        return Scaler.fit(self.parts.filter(F.col("split") == "train"))

    @cached_property
    def rows(self) -> DataFrame:
        """Scaled rows with their split and fold, written once to the shared folder."""
        s = self.settings
        train = self.parts.filter(F.col("split") == "train")
        scaled = self.scaler.apply(self.parts)
        folded = split.stratified_folds(train, LABEL, ["id"], s.folds, s.seed + 1)
        out = scaled.join(folded.select("id", "fold"), "id", "left")
        return materialize(out.select("id", "x", LABEL, "split", "fold"), "training-rows")

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "train").select("id", "x", LABEL, "fold")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "test").select("id", "x", LABEL)

    @cached_property
    def balanced(self) -> DataFrame:
        rows = balancing.balance(self.train.select("id", "x", LABEL), LABEL, seed=self.settings.seed)
        return class_weighted(with_features(materialize(rows, "training-balanced")))

    @cached_property
    def balanced_rows(self) -> int:
        return self.balanced.count()

    @cached_property
    def logistic(self):
        return fit_logistic(self.balanced, self.balanced_rows, self.settings, "weight")

    def logistic_with(self, penalty: str):
        s = replace(self.settings, penalty=penalty)
        return fit_logistic(self.balanced, self.balanced_rows, s, "weight")

    def forest_without_bags(self, trees: int):
        """A forest each tree of which saw all balanced rows, so that its counts can be taken anew."""
        grown = fit_forest(self.balanced, replace(self.settings, forest_bootstrap=False, forest_trees=trees), "weight")
        return RandomForestClassificationModel.load(grown.path)

    @cached_property
    def forest(self):
        return fit_forest(self.balanced, self.settings, "weight")

    @cached_property
    def boosted(self):
        """Boosted trees with early stopping on rows held out of the train part."""
        return fit_boosted_held_out(self.train.select("id", "x", LABEL), self.settings)

    @cached_property
    def isolated(self):
        s = self.settings
        return isolation.fit(
            self.train, s.isolation_trees, s.isolation_sample, s.contamination, s.seed
        )

    @cached_property
    def bases(self) -> Bases:
        return Bases(self.logistic, self.forest, self.boosted, self.isolated)

    @cached_property
    def out_of_fold(self) -> DataFrame:
        """Every train row scored once, by models that never saw its fold."""

        def one(fold: int) -> DataFrame:
            rows = self.train.filter(F.col("fold") != fold).select("id", "x", LABEL)
            models = fit_bases(rows, self.settings)
            held = self.train.filter(F.col("fold") == fold)
            scored = models.score(held).select("id", LABEL, "fold", *BASES)
            return materialize(scored, f"out-of-fold-{fold}")

        # Folds are independent Spark jobs; threads only submit them.  More than keep the cores busy
        # would only hold more plans and models in the driver at once.
        busy = max(1, self.spark.sparkContext.defaultParallelism // 3)
        with ThreadPool(min(self.settings.parallelism, busy)) as pool:
            parts = pool.map(one, range(self.settings.folds))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def ensemble(self) -> Ensemble:
        began = time.monotonic()
        self.rows  # both threads read them
        # The models of the whole train part need nothing of the folds', so they are fitted meanwhile.
        with ThreadPool(1) as pool:
            bases = pool.apply_async(lambda: self.bases)
            scores = meta_features(self.out_of_fold).persist()
            meta = fit_logistic(scores, scores.count(), self.settings)
            scores.unpersist()
            fitted = Ensemble(bases.get(), meta, self.scaler)
        self.train_seconds = time.monotonic() - began
        return fitted

    def register(self, registry: ModelRegistry, metrics: DataFrame, run_id: str) -> None:
        """Append an entry per model of ``metrics``: rows, settings, feature names and seconds of the fit."""
        kinds = {m: m for m in BASES} | {"stacking_ensemble": "ensemble"}
        self.ensemble
        registry.register(model_entries(
            metrics, kinds, self.train.count(), self.scaler.features, settings=self.settings.__dict__,
            train_seconds=self.train_seconds), run_id)

    def save(self, path: str) -> None:
        """The ensemble and the split that chose its test rows, for ``evaluate_stored``."""
        self.ensemble.save(self.spark, path)
        self.split.save(self.spark, f"{path}/split")

    @cached_property
    def stored(self) -> Ensemble:
        """The ensemble as it is read back from where it was stored."""
        path = save_path(self.spark, "stored-ensemble")
        self.ensemble.save(self.spark, path)
        return Ensemble.load(self.spark, path)

    def stored_base(self, name: str):
        """One base model and the scaler, read back from where they were stored."""
        path = save_path(self.spark, f"stored-{name}")
        self.scaler.save(self.spark, f"{path}/scaler")
        fitted = getattr(self, {"logistic_regression": "logistic", "random_forest": "forest",
                                "xgboost": "boosted", "isolation_forest": "isolated"}[name])
        if name != "logistic_regression":
            fitted.save(self.spark, f"{path}/model")
            model = type(fitted).load(self.spark, f"{path}/model")
        else:
            fitted.write().save(f"{path}/model")
            model = type(fitted).load(f"{path}/model")
        return model, Scaler.load(self.spark, f"{path}/scaler")

    @cached_property
    def single_scores(self) -> DataFrame:
        """(id, model, p): every raw row through each base model alone, as it is read back, written once."""
        out = None
        for name in BASES:
            model, scaler = self.stored_base(name)
            rows = scaler.apply(self.data).select("id", "x")
            if name in ("xgboost", "random_forest"):
                p, scored = model.probability(), rows
            elif name == "isolation_forest":
                p, scored = model.probability("_raw"), model.score(rows, "_raw")
            else:
                p, scored = positive(), model.transform(with_features(rows))
            one = scored.select("id", F.lit(name).alias("model"), p.alias("p"))
            out = one if out is None else out.unionByName(one)
        return materialize(out, "single-scores")

    @cached_property
    def all_scores(self) -> DataFrame:
        """Every raw row with all five scores of the stored ensemble, written once."""
        scored = self.stored.score_raw(self.data).select("id", LABEL, *BASES, "stacking_ensemble")
        return materialize(scored, "all-scores")

    @cached_property
    def test_scores(self) -> DataFrame:
        """Test rows with all five scores, written once."""
        scored = self.ensemble.score(self.test).select("id", LABEL, *BASES, "stacking_ensemble")
        return materialize(scored, "test-scores")


def with_split(raw: DataFrame, fitted: split.StratifiedSplit) -> DataFrame:
    """Raw rows with ``split`` = test / train by the points of a fitted split."""
    part = F.when(F.col("_part") == 0, "test").otherwise("train")
    return fitted.apply(raw, "_part").withColumn("split", part).drop("_part")


def evaluate_stored(spark: SparkSession, path: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics and the report by class of a stored run on its test rows, found again in the raw rows."""
    test = with_split(raw, split.StratifiedSplit.load(spark, f"{path}/split")).filter(F.col("split") == "test")
    scored = Ensemble.load(spark, path).score_raw(test).select("id", LABEL, *BASES, "stacking_ensemble")
    long = long_scores(materialize(scored, "reloaded"), [*BASES, "stacking_ensemble"])
    return ev.evaluate(long), ev.class_report(ev.confusion(long))


def long_scores(scored: DataFrame, names: list[str]) -> DataFrame:
    """(model, y, p) from one column per model, scores as they are."""
    long = scored.unpivot([LABEL], names, "model", "p")
    return long.select("model", F.col(LABEL).alias("y"), "p")


def area(scored: DataFrame, names: list[str]) -> DataFrame:
    return ev.roc_auc(long_scores(scored, names))


def boosted_importance(spark: SparkSession, model: boosting.BoostedTrees) -> DataFrame:
    """(kind, feature, value) over the split nodes.

    weight counts splits; gain and cover are means, their totals are sums.
    """
    return spark.createDataFrame(model.importance(), "kind string, feature int, value double")


def vector_rows(spark: SparkSession, model: str, kind: str, values) -> DataFrame:
    """One row per position of a fitted vector (as long as the feature list)."""
    rows = [(model, kind, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "model string, kind string, feature int, value double")


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """Largest by size, sign kept; position breaks ties."""
    return importance.orderBy(F.desc(F.abs("value")), F.asc("feature")).limit(n)


_runs: dict[tuple[str, str], TrainingRun] = {}


def shared_run(data: DataFrame, name: str) -> TrainingRun:
    """The training run of this application on the named data."""
    key = (data.sparkSession.sparkContext.applicationId, name)
    if key not in _runs:
        _runs[key] = TrainingRun(data)
    return _runs[key]


def save_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"model-{name}")
