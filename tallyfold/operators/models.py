"""Small calibrated models with pyspark.ml: fits, calibrators, choices between them, and honest tests of them."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import staged
from . import evaluation
from .windows import global_rank, guarded, last_rows_before, prior

SMALL = 1e-6


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def logistic(df: DataFrame, features: list[str], target: str, c: float = 1.0, standardised: bool = True, balanced: bool = False) -> PipelineModel:
    """L2 logistic regression; c is the inverse penalty on the sum of losses, as 1 / (c * n) on their mean."""
    rows = df.dropna(subset=[*features, target]).withColumn("label", F.col(target).cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.avg("label").alias("r")).first()
    n, r = facts["n"], facts["r"]
    if not n:
        raise ValueError("no complete rows to fit on")
    fit = LogisticRegression(regParam=1 / (c * max(n, 1)), standardization=standardised, maxIter=100, tol=1e-8)
    if balanced and 0 < r < 1:  # one class alone has nothing to be balanced against
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, 1 / (2 * r)).otherwise(1 / (2 * (1 - r))))
        fit = fit.setWeightCol("weight")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), fit]).fit(rows)


def predicted(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """`df` with the probability of class 1, complete rows only."""
    features = model.stages[0].getInputCols()
    out = model.transform(df.dropna(subset=features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Feature, coefficient per standard deviation and odds ratio, the largest first: as many rows as features."""
    features, fit = model.stages[0].getInputCols(), model.stages[1]
    sd = assembled(df, features).select(Summarizer.std(F.col("features"))).first()[0].toArray()
    rows = [(f, float(b * s)) for f, b, s in zip(features, fit.coefficients.toArray(), sd)]
    return df.sparkSession.createDataFrame(rows, "feature string, per_sd double").withColumn("odds_ratio", F.exp("per_sd")).orderBy(F.desc(F.abs("per_sd")), "feature")


def counts_model(df: DataFrame, features: list[str], count: str, most: int = 6, c: float = 1.0) -> PipelineModel:
    """Multinomial logistic regression of a count clipped to 1..most."""
    rows = df.dropna(subset=[*features, count]).withColumn("label", (F.least(F.greatest(F.col(count), F.lit(1)), F.lit(most)) - 1).cast("double"))
    n = rows.count()
    fit = LogisticRegression(family="multinomial", regParam=1 / (c * max(n, 1)), maxIter=100)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), fit]).fit(rows)


def predicted_counts(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with dist: element k is the probability of the count k + 1."""
    out = model.transform(df.dropna(subset=model.stages[0].getInputCols()))
    return out.withColumn("dist", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, least: int = 500) -> PipelineModel | None:
    """Standardised ridge regression; None below `least` rows. Spark scales the label, so the penalty carries its deviation."""
    rows = df.dropna(subset=[*features, target]).withColumn("label", F.col(target).cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.stddev_samp("label").alias("s")).first()
    if facts["n"] < least:
        return None
    fit = LinearRegression(regParam=alpha * facts["s"] / facts["n"], solver="normal", standardization=True)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), fit]).fit(rows)


def predicted_value(model: PipelineModel | None, df: DataFrame, name: str, low: float, high: float, fallback: float) -> DataFrame:
    """`df` with a clipped prediction; the fallback without a model."""
    if model is None:
        return df.withColumn(name, F.lit(fallback))
    out = model.transform(df)
    return out.withColumn(name, F.least(F.greatest(F.col("prediction"), F.lit(low)), F.lit(high))).drop("features", "prediction")


class ProbabilityOf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage: the chance of class 1, kept off 0 and 1, from a probability vector or a number."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.col(self.getInputCol())
        if df.schema[self.getInputCol()].dataType.typeName() != "double":
            p = vector_to_array(p)[1]
        return df.withColumn(self.getOutputCol(), F.least(F.greatest(p, F.lit(SMALL)), F.lit(1 - SMALL)))


def calibrator(kind: str, df: DataFrame, y: str = "y", p: str = "p", least: int = 400) -> list:
    """`none`, `platt` or `isotonic` (as none below `least` rows), fitted: stages that add `calibrated` to rows with `p`."""
    if kind == "platt":
        rows = df.dropna(subset=[p, y]).withColumn("label", F.col(y).cast("double"))
        inputs = VectorAssembler(inputCols=[p], outputCol="_platt_in")
        fit = LogisticRegression(featuresCol="_platt_in", probabilityCol="_platt_p", rawPredictionCol="_platt_r", predictionCol="_platt_c", regParam=1 / max(rows.count(), 1), standardization=False, maxIter=100, tol=1e-8)
        return [inputs, fit.fit(inputs.transform(rows)), ProbabilityOf(inputCol="_platt_p", outputCol="calibrated")]
    if kind == "isotonic" and df.count() >= least:
        model = IsotonicRegression(featuresCol=p, labelCol="_y", predictionCol="_isotonic").fit(df.withColumn("_y", F.col(y).cast("double")))
        return [model, ProbabilityOf(inputCol="_isotonic", outputCol="calibrated")]
    return [ProbabilityOf(inputCol=p, outputCol="calibrated")]


def calibrated(stages: list, df: DataFrame) -> DataFrame:
    """`df` with `calibrated`."""
    return PipelineModel(stages=stages).transform(df).select(*df.columns, "calibrated")


def choose_calibrator(df: DataFrame, order: list[str], y: str = "y", p: str = "p", least: int = 60) -> tuple[str, DataFrame]:
    """The simplest calibrator within one standard error of the best, fitted on the earlier half and scored on the later; the scores as three rows.

    Below `least` rows, or where a half has one class only, nothing can be told apart: "none", without scores.
    """
    kinds, spark = ("none", "platt", "isotonic"), df.sparkSession
    told = "calibrator string, brier double, chosen boolean"
    half = df.count() // 2
    ranked = staged(global_rank(df, order, "_rank"), "calibration")
    first, second = ranked.where(F.col("_rank") <= half).drop("_rank"), ranked.where(F.col("_rank") > half).drop("_rank")
    classes = [x.agg(F.count_distinct(y)).first()[0] for x in (first, second)] if 2 * half + 1 >= least else [0]
    if min(classes) < 2:
        return "none", spark.createDataFrame([(k, None, k == "none") for k in kinds], told)
    out = second
    for kind in kinds:
        out = calibrated(calibrator(kind, first, y, p), out).withColumn(kind, F.pow(F.col("calibrated") - F.col(y), 2)).drop("calibrated")
    facts = out.agg(*(F.avg(k).alias(k) for k in kinds), *(F.stddev_samp(F.col(a) - F.col(b)).alias(f"{a}_{b}") for a in kinds for b in kinds), F.count("*").alias("n")).first()
    best = min(kinds, key=lambda k: facts[k])
    chosen = next(k for k in kinds if facts[k] - facts[best] <= (facts[f"{k}_{best}"] or 0.0) / max(facts["n"], 1) ** 0.5)
    return chosen, spark.createDataFrame([(k, facts[k], k == chosen) for k in kinds], told)


def choose_c(train: DataFrame, check: DataFrame, features: list[str], target: str, grid=(0.003, 0.01, 0.03, 0.1, 0.3, 1.0)) -> DataFrame:
    """c, Brier score on the check rows, and which is best."""
    rows = []
    for c in grid:
        p = predicted(logistic(train, features, target, c), check)
        rows.append((c, p.agg(F.avg(F.pow(F.col("p") - F.col(target), 2))).first()[0]))
    best = min(rows, key=lambda r: r[1])[0]
    return train.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "c double, brier double, best boolean")


def candidates(n: int, trees: int = 300, rounds: tuple[int, int] = (200, 400)) -> dict:
    """Six estimators for n rows: three penalties, boosting of shallow and of deep trees, a forest."""
    leaf = max(1, min(200, n // 50))
    return {
        "logistic_strong": LogisticRegression(regParam=1 / (0.03 * n)),
        "logistic": LogisticRegression(regParam=1 / (0.1 * n)),
        "logistic_weak": LogisticRegression(regParam=1 / (1.0 * n)),
        "boosted": GBTClassifier(maxIter=rounds[0], maxDepth=3, stepSize=0.05, minInstancesPerNode=leaf, seed=7),
        "boosted_deep": GBTClassifier(maxIter=rounds[1], maxDepth=6, stepSize=0.05, minInstancesPerNode=max(1, leaf // 4), seed=7),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=leaf, seed=7),
    }


def cross_fitted(fit, rows: DataFrame, held: DataFrame, key: str, folds: int = 3) -> DataFrame:
    """`held` with p: for each fold a fit on the other folds and an isotonic calibration on the fold itself, averaged over folds.

    rows: features, label and `key`, whose hash deals the rows to folds; held: features.
    """
    dealt, out = rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds))), held
    for k in range(folds):
        model = fit.fit(dealt.where(F.col("_fold") != k))
        said = model.transform(dealt.where(F.col("_fold") == k)).select("label", vector_to_array("probability")[1].alias("_s"))
        step = IsotonicRegression(featuresCol="_s", labelCol="label", predictionCol=f"_p{k}").fit(said)
        out = step.transform(model.transform(out).withColumn("_s", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")).drop("_s")
    return out.withColumn("p", sum((F.col(f"_p{k}") for k in range(folds)), F.lit(0.0)) / folds).drop(*(f"_p{k}" for k in range(folds)))


def compare(train: DataFrame, test: DataFrame, features: list[str], target: str, key: str, trees: int = 300, rounds: tuple[int, int] = (200, 400)) -> DataFrame:
    """Candidates of several kinds fitted on the same rows and evaluated on the same others."""
    rows = assembled(train.dropna(subset=features), features).withColumn("label", F.col(target).cast("double")).cache()
    held = assembled(test.dropna(subset=features), features)
    fits, out = candidates(rows.count(), trees, rounds), None
    for name, fit in [*fits.items(), ("boosted_calibrated", fits["boosted"])]:
        if name == "boosted_calibrated":
            said = cross_fitted(fit, rows, held, key)
        else:
            said = fit.fit(rows).transform(held).withColumn("p", vector_to_array("probability")[1])
        p = said.select(F.col(target).cast("int").alias("y"), "p", F.lit(name).alias("model"))
        out = p if out is None else out.unionByName(p)
    rows.unpersist()
    return evaluation.evaluate(out, ["model"])


def ladder(train: DataFrame, test: DataFrame, rungs: dict[str, list[str]], target: str, c: float = 0.1) -> DataFrame:
    """Nested feature sets, each evaluated on the test rows; the best by skill is marked."""
    out = None
    for name, features in rungs.items():
        p = predicted(logistic(train, features, target, c), test).select(F.col(target).alias("y"), "p", F.lit(name).alias("rung"))
        out = p if out is None else out.unionByName(p)
    e = evaluation.evaluate(out, ["rung"])
    return e.withColumn("best", F.col("skill") == F.max("skill").over(Window.partitionBy()))  # a row for each rung


def rolling_origin(df: DataFrame, order: list[str], features: list[str], target: str, cuts=(0.5, 0.6, 0.7, 0.8), width: float = 0.1, least: int = 100) -> DataFrame:
    """Fits up to each cut of the time order, evaluated on the next `width`; windows under `least` rows are skipped."""
    n = df.count()
    ranked = global_rank(df, order, "_rank").cache()
    out = None
    for cut in cuts:
        past, later = ranked.where(F.col("_rank") <= int(n * cut)), ranked.where((F.col("_rank") > int(n * cut)) & (F.col("_rank") <= int(n * (cut + width))))
        if int(n * width) < least:
            continue
        p = predicted(logistic(past, features, target, 0.1), later).select(F.col(target).alias("y"), "p", F.lit(cut).alias("cut"))
        out = p if out is None else out.unionByName(p)
    if out is None:
        out = df.select(F.col(target).alias("y"), F.lit(0.0).alias("p"), F.lit(0.0).alias("cut")).where("false")
    return evaluation.evaluate(out, ["cut"])


#: Rows of a block within which columns are dealt anew, 8 bytes a feature each.
BLOCK_ROWS = 65_536


def packed_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(block, rows): complete rows dealt by hash to blocks of some BLOCK_ROWS, each packed as one row of doubles."""
    rows = df.dropna(subset=columns).select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)), F.xxhash64(*df.columns).alias("_h"))
    parts = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_h"), F.lit(parts)))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_h", "ascending"), *((f"c{k}", "ascending") for k in range(len(columns)))])
        return pa.table({"block": [key[0].as_py()], "rows": [np.stack([table.column(f"c{k}").to_numpy() for k in range(len(columns))]).tobytes()]})

    return staged(dealt.groupBy("block").applyInArrow(pack, "block long, rows binary"), "packed")


def dealt_anew(x: np.ndarray, suspects: list[int], block: int, replicate: int, part: int) -> np.ndarray:
    """A block with its suspect columns shuffled jointly among its rows; replicate 0 is the block itself."""
    if not replicate:
        return x
    out = x.copy()
    out[:, suspects] = x[np.random.default_rng([part, block, replicate]).permutation(len(x))][:, suspects]
    return out


def _summed(packed: DataFrame, width: int, replicates: int, measure) -> np.ndarray:
    """measure(features, label, block, replicate) -> array, summed over blocks: replicates x length, one job; a row for each task and replicate is shuffled."""
    length = len(measure(np.zeros((1, width - 1)), np.zeros(1), 0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, length))
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(rows.as_buffer(), np.float64).reshape(width, -1).T
                for r in range(replicates):
                    total[r] += measure(x[:, :-1], x[:, -1], block, r)
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["replicate", "v"])

    sums = packed.mapInArrow(run, "replicate int, v array<double>").groupBy("replicate").agg(F.array(*(F.sum(F.get("v", k)) for k in range(length))).alias("v"))
    out = np.zeros((replicates, length))
    for r in sums.collect():  # a row for each replicate
        out[r["replicate"]] = r["v"]
    return out


def permuted_fits(packed: DataFrame, width: int, suspects: list[int], replicates: int, c: float, tol: float = 1e-10, most: int = 50) -> np.ndarray:
    """Coefficients (intercept last) of the logistic fits with the suspects dealt anew, replicates x width, all at once.

    Newton's method: one job a step, in which every block adds its gradient and Hessian for all replicates. The penalty is that of `logistic`, on
    coefficients per standard deviation, which dealing anew leaves as it is.
    """
    facts = _summed(packed, width, 1, lambda x, y, *_: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))[0]
    n, mean = facts[0], facts[1:width] / facts[0]
    sd = np.sqrt(np.maximum(facts[width:] - n * mean * mean, 0) / max(n - 1, 1))
    sd[sd == 0] = 1.0
    pairs, penalty = np.triu_indices(width), np.append(np.full(width - 1, 1 / c), 0.0)
    beta = np.zeros((replicates, width))
    for _ in range(most):
        now = beta

        def step(x, y, block, r):
            z = np.column_stack([(dealt_anew(x, suspects, block, r, 0) - mean) / sd, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(z @ now[r], -500, 500)))
            return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z)[pairs]])

        sums = _summed(packed, width, replicates, step)
        hessian = np.zeros((replicates, width, width))
        hessian[:, pairs[0], pairs[1]] = hessian[:, pairs[1], pairs[0]] = sums[:, width:]
        hessian += np.diag(penalty) + 1e-12 * np.eye(width)
        move = np.linalg.solve(hessian, (sums[:, :width] - penalty * beta)[:, :, None])[:, :, 0]
        beta = beta + move * np.minimum(1, 5 / np.maximum(np.abs(move).max(axis=1), 1e-300))[:, None]
        if np.abs(move).max() < tol:
            break
    slopes = beta[:, :-1] / sd
    return np.column_stack([slopes, beta[:, -1] - slopes @ mean])


def permutation_test(train: DataFrame, test: DataFrame, features: list[str], suspects: list[str], target: str, rounds: int = 200, c: float = 0.03) -> DataFrame:
    """How often refits with the suspect columns dealt anew do as well as the real ones: p = (as good + 1) / (rounds + 1).

    Suspects are shuffled jointly among the rows of random blocks, in the training and in the test rows; all refits advance together, so there are as many
    jobs as Newton steps, whatever `rounds` is. Skill is the Brier skill of uncalibrated predictions.
    """
    width, at, columns = len(features) + 1, [features.index(s) for s in suspects], [*features, target]
    beta = permuted_fits(packed_blocks(train, columns), width, at, rounds + 1, c)

    def score(x, y, block, r):
        p = 1 / (1 + np.exp(-np.clip(dealt_anew(x, at, block, r, 1) @ beta[r, :-1] + beta[r, -1], -500, 500)))
        return np.array([len(y), y.sum(), ((p - y) ** 2).sum()])

    n, hits, loss = _summed(packed_blocks(test, columns), width, rounds + 1, score).T
    rate = hits / n
    skill = 1 - (loss / n) / (rate * (1 - rate))
    as_good = int((skill[1:] >= skill[0]).sum())
    row = (float(skill[0]), float(skill[1:].mean()), float(skill[1:].std()), rounds, (as_good + 1) / (rounds + 1))
    return train.sparkSession.createDataFrame([row], "skill double, shuffled double, shuffled_sd double, rounds int, p double")


def rate_features(targets: tuple[str, ...], windows: tuple[int, ...] = (150, 600), shared: tuple[str, ...] = ("platoon_edge", "is_home", "context_factor")) -> dict[str, list[str]]:
    """The columns that each target's model sees: its own rates over windows and career, what the opponent allows, their match, and the shared ones."""
    return {t: [*(f"{t}_rate_{w}" for w in windows), f"{t}_rate_career", f"{t}_allowed", f"{t}_matchup", *shared] for t in targets}


@dataclasses.dataclass
class Calibrated:
    """A fitted chain from features to a calibrated chance, with what it was chosen by and its test figures; stored and loaded as a folder."""

    chain: PipelineModel
    kind: str
    y: str
    features: list[str]
    c: float
    figures: dict = dataclasses.field(default_factory=dict)

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """`df` with the calibrated chance, complete rows only; nothing is fitted."""
        return self.chain.transform(df.dropna(subset=self.features)).select(*df.columns, F.col("calibrated").alias(name))

    def save(self, spark: SparkSession, path: str) -> None:
        """The whole chain, calibrator included, and one row of facts."""
        self.chain.write().overwrite().save(f"{path}/chain")
        row = [(self.kind, self.y, self.features, self.c, {k: float(v) for k, v in self.figures.items() if v is not None})]
        spark.createDataFrame(row, "kind string, y string, features array<string>, c double, figures map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibrated:
        f = spark.read.parquet(f"{path}/facts").first()
        return cls(PipelineModel.load(f"{path}/chain"), f["kind"], f["y"], list(f["features"]), f["c"], dict(f["figures"]))


def fit_calibrated(train: DataFrame, check: DataFrame, features: list[str], target: str, order: list[str], c: float | None = 0.03) -> Calibrated:
    """A model from `train`; the penalty (c None) and the calibrator are chosen on `check` alone, then the chosen one is fitted on all of it. "none" is a fair winner."""
    if c is None:
        c = choose_c(train, check, features, target).where("best").first()["c"]
    raw = [*logistic(train, features, target, c).stages, ProbabilityOf(inputCol="probability", outputCol="_raw")]
    rows = PipelineModel(stages=raw).transform(check.dropna(subset=features)).select(*order, F.col(target).alias("_y"), "_raw")
    kind = "none" if check.isEmpty() else choose_calibrator(rows, order, "_y", "_raw")[0]
    return Calibrated(PipelineModel(stages=[*raw, *calibrator(kind, rows, "_y", "_raw")]), kind, target, features, c)


def size_projection(df: DataFrame, features: list[str], count: str, split: str, least: tuple[int, int, int] = (500, 300, 100), most: int = 6) -> tuple[PipelineModel, DataFrame] | None:
    """A count model from complete rows where `split` is 0, and its distributions for rows where it is 1; None with too few rows."""
    rows = df.dropna(subset=[*features, count])
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(split) == 0).alias("a"), F.count_if(F.col(split) == 1).alias("b")).first()
    if n["n"] < least[0] or n["a"] < least[1] or n["b"] < least[2]:
        return None
    model = counts_model(rows.where(F.col(split) == 0), features, count, most)
    return model, predicted_counts(model, rows.where(F.col(split) == 1))


#: What a unit's size is told from, and its smallest and largest value.
SIZE_FEATURES = ["slot", "slot_sq", "is_home", "own_mean", "team_mean"]
SMALLEST_SIZE, LARGEST_SIZE = 1, 6


def size_frame(df: DataFrame, entity: str, team: str, day: str, unit: str, count: str, slot: str, starter: str, home: str) -> DataFrame:
    """`df` with SIZE_FEATURES and size, ready for `counts_model`: complete rows of starters in slots 1 to 9.

    History comes from all rows, before the others leave: own_mean over the entity's last 20 units (three at least), team_mean over
    the team's last 50 rows of earlier days (five at least; the own mean where there are fewer).
    """
    own = df.withColumn("own_mean", guarded(F.col(count), F.avg, prior([entity], [day, unit], 20), 3))
    seen = last_rows_before(own, [team], [day], [unit, entity], count, 50, 5, "team_mean")
    kept = seen.where((F.col(starter) == 1) & F.col(slot).between(1, 9))
    size = F.least(F.greatest(F.col(count), F.lit(SMALLEST_SIZE)), F.lit(LARGEST_SIZE)).cast("int")
    facts = {"slot": F.col(slot).cast("double"), "slot_sq": F.pow(F.col(slot).cast("double"), 2), "is_home": F.col(home).cast("double"), "team_mean": F.coalesce("team_mean", "own_mean"), "size": size}
    return kept.withColumns(facts).dropna(subset=[*SIZE_FEATURES, "size"])


def projected_sizes(history: DataFrame, rows: DataFrame, entity: str, count: str, slot: str, least: int = 500, enough: int = 8, most: int = 6) -> DataFrame:
    """`rows` with size_dist: element k is the chance of k + 1 trials.

    Where the slot is known a model of slot, its square and the entity's mean size says so (trained on history rows with
    a slot, `least` at least); elsewhere, and without a model, the entity's own histogram does, or with fewer than
    `enough` units that of everyone.
    """
    clipped = F.least(F.greatest(F.col(count), F.lit(1)), F.lit(most)).cast("int")

    def shares(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array(*(F.avg((clipped == k).cast("double")) for k in range(1, most + 1))).alias(name), F.count("*").alias(f"{name}_n"), F.avg(count).alias(f"{name}_mean"))

    everyone = shares(history, [], "_all")
    own = shares(history, [entity], "_own")
    out = rows.join(own, entity, "left").crossJoin(F.broadcast(everyone))  # one row for everyone
    fallback = F.when(F.col("_own_n") >= enough, F.col("_own")).otherwise(F.col("_all"))
    out = out.withColumns({"_fallback": fallback, "_mean": F.coalesce("_own_mean", "_all_mean"), "_slot": F.col(slot).cast("double"), "_slot_sq": F.pow(F.col(slot).cast("double"), 2)})
    known = history.join(own.select(entity, F.col("_own_mean").alias("_mean")), entity).withColumns({"_slot": F.col(slot).cast("double"), "_slot_sq": F.pow(F.col(slot).cast("double"), 2)}).dropna(subset=["_slot"])
    extra = ["_own", "_own_n", "_own_mean", "_all", "_all_n", "_all_mean", "_fallback", "_mean", "_slot", "_slot_sq"]
    if known.limit(least).count() < least:
        return out.withColumn("size_dist", F.col("_fallback")).drop(*extra)
    model = counts_model(known, ["_slot", "_slot_sq", "_mean"], count, most)
    told = predicted_counts(model, out.where("_slot is not null")).withColumnRenamed("dist", "size_dist")
    rest = out.where("_slot is null").withColumn("size_dist", F.col("_fallback"))
    return told.unionByName(rest).drop(*extra)
