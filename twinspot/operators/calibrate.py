"""A fitted calibrator: logistic regression over named features, with an isotonic curve behind it if asked for.

Fits are Spark ML's. A calibrator is stored as one line of JSON in a folder that Spark writes and reads; loading it checks its kind, its version and that its
features are those in use, in their order, because coefficients go by place.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from . import fusion

KIND, VERSION = "logistic", 1
ISOTONIC_NOTE = "isotonic"


@dataclass(frozen=True)
class Calibrator:
    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    #: Knots (x, y) of the curve behind the logistic function; none if empty.
    knots: tuple[tuple[float, float], ...] = ()
    fitted_on: str = ""
    metrics: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.coef) != len(self.features):
            raise ValueError(f"{len(self.coef)} coefficients for {len(self.features)} features")
        x, y = [k[0] for k in self.knots], [k[1] for k in self.knots]
        if self.knots and (len(x) < 2 or x != sorted(set(x)) or y != sorted(y) or not all(0 <= v <= 1 for v in y)):
            raise ValueError("knots must rise in x, not fall in y, and lie within 0 and 1")


def fit(rows: DataFrame, features: list[str], label: str, isotonic: bool = False, fitted_on: str = "", penalty: float = 0.0) -> Calibrator:
    """Fit to ``rows`` with f_<name> for each feature and a label of 0 or 1."""
    columns = [f"f_{n}" for n in features]
    known = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label")).dropna()
    given = VectorAssembler(inputCols=columns, outputCol="features").transform(known).select("features", "label")
    model = LogisticRegression(maxIter=200, tol=1e-10, regParam=penalty).fit(given)
    coef, intercept = tuple(float(c) for c in model.coefficients), float(model.intercept)
    scored = model.transform(given).select("label", vector_to_array("probability")[1].alias("p"))
    knots: tuple[tuple[float, float], ...] = ()
    if isotonic:
        curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(scored)
        found = sorted({float(x): float(y) for x, y in zip(curve.boundaries, curve.predictions, strict=True)}.items())
        knots = tuple(found) if len(found) > 1 else ()
    loss = scored.agg(F.count("*").alias("rows"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.avg(((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double")).alias("accuracy")).first()
    return Calibrator(tuple(features), coef, intercept, knots, fitted_on, {k: float(loss[k]) for k in ("rows", "brier", "accuracy")})


def save(spark: SparkSession, calibrator: Calibrator, folder: str) -> None:
    line = json.dumps({"kind": KIND, "format_version": VERSION, **asdict(calibrator)})
    spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.text(folder)


def load(spark: SparkSession, folder: str, features: list[str]) -> Calibrator:
    """Read what ``save`` wrote. Anything else, or other features than these in this order, is an error."""
    lines = [r["value"] for r in spark.read.text(folder).limit(2).collect()]
    if len(lines) != 1:
        raise ValueError(f"{folder} holds {len(lines) or 'no'} calibrators")
    held = json.loads(lines[0])
    if not isinstance(held, dict) or held.get("kind") != KIND or held.get("format_version") != VERSION:
        raise ValueError(f"{folder} holds a calibrator of another kind or version")
    if missing := [k for k in ("features", "coef", "intercept") if k not in held]:
        raise ValueError(f"the calibrator lacks {', '.join(missing)}")
    if list(held["features"]) != list(features):
        added, gone = sorted(set(features) - set(held["features"])), sorted(set(held["features"]) - set(features))
        raise ValueError(f"fitted with other features: added {added}, gone {gone}" if added or gone else "fitted with the same features in another order")
    return Calibrator(
        tuple(held["features"]), tuple(float(c) for c in held["coef"]), float(held["intercept"]), tuple((float(x), float(y)) for x, y in held.get("knots", ())),
        str(held.get("fitted_on", "")), {k: float(v) for k, v in held.get("metrics", {}).items()},
    )


def predicted(rows: DataFrame, calibrator: Calibrator) -> DataFrame:
    """``rows`` with logit, confidence, verdict, calibrated (true) and the note that a curve asks for."""
    out = fusion.scored(rows, dict(zip(calibrator.features, calibrator.coef, strict=True)), calibrator.intercept)
    if calibrator.knots:
        out = out.withColumn("confidence", fusion.isotonic(F.col("confidence"), list(calibrator.knots)))
        out = out.withColumn("verdict", X.band(F.col("confidence")))
    return out.withColumn("calibrated", F.lit(True)).withColumn("note", F.lit(ISOTONIC_NOTE if calibrator.knots else None).cast("string"))
