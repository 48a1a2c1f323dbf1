"""Fitted models as tables."""

import datetime
import decimal
import json
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from isoplane.plans.gp import Solution
from isoplane.plans.models import Model
from isoplane.spec import AnalysisSpec, KernelConfig


#: Category values that JSON has no form for, by name: how to write and how to read them.
TYPED = {
    "timestamp": (datetime.datetime, datetime.datetime.isoformat, datetime.datetime.fromisoformat),
    "date": (datetime.date, datetime.date.isoformat, datetime.date.fromisoformat),
    "decimal": (decimal.Decimal, str, decimal.Decimal),
}


def _typed(value):
    """JSON form of a value of another type."""
    for name, (kind, write, _) in TYPED.items():
        if isinstance(value, kind):
            return {"type": name, "value": write(value)}
    raise TypeError(f"category values of type {type(value).__name__} cannot be stored")


def _untyped(found: dict):
    return TYPED[found["type"]][2](found["value"]) if set(found) == {"type", "value"} and found["type"] in TYPED else found


class ModelStore:
    """The latest replicate and row model of one data set, as parquet under ``root``.

    Every save goes to a folder of its own, which a row appended last to the table of
    versions makes the current one: readers see a whole model or the one before it.

    ``dataset`` tags the data the models belong to: under a new tag nothing is
    stored yet, so models of earlier data are never picked up.
    """

    def __init__(self, root: str, dataset: str):
        self.path = f"{root.rstrip('/')}/dataset={dataset}"

    def _table(self, mode, name):
        return f"{self.path}/mode={mode}/{name}"

    def save(self, model: Model) -> None:
        """Make this the current model of its mode."""
        spark, s = model.conditions.sparkSession, model.solution
        grow = s.grow if s.grow is not None else np.zeros((len(s.points), 0))
        noise = s.noise if s.noise is not None else [None] * len(s.points)
        support = [(i, x.tolist(), float(w), a.tolist(), b.tolist(), None if d is None else float(d))
                   for i, (x, w, a, b, d) in enumerate(zip(s.points, s.weights, s.shrink, grow, noise))]
        meta = {"spec": asdict(model.spec), "kernel": asdict(model.kernel), "scalers": model.scalers,
                "levels": model.levels, "combos": model.combos, "method": model.method,
                "constant": model.constant, "y_mean": s.y_mean, "y_scale": s.y_scale, "lml": s.lml,
                "jitter": s.jitter, "sparse": s.grow is not None, "iterative": s.noise is not None}
        mode, version = model.spec.mode, f"version={uuid.uuid4().hex}"
        model.conditions.write.parquet(self._table(mode, f"{version}/conditions"))
        spark.createDataFrame(support, "i int, x array<double>, w double, shrink array<double>, "
                              "grow array<double>, noise double").write.parquet(self._table(mode, f"{version}/support"))
        spark.createDataFrame([(json.dumps(meta, default=_typed),)], "meta string").write.parquet(
            self._table(mode, f"{version}/meta"))
        spark.createDataFrame([(version,)], "version string").coalesce(1).withColumn(
            "saved", F.current_timestamp()).write.mode("append").parquet(self._table(mode, "versions"))

    def load(self, spark: SparkSession, mode: str) -> Model:
        """The stored model of a mode; raises when there is none for this data set."""
        try:
            versions = spark.read.parquet(self._table(mode, "versions"))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            raise ValueError(f"no {mode} model stored; fit one first") from error
        version = versions.orderBy(F.desc("saved"), "version").first().version
        meta = json.loads(spark.read.parquet(self._table(mode, f"{version}/meta")).first().meta, object_hook=_untyped)
        spec = AnalysisSpec(**{**meta["spec"], "dropped": tuple(map(tuple, meta["spec"]["dropped"]))})
        kernel = KernelConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["kernel"].items()})
        rows = sorted(spark.read.parquet(self._table(mode, f"{version}/support")).collect(), key=lambda r: r.i)
        points = np.array([r.x for r in rows])
        solution = Solution(points, np.array([r.w for r in rows]), np.array([r.shrink for r in rows]),
                            np.array([r.grow for r in rows]) if meta["sparse"] else None,
                            kernel.params(points.shape[1]), meta["y_mean"], meta["y_scale"], meta["lml"],
                            meta["jitter"], np.array([r.noise for r in rows]) if meta.get("iterative") else None)
        return Model(spec, kernel, solution, {k: tuple(v) for k, v in meta["scalers"].items()},
                     meta["levels"], meta["combos"], spark.read.parquet(self._table(mode, f"{version}/conditions")),
                     meta["method"], meta["constant"])
