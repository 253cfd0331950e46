"""Estimators of pyspark.ml: ``fit`` a table, then ``transform`` tables; with Params, copies, and save and load, so
that pipelines and tuners can use them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import fields, replace

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.glm import Response, family
from ridgeline.operators.features import FeatureFrame, dense
from ridgeline.plans.cv import cv_grpnet
from ridgeline.plans.diagnostic import mean_response
from ridgeline.plans.path import Options, PathResult, grpnet

FAMILIES = ("gaussian", "binomial", "poisson", "multigaussian", "multinomial")


class _GroupElasticNetParams(Params):
    """What both the estimator and its model hold. ``lmda_idx`` says which value of the path is used, by cv_grpnet
    always the best one."""

    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "response column, or K of them", TypeConverters.toListString)
    solver = Param(Params._dummy(), "solver", "grpnet or cv_grpnet", TypeConverters.toString)
    family_name = Param(Params._dummy(), "family_name", "family of the response", TypeConverters.toString)
    link = Param(Params._dummy(), "link", "logit or probit, for binomial responses", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "weight column, empty for none", TypeConverters.toString)
    groups = Param(Params._dummy(), "groups", "first feature of each group, empty for one group each", TypeConverters.toListInt)
    key = Param(Params._dummy(), "key", "column that deals rows to folds", TypeConverters.toString)
    n_folds = Param(Params._dummy(), "n_folds", "folds of cv_grpnet", TypeConverters.toInt)
    lmda_idx = Param(Params._dummy(), "lmda_idx", "value of the path", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "share of the group lasso penalty", TypeConverters.toFloat)
    lmda_path = Param(Params._dummy(), "lmda_path", "values of lambda, empty for a path from the data", TypeConverters.toListFloat)
    lmda_path_size = Param(Params._dummy(), "lmda_path_size", "values of a path from the data", TypeConverters.toInt)
    min_ratio = Param(Params._dummy(), "min_ratio", "last over first value", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "whether to fit one", TypeConverters.toBoolean)
    early_exit = Param(Params._dummy(), "early_exit", "whether a path may end early", TypeConverters.toBoolean)
    _OPTIONS = ("alpha", "lmda_path", "lmda_path_size", "min_ratio", "intercept", "early_exit")

    def _response(self) -> Response:
        more = {"link": self.getOrDefault("link")} if self.getOrDefault("family_name") == "binomial" else {}
        return Response(family(self.getOrDefault("family_name"), **more), tuple(self.getOrDefault("label")), self.getOrDefault("weight") or None)

    def frame(self, df: DataFrame) -> FeatureFrame:
        own = getattr(self, "expressions", {})
        base = dense(df, [(n, own[n]) if n in own else n for n in self.getOrDefault("features")])
        return FeatureFrame(base.df, base.features, tuple(self.getOrDefault("groups")) or None)


class GroupElasticNet(Estimator, _GroupElasticNetParams, DefaultParamsReadable, DefaultParamsWritable):
    """``solver`` is grpnet (``lmda_idx`` of the path is used, the last by default) or cv_grpnet (the best value, by
    folds over the column ``key``). ``label`` names one column, or K for multi-response families.

    ``options`` gives first values of the Params of its name, and everything else that a fit may be told; those, and
    features that are expressions, are no Params: they live with the object and its copies but are not saved."""

    def __init__(self, features: Sequence[str | tuple[str, Column]] = (), label: str | Sequence[str] = "label", solver: str = "grpnet", family_name: str = "gaussian", weight: str | None = None, groups: Sequence[int] | None = None, key: str | None = None, n_folds: int = 5, options: Options | None = None, lmda_idx: int = -1, link: str = "logit"):
        super().__init__()
        if family_name not in FAMILIES:
            raise ValueError(f"family must be one of {FAMILIES}")
        if solver not in ("grpnet", "cv_grpnet"):
            raise ValueError(f"unknown solver {solver!r}")
        self.expressions = {f[0]: f[1] for f in features if not isinstance(f, str)}
        self.options = options or (Options(min_ratio=1e-1, early_exit=False) if solver == "cv_grpnet" else Options())
        o = self.options
        self._setDefault(
            features=[f if isinstance(f, str) else f[0] for f in features], label=[label] if isinstance(label, str) else list(label), solver=solver, family_name=family_name, link=link, weight=weight or "", groups=list(groups or []),
            key=key or "", n_folds=n_folds, lmda_idx=lmda_idx, alpha=float(o.alpha), lmda_path=[] if o.lmda_path is None else [float(x) for x in o.lmda_path], lmda_path_size=o.lmda_path_size, min_ratio=float(o.min_ratio), intercept=o.intercept, early_exit=o.early_exit,
        )

    def _options(self) -> Options:
        own = {k: self.getOrDefault(k) for k in self._OPTIONS}
        return replace(self.options, **own | {"lmda_path": own["lmda_path"] or None})

    def _fit(self, dataset: DataFrame) -> GroupElasticNetModel:
        response, frame, options = self._response(), self.frame(dataset), self._options()
        if self.getOrDefault("solver") == "cv_grpnet":
            path, at = cv_grpnet(frame, response, self.getOrDefault("key"), self.getOrDefault("n_folds"), options).fit(), -1
        else:
            path, at = grpnet(frame, response, options), self.getOrDefault("lmda_idx")
            if path.error:
                raise RuntimeError(f"the path ended early: {path.error}")
        return self._copyValues(GroupElasticNetModel(path, self.expressions))._set(lmda_idx=at)


class _ModelWriter(MLWriter):
    def __init__(self, instance: GroupElasticNetModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        if self.instance.expressions:
            raise ValueError("features that are expressions can't be saved; add them to the table as columns")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        fit = self.instance.path
        row = {f.name: np.asarray(v).tolist() if isinstance(v := getattr(fit, f.name), np.ndarray) else v for f in fields(fit) if f.name not in ("duals", "timings", "grads")}
        self.sparkSession.createDataFrame([(json.dumps(row),)], "fit string").coalesce(1).write.parquet(f"{path}/fit")


class _ModelReader(MLReader):
    def load(self, path: str) -> GroupElasticNetModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        row = json.loads(self.sparkSession.read.parquet(f"{path}/fit").first()["fit"])
        arrays = {k: np.array(row[k], float) for k in ("lmdas", "betas", "intercepts", "devs", "penalty")}
        model = GroupElasticNetModel(PathResult(**row | arrays))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class GroupElasticNetModel(Model, _GroupElasticNetParams, MLReadable, MLWritable):
    def __init__(self, path: PathResult, expressions: dict[str, Column] | None = None):
        super().__init__()
        self.path, self.expressions = path, expressions or {}

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    @property
    def at(self) -> int:
        return self.getOrDefault("lmda_idx")

    @property
    def coef_(self) -> np.ndarray:
        return self.path.betas[self.at]

    @property
    def intercept_(self) -> np.ndarray:
        return self.path.intercepts[self.at]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with mean_0 ...: class shares, or means of the response."""
        means = mean_response(self.frame(df), self._response(), self.path, self.at, *df.columns)
        K = self.path.classes
        out = means.select(*df.columns, *(F.col(f"mu_{k}").alias(f"mean_{k}") for k in range(K)))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the likeliest class, 0 or 1 at one half, or the mean (an array if several)."""
        probs = self.predict_proba(dataset)
        means = [F.col(f"mean_{k}") for k in range(self.path.classes)]
        if self.getOrDefault("family_name") == "multinomial":
            found = F.array_position(F.array(*means), F.greatest(*means)).cast("int") - 1
        elif self.getOrDefault("family_name") == "binomial":
            found = (means[0] >= 0.5).cast("int")
        else:
            found = means[0] if len(means) == 1 else F.array(*means)
        return probs.withColumn("prediction", found).drop(*(f"mean_{k}" for k in range(self.path.classes)))

    def score(self, df: DataFrame) -> float:
        """R squared of the means, within [0, 1], over all responses."""
        probs = self.predict_proba(df)
        terms = [(F.col(y).cast("double"), F.col(f"mean_{k}")) for k, y in enumerate(self.getOrDefault("label"))]
        row = probs.agg(*(x for k, (y, m) in enumerate(terms) for x in (F.sum((y - m) ** 2).alias(f"r{k}"), F.var_pop(y).alias(f"v{k}"), F.count(y).alias(f"n{k}")))).first()
        total = sum(row[f"v{k}"] * row[f"n{k}"] for k in range(len(terms)))
        return float(np.clip(1 - sum(row[f"r{k}"] for k in range(len(terms))) / total, 0, 1)) if total else 0.0
