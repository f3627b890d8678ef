"""The relevance task: which input columns matter for a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import fold, is_test
from ..operators import models as MD
from ..operators.clean import scaling_stats, standardize
from ..operators.knockoff import simulate_knockoffs
from ..operators.predict import with_key
from ..operators.quantiles import exact_quantiles
from ..operators.ranking import relevance_scores
from ..operators.shapley import attribution_table, shapley_values
from ..operators.tree_shapley import tree_shapley
from ..session import cut

TEST_SHARE = 0.33

# fixed values: option names, defaults and what they may be
DEFAULTS = {
    "pred_class": "regression", "score_func": None, "metric_func": None, "base_models": None, "n_trials": 100,
    "boosted_round": 100, "max_depth": 30, "rf_n_estimators": 1500, "bagging_estimators": 100, "n_neighbors": 30,
    "cv_splits": 3, "ensemble_bagging_estimators": 50, "ensemble_n_trials": 50, "attr_algos": None, "fdr": 0.1,
    "fstats": None, "knockoff_runs": 20, "seed": 1, "keys": None, "permutations": 16, "threshold": None, "zero_selected": True,
}
POSITIVE = ["n_trials", "boosted_round", "max_depth", "rf_n_estimators", "bagging_estimators", "n_neighbors", "cv_splits",
            "ensemble_bagging_estimators", "ensemble_n_trials", "knockoff_runs"]


def check_options(options: dict) -> dict:
    o = dict(options)
    if "list_base_models" in o:
        o["base_models"] = o.pop("list_base_models")
    unknown = set(o) - set(DEFAULTS) - {"xgb_objective", "lgbm_objective"}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    o = {**DEFAULTS, **o}
    if o["pred_class"] not in ("regression", "classification"):
        raise ValueError("pred_class is regression or classification")
    for name in POSITIVE:
        if int(o[name]) < 1:
            raise ValueError(f"{name} has to be at least 1")
    if not 0 < o["fdr"] < 1:
        raise ValueError("fdr lies between 0 and 1")
    bad = set(o["base_models"] or []) - set(MD.MODEL_NAMES)
    if bad:
        raise ValueError(f"unknown base models: {sorted(bad)}")
    o["attr_algos"] = [a.lower() for a in (o["attr_algos"] or ["shap", "knockoffs"])]
    return o


def prepare(df: DataFrame, inputs: list[str], target: str, o: dict) -> DataFrame:
    """Split, fold and scale by the statistics of the training rows; stored once for all models."""
    taken = {"key", "is_test", "fold", "__y"} & set(inputs)
    if taken:
        raise ValueError(f"rename the input columns {sorted(taken)}: these names are used for the split")
    keyed = with_key(df.select(*dict.fromkeys([*(o["keys"] or []), *inputs, target])), o["keys"])
    keyed = keyed.select(F.col("__key").alias("key"), *inputs, target)
    rows = keyed.withColumns({"is_test": is_test("key", TEST_SHARE, o["seed"]), "fold": fold("key", o["cv_splits"], o["seed"])})
    rows = rows.dropna("any", subset=[*inputs, target])
    scaled = standardize(rows, inputs, scaling_stats(rows.where(~F.col("is_test")), inputs))
    return cut(scaled.select("key", "is_test", "fold", F.col(target).cast("double").alias("__y"), *inputs), "relevance")


def model_attributions(rows: DataFrame, inputs: list[str], models: list[MD.FittedModel], o: dict) -> DataFrame:
    """``method, feature, score``: mean absolute Shapley value per model, on the scaled inputs the models saw; those of trees come from their paths."""
    d, out = len(inputs), None
    wide = rows.select(*[F.col("x")[i].alias(c) for i, c in enumerate(inputs)])
    medians = None
    for m in models:
        if m.model is not None:
            phi, _ = tree_shapley(rows.select("key", "x"), m.model, m.explained())
            part = attribution_table(phi, inputs, f"{m.name}_shap")
            out = part if out is None else out.unionByName(part)
            continue
        medians = medians or exact_quantiles(wide, inputs, [0.5])
        base = [medians[c][0] for c in inputs]
        phi = shapley_values(rows.select("key", "x"), m.predict, d, base, o["permutations"], o["seed"])
        part = attribution_table(phi, inputs, f"{m.name}_shap")
        out = part if out is None else out.unionByName(part)
    return out


def relevance(df: DataFrame, input_columns: list[str], target: str, options: dict | None = None) -> dict:
    """Scores of the models and relevance tables ``feature, score`` from models and from knockoffs."""
    o = check_options(options or {})
    rows = prepare(df, input_columns, target, o)
    result = {"base_model_scores": None, "score": None, "xai_model": None, "xai_non_model": None}
    if "knockoffs" in o["attr_algos"] or not o["base_models"]:
        flat = rows.withColumnRenamed("__y", target)
        _, scores = simulate_knockoffs(flat, input_columns, target, o["fdr"], o["fstats"], o["knockoff_runs"], o["zero_selected"])
        result["xai_non_model"] = cut(scores, "knockoffs")
    if o["base_models"]:
        classification = o["pred_class"] == "classification"
        lim = MD.Limits(o["n_trials"], o["boosted_round"], o["max_depth"], o["rf_n_estimators"], o["bagging_estimators"],
                        o["n_neighbors"], o["cv_splits"], o["seed"])
        data = cut(MD.feature_rows(rows, input_columns, "__y"), "features")
        models = [MD.fit_base(data, name, lim, classification, o["score_func"], o["metric_func"]) for name in o["base_models"]]
        result["base_model_scores"] = {m.name: m.scores for m in models}
        chosen = models if o["threshold"] is None else MD.select_models(models, o["threshold"]) or models
        upper = MD.Limits(**{**lim.__dict__, "n_trials": o["ensemble_n_trials"], "bagging_estimators": o["ensemble_bagging_estimators"]})
        result["score"] = MD.fit_stack(data, chosen, upper, o["metric_func"]).scores
        if "shap" in o["attr_algos"]:
            result["xai_model"] = cut(relevance_scores(model_attributions(data, input_columns, models, o)), "attributions")
    return result
