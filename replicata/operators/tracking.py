"""The model registry as a table of documents: saving, fetching, exporting, versions (REG3, REG7, REG9, SRT3), and search over hyperparameters (HPO4)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "model_uuid string, collection string, dataset_key string, document string, saved_at timestamp_ntz"


def save_model(spark: SparkSession, path: str, collection: str, document: dict) -> None:
    """REG7: appends a model's document; ``model_uuid`` is its key, a later document of the same key replaces it for readers."""
    if not document.get("model_uuid"):
        raise ValueError("a document needs a model_uuid")
    row = spark.createDataFrame([(document["model_uuid"], collection, document.get("dataset_key"), json.dumps(document))], "model_uuid string, collection string, dataset_key string, document string")
    row.withColumn("saved_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(path)


def latest(documents: DataFrame) -> DataFrame:
    """The newest document of every collection and model (ties: the larger text); a partial aggregate, however often a model was saved."""
    newest = F.max(F.struct("saved_at", "document", "dataset_key")).alias("m")
    return documents.groupBy("collection", "model_uuid").agg(newest).select("model_uuid", "collection", "m.dataset_key", "m.document", "m.saved_at")


def by_uuid(documents: DataFrame, uuids: list[str], collections: list[str] | None = None) -> DataFrame:
    """REG7: the newest documents of models, in all collections or some."""
    d = documents.filter(F.col("model_uuid").isin(uuids))
    return latest(d if collections is None else d.filter(F.col("collection").isin(collections)))


def collection_of(documents: DataFrame, uuid: str) -> str:
    """REG7: the collection that holds a model (the first by name)."""
    r = documents.filter(F.col("model_uuid") == uuid).agg(F.min("collection")).first()
    if r[0] is None:
        raise ValueError(f"no collection holds {uuid}")
    return r[0]


def export_model(documents: DataFrame, uuid: str, path: str) -> None:
    """REG7: a model's document as JSON below ``path``."""
    one = by_uuid(documents, [uuid])
    if one.isEmpty():
        raise ValueError(f"unknown model {uuid}")
    one.select("document").write.mode("errorifexists").text(path)


def training_table(documents: DataFrame, metrics: list[str], subsets: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """REG3: one row per model with ``<subset>_<metric>`` from its document's ``training_metrics``: a list of objects with ``subset`` and the metrics."""
    kind = "array<struct<subset:string," + ",".join(f"{m}:double" for m in metrics) + ">>"
    m = F.from_json(F.get_json_object("document", "$.training_metrics"), kind)
    first = lambda s: F.get(F.filter(m, lambda x: x["subset"] == s), F.lit(0))
    return documents.select("model_uuid", "collection", "dataset_key", *[first(s)[x].alias(f"{s}_{x}") for s in subsets for x in metrics])


def top_models(perf: DataFrame, metric: str, n: int, how: str = "max", identifier: str = "model_uuid") -> DataFrame:
    """SRT3, SRT6: the ``n`` best rows by a metric, which may stand under its own or its ``best_`` name; missing metrics are left out, ties go to the smaller identifier."""
    name = metric if metric in perf.columns else f"best_{metric}"
    c = F.col(name)
    return perf.filter(c.isNotNull() & ~F.isnan(c)).orderBy(c.desc() if how == "max" else c.asc(), identifier).limit(n)


def compatible(version: Column, groups: list[list[str]], running: str) -> Column:
    """REG9: whether a model's version (``major.minor...``) belongs to the group of versions that the running one belongs to; null for null."""
    short = lambda v: ".".join(v.split(".")[:2])
    mine = next((g for g in groups if short(running) in {short(v) for v in g}), [running])
    return F.when(version.isNotNull(), F.substring_index(version, ".", 2).isin(sorted({short(v) for v in mine})))


def patch_dataset_key(documents: DataFrame, old: str, new: str) -> DataFrame:
    """REG9: documents of a dataset under its new key, in the column and inside the text; others stay as they are."""
    hit = F.coalesce(F.col("dataset_key") == old, F.lit(False))
    text = F.replace("document", F.lit(json.dumps(old)), F.lit(json.dumps(new)))
    return documents.withColumns({"document": F.when(hit, text).otherwise(F.col("document")), "dataset_key": F.when(hit, F.lit(new)).otherwise(F.col("dataset_key"))})


# Search over hyperparameters


def loss_of(prediction_type: str, score: float | None) -> float:
    """HPO4: what a search makes small: 1 - r2, or 100 - ROC AUC in percent; a failed model counts as score 0."""
    s = 0.0 if score is None or math.isnan(score) else score
    return 1 - s if prediction_type == "regression" else 100 - 100 * s


def bayes_search(space: dict[str, tuple], objective: Callable[[dict], float | None], trials: int, prediction_type: str = "regression", start: int = 10, good: float = 0.25, candidates: int = 64, seed: int = 0) -> list[dict]:
    """HPO4: sequential search by tree-structured Parzen estimators: ``[{params, score, loss}]``, the best first.

    ``space``: ``("uniform", lo, hi)``, ``("loguniform", lo, hi)``, ``("int", lo, hi)`` or ``("choice", [values])`` per name.  After ``start`` random trials each next one is, of ``candidates`` drawn
    around the best share ``good`` of the trials, the one that is likeliest among those and unlikeliest among the rest.  ``objective`` trains
    and scores one model (itself distributed); a failure or None counts as score 0.  Equal seeds give equal searches.
    """
    rng = np.random.default_rng(seed)

    def draw(kind: str, *a) -> float:
        if kind == "choice":
            return int(rng.integers(len(a[0])))
        lo, hi = (math.log(a[0]), math.log(a[1])) if kind == "loguniform" else a
        return float(rng.uniform(lo, hi))

    def value(kind: str, a: tuple, x: float) -> object:
        return a[0][int(x)] if kind == "choice" else math.exp(x) if kind == "loguniform" else int(round(x)) if kind == "int" else x

    def width(kind: str, a: tuple) -> float:
        return (math.log(a[1]) - math.log(a[0])) if kind == "loguniform" else a[1] - a[0]

    def density(kind: str, a: tuple, at: list[float], x: float) -> float:
        if kind == "choice":
            return (1 + sum(int(v) == int(x) for v in at)) / (len(a[0]) + len(at))
        h = max(width(kind, a) / max(len(at), 1) ** 0.5 / 2, 1e-12)
        prior = 1 / max(width(kind, a), 1e-12)
        return (prior + sum(math.exp(-0.5 * ((x - v) / h) ** 2) / (h * math.sqrt(2 * math.pi)) for v in at)) / (len(at) + 1)

    def near(kind: str, a: tuple, at: list[float]) -> float:
        if not at or rng.random() < 0.2:
            return draw(kind, *a)
        x = at[int(rng.integers(len(at)))]
        if kind == "choice":
            return x
        lo, hi = (math.log(a[0]), math.log(a[1])) if kind == "loguniform" else a
        return float(np.clip(rng.normal(x, width(kind, a) / len(at) ** 0.5 / 2), lo, hi))

    tried: list[tuple[float, dict, dict]] = []
    for t in range(trials):
        if t < start:
            x = {n: draw(*s) for n, s in space.items()}
        else:
            order = sorted(tried, key=lambda r: r[0])
            cut = max(1, int(len(order) * good))
            best, rest = [r[1] for r in order[:cut]], [r[1] for r in order[cut:]]
            options = [{n: near(s[0], s[1:], [b[n] for b in best]) for n, s in space.items()} for _ in range(candidates)]
            gain = lambda o: sum(math.log(density(s[0], s[1:], [b[n] for b in best], o[n])) - math.log(density(s[0], s[1:], [r[n] for r in rest], o[n])) for n, s in space.items())
            x = max(options, key=gain)
        params = {n: value(s[0], s[1:], x[n]) for n, s in space.items()}
        try:
            score = objective(params)
        except Exception:  # noqa: BLE001 - a model that can't be trained is a bad one, not the end of the search
            score = None
        tried.append((loss_of(prediction_type, score), x, {"params": params, "score": score, "loss": loss_of(prediction_type, score)}))
    return [r for _, _, r in sorted(tried, key=lambda r: r[0])]
