"""Prediction files, saved indexes, and resuming a run."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators.drift import TARGET

GOLD = "_id string, id string, question string, answer string, type string, question_type string, level string, context string, supporting_facts string"


def read_gold(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Gold files (one JSON array each) as raw records with their split; files that don't exist are skipped."""
    out = None
    for p in paths:
        if not Path(p.removeprefix("file://")).exists() and "://" not in p.removeprefix("file://"):
            continue
        rows = spark.read.schema(GOLD).option("multiLine", True).json(p).withColumn("split", F.lit(Path(p).stem))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(", ".join(paths))
    return out


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file {id: record} as rows; a text index in ``sp`` is kept as text in ``sp_raw``."""
    record = ",".join(f"{k}:string" for k in TARGET)
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{record}>>")).alias("question_id", "r"))
    return rows.select("question_id", *(F.col(f"r.{k}").alias(f"{k}_raw" if k in ("sp", "verification", "decision") else k) for k in TARGET))


def save_predictions(predictions: DataFrame, path: str, key: str = "question_id") -> None:
    """Append-only Parquet, the form a resumed run reads."""
    predictions.write.mode("append").parquet(path)


def remaining(questions: DataFrame, saved: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a saved prediction."""
    return questions.join(saved.select(key), key, "left_anti")


def export_predictions(predictions: DataFrame, path: str, key: str = "question_id") -> None:
    """One JSON object keyed by id, streamed through the driver row by row."""
    rows = predictions.select(key, F.to_json(F.struct(*(c for c in predictions.columns if c != key))).alias("r"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for i, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(r[0], ensure_ascii=False) + ": " + r[1])
        f.write("\n}\n")


def save_index(path: str, corpus: str, passages: DataFrame, weights: DataFrame, vectors: DataFrame, dim: int, model_name: str = "") -> None:
    """Index tables of one corpus, as Parquet under its name: passages, term weights, vectors, and last what they were made with."""
    for name, df in (("passages", passages), ("weights", weights), ("vectors", vectors)):
        df.write.mode("overwrite").parquet(f"{path}/{corpus}/{name}")
    about = passages.agg(F.count("*").alias("num_passages")).withColumns({"dim": F.lit(dim), "model_name": F.lit(model_name)})
    about.write.mode("overwrite").json(f"{path}/{corpus}/about")


def load_index(spark: SparkSession, path: str, corpus: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The saved tables; None where no whole index is saved.  An index with other numbers of passages raises ValueError."""
    try:
        about = spark.read.json(f"{path}/{corpus}/about").first()  # one row
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    passages, weights, vectors = (spark.read.parquet(f"{path}/{corpus}/{n}") for n in ("passages", "weights", "vectors"))
    if "terms" not in weights.columns:  # saved in an earlier form
        return None
    if passages.count() != about["num_passages"]:
        raise ValueError(f"the saved index of {corpus} is not whole")
    return passages, weights, vectors


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
