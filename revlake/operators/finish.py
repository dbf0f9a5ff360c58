"""Finished models: a folder with the model, the rows it was judged on and a manifest, read back and compared in another process.

Folder: ``model`` (one artifact), or ``vectoriser`` and ``classifier`` (two); ``expected``: test rows with what the model said;
``manifest``: one line of JSON, written last, so that a folder without it is not a finished model.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions.text import tokens
from revlake.operators import margin, models, warehouse

FORMS = ("pipeline", "parts")
#: Words from which on a text counts as informative.
INFORMATIVE = 5


class Broken(ValueError):
    """The folder holds no finished model."""


class WrongModel(ValueError):
    """Model, setting and scored tables do not name the same model."""


@dataclass(frozen=True)
class Finished:
    manifest: dict
    model: PipelineModel | margin.MarginModel


def fingerprint(rows: DataFrame, *columns: str) -> dict:
    """Number of rows and a digest of them that does not depend on their order: the sum of two hashes of each row."""
    first = F.xxhash64(*columns)
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (first, F.xxhash64(first, F.lit(1), *columns))]
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.concat_ws(":", *sums), F.lit("")).alias("digest")).first()
    return {"n": row.n, "digest": row.digest}


def measures(scored: DataFrame) -> dict[str, dict]:
    """n, accuracy and macro-F1 of all scored test rows and of those with enough words, in one pass over them."""
    words = F.size(tokens(F.coalesce("text", F.lit(""))))
    sets = F.when(words >= INFORMATIVE, F.array(F.lit("full"), F.lit("informative_ge5w"))).otherwise(F.array(F.lit("full")))
    rows = scored.filter("label is not null").select("label", "pred", F.explode(sets).alias("eval_set"))
    cells = rows.groupBy("eval_set", "label", "pred").agg(F.count(F.lit(1)).alias("n")).collect()  # sets x classes x classes
    found = {}
    for name in sorted({c.eval_set for c in cells}):
        mine = [c for c in cells if c.eval_set == name]
        n, hits = sum(c.n for c in mine), sum(c.n for c in mine if c.label == c.pred)
        f1 = []
        for k in {c.label for c in mine} | {c.pred for c in mine}:
            both, either = sum(c.n for c in mine if c.label == k == c.pred), sum(c.n * ((c.label == k) + (c.pred == k)) for c in mine)
            f1.append(2 * both / either)
        found[name] = {"n": n, "accuracy": round(hits / n, 6), "macro_f1": round(sum(f1) / len(f1), 6)}
    return found


def _save(spark: SparkSession, model, form: str, folder: str) -> str:
    if isinstance(model, margin.MarginModel):
        model.save(spark, f"{folder}/model")
        return "margin"
    if form == "parts":
        PipelineModel(model.stages[:-1]).write().overwrite().save(f"{folder}/vectoriser")
        PipelineModel(model.stages[-1:]).write().overwrite().save(f"{folder}/classifier")
    else:
        model.write().overwrite().save(f"{folder}/model")
    return form


def finish(train: DataFrame, test: DataFrame, folder: str, name: str, kind: str, setting: float = 1.0, form: str = "pipeline", choice: dict | None = None, seed: int = 42) -> dict:
    """Fits the chosen setting on the training rows (each text once), judges it on the test rows, writes the folder and returns its manifest.

    ``train`` and ``test`` have doc_id, text, label, terms; ``choice`` says how the setting was found (a row of ``one_se_choice``).
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    spark = train.sparkSession
    warehouse.write_document(spark, {"status": "writing"}, f"{folder}/manifest")  # an earlier model under this name ends here
    once = models.first_of_text(train)
    model = models.fit(once, kind, setting=setting)
    form = _save(spark, model, form, folder)
    warehouse.write_parquet(models.score(model, test).join(test.select("doc_id", "text"), "doc_id"), f"{folder}/expected")
    expected = spark.read.parquet(f"{folder}/expected")
    manifest = {
        "status": "finished",
        "model": {"name": name, "kind": kind, "setting": setting, "form": form, "terms": len(model.terms if form == "margin" else model.stages[0].vocabulary)},
        "choice": choice or {},
        "data": {"train": fingerprint(train, "doc_id", "text", "label"), "train_once": once.count(), "test": fingerprint(test, "doc_id", "text", "label")},
        "measures": measures(expected),
        "labels": {"0": "negatif", "1": "positif"},
        "seed": seed,
        "spark": pyspark.__version__,
    }
    warehouse.write_document(spark, manifest, f"{folder}/manifest")
    return manifest


def manifest(spark: SparkSession, folder: str) -> dict:
    try:
        found = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    except Exception as e:  # no folder, no file in it, or no JSON
        raise Broken(f"no manifest in {folder}") from e
    if found.get("status") != "finished":
        raise Broken(f"{folder} was not finished")
    return found


def load(spark: SparkSession, folder: str, name: str | None = None) -> Finished:
    """The finished model in whichever form it has; ``name`` is the model that the caller serves, and must be the manifest's."""
    found = manifest(spark, folder)
    if name is not None and found["model"]["name"] != name:
        raise WrongModel(f"the folder holds {found['model']['name']}, {name} is served")
    form = found["model"]["form"]
    if form == "margin":
        return Finished(found, margin.MarginModel.load(spark, f"{folder}/model"))
    places = ("vectoriser", "classifier") if form == "parts" else ("model",)
    stages = [s for place in places for s in PipelineModel.load(f"{folder}/{place}").stages]
    return Finished(found, PipelineModel(stages))


def same_model(found: dict, scores: DataFrame) -> None:
    """Raises unless the scored table has rows of the manifest's model: tables and predictions must come from one model."""
    name = found["model"]["name"]
    if scores.filter(F.col("model_name") == name).isEmpty():
        known = [r[0] for r in scores.select("model_name").distinct().limit(20).collect()]
        raise WrongModel(f"the tables were scored with {sorted(map(str, known))}, not with {name}")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """n, n_same: expected rows, and those that the model as read back scores alike."""
    expected = spark.read.parquet(f"{folder}/expected")
    again = models.score(load(spark, folder).model, models.terms(expected.select("doc_id", "text", "label")))
    both = expected.join(again.select("doc_id", F.col("pred").alias("pred2"), F.col("proba").alias("proba2")), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred").eqNullSafe(F.col("pred2")) & F.col("proba").eqNullSafe(F.col("proba2"))).alias("n_same"))


def main(folder: str) -> int:
    """``python -m revlake.operators.finish FOLDER``: reads the model in this new process; 1 if a row is scored differently."""
    spark = SparkSession.builder.getOrCreate()
    row = verify(spark, folder).first()
    print(f"{row.n_same} of {row.n} rows alike")
    spark.stop()
    return int(row.n_same != row.n)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
