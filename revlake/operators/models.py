"""Classifiers and topics on TF-IDF vectors with ``pyspark.ml``."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.text import bigrams, clean_ascii, tokens
from revlake.operators import margin, topicfit, topicmodel
from revlake.operators.analysis import dominant_topic, smallest_near_best, u_mass


def terms(texts: DataFrame) -> DataFrame:
    """Adds ``terms``: words and pairs of neighbours of the cleaned text."""
    rows = texts.withColumn("__w", tokens(clean_ascii(F.col("text"))))
    return rows.withColumn("terms", F.concat("__w", bigrams(F.col("__w")))).drop("__w")


def dealt(texts: DataFrame, cuts: list[float], seed: int = 42) -> DataFrame:
    """Labelled rows with ``part``: each label's rows, ordered by a digest of the id, are cut at exactly these shares of them.

    Rows are counted in 65,536 cells of the digest.  A cell that no cut divides goes to one part as a
    whole; only the rows of divided cells, one cell a label and cut, are ranked.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = texts.filter("label is not null").withColumn("__h", digest).withColumn("__cell", F.substring("__h", 1, 4))
    upto = Window.partitionBy("label").orderBy("__cell")
    cells = rows.groupBy("label", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy("label")))

    def part_of(position):
        return sum((F.when(position > F.round(F.lit(c) * F.col("__all")), 1).otherwise(0) for c in cuts), F.lit(0))

    cells = cells.withColumn("__first", part_of(F.col("__before") + 1)).withColumn("__last", part_of(F.col("__before") + F.col("__n")))
    placed = rows.join(F.broadcast(cells.drop("__n")), ["label", "__cell"])  # 65,536 rows a label at most
    order = Window.partitionBy("label", "__cell").orderBy("__h", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    whole = placed.filter(F.col("__first") == F.col("__last")).withColumn("part", F.col("__first"))
    divided = placed.filter(F.col("__first") < F.col("__last")).withColumn("part", part_of(F.col("__before") + F.row_number().over(order)))
    return whole.unionByName(divided).select(*texts.columns, "part")


def split(texts: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, stratified by label: ``share`` of each label's rows, rounded, train."""
    rows = dealt(texts, [share], seed)
    return rows.filter("part = 0").drop("part"), rows.filter("part = 1").drop("part")


def first_of_text(train: DataFrame) -> DataFrame:
    """One training row per text and the one with the least id; never applied to test rows."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id")
    kept = train.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("__text")).agg(F.min_by(F.struct(*train.columns), rank).alias("__row"))
    return kept.select("__row.*")


def balanced(train: DataFrame) -> DataFrame:
    """Adds weight = n / (classes * n of the class)."""
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    total = F.broadcast(counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k")))  # one row
    return train.join(F.broadcast(counts.join(total)), "label").withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")  # a row per class


def _each_term(rows: DataFrame, *also: str) -> DataFrame:
    """term, n and df, and the columns ``also``: occurrences and texts with the term, one row for each batch of texts that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group in table.select(list(also)).group_by(list(also)).aggregate([]).to_pylist() if also else [{}]:
                lists = table.filter(reduce(pc.and_, [pc.equal(table[c], v) for c, v in group.items()])) if group else table
                lists = lists["terms"].combine_chunks()
                words = lists.flatten().dictionary_encode()
                names, length = words.dictionary, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                code = pa.array(words.indices).to_numpy(zero_copy_only=False).astype(np.int64)
                pair, times = np.unique(np.repeat(np.arange(len(length)), length) * max(1, len(names)) + code, return_counts=True)
                at = pair % max(1, len(names))
                n, df = (np.bincount(at, w, len(names)).astype(np.int64) for w in (times, None))
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(names), batch.schema.field(c).type) for c, v in group.items()), names, pa.array(n), pa.array(df)], names=[*group, "term", "n", "df"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in also)
    return rows.select(*also, "terms").mapInArrow(run, f"{kinds}term string, n long, df long")


def vocabulary(train: DataFrame, most: int = 30_000, least: int = 3) -> tuple[list[str], list[float]]:
    """The ``most`` terms with the greatest corpus count (ties by term) of those in ``least`` documents, and their smooth idf."""
    stats = _each_term(train).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter(F.col("df") >= least)
    return _most_frequent(stats, train.count(), most)


def _most_frequent(stats: DataFrame, docs: int, most: int) -> tuple[list[str], list[float]]:
    """From term, n and df.  A histogram of the counts, some hundred rows, tells how low the last place can lie; only terms above that are sorted."""
    stats = stats.withColumn("__bin", F.floor(8 * F.log2("n"))).persist()
    left, lowest = most, 0
    for bin_, n in stats.groupBy("__bin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("__bin")).collect():  # a row per eighth of a power of two
        left, lowest = left - n, bin_
        if left <= 0:
            break
    idf = F.ln((1 + F.lit(docs)) / (1 + F.col("df"))) + 1
    chosen = stats.filter(F.col("__bin") >= lowest).orderBy(F.desc("n"), "term").limit(most).select("term", idf.alias("idf")).collect()  # ``most`` rows
    stats.unpersist()
    return [r.term for r in chosen], [r.idf for r in chosen]


def fold_vocabularies(rows: DataFrame, folds: int, most: int = 30_000, least: int = 3) -> Iterator[tuple[list[str], list[float]]]:
    """For each fold the vocabulary of the rows of all other parts; terms are counted once, by part."""
    docs = {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per fold
    of = lambda c, k: F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counts = _each_term(rows, "part").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), *(of(c, k) for k in range(folds) for c in ("n", "df")))
    counts = counts.filter(F.col("df") >= least).persist()
    for k in range(folds):
        stats = counts.select("term", (F.col("n") - F.col(f"n{k}")).alias("n"), (F.col("df") - F.col(f"df{k}")).alias("df")).filter(F.col("df") >= least)
        yield _most_frequent(stats, sum(docs.values()) - docs.get(k, 0), most)
    counts.unpersist()


class Sublinear(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(tf) on the values of sparse vectors."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.arrow_udf(VectorUDT())
        def made(column: pa.Array) -> pa.Array:
            values = column.field("values")
            log = pa.ListArray.from_arrays(values.offsets, pc.add(pc.ln(values.values), 1.0))
            return pa.StructArray.from_arrays([column.field("type"), column.field("size"), column.field("indices"), log], names=["type", "size", "indices", "values"])

        return dataset.withColumn(self.getOutputCol(), made(F.col(self.getInputCol())))


def vectoriser(train: DataFrame, most: int = 30_000, least: int = 3) -> PipelineModel:
    """``terms`` -> ``features``: sublinear tf times smooth idf, of unit length, as ``analysis.tfidf`` weighs them."""
    terms_, idf = vocabulary(train, most, least)
    if not terms_:
        raise ValueError(f"no term occurs in {least} documents")
    return weighing(terms_, idf)


def weighing(terms_: list[str], idf: list[float]) -> PipelineModel:
    return PipelineModel([
        CountVectorizerModel.from_vocabulary(terms_, inputCol="terms", outputCol="__tf"),
        Sublinear(inputCol="__tf", outputCol="__sub"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__sub", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="features"),
    ])


def classifier(kind: str, n: int, setting: float = 1.0):
    """``lr``: ``setting`` is C, so that the penalty is 1 / (C * sum of weights); ``nb`` (multinomial), ``cnb`` (complement): alpha."""
    penalty = 1 / (setting * max(n, 1))  # balanced weights sum to the number of rows
    return {
        "lr": lambda: LogisticRegression(weightCol="weight", regParam=penalty, standardization=False, maxIter=50),
        "nb": lambda: NaiveBayes(smoothing=setting),
        "cnb": lambda: NaiveBayes(modelType="complement", smoothing=setting),
    }[kind]()


def margin_model(train: DataFrame, features: int = 30_000, min_df: int = 3, setting: float = 1.0) -> margin.MarginModel:
    """``svc``: squared hinge with balanced costs; ``setting`` is C."""
    return margin.fit(balanced(train), [2 * F.col("label") - 1], [F.col("weight")], vocabulary(train, features, min_df), setting)


def fit(train: DataFrame, kind: str = "lr", features: int = 30_000, min_df: int = 3, setting: float = 1.0) -> PipelineModel | margin.MarginModel:
    """Vectoriser and classifier, fitted on the same rows."""
    return fit_all(train, (kind,), features, min_df, setting)[kind]


def fit_all(train: DataFrame, kinds: tuple[str, ...], features: int = 30_000, min_df: int = 3, setting: float = 1.0) -> dict[str, PipelineModel | margin.MarginModel]:
    """Classifiers over one vectoriser, all fitted on the same rows, whose terms are counted and weighed once."""
    words, idf = vocabulary(train, features, min_df)
    if not words and set(kinds) != {"svc"}:
        raise ValueError(f"no term occurs in {min_df} documents")
    out: dict[str, PipelineModel | margin.MarginModel] = {}
    plain = [kind for kind in kinds if kind != "svc"]
    if plain:
        made = weighing(words, idf)
        rows = made.transform(balanced(train)).select("label", "weight", "features").persist()  # each iteration reads it
        n = rows.count()
        out = {kind: PipelineModel([*made.stages, classifier(kind, n, setting).fit(rows)]) for kind in plain}
        rows.unpersist()
    if "svc" in kinds:
        out["svc"] = margin.fit(balanced(train), [2 * F.col("label") - 1], [F.col("weight")], (words, idf), setting)
    return {kind: out[kind] for kind in kinds}


def score(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """doc_id, label, pred and the probability of 1 (null for models without one)."""
    out = model.transform(texts)
    proba = F.round(vector_to_array("probability")[1], 4) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select("doc_id", "label", F.col("prediction").cast("int").alias("pred"), proba.alias("proba"))


def _predicted(rows: DataFrame, model, k: int) -> DataFrame:
    """``rows`` with features, or terms for a margin model, and columns ``__pK`` (prediction) and ``__qK`` (probability of 1 or null)."""
    if isinstance(model, margin.MarginModel):
        rows = model.margins(rows, f"__m{k}")
        return rows.withColumns({f"__p{k}": (F.get(f"__m{k}", F.lit(0)) > 0).cast("int"), f"__q{k}": F.lit(None).cast("double")}).drop(f"__m{k}")
    named = model.copy({model.predictionCol: f"__p{k}", model.rawPredictionCol: f"__r{k}", model.probabilityCol: f"__v{k}"})
    rows = named.transform(rows)
    return rows.withColumns({f"__p{k}": F.col(f"__p{k}").cast("int"), f"__q{k}": F.round(vector_to_array(f"__v{k}")[1], 4)}).drop(f"__r{k}", f"__v{k}")


def score_all(fitted: dict[str, PipelineModel | margin.MarginModel], texts: DataFrame) -> DataFrame:
    """Every row under every model: doc_id, label, pred, proba, model_name.

    Models that have their vectoriser in common are applied to one set of vectors; no row is shuffled.
    """
    groups: dict[tuple, dict] = {}
    for name, m in fitted.items():
        stages = () if isinstance(m, margin.MarginModel) else tuple(m.stages[:-1])
        groups.setdefault(tuple(map(id, stages)), {})[name] = (stages, m)
    plain = groups.pop((), {})
    out = []
    for group in list(groups.values()) or [{}]:
        rows = texts
        for stage in next(iter(group.values()))[0] if group else ():
            rows = stage.transform(rows)
        group, plain = {**group, **plain}, {}  # margin models go with the first
        for k, (stages, m) in enumerate(group.values()):
            rows = _predicted(rows, m.stages[-1] if stages else m, k)
        made = F.array(*(F.struct(F.col(f"__p{k}").alias("pred"), F.col(f"__q{k}").alias("proba"), F.lit(name).alias("model_name")) for k, name in enumerate(group)))
        out.append(rows.select("doc_id", "label", F.inline(made)))
    return reduce(DataFrame.unionByName, out)


def log_ratios(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """term, log_ratio: what a term says for class 1, from coefficients or from the difference of the classes' log probabilities."""
    if isinstance(model, margin.MarginModel):
        names, weights = model.terms, model.weights[0]
    else:
        last, names = model.stages[-1], model.stages[0].vocabulary
        theta = last.theta.toArray() if hasattr(last, "theta") else None
        weights = last.coefficients.toArray() if theta is None else theta[1] - theta[0]
    return spark.createDataFrame([(t, round(float(w), 6)) for t, w in zip(names, weights)], "term string, log_ratio double")


def macro_f1(predictions: DataFrame, *by: str) -> DataFrame:
    """macro_f1 over any number of classes by the columns ``by``; a class that is neither label nor prediction does not count, 0 where undefined."""
    return _f1_of_cells(predictions.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n")), *by)


def _f1_of_cells(cells: DataFrame, *by: str) -> DataFrame:
    """From the numbers ``n`` of rows by label and prediction."""
    sides = F.array(F.struct(F.col("label").cast("int").alias("class"), F.lit(1).alias("l"), F.lit(0).alias("p")), F.struct(F.col("pred").cast("int").alias("class"), F.lit(0).alias("l"), F.lit(1).alias("p")))
    rows = cells.withColumn("__hit", (F.col("label") == F.col("pred")).cast("int")).select(*by, "n", "__hit", F.inline(sides))
    per = rows.groupBy(*by, "class").agg(F.sum(F.col("n") * F.col("__hit") * F.col("l")).alias("tp"), F.sum(F.col("n") * F.col("l")).alias("n_label"), F.sum(F.col("n") * F.col("p")).alias("n_pred"))
    f1 = 2 * F.col("tp") / (F.col("n_label") + F.col("n_pred"))
    return per.groupBy(*by).agg(F.round(F.avg(f1), 6).alias("macro_f1"))


def class_metrics(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    hit = F.col("label") == F.col("pred")
    sides = predictions.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(True).alias("l"), hit.alias("hit")), F.struct(F.col("pred").alias("class"), F.lit(False).alias("l"), hit.alias("hit")))).alias("x")).select("x.*")
    per = sides.groupBy("class").agg(F.count_if("l").alias("support"), F.count_if(~F.col("l")).alias("n_pred"), F.count_if(F.col("l") & F.col("hit")).alias("tp"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, n_label, n_pred = map(F.col, ("tp", "support", "n_pred"))
    return per.select("class", "support", ratio(tp, n_pred).alias("precision"), ratio(tp, n_label).alias("recall"), ratio(2 * tp, n_label + n_pred).alias("f1"))


#: All settings: alpha of the Bayes models; C of the linear ones, each without and with balanced costs.
_C = [(c, weighted) for c in (0.1, 0.5, 1.0, 5.0) for weighted in (False, True)]
GRID = {"cnb": [0.1, 0.5, 1.0, 2.0], "nb": [0.1, 0.5, 1.0, 2.0], "svc": _C, "lr": _C}


def cv_grid(train: DataFrame, grid: dict[str, list[float | tuple[float, bool]]] = GRID, folds: int = 5, seed: int = 42, min_df: int = 3) -> DataFrame:
    """Macro-F1 on held-out and training rows, over stratified folds: one row per model and setting, as ``analysis.one_se_choice`` takes them.

    A setting is a number, or a number and whether costs are balanced (they are if it is a number).  ``complexity`` is C, and for the Bayes models minus alpha: the more smoothing, the simpler the model.
    Labels are 0 and 1.

    The vectoriser is fitted anew on each fold's training rows.  Rows are encoded once, over the terms of all folds; models of a kind
    are fitted in the same passes, in all settings and folds: Bayes models from the sums of the classes, the others by L-BFGS.
    """
    rows = dealt(train, [i / folds for i in range(1, folds)], seed).select("label", "part", "terms").persist()
    vocabularies = list(fold_vocabularies(rows, folds, least=min_df))
    if not all(words for words, _ in vocabularies):
        raise ValueError(f"no term occurs in {min_df} documents")
    counts = {(r.part, r.label): r.n for r in rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds x labels
    if any(label not in (0, 1) for _, label in counts):
        raise ValueError("labels other than 0 and 1")
    own = [{label: sum(n for (part, at), n in counts.items() if at == label and part != k) for label in (0, 1)} for k in range(folds)]
    inside = lambda k, cost: F.when(F.col("part") != k, cost).otherwise(F.lit(0.0))
    share = lambda n, label: sum(n.values()) / (sum(map(bool, n.values())) * max(n[label], 1))
    balanced_ = [inside(k, F.when(F.col("label") == 1, share(n, 1)).otherwise(share(n, 0))) for k, n in enumerate(own)]
    names, idf = margin.merged(vocabularies)
    made = margin.blocks(rows, names, idf, [2 * F.col("label") - 1], [inside(k, F.lit(1.0)) for k in range(folds)] + balanced_).persist()  # each pass reads it
    found = []
    for kind, items in grid.items():
        settings = [item if isinstance(item, tuple) else (item, True) for item in items]
        problems = [margin.Problem(0, k + folds * weighted, k, setting) for setting, weighted in settings for k in range(folds)]
        if kind in ("nb", "cnb"):
            weights = _bayes_weights(*margin.class_sums(made, idf, [margin.Problem(0, k, k, 1.0) for k in range(folds)]), idf > 0, [(p.vocabulary, p.c) for p in problems], kind == "nb")
        else:
            weights = margin.solve(made, idf, problems, kind == "lr")
        cells = margin.outcomes(made, idf, problems, weights)
        for j, p in enumerate(problems):
            complexity = -p.c if kind in ("nb", "cnb") else p.c
            found += [(kind, float(p.c), bool(settings[j // folds][1]), float(complexity), p.vocabulary, bool(o), label, pred, int(cells[j, o, label, pred])) for o in (0, 1) for label in (0, 1) for pred in (0, 1)]
    made.unpersist()
    rows.unpersist()
    by = ["model_name", "setting", "balanced", "complexity"]
    cells = train.sparkSession.createDataFrame(found, "model_name string, setting double, balanced boolean, complexity double, fold int, own boolean, label int, pred int, n long").filter("n > 0")
    scores = _f1_of_cells(cells, *by, "fold", "own")
    test, fitted = F.when(~F.col("own"), F.col("macro_f1")), F.when(F.col("own"), F.col("macro_f1"))
    means = scores.groupBy(*by).agg(F.round(F.avg(test), 6).alias("mean_score"), F.round(F.stddev_pop(test), 6).alias("std_score"), F.round(F.avg(fitted), 6).alias("train_score"))
    return means.withColumn("gap", F.round(F.col("train_score") - F.col("mean_score"), 6))


def _bayes_weights(rows: np.ndarray, sums: np.ndarray, known: np.ndarray, settings: list[tuple[int, float]], priors: bool) -> np.ndarray:
    """Weights and b of ``pyspark.ml``'s Bayes models of two classes, for each (vocabulary, alpha): the difference of their log probabilities."""
    out = np.zeros((len(settings), known.shape[1] + 1))
    for j, (k, alpha) in enumerate(settings):
        no, yes = (np.log(s[known[k]] + alpha) - np.log(s[known[k]].sum() + alpha * known[k].sum()) for s in sums[k])
        out[j, :-1][known[k]] = yes - no
        out[j, -1] = np.log(rows[k][1] + alpha) - np.log(rows[k][0] + alpha) if priors else 0.0
    return out


def dedup_impact(texts: DataFrame, kinds: tuple[str, ...] = ("nb", "cnb"), seed: int = 42) -> DataFrame:
    """Test macro-F1 of models fitted with and without the training rows' repeated texts, and the seconds of each fit."""
    train, test = split(texts, seed=seed)
    found = []
    for deduplicated, rows in ((False, train), (True, first_of_text(train))):
        n = rows.count()
        for kind in kinds:
            began = time.monotonic()
            model = fit(rows, kind)
            seconds = time.monotonic() - began
            found.append((kind, deduplicated, n, macro_f1(score(model, test)).first().macro_f1, seconds))
    return texts.sparkSession.createDataFrame(found, "model_name string, deduplicated boolean, n_train long, macro_f1 double, fit_seconds double")


def calibrated(train: DataFrame, texts: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, label, pred, proba of the margin model: a logistic curve over margins of rows that the fold's model has not seen.

    The models of all folds and the final one are problems of one fit, over the vocabulary of all training rows; costs are balanced in each.
    """
    rows = dealt(train, [i / folds for i in range(1, folds)], seed).persist()
    inside = [F.col("part") != k for k in range(folds)] + [F.lit(True)]
    counts = rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # folds x labels
    costs = []
    for k, of in enumerate(inside):
        n = {label: sum(r.n for r in counts if r.label == label and r.part != k) for label in (0, 1)}
        costs.append(F.when(of, F.when(F.col("label") == 1, sum(n.values()) / (2 * max(n[1], 1))).otherwise(sum(n.values()) / (2 * max(n[0], 1)))).otherwise(0.0))
    model = margin.fit(rows, [2 * F.col("label") - 1] * (folds + 1), costs, vocabulary(train))
    vector = lambda place: array_to_vector(F.array(F.get("margins", place))).alias("features")
    curve = LogisticRegression().fit(model.margins(rows).select("label", vector(F.col("part"))))
    rows.unpersist()
    scored = model.margins(texts).select("doc_id", "label", (F.get("margins", F.lit(folds)) > 0).cast("int").alias("pred"), vector(F.lit(folds)))
    return curve.transform(scored).select("doc_id", "label", "pred", F.round(vector_to_array("probability")[1], 4).alias("proba"))


def three_class(texts: DataFrame, seed: int = 42) -> DataFrame:
    """Measures of each class (``label`` 0, 1, 2) on test rows, by one margin model per class against the others, fitted together."""
    train, test = split(texts, seed=seed)
    train = balanced(first_of_text(train))
    classes = (0, 1, 2)
    model = margin.fit(train, [F.when(F.col("label") == k, 1).otherwise(-1) for k in classes], [F.col("weight")] * len(classes), vocabulary(train))
    margins = model.margins(test)
    return class_metrics(margins.select(F.col("label").cast("int").alias("label"), (F.array_position("margins", F.array_max("margins")) - 1).cast("int").alias("pred")))


def reload_check(model: PipelineModel, texts: DataFrame, path: str) -> DataFrame:
    """Saves the model, reads it back and counts rows, and rows that the two score alike."""
    model.write().overwrite().save(path)
    again = score(PipelineModel.load(path), texts).select("doc_id", F.col("pred").alias("pred2"), F.col("proba").alias("proba2"))
    both = score(model, texts).join(again, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("pred") == F.col("pred2")) & F.col("proba").eqNullSafe(F.col("proba2"))).alias("n_same"))


def error_sheet(predictions: DataFrame, previous: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """Work-sheet: of each model ``n`` wrongly predicted rows by a digest of the id, least first, with the labels that people have given before."""
    wrong = predictions.filter("label <> pred").withColumn("__h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")).cast("binary")))
    order = Window.partitionBy("model_name").orderBy("__h", "doc_id")
    chosen = wrong.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).drop("__h")
    return chosen.join(previous.select("doc_id", "cause"), "doc_id", "left").select("model_name", "rank", "doc_id", "label", "pred", "cause")


def scoring_sanity(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """By model: rows, share predicted negative, and agreement with the labels where there are any."""
    rows = scores.join(labels, "id", "left")
    return rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("pred") == 0).cast("double")), 6).alias("neg_pct"), F.round(100 * F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("agreement_pct"))


def lda_vectors(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """Vocabulary (document frequency from 10 to half of the documents, no other limit) and count vectors."""
    counter = CountVectorizer(inputCol="terms", outputCol="features", minDF=10, maxDF=0.5, vocabSize=2**31 - 1).fit(rows)
    return counter.vocabulary, counter.transform(rows).select("features")


def lda_model(vectors: DataFrame, k: int, seed: int, passes: int = 10):
    """The JVM object of the ``pyspark.mllib`` model of these count vectors.

    Every pass visits every document once.  ``pyspark.ml`` cannot do so: it draws documents with replacement,
    and at a rate of 1 misses 37 % of them in each pass, so the optimizer is set up here.
    """
    jvm = vectors.sparkSession.sparkContext._jvm.org.apache.spark
    optimizer = jvm.mllib.clustering.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setTau0(1024.0).setKappa(0.51).setOptimizeDocConcentration(True)
    lda = jvm.mllib.clustering.LDA().setK(k).setSeed(seed).setMaxIterations(passes).setOptimizer(optimizer)
    return lda.run(getattr(getattr(jvm.ml.clustering, "LDA$"), "MODULE$").getOldDataset(vectors._jdf, "features"))


def fit_lda(rows: DataFrame, k: int, seed: int, passes: int = 10):
    """Vocabulary and model of ``terms``."""
    vocabulary_, vectors = lda_vectors(rows)
    vectors = vectors.persist()  # each pass reads it
    model = lda_model(vectors, k, seed, passes)
    vectors.unpersist()
    return vocabulary_, model


def described(vocabulary_: list[str], model, top: int) -> list[tuple[int, int, str, float]]:
    """(topic, rank, term, weight) of each topic's first terms."""
    topics = [(t, list(x._1()), list(x._2())) for t, x in enumerate(model.describeTopics(top))]
    return [(t, rank, vocabulary_[i], float(w)) for t, at, weights in topics for rank, (i, w) in enumerate(zip(at, weights), 1)]


def lda_topics(texts: DataFrame, k: int = 5, top: int = 10, seed: int = 42) -> DataFrame:
    """Top terms of each topic."""
    rows = described(*fit_lda(texts.select(tokens(clean_ascii(F.col("text"))).alias("terms")), k, seed), top)
    return texts.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double").withColumn("weight", F.round("weight", 6))


def lda_sweep(texts: DataFrame, ks: range = range(5, 13), top: int = 10, seed: int = 42) -> DataFrame:
    """k, c_v and u_mass (means over the topics), chosen: the least k whose c_v is within 0.005 of the best.

    Texts are cleaned once; all models are fitted in the same passes over the documents, and measured together.
    """
    words = topicmodel.words_of(texts).persist()  # read for the vocabulary, the vectors and the measures
    vocabulary_, vectors = lda_vectors(words.select(F.col("words").alias("terms")))
    vectors = vectors.persist()  # each pass reads it
    fitted = topicfit.fit_together(vectors, len(vocabulary_), list(ks), seed)
    vectors.unpersist()
    rows = [(1000 * k + t, rank, term) for k in ks for t, rank, term, _ in topicfit.described(vocabulary_, fitted[k], top)]
    chosen = texts.sparkSession.createDataFrame(rows, "topic int, rank int, term string")
    means = coherences(texts, chosen, words)
    measured = texts.sparkSession.createDataFrame(means.collect(), means.schema)  # a row a model
    words.unpersist()
    return with_choice(measured)


def coherences(texts: DataFrame, chosen: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """k, c_v, u_mass: means over the topics of each model, whose numbers are 1000 k + topic; ``words`` are those of the texts where they are at hand."""
    scores = topicmodel.c_v(topicmodel.words_of(texts) if words is None else words, chosen).join(u_mass(texts, chosen).select("topic", "u_mass"), "topic")
    return scores.groupBy(F.floor(F.col("topic") / 1000).cast("int").alias("k")).agg(F.round(F.avg("c_v"), 6).alias("c_v"), F.round(F.avg("u_mass"), 6).alias("u_mass"))


def with_choice(means: DataFrame) -> DataFrame:
    best = smallest_near_best(means.withColumnRenamed("c_v", "coherence")).select(F.col("k").alias("chosen_k"))
    return means.join(F.broadcast(best), F.lit(True)).select("k", "c_v", "u_mass", (F.col("k") == F.col("chosen_k")).alias("chosen"))  # one row


def lda_assignment(texts: DataFrame, k: int = 5, seed: int = 42, passes: int = 10) -> DataFrame:
    """doc_id, weights, topic, weight: the posterior of every document under fitted topics, and its dominant topic or -1."""
    rows = topicmodel.words_of(texts)
    vocabulary_, model = fit_lda(rows.select(F.col("words").alias("terms")), k, seed, passes)
    weights = topicmodel.posterior(rows, "doc_id", topicmodel.topic_table(vocabulary_, model), [1.0 / k] * k)
    return weights.join(dominant_topic(weights), "doc_id")
