"""Feature columns, the model pipeline, scoring, evaluation and importances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.operators.running import totals_before
from riskmart.sources.tables import digest, is_complete, remove, shared_dir, write_table

# Columns that are never features, and the forest's seed.
IGNORED = (
    "Customer_ID",
    "Name",
    "SSN",
    "snapshot_date",
    "loan_id",
    "Credit_History_Age",
    "label",
    "prediction_date",
    "start_date",
)
FOREST_SEED = 42

MODELS = {
    "logistic_regression": LogisticRegression,
    "random_forest": lambda: RandomForestClassifier(seed=FOREST_SEED),
}


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns by type: strings, and everything else not ignored."""
    skipped = {*IGNORED, *exclude}
    fields = [f for f in df.schema.fields if f.name not in skipped]
    categorical = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return categorical, [f.name for f in fields if f.name not in categorical]


def feature_presence(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Per feature its kind and the number of usable values, in one pass over the data."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def usable(name: str) -> Column:
        value = F.col(name)
        fractional = isinstance(types[name], (T.FloatType, T.DoubleType))
        return F.count(F.when(~F.isnan(value), value) if fractional else value).alias(name)

    names = [*categorical, *numeric]
    kind = F.when(F.col("feature").isin(list(categorical)), "categorical").otherwise("numeric")
    return (
        df.agg(*[usable(name) for name in names])
        .unpivot([], names, "feature", "n_present")
        .select("feature", kind.alias("kind"), "n_present")
    )


def trainable_columns(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Columns a pipeline can be fitted on: those without any value have no median and no categories and are left out."""
    presence = feature_presence(train, categorical, numeric).collect()
    present = {r.feature for r in presence if r.n_present}
    return [c for c in categorical if c in present], [c for c in numeric if c in present]


def exact_imputer(medians: Mapping[str, float]) -> SQLTransformer:
    """Missing values and NaN as the given numbers."""
    filled = [f"coalesce(nullif(cast(`{c}` as double), double('NaN')), double('{m!r}')) as `{c}`" for c, m in medians.items()]
    names = ", ".join(f"`{c}`" for c in medians)
    return SQLTransformer(statement=f"select * except ({names}), {', '.join(filled)} from __THIS__")


def create_pipeline(
    categorical: Sequence[str],
    numeric: Sequence[str],
    model_type: str = "logistic_regression",
    medians: Mapping[str, float] | None = None,
) -> Pipeline:
    """Index, one-hot encode, impute by median, assemble, classify.

    The imputer's medians are approximate, unless ``medians`` (such as ``exact_quantiles`` of the training rows) are given.

    All categorical columns share one indexer, so their categories are counted in one job.
    """
    if model_type not in MODELS:
        raise ValueError(f"unsupported model type: {model_type}")
    indexed = [f"{c}_idx" for c in categorical]
    encoded = [f"{c}_ohe" for c in categorical]
    stages = []
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded),
        ]
    if numeric and medians is not None:
        stages.append(exact_imputer({c: medians[c] for c in numeric}))
    elif numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=list(numeric), strategy="median"))
    stages.append(VectorAssembler(inputCols=encoded + list(numeric), outputCol="features"))
    return Pipeline(stages=[*stages, MODELS[model_type]()])


def feature_fingerprint(train: DataFrame, pipeline: Pipeline, data_key: str = "") -> str:
    """Digest of the pipeline's stages, of the names and types of its inputs, and of the rows' ``data_key``."""
    stages, inputs = [], set()
    for stage in pipeline.getStages():
        params = {p.name: stage.getOrDefault(p) for p in stage.params if stage.isSet(p)}
        inputs |= set(params.get("inputCols") or ())
        stages.append([type(stage).__name__, params])
    types = sorted((f.name, f.dataType.simpleString()) for f in train.schema.fields if f.name in inputs)
    return digest(stages, types, data_key)


def fit(spark: SparkSession, pipeline: Pipeline, train: DataFrame, vectors_path: str) -> PipelineModel:
    """Fit the preparing stages, store the training vectors, fit the classifier on them.

    The classifier reads its input many times. From a stored table of vectors its tasks
    carry no preparation, and what a lost executor held is read again, not prepared again. The table is removed after the fit.
    """
    *preparing, classifier = pipeline.getStages()
    prepared = Pipeline(stages=preparing).fit(train)
    vectors = prepared.transform(train).select("features", "label")
    write_table(vectors, vectors_path)
    stored = spark.read.schema(vectors.schema).parquet(vectors_path)
    fitted = PipelineModel(stages=[*prepared.stages, classifier.fit(stored)])
    remove(spark, vectors_path)
    return fitted


def fit_or_load(
    spark: SparkSession,
    pipeline: Pipeline,
    train: DataFrame,
    path: str,
    refresh: bool = False,
    data_key: str = "",
    work_path: str | None = None,
) -> PipelineModel:
    """Load the model at ``path`` if it was fitted on the same features of the same rows, else fit and save it.

    ``data_key`` names the training rows: the stored table's build and the split. Training vectors go below ``work_path``, or the
    session's shared folder. The fingerprint is written last, so a model without one is an unfinished save.
    """
    mark = f"{path}/fingerprint"
    fingerprint = feature_fingerprint(train, pipeline, data_key)
    if not refresh and is_complete(spark, mark) and spark.read.text(mark).first()[0] == fingerprint:
        return PipelineModel.load(path)
    model = fit(spark, pipeline, train, f"{work_path or shared_dir(spark)}/vectors-{digest(path)[:12]}")
    model.write().overwrite().save(path)
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.text(mark)
    return model


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The model's prediction and the probability of a default, beside the input columns."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        "rawPrediction",
        vector_to_array("probability")[1].alias("default_probability"),
        "prediction",
    )


def area_of_scores(scored: DataFrame) -> float:
    """Area under the ROC curve of ``rawPrediction`` (a number, or a vector of both classes) against ``label``."""
    return BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)


def exact_area_of_scores(scored: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """``(area_under_roc, positives, negatives)`` with one threshold per score, pairs of equal scores counting one half.

    Scores are counted first, then ordered by ranges; each adds its positives times the negatives below it. Products are exact decimals. With one class only the area
    is null. Rows without score or label are left out.
    """
    known = scored.select(F.col(score_col).alias("score"), F.col(label_col).alias("label")).filter("score is not null and label is not null")
    wide = lambda c: c.cast("decimal(19,0)")
    levels = known.groupBy("score").agg(
        wide(F.count(F.when(F.col("label") == 1, 1))).alias("p"), wide(F.count(F.when(F.col("label") != 1, 1))).alias("n")
    )
    below = totals_before(levels, [F.asc("score")], ["n"])
    twice = F.col("p").cast("decimal(38,0)") * (F.col("n_before").cast("decimal(38,0)") * 2 + F.col("n"))
    total = below.agg(F.sum(twice.cast("decimal(38,0)")).alias("twice"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    area = F.try_divide(F.col("twice").cast("double"), 2 * F.col("p").cast("double") * F.col("n").cast("double"))
    none = F.lit(0).cast("long")
    return total.select(area.alias("area_under_roc"), F.coalesce(F.col("p").cast("long"), none).alias("positives"), F.coalesce(F.col("n").cast("long"), none).alias("negatives"))


def numbers_of_truth_values(df: DataFrame) -> DataFrame:
    """Boolean columns as 0 and 1, which imputing and assembling can take."""
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)})


def area_under_roc(model: PipelineModel, test: DataFrame) -> float:
    return area_of_scores(model.transform(test))


def feature_importance(
    spark: SparkSession, model: PipelineModel, df: DataFrame, top: int | None = None
) -> DataFrame | None:
    """Importance per input column, descending; None if the model has no importances.

    Importances belong to slots of the feature vector. Their names are read from the
    vector's metadata, and the slots of a one-hot column are added up.
    """
    classifier = model.stages[-1]
    if not hasattr(classifier, "featureImportances"):
        return None
    attributes = model.transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    slots = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    encoders = [s for s in model.stages if "OneHotEncoder" in type(s).__name__]
    encoded = {name for s in encoders for name in s.getOutputCols()}

    def source(slot_name: str) -> str:
        # A slot of a one-hot column is named <column>_ohe_<category>; the longest match
        # wins, since one column's name may begin with another's.
        owners = [e for e in encoded if slot_name.startswith(f"{e}_")]
        return max(owners, key=len).removesuffix("_ohe") if owners else slot_name

    weights = classifier.featureImportances.toArray()
    rows = [(source(slots[i]), float(w)) for i, w in enumerate(weights)]
    importance = (
        spark.createDataFrame(rows, "feature string, importance double")
        .groupBy("feature")
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
    return importance if top is None else importance.limit(top)
