"""Intent classification: a multinomial classifier over the encoder's vectors, its training job, its store and its stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.readers import LABELS
from . import annotate, hybrid, metrics, selection

FLOOR = 0.65
META = "encoder string, dim int, labels array<string>, accuracy double"


def _features(vector: Column, dim: int) -> Column:
    """What the classifier takes; a null vector is that of a text without tokens."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.coalesce(vector, F.array_repeat(F.lit(0.0), dim)))


class Intent:
    """A fitted model with what it must agree on: encoder, dimension and the order of labels."""

    def __init__(self, model, labels: tuple[str, ...], encoder: str = "hash", dim: int = hybrid.DIM, accuracy: float | None = None):
        self.model, self.labels, self.encoder, self.dim, self.accuracy = model, tuple(labels), encoder, dim, accuracy

    def classify(self, rows: DataFrame, text_col: str = "text", *, vector_col: str | None = None) -> DataFrame:
        """Adds (label, confidence, probabilities); a null text has nulls.  ``vector_col`` names the vectors where rows are encoded already, null for a null text."""
        from pyspark.ml.functions import vector_to_array

        features = _features(F.col(vector_col) if vector_col else hybrid.encoded(F.col(text_col), self.dim), self.dim)
        out = self.model.transform(rows.withColumn("features", features)).withColumn("_p", vector_to_array("probability"))
        names = F.array(*map(F.lit, self.labels))
        known = F.col(vector_col or text_col).isNotNull()
        out = out.withColumns({
            "label": F.when(known, F.element_at(names, (F.col("prediction") + 1).cast("int"))), "confidence": F.when(known, F.round(F.array_max("_p"), 6)),
            "probabilities": F.when(known, F.map_from_arrays(names, F.transform("_p", lambda p: F.round(p, 6)))),
        })
        return out.drop("features", "rawPrediction", "probability", "prediction", "_p")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.encoder, self.dim, list(self.labels), self.accuracy)], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, encoder: str = "hash", dim: int = hybrid.DIM, labels: tuple[str, ...] = LABELS) -> "Intent":
        """A model of another encoder, dimension or label order is an error."""
        from pyspark.ml.classification import LogisticRegressionModel

        meta = spark.read.schema(META).json(f"{path}/meta").first()
        for name, want in (("encoder", encoder), ("dim", dim), ("labels", list(labels))):
            if getattr(meta, name) != want:
                raise ValueError(f"the classifier's {name} is {getattr(meta, name)}, not {want}")
        return cls(LogisticRegressionModel.load(f"{path}/model"), labels, encoder, dim, meta.accuracy)


def fit(rows: DataFrame, labels: tuple[str, ...], *, text_col: str = "text", label_col: str = "label", dim: int = hybrid.DIM, most: int | None = None, vector_col: str | None = None) -> Intent:
    """Fitted on all rows that have one of ``labels``; where a caller asks for ``most`` at most, on those of the least hashes of their texts.

    ``vector_col`` names the vectors where rows are encoded and written already, null for a null text.
    """
    from pyspark.ml.classification import LogisticRegression

    label = F.array_position(F.array(*map(F.lit, labels)), F.col(label_col)).cast("double") - 1
    own = rows.select("*", label.alias("_y")).filter("_y >= 0")
    if most is not None:
        code = F.call_function("shiftrightunsigned", F.xxhash64(vector_col or text_col), F.lit(12))  # 52 bits, which doubles hold
        own = own.withColumn("_code", code)
        codes = scratch.written(own.select("_code"), "codes")
        if codes.count() > most:  # those below the one that would be too many; no task gets them all to sort
            over = selection.selected(codes, "_code", {"over": lambda n: F.lit(most)}).first().value
            own = own.filter(F.col("_code") < over)
    if vector_col is None:
        own = scratch.written(own.select(hybrid.encoded(F.col(text_col), dim).alias("_v"), "_y"), "features")  # fitting reads them several times
    own = own.select(_features(F.col(vector_col or "_v"), dim).alias("features"), F.col("_y").alias("label"))
    return Intent(LogisticRegression(maxIter=30, regParam=0.001).fit(own), labels, dim=dim)


def train(examples: DataFrame, path: str, *, labels: tuple[str, ...] = LABELS, floor: float = FLOOR, ratio: float = 0.2, seed: int = 42) -> Intent:
    """The training job over (query, label): split, fit, evaluate, save; an accuracy under ``floor`` fails the job and saves nothing."""
    split = metrics.stratified_split(examples, "label", "query", ratio, seed)
    intent = fit(split.filter("split = 'train'"), labels, text_col="query")
    held = intent.classify(split.filter("split = 'val'").select(F.col("query").alias("text"), F.col("label").alias("truth")))
    intent.accuracy = held.agg(F.avg((F.col("label") == F.col("truth")).cast("double"))).first()[0]
    if (intent.accuracy or 0) < floor:
        raise RuntimeError(f"accuracy {intent.accuracy} is under {floor}")
    intent.save(path)
    return intent


def stage(queries: DataFrame, intent: Intent | None) -> DataFrame:
    """Adds (label, confidence, probabilities) to queries (query_id, text); all null without a model, which later stages take for no opinion."""
    if intent is not None:
        return intent.classify(queries)
    return queries.withColumns({"label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "probabilities": F.lit(None).cast("map<string,double>")})


def routed(queries: DataFrame, intent: Intent | None = None) -> DataFrame:
    """Adds (kind, stages, domain, reason), by a sure classifier before the cues."""
    rows = stage(queries, intent)
    r: Column = annotate.routed(F.col("text"), F.col("label"), F.col("confidence"))
    return rows.withColumn("_r", r).select(*queries.columns, "_r.*")
