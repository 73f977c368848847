"""A text encoder trained on the catalog itself: character n-grams, inverse document frequencies, principal components.

Every step is a Spark ML stage, so fitting is distributed sums (the driver sees ``features`` squared numbers) and encoding
runs in the JVM.  Similar spellings get similar unit vectors, which the vector index serves as it does any other encoder's
(``retrieval.encode_texts`` takes one from outside).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, DIMENSIONS, GRAM = 1024, 64, 3


def grams(text, size: int = GRAM) -> Column:
    """Character n-grams of the lower-case text with its ends marked by spaces; a null text has none."""
    padded = F.concat(F.lit(" " * (size - 1)), F.lower(F.col(text) if isinstance(text, str) else text), F.lit(" "))
    found = F.transform(F.sequence(F.lit(1), F.char_length(padded) - (size - 1)), lambda i: F.substring(padded, i, size))
    return F.coalesce(found, F.array().cast("array<string>"))


def fit_encoder(texts: DataFrame, text_col: str = "name", *, features: int = FEATURES, dimensions: int = DIMENSIONS) -> PipelineModel:
    """Encoder of the texts' n-grams; ``dimensions`` at most the number of distinct texts."""
    sample = texts.select(F.col(text_col).alias("text")).where("text is not null").distinct().select(grams("text").alias("grams"))
    stages = [HashingTF(inputCol="grams", outputCol="counts", numFeatures=features), IDF(inputCol="counts", outputCol="weights"),
              Normalizer(inputCol="weights", outputCol="even"), PCA(k=dimensions, inputCol="even", outputCol="parts"),
              Normalizer(inputCol="parts", outputCol="unit")]
    return Pipeline(stages=stages).fit(sample)


def encode(df: DataFrame, model: PipelineModel, text_col: str = "name", out_col: str = "embedding") -> DataFrame:
    """``df`` plus the unit vector of ``text_col`` as array<float>; null for a null text."""
    inner = {c for s in model.stages for c in (s.getInputCol(), s.getOutputCol())}
    clash = inner & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns named like the encoder's own: {sorted(clash)}")
    out = model.transform(df.withColumn("grams", grams(text_col)))
    vector = F.when(F.col(text_col).isNotNull(), vector_to_array("unit", "float32"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != out_col], vector.alias(out_col))
