"""Feature engineering: scaling, principal components, rare levels, dummies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.fixed_values import MIN_GROUP_SIZE
from corpuscope.operators.filters import group_sizes
from corpuscope.operators.joins import weighted_lookup_join


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Adds (x - mean) / population std; a constant column gives 0."""
    moments = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns
    ]).alias("m")).scalar()
    scaled = df.withColumn("_m", moments)
    for c in columns:
        centred = F.col(c) - F.col(f"_m.{c}.mean")
        scaled = scaled.withColumn(
            c + suffix, F.when(F.col(f"_m.{c}.sd") == 0, centred).otherwise(centred / F.col(f"_m.{c}.sd")))
    return scaled.drop("_m")


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Feature vector of numeric columns; rows with a NULL feature are dropped."""
    numeric = df.withColumns({f"_f{i}": F.col(c).cast("double") for i, c in enumerate(columns)})
    names = [f"_f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="skip").transform(numeric).drop(*names)


class Components:
    """Principal components of standardised columns."""

    def __init__(self, columns: Sequence[str], model, signs: list[float]):
        self.columns, self.model, self.signs = list(columns), model, signs

    def loadings(self, df: DataFrame) -> DataFrame:
        """(feature, pc, loading, explained) rows; a small table."""
        spark, matrix, share = df.sparkSession, self.model.pc, self.model.explainedVariance
        rows = [
            (c, j + 1, float(matrix[i, j] * self.signs[j]), float(share[j]))
            for i, c in enumerate(self.columns) for j in range(matrix.numCols)
        ]
        return spark.createDataFrame(rows, "feature string, pc int, loading double, explained double")

    def score(self, df: DataFrame, output: str = "engagement_index") -> DataFrame:
        """Adds the score on the first component to rows complete in all columns."""
        scaled = standardize(df.dropna(subset=self.columns), self.columns)
        weighted = None
        for i, c in enumerate(self.columns):
            term = F.col(f"{c}_z") * float(self.model.pc[i, 0] * self.signs[0])
            weighted = term if weighted is None else weighted + term
        return scaled.withColumn(output, weighted).drop(*[f"{c}_z" for c in self.columns])


def fit_components(df: DataFrame, columns: Sequence[str], k: int | None = None) -> Components:
    """PCA on population-standardised columns; each component's loadings sum to a positive number."""
    scaled = standardize(df.dropna(subset=list(columns)), columns)
    vectors = assemble(scaled, [f"{c}_z" for c in columns])
    model = PCA(k=k or len(columns), inputCol="features", outputCol="scores").fit(vectors)
    signs = []
    for j in range(model.pc.numCols):
        total = sum(model.pc[i, j] for i in range(model.pc.numRows))
        signs.append(-1.0 if total < 0 else 1.0)
    return Components(columns, model, signs)


def log1p_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds log1p_<c>; values of -1 and below give NULL."""
    return df.withColumns({f"log1p_{c}": F.log1p(F.col(c).cast("double")) for c in columns})


def dropped_by_log1p(df: DataFrame, column: str) -> DataFrame:
    """Rows in total and rows whose value is -1 or less, which log1p loses."""
    return df.agg(F.count(column).alias("n"), F.count_if(F.col(column) <= -1).alias("dropped"))


def merge_rare(df: DataFrame, column: str, min_n: int = MIN_GROUP_SIZE, output: str | None = None) -> DataFrame:
    """Adds <column>_grouped: levels with fewer than ``min_n`` rows and NULL become 'Other'."""
    output = output or f"{column}_grouped"
    frequent = group_sizes(df, column, min_n)
    joined = weighted_lookup_join(df, frequent, column, "group_n", "left")
    return joined.withColumn(output, F.when(F.col("group_n").isNotNull(), F.col(column)).otherwise("Other")).drop("group_n")


def one_hot(df: DataFrame, column: str, prefix: str, levels: Sequence[str] | None = None) -> DataFrame:
    """0/1 columns <prefix>_<level>, the alphabetically first level dropped.

    A column per level is meant for columns of few levels, which are read unless named;
    ``one_hot_vector`` takes any number.
    """
    if levels is None:
        levels = [row[0] for row in df.where(F.col(column).isNotNull()).select(column).distinct().collect()]
    levels = sorted(levels)
    flags = {f"{prefix}_{level}": F.coalesce(F.col(column) == level, F.lit(False)).cast("int") for level in levels[1:]}
    return df.withColumns(flags) if flags else df


def one_hot_vector(df: DataFrame, column: str, output: str) -> DataFrame:
    """A sparse vector with a place for each level but the alphabetically last; NULL gives no entry."""
    index = StringIndexer(inputCol=column, outputCol="_index", stringOrderType="alphabetAsc", handleInvalid="keep")
    encoder = OneHotEncoder(inputCol="_index", outputCol=output, dropLast=True)
    return Pipeline(stages=[index, encoder]).fit(df).transform(df).drop("_index")


def interaction(vector: Column, i: int = 0, j: int = 1) -> Column:
    """The array with the product of two of its elements appended."""
    return F.concat(vector, F.array(F.get(vector, F.lit(i)) * F.get(vector, F.lit(j))))
