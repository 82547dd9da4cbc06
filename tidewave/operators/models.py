"""Text features and linear models on Spark's own learners."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """Words of two or more letters or digits in lower case, accents of Latin letters removed."""
    bare = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def terms_of(text: Column) -> Column:
    """Words and word pairs."""
    w = plain_words(text)
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, F.slice(pairs, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))


def vocabulary(docs: DataFrame, text: str, least_docs: int, most_share: float, exclude: DataFrame | None = None, size: int = 20000) -> DataFrame:
    """term, index, idf: terms in at least `least_docs` and at most `most_share` of the documents, without a list of excluded terms, the
    most frequent `size` of them (a bound of the model, not of the data). idf = ln((1 + n) / (1 + df)) + 1."""
    counts = docs.select(F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*")).scalar()
    kept = counts.withColumn("n", n).where((F.col("df") >= least_docs) & (F.col("df") <= F.col("n") * most_share))
    if exclude is not None:
        kept = kept.join(exclude.select("term"), "term", "left_anti")
    top = kept.orderBy(F.col("df").desc(), "term").limit(size)
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("index"), (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tf_idf(docs: DataFrame, id_col: str, text: str, terms: DataFrame) -> DataFrame:
    """Long form: id, index, weight: (1 + ln count) idf, scaled to length 1 in each document."""
    counts = docs.select(id_col, F.explode(terms_of(F.col(text))).alias("term")).join(F.broadcast(terms), "term").groupBy(id_col, "index").agg(F.count("*").alias("c"), F.max("idf").alias("idf"))
    w = counts.withColumn("w", (1 + F.ln("c")) * F.col("idf"))
    return w.select(id_col, "index", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))).alias("weight"))


def feature_vectors(weights: DataFrame, id_col: str, n_features: int) -> DataFrame:
    """id, features: one sparse vector a document."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def vector(entries):
        return SparseVector(n_features, [(e[0], e[1]) for e in entries])

    return weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("e")).select(id_col, vector("e").alias("features"))


def dense(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def classifier(train: DataFrame, label: str, regularization: float = 0.0, rounds: int = 100):
    """Logistic regression (multinomial for more than two labels) on `features`."""
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=regularization, maxIter=rounds).fit(train)


def regressor(train: DataFrame, label: str, regularization: float = 0.0):
    return LinearRegression(labelCol=label, featuresCol="features", regParam=regularization, solver="normal").fit(train)


def coefficients(model, spark, names: list[str]) -> DataFrame:
    """label_index, term, coef of a linear model; at most labels x features numbers."""
    rows = []
    if hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        rows = [(i, names[j], float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    else:
        rows = [(0, names[j], float(c)) for j, c in enumerate(model.coefficients)]
    return spark.createDataFrame(rows, "label_index int, term string, coef double")


def extremes(coefs: DataFrame, k: int = 300) -> DataFrame:
    """The k greatest and k least coefficients of each label."""
    up = F.row_number().over(Window.partitionBy("label_index").orderBy(F.col("coef").desc(), "term"))
    down = F.row_number().over(Window.partitionBy("label_index").orderBy(F.col("coef"), "term"))
    return coefs.withColumn("__u", up).withColumn("__d", down).where((F.col("__u") <= k) | (F.col("__d") <= k)).drop("__u", "__d").distinct()


def scored(model, df: DataFrame, of: int = 1) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[of])


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks (ties count half)."""
    from tidewave.operators.stats import average_ranks

    r = average_ranks(df.select(label, score), [], score)
    s = r.agg(F.sum(F.when(F.col(label) == 1, F.col("rank"))).alias("r"), F.sum((F.col(label) == 1).cast("double")).alias("p"), F.sum((F.col(label) == 0).cast("double")).alias("n"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def precision_recall(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per label: precision, recall, f1 and support."""
    hit = F.col(label) == F.col(prediction)
    a = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("support"), F.sum(hit.cast("int")).alias("hits"))
    b = df.groupBy(F.col(prediction).alias("label")).agg(F.count("*").alias("predicted"))
    j = a.join(b, "label", "left")
    j = j.withColumn("precision", F.try_divide(F.col("hits"), F.col("predicted"))).withColumn("recall", F.col("hits") / F.col("support"))
    return j.select("label", "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def r_squared(df: DataFrame, label: str, prediction: str) -> DataFrame:
    m = df.agg(F.avg(label)).scalar()
    return df.withColumn("__m", m).agg((1 - F.try_divide(F.sum(F.pow(F.col(label) - F.col(prediction), 2)), F.sum(F.pow(F.col(label) - F.col("__m"), 2)))).alias("r2"))
