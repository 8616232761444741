"""Classifiers and clusters over the tables, by pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.session import durable, table


def text_classifier(kind: str, features: int = 4096) -> Pipeline:
    """Words, hashed counts and, for the logistic one, inverse document frequency."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=features)
    if kind == "bayes":
        return Pipeline(stages=[words, tf, NaiveBayes(featuresCol="tf", labelCol="label", smoothing=1.0)])
    return Pipeline(stages=[words, tf, IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", maxIter=20, regParam=0.1)])


def metrics(predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, and over all of them the share of right answers and the mean F1."""
    per = predicted.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    classes = per.groupBy("label").agg(F.sum("n").alias("there"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = per.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    p, r = F.col("hit") / F.col("said"), F.col("hit") / F.col("there")
    rows = classes.join(said, "label", "left").select("label", "there", "hit", F.coalesce(p, F.lit(0.0)).alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
    all_of = rows.agg((F.sum("hit") / F.sum("there")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return rows.drop("hit").crossJoin(F.broadcast(all_of))


def _toxic(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents to learn from, and a third that learning does not see."""
    rows = table(spark, sf, "labels").where("toxic IS NOT NULL").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return rows.where(~held), rows.where(held)


def evaluate(spark, sf: str, kind: str) -> DataFrame:
    """Toxicity of the labelled documents, measured on a third that fitting does not see."""
    known, held = _toxic(spark, sf)
    return metrics(text_classifier(kind).fit(known).transform(held).select("label", "prediction"))


def classify(docs: DataFrame, model, key: str = "doc_id") -> DataFrame:
    """``(key, class, proba)`` of every row by a fitted classifier; nulls where there is no ``model`` or no text."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return docs.select(key, F.lit(None).cast("int").alias("class"), F.lit(None).cast("double").alias("proba"))
    said = model.transform(docs.select(key, F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("_there")))
    best = F.array_max(vector_to_array("probability"))
    return said.select(key, F.when(F.col("_there"), F.col("prediction").cast("int")).alias("class"), F.when(F.col("_there"), best).alias("proba"))


def classify_documents(spark, sf: str, kind: str) -> DataFrame:
    """Every document's toxicity class and its probability, learned from the labelled ones that are not held out."""
    known, _ = _toxic(spark, sf)
    return classify(table(spark, sf, "documents").select("doc_id", "text"), text_classifier(kind).fit(known))


def clusters(vectors: DataFrame, k: int = 10) -> DataFrame:
    """How many vectors of each label fall in each cluster."""
    v = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return KMeans(k=k, seed=1, maxIter=15).fit(v).transform(v).groupBy("prediction", "label").agg(F.count("*").alias("n"))


def dbscan(points: DataFrame, key: str, x: str, y: str, eps: float, least: int) -> DataFrame:
    """``(key, cluster)`` of points in a plane; ``cluster`` is the least core place's number in it, -1 for noise, null without coordinates.

    A place with ``least`` points or more within ``eps``, itself counted, is a core; cores within ``eps`` are one cluster; any other place
    within ``eps`` of a core is in the cluster of the nearest core, ties to the smaller number. Points at one place count as one row with its
    number of points, and places meet by a grid of cells of side ``eps``; a crowded cell is a hot key of a join, which AQE splits.
    """
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    places = durable(at.groupBy("_x", "_y").agg(F.min(key).alias("_p"), F.count("*").alias("_n")))
    cell = lambda c, d: (F.floor(F.col(c) / eps) + d)
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = places.select(F.col("_p").alias("p"), F.col("_x").alias("x1"), F.col("_y").alias("y1"), cell("_x", 0).alias("cx"), cell("_y", 0).alias("cy"))
    b = places.select("*", F.explode(shifts).alias("s")).select(F.col("_p").alias("q"), F.col("_n").alias("n"), F.col("_x").alias("x2"), F.col("_y").alias("y2"), cell("_x", F.col("s.i")).alias("cx"), cell("_y", F.col("s.j")).alias("cy"))
    d2 = (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2"))
    near = durable(a.join(b, ["cx", "cy"]).select("p", "q", "n", d2.alias("d")).where(F.col("d") <= eps * eps))
    core = durable(near.groupBy("p").agg(F.sum("n").alias("around")).where(F.col("around") >= least).select("p"))
    links = near.join(core, "p", "left_semi").join(core.withColumnRenamed("p", "q"), "q", "left_semi").select(F.col("p").alias("src"), F.col("q").alias("dst"))
    of_core = durable(core.join(connected_components(links).withColumnRenamed("node", "p"), "p", "left").select("p", F.coalesce("component", "p").alias("cluster")))
    edge = near.join(of_core.select(F.col("p").alias("q"), F.col("cluster").alias("c")), "q").groupBy("p").agg(F.min_by("c", F.struct("d", "q")).alias("c"))
    of_place = places.select("_x", "_y", F.col("_p").alias("p")).join(of_core, "p", "left").join(edge, "p", "left").select("_x", "_y", F.coalesce("cluster", "c", F.lit(-1)).alias("cluster"))
    out = points.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return out.join(of_place, ["_x", "_y"], "left").select(key, "cluster")
