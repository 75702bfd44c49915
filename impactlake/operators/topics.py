"""Topics of documents with embeddings: reduced, clustered and named by class-based TF-IDF."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impactlake.operators.density import density_clusters
from impactlake.sources.shared import saved

#: How many topics and words each preset has.
PRESETS = {"coarse": (5, 10), "default": (10, 10), "fine": (25, 10)}


def topics(documents: DataFrame, idx: str = "idx", embedding: str = "embedding", preset: str = "default", dims: int = 5, seed: int = 42) -> DataFrame:
    """idx, topic (from 0, the largest first), probability (softmax of negative distances to all centres), by PCA and k-means.

    Every document has a topic; density_topics() finds outliers. At least five documents are needed.
    """
    k, _ = PRESETS[preset]
    there = saved(documents.filter(F.col(embedding).isNotNull()).select(idx, F.col(embedding).cast("array<double>").alias("v")), "embeddings")
    rows, n = there.select(idx, array_to_vector("v").alias("v")), there.count()
    if n < 5:
        raise ValueError("topics need five documents")
    reduced = PCA(k=dims, inputCol="v", outputCol="x").fit(rows).transform(rows)
    model = KMeans(k=min(k, n), seed=seed, featuresCol="x", predictionCol="c").fit(reduced)
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array(F.col("x"))
    near = [F.exp(-F.sqrt(sum((x[i] - float(c[i])) * (x[i] - float(c[i])) for i in range(dims)))) for c in model.clusterCenters()]
    found = model.transform(reduced).select(idx, "c", (F.greatest(*near, F.lit(0.0)) / sum(near, F.lit(0.0))).alias("probability"))
    sizes = found.groupBy("c").agg(F.count("*").alias("n")).withColumn("topic", F.row_number().over(Window.orderBy(F.col("n").desc(), "c")) - 1)  # a row a topic
    return found.join(F.broadcast(sizes.select("c", "topic")), "c").select(idx, "topic", "probability")


def density_topics(documents: DataFrame, idx: str = "idx", embedding: str = "embedding", least: int = 10, dims: int = 5, cells: int = 1024) -> DataFrame:
    """idx, topic (from 0, the largest first; -1 for outliers), probability, by PCA and density clusters of at least `least` documents.

    topics() deals every document to a centre; here the number of topics comes from the data and outliers have none. Null
    embeddings are left out; at least five documents are needed. Working tables stay in the shared folder.
    """
    there = saved(documents.filter(F.col(embedding).isNotNull()).select(idx, F.col(embedding).cast("array<double>").alias("v")), "embeddings")
    if there.limit(5).count() < 5:
        raise ValueError("topics need five documents")
    from pyspark.ml.functions import vector_to_array

    rows = there.select(idx, array_to_vector("v").alias("v"))
    reduced = saved(PCA(k=dims, inputCol="v", outputCol="x").fit(rows).transform(rows).select(idx, vector_to_array("x").alias("x")), "reduced")
    return density_clusters(reduced, idx, "x", least, cells=cells).select(idx, F.col("cluster").cast("int").alias("topic"), "probability")


def topic_words(texts: DataFrame, assigned: DataFrame, idx: str = "idx", text: str = "text", words: int = 10) -> DataFrame:
    """topic, position, word, weight: a topic's words of the greatest count in it times log(1 + mean words of a topic / count in all)."""
    each = texts.join(assigned.select(idx, "topic"), idx).select("topic", F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)).alias("word"))
    counts = each.groupBy("topic", "word").agg(F.count("*").alias("n"))
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("f"))
    mean = counts.groupBy("topic").agg(F.sum("n").alias("a")).agg(F.avg("a").alias("mean"))  # one row
    size = counts.groupBy("topic").agg(F.sum("n").alias("a"))
    weight = F.col("n") / F.col("a") * F.log(1 + F.col("mean") / F.col("f"))
    rows = counts.join(everywhere, "word").join(size, "topic").crossJoin(F.broadcast(mean)).withColumn("weight", weight)
    position = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("weight").desc(), "word"))
    return rows.withColumn("position", position).filter(F.col("position") <= words).select("topic", "position", "word", "weight")


def topic_table(assigned: DataFrame, words: DataFrame) -> DataFrame:
    """Topic, Count, Name: a topic's documents, and its number with its first four words."""
    counts = assigned.groupBy("topic").agg(F.count("*").alias("Count"))
    first = words.filter("position <= 4").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("position", "word"))).alias("w"))  # four at most
    name = F.concat_ws("_", F.col("topic").cast("string"), F.transform(F.coalesce("w", F.array()), lambda x: x["word"]))
    return counts.join(first, "topic", "left").select(F.col("topic").alias("Topic"), "Count", name.alias("Name"))


def write_topics(assigned: DataFrame, words: DataFrame, folder: str, idx: str = "idx") -> None:
    """Two folders of CSV files with headers: doc_topics (doc_id, topic, probability) and topics (topic_table())."""
    assigned.select(F.col(idx).alias("doc_id"), "topic", "probability").write.mode("overwrite").csv(f"{folder}/doc_topics", header=True)
    topic_table(assigned, words).write.mode("overwrite").csv(f"{folder}/topics", header=True)
