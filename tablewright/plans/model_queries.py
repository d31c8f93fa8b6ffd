"""Queries of model training, clusters and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows
from tablewright.operators import evaluation, training
from tablewright.sources.ledger import new_ledger
from tablewright.sources.shared import delete, written
from tablewright.streaming import feeds, reports

FEATURES = ["n_chars", "n_words", "n_symbols", "n_capitals", "mean_length"]


def _labelled(spark: SparkSession, sf_dir: str, folds: int = 3) -> DataFrame:
    """Documents with a quality label, simple features and folds by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.greatest(F.size(F.split("text", r"\s+")), F.lit(1))
    d = docs.select("doc_id", "source", "lang", F.length("text").alias("n_chars"), n.alias("n_words"), (F.regexp_count("text", F.lit("[#*$%&|<>]")) / n).alias("n_symbols"), (F.regexp_count("text", F.lit("[A-Z]")) / n).alias("n_capitals"), (F.length("text") / n).alias("mean_length"))
    d = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return evaluation.grouped_stratified_folds(d, "source", "quality", folds)


def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each candidate on each fold, no source on both sides."""
    m = training.feature_matrix(_labelled(spark, sf_dir), FEATURES, "quality", ["doc_id", "fold"])
    m = written(m)
    out = None
    for name, model in training.candidates().items():
        one = training.fold_metrics(training.out_of_fold(m, model, "fold"), "fold").withColumn("candidate", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 settings of a forest by mean average precision over five folds, the chosen one marked."""
    m = training.feature_matrix(_labelled(spark, sf_dir, 5), FEATURES, "quality", ["fold"]).persist()
    grid = {"maxDepth": [2, 3, 4, 5, 6], "numTrees": [5, 10, 20], "minInstancesPerNode": [1, 4, 16]}
    found, drawn = training.random_search(m, training.candidates()["forest"], grid, "fold")
    best = max(range(len(drawn)), key=lambda i: found.avgMetrics[i])
    rows = [(i, *(d[k] for k in sorted(grid)), round(float(v), 9), i == best) for i, (d, v) in enumerate(zip(drawn, found.avgMetrics, strict=True))]
    m.unpersist()
    return spark.createDataFrame(rows, "draw int, max_depth int, min_instances int, trees int, average_precision double, chosen boolean")


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language distribution from a text classifier; classes in the order of the index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = training.text_classifier("text", "lang").fit(docs.where("doc_id % 2 = 0"))
    return training.scored(model, docs, [*model.stages[4].labels, "unknown"], ["doc_id"])


def signature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.detect_signatures(written(_labelled(spark, sf_dir)), FEATURES, "quality", "fold")


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings lie in all directions, so this distance is a large one and most cells touch."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return training.dense_clusters(training.unit_vectors(e, "embedding"), "vec_id", 1.15).select("vec_id", "label", "cluster")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a letter, as unit vectors of how often each of a to z is in them."""
    def counter():
        def count(text: bytes) -> list[float]:
            return np.bincount(np.frombuffer(text, np.uint8), minlength=123)[97:123].astype(float).tolist()

        return lambda rows: {"doc_id": rows["doc_id"], "letters": [count(t) for t in rows["text"]]}

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    d = d.where(F.col("text").rlike("[a-z]")).withColumn("text", F.col("text").cast("binary"))
    return training.unit_vectors(map_rows(d, counter, "doc_id long, letters array<double>"), "letters").select("doc_id", "unit")


def letter_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents of nearly the same letters."""
    return training.dense_clusters(written(_letters(spark, sf_dir)), "doc_id", 0.05).select("doc_id", "cluster")


def _quality(df: DataFrame) -> DataFrame:
    return training.cluster_quality(df).select(F.round("coverage", 9).alias("coverage"), "clusters", F.round("silhouette", 6).alias("silhouette"))


def letter_cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette and coverage of the clusters that were found."""
    letters = written(_letters(spark, sf_dir))
    out = _quality(training.dense_clusters(letters, "doc_id", 0.05))
    delete(letters)
    return out


def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of the labels that come with the embeddings."""
    e = training.unit_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    return _quality(e.withColumn("cluster", F.col("label").cast("long")))


def streamed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and day, counted by a stream."""
    return feeds.run_available(feeds.windowed_counts(feeds.event_stream(spark, sf_dir), "ts", ["event_type"], "1 day", "2 days"), "complete")


def streamed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over the latest events of each type, from the stream."""
    s = feeds.event_stream(spark, sf_dir).select(F.col("event_type").alias("track"), "ts", "event_id", "value")
    return reports.rolling_reports(s, new_ledger(spark)).withColumnRenamed("track", "event_type").withColumn("mean_value", F.round("mean_value", 6))


QUERIES = {f.__name__: f for f in (out_of_fold_scores, random_search, class_scores, signature_report, embedding_clusters, letter_clusters, letter_cluster_quality, cluster_quality, streamed_rate, streamed_reports)}

_UNIT = "u AS (SELECT * REPLACE (list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v) FROM w WHERE list_inner_product(v, v) > 0)"
_EMBEDDINGS = f"w AS (SELECT vec_id AS k, label, embedding::DOUBLE[] AS v FROM embeddings), {_UNIT}"
_LETTERS = f"w AS (SELECT doc_id AS k, list_transform(range(97, 123), lambda c: (length(text) - length(replace(lower(text), chr(c::INT), '')))::DOUBLE) AS v FROM documents WHERE text IS NOT NULL), {_UNIT}"


def _clusters(distance: float) -> str:
    """CTEs up to `c` (k, cluster), from u (k, v)."""
    return f"""near AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k AND list_distance(a.v, b.v) <= {distance}), core AS (SELECT a AS k FROM near GROUP BY 1 HAVING count(*) >= 3),
        l AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)), r AS (SELECT k AS a, k AS b FROM core UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        g AS (SELECT a AS k, min(b) AS cluster FROM r GROUP BY 1), rim AS (SELECT a AS k, min(cluster) AS cluster FROM near JOIN g ON near.b = g.k WHERE a NOT IN (FROM core) GROUP BY 1),
        al AS (FROM g UNION ALL FROM rim), c AS (SELECT u.* EXCLUDE (v), v, coalesce(s.cluster, -1) AS cluster FROM u LEFT JOIN (SELECT * FROM al WHERE cluster IN (SELECT cluster FROM al GROUP BY 1 HAVING count(*) >= 4)) s USING (k))"""


_SILHOUETTE = """x AS (SELECT k, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c WHERE cluster >= 0), n AS (SELECT cluster, count(*) AS n FROM c WHERE cluster >= 0 GROUP BY 1),
        m AS (SELECT cluster, i, avg(x) AS m FROM x GROUP BY 1, 2), far AS (SELECT x.k, x.cluster AS own, m.cluster AS c, 1 - sum(x * m) AS d FROM x JOIN m USING (i) GROUP BY 1, 2, 3),
        p AS (SELECT k, max(n) AS n, max(CASE WHEN c = own THEN d * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> own THEN d END) AS b FROM far JOIN n ON n.cluster = own GROUP BY 1),
        s AS (SELECT avg(CASE WHEN n = 1 OR a = b THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM p)
        SELECT round(avg((cluster >= 0)::INT), 9) AS coverage, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS clusters, round((SELECT s FROM s), 6) AS silhouette FROM c"""

ORACLE_SQL = {
    "embedding_clusters": f"WITH RECURSIVE {_EMBEDDINGS}, {_clusters(1.15)} SELECT k AS vec_id, label, cluster FROM c",
    "letter_clusters": f"WITH RECURSIVE {_LETTERS}, {_clusters(0.05)} SELECT k AS doc_id, cluster FROM c",
    "letter_cluster_quality": f"WITH RECURSIVE {_LETTERS}, {_clusters(0.05)}, {_SILHOUETTE}",
    "cluster_quality": f"WITH {_EMBEDDINGS}, c AS (SELECT *, label AS cluster FROM u), {_SILHOUETTE}",
    "streamed_rate": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "streamed_reports": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events),
        r AS (SELECT n.*, k AS report FROM n, range(100000) AS t(k) WHERE k * 30 < n AND n <= k * 30 + 60 AND k * 30 + 60 <= total AND k <= n / 30) SELECT event_type, report, count(*) AS n, min(event_id) AS first, max(event_id) AS last, round(avg(value), 6) AS mean_value FROM r GROUP BY 1, 2""",
}
