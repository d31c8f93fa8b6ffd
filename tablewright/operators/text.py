"""Subject areas: table documents, relational TF-IDF, topic keywords, labels and training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.evaluation import first_rows
from tablewright.sources.shared import written


def table_documents(columns: DataFrame, table: Sequence[str] = ("database", "schema", "table_name")) -> DataFrame:
    """Column names in ordinal order, and a description, for each table."""
    d = columns.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("c"))
    d = d.withColumn("columns", F.array_join(F.transform("c", lambda x: x["column_name"]), ", ")).drop("c")
    return d.withColumn("description", F.concat(F.regexp_replace("table_name", "_", " "), F.lit(": "), "columns"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def char_ngrams(text: Column, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """Character n-grams inside each word, padded by a space at both ends; a padded word shorter than n is one gram."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        grams = [F.when(F.length(padded) <= n, F.array(padded)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: padded.substr(i, F.lit(n)))) for n in sizes]
        return F.concat(*grams)

    return F.flatten(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), of_word))


def tf_idf(docs: DataFrame, key: str, terms: Column, min_df: int = 1) -> DataFrame:
    """(key, term, weight): sublinear counts times smoothed inverse document frequency, to unit length.

    Terms are counted for each document before any join; a term in fewer than min_df documents is no feature. The documents' texts are
    shuffled once, by key, and counted there. Document frequencies are written, so that their size decides how they are joined: while they
    can be broadcast, no row of a document and term is ever shuffled, else each is twice.
    """
    tf = docs.repartition(key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = written(tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    w = tf.join(df, "term").join(n).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def topic_keywords(docs: DataFrame, topic: str, terms: Column, top: int = 8) -> DataFrame:
    """c-TF-IDF: a topic's documents as one; term share in the topic times log(1 + mean topic size / term count), the best `top`."""
    tf = docs.select(topic, F.explode(terms).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy(topic).agg(F.sum("tf").alias("size"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    mean = F.broadcast(size.agg(F.avg("size").alias("mean")))
    d = tf.join(size, topic).join(total, "term").join(mean).withColumn("weight", F.round(F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("total")), 9))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= top).select(topic, "term", "weight", "rank")


def representatives(docs: DataFrame, key: str, topic: str, terms: Column, keywords: DataFrame, top: int = 3) -> DataFrame:
    """Of each topic the `top` documents whose terms are most of all its keywords, by their weights: topic, key, score, rank.

    The score is the share of a document's terms that are keywords, each times its weight; ties by key. keywords: topic, term, weight. They are
    written, a few rows a topic, so that their size decides how they are joined. A task cuts its documents down to counts of their keywords, and
    of all other terms together, before anything is shuffled.
    """
    known = written(keywords.select(topic, "term", "weight"))
    found = docs.where(F.col(key).isNotNull()).select(key, topic, F.explode(terms).alias("term")).join(known, [topic, "term"], "left")
    tf = found.groupBy(key, topic, F.when(F.col("weight").isNotNull(), F.col("term")).alias("term"), "weight").agg(F.count("*").alias("tf"))
    d = tf.groupBy(key, topic).agg(F.sum("tf").alias("size"), F.sum(F.col("tf") * F.col("weight")).alias("hit")).where("hit is not null")
    return first_rows(d.select(topic, key, F.round(F.col("hit") / F.col("size"), 9).alias("score")), [topic], [F.desc("score"), key], top)


def label_lookup(keywords: DataFrame, cache: DataFrame, topic: str) -> DataFrame:
    """Each topic's label by its keywords' key; topic_<id> where the cache has none, outlier for topic -1."""
    k = keywords.groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "|").alias("keyword_key"))
    label = F.when(F.col(topic).cast("string") == "-1", "outlier").otherwise(F.coalesce("label", F.concat(F.lit("topic_"), F.col(topic).cast("string"))))
    return k.join(cache, "keyword_key", "left").select(topic, "keyword_key", label.alias("label"))


def clean_label(raw: Column) -> Column:
    """The first line, without a prefix or quotes, five words at most."""
    line = F.trim(F.split(F.trim(raw), "\n")[0])
    line = F.regexp_replace(line, r"(?i)^(label|name|topic|subject area)\s*:\s*", "")
    line = F.trim(F.regexp_replace(line, "[\"'`*]", ""))
    return F.array_join(F.slice(F.split(line, r"\s+"), 1, 5), " ")


def supervised_set(rows: DataFrame, area: str, least: int = 4) -> DataFrame:
    """Rows of named areas (equal names are one), but for outliers and areas with too few."""
    d = rows.where(F.col(area) != "outlier").withColumn("_n", F.count("*").over(Window.partitionBy(area)))
    return d.where(F.col("_n") >= least).drop("_n")


def stratified_split(rows: DataFrame, target: str, identity: Sequence[str], test_share: float = 0.25) -> DataFrame:
    """train or test within each class, by a hash of the row's identity."""
    place = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in identity)).cast("binary"))
    d = rows.withColumn("_part", F.substring(place, 1, 3)).withColumn("_place", place)  # no task sorts a class: 4,096 parts by hash, and their sums
    parts = d.groupBy(target, "_part").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(target).orderBy("_part")
    parts = parts.select(F.col(target).alias("_target"), F.col("_part").alias("_at"), (F.sum("_k").over(before) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy(target)).alias("_n"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(target, "_part").orderBy("_place"))).join(parts, F.col(target).eqNullSafe(F.col("_target")) & (F.col("_part") == F.col("_at")))
    return d.withColumn("split", F.when(F.col("_r") + F.col("_before") <= F.ceil(F.col("_n") * test_share), "test").otherwise("train")).drop("_r", "_n", "_before", "_part", "_place", "_target", "_at")
