"""Votes, folds, weights, metrics and gates of model runs, as aggregations and windows over prediction tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.ranked import running_sums
from tablewright.sources.shared import delete, written


def soft_vote(predictions: DataFrame, table: Sequence[str] = ("table_name",)) -> DataFrame:
    """Mean of the columns' class distributions for each table, and its best class, the lowest of equals.

    predictions: table columns and probabilities (map of class to probability; null: not scored, left out). A class that a column's map
    lacks is passed over there, not counted as 0. normalized: the best class is 3.
    """
    t, scored = list(table), predictions.where("probabilities is not null and size(probabilities) > 0")
    n = scored.groupBy(*t).agg(F.count("*").alias("n_columns"))
    mean = scored.select(*t, F.explode("probabilities").alias("class", "p")).groupBy(*t, "class").agg(F.avg("p").alias("p"))
    best = mean.groupBy(*t).agg(F.max_by("class", F.struct(F.round("p", 12), -F.col("class").cast("int"))).alias("prediction"), F.max("p").alias("confidence"))
    d = best.join(n, t).withColumn("confidence", F.bround("confidence", 4))
    return d.withColumn("prediction", F.col("prediction").cast("int")).withColumn("normalized", F.col("prediction") == 3)


def rule_cross_check(votes: DataFrame, rules: DataFrame, table: Sequence[str] = ("table_name",), few: int = 30) -> DataFrame:
    """Whether the rule's reading agrees, and why a table needs review. rules: rule_normal_form, row_count, constant_columns."""
    d = votes.join(rules, list(table), "left").withColumn("rule_agrees", F.col("rule_normal_form") == F.col("prediction"))
    differ = F.when(~F.col("rule_agrees"), F.concat(F.lit("rule says "), F.col("rule_normal_form").cast("string")))
    small = F.when(F.col("row_count") < few, F.lit("few rows"))
    note = F.when(F.size("constant_columns") > 0, F.concat(F.lit("constant: "), F.array_join(F.array_sort("constant_columns"), ",")))
    return d.withColumn("needs_review", F.coalesce(differ.isNotNull() | small.isNotNull(), F.lit(False))).withColumn("review_reason", F.concat_ws("; ", differ, small, note))


def hard_vote(predictions: DataFrame, table: Sequence[str] = ("table_name",)) -> DataFrame:
    """The class that most columns got, the lowest of equals."""
    c = predictions.groupBy(*table, "prediction").agg(F.count("*").alias("n"))
    return c.groupBy(*table).agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("vote"))


def failure_report(failures: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent kinds of failure by the text of the reason. failures: reason."""
    r = F.lower("reason")
    kind = F.when(r.rlike("no such model|model .* not found"), "missing model").when(r.rlike("alias"), "missing alias").when(r.rlike("refused|timeout|unreachable"), "unreachable").otherwise("other")
    d = failures.select(kind.alias("kind"), "reason").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("reason").alias("reasons"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "kind"))).where(F.col("rank") <= top)


def grouped_stratified_folds(rows: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """A fold for each row, so that no group is in two folds and classes stay balanced: groups with most positives first are dealt
    back and forth over the folds. One task deals the groups, a row for each."""
    g = rows.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    order = Window.orderBy(F.desc("pos"), F.desc("n"), F.md5(F.col(group).cast("string").cast("binary")))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(2 * k))
    g = g.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return rows.join(g, group)


#: Groups that one task deals: the largest ones; with more, a hash deals the others to tasks, each of which balances its own.
DEAL = 10_000


def balanced_folds(rows: DataFrame, group: str, label: str, k: int = 5, deal: int = DEAL) -> DataFrame:
    """A fold for each row, so that no group is in two folds and every class is spread evenly, also where groups are of very different size.

    Groups, largest first, go one by one to the fold in which the squares of the folds' shares of each class then grow least, the first of
    equals. Among the `deal` largest groups a fold's share of a class differs from 1 / k by no more than about the largest group's share of it; all
    others are smaller than these, and their tasks begin at different folds. Null groups
    and labels are a group and a class. Only a row for each group and class, with its count, leaves the tables.
    """
    c = rows.groupBy(F.col(group).alias("_of"), F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n"))
    totals = {r["c"]: r["n"] for r in c.groupBy("c").agg(F.sum("n").alias("n")).orderBy("c").collect()}  # a row for each class
    groups = c.groupBy("_of").agg(F.collect_list(F.struct("c", "n")).alias("counts"), F.sum("n").alias("size"))
    groups = groups.withColumn("tie", F.md5(F.coalesce(F.col("_of").cast("string"), F.lit("")).cast("binary")))
    n = groups.count()
    if n <= deal:
        groups = groups.withColumn("task", F.lit(0).cast("long"))
    else:
        edge = groups.orderBy(F.desc("size"), "tie").limit(deal).agg(F.min("size").alias("size")).first()["size"]
        others = 1 + F.pmod(F.xxhash64("_of"), F.lit(math.ceil(n / deal)))
        groups = groups.withColumn("task", F.when(F.col("size") > edge, F.lit(0)).otherwise(others).cast("long"))
    place, total = {name: i for i, name in enumerate(totals)}, [float(n) for n in totals.values()]
    kind = rows.schema[group].dataType.simpleString()

    def dealt(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie"], ascending=[False, True], ignore_index=True)
        turn = int(pdf["task"][0]) % k
        load, folds = [[0.0] * len(total) for _ in range(k)], []
        for counts in pdf["counts"]:
            mine = [(place[x["c"]], float(x["n"])) for x in counts]
            mine.sort()
            cost = [sum((2 * held[i] + n) * n / (total[i] * total[i]) for i, n in mine) for held in load]
            fold = (cost[turn:] + cost[:turn]).index(min(cost))
            fold = (fold + turn) % k
            for i, n in mine:
                load[fold][i] += n
            folds.append(fold)
        return pd.DataFrame({"_of": pdf["_of"], "fold": folds})

    folds = groups.groupBy("task").applyInPandas(dealt, f"_of {kind}, fold int")
    return rows.join(folds, rows[group].eqNullSafe(folds["_of"])).drop("_of")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    c = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return c.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def curve(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Precision, recall and F1 at each distinct score as threshold.

    Rows are counted for each distinct score, and scores are ranked range by range, so that no task sees all of them.
    """
    b = list(by)
    at = scored.groupBy(*b, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    d = running_sums(at, score, ["pos", "n"], b, descending=True).withColumnsRenamed({"pos_upto": "tp", "n_upto": "predicted", "pos_all": "positives"})
    d = d.withColumn("precision", F.col("tp") / F.col("predicted")).withColumn("recall", F.coalesce(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0)))
    return d.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("positives"), F.lit(0)), F.lit(0.0))).select(*b, score, "pos", "n", "tp", "predicted", "positives", "precision", "recall", "f1")


def average_precision(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """The step sum of precision over recall gained at each distinct score."""
    c = curve(scored, by, label, score)
    gained = F.coalesce(F.col("pos") / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0))
    return c.groupBy(*by).agg(F.sum(gained * F.col("precision")).alias("average_precision"))


def best_threshold(scored: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """The score at which F1 is best; the higher of equals."""
    return curve(scored, by, label, score).groupBy(*by).agg(F.max_by(score, F.struct("f1", score)).alias("threshold"), F.max("f1").alias("f1"))


def binary_metrics(rows: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction", probability: str | None = None) -> DataFrame:
    """Precision, recall, F1, accuracy, and log-loss where a probability of class 1 is given (clipped to 1e-15)."""
    is_, said = F.col(label) == 1, F.col(prediction) == 1
    aggs = [F.count("*").alias("n"), F.count_if(is_ & said).alias("tp"), F.count_if(~is_ & said).alias("fp"), F.count_if(is_ & ~said).alias("fn")]
    if probability:
        p = F.greatest(F.least(F.col(probability), F.lit(1 - 1e-15)), F.lit(1e-15))
        aggs.append(F.avg(-F.when(is_, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
    d = rows.groupBy(*by).agg(*aggs)
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    d = d.select(*by, "n", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), ((F.col("n") - fp - fn) / F.nullif(F.col("n"), F.lit(0))).alias("accuracy"), *(["log_loss"] if probability else []))
    return d


def class_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    c = rows.select(F.col(label).alias("class"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col(label) == F.col(prediction)).cast("int").alias("t")).unionByName(rows.select(F.col(prediction).alias("class"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    d = c.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return d.select("class", "support", over(F.col("tp"), F.col("predicted")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"), over(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def averaged_metrics(per_class: DataFrame) -> DataFrame:
    """Weighted (by support) and macro means."""
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return per_class.agg(*(mean(c) for c in ("precision", "recall", "f1")), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(label, prediction).agg(F.count("*").alias("n"))


def fold_summary(metrics: DataFrame, by: Sequence[str] = (), value: str = "f1") -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def error_buckets(rows: DataFrame, flags: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rates of the flags in true positives, false positives and false negatives."""
    return rows.withColumn("bucket", error_bucket(label, prediction)).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags))


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], top: int) -> DataFrame:
    """The first rows of each group, with rank. The planner limits the groups before the shuffle, so `top` rows of each leave a task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def error_examples(rows: DataFrame, order: Sequence[str], top: int = 30, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Of the false negatives, false positives and true positives the first `top` rows each, with bucket and rank."""
    d = rows.withColumn("bucket", error_bucket(label, prediction)).where("bucket is not null")
    return first_rows(d, ["bucket"], order, top)


def other_kind_share(rows: DataFrame, others: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """How many false positives there are, and which share of them is a target of some other kind (null if there are none)."""
    other = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in others)) if len(others) > 1 else F.coalesce(F.col(others[0]), F.lit(0))
    return rows.where(error_bucket(label, prediction) == "FP").agg(F.count("*").alias("n"), F.avg((other == 1).cast("double")).alias("other_kind_share"))


def error_bucket(label: str, prediction: str) -> Column:
    return F.when((F.col(label) == 1) & (F.col(prediction) == 1), "TP").when(F.col(prediction) == 1, "FP").when(F.col(label) == 1, "FN")


def top_names(rows: DataFrame, bucket: Column, name: str, top: int = 10) -> DataFrame:
    c = rows.where(bucket).groupBy(name).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), name))).where(F.col("rank") <= top)


def best_candidate(metrics: DataFrame, by: Sequence[str], candidate: str, value: str = "f1") -> DataFrame:
    """The candidate of the best mean, the first by name of equals."""
    m = metrics.groupBy(*by, candidate).agg(F.avg(value).alias("mean"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean"), candidate))).where("rank = 1").drop("rank")


def promotion_gate(dev: DataFrame, prod: DataFrame, fallback: str) -> DataFrame:
    """What becomes of each development version: promote where it is no worse, bootstrap where nothing serves, noop for the same version,
    and missing_metric or no_dev where that is the case. dev, prod: model, version, metric, and the fallback metric."""
    side = lambda d, k: d.select("model", F.col("version").alias(f"{k}_version"), F.coalesce("metric", fallback).alias(f"{k}_metric"))
    d = side(dev, "dev").join(side(prod, "prod"), "model", "full_outer")
    verdict = (
        F.when(F.col("dev_version").isNull(), "no_dev").when(F.col("prod_version").isNull(), "bootstrap").when(F.col("dev_version") == F.col("prod_version"), "noop")
        .when(F.col("dev_metric").isNull() | F.col("prod_metric").isNull(), "missing_metric").when(F.col("dev_metric") >= F.col("prod_metric"), "promote").otherwise("keep")
    )
    return d.withColumn("verdict", verdict)


def baseline_gate(metrics: DataFrame, floors: dict[str, float], least: dict[str, int], most_std: float = 0.10) -> DataFrame:
    """Rows of a metrics table that fall short: a mean under its floor, a spread over most_std, a count under its least."""
    floor = F.coalesce(*(F.when(F.col("name") == k, F.lit(v)) for k, v in {**floors, **{k: float(v) for k, v in least.items()}}.items()))
    return metrics.withColumn("floor", floor).withColumn("passed", F.coalesce(F.col("value") >= F.col("floor"), F.lit(True)) & F.coalesce(F.col("std") < most_std, F.lit(True)))


def split_groups(links: DataFrame, u: str, v: str) -> DataFrame:
    """Connected components over links: (node, component), the smallest node's value. Labels spread by joins, a written table a
    round cuts the lineage."""
    e = links.select(F.col(u).cast("string").alias("a"), F.col(v).cast("string").alias("b")).where("a is not null and b is not null")
    e = written(e.union(e.select("b", "a")).distinct())
    labels = written(e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = written(step.join(jump, "mid", "left").select("node", "old", F.least("mid", "far").alias("component")))
        delete(labels)
        labels, path = step.select("node", "component"), step._written_path
        labels._written_path = path
        if step.where("old <> component").isEmpty():
            delete(e)
            return labels


def one_vs_rest_precision(scored: DataFrame, classes: Sequence[str], label: str = "label", probabilities: str = "probabilities") -> DataFrame:
    """Average precision of each class against the rest, and their mean weighted by support. probabilities: map of class to probability;
    a class that a row's map lacks counts as 0."""
    p = F.explode(F.create_map(*(x for c in classes for x in (F.lit(c), F.coalesce(F.element_at(probabilities, F.lit(c)), F.lit(0.0)))))).alias("class", "score")
    d = scored.select(F.col(label).cast("string").alias("truth"), p).select("class", F.round("score", 12).alias("score"), (F.col("truth") == F.col("class")).cast("int").alias("label"))
    ap = average_precision(d, ["class"]).join(d.groupBy("class").agg(F.sum("label").alias("support")), "class")
    mean = ap.agg(F.lit("weighted").alias("class"), (F.sum(F.col("average_precision") * F.col("support")) / F.sum("support")).alias("average_precision"), F.sum("support").alias("support"))
    return ap.unionByName(mean)


def vote_gate(votes: DataFrame, truth: DataFrame, table: Sequence[str] = ("table_name",), floor: float = 0.92) -> DataFrame:
    """Accuracy of votes over the tables of known form, and whether it reaches the floor. A table without a vote counts as wrong."""
    d = truth.join(votes.select(*table, "prediction"), list(table), "left")
    return d.agg(F.count("*").alias("tables"), F.avg(F.coalesce(F.col("prediction") == F.col("truth"), F.lit(False)).cast("double")).alias("accuracy")).withColumn("passed", F.col("accuracy") >= floor)
