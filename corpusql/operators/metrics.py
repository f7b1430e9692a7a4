"""Prediction records, accuracy metrics, running metrics, failure analysis, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.functions.sqltext import execution_text
from corpusql.operators.matching import exact_match, extract_predictions
from corpusql.operators.queryshape import query_shapes
from corpusql.session import stored

#: Parts that a selection cuts an interval into, and how many values it orders in one task at last.
BINS, FEW = 4096, 4096


def prediction_records(examples: DataFrame, responses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One record per example and mode that ran: prediction and both verdicts.

    ``examples(index, db_id, question, output)``; ``responses(mode, index,
    response, generation_time_s)`` or, already extracted, with ``pred_sql``;
    ``verdicts(mode, index, exec_match, pred_error, db_found)``. An example that a mode
    gave no response for stays, with an empty prediction and no match. A response
    without a verdict is an error of the caller and raises.
    """
    preds = responses if "pred_sql" in responses.columns else extract_predictions(responses)
    modes = preds.select("mode").distinct().agg(F.array_sort(F.collect_list("mode"))).scalar()
    asked = examples.select(F.explode(modes).alias("mode"), "index", "db_id", "question", F.col("output").alias("gold_sql"))
    rec = (asked.join(preds.select("mode", "index", "pred_sql", "generation_time_s", F.lit(True).alias("_answered")),
                      ["mode", "index"], "left")
           .withColumn("pred_sql", F.coalesce("pred_sql", F.lit("")))
           .transform(lambda d: exact_match(d, "gold_sql", "pred_sql"))
           .join(verdicts.select("mode", "index", "exec_match", "pred_error", "db_found"),
                 ["mode", "index"], "left"))
    lost = F.col("_answered") & F.col("db_found").isNull()
    return rec.select(
        "mode", "index", "db_id", "question", "gold_sql", "pred_sql", "exact_match",
        F.when(lost, F.raise_error(F.concat(F.lit("no verdict for example "), F.col("index").cast("string"))).cast("boolean"))
        .otherwise(F.coalesce("exec_match", F.lit(False))).alias("exec_match"),
        F.when(F.col("_answered").isNull(), F.lit("no response")).otherwise(F.col("pred_error")).alias("pred_error"),
        F.round("generation_time_s", 2).alias("generation_time_s"),
        F.coalesce("db_found", F.lit(True)).alias("db_found"))


def verdict_counts(pred: DataFrame, group: list[str]) -> DataFrame:
    """Counts that every accuracy table is made of."""
    err = F.col("pred_error").isNotNull() & F.col("db_found")
    return pred.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count(F.when(F.col("exact_match"), 1)).alias("exact_match_count"),
        F.count(F.when(F.col("exec_match"), 1)).alias("execution_match_count"),
        F.count(F.when(err, 1)).alias("execution_error_count"),
        F.sum(F.col("generation_time_s").cast("decimal(20,2)")).alias("_gen_sum"))


def eval_metrics(predictions: DataFrame) -> DataFrame:
    """Per mode: totals, exact-match and execution accuracy (%), execution
    errors (predicted side, database present), average generation time.

    Ratios are unrounded (round only for display); the generation-time sum is
    exact decimal so the average does not depend on row order. total = 0 -> NULL.
    """
    c = verdict_counts(predictions, ["mode"])
    tot = F.col("total_examples")

    def pct(col):
        return F.when(tot > 0, F.col(col).cast("double") * 100.0 / tot)

    return c.select(
        "mode", "total_examples",
        pct("exact_match_count").alias("exact_match_accuracy"),
        pct("execution_match_count").alias("execution_accuracy"),
        "exact_match_count", "execution_match_count", "execution_error_count",
        pct("execution_error_count").alias("error_rate"),
        F.when(tot > 0, F.col("_gen_sum").cast("double") / tot).alias("avg_generation_time_s"))


def running_metrics(predictions: DataFrame, every: int = 50) -> DataFrame:
    """Cumulative EM %, execution % and error count after example 1 and after
    every ``every``-th example (dense 0-based ``index``).

    Rows are pre-aggregated per (mode, index div every); the running window then
    spans one row per bucket, not one per example.
    """
    b = verdict_counts(predictions.withColumn("_b", F.floor(F.col("index") / every).cast("bigint")), ["mode", "_b"])
    w = Window.partitionBy("mode").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = b.select(
        "mode", "_b", "total_examples",
        *[F.sum(c).over(w).alias(c) for c in
          ("exact_match_count", "execution_match_count", "execution_error_count")],
        F.sum("total_examples").over(w).alias("n_seen"))
    buckets = (cum.where(F.col("total_examples") == every)
               .select("mode", "n_seen", "exact_match_count", "execution_match_count",
                       "execution_error_count"))
    first = (verdict_counts(predictions.where(F.col("index") == 0), ["mode"])
             .select("mode", F.col("total_examples").alias("n_seen"), "exact_match_count",
                     "execution_match_count", "execution_error_count"))
    allr = buckets.unionByName(first).dropDuplicates(["mode", "n_seen"])
    return allr.select(
        "mode", "n_seen",
        (F.col("exact_match_count").cast("double") * 100.0 / F.col("n_seen")).alias("running_em_pct"),
        (F.col("execution_match_count").cast("double") * 100.0 / F.col("n_seen")).alias("running_exec_pct"),
        F.col("execution_error_count").alias("running_errors"))


def mode_comparison(metrics: DataFrame, one: str = "zero-shot", other: str = "few-shot") -> DataFrame:
    """Both accuracies of two modes side by side, ``(metric, one, other, difference)``; empty
    unless both ran."""
    sides = metrics.where(F.col("mode").isin(one, other)).select("mode", F.explode(F.create_map(
        F.lit("exact_match_accuracy"), F.col("exact_match_accuracy"),
        F.lit("execution_accuracy"), F.col("execution_accuracy"))).alias("metric", "value"))
    return (sides.groupBy("metric").agg(
        F.max(F.when(F.col("mode") == one, F.col("value"))).alias("one"),
        F.max(F.when(F.col("mode") == other, F.col("value"))).alias("other"), F.count("*").alias("_n"))
        .where("_n = 2").select("metric", "one", "other", (F.col("other") - F.col("one")).alias("difference")))


def model_comparison(predictions: DataFrame, model_col: str = "model") -> DataFrame:
    """Model x metric table: one row per model and mode with both accuracies."""
    tot = F.col("total_examples")
    return verdict_counts(predictions, [model_col, "mode"]).select(
        model_col, "mode",
        (F.col("exact_match_count").cast("double") * 100.0 / tot).alias("exact_match_accuracy"),
        (F.col("execution_match_count").cast("double") * 100.0 / tot).alias("execution_accuracy"))


def failure_sample(predictions: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` records (by index) with a failed execution match, per mode, plus
    the mode's total number of failures. ``row_number() <= n`` lets Spark apply a
    per-task group limit before the shuffle, so a hot mode ships n rows per task."""
    fails = predictions.where(~F.col("exec_match"))
    w = Window.partitionBy("mode").orderBy("index")
    top = fails.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
    totals = fails.groupBy("mode").agg(F.count("*").alias("n_failures"))
    return top.join(totals, "mode").select(
        "mode", "rank", "index", "db_id", "gold_sql", "pred_sql", "pred_error",
        "exact_match", "exec_match", "n_failures")


def error_category() -> F.Column:
    """Rule chain (first hit wins) over the six fixed category names, from the verdicts and the shapes of both
    texts (``gold_`` and ``pred_`` with ``tables``, ``joins``, ``aggregates``). A missing database is
    no error of the prediction, so its text alone decides; a text that is no query has an empty shape."""
    err = F.when(F.col("db_found"), F.col("pred_error"))

    def differ(name: str, empty) -> F.Column:
        return F.coalesce(f"gold_{name}", empty) != F.coalesce(f"pred_{name}", empty)
    none = F.array().cast("array<string>")
    return (F.when(err.rlike("UNRESOLVED_COLUMN|TABLE_OR_VIEW_NOT_FOUND"), F.lit("schema_misunderstanding"))
            .when(err.isNotNull(), F.lit("invalid_sql"))
            .when(F.col("exec_match") & ~F.col("exact_match"), F.lit("false_negative_exact_match"))
            .when(~F.col("db_found") & F.col("exact_match"), F.lit("other"))
            .when(differ("joins", F.lit(0)) | differ("tables", none), F.lit("wrong_join"))
            .when(differ("aggregates", none), F.lit("wrong_aggregation"))
            .otherwise(F.lit("other")))


def error_buckets(predictions: DataFrame, per_bucket: int = 2) -> DataFrame:
    """Failures (not both matches) per (mode, category): count and the first
    ``per_bucket`` example indices. Tables, joins and aggregates are read from the parsed texts, each
    different one parsed once."""
    fails = predictions.where(~(F.col("exact_match") & F.col("exec_match"))).select(
        "mode", "index", "db_found", "pred_error", "exact_match", "exec_match",
        execution_text("gold_sql").alias("gold_text"), execution_text("pred_sql").alias("pred_text"))
    fails = stored(fails, "failures")
    shapes = query_shapes(fails.select(F.col("gold_text").alias("sql")).union(fails.select("pred_text")))
    for side in ("gold", "pred"):
        named = shapes.select(F.col("sql").alias(f"{side}_text"), *(F.col(c).alias(f"{side}_{c}") for c in ("tables", "joins", "aggregates")))
        fails = fails.join(named, f"{side}_text", "left")
    fails = stored(fails.select("mode", "index", error_category().alias("category")), "categories")
    counts = fails.groupBy("mode", "category").agg(F.count("*").alias("n_examples"))
    w = Window.partitionBy("mode", "category").orderBy("index")
    reps = (fails.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_bucket)
            .groupBy("mode", "category").agg(F.array_sort(F.collect_list("index")).alias("examples")))
    return counts.join(reps, ["mode", "category"])


def _bin(v, lo, hi) -> F.Column:
    """Place of ``v`` among ``BINS`` equal parts of ``lo`` to ``hi``, never falling as ``v`` grows; infinite values and NaN
    have places of their own. Halves keep the span of the largest doubles finite."""
    span = hi / 2 - lo / 2
    part = F.when(span > 0, F.floor((v / 2 - lo / 2) / F.when(span > 0, span) * BINS)).otherwise(0)
    return (F.when(F.isnan(v), BINS + 2).when(v == float("inf"), BINS + 1).when(v == float("-inf"), -1)
            .otherwise(part).cast("int"))


def selected(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(g, rank, v)``: the value at each wanted place, from 0, in the order of its group's values.

    ``values(g, v)``, ``wanted(g, rank)``. No value moves to be sorted: a histogram over a group's range
    finds the bin that holds a rank, and the next histogram is over that bin only, from its
    least to its largest value, until a bin holds one value or at most ``FEW`` of them. What is
    shuffled are bin counts, at most ``BINS + 3`` per task and interval.
    """
    finite = (F.col("v") > float("-inf")) & (F.col("v") < float("inf"))
    bounds = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                     F.min(F.when(finite, F.col("v"))).alias("from"), F.max(F.when(finite, F.col("v"))).alias("to"))
    zero = F.lit(0).cast("bigint")
    state = stored(wanted.join(bounds, "g").select("g", "rank", zero.alias("skip"), "n", "lo", "hi",
                                                   *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("from", "to"))), "selection")
    interval = ["g", "lo", "hi"]

    def within(intervals: DataFrame) -> DataFrame:
        return values.join(intervals, "g").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    while True:
        open_ = state.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if not open_.limit(1).count():
            break
        counts = (within(open_.select(*interval, "from", "to").distinct())
                  .groupBy(*interval, _bin(F.col("v"), F.col("from"), F.col("to")).alias("bin"))
                  .agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))
        upto = F.sum("c").over(Window.partitionBy(*interval).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.coalesce(upto, zero))
        nth = F.col("rank") - F.col("skip")
        found = (open_.join(counts, interval).where((F.col("before") <= nth) & (nth < F.col("before") + F.col("c")))
                 .select("g", "rank", (F.col("skip") + F.col("before")).alias("skip"), F.col("c").alias("n"), F.col("least").alias("lo"),
                         F.col("most").alias("hi"), F.col("least").alias("from"), F.col("most").alias("to")))
        state = stored(state.where((F.col("lo") >= F.col("hi")) | (F.col("n") <= FEW)).unionByName(found), "selection")
    known = state.where(F.col("lo") == F.col("hi")).select("g", "rank", F.col("lo").alias("v"))
    few = state.where(F.col("lo") < F.col("hi"))
    order = F.row_number().over(Window.partitionBy("g", "rank").orderBy("v"))     # of at most ``FEW`` values
    last = (within(few.select("g", "rank", "skip", "lo", "hi")).withColumn("nth", order)
            .where(F.col("nth") == F.col("rank") - F.col("skip") + 1).select("g", "rank", "v"))
    return known.unionByName(last)


def exact_percentiles(df: DataFrame, group: str, value: str, probs=(0.5, 0.95)) -> DataFrame:
    """Exact linear-interpolation percentiles ``(group, p, q)`` by selection, without sorting
    or collecting a group.

    NULL values are no observations and a NULL group has no percentiles; NaN is larger than any
    number. The neighbours of rank (n-1)p give lo + (hi - lo) * frac.
    """
    values = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    rank = (F.col("n") - 1).cast("double") * F.col("p")
    places = (values.groupBy("g").agg(F.count("*").alias("n"))
              .select("g", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
              .select("g", "p", F.floor(rank).cast("bigint").alias("low"), F.ceil(rank).cast("bigint").alias("high"),
                      (rank - F.floor(rank)).alias("f")))
    places = stored(places, "percentile-places")
    got = stored(selected(values, places.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()), "selected")
    out = places
    for name in ("low", "high"):
        out = out.join(got.select("g", F.col("rank").alias(name), F.col("v").alias(f"v_{name}")), ["g", name])
    q = F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise(
        F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("f"))
    return out.select(F.col("g").alias(group), "p", q.alias("q"))


def latency_summary(log: DataFrame, group: str = "mode", latency: str = "generation_time_s",
                    ts: str | None = None) -> DataFrame:
    """p50/p95 latency and requests per second (count over the log's time span). Requests without a latency count as
    requests only."""
    q = exact_percentiles(log, group, latency, (0.5, 0.95))
    piv = q.groupBy(group).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("p50"),
        F.max(F.when(F.col("p") == 0.95, F.col("q"))).alias("p95"))
    aggs = [F.count(F.lit(1)).alias("n_requests")]
    if ts is not None:
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        aggs += [F.min(us).alias("_t0"), F.max(us).alias("_t1")]
    base = log.groupBy(group).agg(*aggs)
    if ts is not None:
        base = base.withColumn("requests_per_s", F.when(
            F.col("_t1") > F.col("_t0"),
            F.col("n_requests").cast("double") * 1000000.0 / (F.col("_t1") - F.col("_t0")).cast("double")))
        base = base.drop("_t0", "_t1")
    return base.join(piv, group, "left")
