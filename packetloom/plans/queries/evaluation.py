"""Queries over confusion counts, thresholds and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import evaluate, shape, sketches, stats, threshold
from packetloom.plans.queries.inputs import FLOW_SQL, SCORED_SQL, flows, scored_events, table
from packetloom.plans.queries.registry import query, rounded

STATISTICS = [
    "accuracy", "fn_inverse", "percent_detected", "percent_fn", "fn_to_accuracy",
    "weighted_fn_to_accuracy", "weighted_detection_to_accuracy", "lambda",
]

GRID_SQL = ", ".join(f"('{x!r}'::double)" for x in threshold.threshold_grid())


def _stats_sql(counts: str) -> str:
    """Detection statistics over a relation with columns tn, fp, fn, tp."""
    return f"""
      select *, (wd + weighted_fn_to_accuracy) / 2 as "lambda", wd as weighted_detection_to_accuracy
      from (select *, (accuracy + percent_fn) / 2 as fn_to_accuracy,
                   (percent_fn * 2 + accuracy) / 3 as weighted_fn_to_accuracy,
                   (percent_detected + accuracy) / 2 as wd
            from (select *, (100.0::double - 100.0::double * fn_inverse) / 100.0::double as percent_fn
                  from (select *, tn + fp + fn + tp as total,
                               (tp + tn)::double / nullif(tn + fp + fn + tp, 0) as accuracy,
                               fn::double / nullif(tn + fp + fn + tp, 0) as fn_inverse,
                               tp::double / nullif(tp + fn, 0) as percent_detected
                        from ({counts}))))"""


def _rounded_sql() -> str:
    return ", ".join(f'round("{c}", 9) as "{c}"' for c in STATISTICS)


def _counts_sql(flagged: str) -> str:
    return f"""count(*) filter (truth = 0 and not ({flagged})) as tn,
               count(*) filter (truth = 0 and ({flagged})) as fp,
               count(*) filter (truth = 1 and not ({flagged})) as fn,
               count(*) filter (truth = 1 and ({flagged})) as tp"""


SWEEP_SQL = _stats_sql(
    f"""select threshold, {_counts_sql('score > threshold')}
        from ({SCORED_SQL}), (values {GRID_SQL}) g(threshold) group by threshold"""
)


def _round_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c, 9) for c in STATISTICS})


@query(
    "confusion_matrix",
    """with c as (select distinct toxic::double as k from labels)
       select a.k as actual, p.k as predicted, count(l.doc_id) as n
       from c a cross join c p left join labels l on l.toxic = a.k and l.quality = p.k
       group by a.k, p.k""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels"), "toxic", "quality")


@query(
    "confusion_many_classes",
    """with t as (select l_linenumber::double as a, (l_partkey % 7 + 1)::double as p from lineitem),
            c as (select distinct a as k from t)
       select x.k as actual, y.k as predicted, count(t.a) as n
       from c x cross join c y left join t on t.a = x.k and t.p = y.k group by x.k, y.k""",
)
def confusion_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_partkey") % 7 + 1).alias("guess"))
    return evaluate.confusion(rows, "l_linenumber", "guess")


@query(
    "multiclass_accuracy",
    """select round(avg(case when l_linenumber = l_partkey % 7 + 1 then 1.0 else 0.0 end), 9) as accuracy
       from lineitem""",
)
def multiclass_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_partkey") % 7 + 1).alias("guess"))
    return evaluate.multiclass_accuracy(rows, "l_linenumber", "guess").select(
        rounded("accuracy", 9).alias("accuracy")
    )


@query(
    "binary_counts",
    f"""select tn, fp, fn, tp, round((tp + tn)::double / (tn + fp + fn + tp), 9) as accuracy,
               round(fn::double / (tn + fp + fn + tp), 9) as missed_positive_rate
        from (select {_counts_sql('score > 0.5')} from ({SCORED_SQL}))""",
)
def binary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = shape.flag(scored_events(spark, sf_dir), "score", 0.5)
    report = evaluate.binary_counts(flagged, "truth", "flag")
    return report.withColumns({c: rounded(c, 9) for c in ("accuracy", "missed_positive_rate")})


@query(
    "binary_counts_null_labels",
    """with f as (select case when label = 2 then null else label end as label, flag
                  from (select l_linenumber % 3 as label, case when l_quantity > 40 then null else (l_discount > 0.05)::int end as flag from lineitem))
       select count(*) filter (label = 0 and coalesce(flag, 0) = 0) as tn, count(*) filter (label = 0 and flag = 1) as fp,
              count(*) filter (coalesce(label, 1) = 1 and coalesce(flag, 0) = 0) as fn, count(*) filter (coalesce(label, 1) = 1 and flag = 1) as tp from f""",
)
def binary_counts_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row counts: a null label is positive, a null flag isn't raised."""
    kind = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(kind != 2, kind).alias("label"), F.when(F.col("l_quantity") <= 40, (F.col("l_discount") > 0.05).cast("int")).alias("flag")
    )
    return evaluate.binary_counts(rows, "label", "flag").select("tn", "fp", "fn", "tp")


@query(
    "mean_threshold_report",
    f"""select tn, fp, fn, tp, round((tp + tn)::double / (tn + fp + fn + tp), 9) as accuracy,
               round(fn::double / (tn + fp + fn + tp), 9) as missed_positive_rate,
               round(cut, 6) as threshold
        from (select {_counts_sql('score > cut')}, max(cut) as cut
              from ({SCORED_SQL}), (select avg(score) as cut from ({SCORED_SQL})))""",
)
def mean_threshold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.mean_threshold_report(scored_events(spark, sf_dir), "truth", "score")
    return report.withColumns(
        {
            "accuracy": rounded("accuracy", 9),
            "missed_positive_rate": rounded("missed_positive_rate", 9),
            "threshold": rounded("threshold"),
        }
    )


@query(
    "detection_stats",
    f"""select tn, fp, fn, tp, total, {_rounded_sql()}
        from ({_stats_sql(f"select {_counts_sql('score > 0.3')} from ({SCORED_SQL})")})""",
)
def detection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_stats(evaluate.detection_stats(scored_events(spark, sf_dir), "truth", "score", 0.3))


@query(
    "threshold_sweep",
    f"select threshold, tn, fp, fn, tp, total, {_rounded_sql()} from ({SWEEP_SQL})",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_stats(threshold.threshold_sweep(scored_events(spark, sf_dir), "truth", "score"))


def _best_sql(objective: str) -> str:
    column = threshold.OBJECTIVES[objective]
    return f"""select '{objective}' as objective, threshold, round("{column}", 9) as value
               from ({SWEEP_SQL}) order by "{column}" desc nulls last, threshold desc limit 1"""


def _register_best(objective: str) -> None:
    @query(f"best_threshold_{objective}", _best_sql(objective))
    def best(spark: SparkSession, sf_dir: str) -> DataFrame:
        sweep = threshold.threshold_sweep(scored_events(spark, sf_dir), "truth", "score")
        return threshold.best_threshold(sweep, objective).withColumn("value", rounded("value", 9))


for _objective in threshold.OBJECTIVES:
    _register_best(_objective)


@query(
    "evaluate_report",
    f"""select 'fn_to_accuracy' as objective, round(fn_to_accuracy, 9) as value, threshold,
               tn, fp, fn, tp, total, {_rounded_sql()}
        from ({SWEEP_SQL}) order by "fn_to_accuracy" desc, threshold desc limit 1""",
)
def evaluate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = threshold.evaluate(scored_events(spark, sf_dir), "truth", "score")
    return _round_stats(report).withColumn("value", rounded("value", 9))


def _describe_sql(column: str, relation: str) -> str:
    return f"""select '{column}' as "column", count({column}) as count, round(avg({column}), 6) as mean,
                      round(stddev_samp({column}), 6) as std, round(min({column}), 6) as min,
                      round(quantile_cont({column}, 0.25), 6) as p25,
                      round(quantile_cont({column}, 0.5), 6) as p50,
                      round(quantile_cont({column}, 0.75), 6) as p75, round(max({column}), 6) as max
               from ({relation})"""


def _round_describe(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query("score_describe", _describe_sql("score", SCORED_SQL))
def score_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_describe(stats.describe(scored_events(spark, sf_dir), ["score"]))


WIDE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_wide", " union all ".join(_describe_sql(c, "lineitem") for c in WIDE))
def describe_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric column of the line items at once."""
    rows = table(spark, sf_dir, "lineitem").select(*WIDE)
    return _round_describe(stats.describe(rows, list(WIDE)))


@query(
    "flow_describe",
    " union all ".join(
        _describe_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def flow_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return _round_describe(stats.describe(table(spark, sf_dir, "lineitem").select(*cols), cols))


@query(
    "score_covariance",
    " union all ".join(
        f"""select '{a}' as column_a, '{b}' as column_b, round(covar_samp({a}, {b}), 6) as covariance
            from (select event_id, score, truth, event_id % 100 as step from ({SCORED_SQL}))"""
        for a in ("score", "truth", "step")
        for b in ("score", "truth", "step")
    ),
)
def score_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_events(spark, sf_dir).select("score", "truth", (F.col("event_id") % 100).alias("step"))
    return stats.covariance(rows).withColumn("covariance", rounded("covariance"))


@query(
    "quantile_threshold",
    f"""select round(q, 6) as threshold, count(*) filter (score > q) as flagged
        from ({SCORED_SQL}), (select quantile_cont(score, 0.95) as q from ({SCORED_SQL})) group by q""",
)
def quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_events(spark, sf_dir)
    cut = stats.quantile_threshold(scored, "score", 0.95)
    return shape.flag(scored, "score", F.lit(cut)).agg(
        rounded(F.lit(cut)).alias("threshold"), F.sum("flag").alias("flagged")
    )


@query(
    "train_report",
    f"""select count(p) as n,
               round(avg(case when truth = 1 then -ln(c) else -ln(1 - c) end), 6) as loss,
               round(avg(case when (p > 0.5) = (truth = 1) then 1.0 else 0.0 end), 9) as accuracy
        from (select truth, score as p, least(greatest(score, 1e-7), 1 - 1e-7) as c from ({SCORED_SQL}))""",
)
def train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.train_report(scored_events(spark, sf_dir), "truth", "score")
    return report.withColumns({"loss": rounded("loss"), "accuracy": rounded("accuracy", 9)})


@query(
    "flow_report",
    f"""with f as (select (l_quantity - lo) / (hi - lo) as score, label as truth
                   from ({FLOW_SQL}), (select min(l_quantity) lo, max(l_quantity) hi from lineitem)),
             m as (select avg(score) as cut from f)
        select tn, fp, fn, tp, round((tp + tn)::double / (tn + fp + fn + tp), 9) as accuracy,
               round(fn::double / (tn + fp + fn + tp), 9) as missed_positive_rate, round(cut, 6) as threshold
        from (select {_counts_sql('score > cut')}, max(cut) as cut from f, m)""",
)
def flow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label flows, scale one feature, flag above the mean, count."""
    from packetloom.operators.scale import minmax

    rows = shape.binary_label(flows(spark, sf_dir), "verdict", benign="BENIGN").select(
        "label", F.col("l_quantity").alias("score")
    )
    report = evaluate.mean_threshold_report(minmax(rows, ["score"]), "label", "score")
    return report.withColumns(
        {
            "accuracy": rounded("accuracy", 9),
            "missed_positive_rate": rounded("missed_positive_rate", 9),
            "threshold": rounded("threshold"),
        }
    )


@query(
    "score_sketch_ranks",
    f"""select count(*) as n, min(score) as low, max(score) as high, true as p25, true as p50, true as p75
        from ({SCORED_SQL})""",
)
def score_sketch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by group, merged: each quartile's rank lies within the stated bound of the exact one."""
    rows = scored_events(spark, sf_dir).select("score", (F.col("event_id") % 30).alias("day"))
    made = sketches.describe_sketches(sketches.sketch_columns(rows, ["score"], ["day"])).drop("min", "max")
    bound = sketches.rank_error()

    def within(q: str, share: float):
        below, upto = (F.avg(c.cast("double")) for c in (F.col("score") < F.col(q), F.col("score") <= F.col(q)))
        return ((below - bound <= share) & (upto + bound >= share)).alias(q)

    return rows.join(F.broadcast(made.select("p25", "p50", "p75"))).agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"),
        within("p25", 0.25), within("p50", 0.5), within("p75", 0.75),
    )
