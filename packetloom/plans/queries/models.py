"""Queries that fit or apply models."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.columns import logistic_score as logistic_column
from packetloom.operators import anomaly, conv, crossval, evaluate, health, ids, mlp, sampling, shape, stack
from packetloom.operators.scale import minmax
from packetloom.plans import ensemble, formats
from packetloom.plans.detection import train_detection, train_flows
from packetloom.plans.host_health import train_host_health
from packetloom.plans.queries.inputs import (
    FLOW_KEY,
    FLOW_LAYOUT,
    FLOW_NUMERICS,
    FLOW_SQL,
    HOST_SQL,
    flows,
    host_metrics,
    table,
)
from packetloom.plans.queries.registry import query, rounded
from packetloom.session import scratch_path
from packetloom.sources.models import load_model, save_model


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.binary_label(flows(spark, sf_dir), "verdict", benign="BENIGN", drop=False)


# Intrusion detection -------------------------------------------------------

GROUP_SQL = f"""
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, label,
         round(p, 4) as score, case when p > 0.5 then 1.0::double else 0.0::double end as prediction
  from (select *, avg(label) over (partition by size_class) as p from ({FLOW_SQL}))"""


def _group_model(rows: DataFrame) -> PipelineModel:
    """One categorical and nothing else: the fit must give each group's mean label."""
    return ids.fit_ids(rows, "label", ["size_class"], [])


def _group_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = ids.probability_of_one(ids.score(model, rows))
    return scored.select(*FLOW_KEY, "label", rounded("score", 4).alias("score"), "prediction")


@query("ids_group_probability", GROUP_SQL)
def ids_group_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    return _group_scores(_group_model(rows), rows)


@query("ids_saved_model", GROUP_SQL)
def ids_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a save and a load."""
    rows = _labelled(spark, sf_dir)
    path = scratch_path(spark, "ids-model")
    save_model(_group_model(rows), path)
    return _group_scores(load_model(path), rows)


SPLIT_SQL = f"('0x' || substr(md5('42:' || l_orderkey), 1, 8))::ubigint < {round(0.7 * 2**32)}"


HELDOUT_SQL = f"""with f as (select *, {SPLIT_SQL} as train from ({FLOW_SQL})),
            g as (select size_class, avg(label) as p from f where train group by size_class),
            t as (select label, case when p > 0.5 then 1 else 0 end as guess
                  from f join g using (size_class) where not train),
            c as (select distinct label as k from t)
        select x.k::double as actual, y.k::double as predicted, count(t.label) as n
        from c x cross join c y left join t on t.label = x.k and t.guess = y.k group by x.k, y.k"""


@query("ids_heldout_confusion", HELDOUT_SQL)
def ids_heldout_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = train_detection(flows(spark, sf_dir), "l_orderkey", "verdict", "BENIGN", ["size_class"], [])
    return run.confusion()


@query("flows_heldout_confusion", HELDOUT_SQL)
def flows_heldout_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records through ``train_flows`` with its hashed addresses; only the source address tells them apart.

    All numerics are 0, a third of the rates after NaN and infinity are taken out, so each
    address must get its mean label.
    """
    rate = F.when(F.col("l_linenumber") % 3 == 0, float("inf")).when(F.col("l_linenumber") % 3 == 1, float("nan")).otherwise(0.0)
    other = {c: rate if c.endswith("/s") else F.lit(0.0) for c in formats.FLOW_ORDER if c not in formats.FLOW_CATEGORICAL}
    source, dest = formats.FLOW_CATEGORICAL
    rows = flows(spark, sf_dir).select(
        "l_orderkey", F.col("size_class").alias(source), F.lit("10.0.0.1").alias(dest),
        F.col("verdict").alias(formats.FLOW_LABEL), *[v.alias(c) for c, v in other.items()],
    )
    return train_flows(rows, "l_orderkey").confusion()


@query("connection_ids_scores")
def connection_ids_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three categoricals and five numerics, scored on held-out orders."""
    run = train_detection(
        flows(spark, sf_dir), FLOW_KEY, "verdict", "BENIGN",
        ["l_returnflag", "l_linestatus", "size_class"], FLOW_NUMERICS,
    )
    scored = ids.probability_of_one(run.scored)
    return scored.select(*FLOW_KEY, "label", rounded("score", 4).alias("score"), "prediction")


# Newton steps for a logistic regression on two numerics. Rows with equal
# features are counted together; the list of cells rides along the recursion.
CELLS_SQL = """
  cells as (select list({'x': x, 'z': z, 'n': n, 's': s}) as l, sum(n) as total
            from (select x, z, count(*)::double as n, sum(label)::double as s from f group by x, z))"""


def _cell_sum(term: str) -> str:
    return f"list_sum(list_transform(l, lambda c: {term}))"


NUMERIC_SQL = f"""
  with recursive f as (select *, l_quantity as x, l_linenumber::double as z from ({FLOW_SQL})),
  {CELLS_SQL},
  newton(i, b, u, v) as (
    select 0, 0.0::double, 0.0::double, 0.0::double
    union all
    select i + 1,
           b + (g0*(hxx*hzz - hxz*hxz) - h0x*(gx*hzz - hxz*gz) + h0z*(gx*hxz - hxx*gz)) / det,
           u + (h00*(gx*hzz - hxz*gz) - g0*(h0x*hzz - hxz*h0z) + h0z*(h0x*gz - gx*h0z)) / det,
           v + (h00*(hxx*gz - gx*hxz) - h0x*(h0x*gz - gx*h0z) + g0*(h0x*hxz - hxx*h0z)) / det
    from (select *, h00*(hxx*hzz - hxz*hxz) - h0x*(h0x*hzz - hxz*h0z) + h0z*(h0x*hxz - hxx*h0z) as det
          from (select i, b, u, v,
                  {_cell_sum("c.s - c.n*p(c.x, c.z, b, u, v)")} as g0,
                  {_cell_sum("c.x*(c.s - c.n*p(c.x, c.z, b, u, v))")} as gx,
                  {_cell_sum("c.z*(c.s - c.n*p(c.x, c.z, b, u, v))")} as gz,
                  {_cell_sum("c.n*q(c.x, c.z, b, u, v)")} as h00,
                  {_cell_sum("c.n*c.x*q(c.x, c.z, b, u, v)")} as h0x,
                  {_cell_sum("c.n*c.z*q(c.x, c.z, b, u, v)")} as h0z,
                  {_cell_sum("c.n*c.x*c.x*q(c.x, c.z, b, u, v)")} as hxx,
                  {_cell_sum("c.n*c.x*c.z*q(c.x, c.z, b, u, v)")} as hxz,
                  {_cell_sum("c.n*c.z*c.z*q(c.x, c.z, b, u, v)")} as hzz
                from newton, cells where i < 25)))
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, label,
         round(p(x, z, b, u, v), 4) as score
  from f, newton where i = 25"""
PROBABILITY = "(1 / (1 + exp(-({b} + {u} * {x} + {v} * {z}))))"


def _expand(sql: str) -> str:
    """Write out p(x, z, b, u, v), the probability, and q = p (1 - p)."""

    def write(match: re.Match) -> str:
        x, z, b, u, v = (part.strip() for part in match.group(2).split(","))
        p = PROBABILITY.format(x=x, z=z, b=b, u=u, v=v)
        return p if match.group(1) == "p" else f"({p} * (1 - {p}))"

    return re.sub(r"\b([pq])\(([^()]*)\)", write, sql)


@query("ids_numeric_probability", _expand(NUMERIC_SQL))
def ids_numeric_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numerics, fitted to full precision, against Newton steps."""
    rows = _labelled(spark, sf_dir)
    model = ids.fit_ids(rows, "label", [], ["l_quantity", "l_linenumber"], tol=1e-14)
    scored = ids.probability_of_one(ids.score(model, rows))
    return scored.select(*FLOW_KEY, "label", rounded("score", 4).alias("score"))


def _flow_run(spark: SparkSession, sf_dir: str, **settings):
    return train_detection(
        flows(spark, sf_dir), FLOW_KEY, "verdict", "BENIGN", ["source_ip", "dest_ip"], FLOW_NUMERICS,
        order=["source_ip", "l_linenumber", "dest_ip", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        handle_invalid="keep", **settings,
    )


@query("flow_ids_confusion")
def flow_ids_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as categoricals; an address not seen in training is kept."""
    return _flow_run(spark, sf_dir, encoding="table").confusion()


@query("flow_ids_hashed_accuracy")
def flow_ids_hashed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with hashed addresses, the way for more of them than an index can hold."""
    return _flow_run(spark, sf_dir, encoding="hash").accuracy().select(rounded("accuracy", 3).alias("accuracy"))


LITERALS = {"l_linenumber": 0.6, "l_quantity": 0.05, "l_discount": -3.5}


@query(
    "logistic_score_literal",
    """select l_orderkey, round(1 / (1 + exp(-(-3.0 + 0.6 * l_linenumber + 0.05 * l_quantity - 3.5 * l_discount))), 6) as score
       from lineitem""",
)
def logistic_score_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = logistic_column(list(LITERALS), list(LITERALS.values()), -3.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", rounded(score).alias("score"))


@query("timed_score")
def timed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    model = ids.fit_ids(rows, "label", ["size_class"], FLOW_NUMERICS[1:])
    return ids.timed_score(model, rows)


@query(
    "crossval_group_accuracy",
    f"""with f as (select label, size_class,
                          ('0x' || substr(md5(l_orderkey::varchar), 1, 8))::ubigint % 10 as fold from ({FLOW_SQL})),
            g as (select size_class, fold, count(*) as n, sum(label) as s from f group by size_class, fold),
            o as (select *, (sum(s) over w - s) / (sum(n) over w - n) as p from g
                  window w as (partition by size_class)),
            a as (select fold, sum(case when p > 0.5 then s else n - s end) / sum(n) as accuracy from o group by fold)
        select round(avg(accuracy), 9) as mean_accuracy, round(stddev_pop(accuracy), 9) as sd_accuracy from a""",
)
def crossval_group_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.stratified_folds(
        _labelled(spark, sf_dir).select("l_orderkey", "label", "size_class"), "l_orderkey", "label", k=10, exact=False
    )
    folds = crossval.cross_validate(rows, "fold", 10, _group_model, ids.score, "label")
    summary = crossval.summarize_folds(folds)
    return summary.select(*[rounded(c, 9).alias(c) for c in summary.columns])


@query("crossval_mlp_accuracy")
def crossval_mlp_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds of a perceptron on standardised features, as one row per fold."""
    rows = sampling.stratified_folds(
        _labelled(spark, sf_dir).select(*FLOW_KEY, *FLOW_NUMERICS[1:], "label"), FLOW_KEY, "label", k=10
    )
    return crossval.cross_validate_perceptron(rows, FLOW_NUMERICS, "label", "fold", 10, key=FLOW_KEY)


# Host health ---------------------------------------------------------------

# Least squares on three columns by Cramer's rule over the sample covariances.
LINEAR_SQL = f"""
  with h as ({HOST_SQL}),
  c as (select covar_samp(hour, hour) aa, covar_samp(hour, memutil) ab, covar_samp(hour, netutil) ac,
               covar_samp(memutil, memutil) bb, covar_samp(memutil, netutil) bc, covar_samp(netutil, netutil) cc,
               covar_samp(hour, load) ay, covar_samp(memutil, load) byy, covar_samp(netutil, load) cy,
               avg(hour) ma, avg(memutil) mb, avg(netutil) mc, avg(load) my from h),
  d as (select *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) as det from c),
  w as (select *, (ay*(bb*cc - bc*bc) - ab*(byy*cc - bc*cy) + ac*(byy*bc - bb*cy)) / det as wa,
                  (aa*(byy*cc - bc*cy) - ay*(ab*cc - bc*ac) + ac*(ab*cy - byy*ac)) / det as wb,
                  (aa*(bb*cy - byy*bc) - ab*(ab*cy - byy*ac) + ay*(ab*bc - bb*ac)) / det as wc from d),
  m as (select wa, wb, wc, my - wa*ma - wb*mb - wc*mc as w0 from w)"""


@query(
    "host_linear",
    f"""{LINEAR_SQL} select round(w0, 6) as intercept, round(wa, 6) as hour, round(wb, 6) as memutil,
                            round(wc, 6) as netutil from m""",
)
def host_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = host_metrics(spark, sf_dir)
    cols = ["hour", "memutil", "netutil"]
    weights = health.coefficients(health.fit_linear(metrics, "load", cols), cols)
    # The literals ride on an aggregate of the rows they were fitted on.
    return metrics.agg(F.count(F.lit(1)).alias("n")).select(
        *[rounded(F.lit(v)).alias(c) for c, v in weights.items()]
    )


RESIDUAL_SQL = "load - (w0 + wa*hour + wb*memutil + wc*netutil)"


@query(
    "host_residuals",
    f"""{LINEAR_SQL} select event_id, round({RESIDUAL_SQL}, 5) + 0.0 as residual from h, m""",
)
def host_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = host_metrics(spark, sf_dir)
    model = health.fit_linear(metrics, "load", ["hour", "memutil", "netutil"])
    return health.residuals(model, metrics, "load").select("event_id", rounded("residual", 5).alias("residual"))


@query(
    "host_fit_report",
    f"""{LINEAR_SQL}, r as (select load, {RESIDUAL_SQL} as e from h, m)
        select count(*) as n, round(sqrt(avg(e*e)), 6) as rmse,
               round(1 - sum(e*e) / (var_pop(load) * count(*)), 6) as r2 from r""",
)
def host_fit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = train_host_health(host_metrics(spark, sf_dir))[2]
    return report.withColumns({"rmse": rounded("rmse"), "r2": rounded("r2")})


# Ensemble stages -----------------------------------------------------------


@query(
    "anomaly_2d",
    """with s as (select l_orderkey, (l_quantity - q0)/(q1 - q0) as x, (l_extendedprice - p0)/(p1 - p0) as y
                  from lineitem, (select min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0,
                                         max(l_extendedprice) p1 from lineitem)),
            m as (select avg(x) mx, avg(y) my,
                         0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) as a from s),
            d as (select l_orderkey, abs((y - my) * cos(a) - (x - mx) * sin(a)) as dist from s, m)
       select l_orderkey, round((dist - lo) / (hi - lo), 6) as anomaly_score
       from d, (select min(dist) lo, max(dist) hi from d)""",
)
def anomaly_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features, one axis: the distance has a closed form."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    model = anomaly.fit_anomaly(rows, ["l_quantity", "l_extendedprice"], k=1)
    scored = anomaly.anomaly_score(model, rows)
    return scored.select("l_orderkey", rounded("anomaly_score").alias("anomaly_score"))


# The two leading axes of a covariance matrix: squaring a matrix again and
# again leaves the projector on its leading axis; the second axis comes from
# the matrix with the first one taken out.
_FEATURES = ["x1", "x2", "x3", "x4", "x5"]


def _leading_sql(name: str, source: str, n: int) -> str:
    """Projector on the leading axis of the n x n matrix in ``source``."""
    all_n = f"range(1, {n + 1})"
    trace = f"list_sum(list_transform({all_n}, lambda i: m[i][i]))"
    normed = "list_transform(m, lambda r: list_transform(r, lambda x: x / t))"
    squared = f"""list_transform({all_n}, lambda i: list_transform({all_n}, lambda j:
                    list_sum(list_transform({all_n}, lambda k: m[i][k] * m[k][j]))))"""
    return f"""
      {name}_steps(i, m) as (
        select 0, {normed} from (select m, {trace} as t from {source})
        union all
        select i + 1, {normed}
        from (select i, m, {trace} as t from (select i, {squared} as m from {name}_steps where i < 24))),
      {name} as (select m from {name}_steps where i = 24)"""


def _two_axes_sql(n: int) -> str:
    """Projectors ``one`` and ``two`` on the leading axes of the matrix in ``cov``."""
    all_n = f"range(1, {n + 1})"
    return f"""
      {_leading_sql("one", "cov", n)},
      rest as (
        select list_transform({all_n}, lambda i: list_transform({all_n}, lambda j: a[i][j] - size * o[i][j])) as m
        from (select cov.m as a, one.m as o,
                     list_sum(list_transform({all_n}, lambda i:
                       list_sum(list_transform({all_n}, lambda j: cov.m[i][j] * one.m[j][i])))) as size
              from cov, one)),
      {_leading_sql("two", "rest", n)}"""


def _distance_sql(n: int) -> str:
    """Distance of ``z`` to the plane of both axes (o and w)."""
    all_n = f"range(1, {n + 1})"
    return f"""sqrt(list_sum(list_transform({all_n}, lambda i:
                 power(z[i] - list_sum(list_transform({all_n}, lambda j: (o[i][j] + w[i][j]) * z[j])), 2))))"""


ANOMALY_SQL = f"""
  with recursive s as (
    select {", ".join("t." + k for k in FLOW_KEY)},
           {", ".join(f"(t.{c} - lo.{c}) / (hi.{c} - lo.{c})::double as x{i}" for i, c in enumerate(FLOW_NUMERICS, 1))}
    from (select l_orderkey, l_partkey, l_suppkey, {", ".join(FLOW_NUMERICS)} from lineitem) t,
         (select {", ".join(f"min({c}) as {c}" for c in FLOW_NUMERICS)} from lineitem) lo,
         (select {", ".join(f"max({c}) as {c}" for c in FLOW_NUMERICS)} from lineitem) hi),
  cov as (select [{", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in _FEATURES) + "]" for a in _FEATURES)}] as m
          from s),
  {_two_axes_sql(5)},
  mean as (select {", ".join(f"avg({x}) as {x}" for x in _FEATURES)} from s),
  z as (select {", ".join("s." + k for k in FLOW_KEY)}, [{", ".join(f"s.{x} - mean.{x}" for x in _FEATURES)}] as z
        from s, mean),
  d as (
    select {", ".join(FLOW_KEY)}, {_distance_sql(5)} as dist
    from z, (select one.m as o, two.m as w from one, two))
  select {", ".join(FLOW_KEY)}, round((dist - lo) / (hi - lo), 5) as anomaly_score
  from d, (select min(dist) as lo, max(dist) as hi from d)"""


@query("anomaly_5d", ANOMALY_SQL)
def anomaly_5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir)
    scored = anomaly.anomaly_score(anomaly.fit_anomaly(rows, FLOW_NUMERICS, k=2), rows)
    return scored.select(*FLOW_KEY, rounded("anomaly_score", 5).alias("anomaly_score"))


EMBEDDING_SQL = f"""
  with recursive e as (select vec_id, i, embedding[i]::double as v from embeddings, range(1, 65) t(i)),
  s as (select vec_id, i, (v - lo) / (hi - lo) as x
        from e join (select i, min(v) as lo, max(v) as hi from e group by i) using (i)),
  cov as (select list(r order by i) as m
          from (select i, list(c order by j) as r
                from (select a.i, b.i as j, covar_samp(a.x, b.x) as c from s a join s b using (vec_id) group by a.i, b.i)
                group by i)),
  {_two_axes_sql(64)},
  z as (select vec_id, list(x - mean order by i) as z
        from s join (select i, avg(x) as mean from s group by i) using (i) group by vec_id),
  d as (select vec_id, {_distance_sql(64)} as dist from z, (select one.m as o, two.m as w from one, two))
  select vec_id, round((dist - lo) / (hi - lo), 5) as anomaly_score
  from d, (select min(dist) as lo, max(dist) as hi from d)"""


@query("anomaly_embeddings", EMBEDDING_SQL)
def anomaly_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wide = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    cols = wide.columns[1:]
    scored = anomaly.anomaly_score(anomaly.fit_anomaly(wide, cols, k=2), wide)
    return scored.select("vec_id", rounded("anomaly_score", 5).alias("anomaly_score"))


#: A convolution with given weights: two filters of width three over four scaled columns, and a dense layer.
CONV_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GIVEN_CONV = conv.Weights(
    np.array([[0.5, -1.0], [1.25, 0.75], [-0.5, 1.5]]), np.array([0.1, -0.2]), np.array([[0.6, -0.4, 0.3, 0.2], [0.1, 0.5, -0.3, 0.8]]), np.array([0.05, 0.1, 0.0, -0.1])
)


def _conv_sql() -> str:
    """Windows, ReLU, maximum, dense layer and distance, written out."""
    n, (width, filters) = len(CONV_COLS), GIVEN_CONV.conv.shape
    left = (width - 1) // 2
    pooled = []
    for f in range(filters):
        windows = []
        for t in range(n):
            terms = [f"{float(GIVEN_CONV.conv[d, f])!r} * x{t + d - left}" for d in range(width) if 0 <= t + d - left < n]
            windows.append(f"{' + '.join(terms)} + {float(GIVEN_CONV.conv_bias[f])!r}")
        pooled.append(f"greatest(0, {', '.join(windows)}) as h{f}")
    errors = [f"power({' + '.join(f'h{f} * {float(GIVEN_CONV.dense[f, i])!r}' for f in range(filters))} + {float(GIVEN_CONV.dense_bias[i])!r} - x{i}, 2)" for i in range(n)]
    return f"""
      with s as (
        select {", ".join(FLOW_KEY)}, {", ".join(f"({c} - lo{i}) / (hi{i} - lo{i})::double as x{i}" for i, c in enumerate(CONV_COLS))}
        from lineitem, (select {", ".join(f"min({c}) as lo{i}, max({c}) as hi{i}" for i, c in enumerate(CONV_COLS))} from lineitem)),
      h as (select *, {", ".join(pooled)} from s),
      d as (select *, sqrt({" + ".join(errors)}) as dist from h)
      select {", ".join(FLOW_KEY)}, round((dist - lo) / (hi - lo), 6) as anomaly_score
      from d, (select min(dist) as lo, max(dist) as hi from d)"""


@query("conv_score_given_weights", _conv_sql())
def conv_score_given_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*FLOW_KEY, *CONV_COLS)
    scored = anomaly.anomaly_score(conv.ConvReconstruction(CONV_COLS, {}, GIVEN_CONV, kind=np.float64), rows)
    return scored.select(*FLOW_KEY, rounded("anomaly_score", 6).alias("anomaly_score"))


@query("anomaly_conv1d")
def anomaly_conv1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir)
    model = anomaly.fit_anomaly(rows, FLOW_NUMERICS, method="conv1d", key="l_orderkey")
    scored = anomaly.anomaly_score(model, rows)
    return scored.select(*FLOW_KEY, rounded("anomaly_score", 4).alias("anomaly_score"))


def _malicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    scorer = mlp.fit_mlp(rows, FLOW_NUMERICS, "label", key=FLOW_KEY)
    return mlp.score_mlp(scorer, rows)


@query("mlp_score")
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _malicious(spark, sf_dir).select(*FLOW_KEY, "label", rounded("malicious_score", 4).alias("malicious_score"))


#: A perceptron with given weights: three hidden units over three scaled columns.
GIVEN_COLS = ["l_quantity", "l_discount", "l_tax"]
GIVEN = mlp.Perceptron(
    np.array([[1.5, -2.0, 0.5], [0.25, 3.0, -1.0], [-0.75, 0.5, 2.0]]), np.array([-0.5, 0.1, -0.2]), np.array([2.0, -1.5, 1.0]), np.array([-0.3])
)


def _unit_sql(x: list[str], weights, bias: float) -> str:
    return " + ".join([repr(float(bias)), *(f"{float(w)!r} * {c}" for c, w in zip(x, weights, strict=True))])


_GIVEN_UNITS = ", ".join(f"greatest(0, {_unit_sql(['x0', 'x1', 'x2'], column, b)}) as h{j}" for j, (column, b) in enumerate(zip(GIVEN.hidden.T, GIVEN.hidden_bias, strict=True)))

GIVEN_MLP_SQL = f"""
  with s as (
    select {", ".join(FLOW_KEY)}, {", ".join(f"({c} - lo{i}) / (hi{i} - lo{i})::double as x{i}" for i, c in enumerate(GIVEN_COLS))}
    from lineitem, (select {", ".join(f"min({c}) as lo{i}, max({c}) as hi{i}" for i, c in enumerate(GIVEN_COLS))} from lineitem)),
  h as (select *, {_GIVEN_UNITS} from s),
  p as (select *, 1 / (1 + exp(-({_unit_sql(["h0", "h1", "h2"], GIVEN.out, GIVEN.out_bias[0])}))) as raw from h)
  select {", ".join(FLOW_KEY)}, round((raw - lo) / (hi - lo), 6) as malicious_score
  from p, (select min(raw) as lo, max(raw) as hi from p)"""


@query("mlp_score_given_weights", GIVEN_MLP_SQL)
def mlp_score_given_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ReLU units and a sigmoid over scaled columns, rescaled by the batch's range."""
    rows = table(spark, sf_dir, "lineitem").select(*FLOW_KEY, *GIVEN_COLS)
    scorer = mlp.MaliciousScorer(GIVEN, GIVEN_COLS, {})
    return mlp.score_mlp(scorer, rows).select(*FLOW_KEY, rounded("malicious_score", 6).alias("malicious_score"))


@query(
    "mlp_beats_logistic",
    "select count(*) as n, true as lower_loss from lineitem",
)
def mlp_beats_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the rows both were trained on, the perceptron's loss lies below the logistic regression's."""
    rows = _labelled(spark, sf_dir).select(*FLOW_KEY, *[c for c in FLOW_NUMERICS if c not in FLOW_KEY], "label")
    scorer = mlp.fit_mlp(rows, FLOW_NUMERICS, "label", key=FLOW_KEY)
    scored = mlp.raw_probability(scorer, rows, "p", scorer.bounds)
    plain = ids.probability_of_one(ids.score(ids.fit_ids(rows, "label", [], FLOW_NUMERICS), scored), "q")
    loss = lambda p: F.avg(-F.log(F.greatest(F.when(F.col("label") == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(1e-7))))
    return plain.agg(F.count("*").alias("n"), (loss("p") < loss("q")).alias("lower_loss"))


@query("mlp_train_report")
def mlp_train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy on the training rows."""
    rows = _labelled(spark, sf_dir)
    scorer = mlp.fit_mlp(rows, FLOW_NUMERICS, "label", key=FLOW_KEY)
    report = evaluate.train_report(mlp.raw_probability(scorer, rows, "p", scorer.bounds), "label", "p")
    return report.withColumns({"loss": rounded("loss", 3), "accuracy": rounded("accuracy", 3)})


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minmax(_labelled(spark, sf_dir), ["l_quantity", "l_linenumber"], suffix="_score")
    cols = ["l_quantity_score", "l_linenumber_score"]
    return stack.score_stack(stack.fit_stack(rows, cols, "label", max_iter=500, tol=1e-14), rows)


# Proximal gradient steps on the same objective: both slopes are shrunk towards
# zero by step * 0.01 (soft threshold) and pulled by 0.02 per unit.
STACK_SQL = f"""
  with recursive f as (
    select *, (l_quantity - q0) / (q1 - q0) as x, (l_linenumber - n0) / (n1 - n0)::double as z
    from ({FLOW_SQL}), (select min(l_quantity) q0, max(l_quantity) q1, min(l_linenumber) n0,
                               max(l_linenumber) n1 from lineitem)),
  {CELLS_SQL},
  prox(i, b, u, v) as (
    select 0, 0.0::double, 0.0::double, 0.0::double
    union all
    select i + 1, b - 1.2 * g0,
           sign(u - 1.2 * gx) * greatest(abs(u - 1.2 * gx) - 1.2 * 0.01, 0),
           sign(v - 1.2 * gz) * greatest(abs(v - 1.2 * gz) - 1.2 * 0.01, 0)
    from (select i, b, u, v,
            {_cell_sum("c.n*p(c.x, c.z, b, u, v) - c.s")} / total as g0,
            {_cell_sum("c.x*(c.n*p(c.x, c.z, b, u, v) - c.s)")} / total + 0.02 * u as gx,
            {_cell_sum("c.z*(c.n*p(c.x, c.z, b, u, v) - c.s)")} / total + 0.02 * v as gz
          from prox, cells where i < 1500)),
  s as (select f.*, p(x, z, b, u, v) as raw from f, prox where i = 1500)
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, label,
         round((raw - lo) / (hi - lo), 3) as combined_score
  from s, (select min(raw) lo, max(raw) hi from s)"""


@query("stack_score", _expand(STACK_SQL))
def stack_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(spark, sf_dir).select(*FLOW_KEY, "label", rounded("combined_score", 3).alias("combined_score"))


@query("stack_uninformative", "select l_orderkey, 0.0::double as combined_score from lineitem")
def stack_uninformative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that say nothing about the label get weight 0, so the combined score is constant."""
    rows = shape.binary_label(table(spark, sf_dir, "lineitem"), "l_returnflag", benign="N", drop=False)
    rows = minmax(rows, ["l_tax", "l_discount"])
    model = stack.fit_stack(rows, ["l_tax", "l_discount"], "label")
    return stack.score_stack(model, rows).select("l_orderkey", "combined_score")


def _ensemble(spark: SparkSession, sf_dir: str):
    rows = flows(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", *FLOW_NUMERICS, "verdict")
    return rows, ensemble.ensemble_fit(rows, FLOW_LAYOUT, key=FLOW_KEY[:3])


SCORES = [FLOW_LAYOUT.anomaly, FLOW_LAYOUT.malicious, FLOW_LAYOUT.combined]


@query("ensemble_score")
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _ensemble(spark, sf_dir)
    scored = ensemble.ensemble_score(model, rows)
    return scored.select(*FLOW_KEY, "verdict", *[rounded(c, 4).alias(c) for c in SCORES])


@query(
    "ensemble_ranges",
    """select count(*) as n, count(distinct l_orderkey) as orders, 0.0::double as anomaly_score_min,
              1.0::double as anomaly_score_max, 0.0::double as malicious_score_min, 1.0::double as malicious_score_max,
              0.0::double as combined_score_min, 1.0::double as combined_score_max
       from lineitem""",
)
def ensemble_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored and each score spans [0, 1] in its batch."""
    rows, model = _ensemble(spark, sf_dir)
    scored = ensemble.ensemble_score(model, rows, keep_stages=True)
    ends = [f(c).alias(f"{c}_{n}") for c in SCORES for n, f in (("min", F.min), ("max", F.max))]
    return scored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"), *ends)


@query("ensemble_report")
def ensemble_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _ensemble(spark, sf_dir)
    scored = ensemble.ensemble_score(model, rows, labelled_only=True)
    return ensemble.ensemble_report(scored, FLOW_LAYOUT)


@query("ensemble_stage_reports")
def ensemble_stage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts above the mean for the first two stages."""
    rows, model = _ensemble(spark, sf_dir)
    scored = ensemble.ensemble_score(model, rows, labelled_only=True)
    first, second = (
        ensemble.stage_report(scored, FLOW_LAYOUT, c).withColumn("stage", F.lit(c)) for c in SCORES[:2]
    )
    return first.unionByName(second)
