"""Queries over sources, shaping, sampling and feature engineering."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import encode, sampling, scale, shape
from packetloom.operators.frequency_index import fit_frequency_index
from packetloom.plans.queries.inputs import (
    FLOW_LAYOUT,
    HOST_SQL,
    SCORED_SQL,
    flows,
    host_metrics,
    scored_events,
    table,
)
from packetloom.plans.queries.registry import query, rounded
from packetloom.session import scratch_path
from packetloom.sources import readers, writers

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]
EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props string"
EVENT_SQL = "select event_id, user_id, event_type, value, props from events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*EVENT_COLUMNS)


# Sources and sinks ---------------------------------------------------------


@query("csv_round_trip", EVENT_SQL)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-csv")
    writers.write_csv(_events(spark, sf_dir), path)
    return readers.read_csv(spark, path, EVENT_SCHEMA)


@query("csv_inferred", EVENT_SQL)
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "inferred-csv")
    writers.write_csv(_events(spark, sf_dir), path)
    return readers.read_csv(spark, path).withColumns(
        {"event_id": F.col("event_id").cast("bigint"), "user_id": F.col("user_id").cast("bigint")}
    )


@query("csv_multiline_texts", "select doc_id, lang, text from documents")
def csv_multiline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "texts-csv")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return readers.read_csv(spark, path, "doc_id bigint, lang string, text string", multiline=True)


@query("tsv_round_trip", EVENT_SQL)
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-tsv")
    writers.write_tsv(_events(spark, sf_dir), path, index="event_id")
    return readers.read_tsv(spark, path, EVENT_SCHEMA, index_col="event_id")


@query(
    "tsv_first_rows",
    "select user_id, event_type, value, props from events order by event_id limit 2000",
)
def tsv_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "rows-tsv")
    writers.write_tsv(_events(spark, sf_dir), path, index="event_id")
    return readers.read_tsv(spark, path, EVENT_SCHEMA, rows=2000)


@query("json_round_trip", EVENT_SQL)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-json")
    writers.write_json(_events(spark, sf_dir), path)
    return readers.read_json(spark, path, EVENT_SCHEMA)


@query(
    "json_columns_layout",
    "select cast(event_id as varchar) as row_id, user_id, event_type, value, props from events",
)
def json_columns_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "columns-json")
    events = _events(spark, sf_dir)
    key = F.col("event_id").cast("string")
    maps = [F.create_map(key, F.col(c)).alias(c) for c in EVENT_COLUMNS[1:]]
    events.select(F.to_json(F.struct(*maps))).write.text(path)
    schema = EVENT_SCHEMA.split(", ", 1)[1]
    return readers.read_json(spark, path, schema, layout="columns")


@query(
    "json_columns_document",
    "select cast(event_id as varchar) as row_id, user_id, event_type, value, props from events",
)
def json_columns_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one document of columns, read in blocks."""
    path = scratch_path(spark, "columns-document")
    columns = EVENT_COLUMNS[1:]
    events = _events(spark, sf_dir)
    ends = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    first, last = (F.col("event_id") == F.lit(ends[c]).cast("bigint") for c in ("low", "high"))
    cells = [
        F.concat(
            F.when(first, F.lit(("{" if i == 0 else "") + f'"{c}": {{\n')).otherwise(F.lit("")),
            F.lit('"'), F.col("event_id").cast("string"), F.lit('": '),
            F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null")),
            F.when(last, F.lit("}}" if i + 1 == len(columns) else "},")).otherwise(F.lit(",")),
        )
        for i, c in enumerate(columns)
    ]
    lines = events.select("event_id", F.posexplode(F.array(*cells)).alias("at", "line"))
    writers.write_one_file(lines, ["at", "event_id"], "line", path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # several blocks at any size of the table
    try:
        return readers.read_json(spark, path, EVENT_SCHEMA.split(", ", 1)[1], layout="columns", multiline=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query("load_by_extension", EVENT_SQL)
def load_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events") + ".JSON"
    writers.write_json(_events(spark, sf_dir), path)
    return readers.load(spark, path, EVENT_SCHEMA)


@query("limit_rows", "select event_id, value from events order by event_id limit 500")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.limit_rows(table(spark, sf_dir, "events").select("event_id", "value"), 500, "event_id")


@query("preview")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.preview(_events(spark, sf_dir), 5)


# Shaping -------------------------------------------------------------------


@query(
    "label_flows",
    """select l_orderkey, l_quantity, l_extendedprice,
              case when l_returnflag = 'N' then 0 else 1 end as label
       from lineitem""",
)
def label_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = shape.select_features(
        table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_orderkey", "l_quantity", "l_extendedprice"]
    )
    return shape.binary_label(selected, "label_unreg", benign="N")


@query(
    "ensemble_projection",
    """select l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag as verdict
       from lineitem""",
)
def ensemble_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.select_features(
        table(spark, sf_dir, "lineitem"), "l_returnflag", FLOW_LAYOUT.features, alias="verdict"
    )


LABELLED = """
  case event_type when 'error' then null when 'click' then '0' else event_type end"""


@query(
    "drop_unlabelled",
    f"""with t as (select event_id, {LABELLED} as verdict,
                          case when event_type = 'view' then null else value end as value from events)
        select event_id, verdict, coalesce(value, 0) as value,
               case when verdict = 'purchase' then 0 else 1 end as label
        from t where verdict is distinct from '0'""",
)
def drop_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(f"{LABELLED} as verdict"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
    )
    rows = shape.fill_zero(shape.drop_unlabelled(derived, "verdict"))
    return shape.binary_label(rows, "verdict", benign="purchase", drop=False)


@query(
    "fill_zero",
    """select event_id, coalesce(nullif(event_type, 'click'), null) as event_type,
              case when value > 20 then 0 else value end as value,
              case when user_id < 10 then 0 else user_id end as user_id
       from events""",
)
def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("nullif(event_type, 'click') as event_type"),
        F.expr("case when value > 40 then double('nan') when value > 20 then null else value end as value"),
        F.expr("case when user_id >= 10 then user_id end as user_id"),
    )
    return shape.fill_zero(derived)


@query(
    "filter_host_noon",
    f"""select hour, load, netutil, round(memutil, 6) as label
        from ({HOST_SQL}) where hostname = 'host-3' and hour = 12""",
)
def filter_host_noon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.filter_rows(host_metrics(spark, sf_dir), "hostname = 'host-3' AND hour = 12")
    return shape.select_features(rows, "memutil", ["hour", "load", "netutil"], alias="label").withColumn(
        "label", rounded("label")
    )


SHAPE_SPEC = {
    "event_id": {"col_name": "id"},
    "value": {"col_name": "load", "transform": "`value` * 2"},
    "event_type": {"transform": "upper(event_type)"},
    "no_such_column": {"col_name": "nothing"},
    "user_id": "",
}


@query("shape_config", "select event_id, value * 2 as value, upper(event_type) as event_type, user_id from events")
def shape_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.shape(table(spark, sf_dir, "events"), SHAPE_SPEC)


@query(
    "shape_config_renamed",
    'select event_id as id, value * 2 as "load", upper(event_type) as event_type, user_id from events',
)
def shape_config_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.shape(table(spark, sf_dir, "events"), SHAPE_SPEC, rename=True)


@query(
    "score_beside_features",
    f"select e.event_id, e.user_id, e.event_type, round(s.score, 6) as score from events e join ({SCORED_SQL}) s using (event_id)",
)
def score_beside_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    bounds = scale.fit_bounds(events, ["value"])
    score = scale.minmax_column(F.col("value"), *bounds["value"])
    return shape.with_score(events, "score", rounded(score)).drop("value")


@query(
    "flag_scores",
    f"select event_id, case when score > 0.25 then 1 else 0 end as flag from ({SCORED_SQL})",
)
def flag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.flag(scored_events(spark, sf_dir), "score", 0.25).select("event_id", "flag")


# Sampling ------------------------------------------------------------------


def _hash_sql(salt: str = "", digits: int = 8) -> str:
    return f"('0x' || substr(md5('{salt}' || event_id), 1, {digits}))::ubigint"


@query(
    "hash_split",
    f"""select event_id, case when {_hash_sql('42:')} < {round(0.7 * 2**32)} then 'train' else 'test' end as part
        from events""",
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    train, test = sampling.split(events, "event_id", 0.7, seed=42)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "holdout_split",
    f"select event_id, value from events where {_hash_sql()} >= {round(0.9 * 2**32)}",
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return sampling.split(events, "event_id", 0.9, seed=None)[1]


@query(
    "sample_exact",
    """select event_id, case when value > 40 then 0 else value end as value
       from events order by md5(event_id::varchar), event_id
       limit (select cast(floor(count(*) * 0.35 + 0.5) as bigint) from events)""",
)
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", F.expr("case when value <= 40 then value end as value")
    )
    return sampling.sample_exact(events, "event_id", 0.35)


@query(
    "stratified_folds",
    """select event_id, event_type,
              cast((row_number() over (partition by event_type order by md5(event_id::varchar), event_id) - 1) % 10
                   as integer) as fold
       from events""",
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_folds(events, "event_id", "event_type", k=10)


@query(
    "hash_folds",
    f"select event_id, event_type, cast({_hash_sql()} % 10 as integer) as fold from events",
)
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_folds(events, "event_id", "event_type", k=10, exact=False)


# Feature engineering -------------------------------------------------------


@query(
    "minmax_features",
    """select l_orderkey,
              round((l_quantity - q0) / (q1 - q0), 6) as l_quantity,
              round((l_extendedprice - p0) / (p1 - p0), 6) as l_extendedprice,
              round((l_tax - t0) / (t1 - t0), 6) as l_tax
       from lineitem, (select min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0,
                              max(l_extendedprice) p1, min(l_tax) t0, max(l_tax) t1 from lineitem)""",
)
def minmax_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    scaled = scale.minmax(table(spark, sf_dir, "lineitem").select("l_orderkey", *cols), cols)
    return scaled.select("l_orderkey", *[rounded(c).alias(c) for c in cols])


@query(
    "minmax_saved_bounds",
    """select l_orderkey, least(greatest((l_quantity - 10.0) / 30.0, 0), 1)::double as l_quantity from lineitem""",
)
def minmax_saved_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return scale.minmax(rows, ["l_quantity"], {"l_quantity": (10.0, 40.0)}, clamp=True)


@query("limit_rows_by_time", "select event_id, ts from events order by ts, event_id limit 1500")
def limit_rows_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows than a top-n takes, by a key that isn't a number."""
    return sampling.limit_rows(table(spark, sf_dir, "events").select("event_id", "ts"), 1500, "ts", ["event_id"])


@query("limit_rows_ties", "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity, l_orderkey, l_linenumber limit 1700")
def limit_rows_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of fifty values: the cut falls among ties, which go by order and line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sampling.limit_rows(rows, 1700, "l_quantity", ["l_orderkey", "l_linenumber"])


ODD_SQL = """select l_orderkey, l_linenumber, case l_linenumber when 2 then 'NaN'::double when 3 then 'inf'::double
                    when 4 then '-inf'::double else l_extendedprice::double end as price from lineitem"""


def _odd_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("double")
    odd = F.when(line == 2, float("nan")).when(line == 3, float("inf")).when(line == 4, float("-inf")).otherwise(price)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("price"))


@query(
    "minmax_nonfinite",
    f"""with f as ({ODD_SQL}), b as (select min(price) as low, max(price) as high from f where isfinite(price))
        select l_orderkey, l_linenumber, case when isfinite(price) then round((price - low) / (high - low), 6) end as price from f, b""",
)
def minmax_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.minmax(_odd_prices(spark, sf_dir), ["price"]).withColumn("price", rounded("price"))


@query(
    "standardize_nonfinite",
    f"""with f as ({ODD_SQL}), b as (select avg(price) as mean, stddev_pop(price) as sd from f where isfinite(price))
        select l_orderkey, l_linenumber, case when isfinite(price) then round((price - mean) / sd, 4) + 0.0 end as price from f, b""",
)
def standardize_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.standardize(_odd_prices(spark, sf_dir), ["price"]).withColumn("price", rounded("price", 4))


@query("minmax_constant", "select l_orderkey, 0.0::double as steady from lineitem")
def minmax_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_tax") * 0 + 5.0).alias("steady"))
    return scale.minmax(rows, ["steady"])


@query("minmax_score", f"select event_id, round(score, 6) as score from ({SCORED_SQL})")
def minmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spark, sf_dir).select("event_id", rounded("score").alias("score"))


@query(
    "standardize",
    """select l_orderkey, round((l_quantity - m) / s, 6) as l_quantity,
              round((l_discount - dm) / ds, 6) + 0.0 as l_discount
       from lineitem, (select avg(l_quantity) m, stddev_pop(l_quantity) s,
                              avg(l_discount) dm, stddev_pop(l_discount) ds from lineitem)""",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_discount"]
    scaled = scale.standardize(table(spark, sf_dir, "lineitem").select("l_orderkey", *cols), cols)
    return scaled.select("l_orderkey", *[rounded(c).alias(c) for c in cols])


INDEX_SQL = """
  select event_type, row_number() over (order by count(*) desc, event_type) - 1 as i,
         count(*) over () as n
  from events group by event_type"""


@query(
    "string_index",
    f"select event_id, e.event_type, cast(i as double) as event_type_index from events e join ({INDEX_SQL}) t on e.event_type = t.event_type",
)
def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return encode.string_index(["event_type"]).fit(events).transform(events)


@query(
    "string_index_addresses",
    """with a as (select l_suppkey::varchar s, row_number() over (order by count(*) desc, l_suppkey::varchar) - 1 i
                  from lineitem group by 1),
            b as (select l_partkey::varchar p, row_number() over (order by count(*) desc, l_partkey::varchar) - 1 j
                  from lineitem group by 1)
       select l_orderkey, s as source_ip, p as dest_ip, i::double as source_ip_index, j::double as dest_ip_index
       from lineitem join a on l_suppkey::varchar = s join b on l_partkey::varchar = p""",
)
def string_index_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir).select("l_orderkey", "source_ip", "dest_ip")
    return fit_frequency_index(rows, ["source_ip", "dest_ip"]).transform(rows)


@query(
    "one_hot_position",
    f"""select event_id, case when i < n - 1 then cast(i as integer) else -1 end as hot, cast(n - 1 as integer) as width
        from events e join ({INDEX_SQL}) t on e.event_type = t.event_type""",
)
def one_hot_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    stages = [encode.string_index(["event_type"]), encode.one_hot(["event_type"])]
    encoded = Pipeline(stages=stages).fit(events).transform(events)
    values = vector_to_array("event_type_vec")
    return encoded.select(
        "event_id",
        (F.array_position(values, 1.0) - 1).cast("int").alias("hot"),
        F.size(values).alias("width"),
    )


@query(
    "assemble_features",
    "select l_orderkey, l_quantity as f0, l_discount as f1, l_tax as f2, l_linenumber::double as f3 from lineitem",
)
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.assemble(["l_quantity", "l_discount", "l_tax", "l_linenumber"]).transform(
        table(spark, sf_dir, "lineitem")
    )
    values = vector_to_array("features")
    return rows.select("l_orderkey", *[values[i].alias(f"f{i}") for i in range(4)])


@query(
    "hash_features",
    """select l_suppkey::varchar as source_ip, count(*) as n, 1 as slots, 1.0::double as marks, 64 as width, true as spread
       from lineitem group by l_suppkey""",
)
def hash_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per address: rows, the different slots they got and the mark in each; ``spread`` if many slots are used."""
    rows = encode.hash_features(["source_ip"], n=64).transform(flows(spark, sf_dir))
    values = vector_to_array("hashed")
    slotted = rows.select("source_ip", F.array_position(values, 1.0).alias("slot"), F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("marks"), F.size(values).alias("width"))
    own = slotted.groupBy("source_ip").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("marks").alias("marks"), F.max("width").alias("width"))
    used = slotted.agg((F.count_distinct("slot") >= F.least(F.count_distinct("source_ip"), F.lit(64)) / 2).alias("spread"))
    return own.crossJoin(F.broadcast(used))  # one row
