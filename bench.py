"""Time the headline jobs and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
8), BENCH_NAIVE=1 to also time the re-scan per threshold that the histogram
sweep replaces.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packetloom.operators import anomaly, evaluate, ids, sampling, scale, shape, stats, threshold
from packetloom.operators.frequency_index import fit_frequency_index
from packetloom.plans import ensemble
from packetloom.plans.host_health import train_host_health
from packetloom.plans.queries.inputs import (
    FLOW_KEY,
    FLOW_LAYOUT,
    FLOW_NUMERICS,
    flows,
    host_metrics,
    table,
)
from packetloom.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CATEGORICAL = ["l_returnflag", "l_linestatus", "size_class"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        result = run()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    def load():
        # The tables are single-row-group files, which only one task can read;
        # spread them over the cores once, as files of a real table would be.
        labelled = shape.binary_label(flows(spark, SF_DIR), "verdict", benign="BENIGN", drop=False)
        spread = labelled.repartition(int(CPUS)).persist(), table(spark, SF_DIR, "events").repartition(
            int(CPUS)
        ).persist()
        return [*spread, *[part.count() for part in spread]]

    rows, events, n, _ = timed("load", load)
    plain = rows.select(*FLOW_KEY[:3], *FLOW_NUMERICS, "verdict")

    # one untimed fit and score, so the first job does not carry the start-up
    drain(ids.score(ids.fit_ids(rows.limit(1000), "label", ["l_returnflag"], ["l_tax"]), rows))

    model = timed("ids_fit", lambda: ids.fit_ids(rows, "label", CATEGORICAL, FLOW_NUMERICS))
    scored = ids.score(model, rows)
    timed("batch_score", lambda: drain(scored))
    timed("confusion", lambda: evaluate.confusion(scored, "label", "prediction").collect())

    timed("label_and_scale", lambda: drain(scale.minmax(rows, FLOW_NUMERICS)))
    timed("hash_split", lambda: [drain(part) for part in sampling.split(plain, "l_orderkey")])
    timed("stratified_folds", lambda: drain(sampling.stratified_folds(events, "event_id", "event_type")))
    timed("sample_exact", lambda: drain(sampling.sample_exact(events, "event_id", 0.35)))
    timed("string_index", lambda: drain(fit_frequency_index(rows, ["dest_ip"]).transform(rows.select("l_orderkey", "dest_ip"))))
    timed("describe", lambda: stats.describe(plain, FLOW_NUMERICS).collect())
    timed("covariance", lambda: stats.covariance(plain, FLOW_NUMERICS).collect())

    unit = scale.minmax(rows.select("label", "l_quantity"), ["l_quantity"])
    timed("threshold_sweep", lambda: threshold.threshold_sweep(unit, "label", "l_quantity").collect())
    timed("evaluate", lambda: threshold.evaluate(unit, "label", "l_quantity").collect())
    if os.environ.get("BENCH_NAIVE"):
        start = time.perf_counter()
        for x in threshold.threshold_grid():
            evaluate.detection_stats(unit, "label", "l_quantity", x).collect()
        print("naive sweep seconds", round(time.perf_counter() - start, 3), file=sys.stderr)

    timed("host_health", lambda: train_host_health(host_metrics(spark, SF_DIR))[2].collect())
    linear = timed("anomaly_fit", lambda: anomaly.fit_anomaly(plain, FLOW_NUMERICS, k=2))
    timed("anomaly_score", lambda: drain(anomaly.anomaly_score(linear, plain)))
    # a fit takes a hundred such epochs, each over all rows in batches of ten thousand
    conv = timed(
        "conv_epoch",
        lambda: anomaly.fit_anomaly(plain, FLOW_NUMERICS, method="conv1d", key="l_orderkey", epochs=1),
    )
    timed("conv_score", lambda: drain(anomaly.anomaly_score(conv, plain)))
    stacked = timed("ensemble_fit", lambda: ensemble.ensemble_fit(plain, FLOW_LAYOUT, key=FLOW_KEY[:3]))
    timed("ensemble_score", lambda: drain(ensemble.ensemble_score(stacked, plain)))
    timed("ensemble_score_saved_bounds", lambda: drain(ensemble.ensemble_score(stacked, plain, bounds="saved")))

    rates = {
        name: round(n / times[name])
        for name in ("batch_score", "anomaly_score", "conv_score", "ensemble_score", "ensemble_score_saved_bounds")
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": n,
                "rows_per_second": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
