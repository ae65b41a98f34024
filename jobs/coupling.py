"""Coupling of all dyads by several methods, computed only where it is due.

    python jobs/coupling.py SOURCE OUT [--config jobs/coupling.json]

SOURCE is a Parquet table of measurements; `columns` of the settings say by SQL expressions what is dyad, person (A or B), feature,
t (seconds) and value. A run writes

    OUT/results/method=M/dyad=D          fingerprint, dimension, window_time, metric, value
    OUT/ledger/method=M/dyad=D           fingerprint, status (done or failed), message, n_rows

A dyad's fingerprint follows from all its measurements, the settings that bear on results and `version`. Due is a dyad by a method
unless the ledger holds that fingerprint as done: new dyads, dyads with new or changed measurements, methods added to the settings,
and what failed. Only due dyads are binned and paired. Results are written before their ledger rows, both by overwriting the
partitions of the dyads at hand, so a run that broke off is made up for by the next one, and a run without news writes nothing.
Results count where the ledger vouches for their fingerprint, so none are left over of measurements that no longer give any.
Measurements without dyad, person or t are left out; what was done of dyads that leave SOURCE stays.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.operators import align, synchrony

SETTINGS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "coupling.json")
KEY = ["dyad", "dimension"]
LEDGER = "method string, dyad bigint, fingerprint string, status string, message string, n_rows bigint"
log = logging.getLogger("jobs.coupling")


def _long(df: DataFrame, **metrics: str) -> DataFrame:
    """dyad, dimension, window_time, metric, value of the metrics (name=column) that aren't null."""
    wide = df.select(*KEY, "window_time", *[F.col(c).cast("double").alias(m) for m, c in metrics.items()])
    return wide.unpivot([*KEY, "window_time"], list(metrics), "metric", "value").where("value IS NOT NULL")


def _windows(pair: DataFrame, s: dict, of: str) -> DataFrame:
    swept = synchrony.windowed(pair, s["width"], s["step"], s["low"], s["high"])
    return synchrony.windowed_peaks(swept, of=of).withColumn("window_time", F.col("start") * F.lit(float(s["bin"])))


def overall(pair: DataFrame, s: dict) -> DataFrame:
    whole = synchrony.overall(pair).withColumn("window_time", F.lit(None).cast("double"))
    return _long(whole, pearson_r="pearson_pearson_r_overall", pearson_p="pearson_pearson_p_overall", concordance_ccc="concordance_concordance_ccc_overall")


def pearson(pair: DataFrame, s: dict) -> DataFrame:
    return _long(_windows(pair, s, "r"), pearson_r="peak", peak_lag="peak_lag")


def concordance(pair: DataFrame, s: dict) -> DataFrame:
    return _long(_windows(pair, s, "ccc"), concordance_ccc="peak", peak_lag="peak_lag")


def leader(pair: DataFrame, s: dict) -> DataFrame:
    lead = synchrony.leaders(_windows(pair, s, "r")).withColumn("window_time", F.lit(None).cast("double"))
    return _long(lead, median_lag="peak_lag", effect_size="effect_size")


METHODS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"overall": overall, "pearson": pearson, "concordance": concordance, "leader": leader}


def fingerprints(series: DataFrame, settings: dict) -> DataFrame:
    """dyad, fingerprint: of the multiset of its measurements and the settings, in whatever order the rows come."""
    bearing = {k: v for k, v in settings.items() if k != "methods"}
    seal = hashlib.sha256(json.dumps(bearing, sort_keys=True).encode()).hexdigest()[:16]
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "person", "feature", "t", "value").cast("decimal(20,0)")).cast("string")
    rows = series.groupBy("dyad").agg(F.count(F.lit(1)).cast("string").alias("n"), h(1).alias("x"), h(2).alias("y"))
    return rows.select("dyad", F.sha2(F.concat_ws("/", F.lit(seal), "n", "x", "y"), 256).alias("fingerprint"))


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """What has been done and what failed: a row for each method and dyad, none before the first run."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], LEDGER)


def due(prints: DataFrame, done: DataFrame, methods: list[str]) -> DataFrame:
    """method, dyad, fingerprint of what the ledger doesn't hold as done."""
    wanted = prints.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    return wanted.join(done.where("status = 'done'").select("method", "dyad", "fingerprint"), ["method", "dyad", "fingerprint"], "left_anti")


def _write(df: DataFrame, path: str) -> None:
    df.hint("rebalance", "method", "dyad").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "dyad").parquet(path)


def run(spark: SparkSession, source: str, out: str, settings: dict) -> dict[str, int]:
    """Brings OUT up to date with source. Gives the number of dyads done by each method; one that failed isn't in it."""
    methods = list(dict.fromkeys(settings["methods"]))
    columns = [F.expr(e).cast({"dyad": "bigint", "t": "double", "value": "double"}.get(c, "string")).alias(c) for c, e in settings["columns"].items()]
    series = spark.read.parquet(source).select(*columns).where("dyad IS NOT NULL AND person IS NOT NULL AND t IS NOT NULL")
    # written first: what is due has to stay as it is while the ledger changes
    todo_path = f"{out}/due"
    due(fingerprints(series, settings), ledger(spark, out), methods).write.mode("overwrite").parquet(todo_path)
    todo = spark.read.schema("method string, dyad bigint, fingerprint string").parquet(todo_path)
    counts = {r.method: r["count"] for r in todo.groupBy("method").count().collect()}  # a row a method
    log.info("%s: due %s", source, counts or "nothing")
    finished = {}
    for name in [m for m in methods if m in counts]:
        own = todo.where(F.col("method") == name)
        entry = own.withColumns({"status": F.lit("done"), "message": F.lit("")})
        try:
            if name not in METHODS:
                raise ValueError(f"no method {name}")
            rows = series.join(own.select("dyad"), "dyad", "left_semi")
            dense = align.filled(align.densify(align.bin_series(rows, settings["bin"])))
            pair = align.z_scored(align.pairs(dense), ["a", "b"], KEY)
            _write(METHODS[name](pair, settings).join(own, "dyad"), f"{out}/results")
            finished[name] = counts[name]
        except Exception as e:  # noqa: BLE001 - one method's failure is kept in the ledger, the others go on
            log.error("%s failed: %s", name, e)
            entry = own.withColumns({"status": F.lit("failed"), "message": F.lit(str(e).splitlines()[0][:200])})
        sizes = _results(spark, out).groupBy("method", "dyad", "fingerprint").agg(F.count(F.lit(1)).alias("n_rows")) if name in finished else None
        entry = entry.join(sizes, ["method", "dyad", "fingerprint"], "left") if sizes else entry.withColumn("n_rows", F.lit(0))
        _write(entry.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("bigint")), f"{out}/ledger")
        log.info("%s: %d dyads %s, to %s/results", name, counts[name], "done" if name in finished else "failed", out)
    return finished


RESULTS = "method string, dyad bigint, fingerprint string, dimension string, window_time double, metric string, value double"


def _results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(f"{out}/results")


def output(spark: SparkSession, out: str) -> DataFrame:
    """All results that the ledger vouches for."""
    done = ledger(spark, out).where("status = 'done'").select("method", "dyad", "fingerprint")
    return _results(spark, out).join(done, ["method", "dyad", "fingerprint"], "left_semi").drop("fingerprint")


def main(args: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--config", default=SETTINGS)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.config) as f:
        settings = json.load(f)
    spark = SparkSession.builder.appName("coupling").getOrCreate()
    try:
        run(spark, given.source.rstrip("/"), given.out.rstrip("/"), settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
