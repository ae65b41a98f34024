"""The jobs as queries: each runs twice over the whole tables into one new folder, and its output is read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.plans.dialogue import NEG, WORDS
from dyadspark.plans.dyads import WINDOWS_SQL, _peaks_sql
from dyadspark.plans.registry import query, rounded
from dyadspark.sources.fixtures import ccc_sql, corr_sql, r_p_sql
from dyadspark.sources.shared import run_folder
from jobs import coupling, transcripts


@query(f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, {WORDS.format('lower(text)')} AS w, lag(role) OVER o AS p, lag(text) OVER o AS l FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, CASE WHEN l IS NULL THEN NULL WHEN trim(text) = '' THEN 'neutral' WHEN contains(lower(l), lower(text)) OR contains(lower(text), lower(l)) THEN 'entailment'
  WHEN ({NEG.format('l')}) <> ({NEG.format('text')}) THEN 'contradiction' ELSE 'neutral' END AS label FROM t),
u AS (SELECT conv_id, count(DISTINCT x) AS unique_words FROM (SELECT conv_id, unnest(w) AS x FROM t) GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS num_utterances, CAST(sum(len(w)) AS BIGINT) AS num_words, round(avg(len(w)), 6) AS avg_utterance_length, CAST(max(len(w)) AS BIGINT) AS max_utterance_length, count(DISTINCT role) AS num_speakers,
  CAST(sum(CASE WHEN p <> role THEN 1 ELSE 0 END) + 1 AS BIGINT) AS num_dialogues, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (contains(text, '?')) AS n_questions,
  count(*) FILTER (label = 'entailment') AS n_entailment, count(*) FILTER (label = 'contradiction') AS n_contradiction, count(*) FILTER (label = 'neutral') AS n_neutral FROM n GROUP BY conv_id)
SELECT s.*, coalesce(unique_words, 0) AS unique_words, round(num_words / CAST(2.5 AS DOUBLE), 6) AS duration FROM s LEFT JOIN u USING (conv_id)""")
def job1_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    out = run_folder(spark, "transcripts")
    with open(transcripts.SETTINGS) as f:
        settings = json.load(f)
    for _ in range(2):
        transcripts.run(spark, f"{sf}/conversations.parquet", out, settings)
    return rounded(transcripts.output(spark, out))


def _metrics_sql(method: str, source: str, time: str, **metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT '{method}' AS method, dyad, dimension, {time} AS window_time, '{m}' AS metric, round(CAST({v} AS DOUBLE), 6) + 0.0 AS value FROM {source} WHERE {v} IS NOT NULL" for m, v in metrics.items())


START, WHOLE = "start * CAST(21600.0 AS DOUBLE)", "CAST(NULL AS DOUBLE)"


@query(f"""WITH {WINDOWS_SQL}, {_peaks_sql("r")}, {_peaks_sql("ccc").replace("top AS", "ctop AS").replace("best AS", "cbest AS").replace("JOIN top", "JOIN ctop")},
whole AS (SELECT dyad, dimension, {corr_sql("a", "b")} AS r, {ccc_sql("a", "b")} AS c, count(*) AS n FROM pair GROUP BY ALL),
tested AS (SELECT *, {r_p_sql("r", "n")} AS p FROM whole),
lead AS (SELECT dyad, dimension, median(peak_lag) AS peak_lag, avg(peak) AS effect_size FROM best GROUP BY ALL)
{_metrics_sql("overall", "tested", WHOLE, pearson_r="r", pearson_p="p", concordance_ccc="c")} UNION ALL {_metrics_sql("pearson", "best", START, pearson_r="peak", peak_lag="peak_lag")}
UNION ALL {_metrics_sql("concordance", "cbest", START, concordance_ccc="peak", peak_lag="peak_lag")} UNION ALL {_metrics_sql("leader", "lead", WHOLE, median_lag="peak_lag", effect_size="effect_size")}""")
def job2_coupling(spark: SparkSession, sf: str) -> DataFrame:
    out = run_folder(spark, "coupling")
    with open(coupling.SETTINGS) as f:
        settings = json.load(f)
    for _ in range(2):
        coupling.run(spark, f"{sf}/events.parquet", out, settings)
    return rounded(coupling.output(spark, out)).withColumn("dyad", F.col("dyad").cast("long"))
