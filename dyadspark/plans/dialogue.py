"""Queries over texts, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.columns import cosine, norm
from dyadspark.operators import text
from dyadspark.plans.registry import query, rounded
from dyadspark.sources import fixtures as fx

WORDS = r"list_filter(string_split_regex(trim({0}), '\s+'), lambda w: w <> '')"


@query("SELECT item_id, i AS pos, s AS sentence FROM (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM benchmark))")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "benchmark").select("item_id", F.posexplode(text.sentences_bare(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


KEPT = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT item_id, len(s) AS n, s[1] AS first, s[len(s)] AS last FROM (SELECT item_id, {KEPT} AS s FROM benchmark)")
def sentence_split_kept(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "benchmark").select("item_id", text.sentences_kept(F.col("text")).alias("s"))
    return s.select("item_id", F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"))


@query(f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words, CAST(len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS n_sentences FROM documents")
def text_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", *text.text_counts(F.col("text")))


@query(f"""WITH t AS (SELECT *, {WORDS.format('lower(text)')} AS w, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
c AS (SELECT conv_id, count(*) AS num_utterances, CAST(sum(len(w)) AS BIGINT) AS num_words, round(avg(len(w)), 6) AS avg_utterance_length, CAST(max(len(w)) AS BIGINT) AS max_utterance_length, count(DISTINCT role) AS num_speakers, CAST(sum(CASE WHEN p <> role THEN 1 ELSE 0 END) + 1 AS BIGINT) AS num_dialogues FROM t GROUP BY conv_id),
u AS (SELECT conv_id, count(DISTINCT x) AS unique_words FROM (SELECT conv_id, unnest(w) AS x FROM t) GROUP BY conv_id)
SELECT c.*, coalesce(unique_words, 0) AS unique_words, round(num_words / CAST(2.5 AS DOUBLE), 6) AS duration FROM c LEFT JOIN u USING (conv_id)""")
def dialogue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.conversation_stats(fx.table(spark, sf, "conversations"), "conv_id", "turn", "role", "text"))


@query("SELECT conv_id, CAST(sum(CASE WHEN p <> role THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id")
def turn_changes(spark: SparkSession, sf: str) -> DataFrame:
    return text.changes(fx.table(spark, sf, "conversations"), ["conv_id"], "turn", "role")


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'click') / CAST(count(*) FILTER (event_type IN ('click', 'view', 'error')) AS DOUBLE) AS c, count(*) FILTER (event_type = 'view') / CAST(count(*) FILTER (event_type IN ('click', 'view', 'error')) AS DOUBLE) AS v, count(*) FILTER (event_type = 'error') / CAST(count(*) FILTER (event_type IN ('click', 'view', 'error')) AS DOUBLE) AS e FROM events GROUP BY user_id)
SELECT user_id, round(c, 6) AS share_click, round(v, 6) AS share_view, round(e, 6) AS share_error, CASE WHEN c >= v AND c >= e THEN 'click' WHEN v >= e THEN 'view' ELSE 'error' END AS dominant, round(greatest(c, v, e), 6) AS intensity FROM s""")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.label_shares(fx.table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "error"]))


PAIR_SQL = "p AS (SELECT conv_id, turn, text AS l, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)"
NEG = "(contains(' ' || lower({0}) || ' ', ' not ') OR contains(lower({0}), 'n''t') OR contains(' ' || lower({0}) || ' ', ' never ') OR contains(' ' || lower({0}) || ' ', ' no '))"


@query(f"""WITH {PAIR_SQL} SELECT conv_id, turn, CASE WHEN trim(r) = '' THEN 'neutral' WHEN contains(lower(l), lower(r)) OR contains(lower(r), lower(l)) THEN 'entailment' WHEN ({NEG.format('l')}) <> ({NEG.format('r')}) THEN 'contradiction' ELSE 'neutral' END AS label FROM p WHERE r IS NOT NULL""")
def nli_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = fx.table(spark, sf, "conversations").withColumn("r", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("r IS NOT NULL")
    return c.select("conv_id", "turn", text.inference_label(F.col("text"), F.col("r")).alias("label"))


ASCII_WORDS = "list_filter(regexp_extract_all(lower({0}), '[0-9a-z_]+'), lambda w: length(w) > 3)"


@query(f"WITH {PAIR_SQL} SELECT conv_id, turn, len(list_intersect({ASCII_WORDS.format('l')}, {ASCII_WORDS.format('r')})) > 0 AS overlap FROM p WHERE r IS NOT NULL")
def qa_overlap(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = fx.table(spark, sf, "conversations").withColumn("r", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("r IS NOT NULL")
    return c.select("conv_id", "turn", text.answerable(F.col("text"), F.col("r")).alias("overlap"))


@query(f"""WITH s AS (SELECT item_id, unnest({KEPT}) AS s FROM benchmark) SELECT item_id, count(*) AS n, count(*) FILTER (len({WORDS.format('s')}) >= 3 AND NOT (lower(s[1]) = s[1] AND upper(s[1]) <> s[1]) AND length(s) - length(replace(s, '(', '')) = length(s) - length(replace(s, ')', ''))
AND len(list_filter({WORDS.format('s')}, lambda w: length(w) > 25)) = 0) AS n_acceptable FROM s GROUP BY item_id""")
def cola_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "benchmark").select("item_id", F.explode(text.sentences_kept(F.col("text"))).alias("s"))
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.acceptable(F.col("s"))).alias("n_acceptable"))


@query(rf"""WITH t AS (SELECT item_id, text, {WORDS.format('text')} AS w, strpos(text, ' not ') AS a, strpos(text, 'n''t') AS b FROM benchmark)
SELECT item_id, lower(text) AS lowered, CASE WHEN len(w) >= 3 THEN array_to_string(list_append(w[2:], w[1]), ' ') ELSE text END AS rotated, regexp_replace(text, '(?i)\bthe\b', 'a', 'g') AS the_to_a, text || ' in this context.' AS expanded,
CASE WHEN contains(lower(text), ' not ') THEN CASE WHEN a > 0 THEN substr(text, 1, a - 1) || ' ' || substr(text, a + 5) ELSE text END
  WHEN contains(lower(text), 'n''t') THEN CASE WHEN b > 0 THEN substr(text, 1, b - 1) || substr(text, b + 3) ELSE text END ELSE text || ' not' END AS negated,
text || ' ' || text AS repeated, reverse(text) AS inverted, 'What happens when ' || lower(text) AS asked FROM t""")
def perturbations(spark: SparkSession, sf: str) -> DataFrame:
    p = text.perturbations(F.col("text"))
    return fx.table(spark, sf, "benchmark").select("item_id", *[c.alias(k) for k, c in p.items()])


@query()
def sequence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = fx.table(spark, sf, "conversations").withColumn("s", F.element_at(text.sentences_kept(F.col("text")), 1)).withColumn("r", F.lead("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("r IS NOT NULL")
    return rounded(c.select("conv_id", "turn", text.sequence_ratio(F.col("s"), F.col("r")).alias("ratio")))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) / (sqrt(list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))))
* sqrt(list_dot_product(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))))), 5) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_similarity(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings")
    left, right = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return rounded(left.join(right, "b").select("a", "b", cosine(F.col("x"), F.col("y")).alias("cosine")), 5)


@query("""WITH l AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM l GROUP BY ALL),
d AS (SELECT label, vec_id, sqrt(sum(power(x - c, 2))) AS d FROM l JOIN c USING (label, i) GROUP BY ALL) SELECT label, count(*) AS n, round(avg(d), 5) AS centroid_distance, round(var_pop(d), 5) AS spread_variance FROM d GROUP BY label""")
def embedding_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.embedding_spread(fx.table(spark, sf, "embeddings"), ["label"], "embedding"), 5)


@query("SELECT vec_id, round(sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def embedding_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.table(spark, sf, "embeddings").select("vec_id", norm(F.col("embedding")).alias("norm")), 5)


@query("""WITH b AS (SELECT item_id, list_transform(range(0, 32), lambda i: CAST(CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER) AS DOUBLE)) AS b FROM benchmark)
SELECT item_id, CAST(i AS INTEGER) AS i, round((b[i % 32 + 1] - list_avg(b)) / (list_stddev_pop(b) + 1e-6), 5) + 0.0 AS value FROM (SELECT *, unnest(range(0, 128)) AS i FROM b)""")
def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """All 128 numbers, one a row."""
    e = fx.table(spark, sf, "benchmark").select("item_id", F.posexplode(text.hashed_embedding(F.col("text"))).alias("i", "value"))
    return rounded(e, 5)


@query("""WITH v AS (SELECT vec_id, CAST(abs(embedding[1]) AS DOUBLE) AS a, CAST(abs(embedding[2]) AS DOUBLE) AS h, CAST(abs(embedding[3]) AS DOUBLE) AS s, CAST(abs(embedding[4]) AS DOUBLE) AS n, CAST(embedding[5] AS DOUBLE) AS l, CAST(embedding[6] AS DOUBLE) AS g FROM embeddings),
x AS (SELECT *, a / (a + h + s + n) AS a1, h / (a + h + s + n) AS h1, s / (a + h + s + n) AS s1, n / (a + h + s + n) AS n1, greatest(-0.5, least(0.5, 0.35 * l + 0.15 * g)) AS m FROM v),
e AS (SELECT *, exp(-0.22 + 2.10 * a1 - 1.35 * h1 + 1.75 * s1 - 0.42 * n1) AS e0, exp(0.10 - 0.35 * a1 + 0.42 * h1 - 0.28 * s1 + 1.67 * n1) AS e1, exp(0.12 - 1.85 * a1 + 2.24 * h1 - 1.47 * s1 + 0.31 * n1) AS e2 FROM x),
p AS (SELECT vec_id, greatest(1e-5, e0 / (e0 + e1 + e2) - m) AS p0, greatest(1e-5, e1 / (e0 + e1 + e2) - 0.5 * m) AS p1, greatest(1e-5, e2 / (e0 + e1 + e2) + m) AS p2 FROM e)
SELECT vec_id, round(p0 / (p0 + p1 + p2), 5) AS arvs_negative, round(p1 / (p0 + p1 + p2), 5) AS arvs_neutral, round(p2 / (p0 + p1 + p2), 5) AS arvs_positive, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative' WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END AS arvs_dominant_sentiment, round(greatest(p0, p1, p2) / (p0 + p1 + p2), 5) AS arvs_confidence FROM p""")
def logistic_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    x = [F.col("embedding")[i].cast("double") for i in range(6)]
    return rounded(fx.table(spark, sf, "embeddings").select("vec_id", *text.logistic_sentiment(F.abs(x[0]), F.abs(x[1]), F.abs(x[2]), F.abs(x[3]), x[4], x[5])), 5)


@query("""SELECT o_custkey AS recording, o_orderpriority AS speaker, count(*) AS n_words, round(sum(CASE WHEN o_orderkey % 7 > o_orderkey % 3 THEN CAST(o_orderkey % 7 - o_orderkey % 3 AS DOUBLE) ELSE 0 END), 4) AS speaking_time, round(avg(o_totalprice), 4) AS avg_score FROM orders GROUP BY ALL""")
def speaker_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("recording"), F.col("o_orderpriority").alias("speaker"), (F.col("o_orderkey") % 3).cast("double").alias("start"), (F.col("o_orderkey") % 7).cast("double").alias("end"), F.col("o_totalprice").alias("score"))
    return rounded(text.speaker_summary(o, "recording"), 4)


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS k FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))
SELECT o.o_orderkey, m.o_orderpriority AS mapped FROM orders o JOIN n USING (o_custkey, o_orderpriority) JOIN n m ON m.o_custkey = o.o_custkey AND m.k = n.k % 2""")
def speaker_cap(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "speaker")
    return text.capped_speakers(o, "o_custkey", 2).select("o_orderkey", "mapped")


@query(f"""WITH w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations), s AS (SELECT conv_id, turn, w, greatest(10.0, 0.25 * len(w)) / len(w) AS step FROM w WHERE len(w) > 0)
SELECT conv_id, turn, w[1] AS first_word, round(CAST(step AS DOUBLE), 3) AS first_end, round(CAST(len(w) * step AS DOUBLE), 3) AS last_end FROM s""")
def word_alignment(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", text.uniform_alignment(F.col("text"), F.lit(10.0)).alias("w")).where(F.size("w") > 0)
    return c.select("conv_id", "turn", F.col("w")[0]["word"].alias("first_word"), F.col("w")[0]["end"].alias("first_end"), F.element_at("w", -1)["end"].alias("last_end"))


@query("""WITH x AS (SELECT source, d.doc_id, n_chars > 800 AS p, quality = 1 AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT source, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn, avg(CASE WHEN p THEN 0.9 ELSE 0.1 END) AS m FROM x GROUP BY source),
r AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS pr, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS re FROM c)
SELECT source, tp, fp, fn, tn, round(CASE WHEN tp + fn = 0 OR fp + tn = 0 THEN m ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) END, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1,
round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 AS mcc FROM r""")
def agreement_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id").withColumn("score", F.when(F.col("n_chars") > 800, 0.9).otherwise(0.1))
    return rounded(text.agreement(d, ["source"], "score", "quality"))


@query("SELECT source, doc_id, n_chars, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 10")
def passage_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return text.ranked_passages(fx.table(spark, sf, "documents"), ["source"], "n_chars", "doc_id").select("source", "doc_id", "n_chars", "rank")


#: Names with the label and the feature name that they are read as.
NAMES = [
    ("ENTAILMENT", "entailment", "osm_ENTAILMENT"), ("LABEL_0", "contradiction", "osm_LABEL_0"), ("unacceptable", "acceptable", "osm_unacceptable"), ("not_duplicate", "positive", "osm_not_duplicate"), ("none", "negative", "osm_none"),
    ("mfcc_sma[3]", "mfcc_sma[3]", "osm_mfcc3_sma"), ("audSpec_Rfilt_sma[12]", "audspec_rfilt_sma[12]", "osm_audSpec_Rfilt_sma_12"), ("lspFreq_sma[7]", "lspfreq_sma[7]", "osm_lsf7"), ("a.b-c[1]", "a.b-c[1]", "osm_a_b_c_1"),
]


@query(f"SELECT event_id, n, label, name FROM events JOIN (VALUES {', '.join(str((i, *x)) for i, x in enumerate(NAMES))}) t(k, n, label, name) ON event_id % {len(NAMES)} = k")
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(x[0]) for x in NAMES]), (F.col("event_id") % len(NAMES) + 1).cast("int")).alias("n"))
    return n.select("event_id", "n", text.label_name(F.col("n")).alias("label"), text.clean_name(F.col("n")).alias("name"))


@query("SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''), props) AS text FROM events")
def text_source(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events")
    return e.select("event_id", text.first_text(F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.col("event_type")), F.col("props")).alias("text"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({WORDS.format('lower(text)')}) AS w FROM conversations)
SELECT a.conv_id, count(*) AS n_pairs, CAST(max(len(list_intersect(a.w, b.w))) AS BIGINT) AS most_shared FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id""")
def sentence_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of turns of a conversation: an equality join on the conversation with the order as residual."""
    w = F.array_distinct(F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda x: x != ""))
    t = fx.table(spark, sf, "conversations").select("conv_id", "turn", w.alias("w"))
    b = t.select("conv_id", F.col("turn").alias("turn_b"), F.col("w").alias("w_b"))
    both = t.join(b, "conv_id").where("turn < turn_b")
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.max(F.size(F.array_intersect("w", "w_b"))).cast("long").alias("most_shared"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def transcript_join(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").where(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("transcript"))


@query(r"""WITH s AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM benchmark),
u AS (SELECT item_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS i FROM s)
SELECT item_id, 'SPEAKER_0' || (i % 2) AS speaker, count(*) AS n_utterances, CAST(sum(length(text)) AS BIGINT) AS letters, CAST(sum(len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM u GROUP BY item_id, i % 2""")
def alternating_speakers(spark: SparkSession, sf: str) -> DataFrame:
    u = fx.table(spark, sf, "benchmark").select("item_id", F.explode(text.alternating_speakers(text.sentences_bare(F.col("text")))).alias("u")).select("item_id", "u.*")
    return u.groupBy("item_id", "speaker").agg(F.count(F.lit(1)).alias("n_utterances"), F.sum("length").alias("letters"), F.sum("word_count").alias("words"))


@query("""WITH l AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS o, l_discount AS p, l_quantity AS t, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0 AS rp,
rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rt FROM lineitem),
c AS (SELECT l_suppkey, count(*) AS n, min(t) = max(t) AS alike, arg_min(p, o) AS first, avg(p) AS mean, CASE WHEN min(t) < max(t) AND min(p) < max(p) THEN corr(p, t) END AS r, CASE WHEN min(t) < max(t) AND min(p) < max(p) THEN corr(CAST(rp AS DOUBLE), CAST(rt AS DOUBLE)) END AS s FROM l GROUP BY l_suppkey)
SELECT l_suppkey, n, round(r, 6) AS pearson, round(s, 6) AS spearman, round(CASE WHEN alike THEN first ELSE coalesce((r + s) / 2, mean) END, 6) AS score FROM c""")
def correlation_score(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(text.correlation_score(l, ["l_suppkey"], "l_discount", "l_quantity", "o"))


@query("""SELECT o_custkey, round(coalesce(arg_min(o_totalprice, o_orderkey) FILTER (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%'), max(o_totalprice)), 4) AS score FROM orders GROUP BY o_custkey""")
def positive_score(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("score")))).alias("c"))
    return rounded(o.select("o_custkey", text.positive_score(F.col("c"), ["1-", "2-"]).alias("score")), 4)


@query(f"""WITH s AS (SELECT doc_id, {KEPT.replace('text', 'lower(text)')} AS s FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, s, list_filter(s, lambda x, i: list_position(s, x) = i) AS d FROM s)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CAST(len(d) AS BIGINT) AS n_distinct, array_to_string(d, ' ') AS text FROM d""")
def distinct_sentences(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    d = fx.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.sentences_kept(low)).cast("long").alias("n"), text.distinct_sentences(low).alias("d"))
    return d.select("doc_id", "n", F.size("d").cast("long").alias("n_distinct"), F.array_join("d", " ").alias("text"))


@query(rf"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p, len({KEPT}) AS s FROM documents)
SELECT doc_id, CAST(CASE WHEN len(p) = 1 AND length(text) > 200 THEN (s + 2) // 3 ELSE len(p) END AS BIGINT) AS n_paragraphs FROM p""")
def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))
