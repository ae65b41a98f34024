"""Extractor registry and feature catalogue: which columns belong to which model, and running named steps with their status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes of feature names and the extractor they come from.
PREFIXES = {
    "oc_": "basic_audio", "lbrs_": "librosa_spectral", "osm_": "opensmile", "AS_": "audiostretchy", "ser_": "speech_emotion", "arvs_": "heinsen_sentiment", "MELD_": "meld_emotion", "WhX_": "whisperx_transcription", "xlsr_": "xlsr_speech_to_text",
    "s2t_": "s2t_speech_to_text", "DEB_": "deberta_text", "CSE_": "simcse_text", "alb_": "albert_text", "BERT_": "sbert_text", "USE_": "use_text", "elmo_": "elmo_text", "PARE_": "pare_vision", "vit_": "vitpose_vision", "psa_": "psa_vision",
    "eln_": "emotieffnet_vision", "GMP_": "mediapipe_pose_vision", "openPose_": "openpose_vision", "pf_": "pyfeat_vision", "ann_": "me_graphau_vision", "dan_": "dan_vision", "GAN_": "ganimation_vision", "arbex_": "arbex_vision", "indm_": "instadm_vision",
    "of_": "crowdflow_vision", "DHiR_": "deep_hrnet_vision", "SBH_": "simple_baselines_vision", "rsn_": "rsn_vision", "ViF_": "videofinder_vision", "GCN_": "lanegcn_vision", "net_": "smoothnet_vision", "AVH_": "avhubert_vision", "FACT_": "fact_vision",
    "VFE_": "video_frames_vision", "RIFE_": "rife_vision",
}


def longest_prefix(names: DataFrame, name: str, catalog: DataFrame) -> DataFrame:
    """names with the columns of the catalogue's row (prefix, ...) whose prefix is the longest that a name starts with; null without one.

    Each different name is cut at the lengths that the catalogue has, and the cuts meet the prefixes by equality: no comparison
    of every name with every prefix. Of equal prefixes the least row counts.
    """
    rows = catalog.groupBy("prefix").agg(F.min(F.struct(*[c for c in catalog.columns if c != "prefix"])).alias("__row"))
    lengths = F.broadcast(rows.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("__lengths")).withColumn("__one", F.lit(1)))  # one row
    own = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("__one", F.lit(1)).join(lengths, "__one").drop("__one")
    cuts = own.withColumn("__n", F.explode(F.filter("__lengths", lambda n: n <= F.length(name)))).withColumn("prefix", F.substring(F.col(name), F.lit(1), F.col("__n")))
    found = cuts.join(rows, "prefix").groupBy(name).agg(F.max_by(F.struct("prefix", "__row.*"), "__n").alias("__found"))
    return names.join(found.select(name, "__found.*"), name, "left")


def by_model(features: DataFrame) -> DataFrame:
    """features (feature, ...) with their model; the longest prefix wins, else Other."""
    catalog = features.sparkSession.createDataFrame([(k, v) for k, v in PREFIXES.items()], "prefix string, model string")
    return longest_prefix(features, "feature", catalog).withColumn("model", F.coalesce("model", F.lit("Other"))).drop("prefix")


def by_pattern(names: DataFrame, name: str, patterns: list[str], order: str) -> DataFrame:
    """Each different name that matches one of the globs, in the order of its first appearance: name, position, pattern (the first
    that matches). Raises ValueError where nothing does."""
    import fnmatch

    pattern = None
    for p in patterns:
        hit = F.col(name).rlike("^" + fnmatch.translate(p).replace("(?s:", "(?:").replace("\\z", "\\Z").replace("\\Z", "$"))
        pattern = F.when(hit, p) if pattern is None else pattern.when(hit, p)
    first = names.groupBy(name).agg(F.min(order).alias("__at")).withColumn("pattern", pattern).where("pattern IS NOT NULL")
    if first.isEmpty():
        raise ValueError(f"no name matches any of {patterns}")
    # names are few by nature: columns of recordings
    return first.withColumn("position", F.row_number().over(Window.orderBy("__at", name)) - 1).drop("__at")


Step = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, tuple[tuple[str, ...], Step]] = {}


def extractor(name: str, needs: tuple[str, ...] = ()) -> Callable[[Step], Step]:
    """Registers a step: a function of a DataFrame that has the columns it needs."""

    def add(f: Step) -> Step:
        EXTRACTORS[name] = (needs, f)
        return f

    return add


def run_extractors(df: DataFrame, names: list[str], skip: tuple[str, ...] = ()) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Applies steps in order; one that is unknown, unwanted, lacks a column or can't be planned is passed over and reported."""
    status = []
    for name in names:
        if name in skip:
            status.append((name, "skipped", "by request"))
        elif name not in EXTRACTORS:
            status.append((name, "failed", "unknown"))
        elif missing := [c for c in EXTRACTORS[name][0] if c not in df.columns]:
            status.append((name, "skipped", f"no {', '.join(missing)}"))
        else:
            try:
                df = EXTRACTORS[name][1](df)
                status.append((name, "ok", ""))
            except Exception as e:
                status.append((name, "failed", str(e).splitlines()[0][:200]))
    return df, status


def run_summary(status: DataFrame) -> DataFrame:
    """Steps by outcome: n, and the share of all."""
    out = status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
