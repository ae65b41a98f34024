"""The jobs over growing input, after failures, and by their command lines."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA, ROOT

from jobs import coupling, transcripts

STATES = {"files_per_batch": 1, "conversations_per_part": 10}


def files(path):
    """Every data file below a folder with its time."""
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def add(df, folder, name):
    """df as one more file of a folder, as new data arrive."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    part = next(x for x in os.listdir(f"{folder}-{name}") if x.endswith(".parquet"))
    shutil.copy(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def test_transcripts_over_growing_input(spark, tmp_path):
    turns, source, out = spark.read.parquet(f"{DATA}/conversations.parquet"), str(tmp_path / "in"), str(tmp_path / "out")
    old = (F.col("conv_id") < 15) & (F.col("turn") < 2)
    add(turns.where(old), source, "a")
    first = transcripts.run(spark, source, out, STATES)
    assert first["turns"] == turns.where(old).count() and first["batches"] == 1
    before = files(f"{out}/conversations")
    assert transcripts.run(spark, source, out, STATES) == {"batches": 0, "turns": 0, "conversations": 0}
    assert files(f"{out}/conversations") == before
    later = turns.where(~old & (F.col("conv_id") >= 10))  # late turns of conversations of part 1, and new parts
    add(later, source, "b")
    assert transcripts.run(spark, source, out, STATES)["turns"] == later.count()
    kept = {k: v for k, v in files(f"{out}/conversations").items() if "part=0/" in k}
    assert kept == {k: v for k, v in before.items() if "part=0/" in k} != {}
    add(turns.where(~old & (F.col("conv_id") < 10)), source, "c")
    transcripts.run(spark, source, out, STATES)
    whole = str(tmp_path / "whole")
    transcripts.run(spark, f"{DATA}/conversations.parquet", whole, STATES)
    got = rows(transcripts.output(spark, out))
    assert got == rows(transcripts.output(spark, whole)) and len(got) == turns.select("conv_id").distinct().count()


def test_transcripts_batch_again_and_odd_rows(spark, tmp_path, monkeypatch):
    """A batch that fails after its turns are written runs again; turns sent again replace the earlier ones."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = transcripts.SCHEMA
    add(spark.createDataFrame([(1, 0, "user", "Is it?"), (1, 1, None, None), (1, 2, "user", "  "), (None, 0, "user", "lost"), (2, None, "user", "no turn"), (-3, 0, "user", "below zero")], schema), source, "a")
    whole = transcripts.conversations

    def broken(turns):
        raise RuntimeError("lost")

    monkeypatch.setattr(transcripts, "conversations", broken)
    with pytest.raises(Exception, match="lost"):
        transcripts.run(spark, source, out, STATES)
    monkeypatch.setattr(transcripts, "conversations", whole)
    transcripts.run(spark, source, out, STATES)
    got = {r.conv_id: r for r in transcripts.output(spark, out).collect()}
    assert set(got) == {1, 2, -3} and (got[1].num_utterances, got[1].num_words, got[1].n_questions) == (3, 2, 1)
    add(spark.createDataFrame([(1, 1, "assistant", "It is not so.")], schema), source, "b")
    transcripts.run(spark, source, out, STATES)
    got = {r.conv_id: r for r in transcripts.output(spark, out).collect()}
    assert (got[1].num_utterances, got[1].num_words, got[1].num_speakers, got[1].n_contradiction) == (3, 6, 2, 1)
    add(spark.createDataFrame([(None, 0, "user", "only lost rows")], schema), source, "c")
    assert transcripts.run(spark, source, out, STATES)["turns"] == 0


@pytest.fixture(scope="module")
def settings():
    with open(coupling.SETTINGS) as f:
        return json.load(f)


def test_coupling_over_growing_input(spark, tmp_path, settings):
    events, source, out = spark.read.parquet(f"{DATA}/events.parquet"), str(tmp_path / "in"), str(tmp_path / "out")
    dyad = F.floor(F.col("user_id") % 20 / 2)
    add(events.where(dyad < 4), source, "a")
    two = settings | {"methods": ["overall", "pearson"]}
    assert coupling.run(spark, source, out, two) == {"overall": 4, "pearson": 4}
    before = files(out + "/results")
    assert coupling.run(spark, source, out, two) == {} and files(out + "/results") == before
    add(events.where(dyad == 4), source, "b")  # a new dyad
    assert coupling.run(spark, source, out, two) == {"overall": 1, "pearson": 1}
    assert {k: v for k, v in files(out + "/results").items() if k in before} == before
    add(events.where((dyad == 0) & (F.col("value") > 50)).withColumn("value", F.col("value") + 1), source, "c")  # more of a known one
    assert coupling.run(spark, source, out, two | {"methods": ["overall", "leader"]}) == {"overall": 1, "leader": 5}
    assert coupling.run(spark, source, out, two | {"version": 2}) == {"overall": 5, "pearson": 5}
    whole = str(tmp_path / "whole")
    coupling.run(spark, source, whole, two)
    assert rows(coupling.output(spark, out).where("method <> 'leader'")) == rows(coupling.output(spark, whole)) != []
    held = coupling.ledger(spark, out).where("status = 'done'")
    assert held.count() == 15 and held.agg(F.sum("n_rows")).first()[0] == coupling.output(spark, out).count()


def test_coupling_keeps_failures_due(spark, tmp_path, settings, monkeypatch):
    source, out = f"{DATA}/events.parquet", str(tmp_path / "out")
    own = settings | {"methods": ["overall", "broken", "unknown"]}
    n = spark.read.parquet(source).select(F.floor(F.col("user_id") % 20 / 2)).distinct().count()

    def broken(pair, s):
        raise ValueError("no such thing\nsecond line")

    monkeypatch.setitem(coupling.METHODS, "broken", broken)
    assert coupling.run(spark, source, out, own) == {"overall": n}
    failed = {(r.method, r.status, r.message) for r in coupling.ledger(spark, out).collect()}
    assert failed == {("overall", "done", ""), ("broken", "failed", "no such thing"), ("unknown", "failed", "no method unknown")}
    monkeypatch.setitem(coupling.METHODS, "broken", coupling.overall)
    assert coupling.run(spark, source, out, own) == {"broken": n}
    assert {r.method for r in coupling.output(spark, out).select("method").distinct().collect()} == {"overall", "broken"}


def test_coupling_of_no_rows_and_fewer_rows(spark, tmp_path, settings):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    add(events.where("false"), source, "a")
    one = settings | {"methods": ["overall"]}
    assert coupling.run(spark, source, out, one) == {}
    add(events.where("user_id % 20 < 2"), source, "a")
    assert coupling.run(spark, source, out, one) == {"overall": 1} and coupling.output(spark, out).count() > 0
    add(events.where("user_id % 20 = 0"), source, "a")  # one person is left: no pair, so no results, and none of before
    assert coupling.run(spark, source, out, one) == {"overall": 1} and coupling.output(spark, out).count() == 0


@pytest.mark.parametrize(("job", "table", "made"), [("transcripts", "conversations", "conversations"), ("coupling", "events", "results")])
def test_command_line(spark, tmp_path, job, table, made):
    out = str(tmp_path / job)
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    said = subprocess.run(["timeout", "300", sys.executable, f"{ROOT}/jobs/{job}.py", f"{DATA}/{table}.parquet", out], env=env, capture_output=True, text=True, cwd=tmp_path)
    assert said.returncode == 0, said.stderr[-2000:]
    assert f"jobs.{job}" in said.stderr and spark.read.parquet(f"{out}/{made}").count() > 0
