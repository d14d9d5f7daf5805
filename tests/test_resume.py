"""Jobs that stop and go on, sweeps that outlive a failing job, services that hang."""

import json
import threading
import time
import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pairlens import config
from pairlens.operators.completion import Completers, HashingEmbedder, ask, complete, configured, lexical_completer
from pairlens.plans import features, sweep
from pairlens.sources import derived
from pairlens.sources.steps import Steps, fingerprint, table_fingerprint
from tests.test_jobs import SF, small_config


class Killed(BaseException):
    """Not an error that a batch is retried for."""


def logged(folder, name, inner, dies=False):
    def call(items):
        with open(folder / name, "a") as f:
            f.write("".join(f"{zlib.crc32(x.encode())}\n" for x in items))
        if dies:
            raise Killed(name)
        return inner(items)

    return call


def asked(folder, name):
    return (folder / name).read_text().split() if (folder / name).exists() else []


def test_a_killed_job_asks_nothing_twice(spark, tmp_path):
    spec = small_config(cache_dir=str(tmp_path / "cache"))
    spec["sae"]["n_epochs"] = 1
    spec["interpretation"].update(n_candidates=1, scoring_n_examples=10)
    cfg = config.job_config(spec)
    df = derived.preferences(spark, SF).cache()
    log = tmp_path / "log"
    log.mkdir()
    (log / "interpreter").touch()

    def run(dies=None):
        roles = {n: logged(log, n, lexical_completer, n == dies) for n in ("interpreter", "annotator", "abbreviator")}
        return features.run_job(spark, cfg, logged(log, "embedder", HashingEmbedder(16), dies == "embedder"), Completers(**roles), df)

    roles = ("interpreter", "annotator", "abbreviator")
    with pytest.raises(Exception, match="Killed"):
        run("interpreter")
    (log / "interpreter").unlink()
    kept = {"embedder": sorted(asked(log, "embedder"))}
    assert kept["embedder"]
    for done, dies in zip(roles, [*roles[1:], None]):
        if done != "abbreviator":
            with pytest.raises(Exception, match="Killed"):
                run(dies)
            (log / dies).unlink()  # asked in vain
        else:
            result = run()
        for name, before in kept.items():  # what an earlier run has finished is not asked again
            assert name == "embedder" and done == "abbreviator" or sorted(asked(log, name)) == before, (name, dies)
        kept[done] = sorted(asked(log, done))
    kept["embedder"] = sorted(asked(log, "embedder"))  # now with the descriptions
    assert all(kept.values())
    rows = sorted(map(str, result.features.collect()))
    again = run("interpreter")  # nothing is left to ask
    assert {name: sorted(asked(log, name)) for name in kept} == kept
    assert sorted(map(str, again.features.collect())) == rows
    other = config.job_config({**spec, "interpretation": {**spec["interpretation"], "interpreter_model": "another"}})
    with pytest.raises(Exception, match="Killed"):
        features.run_job(spark, other, HashingEmbedder(16), Completers(logged(log, "new", lexical_completer, True), lexical_completer, lexical_completer), df)


def test_fingerprints_follow_rows_and_not_their_order(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    base = table_fingerprint(df, ["id", "x"])
    assert table_fingerprint(df.repartition(7).orderBy(F.desc("id")), ["id", "x"]) == base
    assert table_fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x"))), ["id", "x"]) != base
    assert table_fingerprint(df.union(df.limit(1)).union(df.limit(1)), ["id", "x"]) != base
    assert fingerprint({"a": 1, "b": [2]}) == fingerprint({"b": [2], "a": 1}) != fingerprint({"a": 2})
    steps = Steps(spark, str(tmp_path / "steps"))
    made = []
    for _ in range(2):
        assert steps.table("s", "k", lambda: made.append(1) or df).count() == 50
    assert made == [1]
    with pytest.raises(Exception, match="lost"):
        steps.table("s", "other", lambda: df.withColumn("x", F.raise_error(F.lit("lost")).cast("long")))
    assert steps.table("s", "other", lambda: df).count() == 50


def test_a_bad_configuration_leaves_the_others_and_jobs_overlap(spark, tmp_path, monkeypatch):
    for name in ("one", "two", "worse"):
        (tmp_path / f"{name}.json").write_text(json.dumps({**small_config(name), **({"typo": {}} if name == "worse" else {})}))
    together = threading.Barrier(2, timeout=60)
    pools = {}

    def job(spark, cfg, *args):
        pools[cfg.dataset.name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        together.wait()  # passes only if two jobs run at the same time
        rows = spark.createDataFrame([(cfg.dataset.name + "_metric", float(spark.range(3).count()))], "metric string, value double")
        return SimpleNamespace(summary=rows, selections=SimpleNamespace(aucs=rows.limit(0)))

    monkeypatch.setattr(sweep, "run_job", job)
    monkeypatch.setattr(sweep, "write_job_result", lambda *a, **k: None)
    rows = sweep.run_sweep(spark, str(tmp_path), str(tmp_path / "out"), HashingEmbedder(4), lexical_completer, parallel=2).collect()
    assert {(r.dataset, r.metric, r.value) for r in rows if r.error is None} == {("one", "one_metric", 3.0), ("two", "two_metric", 3.0)}
    failed = [r for r in rows if r.error]
    assert [(r.dataset, r.metric) for r in failed] == [("worse", "failed")] and "typo" in failed[0].error
    assert pools == {"one": "one", "two": "two"}


def prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_a_hanging_service_costs_one_deadline(spark):
    def hangs(ps):
        time.sleep(300)

    start = time.time()
    done = complete(prompts(spark, 300).coalesce(1), ["k"], hangs, lambda a: a, timeout=2.0)
    assert done.count() == 0 and time.time() - start < 25


def test_late_batches_alone_are_asked_again(spark, tmp_path):
    def slow_once(ps):
        with open(tmp_path / "log", "a") as f:
            f.write(f"{ps[0]}\n")
        if ps[0] == "p64" and not (tmp_path / "late").exists():
            (tmp_path / "late").write_text("")
            time.sleep(300)
        return [p.upper() for p in ps]

    got = {r.k: r.answer for r in ask(prompts(spark, 200).coalesce(1), ["k"], slow_once, timeout=5.0).collect()}
    assert got == {i: f"P{i}" for i in range(200)}
    assert sorted((tmp_path / "log").read_text().split()) == ["p0", "p128", "p192", "p64", "p64"]


class Service:
    def __init__(self, **options):
        self.options = options

    def with_options(self, **options):
        return Service(**options)

    def __call__(self, ps):
        return [json.dumps(self.options, sort_keys=True)] * len(ps)


def test_options_act_or_are_rejected(spark):
    given = configured(Service(), model="m", max_tokens=7, temperature=0.5)
    assert given(["p"]) == ['{"max_tokens": 7, "model": "m", "temperature": 0.5}']
    assert configured(lexical_completer, model="m", max_tokens=None) is lexical_completer
    with pytest.raises(ValueError, match="max_tokens"):
        configured(lexical_completer, model="m", max_tokens=7)
    spec = small_config()
    spec["interpretation"]["completion_kwargs"] = {"temperature": 0}
    with pytest.raises(ValueError, match="temperature"):
        features.run_job(spark, config.job_config(spec), HashingEmbedder(4), lexical_completer, derived.preferences(spark, SF))
