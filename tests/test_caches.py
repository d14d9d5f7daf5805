"""Versions of annotations, buckets of embeddings."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pairlens.functions.text import text_key
from pairlens.operators import annotate, embed
from pairlens.operators.completion import HashingEmbedder
from pairlens.operators.joins import response_deltas, text_concept_tasks
from pairlens.schema import ANNOTATION_CACHE, EMBEDDING_CACHE
from pairlens.sources import caches
from tests.test_jobs import CONCEPTS, as_dict, failing_completer, texts

KEYS = annotate.KEYS
WHERE = {"model": "m", "prompt_name": "p"}


def rows(spark, *values):
    return spark.createDataFrame(list(values), "concept_key string, text_key string, annotation int")


def read(spark, path):
    return as_dict(caches.read_cache(spark, path, ANNOTATION_CACHE, KEYS, **WHERE))


def test_answers_asked_again_win_on_every_later_read(spark, tmp_path):
    path = str(tmp_path / "multi")
    t = texts(spark, [("aaa", "b"), ("x", "yy?"), ("same", "size")])
    first = as_dict(annotate.annotate_multi(t, CONCEPTS, lambda ps: ["[A, A]"] * len(ps), cache_path=path))
    assert set(first.values()) == {1}
    more = [*CONCEPTS, "contains digits"]
    second = as_dict(annotate.annotate_multi(t, more, lambda ps: ["[B, B, B]"] * len(ps), cache_path=path))
    assert set(second.values()) == {-1} and len(second) == 9
    for _ in range(3):
        assert as_dict(annotate.annotate_multi(t, more, failing_completer, cache_path=path)) == second
    listed = caches.read_cache(spark, path, ANNOTATION_CACHE, KEYS, model="offline", prompt_name="pairwise-annotate-multiconcept")
    assert as_dict(listed) == second and listed.count() == 9


def test_two_writers_and_a_failed_job_leave_one_answer_per_key(spark, tmp_path):
    path = str(tmp_path / "annotations")
    caches.append_cache(rows(spark, ("c", "t", 0), ("c", "u", 0)), path, KEYS, **WHERE)

    def write(i):
        caches.append_cache(rows(spark, ("c", "t", i), ("c", f"own{i}", i)), path, KEYS, **WHERE)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(1, 7)))
    number, listed = caches.commits(spark, path)
    assert number == 7 and len(set(listed)) == 7
    broken = rows(spark, ("c", "t", 9)).withColumn("annotation", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        caches.append_cache(broken, path, KEYS, **WHERE)
    # A job that wrote its rows and died before it published them.
    caches._write_commit(rows(spark, ("c", "t", 9)).withColumns({c: F.lit(v) for c, v in WHERE.items()}), path, list(WHERE))
    got = read(spark, path)
    assert set(got) == {("c", "t"), ("c", "u"), *[("c", f"own{i}") for i in range(1, 7)]}
    assert got["c", "t"] in range(1, 7) and got["c", "u"] == 0
    assert all(read(spark, path) == got for _ in range(3))


def test_compaction_keeps_the_latest_and_what_came_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "annotations")
    for i in range(3):
        caches.append_cache(rows(spark, ("c", "t", i), ("c", f"own{i}", i)), path, KEYS, **WHERE)
    before = read(spark, path)
    real = caches.publish

    def late(spark, path, change):
        monkeypatch.setattr(caches, "publish", real)
        caches.append_cache(rows(spark, ("c", "t", 7)), path, KEYS, **WHERE)
        return real(spark, path, change)

    monkeypatch.setattr(caches, "publish", late)
    caches.compact(spark, path, ANNOTATION_CACHE, KEYS, list(WHERE))
    assert len(caches.commits(spark, path)[1]) == 2
    assert read(spark, path) == before | {("c", "t"): 7}
    monkeypatch.setattr(caches, "MANY_COMMITS", 3)
    for i in (1, 0):
        caches.append_cache(rows(spark, ("c", "u", i)), path, KEYS, **WHERE)
    assert len(caches.commits(spark, path)[1]) == 1
    assert read(spark, path)["c", "u"] == 0


def scans_without_exchange(df):
    """Bucketed scans of the plan, and those with an exchange between them and their join."""
    lines = df._jdf.queryExecution().executedPlan().treeString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    found, moved = 0, 0
    for i, line in enumerate(lines):
        if "FileScan parquet" not in line or "Bucketed: true" not in line:
            continue
        found += 1
        level = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < level:
                level = depth[j]
                if "Exchange" in lines[j]:
                    moved += 1
                if "Join" in lines[j] or "Exchange" in lines[j]:
                    break
    return found, moved


def test_vectors_of_the_cache_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "embeddings")
    t = spark.createDataFrame([(f"text {i}",) for i in range(200)], "text string").withColumn("text_key", text_key(F.col("text")))
    made = embed.embed_texts(t, HashingEmbedder(8), "m", path)
    assert made.count() == 200
    again = spark.createDataFrame([(f"text {i}",) for i in range(100, 300)], "text string").withColumn("text_key", text_key(F.col("text")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cache = caches.bucketed_table(spark, path, EMBEDDING_CACHE, "text_key", model="m")
        misses = embed.cached_split(again, cache, ["text_key"])[1]
        assert misses.count() == 100
        assert scans_without_exchange(misses) == (1, 0)
        assert scans_without_exchange(embed.embed_texts(t, failing_completer, "m", path)) == (1, 0)
        pairs = spark.createDataFrame([(i, f"text {i}", f"text {199 - i}") for i in range(200)], "row_id long, a string, b string")
        deltas = response_deltas(pairs, made, text_key(F.col("a")), text_key(F.col("b")))
        assert deltas.count() == 200
        assert scans_without_exchange(deltas) == (2, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # Another session knows the table by its files alone.
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    spark.sql(f"DROP TABLE {caches._bucketed_entry(spark, path, EMBEDDING_CACHE, 'text_key', {'model': 'm'})[0]}")
    assert embed.embed_texts(
        other.createDataFrame([("text 1",), ("new",)], "text string").withColumn("text_key", text_key(F.col("text"))), HashingEmbedder(8), "m", path
    ).count() == 2


def test_tasks_of_a_cached_model_are_not_asked(spark, tmp_path):
    path = str(tmp_path / "annotations")
    tasks = text_concept_tasks(texts(spark, [("aaa", "b")]), CONCEPTS)
    first = as_dict(annotate.annotate(tasks, lambda ps: ["A"] * len(ps), "m1", cache_path=path))
    number, _ = caches.commits(spark, path)
    assert as_dict(annotate.annotate(tasks, failing_completer, "m1", cache_path=path)) == first
    assert caches.commits(spark, path)[0] == number
