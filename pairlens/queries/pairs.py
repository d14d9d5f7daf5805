"""Queries over pairs: joins, dedup, components, splits, caps and label statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.config import DatasetConfig
from pairlens.functions.text import text_key
from pairlens.lineage import cut_lineage
from pairlens.operators import joins, stats
from pairlens.operators.dedup import augment_signs, dedup_unordered_pairs, merge_duplicate_labels
from pairlens.operators.ordered import cap_rows
from pairlens.operators.split import component_split, connected_components, split_report
from pairlens.plans.preprocess import preprocess
from pairlens.queries.registry import query
from pairlens.sources import derived
from pairlens.sources.derived import table
from pairlens.sources.loader import with_length_delta

SPLIT_ON = ["prompt", "conversation_id"]


def preferences(spark, sf_dir):
    return with_length_delta(derived.preferences(spark, sf_dir))


def deltas(spark, sf_dir, rows=None):
    """Deltas of the measured pairs ``rows``, which are derived if not given."""
    rows = derived.measured(spark, sf_dir) if rows is None else rows
    vectors = derived.response_embeddings(spark, sf_dir)
    return joins.response_deltas(rows, vectors, F.col("key_a"), F.col("key_b"), materialised=True)


def stored_deltas(spark, sf_dir):
    """Deltas for jobs that read them more than once."""
    return cut_lineage(deltas(spark, sf_dir))


@query(
    "SELECT row_id, md5(prompt) AS prompt, md5(response_A) AS a, md5(response_B) AS b, label, conversation_id FROM prefs",
    ("prefs",),
)
def preference_rows(spark, sf_dir):
    return derived.preferences(spark, sf_dir).select(
        "row_id", F.md5("prompt").alias("prompt"), F.md5("response_A").alias("a"), F.md5("response_B").alias("b"),
        "label", "conversation_id",
    )


@query("SELECT row_id, label FROM prefs WHERE label IN (0, 1)", ("prefs",))
def binary_label_rows(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir)
    return prefs.filter(stats.is_binary_label(F.col("label"))).select("row_id", "label")


@query("SELECT row_id FROM prefs ORDER BY md5('42|' || row_id), row_id LIMIT 300", ("prefs",))
def capped_rows(spark, sf_dir):
    return cap_rows(derived.preferences(spark, sf_dir).select("row_id"), 300)


@query("SELECT row_id, CAST(i - 1 AS INTEGER) AS dim, delta[i]::double AS value FROM deltas, (SELECT unnest(range(1, 65)) AS i)", ("deltas",))
def response_delta_vectors(spark, sf_dir):
    long = deltas(spark, sf_dir).select("row_id", F.posexplode("delta").alias("dim", "value"))
    return long.select("row_id", "dim", F.col("value").cast("double").alias("value"))


@query(
    """, wanted AS (SELECT DISTINCT t FROM (SELECT response_A AS t FROM prefs UNION ALL SELECT response_B FROM prefs)),
    cache AS (SELECT DISTINCT response_A AS t FROM prefs WHERE label IN (0, 1))
    SELECT sha256(t) AS text_key, t IN (SELECT t FROM cache) AS hit FROM wanted""",
    ("prefs",),
)
def cache_hits_and_misses(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir)
    wanted = prefs.select(F.explode(F.array("response_A", "response_B")).alias("t")).select(text_key(F.col("t")).alias("text_key")).distinct()
    cache = prefs.filter(stats.is_binary_label(F.col("label"))).select(text_key(F.col("response_A")).alias("text_key"))
    hits, misses = joins.cached_split(wanted, cache, ["text_key"])
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


@query(
    """SELECT DISTINCT sha256(d.text) AS text_key FROM documents d
       WHERE d.text NOT IN (SELECT d2.text FROM documents d2 JOIN labels l USING (doc_id))
          OR d.text NOT IN (SELECT d3.text FROM documents d3 JOIN labels l USING (doc_id) WHERE l.toxic = 1)"""
)
def texts_lacking_an_annotation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text_key(F.col("text")).alias("text_key"))
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    tasks = joins.text_concept_tasks(docs.select("text_key").distinct(), ["quality", "toxic"]).select("text_key", "concept_key")
    cached = labelled.select(
        "text_key",
        F.explode(F.array(
            F.struct(F.sha2(F.lit("quality"), 256).alias("k"), F.col("quality").alias("v")),
            F.struct(F.sha2(F.lit("toxic"), 256).alias("k"), F.when(F.col("toxic") == 1, 1).alias("v")),
        )).alias("e"),
    ).groupBy("text_key", F.col("e.k").alias("concept_key")).agg(F.max("e.v").alias("annotation"))
    return joins.texts_to_reannotate(tasks, cached)


@query(
    """SELECT doc_id, sha256(concept) AS concept_key FROM documents
       CROSS JOIN (VALUES ('asks questions'), ('contains digits'), ('is written at greater length')) c(concept)"""
)
def text_concept_tasks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    concepts = ["asks questions", "contains digits", "is written at greater length"]
    return joins.text_concept_tasks(docs, concepts).select("doc_id", "concept_key")


@query(
    """SELECT row_id FROM (SELECT row_id, row_number() OVER (
         PARTITION BY least(response_A, response_B), greatest(response_A, response_B)
         ORDER BY md5('42|' || row_id)) AS r FROM prefs) WHERE r = 1""",
    ("prefs",),
)
def unordered_pair_dedup(spark, sf_dir):
    return dedup_unordered_pairs(derived.preferences(spark, sf_dir)).select("row_id")


@query(
    """SELECT min(row_id) AS row_id, CAST(round_even(avg(label), 0) AS INTEGER) AS label,
       arg_min(length_delta, row_id) AS length_delta FROM rows GROUP BY prompt, response_A, response_B""",
    ("rows",),
)
def merged_duplicate_labels(spark, sf_dir):
    return merge_duplicate_labels(preferences(spark, sf_dir)).select("row_id", "label", "length_delta")


@query(
    """SELECT row_id, CAST(s AS INTEGER) AS sign, CAST(i - 1 AS INTEGER) AS dim, s * delta[i]::double AS value
       FROM deltas, (SELECT unnest([1, -1]) AS s), (SELECT unnest(range(1, 65)) AS i)""",
    ("deltas",),
)
def sign_augmented_deltas(spark, sf_dir):
    both = augment_signs(deltas(spark, sf_dir)).select("row_id", "sign", F.posexplode("delta").alias("dim", "value"))
    return both.withColumn("value", F.col("value").cast("double"))


@query("SELECT row_id, component FROM components", ("components",))
def row_components(spark, sf_dir):
    return connected_components(derived.preferences(spark, sf_dir), SPLIT_ON)


@query("SELECT row_id, min(row_id) OVER (PARTITION BY prompt) AS component FROM prefs", ("prefs",))
def prompt_components(spark, sf_dir):
    return connected_components(derived.preferences(spark, sf_dir), ["prompt"])


@query("SELECT row_id, split FROM split", ("split",))
def leakage_free_split(spark, sf_dir):
    return component_split(derived.preferences(spark, sf_dir), SPLIT_ON).select("row_id", "split")


@query(
    """SELECT split, count(*) AS n_rows, count(DISTINCT component) AS n_components,
       round(count(*) / sum(count(*)) OVER (), 9) AS share FROM split GROUP BY split""",
    ("split",),
)
def split_sizes(spark, sf_dir):
    report = split_report(component_split(derived.preferences(spark, sf_dir), SPLIT_ON))
    return report.withColumn("share", F.round("share", 9))


@query(
    """, sided AS (SELECT p.*, split FROM prefs p JOIN split s USING (row_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY split, least(response_A, response_B), greatest(response_A, response_B)
      ORDER BY md5('42|' || row_id)) AS r FROM sided)
    SELECT split AS subset, row_id FROM sided
    UNION ALL SELECT split || '_pred', row_id FROM sided WHERE label IN (0, 1)
    UNION ALL SELECT 'dedup_' || split, row_id FROM ranked WHERE r = 1""",
    ("prefs", "split"),
)
def preprocessed_subsets(spark, sf_dir):
    cfg = DatasetConfig("derived", sf_dir, SPLIT_ON)
    return preprocess(derived.preferences(spark, sf_dir), cfg).subsets()


_AUC = """SELECT {by} round(sum(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END) / count(*), 9) AS auc
          FROM scored x JOIN scored y ON x.label = 1 AND y.label = 0 {on} {group}"""


@query(
    ", scored AS (SELECT split, label, length_delta AS s FROM rows JOIN split USING (row_id) WHERE label IN (0, 1)) "
    + _AUC.format(by="x.split,", on="AND x.split = y.split", group="GROUP BY x.split"),
    ("rows", "split"),
)
def length_auc_by_split(spark, sf_dir):
    prefs = derived.measured(spark, sf_dir)
    sides = component_split(prefs, SPLIT_ON).select("row_id", "split")
    auc = stats.roc_auc(prefs.select("row_id", "label", "length_delta").join(sides, "row_id"), "label", "length_delta", ("split",))
    return auc.select("split", F.round("auc", 9).alias("auc"))


@query(
    """SELECT CAST(avg(CASE WHEN CAST(length_delta > 0 AS INTEGER) = label THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS accuracy
       FROM rows WHERE label IN (0, 1)""",
    ("rows",),
)
def length_accuracy(spark, sf_dir):
    prefs = derived.measured(spark, sf_dir).select("label", "length_delta")
    return stats.accuracy(prefs, "label", "length_delta", 0.0, strict=True)


@query(
    """, scored AS (SELECT label, length(response_A) - length(response_B) AS s FROM prefs WHERE label IN (0, 1)),
    area AS ("""
    + _AUC.format(by="", on="", group="")
    + """) SELECT auc, round((SELECT avg(CASE WHEN CAST(s > 0 AS INTEGER) = label THEN 1.0 ELSE 0.0 END) FROM scored)::double, 9) AS accuracy FROM area""",
    ("prefs",),
)
def reward_margin_evaluation(spark, sf_dir):
    scores = derived.preferences(spark, sf_dir).select(
        "label", F.length("response_A").alias("score_A"), F.length("response_B").alias("score_B")
    )
    return stats.margin_evaluation(scores).select(F.round("auc", 9).alias("auc"), F.round("accuracy", 9).alias("accuracy"))


@query(
    """, m AS (SELECT avg(length_delta::double) AS mu, stddev_pop(length_delta::double) AS sd FROM rows JOIN split USING (row_id) WHERE split = 'train')
    SELECT row_id, round((length_delta - mu) / sd, 6) AS z FROM rows, m""",
    ("rows", "split"),
)
def standardised_length(spark, sf_dir):
    prefs = derived.measured(spark, sf_dir)
    sides = component_split(prefs, SPLIT_ON).select("row_id", "split")
    rows = prefs.select("row_id", "length_delta").join(sides, "row_id")
    train, val = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    scaled = stats.standardise(train, val, ["length_delta"])
    return scaled[0].unionByName(scaled[1]).select("row_id", F.round("length_delta", 6).alias("z"))
