"""The pipeline stage by stage against what the stages promise, and the registered queries."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from pairlens.lineage import cut_lineage
from pairlens.llm import line_rules, mixing, ngram_join
from tests.llm.fixtures import SF, documents, no_documents, odd_documents, words
from tests.llm.test_ngram_join import brute
from tests.llm.test_tokens import check_pieces, with_end


@pytest.fixture(scope="module", params=["documents", "odd_documents"])
def stages(request, spark):
    docs = {"documents": documents, "odd_documents": odd_documents}[request.param](spark)
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, cut_lineage(stage(spark, out[-1][1], SF))))
    return dict(out)


# Words that only toxic documents of the test data hold.
INSULTS = set("loser idiot pathetic scum worthless moron trash clown disgusting stupid".split())


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "pack"]


def test_columns_are_those_of_the_documents(stages):
    for name in ("quality", "toxicity", "near_duplicates", "mix"):
        assert stages[name].columns == stages["input"].columns


def test_quality_keeps_what_the_rules_keep(stages):
    verdict = line_rules.judge_documents(stages["input"])
    kept = Counter((r.doc_id, r.n_words) for r in verdict.filter("kept").collect())
    assert Counter((d, len(words(t))) for d, t in rows_of(stages["quality"]).elements()) == kept


def test_toxicity_only_drops(stages):
    before, after = rows_of(stages["quality"]), rows_of(stages["toxicity"])
    assert not after - before and sum(after.values()) >= 0.8 * sum(before.values())


def test_one_document_of_each_class_stays(stages):
    before = list(rows_of(stages["toxicity"]).elements())
    after = rows_of(stages["near_duplicates"])
    _, roots = brute(before, roots=True)
    assert not after - Counter(before) and sum(after.values()) == len(set(roots))
    assert all(links == 0 for _, _, links in brute(list(after.elements())))


def test_mix_takes_documents_as_often_as_rounded(stages):
    copies = Counter()
    for r in mixing.mix_documents(stages["near_duplicates"]).collect():
        copies[(r.doc_id, r["size"])] += r.copies
    got = Counter((d, len(words(t))) for d, t in rows_of(stages["mix"]).elements())
    assert got == +copies and max(got.values()) <= 2


def test_all_ids_of_the_mix_are_packed(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(d, with_end(library, t)) for d, t in rows_of(stages["mix"]).elements()]
    check_pieces(stages["pack"].collect(), want)


def test_an_empty_corpus(spark, tmp_path):
    no_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_planted_cases(spark, tmp_path):
    """Copies, near copies, toxic and clean documents among those of the test data."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    base = [r for r in docs.filter("lang = 'en' and n_chars between 1500 and 3000").orderBy("doc_id").limit(60).collect()]
    clean = [r for r in base if not set(r.text.lower().replace(".", " ").replace(",", " ").split()) & INSULTS]
    near = [(900_000 + i, r.text.replace(" the ", " this ", 1), r.lang, r.source, r.n_chars) for i, r in enumerate(clean[:10])]
    exact = [(910_000 + i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(clean[10:20])]
    toxic = [
        (920_000 + i, r.text[: len(r.text) // 2].rsplit(" ", 1)[0] + " idiot, stupid loser " + r.text[len(r.text) // 2 :][::-1], r.lang, r.source, None)
        for i, r in enumerate(clean[20:30])
    ]
    docs.unionByName(spark.createDataFrame([*near, *exact, *toxic], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.1/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    quality = cut_lineage(corpus_pipeline.quality(spark, rows, str(tmp_path)))
    ids = {r.doc_id for r in quality.select("doc_id").collect()}
    assert {r[0] for r in near + exact} <= ids
    calm = cut_lineage(corpus_pipeline.toxicity(spark, quality, str(tmp_path)))
    left = {r.doc_id for r in calm.select("doc_id").collect()}
    assert not {r[0] for r in toxic} & left and {r[0] for r in near + exact} <= left
    classes = {r.doc_id: r for r in ngram_join.jaccard_classes(calm).collect()}
    for made, first in zip(near + exact, clean[:20]):
        assert classes[made[0]].class_id == classes[first.doc_id].class_id and classes[made[0]].n_links >= 1


@pytest.mark.parametrize("n", range(1, 11))
def test_registered_queries_give_the_contract_columns(spark, n):
    columns = {
        1: "query_id:bigint rank:int vec_id:bigint score:double",
        2: "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
        3: "page_id:bigint url:string text:string n_chars:bigint",
        4: "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
        5: "doc_id:bigint class_id:bigint n_links:bigint",
        6: "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
        7: "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
        8: "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
        9: "doc_id:bigint held_out:boolean score:double predicted:int",
        10: "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    }[n]
    (name,) = [q for q in driver.queries() if q.startswith(f"op{n}_")]
    df = driver.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    for column in columns.split():
        c, kind = column.split(":")
        assert kinds[c] == kind, c
    source = {1: "embeddings", 3: "pages"}.get(n, "documents")
    rows, given = df.count(), spark.read.parquet(f"{SF}/{source}.parquet")
    if n == 1:
        assert rows == 10 * given.filter(F.col("vec_id") % 100 == 0).count()
    elif n == 7:
        assert rows >= given.count()
    else:
        assert rows == given.count()
