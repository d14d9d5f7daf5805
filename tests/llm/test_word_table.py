import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
from pairlens.llm import word_table as wt
from pairlens.llm.tokens import Memory, encoder
from tests.llm.fixtures import SF, documents, no_documents, odd_documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_padding()
    t.no_truncation()
    return t


def want(rows):
    t = library()
    found = [t.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    return sorted(repr((r.doc_id, ids, t.decode(ids, skip_special_tokens=False))) for r, ids in zip(rows, found))


@pytest.mark.parametrize("block_bytes", [2000, wt.BLOCK_BYTES])
@pytest.mark.parametrize("table", [documents, odd_documents])
def test_ids_and_texts_are_those_of_the_library(spark, table, block_bytes):
    docs = table(spark)
    got = wt.encode(docs, WORD_BPE, block_bytes=block_bytes).collect()
    assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in got) == want(docs.collect())


def test_hard_texts(spark):
    texts = ["it's 'S'll don't", "a<|endoftext|>b <|startoftext|>", "İstanbul ǅ ﬁne x́y é", "你好 世界 a,b", "x\x00y\x1cz", "A-B_c's 12,5",
             "  a\xa0b", "«quoted» “text”—dash", "''s 's' \"'s", "😀😀 ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = wt.encode(docs, WORD_BPE).collect()
    assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in got) == want(docs.collect())


def test_no_rows(spark):
    assert wt.encode(no_documents(spark), WORD_BPE).count() == 0


def test_every_distinct_word_is_encoded_once(spark):
    docs = documents(spark)
    blocks = wt.word_blocks(docs, WORD_BPE, "dropped", "doc_id", "text", 20_000)
    rows = blocks.collect()
    assert len(rows) > 5
    distinct = {w for r in rows for w in wt.unpack(r.words, r.sizes)}
    asked = []
    table = Memory(10**6)
    for r in rows:
        table.hold(wt.unpack(r.words, r.sizes), lambda new: asked.extend(new) or encoder(WORD_BPE, "dropped").encode_words(new))
    assert sorted(asked) == sorted(distinct)


def test_packed_numbers_and_words_come_back():
    rng = random.Random(0)
    for n, top in ((0, 5), (1, 0), (300, 200), (300, 70_000), (50, 2**32 - 1)):
        values = np.array([rng.randint(0, top) for _ in range(n)], np.int64)
        assert wt.expand(wt.squeeze(values)).tolist() == values.tolist()
    words = [bytes([rng.randrange(256)]) * rng.randint(0, 9) for _ in range(100)]
    assert wt.unpack(*wt.pack(words)) == words and wt.unpack(*wt.pack([])) == []


def test_query(spark):
    t = library()
    got = {r.doc_id: tuple(r)[1:] for r in driver.queries()["op12_word_table"](spark, SF).collect()}
    for r in documents(spark).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        digests = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert got[r.doc_id] == (len(ids), *digests)
