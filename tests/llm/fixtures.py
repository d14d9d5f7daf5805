"""Small tables with everything that may go wrong in a large one."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, node int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]
    return " ".join(words)


def odd_rows(seed: int = 3) -> list[tuple]:
    """Null ids, texts, hosts; empty, blank, short and very long texts; copies; repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = [None, "", "   \n\t ", "one", "one", "Café naïve   x y", "a\x1cb\x85c ,,, '' 's", *base]
    near = base[0] if len(base[0].split()) > 60 else prose(rng, 100)
    texts += [near, near, near.replace("w1 ", "w2 ", 1), near + " tail"]
    texts.append("\n".join(prose(rng, 8) for _ in range(3000)))
    texts.append("x" * 30_000)
    rows = [(i * 3, t, "en", f"s{i % 4}", None, 0.5, "a", 1) for i, t in enumerate(texts)]
    rows += [(None, base[1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[10], rows[10], rows[12], (rows[13][0], "another text of this id", None, None, 1, None, None, None)]
    return rows


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
