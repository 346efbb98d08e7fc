"""Python functions hold a bounded number of texts, whatever the length of an Arrow batch."""
import random

from pyspark.sql import functions as F

from textvault.functions import units as UN
from textvault.functions import vectors as V
from textvault.hooks import PandasEmbedder


def test_embedder_and_tokenizer_work_in_parts(spark):
    n = 3000
    docs = spark.range(n).coalesce(1).select("id", F.concat(F.lit("word "), F.repeat(F.lit("x "), F.col("id").cast("int") % 50)).alias("text"))
    model = PandasEmbedder(lambda: 0, lambda _, texts: [[float(len(texts)), float(len(t))] for t in texts], 2, "parts")
    got = docs.select("id", F.length("text").alias("n"), model(F.col("text")).alias("v")).collect()
    assert len(got) == n and all(r["v"][1] == r["n"] for r in got) and max(r["v"][0] for r in got) <= PandasEmbedder.PART

    held = UN.PandasTokenizer(lambda s: s.split(" "))
    units = docs.select("id", UN.text_to_units(F.col("text"), 10, held).alias("a"), UN.text_to_units(F.col("text"), 10).alias("b"))
    assert units.count() == n and units.filter("a <> b").count() == 0


def test_hashed_vectors_of_many_rows(spark):
    texts = ["", None, "a b a", "ü", "..."] * 500
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: list(r["v"]) for r in d.select("id", V.hashed_embedding(F.col("text"), 64).alias("v")).collect()}
    assert len(got) == len(texts) and all(got[i] == got[i % 5] for i in got) and got[0] == got[1] == got[4] == [0.0] * 64


def test_sentences_equal_the_pattern(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("ab \n\t　é😀.。!！?？;；..") for _ in range(r.randrange(14))),) for _ in range(3000)] + [(None,), ("",)]
    from textvault.functions.text import py_strip
    old = F.filter(F.transform(F.regexp_extract_all("l", F.lit(UN.SENTENCE_REGEX), 1), py_strip), lambda s: s != "")
    assert spark.createDataFrame(rows, "l string").filter(~old.eqNullSafe(UN.text_to_sentences(F.col("l")))).count() == 0
