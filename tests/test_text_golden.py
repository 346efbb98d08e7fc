"""Golden micro cases for cleaning, sentences and packing (hand-restated rules)."""
import pytest
from pyspark.sql import functions as F

from conftest import one
from textvault.functions import text as T
from textvault.functions import units as U

PREPROCESS = [
    ("图1 智能空战发展脉络\nFig.1 Development process of AI based air combat techniques",
     "图1 智能空战发展脉络\nFig.1 Development process of AI based air combat techniques"),
    ("其采 用 的 主 要 决 策", "其采用的主要决 策"),
    ("Hello wor-\nld. Next\nline", "Hello wor-ld. Nextline"),
    ("a:\nb", "a: b"),
    ("a：\nb", "a: b"),
    ("A。\nB", "A。\nB"),
    ("x\n\n\ny", "x\ny"),
    ("ＡＢＣ　１２３，你好！", "ABC 123,你好!"),
    ("x\n y", "x\n y"),
    ("  lead\nTable 3 t", "lead\nTable 3 t"),
    (" a\n  \nb", "a\n \nb"),
]


@pytest.mark.parametrize("src,want", PREPROCESS)
def test_text_preprocess(spark, src, want):
    assert one(spark, T.text_preprocess(F.col("x")), src) == want


def test_fix_newlines_alone(spark):
    assert one(spark, T.fix_newlines(F.col("x")), "a：\nb") == "a： b"
    assert one(spark, T.fix_newlines(F.col("x")), "x\n\n\ny") == "x\n\ny"


SENTENCES = [
    ("", []), ("...", ["..", "."]), ("A. B! C", ["A.", "B!", "C"]),
    ("你好。世界？", ["你好。", "世界？"]), ("Wait... what?!", ["Wait.", "..", "what?", "!"]),
    ("no end", ["no end"]), ("a.b.c", ["a.", "b.", "c"]), (" . x", [".", "x"]),
]


@pytest.mark.parametrize("src,want", SENTENCES)
def test_sentences(spark, src, want):
    assert one(spark, U.text_to_sentences(F.col("x")), src) == want


PACK = [
    ((7, 0, 100), ["aaaa bbbb", "cccc dddd", "eeee"]),
    ((8, 0, 100), ["aaaa bbbb cccc", "dddd eeee"]),
    ((7, 1, 100), ["aaaa bbbb", "bbbb cccc", "cccc dddd", "dddd eeee", "eeee"]),
    ((7, 2, 100), ["aaaa bbbb", "aaaa bbbb cccc", "bbbb cccc dddd", "cccc dddd eeee", "dddd eeee"]),
    ((7, 0, 1), ["aaaa bbbb"]),
    ((100, 0, 100), ["aaaa bbbb cccc dddd eeee"]),
]


def packed(units, *params):
    """Chunk texts from the bounds of the fold, as ``with_chunks`` makes them."""
    text = F.transform(U.chunk_bounds(units, *params), lambda x: F.array_join(F.slice(units, x["s"] + 1, x["e"] - x["s"] + 1), " "))
    return F.when(F.size(units) == 0, F.array().cast("array<string>")).otherwise(text)


@pytest.mark.parametrize("params,want", PACK)
def test_packing(spark, params, want):
    units = ["aaaa", "bbbb", "cccc", "dddd", "eeee"]
    got = one(spark, packed(F.col("x"), *params), units, "x array<string>")
    assert got == want


def test_packing_empty(spark):
    assert one(spark, packed(F.col("x"), 7, 0, 100), [], "x array<string>") == []


def test_md5_and_bucket(spark):
    assert one(spark, F.md5(F.col("x")), "文件") == "2a0c4740f156a9536049f4610da25400"


def test_fullwidth_table():
    src, dst, multi = T.fullwidth_table()
    assert len(src) + len(multi) == 103
    assert list(multi) == ["\uffe3"]


def test_outline_entries_without_a_level(spark):
    from textvault.operators import outline as OL
    rows = [("a", 1, 1), ("a", 2, None), ("a", 3, 2), ("a", 4, None), ("a", 5, 1), ("b", 1, None), ("b", 2, None), ("b", 3, 3)]
    got = {(r["doc"], r["idx"]): r["parent"] for r in OL.outline_links(spark.createDataFrame(rows, "doc string, idx int, level int")).collect()}
    assert got == {("a", 1): None, ("a", 2): 1, ("a", 3): 1, ("a", 4): 3, ("a", 5): None, ("b", 1): None, ("b", 2): None, ("b", 3): None}
