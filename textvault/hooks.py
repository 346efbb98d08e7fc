"""Pluggable model hooks with deterministic defaults.

* Embedder: text Column -> ``array<float>`` Column. Default: hashed bag of
  tokens (JVM tokenising, numpy bincount per Arrow batch). A real encoder is
  wrapped with :class:`PandasEmbedder` and loaded once per Python worker.
* Reader: prompt Column (+ history) -> response Column. Default: a pure
  column expression, so folds over prompts stay in the JVM.
* Extractor: document bytes -> page rows (a ``mapInPandas`` in shape).
* Tokenizer: sentence Column -> ``array<string>``.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from textvault.functions import vectors as V


class HashingEmbedder:
    def __init__(self, dim: int = V.DEFAULT_DIM):
        self.dim = dim

    def __call__(self, text: Column) -> Column:
        return V.hashed_embedding(text, self.dim)


_MODELS: dict = {}


class PandasEmbedder:
    """Wrap ``load() -> model`` and ``encode(model, list[str]) -> 2-D array``.

    The model is cached per Python worker process, so it loads once per
    executor; at most ``PART`` texts are encoded in one call, so that no more vectors are held.
    """

    PART = 1024

    def __init__(self, load: Callable, encode: Callable, dim: int, key: str = "default"):
        self.load, self.encode, self.dim, self.key = load, encode, dim, key

    def __call__(self, text: Column) -> Column:
        load, encode, key, part = self.load, self.encode, self.key, self.PART

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                if key not in _MODELS:
                    _MODELS[key] = load()
                for a in range(0, len(s), part):
                    out = encode(_MODELS[key], s[a:a + part].fillna("").tolist())
                    yield pd.Series([np.asarray(row, np.float32) for row in out], dtype=object)

        return embed(text)


def hash_reader(prompt: Column, width: int = 16) -> Column:
    """Deterministic stand-in reader: the response is a digest of the prompt."""
    return F.concat(F.lit("R"), F.substring(F.md5(prompt), 1, width))


def text_extractor(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Default extractor: UTF-8 bytes are one page. Shape of any extractor hook:
    (filename, content) batches in, (filename, page_no, text) batches out."""
    for pdf in rows:
        out = []
        for name, content in zip(pdf["filename"], pdf["content"]):
            try:
                text = bytes(content).decode("utf-8")
            except UnicodeDecodeError:
                text = ""
            out.append((name, 0, text))
        yield pd.DataFrame(out, columns=["filename", "page_no", "text"])


class PageExtractor:
    """Table function (bytes) -> (page_no, text) rows; called in a lateral join from SQL.

    The default takes UTF-8 bytes and starts a page at every form feed; bytes that aren't UTF-8 are one empty
    page, NULL has none. A subclass overrides :meth:`pages`.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument) -> AnalyzeResult:
        if content.isTable or content.dataType not in (T.BinaryType(), T.NullType()):
            raise ValueError(f"a page extractor takes binary content, not {content.dataType.simpleString()}")
        return AnalyzeResult(schema=T.StructType().add("page_no", "long").add("text", "string"))

    def pages(self, content: bytes) -> list[str]:
        try:
            return content.decode("utf-8").split("\f")
        except UnicodeDecodeError:
            return [""]

    def eval(self, content: bytes):
        if content is not None:
            yield from enumerate(self.pages(bytes(content)))


def register_extractor(spark: SparkSession, name: str = "extract_pages", extractor: type = PageExtractor) -> None:
    """Make an extractor a table function of the session."""
    spark.udtf.register(name, F.udtf(extractor))


def lateral_pages(files: DataFrame, name: str = "extract_pages") -> DataFrame:
    """(filename, page_no, text) of (filename, content) rows through a registered extractor."""
    return files.sparkSession.sql(f"SELECT f.filename, p.page_no, p.text FROM {{files}} f, LATERAL {name}(f.content) p", files=files)


def extract_pages(docs: DataFrame, extractor=text_extractor) -> DataFrame:
    return docs.select("filename", "content").mapInPandas(extractor, "filename string, page_no long, text string")
