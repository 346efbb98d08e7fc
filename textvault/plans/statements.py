"""The knowledge base's SQL statements: text with parameter markers, run over DataFrames.

Values never become part of a text: single ones are named parameters, lists are as many ``?`` as values
(:func:`que_marks`). Long lists come as a table and are joined (:func:`hit_rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# the statements of the SQL tables
FILE_BY_KEY = "SELECT filename, text_md5 FROM {files} WHERE filename_md5 = :key"
CHUNK_KEYS_OF_FILE = "SELECT filename_md5_no FROM {chunks} WHERE filename_md5 = :key"
FILES_IN = "SELECT filename FROM {files} WHERE filename_md5 IN (%s)"
CHUNKS_IN = "SELECT filename, chunk_no, chunk FROM {chunks} WHERE filename_md5_no IN (%s)"
HIT_ROWS = """SELECT h.query_id, h.rk, c.filename, c.chunk_no, c.chunk, h.distance
FROM {hits} h JOIN {chunks} c ON c.filename_md5_no = h.id"""


def que_marks(count: int) -> str:
    """``count`` parameter markers."""
    return ", ".join("?" for _ in range(count))


def file_by_key(files: DataFrame, key: str) -> DataFrame:
    return files.sparkSession.sql(FILE_BY_KEY, args={"key": key}, files=files)


def chunk_keys_of_file(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.sparkSession.sql(CHUNK_KEYS_OF_FILE, args={"key": key}, chunks=chunks)


def files_in(files: DataFrame, keys: list[str]) -> DataFrame:
    """File names of a short list of keys; none for an empty list."""
    return files.sparkSession.sql(FILES_IN % (que_marks(len(keys)) or "NULL"), args=keys or None, files=files)


def chunks_in(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.sparkSession.sql(CHUNKS_IN % (que_marks(len(keys)) or "NULL"), args=keys or None, chunks=chunks)


def hit_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of (query_id, id, rk, distance) hits, which keep their rank."""
    return chunks.sparkSession.sql(HIT_ROWS, hits=hits, chunks=chunks)
