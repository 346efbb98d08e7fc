"""Reading long texts chunk by chunk through a reader, as a fold or a map.

Two kinds of readers: Column readers (``history_reader``) stay in the JVM; Python readers, the
place for a real chat model, are called ``reader(prompt, history, **params)`` and run in
``mapInPandas`` (:func:`read_in_order`, :func:`read_each`).

* Recursive: memory folds over (round, chunk) in order; sequential inside one
  request by definition, parallel across requests. With a column-expression
  reader the fold is one ``aggregate`` per request row (JVM-side).
* ForEach: every chunk is read independently; rounds refine that chunk's own
  answer. Answers are joined in chunk order.

Readers take (prompt, history) Columns; history is
``array<struct<user:string, assistant:string>>``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textvault.functions.units import explode_items
from textvault.hooks import hash_reader

NL = "\n"
# Prompt templates of the reading modes.
STEP_TEXT = ("当前上下文:\n", "\n---\n新的上下文片段:\n", "\n---\n根据用户关心的问题\"", "\"，结合新的上下文片段，生成新的上下文：")
STEP_FILE_HEAD = ("文件名=", " 片段序号=", "\n")
FINAL = ("上下文: ", "\n---\n")
EACH_HEAD = "上下文片段:\n"
EACH_FILE = "文件名="
EACH_SEP = "\n---\n"
EACH_REFINE = "(优化上次的回答内容)"

HISTORY_TYPE = "array<struct<user:string,assistant:string>>"


def history_reader(prompt: Column, history: Column) -> Column:
    """Default deterministic reader: digest of the prompt and the last answer."""
    last = F.coalesce(F.try_element_at(history, F.lit(-1))["assistant"], F.lit(""))
    return hash_reader(F.concat(prompt, F.lit("|"), last))


def empty_history() -> Column:
    return F.array().cast(HISTORY_TYPE)


def turn(user: Column, assistant: Column) -> Column:
    return F.struct(user.alias("user"), assistant.alias("assistant"))


def step_prompt(memory: Column, chunk: Column, question: Column, filename: Column | None = None,
                chunk_no: Column | None = None) -> Column:
    parts = [F.lit(STEP_TEXT[0]), memory, F.lit(STEP_TEXT[1])]
    if filename is not None:
        parts += [F.lit(STEP_FILE_HEAD[0]), filename, F.lit(STEP_FILE_HEAD[1]), chunk_no.cast("string"),
                  F.lit(STEP_FILE_HEAD[2])]
    parts += [chunk, F.lit(STEP_TEXT[2]), question, F.lit(STEP_TEXT[3])]
    return F.concat(*parts)


def final_prompt(memory: Column, question: Column) -> Column:
    return F.concat(F.lit(FINAL[0]), memory, F.lit(FINAL[1]), question)


def each_prompt(chunk: Column, question: Column, refine: Column, filename: Column | None = None,
                compat: bool = False) -> Column:
    """ForEach prompt; ``compat`` reproduces the stray quote of the text variant."""
    head = [F.lit(EACH_HEAD)]
    if filename is not None:
        head += [F.lit(EACH_FILE), filename, F.lit(NL)]
    q = F.concat(F.lit('"'), question) if compat and filename is None else question
    return F.concat(*head, chunk, F.lit(EACH_SEP), F.when(refine, F.lit(EACH_REFINE)).otherwise(F.lit("")), q)


def recursive_memory(items: Column, question: Column, repeat: int = 1, reader=history_reader,
                     history: Column | None = None, files: bool = False, skip_single: bool = True) -> Column:
    """Memory after folding over an ordered array of chunk items.

    ``items`` is ``array<string>`` (text variant) or
    ``array<struct<filename, chunk_no, chunk>>`` (files variant). Each step's
    history turn is dropped again, so every step sees the initial history.
    ``skip_single``: the text variant uses a lone chunk as memory directly.
    """
    history = empty_history() if history is None else history
    seq = F.flatten(F.array_repeat(items, repeat))

    def step(acc, it):
        if files:
            p = step_prompt(acc["m"], it["chunk"], question, it["filename"], it["chunk_no"])
        else:
            p = step_prompt(acc["m"], it, question)
        return F.struct(reader(p, acc["h"]).alias("m"), acc["h"].alias("h"))

    folded = F.aggregate(seq, F.struct(F.lit("").alias("m"), history.alias("h")), step, lambda a: a["m"])
    if skip_single and not files:
        n = F.size(items) * repeat
        return F.when(n > 1, folded).when(n == 1, F.element_at(items, 1)).otherwise(F.lit(""))
    return folded


def final_answer(memory: Column, question: Column, reader=history_reader, history: Column | None = None) -> Column:
    history = empty_history() if history is None else history
    return reader(final_prompt(memory, question), history)


def recursive_read(df: DataFrame, items: str, question: Column, repeat: int = 1, reader=history_reader,
                   files: bool = False, skip_single: bool = True) -> DataFrame:
    """Add ``memory`` then ``answer`` as two projections, so the fold runs once per row."""
    m = df.withColumn("memory", recursive_memory(F.col(items), question, repeat, reader, None, files, skip_single))
    return m.withColumn("answer", final_answer(F.col("memory"), question, reader))


def foreach_read(chunk: Column, question: Column, repeat: int = 1, reader=history_reader,
                 filename: Column | None = None, compat: bool = False) -> Column:
    """struct<answer, history> of one chunk read ``repeat`` times."""
    def rnd(acc, _):
        refine = F.size(acc["h"]) > 0
        p = each_prompt(chunk, question, refine, filename, compat)
        a = reader(p, acc["h"])
        return F.struct(a.alias("a"), F.array_append(acc["h"], turn(p, a)).alias("h"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(max(repeat, 1))),
                      F.struct(F.lit("").alias("a"), empty_history().alias("h")), rnd)
    return F.struct(out["a"].alias("answer"), out["h"].alias("history"))


def foreach_read_text(docs: DataFrame, question: Column, repeat: int = 1, reader=history_reader,
                      compat: bool = False, key: str = "filename", chunks_col: str = "chunks") -> DataFrame:
    """(key, n_chunks, answers): every chunk is a row of its own; answers joined by a blank line, in chunk order."""
    x = docs.select(key, F.posexplode_outer(chunks_col).alias("chunk_no", "chunk"))
    a = x.select(key, "chunk_no", foreach_read(F.col("chunk"), question, repeat, reader, None, compat)["answer"].alias("answer"))
    return a.groupBy(key).agg(
        F.count("chunk_no").alias("n_chunks"),
        F.coalesce(F.expr("listagg(answer, '\\n\\n') WITHIN GROUP (ORDER BY chunk_no) FILTER (WHERE chunk_no IS NOT NULL)"),
                   F.lit("")).alias("answers"))


# --- Python readers ---------------------------------------------------------------

def hash_chat(prompt: str, history: list[tuple[str, str]], max_length: int = 2048, top_p: float = 0.7,
              temperature: float = 0.95) -> str:
    """Python twin of ``history_reader``; a chat model takes the same arguments."""
    last = history[-1][1] if history else ""
    return ("R" + hashlib.md5(f"{prompt}|{last}".encode()).hexdigest()[:16])[:max_length]


def _step(memory: str, r, question: str, files: bool) -> str:
    head = f"{STEP_FILE_HEAD[0]}{r.filename}{STEP_FILE_HEAD[1]}{r.chunk_no}{STEP_FILE_HEAD[2]}" if files else ""
    return f"{STEP_TEXT[0]}{memory}{STEP_TEXT[1]}{head}{r.chunk}{STEP_TEXT[2]}{question}{STEP_TEXT[3]}"


def read_in_order(chunks: DataFrame, request: str, order: str, question: str, reader: Callable = hash_chat, repeat: int = 1,
                  files: bool = True, params: dict | None = None) -> DataFrame:
    """(request, n_steps, memory, answer): the recursive mode with a Python reader.

    ``chunks``: (request, order, chunk_no, filename, chunk). The chunks of a request stream
    through one task in order and only the memory is carried. The text variant (``files=False``) uses
    a lone chunk as memory directly.
    """
    params = params or {}
    rows = chunks.select(F.col(request).cast("string").alias("request"), F.col(order).alias("place"), "chunk_no", "filename", "chunk",
                         F.explode(F.sequence(F.lit(1), F.lit(max(repeat, 1)))).alias("round"))
    ordered = rows.repartition("request").sortWithinPartitions("request", "round", "place", "chunk_no")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, memory, n, lone = None, "", 0, None

        def done():
            m = lone if lone is not None else memory
            return pd.DataFrame([(now, n, m, reader(f"{FINAL[0]}{m}{FINAL[1]}{question}", [], **params))],
                                columns=["request", "n_steps", "memory", "answer"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.request != now:
                    if now is not None:
                        yield done()
                    now, memory, n, lone = r.request, "", 0, None
                    if not files:
                        lone, n = r.chunk, 1
                        first = r
                        continue
                if lone is not None:                      # a second chunk: the first is read after all
                    memory, lone = reader(_step("", first, question, files), [], **params), None
                memory, n = reader(_step(memory, r, question, files), [], **params), n + 1
        if now is not None:
            yield done()

    out = ordered.mapInPandas(fold, "request string, n_steps long, memory string, answer string")
    return out.withColumn("request", F.col("request").cast(chunks.schema[request].dataType)).withColumnRenamed("request", request)


def read_each(chunks: DataFrame, question: str, reader: Callable = hash_chat, repeat: int = 1, files: bool = True,
              params: dict | None = None) -> DataFrame:
    """``chunks`` plus ``answer``: each chunk read ``repeat`` times by a Python reader, its own answers as history."""
    params = params or {}

    @F.pandas_udf("string")
    def answers(names: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for name, text in zip(names, texts, strict=True):
            history: list[tuple[str, str]] = []
            for _ in range(max(repeat, 1)):
                head = f"{EACH_FILE}{name}\n" if files else ""
                p = f"{EACH_HEAD}{head}{text}{EACH_SEP}{EACH_REFINE if history else ''}{question}"
                history.append((p, reader(p, history, **params)))
            out.append(history[-1][1])
        return pd.Series(out, dtype=object)

    return chunks.withColumn("answer", answers(F.col("filename"), F.col("chunk")))


# --- chat history -----------------------------------------------------------------

def history_of(turns: DataFrame) -> DataFrame:
    """(conv_id, history): question and answer pairs of each conversation in order; none is an empty history.

    ``turns``: (conv_id, turn, role, text). A question without an answer right after it is dropped.
    """
    nxt = lambda c: F.lead(c).over(Window.partitionBy("conv_id").orderBy("turn"))
    seen = turns.withColumns({"r": nxt("text"), "next_role": nxt("role"), "next_turn": nxt("turn")})
    pair = (F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("next_turn") == F.col("turn") + 1)
    item = F.when(pair, F.struct("turn", F.col("text").alias("q"), "r"))
    return seen.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: turn(s["q"], s["r"])).alias("history"))


def respond(histories: DataFrame, question: Column, reader=history_reader, keep_last: bool = True) -> DataFrame:
    """Add ``response`` and ``after``: the history with the new turn, or without its last one for a retry."""
    base = F.col("history") if keep_last else F.slice("history", 1, F.greatest(F.size("history") - 1, F.lit(0)))
    h = histories.withColumn("history", base).withColumn("response", reader(question, F.col("history")))
    return h.withColumn("after", F.array_append("history", turn(question, F.col("response"))))


def chunk_list(docs: DataFrame, request: str, order: str, chunks_col: str = "chunks") -> DataFrame:
    """(request, items): chunks of many files in (file order, chunk_no) order."""
    x = explode_items(docs, F.col(chunks_col), "chunk_no", "chunk", request, order, "filename")
    items = F.array_sort(F.collect_list(F.struct(order, "chunk_no", "filename", "chunk")))
    return x.groupBy(request).agg(F.transform(items, lambda s: F.struct(
        s["filename"].alias("filename"), s["chunk_no"].alias("chunk_no"), s["chunk"].alias("chunk"))).alias("items"))


def foreach_answers(docs_chunks: DataFrame, request: str, order: str, question: Column, repeat: int = 1,
                    reader=history_reader) -> DataFrame:
    """Files variant of ForEach: every (file, chunk) row in parallel, then an
    ordered join of answers per request."""
    x = explode_items(docs_chunks, F.col("chunks"), "chunk_no", "chunk", request, order, "filename")
    a = x.select(request, order, "chunk_no",
                 foreach_read(F.col("chunk"), question, repeat, reader, F.col("filename"))["answer"].alias("answer"))
    return a.groupBy(request).agg(
        F.expr(f"listagg(answer, '\\n\\n') WITHIN GROUP (ORDER BY {order}, chunk_no)").alias("answers"),
        F.count(F.lit(1)).cast("bigint").alias("n_chunks"))
