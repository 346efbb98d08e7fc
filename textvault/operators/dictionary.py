"""Dictionary cut: every dictionary word in a line, overlaps included, and the characters no word covers.

Lines are cut at the characters that no word has. An equal piece between them is matched once a batch or block, and what is
found is laid over the lines by numpy, without an object a word.

The words become an automaton (a trie with failure links), which reads a piece once and reports
all words that end at each character. A dictionary within ``budget`` characters is broadcast and
built once per Python worker. Beyond it no task holds the dictionary: lines are dealt into blocks, the distinct
substrings of a block's pieces are joined with the words, and the words that a block has are brought together with its lines.
Substrings that a bitmap of the words' hashes shows not to be words don't reach the join. So a line travels once,
whatever the number of words, and memory depends on the budget or on the size of a block.

Defined results: null and empty words don't count, repeated ones count once; a null line is an empty
line; an empty dictionary leaves all characters uncovered. White space is never a token of its own.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textvault.functions.text import ASCII_ALNUM
from textvault.session import scratch_path

DEFAULT_BUDGET = 400_000      # characters of the words in one automaton, which has at most one state more
PIECE = 256                   # places of words in one piece of a line
KEY = 16                      # first characters of a longer word, without which it isn't looked for
BLOCK = 1 << 23               # characters of the lines in a block
PART = 1 << 18                # characters whose tokens are made at a time
HASH_BITS = 25                # at most 2 ** HASH_BITS bits tell which substrings may be words
LETTERS = f"[{ASCII_ALNUM[10:]}[\\p{{L}}]]{{2,12}}"     # \\p{L}{2,12}: the commonest letters are looked up first
FOUND = "array<struct<start: int, length: int>>"


class Automaton:
    """Trie with failure links over a set of words."""

    def __init__(self, words: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        self.length = [0]                     # of the word that ends in the state, 0 if none
        for word in words:
            state = 0
            for c in word:
                to = self.step[state].get(c)
                if to is None:
                    to = self.step[state][c] = len(self.step)
                    self.step.append({})
                    self.length.append(0)
                state = to
            self.length[state] = len(word)
        self.fail = [0] * len(self.step)
        self.ends: list[tuple[int, ...]] = [()] * len(self.step)     # lengths of all words that end in the state
        todo = deque([0])
        while todo:                           # by depth: failure links lead to shallower states
            state = todo.popleft()
            own = (self.length[state],) if self.length[state] else ()
            self.ends[state] = own + (self.ends[self.fail[state]] if state else ())
            for c, to in self.step[state].items():
                back = self.fail[state]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[to] = self.step[back].get(c, 0) if state else 0
                todo.append(to)

    def occurrences(self, text: str) -> list[tuple[int, int]]:
        """(start, length) of every word in the text, by start, then length."""
        out, state, step, fail, ends = [], 0, self.step, self.fail, self.ends
        for at, c in enumerate(text):
            to = step[state].get(c)
            while to is None and state:
                state = fail[state]
                to = step[state].get(c)
            state = to or 0
            for n in ends[state]:
                out.append((at + 1 - n, n))
        out.sort()
        return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------
# a few texts as one row of code points
# ---------------------------------------------------------------------------

def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts one after the other; where each begins and the last ends."""
    points = np.frombuffer("".join(_list(texts)).encode("utf-32-le"), np.uint32)
    return points, _ends(np.asarray(pc.utf8_length(texts)))


def _list(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = _ends(lengths)
    return np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])


def _strings(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    part, ends = points[_ranges(starts, lengths)], _ends(lengths)
    plain = not len(part) or part.max() < 0x80
    data = part.astype(np.uint8).tobytes() if plain else part.tobytes().decode("utf-32-le").encode()
    if not plain:
        ends = _ends(1 + (part > 0x7F) + (part > 0x7FF) + (part > 0xFFFF))[ends]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _pieces(points: np.ndarray, ends: np.ndarray, letters: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of dictionary characters; a long run becomes pieces that overlap by a word."""
    inside, edge = letters[points], np.zeros(len(points) + 1, bool)
    edge[ends] = True
    before, after = np.concatenate([[False], inside])[:-1], np.concatenate([inside, [False]])[1:]
    first, last = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
    n = -(-(last - first) // PIECE)
    starts = np.repeat(first, n) + _ranges(np.zeros(len(n), np.int64), n) * PIECE
    return starts, np.minimum(np.repeat(last, n) - starts, PIECE + longest - 1)


def _letters(characters: Iterable[str]) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in characters]] = True
    return table


def _parts(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(first, number) of rows with about ``size`` characters."""
    return _stretches(_ends(np.asarray(pc.utf8_length(texts)))[:-1] // size)


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of the rows with equal values that stand together."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
    return ((int(a), int(z - a)) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a)


def _made(rows: pa.RecordBatch, at: int, letters: np.ndarray, longest: int, matched, made, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with the columns that ``made`` makes of the words in their texts. ``matched`` gets distinct pieces and returns, one piece after
    the other, the codes ``start * (longest + 1) + length`` of the words that start in the first ``PIECE`` places, ascending, and their ends."""
    for first, number in _parts(rows.column(at), BLOCK):
        parts = []
        for a, n in _parts(rows.column(at).slice(first, number), PART):
            part = rows.slice(first + a, n)
            points, ends = _points(part.column(at))
            starts, lengths = _pieces(points, ends, letters, longest)
            parts.append((part, points, ends, starts, _strings(points, starts, lengths).dictionary_encode()))
        pieces = pa.chunked_array([x[4] for x in parts]).unify_dictionaries().chunks
        limits, codes = matched(pieces[0].dictionary)
        for (part, points, ends, starts, _), own in zip(parts, pieces, strict=True):
            which = np.asarray(own.indices)
            n = limits[which + 1] - limits[which]
            begin, length = np.divmod(codes[_ranges(limits[which], n)], longest + 1)
            yield pa.RecordBatch.from_arrays([*part.columns, *made(points, ends, begin + np.repeat(starts, n), length)], names)


def _found(points: np.ndarray, ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """The (start, length) of each text's words."""
    cuts = np.searchsorted(starts, ends)
    own = starts - np.repeat(ends[:-1], np.diff(cuts))
    pairs = pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(lengths, pa.int32())], ["start", "length"])
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)]


def _tokens(points: np.ndarray, ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """The tokens of each text by place, then length, and how many are uncovered characters."""
    size = len(points) + 1
    covered = np.cumsum(np.bincount(starts, minlength=size) - np.bincount(starts + lengths, minlength=size))[:-1] > 0
    rest = np.flatnonzero(~covered & ~_spaces()[points])
    total = len(starts) + len(rest)
    lone = np.zeros(total, bool)
    lone[np.arange(len(rest)) + np.searchsorted(starts, rest)] = True
    at, n = np.empty(total, np.int64), np.ones(total, np.int64)
    at[lone], at[~lone], n[~lone] = rest, starts, lengths
    tokens = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends), pa.int32()), _strings(points, at, n))
    return [tokens, pa.array(np.diff(np.searchsorted(rest, ends)), pa.int32())]


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    return _letters(c for c in map(chr, range(0x110000)) if c.isspace())


# ---------------------------------------------------------------------------
# the two ways
# ---------------------------------------------------------------------------

_AUTOMATA: dict[str, Callable[[str], list[int]]] = {}


def occurrences(lines: DataFrame, words: DataFrame, budget: int = DEFAULT_BUDGET, text_col: str = "text", word_col: str = "word") -> DataFrame:
    """``lines`` with ``found``: the (start from 0, length) of every dictionary word in the text, by start, then length.

    The other columns of ``lines`` must tell its rows apart.
    """
    return _matched(lines, words, budget, text_col, word_col, f"found {FOUND}", _found)


def _matched(lines: DataFrame, words: DataFrame, budget: int, text_col: str, word_col: str, out: str, made) -> DataFrame:
    """``lines`` and the columns ``out`` that ``made`` makes of the words found in them."""
    spark = lines.sparkSession
    dictionary = words.select(F.col(word_col).alias("word")).filter("word <> ''").distinct()
    dictionary = _written(dictionary, "dictionary")          # read several times
    size = dictionary.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    lines = lines.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    at = lines.columns.index(text_col)
    schema = T.StructType([*lines.schema.fields, *T._parse_datatype_string(out).fields])
    if size <= budget:
        held = [r["word"] for r in dictionary.collect()]
        known, name, longest = spark.sparkContext.broadcast(held), uuid.uuid4().hex, max(map(len, held), default=0)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _AUTOMATA:                # one a worker, whatever the number of its tasks
                _AUTOMATA.clear()
                automaton = Automaton(known.value)
                _AUTOMATA[name] = lru_cache(maxsize=1 << 16)(
                    lambda piece: [i * (longest + 1) + n for i, n in automaton.occurrences(piece) if i < PIECE])
            codes, letters = _AUTOMATA[name], _letters({c for w in known.value for c in w})

            def matched(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                lists = [codes(p) for p in _list(pieces)]
                return _ends([len(x) for x in lists]), np.array([c for x in lists for c in x], np.int64)

            for b in batches:
                yield from _made(b, at, letters, longest, matched, made, schema.names)

        return lines.mapInArrow(scan, schema)

    return _dealt(lines, dictionary, text_col, schema, made)


def _once(lines: DataFrame) -> DataFrame:
    """``lines.dropDuplicates()``, for which only rows of repeated hashes are shuffled."""
    spark, row = lines.sparkSession, F.xxhash64(*lines.columns)
    again = _written(lines.select(row.alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_hash"), "cut-again")
    if again.isEmpty():
        return lines
    hashed = lines.withColumn("_hash", row)
    return (hashed.join(again, "_hash", "left_anti").unionByName(hashed.join(again, "_hash", "left_semi").dropDuplicates())
            .select(*lines.columns))


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hashes(points: np.ndarray, starts: np.ndarray, room: np.ndarray, bits: int, longest: int, prefixes: np.ndarray | None = None):
    """(n, which, place in a bitmap) of the starts with n characters of ``room``; beyond ``KEY`` only of those whose first ones are in ``prefixes``."""
    which, h = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    for n in range(1, longest + 1):
        more = room[which] >= n
        which, h = which[more], h[more]
        if not len(which):
            return
        h = h * np.uint64(0x100000001B3) + points[starts[which] + n - 1]
        at = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        yield n, which, at
        if n == KEY and prefixes is not None:
            more = _held(prefixes, at)
            which, h = which[more], h[more]


def _bitmaps(dictionary: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the hashes of the words, and of the first ``KEY`` characters of longer ones. A task hands on what its words set of each 8 bytes."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, ends = _points(b.column(0))
            lengths, out = np.diff(ends), [np.zeros(0, np.uint64)]
            for n, which, at in _hashes(points, ends[:-1], lengths, bits, lengths.max(initial=0)):
                out.append(at[lengths[which] == n])
                if n == KEY:
                    out.append(at[lengths[which] > n] + np.uint64(1 << bits))
            at = np.concatenate(out)
            slot, place = np.unique(at >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(held, place, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(held.view(np.int64))], ["slot", "held"])

    rows = dictionary.mapInArrow(marked, "slot long, held long").groupBy("slot").agg(F.bit_or("held").alias("held")).toPandas()
    both = np.zeros((2, 1 << (bits - 6)), "<i8")
    both.reshape(-1)[rows["slot"].to_numpy()] = rows["held"].to_numpy()
    return both[0].view(np.uint8), both[1].view(np.uint8)


def _dealt(lines: DataFrame, dictionary: DataFrame, text_col: str, schema: T.StructType, made) -> DataFrame:
    """The way beyond the budget: equal rows are one, as they can't be told apart."""
    spark, columns, at = lines.sparkSession, lines.columns, lines.columns.index(text_col)
    lengths = dictionary.select(F.collect_set(F.length("word")).alias("n"), F.count(F.lit(1)).alias("words")).first()
    sizes, longest = set(lengths["n"]), max(lengths["n"])
    letters = [r["c"] for r in dictionary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()]
    bits = max(10, min(HASH_BITS, (32 * lengths["words"]).bit_length()))
    bitmaps = spark.sparkContext.broadcast(_bitmaps(dictionary, bits))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            out = []
            for n in pc.utf8_length(b.column(at)).to_pylist():
                if seen and seen + n > BLOCK:
                    number, seen = number + 1, 0
                seen += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "_block"])

    blocks = _written(_once(lines).mapInArrow(block, T.StructType([*lines.schema.fields, T.StructField("_block", T.LongType())])), "cut-lines")

    def maybe(pieces: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Substrings of the pieces that may be words; the pieces, the places there and the lengths."""
        words, prefixes = bitmaps.value
        for a, count in _parts(pieces, PART):
            points, ends = _points(pieces.slice(a, count))
            places = np.minimum(np.diff(ends), PIECE)
            starts, of = _ranges(ends[:-1], places), np.repeat(np.arange(count), places)
            for n, which, place in _hashes(points, starts, ends[1:][of] - starts, bits, longest, prefixes):
                if n in sizes:
                    which = which[_held(words, place)]
                    n = np.full(len(which), n)
                    yield _strings(points, starts[which], n), of[which] + a, starts[which] - ends[of[which]], n

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letters(letters)

        def substrings(number: int, texts: list[pa.Array]) -> pa.RecordBatch:
            distinct, texts = [pa.array([], pa.string())], pa.concat_arrays(texts)
            for a, n in _parts(texts, PART):
                points, ends = _points(texts.slice(a, n))
                distinct.append(_strings(points, *_pieces(points, ends, table, longest)).unique())
            keys = pa.chunked_array([x[0] for x in maybe(pa.chunked_array(distinct).unique())], pa.string()).unique()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), keys], ["_block", "word"])

        now, held = None, []
        for b in batches:
            for first, count in _stretches(np.asarray(b.column(0))):
                number = b.column(0)[first].as_py()
                if held and number != now:
                    yield substrings(now, held)
                    held = []
                now = number
                held.append(b.column(1).slice(first, count))
        if held:
            yield substrings(now, held)

    words = blocks.select("_block", text_col).mapInArrow(vocabulary, "_block long, word string").join(dictionary, "word", "left_semi")
    # about a block a task, so that it is sorted in memory
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, blocks.select("_block").distinct().count())
    both = (words.select("_block", "word", F.lit(None).cast(lines.schema).alias("row"))
            .unionByName(blocks.select("_block", F.lit(None).cast("string").alias("word"), F.struct(*columns).alias("row"))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letters(letters)

        def cut(own: list[pa.Array], rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.chunked_array(own, pa.string()).unique()

            def matched(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                found = list(maybe(pieces))
                words = pa.chunked_array([x[0] for x in found], pa.string())
                is_word = np.asarray(pc.is_in(words, value_set=own)) if len(words) else np.zeros(0, bool)
                which, place, n = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)])[is_word] for i in (1, 2, 3))
                codes = np.sort((which * PIECE + place) * (longest + 1) + n) % (PIECE * (longest + 1))
                return _ends(np.bincount(which, minlength=len(pieces))), codes

            for b in pa.Table.from_batches(rows).combine_chunks().to_batches():
                yield from _made(b, at, table, longest, matched, made, schema.names)

        now, own, rows = None, [], []
        for b in batches:
            numbers, is_row = np.asarray(b.column(0)), np.asarray(b.column(1).is_null())
            for first, count in _stretches(numbers * 2 + is_row):
                if numbers[first] != now:
                    if rows:
                        yield from cut(own, rows)
                    now, own, rows = numbers[first], [], []
                if is_row[first]:
                    rows.append(pa.RecordBatch.from_arrays(b.column(2).slice(first, count).flatten(), columns))
                else:
                    own.append(b.column(1).slice(first, count))
        if rows:
            yield from cut(own, rows)

    return both.repartition(tasks, "_block").sortWithinPartitions("_block", F.col("word").isNull()).mapInArrow(join, schema)


def text_to_tokens(lines: DataFrame, words: DataFrame, budget: int = DEFAULT_BUDGET, text_col: str = "text") -> DataFrame:
    """``lines`` with ``tokens`` (every dictionary word and every uncovered character, by place, then length) and ``rest``, the number of the latter."""
    return _matched(lines, words, budget, text_col, "word", "tokens array<string>, rest int", _tokens)


def frequent_words(docs: DataFrame, least: int, text_col: str = "text", pattern: str = LETTERS) -> DataFrame:
    """(word, n): letter runs that occur in at least ``least`` rows. Partial counts are made before the shuffle."""
    each = docs.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(text_col, F.lit(pattern), 0))).alias("word")).filter("word is not null")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
