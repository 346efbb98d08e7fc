"""Best-fit packing of documents into fixed-size sequences by a configuration LP.

1. *Pieces.* Texts become token ids plus an end id; only documents longer than a
   sequence are cut, into full-size pieces and one rest (:func:`token_pieces`).
2. *Histogram.* The pieces of each length are counted: at most ``size`` numbers,
   whatever the input.
3. *Configuration LP.* A configuration is a multiset of lengths that fits a sequence.
   Find few sequences that cover the histogram by multiplicative weights: each round prices all
   lengths that are left by a knapsack dynamic programme over the capacity, reads the best
   configuration with each length from it, uses those near the best by fractions, and lowers the
   prices of what they cover (:func:`programme`).
4. *Rounding.* Fractions are rounded up in the order of how full the configuration is, as far as pieces are left,
   and the programme is solved again for what is left (:func:`solve`). What the passes leave is placed
   best-fit-decreasing, still on counts (:func:`best_fit`): after all passes or fewer, whichever
   needs the fewest sequences. Every configuration used is a row of a plan whose size
   depends on ``size`` alone.
5. *Assignment.* The r-th piece of a length takes the r-th slot that the plan has for
   that length; ranks come from counts per (length, bucket), so a very frequent length is
   never in one task.

Defined results: null text is an empty text, which is one piece with only the end id;
repeated rows are packed once each (their pieces are told apart only by their place);
an empty table gives no rows; a null doc_id is kept. Ties are broken by doc_id, piece
and start.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvault.llm.shared import ranked, small_batches, stored

END_ID = 1
KNOWN_WORDS = 200_000      # distinct words in each of the two generations a worker remembers
PASSES, ROUNDS = 3, 8      # programmes solved one after the other on what is left, and pricing rounds of each
NEAR = 0.02                # a configuration is used whose value is within this share of the best
STEP = 0.5                 # share of a need that a round may cover at most
LEARN = 0.2                # how fast the price of a length falls with what a round covers of it
LONG_WORD = 64             # longer words are not remembered

# How byte-level vocabularies write a byte: printable ones as themselves, the others from U+0100 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = dict(zip([b for b in range(256) if b not in PRINTABLE], range(256, 512)))
LATIN_END = "\u0250"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"     # ASCII signs but the apostrophe, which may join letters


class WordIds:
    """Token ids of a text through a worker's memory of its words.

    The tokenizer drops white space and never joins across it, so a text's ids are
    the ids of its space-separated words one after the other; each distinct word is
    tokenized once while it is remembered. A run of Latin letters is one unit of the
    vocabulary's splitting rule, so it goes straight to the model, lower-cased; signs
    before the first or after the last letter or digit are units of their own, so they
    are looked up apart; every other word goes through the whole tokenizer. The tests
    compare all with the encoding of whole texts.
    """

    _of: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]    # found in raw text, whatever is around
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The one of this Python worker, which Spark uses for several tasks."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def tokenized(self, word: str) -> bytes:
        core = word.strip(SIGNS)
        if core and core != word and not any(t in word for t in self.added) and all(c.isalnum() and c < LATIN_END and c != "\u0130" for c in (core[0], core[-1])):
            at = word.index(core)
            return self.look_up(word[:at]) + self.look_up(core) + self.look_up(word[at + len(core):])
        if word.isalpha() and max(word) < LATIN_END and "\u0130" not in word:
            low = word.lower()
            if low != word:
                return self.look_up(low)
            units = self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_SIGNS))
            return struct.pack(f"<{len(units)}I", *[u.id for u in units])
        return np.asarray(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def look_up(self, word: str) -> bytes:
        ids = self.new.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self.tokenized(word)
            if len(word) <= LONG_WORD:
                self.new[word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, the end id last."""
        words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.new) > KNOWN_WORDS:
            self.old, self.new = self.new, {"": b""}
        known, end = self.new, struct.pack("<I", END_ID)
        try:
            return b"".join([known[w] for w in words]) + end
        except KeyError:
            return b"".join([known[w] if w in known else self.look_up(w) for w in words]) + end


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds.of(tokenizer)
        for b in batches:
            doc, text = b.column(0), b.column(1)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i in range(b.num_rows):
                raw = ids_of(text[i].as_py())
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at:at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [doc.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(cut_up, schema)


def knapsack(value: np.ndarray, lengths: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, list]:
    """Best value of every capacity with no length used more often than is left, and the steps that :func:`read` follows.

    A length's copies enter as powers of two.
    """
    best, steps = np.zeros(size + 1), []
    for k in range(len(lengths)):
        copies, part = int(min(left[k], size // lengths[k])), 1
        while copies > 0:
            n = min(part, copies)
            w = int(n * lengths[k])
            with_it = best[:size + 1 - w] + n * value[k]
            better = with_it > best[w:]
            np.copyto(best[w:], with_it, where=better)
            steps.append((k, n, w, better))
            copies, part = copies - n, 2 * part
    return best, steps


def read(steps: list, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length number, copies) of the best configurations of several capacities."""
    room, rows, which, copies = room.copy(), [], [], []
    for k, n, w, better in reversed(steps):
        at = np.flatnonzero(room >= w)
        at = at[better[room[at] - w]]
        if len(at):
            rows.append(at)
            which.append(np.full(len(at), k))
            copies.append(np.full(len(at), n))
            room[at] -= w
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (rows, which, copies))


def programme(lengths: np.ndarray, need: np.ndarray, size: int, rng: np.random.Generator) -> dict[tuple, float]:
    """Fractional uses of configurations ((length number, copies), ...) that cover part of ``need``.

    Prices start at a length's share of a sequence. Lengths come in a new order, and prices differ in the sixth digit,
    each round, so that of equally good configurations different ones are found.
    """
    m, price, covered, uses = len(lengths), lengths / size, np.zeros(len(lengths)), {}
    for _ in range(ROUNDS):
        value, order = price * (1 + 1e-6 * rng.random(m)), rng.permutation(m)
        best, steps = knapsack(value[order], lengths[order], need[order], size)
        row, which, copies = read(steps, size - lengths)
        # the best configuration with a length is that length and the best of the rest
        row, which, copies = np.r_[row, np.arange(m)], np.r_[order[which], np.arange(m)], np.r_[copies, np.ones(m, np.int64)]
        total = value + best[size - lengths]
        wanted = need * np.maximum(0.0, 1 - covered)
        good = (total >= (1 - NEAR) * total.max()) & (wanted > 0)
        use = good[row]
        row, which, copies = row[use], which[use], copies[use]
        now = np.bincount(which, weights=wanted[row] * copies, minlength=m) / need
        most = max(float(now.max()), 1e-12)
        scale = min(1.0, STEP / most)
        by = np.lexsort((which, row))
        row, which, copies = row[by], which[by], copies[by]
        cuts = np.searchsorted(row, np.arange(m + 1))
        for i in np.flatnonzero(good).tolist():
            conf: dict[int, int] = {}
            for k, n in zip(which[cuts[i]:cuts[i + 1]].tolist(), copies[cuts[i]:cuts[i + 1]].tolist(), strict=True):
                conf[k] = conf.get(k, 0) + n
            key = tuple(sorted(conf.items()))
            uses[key] = uses.get(key, 0.0) + wanted[i] * scale
        covered += now * scale
        price = price * np.exp(-LEARN * now / most)
    return uses


def solve(lengths: np.ndarray, need: np.ndarray, size: int, passes: int) -> tuple[list[tuple[dict[int, int], int]], list[tuple[int, np.ndarray]]]:
    """Configurations with their whole uses, and after each pass how many there are and what is left."""
    rng, left = np.random.default_rng(0), need.copy()
    uses: list[tuple[dict[int, int], int]] = []
    marks = [(0, left.copy())]
    for _ in range(passes):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        found = programme(lengths[live], left[live], size, rng)
        fill = lambda u: int(sum(lengths[live[k]] * n for k, n in u[0]))
        for key, x in sorted(found.items(), key=lambda u: (-fill(u), -u[1], u[0])):
            idx, per = live[[k for k, _ in key]], np.array([n for _, n in key])
            times = min(int((left[idx] // per).min()), math.ceil(x))
            if times:
                uses.append((dict(zip(idx.tolist(), per.tolist(), strict=True)), times))
                left[idx] -= times * per
        marks.append((len(uses), left.copy()))
    return uses, marks


def best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit-decreasing on counts: ``(configuration, times)``.

    Equal sequences are one group; placing a length into part of a group splits it, so
    the work follows the number of different configurations, not of pieces.
    """
    groups: list[list] = []                                  # [room, times, configuration]
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    for k in np.argsort(-lengths):
        n, need = int(lengths[k]), int(left[k])
        room = n
        while need and room <= size:
            if not by_room[room]:
                room += 1
                continue
            g = by_room[room].pop()
            _, times, conf = groups[g]
            fit = min(room // n, need)                       # of this length in one sequence
            used = min(times, need // fit)
            if used < times:
                groups.append([room, times - used, dict(conf)])
                by_room[room].append(len(groups) - 1)
            groups[g] = [room - fit * n, used, conf | {int(k): conf.get(int(k), 0) + fit}]
            by_room[room - fit * n].append(g)
            need -= fit * used
        while need:
            fit = min(size // n, need)
            groups.append([size - fit * n, need // fit, {int(k): fit}])
            by_room[size - fit * n].append(len(groups) - 1)
            need -= fit * (need // fit)
    return [(conf, times) for _, times, conf in groups if times]


def packed(lengths: np.ndarray, need: np.ndarray, size: int, passes: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations with their uses for all pieces, and how many sequences come from the programme."""
    solved, marks = solve(lengths, need, size, passes)
    used, of_programme, fewest = [], 0, None
    for n, left in reversed(marks):
        rest = best_fit(lengths, left, size)
        mine = sum(t for _, t in solved[:n])
        if fewest is None or mine + sum(t for _, t in rest) < fewest:
            used, of_programme, fewest = solved[:n] + rest, mine, mine + sum(t for _, t in rest)
    return used, of_programme


def plan(histogram: dict[int, int], size: int = 4096, passes: int = PASSES) -> list[tuple[int, int, int, int, int, int, int]]:
    """Slots for every piece: (length, first rank, slots per sequence, first sequence, sequences, offset, last rank + 1)."""
    lengths = np.array(sorted(n for n in histogram if histogram[n]), dtype=np.int64)
    need = np.array([histogram[n] for n in lengths], dtype=np.int64)
    if not len(lengths):
        return []
    used, _ = packed(lengths, need, size, passes)
    rows, rank, sequence = [], dict.fromkeys(range(len(lengths)), 0), 0
    for conf, times in used:
        offset = 0
        for k in sorted(conf, key=lambda k: -lengths[k]):
            n, length = conf[k], int(lengths[k])
            rows.append((length, rank[k], n, sequence, times, offset, rank[k] + n * times))
            rank[k] += n * times
            offset += n * length
        sequence += times
    return rows


def assign(pieces: DataFrame, size: int = 4096, passes: int = PASSES) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset. Reads ``pieces`` twice: store it first.

    Only the histogram (at most ``size`` numbers) and the plan made of it pass
    through the driver; the plan's rows are bounded by ``size`` and ``passes``.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, np.ndarray] = {}
    for r in sorted(plan(histogram, size, passes), key=lambda r: (r[0], r[1])):
        slots.setdefault(r[0], []).append(r)
    slots = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}
    order = [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    numbered = ranked(pieces, ["length"], order, "__rank")
    fields = [f.name for f in pieces.schema]
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(fields.index("length")).to_numpy()
            rank = b.column(len(fields)).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), slots[int(n)]
                row = rows[np.searchsorted(rows[:, 1], rank[at], side="right") - 1]
                k = rank[at] - row[:, 1]
                seq[at], off[at] = row[:, 3] + k // row[:, 2], row[:, 5] + k % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*fields, "sequence_id", "offset"])

    return numbered.select(*fields, "__rank").mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, passes: int = PASSES, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their ids' checksum, sequence and offset."""
    return assign(stored(token_pieces(docs, tokenizer, size, with_ids=with_ids), "pieces"), size, passes)
