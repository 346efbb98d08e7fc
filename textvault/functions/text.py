"""Text cleaning as Column expressions (JVM-side, no Python per row).

Every function takes and returns a ``Column`` so it can sit inside any
``select`` and stay in the same stage as the scan.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being matched.
# ---------------------------------------------------------------------------
# Python ``str.strip()`` whitespace (29 code points), as a regex class body.
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Sentence terminators.
SENTENCE_END = ".。!！?？;；"
# Line repair (fix_newlines): characters ending a line that was broken by mistake.
JOIN_BARE = ",，\\/-——~～+=*^&%$#@[<《“、"
JOIN_SPACE = ":：\"'"
NEW_LINE_END = "\n。.！!？?；;:：……)]”"
# Figure / table / equation label at the start of a line (case-insensitive).
LABEL_PATTERN = (r"^(?:[图表式注引]\.*[WS]*\p{Nd}+|Fig\.?\p{Nd}+|Figure\.?[WS]*\p{Nd}+"
                 r"|Table\.?[WS]*\p{Nd}+|Equation\.?[WS]*\p{Nd}+|Equ\.?[WS]*\p{Nd}+)")
ASCII_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"     # one by one: a table in Java's classes
# CJK unified ideographs block used by the "is Chinese" test.
CJK_FIRST, CJK_LAST = "一", "鿿"
# Code fence marker for markdown rendering.
FENCE = "```"
# In-fence escapes applied by show_text, in this order.
FENCE_ESCAPES = [
    ("`", "\\`"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;"), ("*", "&ast;"),
    ("_", "&lowbar;"), ("-", "&#45;"), (".", "&#46;"), ("!", "&#33;"), ("(", "&#40;"),
    (")", "&#41;"), ("$", "&#36;"),
]
# ---------------------------------------------------------------------------

WS = f"[{WS_CLASS}]"
# the same 29 code points as a literal set for ``btrim``
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
LABEL_REGEX = "(?i)" + LABEL_PATTERN.replace("[WS]", WS)
CJK_CLASS = r"\x{4E00}-\x{9FFF}"


def _regex_class_escape(chars: str) -> str:
    out = []
    for ch in chars:
        out.append("\\" + ch if ch in "\\]^-[&" else ch)
    return "".join(dict.fromkeys(out))


@lru_cache(maxsize=1)
def fullwidth_table() -> tuple[str, str, dict[str, str]]:
    """(from, to) for ``translate`` plus multi-char replacements.

    Rule: every code point whose Unicode name contains FULLWIDTH maps to its
    NFKC form. Built from the Unicode database rather than listed.
    """
    src, dst, multi = [], [], {}
    for cp in range(0x110000):
        ch = chr(cp)
        if "FULLWIDTH" not in unicodedata.name(ch, ""):
            continue
        norm = unicodedata.normalize("NFKC", ch)
        if len(norm) == 1:
            src.append(ch)
            dst.append(norm)
        else:
            multi[ch] = norm
    return "".join(src), "".join(dst), multi


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: plain ``trim`` only removes U+0020."""
    return F.btrim(c, F.lit(WS_CHARS))


def bound(c: Column, f) -> Column:
    """``f(c)``, with ``c`` computed once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def replace_fullwidth_chars(c: Column) -> Column:
    src, dst, multi = fullwidth_table()

    def rewritten(x):
        out = F.translate(F.regexp_replace(x, "　+", " "), src, dst)
        for k, v in multi.items():
            out = F.replace(out, F.lit(k), F.lit(v))
        # most text has none of these characters: cheap scans skip the rewrite
        return F.when(_beyond_ascii(x) & x.rlike("[　-\uFFE6&&[　\uFF01-\uFF60\uFFE0-\uFFE6]]"), out).otherwise(x)

    return bound(c, rewritten)


def is_label_number_format(c: Column) -> Column:
    return c.rlike(LABEL_REGEX)


def is_character_chinese(c: Column) -> Column:
    return c.rlike(f"^[{CJK_CLASS}]$")


def is_character_valid(c: Column) -> Column:
    """Letter, number, or CJK ideograph (one character)."""
    return c.rlike(f"^[\\p{{L}}\\p{{N}}{CJK_CLASS}]$")


def is_punctuation(c: Column) -> Column:
    """Not alphanumeric and not whitespace (one character)."""
    return c.rlike(f"^[^\\p{{L}}\\p{{N}}{WS_CLASS}]$")


def _in_set(ch: Column, chars: str) -> Column:
    return F.instr(F.lit(chars), ch) > 0


def _line_separator(line: Column, last: Column) -> Column:
    """Separator placed before a non-first line by the line-repair rules.

    ``last`` is the last character of the previous raw line after stripping
    ('' when that line is blank).
    """
    return (
        F.when(py_strip(line) == "", "\n")
        .when(F.substring(line, 1, 1) == " ", "\n")
        .when(is_label_number_format(line), "\n")
        .when(last == "", "\n")
        .when(_in_set(last, JOIN_BARE), "")
        .when(_in_set(last, JOIN_SPACE), " ")
        .when(_in_set(last, NEW_LINE_END), "\n")
        .when(is_character_valid(last), "")
        .otherwise("\n")
    )


def fix_newlines(c: Column) -> Column:
    """Repair hard line breaks; each boundary depends on two adjacent raw lines.

    Lines are zipped with the last character of their predecessor, so no
    lambda reaches outside its own arguments (an outer reference would be
    re-evaluated per element).
    """
    lines = F.split(c, "\n", -1)
    prev = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    lasts = F.concat(F.array(F.lit(None).cast("string")),
                     F.transform(prev, lambda p: F.substring(py_strip(p), -1, 1)))
    pieces = F.zip_with(lines, lasts, lambda l, ch: F.when(ch.isNull(), l).otherwise(F.concat(_line_separator(l, ch), l)))
    return F.replace(F.array_join(pieces, ""), F.lit("\n\n"), F.lit("\n"))


def fix_error_space(c: Column) -> Column:
    """Collapse space runs, drop a space before a lone CJK char, strip."""
    c = _replaced_if(c, lambda x: F.contains(x, F.lit("  ")), " {2,}", " ")
    c = _replaced_if(c, _beyond_ascii, f" (?=[{CJK_CLASS}] )", "")
    return py_strip(c)


def _replaced_if(c: Column, may_match, pattern: str, by: str) -> Column:
    """``regexp_replace``, run only on texts that a cheap scan finds may match."""
    return bound(c, lambda x: F.when(may_match(x), F.regexp_replace(x, pattern, by)).otherwise(x))


def text_preprocess(c: Column) -> Column:
    c = replace_fullwidth_chars(c)
    c = fix_newlines(c)
    c = fix_error_space(c)
    return _replaced_if(c, lambda x: F.contains(x, F.lit("\n\n")), "\n{2,}", "\n")


def normalize_newlines(c: Column) -> Column:
    """Universal-newline translation of text-mode reads."""
    return F.regexp_replace(c, "\r\n?", "\n")


def decode_utf8_or_empty(b: Column) -> Column:
    """Decode bytes as UTF-8; undecodable content becomes ''."""
    return F.when(F.is_valid_utf8(b.cast("string")), normalize_newlines(b.cast("string"))).otherwise(F.lit(""))


# --- paths -----------------------------------------------------------------

def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """``os.path.splitext`` extension without the dot; a leading-dot name has none."""
    return F.regexp_extract(name, r"^\.*[^.].*\.([^./]*)$", 1)


def stem_of(name: Column) -> Column:
    """File name without its last extension (``splitext(name)[0]``)."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^./]*$", "$1")


# --- fingerprints and labels -----------------------------------------------

def md5_text(c: Column) -> Column:
    return F.md5(c)


# The words around file name and chunk number in fingerprints and transcripts.
FILE_HEAD, PART_HEAD, PART_TAIL = "文件 ", " 第", "部分"


def file_fingerprint_text(filename: Column, text: Column) -> Column:
    return F.concat(F.lit(FILE_HEAD), filename, F.lit("\n"), text)


def chunk_label(filename: Column, chunk_no: Column) -> Column:
    return F.concat(F.lit(FILE_HEAD), filename, F.lit(PART_HEAD), chunk_no.cast("string"), F.lit(PART_TAIL))


def chunk_fingerprint_text(filename: Column, chunk_no: Column, chunk: Column) -> Column:
    return F.concat(chunk_label(filename, chunk_no), F.lit("\n"), chunk)


def chunk_key(filename_md5: Column, chunk_no: Column) -> Column:
    return F.concat(filename_md5, F.lit("_"), chunk_no.cast("string"))


def stable_id(md5_hex: Column) -> Column:
    """A bigint row id derived from an md5 hex string (first 15 hex digits)."""
    return F.conv(F.substring(md5_hex, 1, 15), 16, 10).cast("bigint")


# --- markdown-ish rendering (show_text) ------------------------------------

def _escape_in_fence(l: Column) -> Column:
    for a, b in FENCE_ESCAPES:
        l = F.replace(l, F.lit(a), F.lit(b))
    return l


FENCE_LINE = r"(?<![^\n])[^\n]*?```[^\n]*"   # a whole line with a fence in it


def _kept_lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n", -1), lambda l: l != "")


def show_text(c: Column) -> Column:
    """Render text to HTML the way the chat view does.

    Empty lines are dropped; a line is inside a code block after an odd number of fence
    lines. The first kept line is never prefixed nor escaped. The text is split at its
    fence lines, so piece i stands after i fences and each line is rendered once. A text
    without a fence is one piece and isn't searched for fence lines.
    """
    return bound(c, lambda x: F.when(F.contains(x, F.lit(FENCE)), _show_fenced(x)).otherwise(F.array_join(_kept_lines(x), "<br>")))


def _show_fenced(c: Column) -> Column:
    fences = F.concat(F.array(F.lit("")), F.regexp_extract_all(c, F.lit(FENCE_LINE), 0))
    pairs = F.zip_with(F.split(c, FENCE_LINE, -1), fences, lambda p, f: F.struct(p.alias("p"), f.alias("f")))

    def rendered(x, i):
        lines = _kept_lines(x["p"])
        inside = i % 2 == 1
        lang = F.element_at(F.split(x["f"], "`", -1), -1)
        fence = (F.when(i == 0, "").when(inside, F.concat(F.lit('<pre><code class="language-'), lang, F.lit('">')))
                 .otherwise("<br></code></pre>"))
        body = F.array_join(F.transform(lines, lambda l: F.when(inside, _escape_in_fence(l)).otherwise(l)), "<br>")
        return F.concat(fence, F.when((i > 0) & (F.size(lines) > 0), "<br>").otherwise(""), body)

    return F.array_join(F.transform(pairs, rendered), "")


def fence_depth(c: Column) -> Column:
    """Per non-empty line: running count of fence lines (odd = inside a block)."""
    pieces = F.split(c, FENCE_LINE, -1)

    def counts(p, i):
        own = F.array_repeat(i, F.size(_kept_lines(p)))
        return F.when(i == 0, own).otherwise(F.concat(F.array(i), own))

    return F.flatten(F.transform(pieces, counts))


# --- positions of a pattern ---------------------------------------------------

def find_from(c: Column, pattern: str, start: int = 0) -> Column:
    """First place at or after ``start``; -1 if none."""
    return F.locate(pattern, c, start + 1) - 1


def find_before(c: Column, pattern: str, end: Column | int) -> Column:
    """Start of the last occurrence that ends at or before ``end``; -1 if none."""
    head = F.reverse(F.substring(c, 1, end) if isinstance(end, int) else F.substring(c, F.lit(1), end))
    at = F.locate(pattern[::-1], head)
    return F.when(at > 0, F.length(head) - at + 1 - len(pattern)).otherwise(-1)
