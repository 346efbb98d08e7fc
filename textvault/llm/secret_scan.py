r"""Secret scan with structural confirmation.

Three plain patterns (``assign``, ``access``, ``hex``) are always reported.
Beyond them, base64 and hex candidates are *decoded* and reported only when the
bytes have the structure of key material:

* ``der``      a DER private key (PKCS#1, PKCS#8 or SEC1): tag by tag, every nested
               length must fit its parent exactly;
* ``openssh``  an ``openssh-key-v1`` blob: its chain of length-prefixed strings must
               end exactly at the end of the blob;
* ``jwt``      a signed token: header JSON with ``alg``, a JSON object as payload and a
               non-empty signature.

A candidate may begin anywhere, also right after other letters or an escape. A key may be
broken by white space and escaped line ends (``\n`` in JSON or .env files, spaces of a flattened
or indented key, also ``:`` between hex digits); its own lengths tell where it ends. A key broken by
blanks alone must end where its last word ends, so that a cut-off key doesn't borrow the next word.

Defined results: null or empty text has no findings; each occurrence is reported
(repeated rows and repeated secrets included); overlapping spans of different kinds
are all kept; texts are scanned whole. Rows are independent, so nothing shuffles and
a lost executor only repeats its own partitions. Other columns pass through untouched.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textvault.llm.shared import small_batches

# The kinds in reporting order and the base patterns.
KINDS = ["assign", "access", "hex", "der", "openssh", "jwt"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")     # a maximal run, so the length test can be in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")            # likewise
# Beginnings of candidates for decoding: 0x30 (SEQUENCE) and a length of up to four bytes.
B64_DER = re.compile(r"M(?=[A-H]|I[E-T])")
HEX_DER = re.compile(r"30(?=[\s:]?(?:[0-7][0-9A-Fa-f]|8[1-4]))")
SSH_BLOB = re.compile(r"b3BlbnNzaC1rZXktdjE")
B64_RUN, HEX_RUN = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
# What may stand between the characters of a key: white space, escaped white space, escapes of a line end or "/".
B64_GAP = re.compile(r"(?:\s|\\+[nrt]|\\+(?=[\r\n/+]))+")
HEX_GAP = re.compile(r"(?:[\s:]|\\+[nrt]|\\+(?=[\r\n]))+")
# Three dotted parts at the beginning of a run; "ew" and "ey" are "{" with white space or a quote.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,}))")
TOKEN_BEGIN = re.compile(r"e(?=[wy])")

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                              StructField("end", IntegerType())]))

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def unbase64(s: str) -> bytes | None:
    """Bytes of a base64 or base64url string (line ends and missing padding allowed)."""
    s = s.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(b: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the values that fill ``b[lo:hi]`` exactly; None if they don't."""
    out = []
    while lo < hi:
        if lo + 2 > hi:
            return None
        tag, n, lo = b[lo], b[lo + 1], lo + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or lo + k > hi:
                return None
            n, lo = int.from_bytes(b[lo:lo + k], "big"), lo + k
        if lo + n > hi:
            return None
        out.append((tag, lo, lo + n))
        lo += n
    return out


def is_der_key(b: bytes | None) -> bool:
    """PKCS#1, PKCS#8 or SEC1 private key whose nested lengths all fit."""
    if not b or b[0] != SEQUENCE:
        return False
    top = der_items(b, 0, len(b))
    if not top or len(top) != 1:
        return False
    inner = der_items(b, top[0][1], top[0][2])
    if not inner or len(inner) < 2 or inner[0][0] != INTEGER or inner[0][2] - inner[0][1] != 1:
        return False
    version, tags = b[inner[0][1]], [t for t, _, _ in inner]
    if version in (0, 1) and len(tags) >= 9 and all(t == INTEGER for t in tags[:9]):
        return inner[1][2] - inner[1][1] >= 32          # PKCS#1: modulus of 256 bits or more
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(b, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == OID   # PKCS#8
    if version == 1 and tags[1] == OCTETS:
        return inner[1][2] - inner[1][1] >= 16          # SEC1
    return False


def der_key_end(b: bytes | None) -> int:
    """Bytes that the DER key at the start of ``b`` takes by its own length; 0 if there is none."""
    if not b or len(b) < 4 or b[0] != SEQUENCE:
        return 0
    n, at = b[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(b) < 2 + k:
            return 0
        n, at = int.from_bytes(b[2:2 + k], "big"), 2 + k
    end = at + n
    return end if end <= len(b) and is_der_key(b[:end]) else 0


def der_reach(b: bytes) -> int:
    """Bytes of the DER key that may begin ``b``, which has its first 9; 0 if none does."""
    n, at = b[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return 0
        n, at = int.from_bytes(b[2:2 + k], "big"), 2 + k
    # every key has a version first
    return at + n if b[0] == SEQUENCE and b[at] == INTEGER and b[at + 1] in (1, 0x81, 0x82, 0x83, 0x84) else 0


def openssh_reach(b: bytes | None) -> int:
    """Bytes that the blob at the start of ``b`` has at least, exact once ``b`` has them all: magic, cipher, kdf,
    kdf options, number of keys, public keys, private part, each with its length; 0 if it is none."""
    magic = b"openssh-key-v1\x00"
    if not b or not b.startswith(magic):
        return 0
    at, left = len(magic), 3
    counted = False
    while left:
        if at + 4 > len(b):
            return at + 4
        size = int.from_bytes(b[at:at + 4], "big")
        at, left = at + 4 + size, left - 1
        if at > len(b):
            return at
        if not left and not counted:
            if at + 4 > len(b):
                return at + 4
            keys, at, counted = int.from_bytes(b[at:at + 4], "big"), at + 4, True
            if not 1 <= keys <= 64:
                return 0
            left = keys + 1
    return at


def openssh_key_end(b: bytes | None) -> int:
    """Bytes of the blob at the start of ``b``; 0 if a length doesn't fit."""
    n = openssh_reach(b)
    return n if b and n <= len(b) else 0


def json_object(part: str) -> dict | None:
    raw = unbase64(part)
    try:
        v = json.loads(raw.decode("utf-8")) if raw else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def is_signed_token(s: str) -> bool:
    head, body, _ = s.split(".", 2)
    h = json_object(head)
    return bool(h) and isinstance(h.get("alg"), str) and h["alg"].lower() != "none" and json_object(body) is not None


def may_begin_object(part: str) -> bool:
    """Whether the first characters of a head can begin an object with a key, so that decoding all of it is worth while.

    Only what :func:`json_object` is sure to refuse is refused: another byte than the quote of a key after the
    brace, a control character or broken UTF-8 in the key, another byte than a colon after it.
    """
    b = base64.urlsafe_b64decode(part[:len(part) // 4 * 4])
    if len(b) < 2 or b[1] == 0:                   # nothing to tell, or an encoding of more bytes
        return True
    key = b[1:].lstrip(b" \t\r\n")
    if not key:
        return True
    if key[:1] != b'"':
        return False
    name, closed, after = key[1:].partition(b'"')
    if b"\\" in name:
        return True
    try:
        codecs.getincrementaldecoder("utf-8")().decode(name, final=bool(closed))
    except UnicodeDecodeError:
        return False
    if min(name, default=32) < 32:
        return False
    after = after.lstrip(b" \t\r\n")
    return not closed or not after or after[:1] == b":"


def unbroken(text: str, at: int, n: int, run: re.Pattern, gap: re.Pattern) -> tuple[str, int, bool] | None:
    """``n`` characters of ``run`` from ``at`` on without the gaps, their end, and whether blanks alone are
    a gap; None if there are fewer."""
    parts, blank = [], False
    while True:
        if at + n > len(text) or not (m := run.match(text, at, at + n)):
            return None
        parts.append(m.group(0))
        at, n = m.end(), n - len(parts[-1])
        if not n:
            return "".join(parts), at, blank
        if not (g := gap.match(text, at)):
            return None
        blank |= not re.search(r"[^ \t\xa0:]", g.group(0))
        at = g.end()


def key_span(text: str, start: int, known: int, reach, end_of, hexed: bool = False) -> tuple[int, int] | None:
    """Span of the key that begins at ``start``, or None.

    Only as much is read as the key's own lengths ask for: ``known`` bytes first, then ``reach`` of what is read.
    """
    run, gap = (HEX_RUN, HEX_GAP) if hexed else (B64_RUN, B64_GAP)
    n = known
    while True:
        got = unbroken(text, start, 2 * n if hexed else -(-n * 4 // 3), run, gap)
        if not got:
            return None
        chars, end, blank = got
        b = bytes.fromhex(chars) if hexed else unbase64(chars)
        if not b or not (need := reach(b[:n])):
            return None
        if need <= n:
            break
        n = need
    if end_of(b[:n]) != n or (blank and run.match(text, end) and not text.startswith("-----", end)):
        return None
    return start, end if hexed else end + len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))


def key_spans(text: str, begins: re.Pattern, known: int, reach, end_of, hexed: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of the keys of a text, one after the other."""
    done = 0
    for m in begins.finditer(text):
        if m.start() >= done and (span := key_span(text, m.start(), known, reach, end_of, hexed)):
            yield span
            done = span[1]


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the signed tokens; a token may follow other letters of its run."""
    for m in DOTTED.finditer(text):
        head, rest = m.group(1), f".{m.group(2)}.{m.group(3)}"
        for e in TOKEN_BEGIN.finditer(head):
            if may_begin_object(head[e.start():e.start() + 64]) and is_signed_token(head[e.start():] + rest):
                yield m.start() + e.start(), m.end(3)
                break


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """All findings of one text, by start, then kind; code-point offsets, end exclusive."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out += [("der", *span) for span in key_spans(text, B64_DER, 9, der_reach, der_key_end)]
    out += [("der", *span) for span in key_spans(text, HEX_DER, 9, der_reach, der_key_end, hexed=True)]
    out += [("openssh", *span) for span in key_spans(text, SSH_BLOB, 19, openssh_reach, openssh_key_end)]
    if "ey" in text or "ew" in text:
        out += [("jwt", *span) for span in signed_tokens(text)]
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@F.pandas_udf(SPANS)
def secret_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t)] for t in batch],
                        dtype=object)


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` plus ``out``: array<struct<kind, start, end>> of the findings in ``text_col``."""
    return small_batches(docs).withColumn(out, secret_spans(F.col(text_col)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact_text(text: str | None, spans, mark: str) -> str | None:
    """``text`` with the union of the spans replaced by ``mark``."""
    if text is None or spans is None or len(spans) == 0:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding of ``text_col`` replaced by ``mark``; columns unchanged."""
    @F.pandas_udf("string")
    def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([redact_text(t, [{"start": a, "end": b} for _, a, b in scan_text(t)], mark)
                             for t in batch], dtype=object)

    return small_batches(docs).withColumn(text_col, cleaned(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    """The digest rows of query op2: counts and hashed positions per document."""
    found = find_secrets(docs.select("doc_id", "text"), out="spans_")
    n = lambda kind: F.size(F.filter("spans_", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans_", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(F.encode(listed(base), "utf-8"), 256).alias("base_sha256"), listed(F.col("spans_")).alias("spans"),
        F.size(F.filter("spans_", lambda s: ~s["kind"].isin("assign", "access", "hex"))).cast("long").alias("n_confirmed"))
