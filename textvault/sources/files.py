"""Document folders and formats.

A folder is read with the ``binaryFile`` source (path, modificationTime,
length, content): listing, decoding and format dispatch are Column
expressions, so a folder of millions of files is just a wide scan.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvault.functions.text import (basename, decode_utf8_or_empty, dirname, extension,
                                      show_text, stem_of, text_preprocess)
from textvault.operators.outline import toc_line

# File types offered for upload.
ALLOWED_EXTENSIONS = ["pdf", "txt", "md", "py", "html", "js", "java", "h", "cpp", "c", "hpp", "json", "toml", "ipynb",
                      "yml", "rst"]
# Regex steps of HTML text extraction, in order. A tag ends at the first ``>`` outside quotes.
HTML_DROP = [
    r"(?s)<!--.*?-->",
    r"(?is)<!doctype[^>]*>",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
    r"(?is)<template\b[^>]*>.*?</template\s*>",
    r"""(?s)</?[A-Za-z](?:[^>"']|"[^"]*"|'[^']*')*>""",
    r"(?s)<[!?][^>]*>",
]
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def read_folder(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Recursive listing: (path, dir, filename, ext, modificationTime, length[, content])."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cols = [F.col("path"), dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("filename"),
            extension(basename(F.col("path"))).alias("ext"), "modificationTime", "length"]
    if with_content:
        cols.append("content")
    return df.select(*cols)


def list_files(listing: DataFrame, key: str = "basename") -> DataFrame:
    """Distinct file names to index, with sibling preference.

    ``x.caj`` is indexed as ``x.pdf`` when that file exists in the same folder
    and dropped otherwise (conversion is not built). ``key='relpath'`` keeps the
    folder so equal names in different folders do not collide.
    """
    pdfs = listing.filter(F.col("ext") == "pdf").select("dir", stem_of(F.col("filename")).alias("stem"))
    cajs = listing.filter(F.col("ext") == "caj").select("dir", stem_of(F.col("filename")).alias("stem"))
    # a caj with a pdf sibling maps to that pdf; others are dropped
    plain = listing.filter(F.col("ext") != "caj").select("dir", "filename")
    mapped = cajs.join(pdfs, ["dir", "stem"], "left_semi").select(
        "dir", F.concat(F.col("stem"), F.lit(".pdf")).alias("filename"))
    plain = plain.unionByName(mapped)
    name = F.col("filename") if key == "basename" else F.concat_ws("/", "dir", "filename")
    return plain.select(name.alias("filename")).distinct()


def _code_point(ref: Column) -> Column:
    """Code point of a character reference such as ``&eacute;``, ``&#233;`` or ``&#xE9;`` (NULL if unknown)."""
    names = F.create_map(*[F.lit(x) for name, cp in sorted(name2codepoint.items()) for x in (name, cp)],
                         F.lit("apos"), F.lit(39))
    return (F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX]([0-9A-Fa-f]+);", 1), 16, 10).cast("int"))
            .when(ref.startswith("&#"), F.regexp_extract(ref, "^&#([0-9]+);", 1).cast("int"))
            .otherwise(F.element_at(names, F.regexp_extract(ref, "^&(.*);$", 1))))


def decode_entities(text: Column) -> Column:
    """Character references replaced in one pass; unknown ones and code points outside Unicode stay."""
    def decoded(ref):
        cp = _code_point(ref)
        valid = ((cp >= 1) & (cp < 0xD800)) | ((cp > 0xDFFF) & (cp <= 0x10FFFF))
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(cp.cast("bigint")), 8, "0")), "UTF-32")).otherwise(ref)

    refs = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), 0), decoded)
    pieces = F.split(text, ENTITY, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(refs, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    """All text nodes concatenated; tags, comments, doctype, script/style/template dropped."""
    t = html
    for pat in HTML_DROP:
        t = F.regexp_replace(t, pat, "")
    return decode_entities(t)


def pages_to_text(pages: DataFrame, key: str = "filename", order: str = "page_no",
                  text: str = "text") -> DataFrame:
    """(key, text): page texts joined by a line feed in page order."""
    return pages.groupBy(key).agg(
        F.expr(f"listagg({text}, '\\n') WITHIN GROUP (ORDER BY {order})").alias("text"))


def read_text(ext: Column, content_text: Column, html_text: Column | None = None) -> Column:
    """Format dispatch of ``advanced_read_text`` followed by preprocessing."""
    html_text = html_to_text(content_text) if html_text is None else html_text
    raw = (F.when(ext == "html", html_text)
           .when(ext == "caj", F.lit(""))
           .otherwise(content_text))
    return text_preprocess(raw)


def read_and_render(files: DataFrame) -> DataFrame:
    """(filename, html) of (path, body) rows: each file read by its type and rendered for display."""
    name = basename(F.col("path"))
    read = files.select(name.alias("filename"), read_text(extension(name), F.col("body")).alias("text"))
    return read.select("filename", show_text(F.col("text")).alias("html"))


def read_documents(listing: DataFrame, pdf_pages: DataFrame | None = None) -> DataFrame:
    """(filename, text) for every listed non-PDF file; PDFs come as page rows.

    ``pdf_pages`` is the output of a document-extractor hook: (filename, page_no, text).
    """
    non_pdf = listing.filter(F.col("ext") != "pdf").select(
        "filename", "ext", decode_utf8_or_empty(F.col("content")).alias("body"))
    out = non_pdf.select("filename", read_text(F.col("ext"), F.col("body")).alias("text"))
    if pdf_pages is not None:
        out = out.unionByName(pages_to_text(pdf_pages).select("filename", text_preprocess(F.col("text")).alias("text")))
    return out


def allowed_upload(name: Column, allowed=ALLOWED_EXTENSIONS) -> Column:
    return extension(name).isin(list(allowed))


# --- SQL scripts --------------------------------------------------------------

def sql_statements(scripts: DataFrame, col: str = "text") -> DataFrame:
    """Other columns plus (stmt_no, stmt): split on ';', trim, drop blanks (no literal awareness)."""
    keep = [c for c in scripts.columns if c != col]
    parts = scripts.select(*keep, F.posexplode(F.split(F.col(col), ";", -1)).alias("pos", "stmt"))
    trimmed = parts.select(*keep, F.col("pos").cast("bigint").alias("stmt_no"), F.btrim("stmt", F.lit(" \t\n\x0b\f\r")).alias("stmt"))
    return trimmed.filter(F.col("stmt") != "")


def execute_sql_file(spark: SparkSession, path: str) -> int:
    """Run each statement of a DDL script (driver-side, statements are few)."""
    script = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    n = 0
    for r in sql_statements(script).orderBy("stmt_no").toLocalIterator():
        spark.sql(r["stmt"])
        n += 1
    return n


# --- binary containers ------------------------------------------------------------

# Container magic and header offsets (0 = field absent).
#   first byte C8 -> C8 (pages at 0x08, no TOC)
#   "HN" then bytes C8 00 at 4..5 -> HN variant (pages at 0x90, no TOC)
#   else the first 4 bytes without NULs: "CAJ" (0x10, 0x110), "HN" (0x90, 0x158),
#   "%PDF", "KDH ", "TEB" (no header counts)
FORMAT_NAMES = {"CAJ": "CAJ", "HN": "HN", "%PDF": "PDF", "KDH ": "KDH", "TEB": "TEB"}
PAGE_OFFSET = {"C8": 0x08, "HN_C8": 0x90, "CAJ": 0x10, "HN": 0x90}
TOC_OFFSET = {"CAJ": 0x110, "HN": 0x158}
TOC_RECORD = 0x134


def container_format(content: Column) -> Column:
    """Format tag from the leading magic bytes, else 'unknown'.

    ``HN_C8`` marks the HN variant without a table of contents.
    """
    head = F.substring(content, 1, 4)
    tag4 = F.replace(F.decode(head, "ISO-8859-1"), F.lit("\u0000"), F.lit(""))
    expr = (F.when(F.hex(F.substring(content, 1, 1)) == "C8", F.lit("C8"))
            .when((F.hex(F.substring(content, 1, 2)) == "484E") & (F.hex(F.substring(content, 5, 2)) == "C800"),
                  F.lit("HN_C8")))
    for magic, name in FORMAT_NAMES.items():
        expr = expr.when(tag4 == magic, F.lit(name))
    return expr.otherwise(F.lit("unknown"))


def _offset(table: dict, fmt: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[fmt], F.lit(0))


def le_int32(content: Column, offset: int | Column) -> Column:
    """Little-endian signed int32 at a 0-based byte offset."""
    off = offset if isinstance(offset, Column) else F.lit(offset)
    b = F.hex(F.substring(content, off + 1, 4))
    le = F.concat(F.substring(b, 7, 2), F.substring(b, 5, 2), F.substring(b, 3, 2), F.substring(b, 1, 2))
    u = F.conv(le, 16, 10).cast("bigint")
    return F.when(u >= 2 ** 31, u - 2 ** 32).otherwise(u).cast("int")


def header_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """Add fmt, page_num, toc_num (0 when the format keeps no table of contents)."""
    out = df.withColumn("fmt", container_format(F.col(content)))
    page_off, toc_off = _offset(PAGE_OFFSET, F.col("fmt")), _offset(TOC_OFFSET, F.col("fmt"))
    return (out.withColumn("page_num", F.when(page_off > 0, le_int32(F.col(content), page_off)).otherwise(0))
            .withColumn("toc_num", F.when(toc_off > 0, le_int32(F.col(content), toc_off)).otherwise(0)))


def explode_records(df: DataFrame, content: str, offset: Column, stride: int, count: Column) -> DataFrame:
    """One row per fixed-width record: (rec_no, rec) slices of a binary column."""
    idx = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.posexplode(idx).alias("rec_no", "_i")).select(
        "*", F.substring(F.col(content), offset + F.col("rec_no") * stride + 1, stride).alias("rec")).drop("_i")


def toc_entries(df: DataFrame, content: str = "content", charset: str = "UTF-8") -> DataFrame:
    """TOC records (title 256 B NUL-terminated, 24 B, page 12 B text, 12 B, level int32).

    Titles are GB18030 in the wild: pass ``charset='GB18030'`` with
    ``spark.sql.legacy.javaCharsets=true``.
    """
    h = header_counts(df, content)
    toc_off = _offset(TOC_OFFSET, F.col("fmt"))
    recs = explode_records(h, content, toc_off + 4, TOC_RECORD, F.col("toc_num"))
    title = F.regexp_replace(F.decode(F.substring("rec", 1, 256), charset), "\u0000.*$", "")
    page_s = F.regexp_replace(F.decode(F.substring("rec", 281, 12), "ISO-8859-1"), "\u0000.*$", "")
    return recs.select("*", title.alias("title"), page_s.cast("int").alias("page"),
                       le_int32(F.col("rec"), 304).alias("level"))


def output_toc(entries: DataFrame) -> DataFrame:
    """Entries (title, page, level) with their outline ``line``."""
    return entries.select("*", toc_line().alias("line"))
