"""File formats, names, paths and display forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_extract(name, r"[^./\\]\.([^./\\]+)$", 1))), F.lit(""))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def looks_like_epub(content: Column) -> Column:
    return (F.length(content) > 58) & F.startswith(content, F.unhex(F.lit("504B0304"))) & F.contains(F.substring(content, 1, 200), F.encode(F.lit("mimetype"), "UTF-8"))


def markup_sniff(content: Column) -> Column:
    """html, plain or null for the first 2048 bytes; a NUL byte rules both out."""
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    low = F.lower(F.regexp_replace(head, r"^(?:\xEF\xBB\xBF)?\s+", ""))
    html = F.startswith(low, F.lit("<!doctype html")) | F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body"))
    printable = F.floor(F.regexp_count(head, F.lit(r"[\x09\x0A\x0D\x20-\x7E\x80-\xFF]")) * 100 / F.length(head))
    return F.when(F.contains(head, F.lit("\0")), None).when(html, "html").when((F.length(head) > 0) & (printable > 95), "plain")


def detect(name: Column, content: Column) -> Column:
    """Struct of class (pdf, html, other) and detail: magic bytes, then markup, then the name's extension."""
    ext, sniffed = extension(name), markup_sniff(content)
    detail = (
        F.when(F.startswith(content, F.encode(F.lit("%PDF-"), "UTF-8")), "pdf")
        .when(looks_like_epub(content), "epub")
        .when(sniffed == "html", "html")
        .when(sniffed == "plain", F.when(ext.isin("html", "htm", "xhtml"), "html").otherwise("txt"))
        .when(ext.isin("htm", "xhtml"), "html")
        .otherwise(F.coalesce(ext, F.lit("bin")))
    )
    return F.struct(F.when(detail.isin("pdf", "html"), detail).otherwise("other").alias("class"), detail.alias("detail"))


def is_text(detail: Column) -> Column:
    return detail.isin("html", "txt", "epub")


def _legacy(contents: pd.Series) -> pd.Series:
    def decode(raw: bytes) -> str:
        for name in ("gbk", "big5", "shift_jis"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", "replace")

    return contents.map(lambda x: decode(bytes(x)), na_action="ignore")


def decode_text(content: Column) -> Column:
    """Byte-order marks, then strict UTF-8, then the legacy encodings; only what is no UTF-8 leaves the JVM."""
    starts = lambda mark: F.startswith(content, F.unhex(F.lit(mark)))
    rest = lambda n: F.substring(content, n + 1, 2**31 - 1 - n)
    odd = F.when(~F.is_valid_utf8(content.cast("string")), content)
    return F.when(starts("EFBBBF"), rest(3).cast("string")).when(starts("FFFE"), F.decode(rest(2), "UTF-16LE")).when(starts("FEFF"), F.decode(rest(2), "UTF-16BE")).when(odd.isNull(), content.cast("string")).otherwise(F.pandas_udf(_legacy, "string")(odd))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(digest: Column) -> Column:
    return F.substring(digest, 1, 12)


def safe_extension(ext: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.substring(F.regexp_replace(ext, "[^A-Za-z0-9]", ""), 1, 12)), F.lit("")), F.lit("bin"))


def work_folder(work_id: Column) -> Column:
    return F.format_string("library/%06d", work_id)


def relative_path(work_id: Column, version: Column, ext: Column) -> Column:
    plain = F.format_string("library/%06d/work.%s", work_id, safe_extension(ext))
    return F.when(version <= 1, plain).otherwise(F.format_string("library/%06d/work.v%d.%s", work_id, version, safe_extension(ext)))


def grouped_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def word_count_display(count: Column, source: Column) -> Column:
    """A dash for none, ~ for an estimate."""
    return F.when(count == 0, "—").when(F.coalesce(source, F.lit("")).isin("ao3", "manual"), grouped_digits(count)).otherwise(F.concat(F.lit("~"), grouped_digits(count)))


def bytes_display(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def format_label(kind: Column, detail: Column) -> Column:
    return F.when(kind == "other", F.concat(F.lit("Other · "), F.upper(detail))).otherwise(F.upper(detail))


def language_badge(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", "?").otherwise(F.upper(code))


def highlight(text: Column, query: str) -> Column:
    """Array of (text, hit): the literal, case-insensitive occurrences of query and what lies between them."""
    import re

    if not query:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    quoted = re.escape(query)
    parts = F.regexp_extract_all(text, F.lit(f"(?is)({quoted}|(?:(?!{quoted}).)+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), (F.lower(p) == query.lower()).alias("hit")))
