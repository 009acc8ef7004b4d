"""Raw transcripts: one HTML document per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.steps import computed_once

# The character sets Spark decodes itself.
_SPARK_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def decoded(content: Column, encoding: str) -> Column:
    """Bytes as text. Other single-byte character sets, like windows-1252, are read as
    iso-8859-1, whose characters are the bytes, and each byte's character is then replaced."""
    if encoding.lower() in _SPARK_CHARSETS:
        return F.decode(content, encoding)
    high = [bytes([b]) for b in range(0x80, 0x100)]
    replaced = [(b.decode("iso-8859-1"), b.decode(encoding, "ignore")) for b in high]
    if len("".join(new for _, new in replaced)) < 64:
        raise ValueError(f"{encoding} is neither known to Spark nor a single-byte character set")
    replaced = [(old, new) for old, new in replaced if new]
    text = F.decode(content, "iso-8859-1")
    return F.translate(text, "".join(o for o, _ in replaced), "".join(n for _, n in replaced))


# Labels of character sets as documents declare them, and the sets they are read as.
CHARSETS = {
    "utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "windows-1252", "ascii": "windows-1252",
    "iso-8859-1": "iso-8859-1", "latin1": "iso-8859-1", "iso_8859-1": "iso-8859-1", "l1": "iso-8859-1",
    "windows-1252": "windows-1252", "cp1252": "windows-1252", "x-cp1252": "windows-1252",
    "windows-1250": "windows-1250", "cp1250": "windows-1250", "windows-1251": "windows-1251", "cp1251": "windows-1251",
    "iso-8859-2": "iso-8859-2", "latin2": "iso-8859-2", "iso-8859-15": "iso-8859-15", "latin-9": "iso-8859-15",
    "koi8-r": "koi8-r", "utf-16": "utf-16", "utf-16le": "utf-16le", "utf-16be": "utf-16be",
}
DECLARED_WITHIN = 4096
_DECLARATION = r"(?is)<meta\b[^<>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)|<\?xml\b[^<>]*?\bencoding\s*=\s*[\"']([A-Za-z0-9_-]+)"


def charset_of(content: Column, fallback: str = "windows-1252") -> Column:
    """The character set of a document's bytes: by its byte order mark, else as its first ``DECLARED_WITHIN``
    bytes declare it, else UTF-8 where the bytes are that, else ``fallback``.

    A declared UTF-8 that the bytes are not, an unknown label, and a declared UTF-16 without a mark, whose
    declaration could not have been read so, count as none.
    """
    head = F.decode(F.substring(content, 1, DECLARED_WITHIN), "iso-8859-1")
    mark = F.hex(F.substring(content, 1, 3))
    names = F.regexp_extract_all(head, F.lit(_DECLARATION), 1), F.regexp_extract_all(head, F.lit(_DECLARATION), 2)
    label = F.lower(F.coalesce(*[F.nullif(F.get(n, F.lit(0)), F.lit("")) for n in names]))
    known = F.lit(None).cast("string")
    for charset in sorted(set(CHARSETS.values()) - {"utf-16", "utf-16le", "utf-16be"}):
        known = F.when(label.isin([n for n, c in CHARSETS.items() if c == charset]), charset).otherwise(known)
    valid = F.is_valid_utf8(content.cast("string"))
    return (
        F.when(mark == "EFBBBF", "utf-8")
        .when(mark.startswith("FFFE"), "utf-16le")
        .when(mark.startswith("FEFF"), "utf-16be")
        .when(known.isNotNull() & ((known != "utf-8") | valid), known)
        .when(valid, "utf-8")
        .otherwise(fallback)
    )


def decoded_as(content: Column, charset: Column, charsets: Iterable[str] = tuple(dict.fromkeys(CHARSETS.values()))) -> Column:
    """Bytes as text, each row by its own character set; malformed UTF-8 gets replacement characters, and byte
    order marks go. Null for a set that is not among ``charsets``."""
    out = F.lit(None).cast("string")
    for name in charsets:
        if name == "utf-8":
            text = F.make_valid_utf8(content.cast("string"))
        elif name.startswith("utf-16"):
            # whole units only
            text = F.decode(F.when(charset == name, F.substring(content, F.lit(1), F.length(content) - F.length(content) % 2)), name)
        else:
            text = decoded(F.when(charset == name, content), name)
        out = F.when(charset == name, text).otherwise(out)
    return F.regexp_replace(out, "^\uFEFF", "")


def with_text(files: DataFrame, fallback: str = "windows-1252") -> DataFrame:
    """Adds to ``files(content)`` the character set of each row's bytes, and their text. The bytes are looked
    through once: the set is a value before the text is made from it."""
    found = computed_once(files, "charset", charset_of(F.col("content"), fallback))
    return found.withColumn("text", decoded_as(F.col("content"), F.col("charset")))


def read_pages(spark: SparkSession, path: str, encoding: str | None = "UTF-8") -> DataFrame:
    """``raw(file, html)`` from a directory or glob of HTML files, read whole.

    ``encoding`` is the character set the source is known to use; None takes each file's own declaration.
    Very many small files are better packed once into a table; ``named_pages`` takes it from there.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.col("_metadata.file_name").alias("file"), "content")
    if encoding:
        return files.select("file", decoded(F.col("content"), encoding).alias("html"))
    return with_text(files).select("file", F.col("text").alias("html"))


def named_pages(pages: DataFrame, name: str = "url") -> DataFrame:
    """``raw(file, html)`` plus the key of a table that already holds the documents."""
    return pages.withColumnRenamed(name, "file")


def without_files(raw: DataFrame, names: Iterable[str]) -> DataFrame:
    """All documents but those named; a document without a name stays."""
    names = list(names)
    if not names:
        return raw
    return raw.filter(~F.coalesce(F.col("file").isin(names), F.lit(False)))
