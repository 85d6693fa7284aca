"""Document sources: key-value listing texts, profile files (DOCX, PDF, JSON) and related files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Text, heading_key, norm_key, text
from ..schema import PROFILE
from ..shipping import ship_package

# Prefixes of a listing text's fields.
PREFIXES = (("company", "empresa"), ("location", "ubicacion|ubicación"), ("modality", "modalidad"), ("salary", "salario"), ("requirements", "requisitos"))


def listing_of(raw: Text) -> Column:
    """struct(title, company, location, modality, salary, requirements, url, description): the first line, prefixed fields, the first URL, all of it."""
    t = text(raw)
    field = lambda p: F.trim(F.regexp_extract(t, rf"(?im)^\s*(?:{p})\s*:(.*)$", 1))
    first = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit(""))
    return F.struct(first.alias("title"), *(field(p).alias(n) for n, p in PREFIXES), F.regexp_extract(t, r"(https?://\S+)", 1).alias("url"), F.trim(t).alias("description"))


def mail_alerts(spark) -> DataFrame:
    """Listing texts from mail alerts: an empty source until a connector lands them."""
    return spark.createDataFrame([], "raw string")


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells joined by ' | '."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    lines = [s for p in body.findall(f"{w}p") if (s := said(p))]
    for table in body.findall(f"{w}tbl"):
        for row in table.iter(f"{w}tr"):
            if cells := [s for c in row.findall(f"{w}tc") if (s := said(c))]:
                lines.append(" | ".join(cells))
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    """Text of pages that hold plain or deflated text operators; a PDF library, where one is installed, does better."""
    try:
        from pypdf import PdfReader
    except ImportError:
        import zlib

        out = []
        for raw in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.DOTALL):
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                pass
            shown = re.findall(rb"\(((?:\\.|[^()\\])*)\)\s*Tj|\[((?:\\.|[^\]])*)\]\s*TJ", raw)
            for plain, spaced in shown:
                parts = [plain] if plain else re.findall(rb"\(((?:\\.|[^()\\])*)\)", spaced)
                out.append(b"".join(parts).replace(b"\\(", b"(").replace(b"\\)", b")").decode("latin-1"))
        return "\n".join(out)
    return "\n".join((page.extract_text() or "") for page in PdfReader(io.BytesIO(content)).pages)


def profile_texts(spark, path: str) -> DataFrame:
    """(path, raw) of DOCX and PDF files below a path, read where they lie; other kinds are an error."""
    ship_package(spark)

    @F.pandas_udf("string")
    def extract(paths: pd.Series, contents: pd.Series) -> pd.Series:
        def one(p, c):
            kind = p.rsplit(".", 1)[-1].lower()
            if kind not in ("docx", "pdf"):
                raise ValueError(f"unsupported profile file: .{kind}")
            return docx_text(c) if kind == "docx" else pdf_text(c)

        return pd.Series([one(p, c) for p, c in zip(paths, contents, strict=True)])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", extract("path", "content").alias("raw"))


def related_files(files: DataFrame, name: Column, hints=("cv", "hoja", "resume")) -> DataFrame:
    """Files whose name has a hint and at least two words of a person's name (four letters or more)."""
    file_key = norm_key(F.element_at(F.split("path", "/"), -1))
    words = F.filter(F.split(norm_key(name), " "), lambda w: F.length(w) >= 4)
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | file_key.contains(h)
    return files.where(hinted & (F.size(F.filter(words, lambda w: F.contains(file_key, w))) >= 2))


def profiles_from_json(spark, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).option("multiLine", True).json(path)


__all__ = ["docx_text", "heading_key", "listing_of", "mail_alerts", "pdf_text", "profile_texts", "profiles_from_json", "related_files"]
