"""Sinks: snapshots swapped in whole, exports, rendered documents and delivery logs."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_utc
from ..functions.text import first_non_empty, json_list, text

EXPORT_COLUMNS = ("portal", "target_role", "title", "company", "location", "url", "compatibility_score", "discard_reasons", "detected_keywords", "seen_count", "found_at", "last_seen_at")


def export_rows(discarded: DataFrame) -> DataFrame:
    """Rows as they are exported: lists joined with '; ', the canonical URL where there is one, times in ISO-8601."""
    kinds = dict(discarded.dtypes)
    as_list = lambda c: F.col(c) if kinds.get(c) == "array<string>" else json_list(c)
    made = {"url": first_non_empty("normalized_url", "url") if "normalized_url" in kinds else text("url")}
    made |= {c: F.array_join(as_list(c), "; ") for c in ("discard_reasons", "detected_keywords") if c in kinds}
    made |= {c: F.coalesce(iso_utc(c), F.lit("")) for c in ("found_at", "last_seen_at") if c in kinds}
    return discarded.withColumns(made).select(*(c for c in EXPORT_COLUMNS if c in kinds))


def export(discarded: DataFrame, path: str) -> int:
    """Write the export as CSV with a header or as JSON lines, by the suffix of the path; another suffix is an error. Returns the number of rows."""
    rows = export_rows(discarded)
    if path.endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".json"):
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"export to {path!r}: use .csv or .json")
    return rows.count()


def save_snapshot(table: DataFrame, folder: str) -> str:
    """Write a table to a new path below folder and return that; the path being read is never overwritten."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path


def profile_json(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def log_rows(offers: DataFrame, channel: str, status: Column, message: Column, at: Column) -> DataFrame:
    """Rows to append to the delivery log."""
    return offers.select("url_hash", F.lit(channel).alias("channel"), status.alias("status"), message.alias("message"), at.alias("created_at"))


def docx(lines: list[str]) -> bytes:
    """A minimal DOCX of paragraphs."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def deliver(messages: DataFrame, post) -> DataFrame:
    """Give each message to post(recipient, message) on the executors: rows (recipient, part, delivered, error). Errors never stop the others."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for r, p, m in zip(f["recipient"], f["part"], f["message"], strict=True):
                try:
                    post(r, m)
                    out.append((r, p, True, None))
                except Exception as e:  # noqa: BLE001  one failed delivery is a row, not the end
                    out.append((r, p, False, str(e)))
            yield pd.DataFrame(out, columns=["recipient", "part", "delivered", "error"])

    return messages.select("recipient", "part", "message").mapInPandas(run, "recipient string, part int, delivered boolean, error string")
