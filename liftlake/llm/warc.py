"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both name the response in WARC-Refers-To and keep its target, date and payload
digest; the metadata block is JSON with the source's WARC and HTTP headers, title
and links, and names the conversion record. Record ids follow from the response's,
so a repeated run gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import textnum

# Record names of the WARC format, elements without visible text, elements that end a line.
VERSION = "WARC/1.0"
_HIDDEN = "script|style|noscript|template|head"
_BLOCK = ("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav "
          "ol option p pre section table td th title tr ul").split()

_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][a-zA-Z0-9]*)[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
                     re.S | re.I)
# A tag that is not closed ends at the next one, so that no text is read again from each of its tags on.
_TITLE = re.compile(r"<title\b[^<>]*+>(.*?)(?:</title\s*+>|\Z)", re.S | re.I)
_ANCHOR = re.compile(r"<a\b((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_SPACES = re.compile(r"[ \t\r\f\v]+")

RECORD = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, date string, " \
         "content_type string, content_length bigint, block_digest string, source_digest string, headers string, block string"


def digest(data: bytes) -> str:
    """Labelled digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """Visible text of an HTML page, one line per block element."""
    flat = _MARKUP.sub(lambda m: "\n" if m[2] and m[2].lower() in _BLOCK else " " if m[1] or not m[2] else "", page)
    lines = (_SPACES.sub(" ", x).strip() for x in html.unescape(flat).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str) -> list[str]:
    """Targets of the page's anchors, in order; empty ones are left out."""
    found = (_HREF.search(m[1]) for m in _ANCHOR.finditer(page))
    return [html.unescape(m[1] or m[2] or m[3]) for m in found if m and (m[1] or m[2] or m[3])]


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def header_lines(fields: list[tuple[str, str]]) -> str:
    return VERSION + "\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)


def parse_headers(text: str) -> list[list[str]]:
    """Header fields in order, as written; a folded line continues the one before."""
    out: list[list[str]] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1][1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append([name.strip(), value.strip()])
    return out


def derived(page_id, response_id: str, uri: str, date: str, warc_headers: str, http: str, payload: str) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    source = digest(payload.encode("utf-8", "surrogatepass"))
    text = plain_text(payload)
    title = _TITLE.search(payload)
    ids = {kind: record_id(response_id, kind) for kind in ("metadata", "conversion")}
    status, _, http_rest = http.partition("\n")
    described = {
        "source": {"record_id": response_id, "warc_headers": parse_headers(warc_headers), "payload_digest": source},
        "http": {"status_line": status.strip(), "headers": parse_headers(http_rest)},
        "html": {"title": " ".join(html.unescape(title[1]).split()) if title else None,
                 "links": links(payload)},
        "conversion_record": ids["conversion"], "characters": len(text),
    }
    out = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps(described, ensure_ascii=False)), ("conversion", "text/plain", text)):
        data = block.encode("utf-8", "surrogatepass")
        fields = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri),
                  ("WARC-Refers-To", response_id), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", digest(data)),
                  ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        out.append((page_id, kind, ids[kind], response_id, uri, date, content_type, len(data), digest(data), source, header_lines(fields), block))
    return out


def serialised(headers: str, block: str) -> bytes:
    """One record as it stands in a WARC file."""
    return headers.encode("utf-8", "surrogatepass") + b"\r\n" + block.encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def derive(responses: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", record_col: str | None = None,
           date_col: str | None = None, warc_col: str | None = None, http_col: str | None = None,
           date: str = "1970-01-01T00:00:00Z", http: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8") -> DataFrame:
    """Two rows per response, see ``RECORD``; ``headers`` and ``block`` make the record's bytes.

    Columns that are not named take the constants; a response without record id
    gets one that follows from its id, URI and payload. Null URI, headers and
    payload count as empty; a null page id stays null. Equal rows give equal
    records as often as they come. An empty table gives none.
    """

    def text(name, default):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name else F.lit(default)

    picked = responses.select(
        F.col(id_col).cast("bigint").alias("page_id"), text(payload_col, "").alias("payload"), text(uri_col, "").alias("uri"),
        (F.col(record_col).cast("string") if record_col else F.lit(None).cast("string")).alias("record_id"),
        text(date_col, date).alias("date"), text(warc_col, "").alias("warc"), text(http_col, http).alias("http"))

    def run(batches):
        for batch in textnum.parts(batches):
            rows = []
            for r in batch.to_pylist():
                source = digest(r["payload"].encode("utf-8", "surrogatepass"))
                response = r["record_id"] or record_id(str(r["page_id"]), r["uri"], source)
                own = r["warc"] or header_lines([("WARC-Type", "response"), ("WARC-Record-ID", response), ("WARC-Date", r["date"]),
                                                 ("WARC-Target-URI", r["uri"]), ("WARC-Payload-Digest", source)]).partition("\r\n")[2]
                rows += derived(r["page_id"], response, r["uri"], r["date"], own, r["http"], r["payload"])
            cols = list(zip(*rows))
            names = [x.split()[0] for x in RECORD.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if n in ("page_id", "content_length") else pa.string()) for n, c in zip(names, cols)], names)

    return picked.mapInArrow(run, RECORD)
