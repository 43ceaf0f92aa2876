"""WARC derivatives: metadata and plain-text conversion records of response records.

``read_warc`` and ``write_warc`` read and write WARC files, ``responses``
wraps pages as response records, ``derive`` makes of each response one metadata
record and, if its payload is text, one conversion record. Both name the response
in WARC-Refers-To and keep its target URI, date and payload digest; the metadata
record keeps its HTTP status and headers, its title and its links. Record ids are
UUIDs derived from the response's id and the kind of record, so a rerun gives the
same ids. Digests are SHA-256 in hexadecimal.

Records are rows: record_id, warc_type, target_uri, date, content_type, refers_to,
payload_digest, block_digest, content_length, fields (other header lines), block (bytes).

Text: the payload is freed from chunks and from gzip or deflate, then read in the
character set that its byte order mark, its HTTP header or its meta element names, else
as UTF-8 and, where that fails, as Windows-1252. Of HTML it is one line a block element, white
space folded, all character references decoded, without comments, scripts and styles.
Links are the href of a elements, in any quotes or none.

Files are read one by one: a block ends where Content-Length says, whatever it holds. They may be
compressed as a whole or a member a record, which is what ``write_warc`` writes. A file is one value
of Spark's, of less than 2 GB.

Edge cases: null html is an empty payload and gives an empty conversion record;
a null URL gives no WARC-Target-URI. A response without a blank line after its
HTTP header is header only. Payloads that aren't text, and those whose compression is
unknown or damaged, give no conversion record. An unclosed script, style or comment runs
to the end of the page; unclosed noscript and template elements are ignored as tags. What is no character reference stays.
Repeated rows give repeated records. Extra
columns are ignored, but for page_id, which is carried along. Records other than
responses are skipped by ``derive``. An empty table gives an empty result. A file that breaks off
within a record gives the records before it.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

CRLF = "\r\n"
VERSION = "WARC/1.0"
# Elements that end a line of text, elements without text, and the header fields of a record.
LINES = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
SILENT = ("script", "style", "noscript", "template")
FIELDS = {
    "WARC-Type": "warc_type",
    "WARC-Record-ID": "record_id",
    "WARC-Date": "date",
    "WARC-Target-URI": "target_uri",
    "WARC-Refers-To": "refers_to",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Block-Digest": "block_digest",
    "Content-Type": "content_type",
    "Content-Length": "content_length",
}
RECORD = {
    "record_id": pa.string(), "warc_type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "content_type": pa.string(), "refers_to": pa.string(),
    "payload_digest": pa.string(), "block_digest": pa.string(), "content_length": pa.int64(), "fields": pa.string(), "block": pa.binary(),
}
MEMBER = (1 << 24) - 1  # bytes of a gzip member

_REST = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]){_REST}.*?(?:</\1\s*>|\Z)|<(noscript|template)(?=[\s/>]){_REST}.*?</\2\s*>", re.S | re.I)
_LINE = re.compile(rf"</?(?:{LINES})(?=[\s/>]){_REST}", re.I)
_TAG = re.compile(rf"<[a-zA-Z/!?]{_REST}|<[a-zA-Z/!?][^>]*>")
_FOLD = re.compile(r"[ \t\r\n\f]+")
_SPACES = re.compile(r"&(?:nbsp|#160|#[xX]0*[aA]0);")
_BREAKS = re.compile(r" *\n[ \n]*")
_TITLE = re.compile(rf"<title(?=[\s/>]){_REST}(.*?)</title\s*>", re.S | re.I)
_HREF = re.compile(r"""<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(s: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(s.cast("binary"), 256))


def responses(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.col("url").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    out = pages.select("page_id", uri.alias("target_uri"), payload.alias("payload"), F.concat(head, payload).alias("block"))
    return out.select(
        "page_id",
        _uuid(F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri")).alias("record_id"),
        F.lit("response").alias("warc_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.lit(None).cast("string").alias("refers_to"),
        _digest(F.col("payload")).alias("payload_digest"),
        _digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        F.lit("").alias("fields"),
        F.col("block").cast("binary").alias("block"),
    )


def plain_text(page: str) -> str:
    """Text of a page: one line per block, white space folded, references decoded."""
    t = _FOLD.sub(" ", _HIDDEN.sub("", page))
    t = _TAG.sub("", _LINE.sub("\n", t))
    if "&" in t:
        t = html.unescape(_SPACES.sub(" ", t))
    return _BREAKS.sub("\n", t).strip(" \n")


def links(page: str) -> list[str]:
    found = (a or b or c for a, b, c in _HREF.findall(_HIDDEN.sub("", page)))
    return [html.unescape(_FOLD.sub(" ", u)).strip() for u in found]


def _header(head: bytes) -> tuple[str, list[str], dict[str, str]]:
    """Status, header lines and their values by lower-case name, of the head of an HTTP response."""
    lines = head.decode("utf-8", "replace").split(CRLF)
    status = re.match(r"HTTP/[0-9.]+ ([0-9]+)", lines[0])
    values = {}
    for x in lines[1:]:
        name, _, value = x.partition(":")
        values.setdefault(name.strip().lower(), value.strip())
    return status[1] if status else "", lines[1:], values


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = re.match(rb"\s*([0-9a-fA-F]+)", data[at:end])
        n = int(size[1], 16) if size else 0
        if not n:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def _content(payload: bytes, headers: dict[str, str]) -> bytes | None:
    """The payload without its transfer and content encodings; null if they can't be undone."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    for coding in reversed([c.strip().lower() for c in headers.get("content-encoding", "").split(",") if c.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif coding == "deflate":
                payload = zlib.decompress(payload, -15 if payload[:1] and payload[0] & 15 != 8 else 15)
            elif coding != "identity":
                return None
        except (OSError, EOFError, zlib.error):
            return None
    return payload


def _decoded(data: bytes, content_type: str) -> str:
    for mark, name in _MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    meta = None if named else _META.search(data[:4096])
    for name in (named[1] if named else "", meta[1].decode("ascii", "replace") if meta else "", "utf-8", "cp1252"):
        try:
            return data.decode("cp1252" if name.lower() in ("iso-8859-1", "latin1", "latin-1") else name)
        except (LookupError, ValueError):
            continue
    return data.decode("utf-8", "replace")


def _named(*parts: str) -> str:
    h = hashlib.md5("|".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def derivatives(record_id: str | None, block: bytes | None) -> tuple[str, list[tuple[str, str, bytes]]]:
    """The SHA-256 digest of a response's payload, and (type, content type, block) of the records made of it."""
    head, _, payload = (block or b"").partition(b"\r\n\r\n")
    status, lines, headers = _header(head)
    kind = headers.get("content-type", "")
    media = kind.partition(";")[0].strip().lower()
    content = _content(payload, headers) if media.startswith("text/") or media == "application/xhtml+xml" else None
    page, text, title, out_links = "", None, "", []
    if content is not None:
        page = text = _decoded(content, kind)
        if media in ("text/html", "application/xhtml+xml"):
            found = _TITLE.search(page)
            title, out_links, text = plain_text(found[1]).replace("\n", " ") if found else "", links(page), plain_text(page)
    meta = [f"http-status: {status}", *(f"http-header-{x}" for x in lines), f"title: {title}", *(f"outlink: {u}" for u in out_links)]
    out = [("metadata", "application/warc-fields", (CRLF.join(meta) + CRLF).encode())]
    if text is not None:
        out.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    return f"sha256:{hashlib.sha256(payload).hexdigest()}", out


def _derive(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows = []
                for i, (ident, uri, date, digest, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "payload_digest", "block")), strict=True)):
                    own, made = derivatives(ident, block)
                    rows += [(i, _named(kind, ident or ""), kind, uri, date, content_type, ident, digest or own, f"sha256:{hashlib.sha256(b).hexdigest()}", len(b), "", b) for kind, content_type, b in made]
                columns = list(zip(*rows, strict=True)) or [()] * (len(RECORD) + 1)
                of = pa.array(columns[0], pa.int64())
                values = [pa.array(c, t) for c, t in zip(columns[1:], RECORD.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in carried), *values], [*carried, *RECORD])

    return run


def _ddl() -> str:
    return ", ".join(f"{c} {'binary' if t == pa.binary() else 'long' if t == pa.int64() else 'string'}" for c, t in RECORD.items())


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the response records among records."""
    tune(records.sparkSession)
    carried = [c for c in ("page_id",) if c in records.columns]
    rows = records.where(F.col("warc_type") == "response").select(*carried, "record_id", "target_uri", "date", "payload_digest", F.col("block").cast("binary").alias("block"))
    return rows.mapInArrow(_derive(carried), "".join(f"{c} {records.schema[c].dataType.simpleString()}, " for c in carried) + _ddl())


def serialized(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    block = record["block"] or b""
    values = {**record, "content_length": len(block)}
    lines = "".join(f"{name}: {values[c]}{CRLF}" for name, c in FIELDS.items() if values[c] is not None)
    return f"{VERSION}{CRLF}{lines}{record['fields'] or ''}{CRLF}".encode() + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member for each record, without the last byte.

    That is the highest of the four that tell the size, and so 0 in members below 2 ** 24 bytes: the text
    writer's line separator puts it back. Longer records are several members.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            out = []
            for record in whole.slice(at, 200).to_pylist():
                data = serialized(record)
                out += [gzip.compress(data[i : i + MEMBER], mtime=0)[:-1] for i in range(0, len(data), MEMBER)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            yield pa.RecordBatch.from_arrays([pa.array([serialized(r)[:-2] for r in whole.slice(at, 200).to_pylist()], pa.binary())], ["value"])


def write_warc(records: DataFrame, path: str, *, compression: str = "gzip") -> None:
    """Write records as WARC files in a folder, with gzip (a member a record) or none."""
    tune(records.sparkSession)
    rows = records.select(*(F.col(c).cast("binary").alias(c) if c == "block" else F.col(c) for c in RECORD))
    data = rows.mapInArrow(_members if compression == "gzip" else _plain, "value binary")
    # the writer puts the bytes of a value into the file as they are
    data.select(F.col("value").cast("string")).write.option("lineSep", "\0" if compression == "gzip" else CRLF).option("compression", "none").text(path)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, compressed or not."""
    stream = gzip.GzipFile(fileobj=BytesIO(data)) if data[:2] == b"\x1f\x8b" else BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            found, others = dict.fromkeys(RECORD), []
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                name, _, value = text.partition(":")
                known = next((c for f, c in FIELDS.items() if f.lower() == name.strip().lower()), None)
                if known:
                    found[known] = value.strip()
                else:
                    others.append(text + CRLF)
            length = found["content_length"] or ""
            found |= {"content_length": int(length) if length.isdigit() else 0, "fields": "".join(others)}
            found["block"] = stream.read(found["content_length"])
            if len(found["block"]) < found["content_length"]:
                return
            yield found
    except (EOFError, OSError, zlib.error):
        return


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in RECORD.items()], list(RECORD))

    for files in batches:
        for data in files.column(0):
            rows, size = [], 0
            for record in parsed(data.as_py()):
                rows.append(record)
                size += record["content_length"]
                if size >= 8 << 20 or len(rows) >= 1000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files of a folder."""
    tune(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, _ddl())


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(responses(table(spark, sf_dir, "pages")))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length")


# The SQL decodes the references that the given pages hold.
_SQL_REFERENCES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "copy": "©", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "amp": "&"}


def _sql_text(html: str) -> str:
    t = rf"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in SILENT:
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    t = rf"regexp_replace({t}, '[ \t\r\n\f]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{LINES})\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for name, value in _SQL_REFERENCES.items():
        quoted = value.replace("'", "''")
        t = f"replace({t}, '&{name};', '{quoted}')"
    return rf"regexp_replace(regexp_replace({t}, ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def _sql_uuid(s: str) -> str:
    return f"'<urn:uuid:' || regexp_replace(md5({s}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'"


OP7_SQL = rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT page_id, url, html, nl, {_sql_uuid("'response|' || coalesce(page_id::varchar, '') || '|' || coalesce(url, '')")} AS rid, 'sha256:' || sha256(html) AS pd,
  'http-status: 200' || nl || 'http-header-Content-Type: text/html; charset=utf-8' || nl || 'http-header-Content-Length: ' || octet_length(encode(html)) || nl AS head,
  {_sql_text(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")} AS title,
  array_to_string(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"\r\n]*)"', 1), lambda u: 'outlink: ' || u || nl), '') AS links FROM p),
m AS (SELECT page_id, url, rid, pd, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, head || 'title: ' || title || nl || links AS block FROM r
  UNION ALL SELECT page_id, url, rid, pd, 'conversion', 'text/plain; charset=utf-8', {_sql_text("html")} FROM r)
SELECT page_id, warc_type, {_sql_uuid("warc_type || '|' || rid")} AS record_id, rid AS refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS date, content_type,
  pd AS payload_digest, 'sha256:' || sha256(block) AS block_digest, octet_length(encode(block)) AS content_length FROM m
"""
