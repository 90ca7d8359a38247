"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A record is a row ``(record_id, type, headers, block)``: the WARC named fields as a map and the block
as bytes. ``derive`` turns every response record into

* a *metadata* record (``application/warc-fields``): HTTP status and content type, the response's HTTP
  headers under ``source-``, title, charset and outlinks;
* a *conversion* record (``text/plain; charset=utf-8``): the visible text.

Both carry ``WARC-Refers-To`` with the response's WARC-Record-ID, its target URI and date,
``WARC-Source-Payload-Digest`` and ``WARC-Source-Block-Digest`` with the response's digests, and a block
digest of their own; their ids are made from the response's id, so a rebuilt record has the same id.
``write_records`` stores records as WARC/1.1 files, one gzip member per record, under the folder all
executors share, each part moved into place when it is whole; ``read_records`` parses them back.

Missing and odd input: a null or empty body gives both records, with empty text; a response without
HTTP header block is taken as body only; a body that is not UTF-8 is decoded by its charset if known,
else with replacement characters; null header values are left out, a line break within a value is written as
a blank; markup that is never closed is text, and costs no more time than other text; repeated responses give equal
records, once each; records of other types are skipped; empty tables give empty results. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.tokenids import Folder
from bandwise.session import checkpoint_dir, cut_lineage

RECORD = "record_id string, type string, headers map<string,string>, block binary"
_NAMES = ["record_id", "type", "headers", "block"]

_GONE = ("script", "style", "template", "noscript")
_OPEN = re.compile(r"<(?:(script|style|template|noscript)\b|!--|!\[CDATA\[)", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|article|section|nav|header|footer|main|aside|blockquote|pre|body|html|title)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_LINK = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_VALUE = re.compile(r"\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_BREAKS = re.compile(r"[\r\n]+[ \t]*")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(p or '' for p in parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and body of an HTTP response; no header block: all is body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        head, _, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and fields:  # a folded field goes on
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0], fields, body


def decode_body(body: bytes, content_type: str) -> tuple[str, str]:
    m = _CHARSET.search(content_type) or _CHARSET.search(body[:2048].decode("latin-1"))
    for name in ([m.group(1)] if m else []) + ["utf-8"]:
        try:
            return body.decode(name), name.lower()
        except (LookupError, UnicodeDecodeError):
            pass
    return body.decode("utf-8", "replace"), "utf-8"


def _start_and_end(name: str) -> tuple[re.Pattern, re.Pattern]:
    return re.compile(rf"<{name}\b", re.I), re.compile(rf"</{name}\s*>", re.I)


_ENDS = {name: _start_and_end(name)[1] for name in _GONE}
_HEAD, _TITLE = _start_and_end("head"), _start_and_end("title")


def without_scripts(page: str) -> str:
    """The page without scripts, styles, templates, comments and CDATA, from left to right.

    What is never closed stays, and is looked for once: the time is linear in the page.
    """
    out, kept, open_ = [], 0, set()
    for m in _OPEN.finditer(page):
        if m.start() < kept:
            continue
        name = (m.group(1) or m.group(0)).lower()
        if name in open_:
            continue
        if m.group(1):
            tag = page.find(">", m.end())
            end = _ENDS[name].search(page, tag + 1) if tag >= 0 else None
            at = end.end() if end else -1
        else:
            close = "-->" if name == "<!--" else "]]>"
            at = page.find(close, m.end())
            at = at + 3 if at >= 0 else -1
        if at < 0:
            open_.add(name)
            continue
        out.append(page[kept:m.start()])
        kept = at
    return "".join(out) + page[kept:]


def _element(page: str, kind: tuple[re.Pattern, re.Pattern]) -> tuple[int, int, int, int] | None:
    """Start, start and end of the content, and end of the first element of a kind; None if none is closed."""
    start = kind[0].search(page)
    tag = page.find(">", start.end()) if start else -1
    end = kind[1].search(page, tag + 1) if tag >= 0 else None
    return (start.start(), tag + 1, end.start(), end.end()) if end else None


def _replaced(tags: re.Pattern, by: str, page: str) -> str:
    """``tags.sub`` up to the last ``>``, behind which no tag ends: no scan can fail, so none is repeated."""
    cut = page.rfind(">") + 1
    return tags.sub(by, page[:cut]) + page[cut:]


def visible_text(page: str) -> str:
    """Text of a page ``without_scripts``: no markup, one line per block, blanks collapsed."""
    head = _element(page, _HEAD)
    if head:
        page = page[:head[0]] + " " + page[head[3]:]
    page = _replaced(_TAG, "", _replaced(_BREAK, "\n", page.replace("\n", " ")))
    lines = (" ".join(line.split()) for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def page_facts(page: str) -> tuple[str, list[str]]:
    """Title and outlinks (the first href of every link tag) of a page ``without_scripts``."""
    title = _element(page, _TITLE)
    links, at, end = [], 0, -1
    while m := _LINK.search(page, at):
        if end < m.end():
            end = page.find(">", m.end())
            end = len(page) if end < 0 else end
        href = _HREF.search(page, m.end(), end)
        value = _VALUE.match(page, href.end()) if href else None
        if value:
            links.append("".join(html.unescape("".join(g or "" for g in value.groups())).split()))
        at = value.end() if value else end
    return " ".join(html.unescape(page[title[1]:title[2]]).split()) if title else "", links


def derivatives(record_id: str, headers: dict[str, str], block: bytes) -> Iterator[tuple[str, str, dict, bytes]]:
    """The metadata and the conversion record of one response."""
    status, fields, body = split_http(block)
    kind = next((v for n, v in fields if n.lower() == "content-type"), "")
    page, charset = decode_body(body, kind)
    page = without_scripts(page)
    title, links = page_facts(page)
    code = status.split(" ")[1] if status.count(" ") else ""
    lines = [("http-status", code), ("content-type", kind), ("charset", charset), ("title", title)]
    lines += [("source-" + n, v) for n, v in fields] + [("outlink", u) for u in links]
    meta = "".join(f"{n}: {v}\r\n" for n, v in lines).encode()
    text = visible_text(page).encode()
    shared = {k: headers[k] for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address") if headers.get(k) is not None}
    shared["WARC-Refers-To"] = record_id
    shared["WARC-Source-Payload-Digest"] = headers.get("WARC-Payload-Digest") or digest(body)
    shared["WARC-Source-Block-Digest"] = headers.get("WARC-Block-Digest") or digest(block)
    for name, mime, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = urn(record_id, name)
        yield own, name, shared | {"WARC-Type": name, "WARC-Record-ID": own, "Content-Type": mime, "Content-Length": str(len(data)), "WARC-Block-Digest": digest(data)}, data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, kinds, headers, blocks = zip(*rows)
    maps = pa.array([list(h.items()) for h in headers], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string()), maps, pa.array(blocks, pa.binary())], _NAMES)


def _packed(rows: Iterator[tuple], least: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[3]) + 512
        if held >= least:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for rid, kind, h, block in zip(*(b.column(n) for n in _NAMES)):
            yield rid.as_py(), kind.as_py(), {k: v for k, v in (h.as_py() or []) if v is not None}, block.as_py() or b""


def _responses(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for pid, url, page in zip(*(b.column(n) for n in ("page_id", "url", "html"))):
                pid, url, body = pid.as_py(), url.as_py(), (page.as_py() or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\nX-Page-Id: %s\r\n\r\n" % (
                    len(body), str("" if pid is None else pid).encode()) + body
                rid = urn("page", None if pid is None else str(pid), url, digest(body))
                h = {"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
                     "Content-Length": str(len(block)), "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(body)}
                yield rid, "response", h | ({} if url is None else {"WARC-Target-URI": url}), block
    return _packed(rows())


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages(page_id, url, html)``, as a crawler would have stored them."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(partial(_responses, date=date), RECORD)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed(d for rid, kind, h, block in _rows(batches) if kind == "response" for d in derivatives(rid, h, block))


def derive(records: DataFrame) -> DataFrame:
    """Two linked records for every response of ``records``; row by row, without a shuffle."""
    return records.select(*_NAMES).mapInArrow(_derive, RECORD)


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A record as bytes; a line break in a header (with the blanks behind it) becomes one blank."""
    first = ("WARC-Type", "WARC-Record-ID")
    names = [n for n in first if n in headers] + sorted(n for n in headers if n not in first)
    one = lambda v: _BREAKS.sub(" ", v)
    head = "WARC/1.1\r\n" + "".join(f"{one(n)}: {one(headers[n])}\r\n" for n in names) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; a folded line goes on with its field, a line without a colon is skipped."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            fields[name] = value[1:] if value[:1] == " " else value
    length = fields.get("Content-Length", "").strip()
    return fields, rest[: int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    name, out, n = f"{task.partitionId():06d}.warc.gz", Folder(folder), 0
    trial = f"{name}.{task.taskAttemptId()}"
    with out.create(trial) as f:
        for _, _, h, block in _rows(batches):
            f.write(gzip.compress(serialise(h, block), 4, mtime=0))
            n += 1
    out.move(trial, name)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])


def write_records(records: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write one file per partition; returns the folder and the manifest ``(file, records)``."""
    folder = folder or f"{checkpoint_dir(records.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return folder, cut_lineage(records.select(*_NAMES).mapInArrow(partial(_write, folder=folder), "file string, records long"))


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    src = Folder(folder)

    def rows():
        for b in batches:
            for name in b.column("file").to_pylist():
                for data in _members(src, name):
                    h, block = parse(data)
                    yield h.get("WARC-Record-ID"), h.get("WARC-Type"), h, block
    return _packed(rows())


def _members(src: Folder, name: str) -> Iterator[bytes]:
    """The gzip members of a file, read in pieces of 1 MB."""
    with src.open(name) as f:
        z, parts, rest = zlib.decompressobj(31), [], b""
        while rest or (rest := f.read(1 << 20)):
            parts.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []


def read_records(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of all files of the manifest, one task per file."""
    files = manifest.select("file")
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(partial(_read, folder=folder), RECORD)


def derivative_digest(pages: DataFrame) -> DataFrame:
    """Build, write and read back the derivatives of all pages; one row per derivative record."""
    folder, manifest = write_records(derive(responses(pages)))
    h = lambda name: F.col("headers")[name]
    page = F.regexp_extract(F.col("block").cast("string"), r"(?m)^source-X-Page-Id: (-?\d+)\r?$", 1)
    return read_records(folder, manifest).select(
        "record_id", "type", h("WARC-Refers-To").alias("refers_to"), h("WARC-Target-URI").alias("target_uri"), h("WARC-Date").alias("date"),
        h("WARC-Source-Payload-Digest").alias("source_digest"), h("WARC-Block-Digest").alias("block_digest"),
        F.when(F.col("type") == "metadata", page.try_cast("long")).alias("page_id"),
        F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))
