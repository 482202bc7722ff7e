"""WARC derivatives: metadata and plain-text conversion records built from response records.

For each response a ``metadata`` record (JSON: the response's own WARC and HTTP headers, title, metas and links) and a
``conversion`` record (plain text) are made. Both name the response in WARC-Refers-To and repeat its target URI and
date; the conversion carries the response's payload digest as WARC-Refers-To-Payload-Digest, the metadata record holds
all digests. Record ids are name-based (UUID 5), so a rerun gives the same records. Files are gzip members, one for
each record, written by the executors to the shared folder under a name of their own for each attempt; the index of
offsets is a Spark table, so only attempts that ended count.

Source headers are kept as they are, repeated ones (Set-Cookie, WARC-Concurrent-To) as lists. Text and links are read
from the content: chunked bodies are put together, gzip, deflate and zstd taken off.

Defined cases: a null page is an empty body and a null URL is the empty URI; both still give two records; pages of the
same id and URL, repeated rows among them, give records of equal ids; records that aren't HTTP responses with a header,
and contents in a coding that isn't known, give an empty text and no link; very long pages are converted whole; a
page_id that is no number is null; an empty table gives no file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, filesystem, qualified, scratch, small_batches, written
from .htmltext import ATTRIBUTE, shown_lines, tag_end

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

TITLE = re.compile(r"<title\b[^>]*(?:>|\Z)(.*?)(?:</title\s*>|\Z)", re.S | re.I)
TOLD = re.compile(r"<(a|area|link|img|script|iframe|form|source|video|audio|meta)(?=[\s/>])", re.I)
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(name))}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record: version line, named fields, block, two line ends."""
    fields = headers | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


Fields = dict[str, str | list[str]]


def header_lines(lines: bytes) -> tuple[str, Fields]:
    """The first line and the named fields, continuation lines joined. A name that is repeated, in any case of letters, has the list of its values in order."""
    first, _, rest = lines.decode("utf-8", "replace").partition("\r\n")
    rows: list[list[str]] = []
    for line in rest.split("\r\n"):
        if line[:1] in (" ", "\t") and rows:
            rows[-1][1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            rows.append([name.strip(), value.strip()])
    found: dict[str, tuple[str, list[str]]] = {}
    for name, value in rows:
        found.setdefault(name.lower(), (name, []))[1].append(value)
    return first, {name: values[0] if len(values) == 1 else values for name, values in found.values()}


def field(fields: Fields, name: str, default: str = "") -> str:
    """The (first) value of a field, whatever the case of its name."""
    value = next((v for k, v in fields.items() if k.lower() == name.lower()), default)
    return value if isinstance(value, str) else value[0]


def parse(data: bytes) -> tuple[Fields, bytes]:
    """(named fields, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, fields = header_lines(head)
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return fields, rest[: int(field(fields, "Content-Length"))]


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body, as far as it is well formed."""
    out, at = [], 0
    while m := CHUNK.match(body, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            break
        out.append(body[at : at + size])
        at += size + 2
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes:
    """The body without one content coding; what can be read of one that is cut off. One that isn't known gives nothing."""
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            d = zlib.decompressobj(bits)
            try:
                out = d.decompress(body)
                while d.unused_data and bits == 47:  # further members
                    rest, d = d.unused_data, zlib.decompressobj(bits)
                    out += d.decompress(rest)
                return out
            except zlib.error:
                continue
        return b""
    if coding == "zstd":
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError:
            return b""
    return body if coding in ("", "identity") else b""


def entity(body: bytes, http: Fields) -> bytes:
    """The content of a response's body, without transfer and content codings."""
    codings = lambda name: [c.strip().lower() for v in [next((v for k, v in http.items() if k.lower() == name), "")] for x in ([v] if isinstance(v, str) else v) for c in x.split(",")]
    for coding in reversed(codings("transfer-encoding")):
        body = unchunked(body) if coding == "chunked" else inflated(body, coding)
    for coding in reversed(codings("content-encoding")):
        body = inflated(body, coding)
    return body


def response(key: str, url: str, page: str, date: str = DATE) -> bytes:
    body = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", key, url), "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url), "WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response"}
    return record(headers, block)


def attributes(text: str) -> dict[str, str]:
    """Attributes by name; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def told(page: str) -> list[tuple[str, dict[str, str]]]:
    """(element, attributes) of each tag that links or holds metadata, in one pass."""
    out, at, dead = [], 0, set()
    while m := TOLD.search(page, at):
        at = tag_end(page, m.end(), dead)
        if at < 0:
            break
        out.append((m[1].lower(), attributes(page[m.end() : at - 1])))
    return out


#: The attribute that links, by element.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src", "video": "src", "audio": "src"}


def links(found: list[tuple[str, dict[str, str]]]) -> list[dict[str, str]]:
    return [{"path": f"{name.upper()}@/{LINKS[name]}", "url": got[LINKS[name]]} | {k: got[k] for k in ("rel", "alt", "title") if k in got} for name, got in found if LINKS.get(name) in got]


def plain_text(page: str) -> str:
    """All text outside of elements that never show any, a line for each block, white space inside a line made one space."""
    return "\n".join(shown_lines(page))


def derive(data: bytes) -> tuple[bytes, bytes]:
    """(metadata record, conversion record) of one response record."""
    source, block = parse(data)
    head, sep, body = block.partition(b"\r\n\r\n")
    status, http = header_lines(head) if sep and head.startswith(b"HTTP/") else ("", {})
    kind = field(http, "Content-Type")
    content = entity(body, http) if status else b""
    charset = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    try:
        page = content.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = content.decode("utf-8", "replace")
    title, tags = TITLE.search(page), told(page)
    envelope = {
        "Container": {"Compressed": True},
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Metadata": source,
            "Payload-Metadata": {
                "Actual-Content-Type": kind,
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": http,
                    "Entity-Length": len(body),
                    "Entity-Digest": digest(body),
                    "HTML-Metadata": {"Head": {"Title": " ".join(html.unescape(title[1]).split()) if title else "", "Metas": [got for name, got in tags if name == "meta"]}, "Links": links(tags)},
                },
            },
        },
    }
    name = field(source, "WARC-Record-ID")
    same = {"WARC-Date": field(source, "WARC-Date"), "WARC-Target-URI": field(source, "WARC-Target-URI"), "WARC-Refers-To": name}
    meta = record({"WARC-Type": "metadata", "WARC-Record-ID": record_id("metadata", name)} | same | {"Content-Type": "application/json"}, json.dumps(envelope, ensure_ascii=False).encode())
    text = record({"WARC-Type": "conversion", "WARC-Record-ID": record_id("conversion", name)} | same | {"WARC-Refers-To-Payload-Digest": field(source, "WARC-Payload-Digest", digest(body)), "Content-Type": "text/plain"}, plain_text(page).encode())
    return meta, text


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, record): each page as a response record."""
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])

    def build(batches):
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            yield batch_of(schema, b.column(0), [response("" if k is None else str(k), u or "", p or "") for k, u, p in rows])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), page).mapInArrow(build, "page_id long, record binary")


INDEX = "page_id long, file string, at long, meta_size long, text_size long"


def write_derivatives(records: DataFrame, path: str) -> DataFrame:
    """Write both derivatives of each record under ``path``; returns the index: page_id, file, at, meta_size, text_size."""
    path = qualified(records.sparkSession, path)
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("meta_size", pa.int64()), ("text_size", pa.int64())])

    def write(batches):
        out, at, name = None, 0, ""
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = filesystem(path)[0].open_output_stream(f"{folder}/{name}", compression=None)
                meta, text = (gzip.compress(x, 6, mtime=0) for x in derive(data))
                out.write(meta)
                out.write(text)
                rows.append((key, name, at, len(meta), len(text)))
                at += len(meta) + len(text)
            yield batch_of(schema, *(list(zip(*rows)) or [[]] * 5))
        if out is not None:
            out.close()

    return written(records.mapInArrow(write, INDEX), "warc-index")


def read_derivatives(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(page_id, metadata, conversion): both records of each indexed page, as bytes without compression."""
    path = qualified(spark, path)
    _, folder = filesystem(path)
    schema = pa.schema([("page_id", pa.int64()), ("metadata", pa.binary()), ("conversion", pa.binary())])

    def read(batches):
        fs, name, src = filesystem(path)[0], None, None
        for b in batches:
            rows = []
            for key, file, at, meta, text in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    name, src = file, fs.open_input_file(f"{folder}/{file}")
                src.seek(at)
                data = src.read(meta + text)
                rows.append((key, gzip.decompress(data[:meta]), gzip.decompress(data[meta:])))
            yield batch_of(schema, *(list(zip(*rows)) or [[]] * 3))

    return index.mapInArrow(read, "page_id long, metadata binary, conversion binary")


OUT = "page_id long, url string, response_id string, response_digest string, metadata_id string, metadata_refers_to string, metadata_digest string, n_links long, title string, conversion_id string, conversion_refers_to string, conversion_digest string, n_chars long"


def describe(derived: DataFrame) -> DataFrame:
    """One row for each page, read from its two records."""
    names = [x.split(" ") for x in OUT.split(", ")]
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in names])

    def tell(batches):
        for b in batches:
            rows = []
            for key, meta, text in zip(*(c.to_pylist() for c in b.columns)):
                m, block = parse(meta)
                c, body = parse(text)
                envelope = json.loads(block)["Envelope"]
                source, found = envelope["WARC-Header-Metadata"], envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
                rows.append((key, m["WARC-Target-URI"], source["WARC-Record-ID"], source["WARC-Payload-Digest"], m["WARC-Record-ID"], m["WARC-Refers-To"], m["WARC-Block-Digest"], len(found["Links"]), found["Head"]["Title"], c["WARC-Record-ID"], c["WARC-Refers-To"], c["WARC-Block-Digest"], len(body.decode())))
            yield batch_of(schema, *(list(zip(*rows)) or [[]] * len(names)))

    return derived.mapInArrow(tell, OUT)


def round_trip(pages: DataFrame) -> DataFrame:
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "warc")
    return describe(read_derivatives(spark, path, write_derivatives(responses(pages), path)))
