"""WARC archives with a two-level capture index.

`write` puts one gzip member per page into archives (one or more per task, rotated by size), as response or revisit
record, and gives the index lines. `build_index` sorts the lines by reversed-host url key into compressed blocks of
`per_block` lines and keeps one directory row per block (first and last key, file, offset, length). `find` binary-searches the
directory for url keys, which gives the blocks that may hold them, reads each of these blocks once, and then the ranges of
the archives that hold the records; the query finds all pages that way. The directory goes to the tasks in parts of at most
`max_blocks` rows, each a pass over the keys; `read_all` reads every block without keys.

Files are written by the executors to the folder given, which all must share, under names that hold the task attempt;
index lines come from successful attempts only, so repeated attempts leave files that nothing refers to.

Nulls and edge cases: null html is an empty payload; a null url has the key `-` and no target header, white space and
controls in urls are escaped in the header; a null page_id is written as `null` and read back as null, and is never
referred to; rows with the same page_id and payload that hold the largest page_id are all responses; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from bisect import bisect_right
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.shared import ranked, shared_dir, small, stage, table
from engrama.llm.urlfilter import split_url

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
LINE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ) and the rest of the url: `com,example,www)/a?b`."""
    if not url:
        return "-"
    host, _ = split_url(url)
    rest = url.split("://", 1)[1][len(host) :] if host else url
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + rest


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed."""
    name = lambda p: f"<urn:page:{'null' if p is None else int(p)}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, payload and facts of one record; a response's digest is taken from its payload and checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda k: None if (x := headers[k][10:-1]) == "null" else int(x)
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != size):
        raise ValueError(f"record {headers['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": number("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": size,
        "payload_digest": stated, "record_type": kind, "refers_to": number("WARC-Refers-To") if kind == "revisit" else None,
    }


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _task() -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.partitionId():05d}-{c.taskAttemptId()}"


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.when(F.octet_length(body) >= least, F.sha2(body, 256)).alias("_same"))
    copies = rows.where("_same IS NOT NULL").groupBy("_same").agg(F.max("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = stage(copies.withColumnRenamed("_same", "_k"), "copies")
    # rows without _same have keys of their own, so that they don't meet in one task
    own = F.coalesce("_same", F.concat_ws(":", F.lit("none"), F.col("page_id").cast("string"), F.col("digest")))
    out = rows.join(small(copies, 100_000), own == F.col("_k"), "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("_first")).alias("refers_to"))


def write(records: DataFrame, folder: str, rotate: int = 1 << 30) -> DataFrame:
    """Writes archives of about `rotate` bytes at most; gives the index lines (key, page_id, file, offset, length)."""

    def run(batches):
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        out, name, at, n = None, None, 0, 0
        for b in batches:
            lines = []
            for p, u, h, d, r in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"]):
                if out is None or at >= rotate:
                    if out is not None:
                        out.close()
                    name, at, n = f"{_task()}-{n:04d}.warc.gz", 0, n + 1
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                known = lambda x: None if x is None or pd.isna(x) else int(x)
                packed = gzip.compress(record(known(p), u if isinstance(u, str) else None, (h or "").encode() if isinstance(h, str) else b"", d, known(r)), 6, mtime=0)
                out.write(packed)
                lines.append((url_key(u if isinstance(u, str) else None), known(p), name, at, len(packed)))
                at += len(packed)
            yield pd.DataFrame({
                "key": pd.Series([x[0] for x in lines], dtype=object), "page_id": pd.Series([x[1] for x in lines], dtype="Int64"), "file": pd.Series([x[2] for x in lines], dtype=object),
                "offset": [x[3] for x in lines], "length": [x[4] for x in lines],
            })
        if out is not None:
            out.close()

    safe = records.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return stage(safe.mapInPandas(run, LINE), "warc_lines")


def build_index(lines: DataFrame, folder: str, per_block: int = 1000) -> DataFrame:
    """Sorted, compressed blocks of index lines in files; gives the sparse directory: first, last, file, offset, length."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches):
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        rest, out, at, name = [], None, 0, None

        def put(block):
            nonlocal out, at, name
            if out is None:
                name = f"{_task()}.idx"
                out = files.open_output_stream(f"{path}/{name}", compression=None)
            raw = "\n".join("\t".join((quote(k, safe="/:=&?~,;)"), p, f, str(o), str(s))) for k, p, f, o, s in block).encode()
            packed = gzip.compress(raw, 6, mtime=0)
            out.write(packed)
            row = (block[0][0], block[-1][0], name, at, len(packed))
            at += len(packed)
            return row

        for b in batches:
            ids = ["null" if pd.isna(p) else str(int(p)) for p in b["page_id"]]
            rest += list(zip(b["key"], ids, b["file"], b["offset"], b["length"]))
            rows = []
            while len(rest) >= per_block:
                rows.append(put(rest[:per_block]))
                rest = rest[per_block:]
            if rows:
                yield pd.DataFrame(rows, columns=["first", "last", "file", "offset", "length"])
        if rest:
            yield pd.DataFrame([put(rest)], columns=["first", "last", "file", "offset", "length"])
        if out is not None:
            out.close()

    safe = ordered.withColumn("page_id", F.col("page_id").cast("string"))
    return stage(safe.mapInPandas(run, "first string, last string, file string, offset long, length long"), "directory")


def _range(handle, offset: int, length: int) -> bytes:
    handle.seek(int(offset))
    return gzip.GzipFile(fileobj=io.BytesIO(handle.read(int(length)))).read()


def _block(files, path: str, name: str, offset: int, length: int) -> list[list[str]]:
    with files.open_input_file(f"{path}/{name}") as h:
        return [x.split("\t") for x in _range(h, offset, length).decode().split("\n")]


def _records(files, path: str, lines):
    """Index lines with their parsed records, each archive opened once and read in order of offsets."""
    by_file: dict[str, list] = {}
    for x in lines:
        by_file.setdefault(x[2], []).append(x)
    for name, own in sorted(by_file.items()):
        with files.open_input_file(f"{path}/{name}") as h:
            for x in sorted(own, key=lambda x: int(x[3])):
                yield x, parse(_range(h, int(x[3]), int(x[4])))


FACTS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _frame(found: list[dict], extra: list[str]) -> pd.DataFrame:
    kinds = {"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"}
    return pd.DataFrame({c: pd.Series([x[c] for x in found], dtype=kinds.get(c, object)) for c in [*FACTS, *extra]})


def read_all(directory: DataFrame, folder: str) -> DataFrame:
    """Every record through its index block: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches):
        files, path = _filesystem(folder)
        for b in batches:
            for f, o, s in zip(b["file"], b["offset"], b["length"]):
                found = []
                for _, r in _records(files, path, _block(files, path, f, o, s)):
                    found.append({k: r[k] for k in FACTS})
                yield _frame(found, [])

    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return directory.repartition(n, "file", "offset").mapInPandas(run, schema)


def _parts(directory: DataFrame, max_blocks: int):
    """The directory in key order, in lists of at most max_blocks rows."""
    n = directory.count()
    if n <= max_blocks:
        yield directory.collect()
        return
    numbered = stage(ranked(directory.withColumn("_one", F.lit(0)), "_one", ["first", "file", "offset"], "directory"), "directory")
    for k in range(-(-n // max_blocks)):
        yield numbered.where((F.col("rank") >= k * max_blocks) & (F.col("rank") < (k + 1) * max_blocks)).collect()


def find(directory: DataFrame, folder: str, keys: DataFrame, max_blocks: int = 1_000_000, payloads: bool = True) -> DataFrame:
    """The records of all url keys (column key): page_id, payload_bytes, payload_digest, record_type, refers_to, key and, if
    wanted, payload (null for revisits)."""
    extra = ["key", "payload"] if payloads else ["key"]
    spark, asked = directory.sparkSession, keys.select("key").distinct()
    places = None
    for part in _parts(directory, max_blocks):
        # firsts ascend and so do lasts, as the blocks are in key order
        rows = sorted((r["first"], r["last"], r["file"], r["offset"], r["length"]) for r in part)
        bc = spark.sparkContext.broadcast(rows)

        def search(batches, bc=bc):
            firsts = [r[0] for r in bc.value]
            for b in batches:
                out = []
                for key in b["key"]:
                    i = bisect_right(firsts, key) - 1
                    while i >= 0 and bc.value[i][1] >= key:
                        out.append((key, *bc.value[i][2:]))
                        i -= 1
                yield pd.DataFrame(out, columns=["key", "file", "offset", "length"])

        got = asked.mapInPandas(search, "key string, file string, offset long, length long")
        places = got if places is None else places.union(got)

    def read(batches):
        files, path = _filesystem(folder)
        blocks: dict[tuple, set] = {}
        for b in batches:
            for k, f, o, s in zip(b["key"], b["file"], b["offset"], b["length"]):
                blocks.setdefault((f, o, s), set()).add(k)
        for place, wanted in sorted(blocks.items()):
            lines = [x for x in _block(files, path, *place) if unquote(x[0]) in wanted]
            for i in range(0, len(lines), 200):
                found = [r | {"key": unquote(x[0])} for x, r in _records(files, path, lines[i : i + 200])]
                yield _frame(found, extra)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, key string" + ", payload binary" * payloads
    return places.repartition(n, "file", "offset").mapInPandas(read, schema)


def key_of(url: str):
    @F.pandas_udf("string")
    def run(u: pd.Series) -> pd.Series:
        return pd.Series([url_key(x) for x in u], dtype=object)

    return run(url)


def lookup(directory: DataFrame, folder: str, urls: DataFrame, max_blocks: int = 1_000_000) -> DataFrame:
    """Records of the urls (column url; null urls are skipped), found by their keys, with the url."""
    asked = stage(urls.select("url").where("url IS NOT NULL").distinct().withColumn("key", key_of("url")), "urls")
    found = find(directory, folder, asked, max_blocks)
    return found.join(asked, "key").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives and index; gives the directory."""
    return build_index(write(plan_records(pages), folder), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    directory = archive(pages, folder)
    return find(directory, folder, pages.select(key_of("url").alias("key")), payloads=False).drop("key")


OP7_SQL = """WITH a AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
  b AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest, body FROM a),
  c AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM c"""
