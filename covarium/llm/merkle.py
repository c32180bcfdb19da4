"""WARC fixity audit with Merkle trees over offset ranges.

Each record is hashed.  Records that start in the same range of RANGE_BYTES of an
archive, in order of offset, make a leaf; FANOUT neighbouring nodes make a node
of the next level, up to one root for each archive.  Roots of two replicas are
compared first; only below roots that differ are children compared, level by
level, and records only in leaves that differ.  A group never holds more than a
range's records or FANOUT nodes, so no task gathers an archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.llm.base import materialise

RANGE_BYTES = 1 << 16
FANOUT = 16
PAGES_AN_ARCHIVE = 1000


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record; nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def index(pages: DataFrame, pages_an_archive: int = PAGES_AN_ARCHIVE) -> DataFrame:
    """(archive, offset, length, page_id, sha256) of the records that ``pages`` make, in order of page_id.

    Pages without an id go to archives of their own, dealt by content; equal rows get
    offsets of their own.  Only lengths and hashes are shuffled, not records.
    """
    text = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    archive = F.coalesce(F.floor(F.col("page_id") / pages_an_archive).cast("long"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1024)))
    rows = pages.select(archive.alias("archive"), "page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("sha256"))
    before = W.partitionBy("archive").orderBy("page_id", "sha256").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "page_id", "sha256")


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, node, hash) of level 0."""
    line = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("sha256"))
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", line.alias("line")))), lambda s: s["line"]), ",")
    return records.groupBy("archive", F.floor(F.col("offset") / range_bytes).cast("long").alias("node")).agg(F.sha2(one, 256).alias("hash"))


def above(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level of nodes."""
    line = F.concat_ws(":", F.col("node").cast("string"), F.col("hash"))
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", line.alias("line")))), lambda s: s["line"]), ",")
    return nodes.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.sha2(one, 256).alias("hash"))


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes of each level, leaves first; each is written, so the next starts from it."""
    out = [materialise(leaves(records, range_bytes), "leaves")]
    for _ in range(levels - 1):
        out.append(materialise(above(out[-1], fanout), "nodes"))
    return out


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(archive, node) of leaves that differ, by descent from the roots through differing nodes only."""
    bad = None
    for x, y in zip(reversed(a), reversed(b)):
        if bad is not None:
            parents = bad.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))
            x, y = (n.join(parents, (n["archive"] == F.col("p_archive")) & (F.floor(n["node"] / fanout) == F.col("p_node")), "left_semi") for n in (x, y))
        x, y = (n.select("archive", "node", F.col("hash").alias(h)) for n, h in ((x, "hash_a"), (y, "hash_b")))
        bad = materialise(x.join(y, ["archive", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("archive", "node"), "differing")
    return bad


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """A row per record of either replica: archive, offset, length, page_id, sha256_a, sha256_b, status.

    Replicas are indices (archive, offset, length, page_id, sha256).  ``status`` is ok,
    corrupt (hash or length differs), missing (only in ``a``) or extra (only in ``b``).
    Records outside differing leaves are ok without being compared.  Length and page_id
    are those of ``a`` if it has the record.  Two empty replicas give no rows.
    """
    a, b = materialise(a, "replica"), materialise(b, "replica")
    last = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0  # one number
    levels, top = 1, last // range_bytes
    while top:
        levels, top = levels + 1, top // fanout
    bad = differing(tree(a, levels, range_bytes, fanout), tree(b, levels, range_bytes, fanout), fanout)
    bad = bad.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))

    def under(rows, how):
        return rows.join(bad, (rows["archive"] == F.col("p_archive")) & (F.floor(rows["offset"] / range_bytes) == F.col("p_node")), how)

    sure = under(a, "left_anti").select("archive", "offset", "length", "page_id", F.col("sha256").alias("sha256_a"), F.col("sha256").alias("sha256_b"), F.lit("ok").alias("status"))
    x = under(a, "left_semi").select("archive", "offset", F.struct("length", "page_id", "sha256").alias("x"))
    y = under(b, "left_semi").select("archive", "offset", F.struct("length", "page_id", "sha256").alias("y"))
    status = (
        F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra")
        .when((F.col("x.sha256") == F.col("y.sha256")) & (F.col("x.length") == F.col("y.length")), "ok").otherwise("corrupt")
    )
    doubt = x.join(y, ["archive", "offset"], "full").select(
        "archive", "offset", F.coalesce("x.length", "y.length").alias("length"), F.coalesce("x.page_id", "y.page_id").alias("page_id"),
        F.col("x.sha256").alias("sha256_a"), F.col("y.sha256").alias("sha256_b"), status.alias("status"),
    )
    return sure.unionByName(doubt)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header lines after the first, names in lower case."""
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _name(fields: dict[bytes, bytes]) -> str | None:
    name = fields.get(b"warc-record-id")
    return name.decode("utf-8", "replace") if name else None


def parse_archive(raw: bytes) -> Iterator[tuple[int, int, str | None, str]]:
    """(offset, length, record id, sha256) of each record of a WARC file; a torn record ends it with the bytes there are.

    Of a compressed file each gzip member is a record, and its offset, length and hash are those
    of the member's bytes in the file; a member that can't be read ends it.
    """
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\x1f\x8b":
            member, head, end = zlib.decompressobj(31), b"", len(raw)
            try:
                for cut in range(at, len(raw), 1 << 20):
                    part = member.decompress(raw[cut : cut + (1 << 20)])
                    head = head if b"\r\n\r\n" in head else head + part
                    if member.eof:
                        end = min(cut + (1 << 20), len(raw)) - len(member.unused_data)
                        break
            except zlib.error:
                pass
            fields = _fields(head.partition(b"\r\n\r\n")[0])
        else:
            stop = raw.find(b"\r\n\r\n", at)
            fields = _fields(raw[at : stop if stop >= 0 else len(raw)])
            size = fields.get(b"content-length", b"")
            end = min(len(raw), stop + 4 + int(size) + 4) if stop >= 0 and size.isdigit() else len(raw)
        yield at, end - at, _name(fields), hashlib.sha256(raw[at:end]).hexdigest()
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, record_id, sha256) of the records of WARC files, compressed or not, of at most 2 GB, one file at a time in a task."""
    def run(batches):
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                yield pd.DataFrame([(name, *r) for r in parse_archive(bytes(raw or b""))], columns=["path", "offset", "length", "record_id", "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, offset bigint, length bigint, record_id string, sha256 string")
