"""WARC archives written by Spark's own writer and read back by boundary-chain verification.

Write: one record per page. Only narrow rows (page_id, url, digest, length) are grouped to choose the response among
equal payloads; a payload shared by a third of all pages is one row per task before the shuffle. Payloads that
no other page shares are written from the scan itself. A broadcast of at most 2**20 slots (a fixed bound) tells
them apart; the payloads behind the other slots pass through one join that sends each chosen payload once, revisits
none. Records are lines of Spark's text writer whose separator is the blank line pair that ends a WARC record, so the
committer makes the archives whole whatever executor is lost. Files are gzipped and hold at most ``pages_per_file`` records.

Read: the text reader splits files at the record magic wherever it stands, also inside payloads. A gzipped
file is one task's, in order, so a running sum of lengths gives each chunk's offset. Each chunk is a candidate
record start; its headers give a candidate successor offset. Per file, pointer jumping from offset 0 over these (offset,
successor) pairs keeps what is reachable: a magic inside a payload is no one's successor. Most records are one
chunk and leave the second scan as they are; false starts and the records that hold them (told by
slots of at most 2**20 hashes) are joined to the verdicts and put together again.

Null html is an empty payload. Of records with equal payloads of at least ``least_bytes`` bytes that
with the smallest page_id (nulls last, then the least url) is a response and all others are revisits, rows that
repeat a page_id too. A null page_id is written as an empty id. Columns beyond page_id, url and html are
ignored. An empty table gives an empty archive and result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, one_row_each

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
SLOTS = 1 << 20


def _slot(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SLOTS))


def plan_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, n_bytes, refers_to, one row per record; html is null for revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    full = full.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    narrow = scratch.cut(full.select("page_id", "url", "digest", "n_bytes"), "narrow")
    who = ["page_id", "url", "digest", "n_bytes"]
    shared = scratch.cut(narrow.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "shared")
    slots = scratch.cut(shared.select(_slot(F.col("digest")).alias("slot")).distinct(), "slots")
    is_maybe = (F.col("n_bytes") >= least_bytes) & F.col("slot").isNotNull()
    marked = lambda rows: rows.join(F.broadcast(slots), _slot(F.col("digest")) == F.col("slot"), "left")
    rows = marked(narrow).where(is_maybe).groupBy(*who).agg(F.count(F.lit(1)).alias("times")).join(shared.withColumn("shared", F.lit(True)), "digest", "left")
    rows = scratch.cut(rows, "rows")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    first = scratch.cut(rows.where("shared").groupBy("digest").agg(F.min(order).alias("first")), "first")
    judged = rows.join(first, "digest", "left").withColumn("chosen", F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url"))))
    judged = scratch.cut(judged.select(*who, "times", "chosen", F.col("shared").isNotNull().alias("shared"), F.col("first.page_id").alias("first_id")), "judged")
    more = F.col("times") - F.when(F.col("chosen"), 1).otherwise(0)
    again = judged.where("shared").where(more > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), more.cast("int"))))
    nothing = F.lit(None).cast("string")
    revisits = again.select("page_id", "url", nothing.alias("html"), "digest", "n_bytes", F.col("first_id").alias("refers_to"), F.lit(True).alias("revisit"))
    # A payload is wanted from one row: its page's slot keeps the copies' texts out of the shuffle.
    wanted = judged.where("chosen").select("page_id", "url", "digest", "times", "shared")
    chosen_slots = scratch.cut(wanted.select(_slot(F.col("page_id"), F.col("url"), F.col("digest")).alias("chosen_slot")).distinct(), "chosen-slots")
    kept = marked(full).where(is_maybe).drop("slot").join(F.broadcast(chosen_slots), _slot(F.col("page_id"), F.col("url"), F.col("digest")) == F.col("chosen_slot"), "left_semi")
    w = wanted.toDF("w_page", "w_url", "w_digest", "times", "shared")
    held = kept.join(w, (F.col("digest") == F.col("w_digest")) & F.col("page_id").eqNullSafe(F.col("w_page")) & (F.col("url") == F.col("w_url")))
    record = lambda df: df.select("page_id", "url", "html", "digest", "n_bytes", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    repeated = one_row_each(held.where("shared AND times > 1"), ["digest"])
    direct = marked(full).where(~is_maybe)
    return record(direct).unionByName(record(held.where("NOT shared OR times = 1"))).unionByName(record(repeated)).unionByName(revisits)


def write_warc(pages: DataFrame, path: str, scratch: Scratch, pages_per_file: int = 4000, least_bytes: int = 100) -> None:
    planned = plan_records(pages, scratch, least_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("revisit")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type: ", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID: ", urn(F.col("page_id"))),
        line("WARC-Target-URI: ", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        line("X-Payload-Length: ", F.col("n_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To: ", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    planned.select(F.concat(head, block).alias("value")).write.options(lineSep=END, maxRecordsPerFile=pages_per_file, compression="gzip").mode("overwrite").text(path)


def _reach(file: pd.DataFrame) -> pd.DataFrame:
    """Marks the candidates reachable from offset 0; pointer jumping in log2(candidates) rounds."""
    file = file.sort_values("offset", ignore_index=True)
    off, nxt = file["offset"].to_numpy(), file["successor"].to_numpy()
    n = len(off)
    at = np.searchsorted(off, nxt)
    jump = np.where((at < n) & (off[np.minimum(at, n - 1)] == nxt), at, n)
    jump = np.append(jump, n)
    held = np.zeros(n + 1, bool)
    held[:1] = n > 0 and off[0] == 0
    while True:
        more = held.copy()
        more[jump[held]] = True
        if (more == held).all() and (jump == jump[jump]).all():
            break
        held, jump = more, jump[jump]
    return file.assign(kept=held[:n], record=np.cumsum(held[:n]))


_LENGTH = re.compile(rb"(?i)(?:^|\r\n)Content-Length: *(\d{1,18}) *(?:\r\n|$)")


def _chunks(whole: bool):
    """Candidate starts of gzipped files, whose chunks come in order: offset and successor (-1: no length), with ``whole`` the bytes."""

    def run(batches):
        at, end = None, 0
        for batch in batches:
            file, offset, successor, body = [], [], [], []
            for name, value in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist()):
                if name != at:
                    at, end = name, 0
                    if not value:  # a file starts with the magic: its first chunk is empty
                        end = len(MAGIC)
                        continue
                head = value.find(b"\r\n\r\n")
                head = len(value) if head < 0 else head
                said = _LENGTH.search(value[:head])
                file.append(name)
                offset.append(end - len(MAGIC))
                successor.append(end + head + 4 + int(said[1]) + 4 if said else -1)
                body.append(value)
                end += len(value) + len(MAGIC)
            cols = [pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(body, pa.binary()) if whole else pa.array(successor, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["file", "offset", "bytes" if whole else "successor"])

    return run


def read_warc(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row per verified record of gzipped archives: type, page_id, url, digest, payload (binary), said (payload length), refers_to."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    chunk = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("bytes"))
    starts = chunk.mapInArrow(_chunks(False), "file string, offset long, successor long")
    kept = scratch.cut(starts.groupBy("file").applyInPandas(_reach, "file string, offset long, successor long, kept boolean, record long").where("record > 0"), "kept")
    # A record is its chunk and the false starts that follow it. Those alone are joined to the verdicts.
    size = kept.groupBy("file", "record").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    odd = scratch.cut(kept.join(size, ["file", "record"]).select("file", "offset", "record"), "odd")
    slots = scratch.cut(odd.select(_slot(F.col("file"), F.col("offset")).alias("slot")).distinct(), "odd-slots")
    bodies = chunk.mapInArrow(_chunks(True), "file string, offset long, bytes binary").join(F.broadcast(slots), _slot(F.col("file"), F.col("offset")) == F.col("slot"), "left")
    some = bodies.where("slot IS NOT NULL").drop("slot").join(odd, ["file", "offset"], "left")
    single = bodies.where("slot IS NULL").select("bytes").unionByName(some.where("record IS NULL").select("bytes")).select(F.col("bytes").alias("body"))
    whole = some.where("record IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "bytes"))).alias("parts"))
    text = F.col("parts")[0]["bytes"]
    body = F.aggregate(F.slice("parts", 2, F.size("parts")), text, lambda acc, x: F.concat(acc, F.lit(MAGIC).cast("binary"), x["bytes"]))
    rec = single.unionByName(whole.select(body.alias("body"))).select("body", F.substring_index(F.decode("body", "ISO-8859-1"), "\r\n\r\n", 1).alias("h"))
    get = lambda name, pat: F.nullif(F.regexp_extract(F.col("h"), rf"(?i)(?:^|\r\n){name}: *{pat}", 1), F.lit(""))
    rec = rec.select(
        get("WARC-Type", r"([a-z]+)").alias("record_type"), get("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"), F.decode(F.encode(get("WARC-Target-URI", r"([^\r]*)"), "ISO-8859-1"), "UTF-8").alias("url"),
        get("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("digest"), get("X-Payload-Length", r"(\d+)").cast("long").alias("said"), get("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        get("Content-Length", r"(\d+)").cast("int").alias("n"), F.length("h").alias("hl"), "body",
    )
    block = F.expr("substring(body, hl + 5, n)")
    rec = rec.withColumn("block", block).withColumn("http", F.length(F.substring_index(F.decode("block", "ISO-8859-1"), "\r\n\r\n", 1)) + 4)
    return rec.select("record_type", "page_id", "url", "digest", "said", "refers_to", F.expr("substring(block, http + 1, n)").alias("payload"))


def round_trip(pages: DataFrame, pages_per_file: int = 4000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives.

    A response's length and digest are those of the payload read; a revisit has no payload, its own
    headers speak for the full one.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    write_warc(pages, scratch.path("archive"), scratch, pages_per_file)
    rec = read_warc(pages.sparkSession, scratch.path("archive"), scratch)
    full = F.col("record_type") == "response"
    return rec.select(
        "page_id", F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("said")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


REPORT_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id ASC NULLS LAST, url) AS turn,
  first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id ASC NULLS LAST, url) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN turn > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN turn > 1 AND payload_bytes >= 100 THEN first_id END AS refers_to FROM f
"""
