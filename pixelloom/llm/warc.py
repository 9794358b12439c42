"""WARC archives: writing records, and reading them back by boundary-chain verification.

Spark's text writer lays the records into archive files. Reading splits the files at every magic string, wherever it stands;
each such place is a candidate record and names the offset of its successor. Pointer jumping from the first record of every file
keeps the places that the chain of lengths reaches, so a magic string inside a payload never starts a record; where a chain
breaks, the file is damaged, which is an error or reported.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch

MAGIC = "WARC/1.0\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records a written file holds at most.
RECORDS_PER_FILE = 4096
#: Rows of a narrow written table up to which it is broadcast (under 100 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 100_000


def _sized(table: DataFrame) -> DataFrame:
    """A written, narrow table with the join strategy that its row count allows."""
    return table.hint("broadcast") if table.count() <= BROADCAST_ROWS else table.hint("merge")


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: 40 hex digits as eight groups of 20 bits."""
    h = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean(c: Column) -> Column:
    """A header value: control characters and blanks percent-encoded would change lengths; they are replaced by '%20'."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x20\\x7F]", "%20")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) as WARC files under ``path``. A null html is an empty payload, a
    null url gives no target header. Rows with one page_id and one payload are all responses of their own."""
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", body.alias("html"), base32_sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    # Digests that stand more than once are looked up on narrow rows; payloads meet the outcome by page, so that no digest gathers them.
    narrow = materialize(p.select("page_id", "digest", "size").filter(F.col("size") >= min_bytes), "warc-digests")
    first = narrow.groupBy(F.col("digest").alias("g"), F.col("size").alias("gs")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(first.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("g", "gs", "first"), "warc-repeated")
    again = narrow.join(_sized(repeated), (F.col("digest") == F.col("g")) & (F.col("size") == F.col("gs"))).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = materialize(again.select(F.col("page_id").alias("again"), "g", "first").distinct(), "warc-revisits")
    p = p.join(_sized(again), F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("g")), "left")
    revisit = F.col("first").isNotNull()
    uuid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    length = F.when(revisit, F.lit(len(_HTTP))).otherwise(F.lit(len(_HTTP)) + F.col("size"))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), uuid(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z"), F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url")))).otherwise(F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), uuid(F.col("first")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"), F.lit(f"\r\nX-HTTP-Head-Length: {len(_HTTP)}"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    p.select(F.concat(head, block, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives split at every magic string: file, split, i (order of rows in a split), seg (the bytes after the magic)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("seg"))


def placed(rows: DataFrame) -> DataFrame:
    """Add off, where the magic string of a segment stands, and next, where the following one does. ``rows``: file, split, i, len (bytes). A
    read that starts inside a file yields what follows its first magic, so the sums of the lengths give offsets."""
    w = Window.partitionBy("file").orderBy("split", "i")
    cum = F.sum(F.col("len") + len(MAGIC)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumns({"k": F.row_number().over(w), "off": cum - F.col("len") - 2 * len(MAGIC)}).filter(F.col("k") > 1)
    return out.withColumn("next", F.col("off") + F.col("len") + len(MAGIC)).drop("k")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the magic string, parsed as a record of its own: file, off, succ (where the next record must start by its length;
    null if it has no header), next (where the next magic string stands), and what ``parse`` reads. Payloads stay behind."""
    s = F.col("seg")
    narrow = segments(spark, path).select("file", "split", "i", F.octet_length("seg").cast("long").alias("len"), jump(s).alias("jump"), *parse(s))
    narrow = materialize(narrow, "warc-parsed")
    return materialize(placed(narrow).withColumn("succ", F.col("off") + F.col("jump")).drop("jump", "len", "split", "i"), "warc-candidates")


def jump(seg: Column) -> Column:
    """Bytes from a magic string to the record after it, by the header that follows; null without one."""
    end = F.instr(seg, "\r\n\r\n")
    header = F.substring(seg, F.lit(1), F.greatest(end - 1, F.lit(0)))
    length = F.regexp_extract(header, "(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r\n|$)", 1)
    return F.when((end > 0) & (length != ""), F.lit(len(MAGIC) + 8) + F.octet_length(header) + length.try_cast("long"))


def read_archives(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """The records of all archives under ``path``: page_id, record_type, refers_to, stated_digest, stated_bytes, digest and bytes of the
    payload that was read (null in revisits). Empty files have no records; text before the first record of a file is skipped.

    A chain that breaks (see ``chains``) is an error. With ``damaged="skip"`` the records up to the break are returned, without one that is cut; what
    lies behind it is not read, and ``damages`` tells where."""
    cand = candidates(spark, path)
    good = materialize(chains(cand), "warc-chains")
    if damaged == "raise":
        bad = good.filter("reason != ''").orderBy("file", "off").limit(3).collect()
        if bad:
            raise ValueError("damaged archives: " + "; ".join(f"{r['file']} at byte {r['off']}: {r['reason']}" for r in bad))
    marked = cand.join(good.select(F.col("file").alias("gf"), F.col("off").alias("go"), "reason").hint("shuffle_hash"), (F.col("gf") == F.col("file")) & (F.col("go") == F.col("off")), "left")
    owner = F.last(F.when(F.col("gf").isNotNull(), F.col("off")), True).over(Window.partitionBy("file").orderBy("off"))
    owned = materialize(marked.withColumn("rec", owner).filter(F.col("rec").isNotNull()), "warc-owned")
    fields = ["page_id", "record_type", "refers_to", "stated_digest", "stated_bytes", "digest", "bytes"]
    starts = owned.filter((F.col("rec") == F.col("off")) & F.col("reason").isin("", GAP))
    whole = starts.filter(F.col("succ") <= F.col("next")).select(*fields)
    broken = starts.filter(F.col("succ") > F.col("next")).select("file", "rec")
    if not broken.limit(1).count():
        return whole
    # A record whose payload holds magic strings was split there: the files are read once more and its pieces put together, in order.
    pieces = materialize(owned.select("file", "rec", "off").join(broken.hint("merge"), ["file", "rec"], "left_semi"), "warc-pieces")
    segs = materialize(segments(spark, path), "warc-segments")
    places = placed(segs.select("file", "split", "i", F.octet_length("seg").cast("long").alias("len"))).select("file", "off", "i")
    wanted = materialize(places.join(pieces.hint("merge"), ["file", "off"]), "warc-wanted")
    parts = segs.select("i", "seg").join(_sized(wanted), "i").groupBy("file", "rec").agg(F.sort_array(F.collect_list(F.struct("off", "seg"))).alias("p"))
    again = parts.select(F.array_join(F.transform("p", lambda x: x["seg"]), MAGIC).alias("seg")).select(*parse(F.col("seg")))
    return whole.unionByName(again)


CUT, GAP, HEADLESS = "the record ends behind the file's end", "no record where the next one must start", "no header with a length"


def damages(spark: SparkSession, path: str) -> DataFrame:
    """Where the chains of the archives under ``path`` break: file, off (of the last record reached), reason, and unread, the bytes of the file from there
    (for a record that is whole itself, from its end)."""
    cand = candidates(spark, path)
    end = cand.groupBy(F.col("file").alias("ef")).agg(F.max("next").alias("end"))
    bad = chains(cand).filter("reason != ''").join(cand.select(F.col("file").alias("cf"), F.col("off").alias("co"), "succ").hint("merge"), (F.col("cf") == F.col("file")) & (F.col("co") == F.col("off")))
    out = bad.join(end.hint("merge"), F.col("ef") == F.col("file"))
    return out.select("file", "off", "reason", (F.col("end") - F.when(F.col("reason") == GAP, F.col("succ")).otherwise(F.col("off"))).alias("unread"))


def chains(cand: DataFrame) -> DataFrame:
    """The places (file, off, reason) that successors reach from the first record of their file. ``reason`` is empty where the chain goes on or ends
    with the file, else it says why it breaks there. A file's narrow places come together in one task; each round of pointer jumping doubles the
    stride of the links."""

    def jump_(table: pa.Table) -> pa.Table:
        t = table.sort_by("off")
        off, next_ = t.column("off").to_numpy(), t.column("next").to_numpy()
        succ = t.column("succ").fill_null(-1).to_numpy()
        n, end = len(off), next_[-1]
        at = np.minimum(np.searchsorted(off, succ), n - 1)
        linked = off[at] == succ
        link = np.append(np.where(linked, at, n), n)
        seen = np.zeros(n + 1, bool)
        seen[np.argmax(succ >= 0)] = True
        while (link < n).any():
            seen[link[seen]] = True
            link = link[link]
        k = np.flatnonzero(seen[:n])
        reason = np.select([linked[k] | (succ[k] == end), succ[k] < 0, succ[k] > end], ["", HEADLESS, CUT], GAP)
        return pa.table({"file": t.column("file").take(pa.array(k)), "off": pa.array(off[k]), "reason": pa.array(reason.tolist(), pa.string())})

    return cand.select("file", "off", "succ", "next").groupBy("file").applyInArrow(jump_, "file string, off bigint, reason string")


def parse(seg: Column) -> list[Column]:
    """Header fields of a record, and digest and length of its payload. ``seg``: the bytes after the magic string."""
    end = F.instr(seg, "\r\n\r\n")
    header = F.substring(seg, F.lit(1), F.greatest(end - 1, F.lit(0)))
    field = lambda name, pat: F.regexp_extract(header, f"(?:^|\r\n){name}: {pat}(?:\r\n|$)", 1)
    kind = field("WARC-Type", "([a-z]+)")
    size = field("X-HTTP-Head-Length", "([0-9]{1,9})").try_cast("int")
    length = field("Content-Length", "([0-9]{1,18})").try_cast("long")
    # The payload ends four bytes (two line ends) before the next record; lengths of the header are in bytes, as it is ASCII.
    body = F.substring(seg.cast("binary"), F.octet_length(header) + 5 + size, (length - size).cast("int"))
    own = kind == "response"
    return [field("WARC-Record-ID", "<urn:page:([^>]*)>").try_cast("long").alias("page_id"), kind.alias("record_type"), field("WARC-Refers-To", "<urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
            field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated_digest"), field("X-Payload-Length", "([0-9]{1,18})").try_cast("long").alias("stated_bytes"),
            F.when(own, base32_sha1(body)).alias("digest"), F.when(own, F.octet_length(body).cast("long")).alias("bytes")]


def archive_report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and report each record. Digest and length of a response
    are taken from the payload that was read; a revisit has those of the record it refers to, as its header states them."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    rec = read_archives(spark, path)
    return rec.select("page_id", F.coalesce("bytes", "stated_bytes").alias("payload_bytes"), F.coalesce("digest", "stated_digest").alias("payload_digest"), "record_type", "refers_to")
