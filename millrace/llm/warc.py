"""Content-addressed web archive.

Payload bytes are stored once, under the SHA-256 of the bytes; exact record
headers are stored apart, one row a record, and name their payload by that digest
and by the SHA-1 that the record format asks for.  Reading back rebuilds the records
through a join and takes lengths and digests from the rebuilt bytes: those of a
response from what follows its header, those of a revisit from what follows the header
of the record it refers to, which holds the payload of the same address.

A payload may belong to any share of the records.  Addresses with more than one record
in ``HOT`` (so fewer than ``HOT`` of them) are dealt over ``SALTS`` tasks in both joins.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the
smallest id is the ``response``; the others are ``revisit`` records, which refer to
it and carry no payload.  Smaller payloads are all responses.

Defined results: null html is an empty payload; null url is an empty one, and
line breaks in one are written as %0D and %0A; a null
``page_id`` comes after all others and is no one's reference unless alone; rows
that repeat an id are records of their own and all of them responses if theirs is
the smallest id; empty tables give an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MIN_REVISIT = 0
HOT = 1000
SALTS = 64
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Base32 (RFC 4648, upper case) of a hex string of 5n digits of five at a time.

    Five hex digits are twenty bits, which are four digits to the base 32.
    """
    parts = [F.lpad(F.lower(F.conv(F.substring(hex_digest, i, 5), 16, 32)), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def described(pages: DataFrame) -> DataFrame:
    """``page_id, url, address, sha1, n``: what headers need to know of the payloads."""
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), _payload().alias("_p"))
    return rows.select("page_id", "url", F.sha2("_p", 256).alias("address"), base32(F.sha1("_p")).alias("sha1"), F.length("_p").alias("n"))


def hot_addresses(rows: DataFrame) -> DataFrame:
    """``_h``: the addresses of more than one row in ``HOT``; fewer than ``HOT`` of them, so they can be broadcast."""
    counts = rows.groupBy("address").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * HOT > F.col("_all")).select(F.col("address").alias("_h"))


def by_address(rows: DataFrame, single: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``single`` (one row an address, named ``_a``); rows of hot addresses are dealt over tasks."""
    hot = F.broadcast(hot)
    salt = F.when(F.col("_h").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    many = rows.join(hot, F.col("address") == F.col("_h"), "left").withColumn("_salt", salt).drop("_h")
    salts = F.explode(F.when(F.col("_h").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    one = single.join(hot, F.col("_a") == F.col("_h"), "left").withColumn("_s", salts).drop("_h")
    return many.join(one, (F.col("address") == F.col("_a")) & (F.col("_salt") == F.col("_s")), how).drop("_salt", "_s")


def headers(rows: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, header, address`` for each row that :func:`described` gives."""
    # The first id of each address: combined map-side, one row a task and address.
    first = rows.groupBy("address").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # Only addresses that repeat need the join; the rest are responses as they are.
    repeated = first.filter("copies > 1").select(F.col("address").alias("_a"), "first_id")
    rows = by_address(rows, repeated, hot_addresses(rows), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n") >= min_revisit)
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, *v: F.concat(F.lit(f"{key}: "), *v, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("first_id"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select("page_id", header.alias("header"), "address")


def payloads(pages: DataFrame) -> DataFrame:
    """``address, payload``: each payload once; copies meet map-side, before the shuffle."""
    return pages.select(_payload().alias("payload")).groupBy(F.sha2("payload", 256).alias("address")).agg(F.first("payload").alias("payload"))


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive: ``path/headers`` and ``path/payloads``, both Parquet."""
    headers(scratch.table(described(pages), "warc-rows"), min_revisit).write.option("compression", "zstd").parquet(f"{path}/headers")
    payloads(pages).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(header: Column, key: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{key}: ([^\r\n]*)\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: ``page_id, header, record_type, refers_to, payload_digest, payload_bytes, payload, record``.

    ``record`` is the record's bytes as an archive file holds them, rebuilt from header
    and payload.  ``payload`` is the full payload of responses and revisits alike: for
    a response it is cut out of its record by the header's length, for a revisit it is
    that of the record it refers to.  A payload whose bytes do not match its
    address, the header's length or the header's digest raises.
    """
    headers = spark.read.schema("page_id long, header string, address string").parquet(f"{path}/headers")
    stored = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    rows = by_address(headers, stored.withColumnRenamed("address", "_a"), hot_addresses(headers), "inner")
    kind, head = _field(F.col("header"), "WARC-Type"), F.col("header").cast("binary")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    rows = rows.select("header", "address", kind.alias("record_type"), F.col("payload").alias("_stored"), F.concat(head, body, F.lit(END).cast("binary")).alias("record"))
    length = _field(F.col("header"), "Content-Length").cast("int")
    block = F.substring(F.col("record"), F.length(F.col("header").cast("binary")) + 1, F.length("record") - F.length(F.col("header").cast("binary")) - len(END))
    payload = F.when(F.col("record_type") == "response", block).otherwise(F.col("_stored"))
    sound = (F.length(block) == length) & (F.sha2("payload", 256) == F.col("address")) & (_digest() == base32(F.sha1("payload")))
    rows = rows.withColumn("payload", payload)
    rows = rows.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("record does not match its header or address "), F.col("address"))).cast("binary")))
    number = lambda key: F.regexp_extract("header", rf"\r\n{key}: <urn:page:(-?[0-9]+)>\r\n", 1).try_cast("long")
    return rows.select(
        number("WARC-Record-ID").alias("page_id"),
        "header",
        "record_type",
        number("WARC-Refers-To").alias("refers_to"),
        base32(F.sha1("payload")).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload",
        "record",
    )


def _digest() -> Column:
    return F.substring(_field(F.col("header"), "WARC-Payload-Digest"), 6, 32)


def export(spark: SparkSession, path: str, target: str) -> None:
    """Write the archive at ``path`` as plain record files under ``target``.

    A record is text in UTF-8, so Spark's text writer makes the files on any file
    system: each row is header and payload, and the separator ends the record.
    """
    rows = read(spark, path).select(F.col("record").cast("string").alias("record"))
    rows.select(F.substring("record", F.lit(1), F.length("record") - len(END)).alias("value")).write.option("lineSep", END).text(target)
