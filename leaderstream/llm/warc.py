"""WARC archives: writing with revisits, and reading with boundary-chain verification.

Archives are read in splits, cut wherever the bytes that begin a record occur, also inside payloads. Each cut is a candidate
with a successor, the place where its own header says the record ends. Only candidates that a chain from the file's start
reaches are records. Chains are followed by pointer jumping: first inside each split, where a task finds the place at which a chain
leaves it from each candidate, then between splits by joins that double the distance in each round, then once more
inside, from the one place at which the chain enters a split.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept, text_or_empty

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 0
_MAGIC = MAGIC.encode()


def base32(hex_digest: Column) -> Column:
    """A hexadecimal SHA-1 in base 32: 5 hexadecimal digits are 4 digits."""
    digits = []
    for at in range(8):
        five = F.conv(F.substring(hex_digest, 5 * at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(five, shift).bitwiseAND(F.lit(31)) + 1
            digits.append(F.substr(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*digits)


def _record_id(page_id: str) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(" "), "_sha").cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit("\r\n"))


def write_warc(
    pages: DataFrame,
    path: str,
    least_bytes: int = LEAST_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> None:
    """A record for each page, in one archive for each task, in a fresh folder ``path``.

    Of equal payloads of at least ``least_bytes`` bytes, the page with the largest id is the response; the others are revisits
    that have no block and name it. A NULL payload is empty. A NULL id is the least; rows with
    the largest id and equal payloads are all responses. Line breaks in a URL become spaces. Other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), text_or_empty(html).alias("_html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("_html").cast("binary"))).withColumn("_size", F.octet_length("_html"))
    # Written and read again, so that Spark can measure it, broadcast it or split a common payload's rows.
    copies = rows.where(F.col("_size") >= least_bytes).groupBy("_sha", "_size").agg(
        F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    copies = kept(copies.where("_n > 1 and _first is not null").drop("_n"), "warc-copies")
    rows = rows.join(copies, ["_sha", "_size"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id("_id")),
        _header("WARC-Date", date),
        _header("WARC-Target-URI", F.col("_url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha")))),
        _header("X-Payload-Length", F.col("_size")),
        _header("X-Page-ID", F.col("_id")),
        F.when(
            revisit,
            F.concat(
                _header("WARC-Profile", PROFILE),
                _header("WARC-Refers-To", _record_id("_first")),
                _header("X-Refers-To-Page", F.col("_first")),
            ),
        ).otherwise(""),
        _header("Content-Type", "text/html; charset=UTF-8"),
        _header("Content-Length", F.when(revisit, 0).otherwise(F.col("_size"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("_html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


_FIELDS = (
    "record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, "
    "payload_at bigint, payload_end bigint"
)
_CANDIDATE = f"file string, split bigint, at bigint, next bigint, covered bigint, {_FIELDS}"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _parse(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Headers, and where the block begins; None where this is no header of a record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    return (headers, end + 4) if length.isdigit() else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cut, places counted from the first cut of the split; ``covered`` in a last row of each split.

    The digest is that of the payload where it has no cut in it, else NULL.
    """
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _CANDIDATE.split(", ")])
    key, at = None, 0

    def total() -> dict:
        return {**dict.fromkeys(names), "file": key[0], "split": key[1], "covered": at}

    for batch in batches:
        rows = []
        for file, split, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (file, split):
                if key is not None:
                    rows.append(total())
                key, at = (file, split), 0
            # What stands before the first cut of a file is no record.
            begin = at
            if first and at == 0:
                at += len(raw) + len(_MAGIC)
                if not raw:
                    continue
            else:
                at += len(raw) + len(_MAGIC)
                found = _parse(raw)
                if found:
                    rows.append(_row(names, file, split, begin, raw, *found))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([total()], schema=schema)


def _row(names: list[str], file: str, split: int, begin: int, raw: bytes, headers: dict, block: int) -> dict:
    """``at`` is where the magic of the record begins: a cut's text begins behind it."""
    length = int(headers["content-length"])
    revisit = headers.get("warc-type") == "revisit"
    digest = None
    if revisit:
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    elif block + length <= len(raw):
        digest = base64.b32encode(hashlib.sha1(memoryview(raw)[block : block + length]).digest()).decode()
    return {
        **dict.fromkeys(names),
        "file": file,
        "split": split,
        "at": begin - len(_MAGIC),
        "next": begin + block + length + len(END),
        "record_type": headers.get("warc-type"),
        "page_id": _number(headers.get("x-page-id")),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": _number(headers.get("x-payload-length")) if revisit else length,
        "payload_digest": digest,
        "refers_to": _number(headers.get("x-refers-to-page")),
        "payload_at": begin + block,
        "payload_end": begin + block + length,
    }


def _jumps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Index of each place's successor among the ascending places ``at``; the number of places where it has none."""
    n = len(at)
    index = np.searchsorted(at, after)
    inside = (index < n) & (at[np.minimum(index, n - 1)] == after)
    return np.append(np.where(inside, index, n), n)


def exits(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """From each place, the first place of its chain that is not among ``at``, by pointer jumping."""
    if not len(at):
        return after
    step = _jumps(at, after)[:-1]
    # Places without a successor here point to themselves; distances double until all point to such.
    last = np.where(step < len(at), step, np.arange(len(at)))
    while (far := last[last]).tolist() != last.tolist():
        last = far
    return after[last]


def reached(at: np.ndarray, after: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which places chains from those marked by ``entry`` pass, by pointer jumping."""
    jump = _jumps(at, after)
    mark = np.append(entry, False)
    while True:
        hit = jump[np.flatnonzero(mark)]
        mark[hit[hit < len(at)]] = True
        far = np.append(jump[jump[:-1]], len(at))
        if (far == jump).all():
            return mark[:-1]
        jump = far


def _leave(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    out = exits(rows.column("at").to_numpy(), rows.column("next").to_numpy())
    return rows.select(["file", "split", "at"]).append_column("leaves", pa.array(out, pa.int64()))


def _pass(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    entry = rows.column("entry").to_numpy(zero_copy_only=False).astype(bool)
    mark = reached(rows.column("at").to_numpy(), rows.column("next").to_numpy(), entry)
    return rows.drop_columns(["entry"]).filter(pa.array(mark, pa.bool_()))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    where = F.col("_metadata.file_block_start")
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        where.alias("split"),
        (where == 0).alias("first"),
        F.col("value").cast("binary").alias("raw"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in ``path``: ``file``, ``at`` and the fields of its header.

    ``payload_bytes`` and ``payload_digest`` (SHA-1 in base 32) are of the full payload: counted and computed from the bytes of a
    response, stated by a revisit. A record whose header is broken ends its file's chain. No archives: no rows.
    """
    found = kept(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    # A split's first cut is where the last one of the split before ends.
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = found.where("covered is not null").select("file", "split", "covered")
    bases = splits.select("file", "split", F.coalesce(F.sum("covered").over(before), F.lit(0)).alias("_base"))
    bases = kept(bases, "warc-splits")
    places = ("at", "next", "payload_at", "payload_end")
    rows = found.where("at is not null").drop("covered").join(bases, ["file", "split"])
    rows = kept(rows.withColumns({c: F.col(c) + F.col("_base") for c in places}).drop("_base"), "warc-places")

    light = rows.select("file", "split", "at", "next")
    leaving = light.groupBy("file", "split").applyInArrow(_leave, "file string, split bigint, at bigint, leaves bigint")
    chain = kept(leaving.select("file", "at", "leaves"), "warc-chain")
    entries = rows.where("at = 0").select("file", "at").distinct()
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range((most - 1).bit_length()):
        far = chain.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("_far"))
        ahead = entries.join(chain, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        entries = kept(entries.unionAll(ahead).distinct(), "warc-entries")
        jumped = chain.join(far, ["file", "leaves"], "left")
        chain = kept(jumped.select("file", "at", F.coalesce("_far", "leaves").alias("leaves")), "warc-chain")
    marked = rows.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = marked.select(*rows.columns, F.coalesce("entry", F.lit(False)).alias("entry"))
    records = kept(marked.groupBy("file", "split").applyInArrow(_pass, fields), "warc-records")

    parted = records.where("payload_digest is null").select("file", "at", "payload_at", "payload_end")
    if not parted.isEmpty():
        digests = _parted_digests(spark, path, parted, bases)
        records = records.join(digests, ["file", "at"], "left").withColumn(
            "payload_digest", F.coalesce("payload_digest", "_digest")
        )
    return records.select("file", "at", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to")


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cut's text with the magic behind it, and its place counted from the first cut of its split."""
    key, at = None, 0
    for batch in batches:
        places = []
        for file, split, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if key != (file, split):
                key, at = (file, split), 0
            places.append(at)
            at += len(raw.as_buffer()) + len(_MAGIC)
        columns = [batch.column(0), batch.column(1), pa.array(places, pa.int64()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "split", "place", "raw"])


def _parted_digests(spark: SparkSession, path: str, parted: DataFrame, bases: DataFrame) -> DataFrame:
    """Digests of the payloads that hold the magic, put together from the cuts they are in."""
    cuts = _pieces(spark, path).mapInArrow(_offsets, "file string, split bigint, place bigint, raw binary")
    cuts = cuts.join(bases, ["file", "split"]).select(
        F.col("file").alias("_file"), (F.col("place") + F.col("_base")).alias("_place"), "raw"
    )
    end = F.col("_place") + F.octet_length("raw") + len(_MAGIC)
    meets = (F.col("file") == F.col("_file")) & (F.col("_place") < F.col("payload_end")) & (end > F.col("payload_at"))
    rows = cuts.join(parted, meets).select("file", "at", "payload_at", "payload_end", "_place", "raw")

    def digest(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        place = rows.column("_place")[0].as_py()
        data = _MAGIC.join(rows.column("raw").to_pylist()) + _MAGIC
        begin, to = rows.column("payload_at")[0].as_py() - place, rows.column("payload_end")[0].as_py() - place
        found = base64.b32encode(hashlib.sha1(data[begin:to]).digest()).decode()
        return pa.table({"file": rows.column("file")[:1], "at": rows.column("at")[:1], "_digest": [found]})

    return rows.groupBy("file", "at").applyInArrow(digest, "file string, at bigint, _digest string")
