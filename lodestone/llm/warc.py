"""Content-addressed WARC archive.

`write_archive` lays down three parts under one path:
  payloads/  WARC files: one response record per distinct payload of at least MIN_REVISIT bytes, the page with the
             smallest id, and one per page with a smaller payload. Payload bytes are stored once per strong digest.
  revisits/  WARC files: a revisit record without payload for every other page, referring to that response.
  headers/   Parquet: the exact header block of the plain response record of every page, with its payload digest.
A revisit's header states the length of the payload it stands for, so that it is read without a join. Payload files are written
by size class, so that none holds more than about FILE_BYTES of payloads, or one record.
`read_archive` parses the WARC files by Content-Length, verifies every stored payload against its digest and returns the
rows; `reconstruct` joins headers to payloads and gives the original records byte for byte.

The pages are read twice: for the headers, and for the payloads. A distinct payload is shuffled once (copies collapse on the map side),
since only where all pages of a digest meet is it known which of them owns it. Revisits and their owners come from the written
headers, without payloads. Rows of a payload that many pages share are dealt over several tasks to
meet its owner, so it is no hot key.

Cases: a null payload is empty; null urls give no target header; page ids are unique keys: of rows that repeat an id and
a payload the first is the response, the rest revisit it like any other page; a null page_id is written as `null` and
sorts last; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, shared_path

MIN_REVISIT = 100
#: Records of a WARC file at most, and about how many bytes of payloads, so that a reader task holds a bounded file.
FILE_RECORDS, FILE_BYTES = 2000, 128 << 20
DATE = "2020-01-01T00:00:00Z"
END = "\r\n"
#: Field of revisits for the length of the payload they stand for.
LENGTH = "WARC-Payload-Length"


def _header(kind: str, *fields) -> F.Column:
    """Header block up to the blank line. fields: (name, column); a null value leaves its field out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{END}{name}: "), v.cast("string"))) for name, v in fields]
    return F.concat(F.lit(f"WARC/1.1{END}WARC-Type: {kind}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(END + END))


def _record_id(page: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _response(page: F.Column, url: F.Column, digest: F.Column, n: F.Column) -> F.Column:
    return _header(
        "response",
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", n),
    )


def _save(records: DataFrame, path: str, most: int = FILE_RECORDS) -> None:
    """Write a column of whole records; the line separator of the text format is the end of a WARC record."""
    records.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _size_class(n: F.Column) -> F.Column:
    """0 for payloads of which FILE_RECORDS make a file, and one more for each factor of 8."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) / (FILE_BYTES / FILE_RECORDS)) / 3)).cast("int")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    # url may hold line ends, which a header can't
    url = F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]+", " ")
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), body.alias("body"))
    marked = page.withColumn("digest", F.sha2(F.encode("body", "utf-8"), 256)).withColumn("n", F.octet_length("body").cast("long"))
    small = F.col("n") < MIN_REVISIT
    last = F.coalesce("page_id", F.lit((1 << 63) - 1))
    marked.select("page_id", "url", "digest", "n", _response(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n")).alias("header")).write.parquet(f"{path}/headers")
    narrow = pages.sparkSession.read.schema("page_id long, url string, digest string, n long").parquet(f"{path}/headers")

    # payload store: as a rule there is one size class
    classes = sorted(r[0] for r in narrow.select(_size_class(F.col("n")).alias("c")).distinct().collect()) or [0]
    for c in classes:
        part = marked.filter(_size_class(F.col("n")) == c)
        large = part.filter(~small)
        stored = large.groupBy("digest").agg(F.min(F.struct(last.alias("o"), "page_id", "url", "n", "body")).alias("r")).select("digest", "r.page_id", "r.url", "r.n", "r.body")
        whole = stored.unionByName(part.filter(small).select(*stored.columns)) if c == 0 else stored
        _save(whole.select(F.concat(_response(F.col("page_id"), F.col("url"), F.col("digest"), F.col("n")), "body").alias("value")), f"{path}/payloads/{c}", max(1, FILE_RECORDS >> 3 * c))

    owner = narrow.filter(~small).groupBy(F.col("digest").alias("d")).agg(F.min(F.struct(last.alias("o"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
    several = owner.filter("copies > 1")
    each = narrow.filter(~small).groupBy("digest", "page_id", "url", "n").agg(F.count(F.lit(1)).alias("same"))
    joined = join_spread(each, "digest", "page_id", several, "d", "copies")
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    times = F.col("same") - own.cast("int")
    again = joined.filter(times > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    revisit = _header(
        "revisit",
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", _record_id(F.col("first.page_id"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        (LENGTH, F.col("n")),
        ("Content-Length", F.lit(0)),
    )
    _save(again.select(revisit.alias("value")), f"{path}/revisits")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, header block, payload) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split(END)[1:-2])
        n = int(fields["Content-Length"])
        if data[end + n : end + n + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its length says")
        yield fields, head, data[end : end + n]
        at = end + n + 4


def _page(urn: str | None) -> int | None:
    raw = urn[len("<urn:page:") : -1] if urn else "null"
    return None if raw == "null" else int(raw)


_RECORDS = "page_id long, record_type string, refers_to long, digest string, header string, payload binary"


def records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the WARC files under a path. A response whose payload doesn't give its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORDS.split(", ")] + ["n"]
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, head, body in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())).read()):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"digest of {f['WARC-Record-ID']}")
                    out.append((_page(f["WARC-Record-ID"]), kind, _page(f.get("WARC-Refers-To")), digest, head.decode(), body if payload else None, int(f.get(LENGTH, n)) if (n := len(body)) == 0 else n))
                for at in range(0, max(1, len(out)), 500):
                    part = out[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, _RECORDS + ", n long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record."""
    both = records(spark, f"{path}/payloads").unionByName(records(spark, f"{path}/revisits"))
    return both.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the original plain response record (binary) of every page, from headers and payloads."""
    headers = spark.read.parquet(f"{path}/headers")
    # small payloads may be stored more than once
    payloads = records(spark, f"{path}/payloads", payload=True).select("digest", "payload").dropDuplicates(["digest"])
    whole = F.concat(F.encode("header", "utf-8"), "payload", F.lit((END + END).encode()))
    return headers.join(payloads, "digest").select("page_id", whole.alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archive(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN o USING (payload_digest)
"""
