"""Feed payloads as a table: one row per landed response.

Columns: ``source``, ``company`` (null for whole-board feeds), ``payload_id``,
``kind`` (``listings``; the thread feed has ``stories`` and ``comments``),
``body`` and ``error`` (why the fetch itself failed, null when it did not);
optionally ``landed_at``, when the response was written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import coerce
from siftline.functions.text import strip

#: When a response was written, where that is known.
LANDED = "landed_at"
PAYLOAD = "source string, company string, payload_id string, kind string, body string, error string"


#: Whether a query's shuffle files go when it has ended, not when the driver next
#: collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of a folder's name that Spark's readers expect as ``%XX``.
_ESCAPED = "".join(map(chr, range(1, 32))) + "\x7f\"#%'*/:=?\\{[]^"


def land(responses: DataFrame, root: str) -> int:
    """Write each ``(source, company, payload_id, body)`` as a file of its own, in
    the layout of :func:`read_landing`; the number of files.

    A file has the name of its payload id, so a task that is done again writes the
    same files. Bodies are written as gzip, which the readers open as they are.
    """
    escaped = {ord(c): f"%{ord(c):02X}" for c in _ESCAPED}
    target, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def named(value: str | None) -> str:  # Python workers need not find this package
        return value.translate(escaped) if value else "__HIVE_DEFAULT_PARTITION__"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for source, company, name, body in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                folder = f"{base}/source={named(source)}/company={named(company)}"
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                packer = zlib.compressobj(1, wbits=31)
                with target.open_output_stream(f"{folder}/{named(name)}.txt.gz", compression=None) as out:
                    out.write(packer.compress(body.as_buffer()) + packer.flush())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    target.create_dir(base, recursive=True)
    rows = responses.filter(F.col("body").isNotNull()).select("source", "company", "payload_id", "body")
    spark = responses.sparkSession
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        spark.conf.set(FREED, before)


def read_landing(spark: SparkSession, root: str) -> DataFrame:
    """Read ``root/source=<name>/company=<slug>/<file>``.

    Each file is one response, read whole; the file name's first word gives the
    kind when it is ``stories`` or ``comments``, and a ``.error`` file holds the
    message of a failed fetch. Choosing a source prunes its directories.
    """
    return _payloads(_whole_files(spark.read).load(root))


def stream_landing(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """The same layout as a stream; ``most_files`` bounds what one batch takes."""
    reader = _whole_files(spark.readStream)
    return _payloads((reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(root))


def _whole_files(reader):
    return reader.format("text").option("wholetext", True).schema("value string, source string, company string")


def _payloads(loaded: DataFrame) -> DataFrame:
    files = loaded.withColumn("payload_id", F.col("_metadata.file_path"))
    name = F.col("_metadata.file_name")
    failed = name.endswith(".error")
    return files.select(
        "source",
        "company",
        "payload_id",
        F.when(name.rlike(r"\A(stories|comments)\b"), F.regexp_extract(name, r"\A(stories|comments)", 1)).otherwise(F.lit("listings")).alias("kind"),
        F.when(~failed, F.col("value")).alias("body"),
        F.when(failed, strip(F.col("value"))).alias("error"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
    )


def open_json(payloads: DataFrame, envelope: str | None) -> DataFrame:
    """Parse bodies and find the record list: the document itself, or the
    envelope key. Adds ``records`` and ``problem``; exactly one is null."""
    parsed = payloads.withColumn("_doc", F.try_parse_json("body"))
    listed = F.col("_doc") if envelope is None else coerce.at(F.col("_doc"), f"$.{envelope}")
    opened = parsed.withColumn("_list", listed)
    what = "expected a JSON array" if envelope is None else f"response has no '{envelope}' array"
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_doc").isNull(), F.lit("not valid JSON"))
        .when(~coerce.is_array(F.col("_list")), F.lit(what))
    )
    usable = F.when(coerce.is_array(F.col("_list")), F.try_variant_get("_list", "$", "array<variant>"))
    return opened.withColumns({"problem": problem, "records": usable}).drop("_doc", "_list")


def problems(opened: DataFrame) -> DataFrame:
    """Payloads that could not be read, with the reason."""
    return opened.filter(F.col("problem").isNotNull()).select("source", "company", "payload_id", "problem")


def entries(opened: DataFrame) -> DataFrame:
    """The records, and a row without record for each payload with a ``problem``:
    both from one reading of the payload."""
    when = [F.col(LANDED)] if LANDED in opened.columns else []
    exploded = opened.select(
        "source", "company", "payload_id", "kind", *when, "problem", F.posexplode_outer("records").alias("record_pos", "record")
    )
    return exploded.filter(coerce.is_object(F.col("record")) | F.col("problem").isNotNull())


def records(opened: DataFrame) -> DataFrame:
    """One row per record that is an object, with its place in the payload.

    The outer form keeps the planner from parsing each payload once more, just
    to see whether it has records; unreadable payloads give a null record.
    """
    exploded = opened.select(
        "source", "company", "payload_id", "kind", F.posexplode_outer("records").alias("record_pos", "record")
    )
    return exploded.filter(coerce.is_object(F.col("record")))
