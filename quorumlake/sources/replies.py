"""A data source over saved replies of a literature service: searches page by page and fetched records, read by ranges of files.

Each line is a JSON object: of a search {"query", "retstart", "reply"}, the reply
being the service's JSON text; of a fetch {"ids", "reply"}, the reply being the
service's XML text.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "saved_replies"
SCHEMAS = {"search": "query string, retstart long, total long, position long, pmid string, error string", "fetch": "pmid string, found boolean, raw string, error string"}
#: The column by which a kind's lines are chosen before their replies are parsed.
CHOOSING = {"search": "query", "fetch": "pmid"}
#: Bytes of a file in a partition.
RANGE = 8 << 20
#: The elements of a reply that are records, and the one that names a record.
RECORD = re.compile(r"<(PubmedArticle|PubmedBookArticle)[ >].*?</\1>", re.DOTALL)
RECORD_ID = re.compile(r"<PMID[^>]*>\s*(\d+)\s*</PMID>")


@dataclass
class Lines(InputPartition):
    """The lines of a file that begin in low <= place < high."""

    path: str
    low: int
    high: int


def search_rows(line: dict) -> Iterator[tuple]:
    """The ids of a page with their places in the whole result; a reply that is none, or an error, is one row that says so."""
    query, start = line.get("query"), int(line.get("retstart") or 0)
    try:
        got = json.loads(line["reply"])["esearchresult"]
        if error := got.get("ERROR") or got.get("error"):
            raise ValueError(f"service: {error}")
        total, ids = got["count"], got["idlist"]
        if not (isinstance(total, str) and total.isascii() and total.isdigit() and isinstance(ids, list) and all(isinstance(x, str) and x.isascii() and x.isdigit() for x in ids)):
            raise ValueError("count and ids are strings of digits")
        if int(got.get("retstart", start)) != start:
            raise ValueError("another page than was asked for")
    except (KeyError, TypeError, ValueError) as e:
        yield query, start, None, None, None, f"{type(e).__name__}: {e}"[:200]
        return
    for k, x in enumerate(ids):
        yield query, start, int(total), start + k, x, None
    if not ids:
        yield query, start, int(total), None, None, None


def fetch_rows(line: dict, only: set[str] | None = None) -> Iterator[tuple]:
    """A row for each id asked for: its record, or that the service has none; records that were not asked for are left out."""
    ids = list(dict.fromkeys(map(str, line.get("ids") or [])))
    reply = line.get("reply")
    if not isinstance(reply, str) or "</PubmedArticleSet>" not in reply and not reply.rstrip().endswith("<PubmedArticleSet/>"):
        yield from ((i, False, None, "no complete reply") for i in ids if only is None or i in only)
        return
    records = {}
    for m in RECORD.finditer(reply):
        if own := RECORD_ID.search(m[0]):
            records.setdefault(own[1], m[0])
    yield from ((i, i in records, records.get(i), None) for i in ids if only is None or i in only)


class RepliesReader(DataSourceReader):
    def __init__(self, kind: str, path: str, size: int):
        self.kind, self.path, self.size = kind, path, size
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of the choosing column are kept to here; all others go back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (CHOOSING[self.kind],):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[Lines]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if self.only is not None and not self.only:
            return []
        found = [x for x in files.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        return [Lines(x.path, low, min(low + self.size, x.size)) for x in sorted(found, key=lambda x: x.path) for low in range(0, x.size, self.size)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        names = [x.split()[0] for x in SCHEMAS[self.kind].split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        types = [kinds[x.split()[1]] for x in SCHEMAS[self.kind].split(", ")]
        held: list[tuple] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), types)], names)

        with io.BufferedReader(files.open_input_file(partition.path), 1 << 20) as f:
            f.seek(max(partition.low - 1, 0))
            # A line that begins before the range is the partition's before; so is what is left of it.
            if partition.low:
                f.readline()
            while f.tell() < partition.high and (raw := f.readline()):
                if not raw.strip():
                    continue
                try:
                    line = json.loads(raw)
                    if not isinstance(line, dict):
                        raise ValueError("not an object")
                except ValueError as e:
                    line = None
                    held.append((None,) * (len(names) - 1) + (f"line at {partition.path}: {e}"[:200],))
                if line is not None and self.kind == "search":
                    if self.only is None or line.get("query") in self.only:
                        held += search_rows(line)
                elif line is not None:
                    held += fetch_rows(line, self.only)
                if len(held) >= 4096:
                    yield full()
                    held.clear()
        if held:
            yield full()


class SavedReplies(DataSource):
    """format("saved_replies"), options kind (search or fetch), path and range (bytes of a file in a partition)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "search")]

    def reader(self, schema) -> RepliesReader:
        return RepliesReader(self.options.get("kind", "search"), self.options["path"], int(self.options.get("range", RANGE)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedReplies)


def saved_replies(spark: SparkSession, path: str, kind: str, size: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("kind", kind).option("range", size).load(path)


def whole_results(pages: DataFrame) -> DataFrame:
    """query, total, ids in order and status of each search from its pages: OK, FAILED (an error in any page), MOVED (pages disagree on the total) or TORN (places are missing).

    The same page may have been saved more than once; ids of one place must agree.
    """
    each = pages.groupBy("query").agg(
        F.min("total").alias("total"), F.max("total").alias("_most"), F.count("error").alias("_errors"), F.count_distinct("position").alias("_places"), F.count_distinct("position", "pmid").alias("_pairs"),
        F.max("position").alias("_last"), F.array_sort(F.collect_set(F.when(F.col("pmid").isNotNull(), F.struct("position", "pmid")))).alias("_ids"),
    )
    status = F.when(F.col("_errors") > 0, "FAILED").when((F.col("total") != F.col("_most")) | (F.col("_pairs") != F.col("_places")), "MOVED").when(F.coalesce(F.col("_last") + 1, F.lit(0)) != F.col("_places"), "TORN").otherwise("OK")
    return each.select("query", "total", F.when(status == "OK", F.transform("_ids", lambda x: x["pmid"])).alias("ids"), status.alias("status"))


def still_to_fetch(wanted: DataFrame, records: DataFrame, absent: DataFrame, now: str, keep: str = "30 days") -> DataFrame:
    """Distinct ids (pmid) of wanted that are neither among the records nor known to be absent: an absence counts for a time, then it is asked for again.

    absent: pmid, asked_at.
    """
    known = records.select("pmid").unionByName(absent.filter(F.expr(f"asked_at + INTERVAL {keep} > TIMESTAMP '{now}'")).select("pmid"))
    return wanted.select("pmid").filter("pmid IS NOT NULL").distinct().join(known.distinct(), "pmid", "left_anti")


def settled_fetches(rows: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(records, absences) of fetched rows: one record for each id, the longest where replies differ; ids that no complete reply had."""
    best = rows.filter("found").groupBy("pmid").agg(F.max_by("raw", F.struct(F.length("raw"), "raw")).alias("raw"))
    whole = rows.withColumn("_any", F.max(F.col("found")).over(Window.partitionBy("pmid")))
    gone = whole.filter(~F.col("_any") & F.col("error").isNull()).select("pmid", F.lit(now).cast("timestamp").alias("asked_at")).distinct()
    return best, gone
