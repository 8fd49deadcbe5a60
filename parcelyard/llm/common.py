"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words: \x20 and \x09-\x0D, which is what bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers each (some 50 MB) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

T = TypeVar("T")
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A private temporary folder stands in only where the session names none and
    runs in one process, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="parcelyard-")
    return _own_dirs[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the written table.

    The files cut the lineage and outlive lost executors. Shuffle files of the
    write go with its end, rather than when the driver collects its garbage.
    """
    spark, tidy = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(tidy, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._parcelyard_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `saved` wrote, once all that reads them is itself saved."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._parcelyard_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[tuple, object] = {}


def kept_in_worker(name: tuple, make: Callable[[], T]) -> T:
    """What `make` gives, kept from task to task of a Python worker; one thing at a time, so that stages in a row don't add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def keep_nothing() -> None:
    """Drop what an earlier stage's tasks kept, for a stage that keeps nothing of its own."""
    _kept.clear()


def by_chars(texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Lists of successive texts, each closed at so many characters; none of them if there is no text."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


def in_slices(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in lists of so many characters, or of one longer text, so that a batch is never all Python's at once."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held + sizes[end] <= most):
            held += sizes[end]
            end += 1
        yield column.slice(at, end - at).to_pylist()
        at = end


def give_back() -> None:
    """Return what Arrow holds in reserve to the system, when a task ends; its worker stays and waits beside other stages."""
    pa.default_memory_pool().release_unused()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, which the join it is handed to sorts and shuffles, and so the other side, whatever sizes Spark takes them for.

    Spark broadcasts a side unasked by a guess: an explode counts as one row
    for each that it is given, and a table's rows as its compressed files.
    """
    return df.hint("merge")


def looked_up(rows: DataFrame, wanted: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with a saved table of a few numbers a row, which is broadcast if its counted rows are few; else nothing is."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else by_shuffle(wanted), on, how)


def once(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs in which of the rows with one key (null is one) and one text (null counts as empty) a single one stays."""
    names, value = docs.columns, F.coalesce(F.col(text), F.lit(""))
    own = docs.withColumns({"_parcelyard_k": F.xxhash64(key, F.lit(0), value), "_parcelyard_h": F.xxhash64(value, F.lit(1), key)})
    on = ["_parcelyard_k", "_parcelyard_h"]
    repeats = saved(own.groupBy(on).agg(F.count(F.lit(1)).alias("_parcelyard_n")).where("_parcelyard_n > 1"), "repeats")
    if repeats.isEmpty():
        return docs
    marked = looked_up(own, repeats, on, "left")
    single = marked.where("_parcelyard_n is null").select(*names)
    return single.unionByName(marked.where("_parcelyard_n is not null").dropDuplicates(on).select(*names))
