"""What the text operators share: words, split of rows by a documented hash, tables in the shared folder."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


#: Folders of local sessions without the setting, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a new folder of its own; on a cluster that is an error, since
    no folder of one machine would do.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="railbeam-shared-")
    return _own_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return posixpath.join(shared_folder(spark), "railbeam", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` in the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing will read it again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        if "/railbeam/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null and for blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later expressions name them."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.withColumn("_once", F.explode(F.array(row))).select(*df.columns, *[F.col(f"_once.{name}").alias(name) for name in columns])


def spread(text: Column, pieces: int, width: int) -> Column:
    """A sample of a text that reaches all its places: the whole text up to ``pieces`` times ``width`` characters,
    else one piece of ``width`` characters at a hashed place of each of ``pieces`` equal parts, blanks between."""
    part = F.floor(F.length(text) / pieces).cast("int")

    def piece(k: Column) -> Column:
        start = k * part + F.pmod(F.xxhash64(text, k), part - width + 1).cast("int") + 1
        return F.substring(text, start, F.lit(width))

    pieces_of = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), piece), " ")
    return F.when(F.length(text) > pieces * width, pieces_of).otherwise(text)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fold(doc_id: int | None, parts: int) -> int:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def packed_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case. ``bytes`` lower-cases and splits ASCII alone."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that others can't clash: ``own=theirs``."""
    return df.select(*[df[theirs].alias(own) for own, theirs in columns.items()])
