"""What the text operators share: reading, Python stages over Arrow batches, words."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.session import read_table

MATH_KINDS = ("display_math", "inline_math")
#: Han characters, for patterns of Python's own re.
HAN = "\u3400-\u9fff\uf900-\ufaff"
LANGS = ("en", "de", "fr", "ru", "zh")

#: A word of any script; a Chinese character is a word of its own.
WORD = regex.compile(r"\p{Han}|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|\d+")
#: The same for Java, for use inside Spark expressions.
JAVA_WORD = r"\p{IsHan}|[\p{L}\p{M}&&[^\p{IsHan}]]+|\p{N}+"


def words(text: str) -> list[str]:
    return WORD.findall(text)


def to_python(column: pa.Array) -> list:
    """The values of an Arrow column as Python's, nested ones by whole columns."""
    kind = column.type
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, v)) for v in zip(*map(to_python, column.flatten()))] if names else column.to_pylist()
        return [x if ok else None for x, ok in zip(out, column.is_valid().to_pylist())] if column.null_count else out
    if pa.types.is_list(kind):
        values, out, at = to_python(column.flatten()), [], 0
        for n in pc.list_value_length(column).to_pylist():
            out.append(None if n is None else values[at:at + n])
            at += n or 0
        return out
    if pa.types.is_string(kind) or not column.null_count and pa.types.is_primitive(kind) and not pa.types.is_temporal(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def python_stage(df: DataFrame, schema: str, rows: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """Apply ``rows`` to every row (a dict) of ``df`` in Arrow batches; what it yields are the new rows."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                out = [r for values in zip(*map(to_python, part.columns)) for r in rows(dict(zip(part.schema.names, values)))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), target)], schema=target)

    return df.mapInArrow(run, schema)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain table scan over all cores where it has fewer splits than there are cores: splits follow
    bytes, the work of a Python stage follows characters. It changes where rows are worked on, never the
    result. Only for scans; what comes out of a shuffle or a written table stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan


def candidates_of(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct candidate records; exact copies are one record. They are spread by block, so that
    the removal of copies, joins with blocks and grouping by block need no further shuffle."""
    raw = read_table(spark, directory, "candidates").select("paper", "block", "seq", "engine", "family", "content", "format", "meta")
    return raw.repartition("paper", "block").dropDuplicates(["paper", "block", "seq"])


def blocks_of(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "blocks").select("paper", "id", "page", "kind", "text", "ord").dropDuplicates(["paper", "id"])


def word_counts(texts: DataFrame, column: str = "text", *by: str) -> DataFrame:
    """(by..., word, n) over all texts, lower case. Counts are combined before the shuffle."""
    picked = texts.select(*by, F.explode(F.expr(f"regexp_extract_all(lower({column}), '{JAVA_WORD}', 0)")).alias("word"))
    return picked.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def hashed_sample(df: DataFrame, keys: list[str], at_most: int, count: int) -> DataFrame:
    """About ``at_most`` rows of ``df``, picked by the hash of their keys: no row moves for it, and
    no task sees more than its own share. ``count``: rows of ``df``, or more."""
    share = min(1.0, at_most / max(1, count))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵︀-️]")
SPACES = regex.compile(r"[\p{Zs}\t\r\n\f\v  ]+")


def plain(text: str) -> str:
    """NFKC without invisible characters and with single spaces; for comparing only."""
    if text.isascii():
        return " ".join(text.split())
    return SPACES.sub(" ", unicodedata.normalize("NFKC", INVISIBLE.sub("", text))).strip()
