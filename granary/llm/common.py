"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only
    where both are unset and all runs in this process (local tests) a temporary folder is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not jvm_dir.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jvm_dir.get()


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: it cuts the lineage, survives lost executors and
    lets later plans read single columns. The files go when the session's process ends, with drop_stored(), or with
    forget()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/granary-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path and (df.sparkSession, path) in _TABLES:
            _TABLES.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


@atexit.register
def drop_stored() -> None:
    """Deletes what stored() has written; queries that still read it fail afterwards."""
    while _TABLES:
        try:
            _delete(*_TABLES.pop())
        except Exception:  # the session has ended, and with it the way to reach the files
            return


#: A key that more than one of so many rows have is hot.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """rows joined with table, which has one row for each key; `size` is the number of rows of the key, `total` that of
    all rows. The table's rows of hot keys, fewer than HOT_SHARE, go to every task, so that no key's rows must meet in
    one; the others are joined by a shuffle."""
    hot = F.broadcast(table.where(size * HOT_SHARE > total))
    others = rows.join(hot.select(key), key, "left_anti").join(table.where(size * HOT_SHARE <= total), key)
    return rows.join(hot, key).unionByName(others)


def arrow_schema(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, fields: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow with a state that make() builds once for each task; its result maps a batch to columns."""
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out = None, to_arrow(schema)
        for batch in batches:
            f = f or make()
            cols = f(batch)
            yield pa.RecordBatch.from_arrays([v if isinstance(v := cols[x.name], pa.Array) and v.type == x.type else pa.array(v, type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fields: str, make: Callable[[], Callable[[pa.Table], dict]], partitions: int | None = None) -> DataFrame:
    """Sorted rows of one key at a time, without a call from the JVM for each group. Whoever calls this bounds the
    rows of a key."""
    schema, cols = arrow_schema(fields), [F.col(x) for x in keys]
    dealt = df.repartition(partitions, *cols) if partitions else df.repartition(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held, last, out, made = None, [], None, to_arrow(schema), {x.name: [] for x in schema}

        def close() -> int:
            for k, v in f(pa.Table.from_batches(held)).items():
                made[k].extend(v)
            held.clear()
            return len(made[out.names[0]])

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(made[x.name], type=x.type) for x in out], schema=out)
            for v in made.values():
                v.clear()
            return b

        for batch in batches:
            if not batch.num_rows:
                continue
            f = f or make()
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if held and rows[a] != last and close() >= 5000:
                    yield flush()
                held.append(batch.slice(a, b - a))
                last = rows[a]
        if held:
            close()
            yield flush()

    return dealt.sortWithinPartitions(*cols).mapInArrow(run, schema)


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == n * width:
        return flat.reshape(n, width)
    lengths, out = np.array([len(x) for x in column.to_pylist()]), np.zeros((n, width))
    ends = np.cumsum(lengths)
    for i, (b, k) in enumerate(zip(ends, lengths, strict=True)):
        out[i, :k] = flat[b - k : b]
    return out


def sound_vectors(df: DataFrame, id_col: str, vec_col: str, zero_too: bool) -> DataFrame:
    """(id, vec): rows with an id whose vector has only finite components, and if not zero_too one other than zero.
    Of rows that repeat an id, the smallest vector in array order stays."""
    v = F.col(vec_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero_too:
        good &= F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


#: Multiplier of the byte hash and its inverse modulo 2^64; any odd number does.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 16, 2 * len(_POWERS[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes stand in a shingle by a digest; words of a text that are hashed at once.
LONG_WORD, SLICE = 64, 100_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: runs of `words` words of the lower-cased text, split at ASCII
    white space. A text of fewer words has one shingle of all its words, a text without words none. Long texts are hashed
    in slices that overlap by all but one word of a shingle, so memory is bounded."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not parts:
        return np.zeros(0, np.uint64)
    if max(map(len, parts)) > LONG_WORD:
        parts = [p if len(p) <= LONG_WORD else b"#" + hashlib.blake2b(p, digest_size=16).digest() for p in parts]
    k = min(words, len(parts))
    if len(parts) - k < SLICE:
        return np.unique(_shingles(parts, k))
    return np.unique(np.concatenate([np.unique(_shingles(parts[a : a + SLICE + k - 1], k)) for a in range(0, len(parts) - k + 1, SLICE)]))


def _shingles(parts: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of k words. The sum of byte * base^position over a run, divided by base^start, depends on the
    run's bytes alone."""
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:], dtype=np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    a, b = starts[: len(parts) - k + 1], ends[k - 1 :]
    return mixed((sums[b] - sums[a]) * down[a])
