"""Substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words of one document; a word goes if a window over it
also starts in a document with a smaller id. Documents come in batches of rising
ids. Windows of a batch are hashed (64-bit key), cut into buckets by key and
packed: a chunk of documents sends one binary row a bucket. In a bucket the
batch's windows are sorted and merge-joined with the sorted immutable runs of
earlier batches; equal keys are verified by an independent second hash over the
words (16 bits, so equality rests on 80 bits and the bucket's own), since texts
of history needn't be kept. The answer goes back as a bitmap a chunk and bucket,
and the new windows become a run. Runs of similar size are compacted: merged into one run
that supersedes them. A run is a committed Parquet table with one file a bucket
in the shared folder, so a lost executor or driver leaves a usable index.

A window that repeats a million times is one key in one bucket: its copies are
packed integers, and earlier batches hold it once. Buckets and chunks follow the number of
documents, so what a task holds doesn't grow with the data.

Defined cases: a null or empty text has no words and an empty kept text. A null id
counts as larger than all others; rows of one id don't remove each other's words.
An empty batch leaves the index as it is. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, ensure_checkpoint_dir, shared_path

WINDOW = 13
#: Documents of a chunk, documents a bucket (some 500 windows each), and words remembered in a worker.
CHUNK_DOCS, BUCKET_DOCS, LEAST_BUCKETS, VOCABULARY = 1000, 8000, 48, 1_000_000
#: Batches of the query, and runs of one level that are merged into one of the next.
BATCHES, FAN_IN = 4, 2

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(docs: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, checks, counts): of all windows in order, and the number of windows of each document."""
    sizes = np.array([len(d) for d in docs], np.int64)
    counts = np.maximum(0, sizes - window + 1)
    total = int(sizes.sum())
    if not counts.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), counts
    look = _WORDS.__getitem__
    h = np.fromiter((look(w) for d in docs for w in d), np.uint64, total)
    g = _mix(h + _B2)
    n = total - window + 1
    key, check = h[:n].copy(), g[:n].copy()
    for j in range(1, window):
        key *= _B1
        key += h[j : n + j]
        check *= _B2
        check += g[j : n + j]
    # Windows that begin in the last words of a document would reach into the next.
    ends = np.repeat(np.cumsum(sizes), sizes)[:n]
    inside = np.arange(n) + window <= ends
    return _mix(key[inside]), (_mix(check[inside]) >> np.uint64(48)).astype(np.uint16), counts


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and bounds of each bucket in it."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _sorted_docs(table: pa.Table) -> list[tuple[int, bytes]]:
    """(id, text) by id; equal ids by text, so that every pass sees one order."""
    return sorted(zip(table.column("_id").to_pylist(), (t or b"" for t in table.column("_text").to_pylist())))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes: the high planes hardly change."""
    return zstandard.compress(np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def _unique(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, check) in order."""
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return keys[new], checks[new]


def _held(keys: np.ndarray, checks: np.ndarray, run: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (key, check) of sorted input the sorted run holds: a merge join by galloping search, verified by the check."""
    run_keys, run_checks = run
    found = np.zeros(len(keys), bool)
    at, last = np.searchsorted(run_keys, keys), np.searchsorted(run_keys, keys, "right")
    while (open_ := np.flatnonzero((at < last) & ~found)).size:
        found[open_] = run_checks[at[open_]] == checks[open_]
        at[open_] += 1
    return found


def _read_runs(runs: list[str], bucket: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for path in runs:
        fs, where = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{where}/bucket={bucket}", allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    table = pq.ParquetFile(f).read(columns=["chunk", "keys", "checks"])
                for chunk, keys, checks in zip(*(c.to_pylist() for c in table.columns)):
                    if chunk is None:
                        out.append((unpack_sorted(keys), np.frombuffer(zstandard.decompress(checks), np.uint16)))
    return out


def _first_seen(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted (keys, checks), the smallest id of each, and each input window's place among them."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if (~new[1:] & (c[1:] != c[:-1])).any():  # equal keys of different words
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[starts], c[starts], np.minimum.reduceat(ids[order], starts), place


class FingerprintIndex:
    """Runs in one folder: ``run-LEVEL-FIRST-LAST`` holds the windows of batches FIRST to LAST.

    A run whose range lies in another's is superseded. The folder alone is the state.
    """

    def __init__(self, spark, path: str, buckets: int, window: int = WINDOW, fan_in: int = FAN_IN):
        self.spark, self.path, self.buckets, self.window, self.fan_in = spark, path.rstrip("/"), buckets, window, fan_in

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where, jvm

    def runs(self) -> list[tuple[int, int, int, str]]:
        """(level, first, last, path) of the live, committed runs."""
        fs, where, jvm = self._fs()
        if not fs.exists(where):
            return []
        found = []
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.startswith("run-") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                level, first, last = map(int, name[4:].split("-"))
                found.append((level, first, last, f"{self.path}/{name}"))
        inside = lambda a, b: a != b and b[1] <= a[1] and a[2] <= b[2] and (b[2] - b[1], b[0]) > (a[2] - a[1], a[0])
        return sorted((r for r in found if not any(inside(r, s) for s in found)), key=lambda r: r[1])

    def compact(self) -> None:
        """Merge the newest FAN_IN runs while they are of one level; each merge is a table of its own, then the old go."""
        while len(newest := self.runs()[-self.fan_in :]) == self.fan_in and len({r[0] for r in newest}) == 1:
            target = f"{self.path}/run-{newest[0][0] + 1}-{newest[0][1]}-{newest[-1][2]}"
            paths = [r[3] for r in newest]

            def merge(batches):
                for batch in batches:
                    for bucket in batch.column(0).to_pylist():
                        held = _read_runs(paths, bucket)
                        if held:
                            keys, checks = _unique(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                            yield _run_row(bucket, keys, checks)

            every = self.spark.range(0, self.buckets, 1, min(self.buckets, 200)).select(F.col("id").cast("int").alias("bucket"))
            every.mapInArrow(merge, _REDUCED).write.mode("overwrite").partitionBy("bucket").parquet(target)
            fs, _, jvm = self._fs()
            for p in paths:
                fs.delete(jvm.org.apache.hadoop.fs.Path(p), True)

    def add(self, docs: DataFrame, id_col: str, text_col: str, chunks: int, out_schema: str, finish) -> DataFrame:
        """Merge-join a batch of larger ids than before with the index and append its run.

        ``finish(words, removed)`` gives a document's output columns from its words and the mask
        of covered words. Returns the id, then these columns.
        """
        self.compact()
        live = self.runs()
        number = live[-1][2] + 1 if live else 0
        id_field = docs.schema[id_col]
        top = F.lit(2**63 - 1)
        keyed = docs.select(
            F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("chunk"),
            F.coalesce(F.col(id_col).cast("long"), top).alias("_id"),
            as_bytes(text_col).alias("_text"),
        ).repartition("chunk")
        buckets, window, paths = self.buckets, self.window, [r[3] for r in live]

        def send(table: pa.Table) -> pa.Table:
            rows = _sorted_docs(table)
            keys, checks, counts = window_hashes([t.split() for _, t in rows], window)
            order, bounds = _by_bucket(keys, buckets)
            owner = np.repeat(np.arange(len(rows)), counts)[order]
            keys, checks, ids = keys[order], checks[order], np.array([i for i, _ in rows], np.int64)
            out = {n: [] for n in ("chunk", "bucket", "keys", "checks", "ids", "counts")}
            chunk = table.column("chunk")[0].as_py()
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[b], bounds[b + 1])
                present, n = np.unique(owner[part], return_counts=True)
                values = (chunk, b, keys[part].tobytes(), checks[part].tobytes(), zstandard.compress(np.diff(ids[present], prepend=0).tobytes(), 1), zstandard.compress(n.astype(np.uint32).tobytes(), 1))
                for k, v in zip(out, values):
                    out[k].append(v)
            return pa.table([pa.array(v, type=t) for v, t in zip(out.values(), [pa.int32(), pa.int32()] + [pa.binary()] * 4)], names=list(out))

        def meet(table: pa.Table) -> pa.Table:
            """All windows of the batch in one bucket against the runs."""
            parts = sorted(zip(*(table.column(n).to_pylist() for n in ("chunk", "keys", "checks", "ids", "counts"))))
            bucket = table.column("bucket")[0].as_py()
            keys = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
            checks = np.concatenate([np.frombuffer(p[2], np.uint16) for p in parts])
            unpack = lambda x, t: np.frombuffer(zstandard.decompress(x), t)
            ids = np.concatenate([np.repeat(np.cumsum(unpack(p[3], np.int64)), unpack(p[4], np.uint32)) for p in parts])
            distinct, distinct_checks, least, place = _first_seen(keys, checks, ids)
            old = np.zeros(len(distinct), bool)
            for run in _read_runs(paths, bucket):
                old |= _held(distinct, distinct_checks, run)
            repeated = old[place] | (ids > least[place])
            cuts = np.cumsum([0] + [len(p[1]) // 8 for p in parts])
            bitmaps = [zstandard.compress(np.packbits(repeated[a:b]).tobytes(), 1) for a, b in zip(cuts, cuts[1:])]
            rows = pa.RecordBatch.from_arrays(
                [pa.array([bucket] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array(bitmaps, pa.binary()), pa.array([None] * len(parts), pa.binary())],
                names=["bucket", "chunk", "keys", "checks"],
            )
            return pa.Table.from_batches([rows, _run_row(bucket, distinct[~old], distinct_checks[~old])])

        packed = keyed.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, keys binary, checks binary, ids binary, counts binary")
        target = f"{self.path}/run-0-{number}-{number}"
        packed.groupBy("bucket").applyInArrow(meet, _REDUCED).write.mode("overwrite").partitionBy("bucket").parquet(target)
        added = T.StructType.fromDDL(out_schema)
        out_types = [pa.int64(), *(_arrow(f.dataType) for f in added.fields)]
        names = ["_id", *added.names]

        def apply(docs_table: pa.Table, marks: pa.Table) -> pa.Table:
            rows = _sorted_docs(docs_table)
            words = [t.split() for _, t in rows]
            keys, _, counts = window_hashes(words, window)
            flags = np.zeros(len(keys), bool)
            order, bounds = _by_bucket(keys, buckets)
            for bucket, bits in zip(marks.column("bucket").to_pylist(), marks.column("keys").to_pylist()):
                part = order[bounds[bucket] : bounds[bucket + 1]]
                flags[part] = np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8), count=len(part)).astype(bool)
            ends = np.cumsum(counts)
            found = []
            for (_, _), w, end, n in zip(rows, words, ends.tolist(), counts.tolist()):
                covered = np.zeros(len(w) + 1, np.int32)
                if n and (hit := np.flatnonzero(flags[end - n : end])).size:
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + window, -1)
                found.append(finish(w, np.cumsum(covered)[:-1] > 0))
            columns = [[i for i, _ in rows], *(list(c) for c in zip(*found))]
            return pa.table([pa.array(c, type=t) for c, t in zip(columns, out_types)], names=names)

        marks = self.spark.read.schema("chunk int, keys binary, checks binary, bucket int").parquet(target).where("chunk is not null").select("chunk", "bucket", "keys")
        schema = T.StructType([T.StructField("_id", T.LongType()), *added.fields])
        done = keyed.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(apply, schema)
        return done.select(F.when(F.col("_id") != top, F.col("_id")).cast(id_field.dataType).alias(id_col), *added.names)


_REDUCED = "bucket int, chunk int, keys binary, checks binary"


def _run_row(bucket: int, keys: np.ndarray, checks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([None], pa.int32()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([zstandard.compress(np.ascontiguousarray(checks).tobytes(), 1)], pa.binary())],
        names=["bucket", "chunk", "keys", "checks"],
    )


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def deduplicate(docs: DataFrame, out_schema: str, finish, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, window: int = WINDOW) -> DataFrame:
    """Feed a table to a new index in batches of rising ids; returns id and the columns of ``finish``.

    Each batch's result is written to the shared folder before the next begins.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    base = shared_path(spark, "fingerprints")
    fractions = [k / batches for k in range(1, batches)]
    rows, bounds = docs.agg(F.count("*"), F.percentile_approx(F.col(id_col).cast("long"), fractions, 10_000) if fractions else F.lit(None)).first()
    index = FingerprintIndex(spark, f"{base}/index", max(LEAST_BUCKETS, -(-rows // BUCKET_DOCS)), window)
    bounds = sorted(set(bounds or []))
    ranges = list(zip([None, *bounds], [*bounds, None]))
    parts = []
    for number, (low, high) in enumerate(ranges):
        batch = docs
        if low is not None:
            batch = batch.where((F.col(id_col) > low) | F.col(id_col).isNull() if high is None else F.col(id_col) > low)
        if high is not None:
            batch = batch.where(F.col(id_col) <= high)
        chunks = max(1, -(-rows // (len(ranges) * CHUNK_DOCS)))
        parts.append(f"{base}/out-{number}")
        index.add(batch, id_col, text_col, chunks, out_schema, finish).write.parquet(parts[-1])
        _release(spark)
    return spark.read.parquet(*parts)


def _release(spark) -> None:
    """Let Spark drop the finished batch's shuffle files now and not when memory happens to run short."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _digest(words: list[bytes], removed: np.ndarray) -> tuple[int, int, str]:
    kept = [w for w, r in zip(words, removed.tolist()) if not r] if removed.any() else words
    return len(words), int(removed.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def _texts(words: list[bytes], removed: np.ndarray) -> tuple[int, int, str]:
    return len(words), int(removed.sum()), b" ".join([w for w, r in zip(words, removed.tolist()) if not r]).decode("utf-8", "replace")


def kept_texts(docs: DataFrame, **options) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (text)."""
    return deduplicate(docs, "n_words long, n_removed long, kept string", _texts, **options)


def op10(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs, "n_words long, n_removed long, kept_sha256 string", _digest)


OP10_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + {WINDOW}), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS p FROM words WHERE len(w) >= {WINDOW})),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p
  FROM windows JOIN firsts USING (s) WHERE first < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words),
kept AS (
  SELECT doc_id, count(g.p) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY p), '')) AS kept_sha256
  FROM places LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
