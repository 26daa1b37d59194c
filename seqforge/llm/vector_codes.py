"""Product quantisation of vectors: integer codebooks, and codes by partial-distance search.

A vector's components become integers, floor(SCALE x), and it is cut into PARTS equal parts. Each part has a codebook of
up to ENTRIES entries, at first the parts of the vectors with the smallest ids; each of ROUNDS rounds assigns every part
to the nearest entry and moves each entry to the floored mean of its parts.

The nearest entry is found by partial-distance search. Dimensions are taken in descending variance of the codebook, the
entries in order; of a batch of vectors a mask holds those that an entry may still win, and a vector leaves it once the
sum so far strictly exceeds its best complete distance. A distance is a sum of squares, so what leaves could not win, and
ties stay with the lower index. All arithmetic is in integers: nothing depends on the order of sums.

A round reads the vectors once; a task returns a count and sums for each part and entry. What the driver and each task
hold is the codebooks, PARTS x ENTRIES x part length integers, whatever the number of vectors. Sums travel as limbs of
LIMB bits, so those of any number of vectors are exact.

Defined cases: vectors that are null or hold null, NaN or infinite components are dropped, and so are those whose length
isn't the most common one of those that PARTS divides (ties: the longer). Components are taken as 32-bit floats. Vectors
with a null id are coded, but start no codebook; rows that share an id start one each, in order of their components;
equal rows are coded row by row. Fewer vectors than ENTRIES make smaller codebooks. An error beyond a long is the
largest long. Null labels are one label. An empty table gives an empty result. Columns other than the three that are
named are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels that are broadcast with their sums at most.
BROADCAST_LABELS = 1_000_000
#: Bits of a limb and limbs of a sum: 32-bit floats times SCALE have 141 bits at most, which leaves 38 for the rows of a task.
LIMB, LIMBS = 30, 6
#: Components up to here have squared distances that fit 64 bits for parts of up to 1024 dimensions.
_PLAIN = 1 << 25
_MOST = (1 << 63) - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of finite floats: 64-bit integers, or Python's where some don't fit."""
    y = np.floor(x.astype(np.float64) * SCALE)  # exact: SCALE is a power of two
    if not y.size or np.abs(y).max() < _PLAIN:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of book's entries for each row of x, the lower index among equals, and its squared distance."""
    kind = object if x.dtype == object or book.dtype == object else np.int64
    wide = book.astype(np.float64)
    dims = np.argsort(-wide.var(axis=0), kind="stable") if book.size else range(book.shape[1])
    columns = np.ascontiguousarray(x.T)
    best, at = np.zeros(len(x), kind), np.zeros(len(x), np.int64)
    for j in range(x.shape[1]):
        step = columns[j] - book[0, j]
        best = best + step * step
    for e in range(1, len(book)):
        left, total = np.arange(len(x)), np.zeros(len(x), kind)
        for j in dims:
            step = columns[j][left] - book[e, j]
            total = total + step * step
            may = (total <= best[left]).astype(bool)
            if not may.all():
                left, total = left[may], total[may]
            if not len(left):
                break
        won = (total < best[left]).astype(bool)
        best[left[won]], at[left[won]] = total[won], e
    return at, best


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """id, label and v (32-bit floats) of the vectors that are kept, and their length."""
    v = F.col(vector_col).cast("array<float>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))
    named = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(good)
    sizes = named.groupBy(F.size("v").alias("n")).count().where(f"n > 0 AND n % {parts} = 0")
    common = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else 0
    return named.where(F.size("v") == length), length


def _matrix(b: pa.RecordBatch, length: int) -> np.ndarray:
    v = b.column("v")
    return scaled(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), length))


def _steps(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, most):
            yield b.slice(k, most)


def _moved(found: DataFrame, books: np.ndarray) -> np.ndarray:
    """books (part, entry, position) with the entries that have parts moved to their floored means."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for b in _steps(batches):
            x = _matrix(b, parts * width)
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                at, _ = nearest(mine, books[p])
                number[p] += np.bincount(at, minlength=entries)
                if mine.dtype == object:
                    for row, e in zip(mine, at):
                        total[p, e] += row
                else:
                    sums = np.zeros((entries, width), np.int64)
                    np.add.at(sums, at, mine)
                    total[p] += sums
        rows = [(p, e, j, number[p, e], *_limbs(int(total[p, e, j]))) for p in range(parts) for e in range(entries) if number[p, e] for j in range(width)]
        cols = list(zip(*rows)) if rows else [()] * (4 + LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 3 + [pa.int64()] * (1 + LIMBS))], names=["p", "e", "j", "n", *[f"l{i}" for i in range(LIMBS)]])

    schema = "p int, e int, j int, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS))
    sums = map_batches(found.select("v"), run, schema).groupBy("p", "e", "j").agg(*[F.sum(c).alias(c) for c in ("n", *[f"l{i}" for i in range(LIMBS)])])
    new = books.copy()
    for r in sums.collect():  # parts x entries x width rows at most
        mean = sum(r[f"l{i}"] << (LIMB * i) for i in range(LIMBS)) // r["n"]
        if abs(mean) >= _PLAIN and new.dtype != object:
            new = new.astype(object)
        new[r["p"], r["e"], r["j"]] = mean
    return new


def _limbs(x: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out, x]


def codebooks(found: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The final codebooks (part, entry, position) of vectors (id, v)."""
    seeds = found.where("id IS NOT NULL").orderBy("id", "v").select("v").limit(entries).collect()
    width = length // parts
    first = scaled(np.array([r["v"] for r in seeds], np.float32).reshape(len(seeds), length))
    books = np.ascontiguousarray(first.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(seeds) else 0):
        books = _moved(found, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def encoded(found: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, codes (an index for each part) and error of vectors (id, label, v)."""
    parts, entries, width = books.shape
    if not entries:  # no vector has an id, so there is no codebook
        return found.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            x = _matrix(b, parts * width)
            got = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            codes = np.stack([g[0] for g in got], axis=1).astype(np.int32)
            error = sum(g[1].astype(object) for g in got) if len(x) else np.zeros(0, object)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), lists, pa.array([min(int(v), _MOST) for v in error], pa.int64())], names=["id", "label", "codes", "error"])

    return map_batches(found.select("id", "label", "v"), run, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """id, label, codes, error and label_error (the errors of all vectors of the label) of the vectors, and the codebooks."""
    found, length = vectors(df, id_col, vector_col, label_col, parts)
    books = codebooks(found, length, parts, entries, rounds)
    coded = cut(encoded(found, books), "codes")
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(whole.alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m, any_value(x) AS x FROM v JOIN c{r} USING (p) GROUP BY 1, 2)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT p, e, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (SELECT p, m.e AS e, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, w + 1)) AS j FROM width) GROUP BY ALL)),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n, c) AS c FROM c{r} LEFT JOIN (SELECT p, e, list(mean ORDER BY j) AS n FROM s{r} GROUP BY 1, 2) USING (p, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS i FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT len(any_value(i)) // {PARTS} AS w FROM k),
v AS MATERIALIZED (SELECT vec_id, p, i[CAST(p * w + 1 AS BIGINT) : CAST((p + 1) * w AS BIGINT)] AS x FROM k, width, range({PARTS}) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM first JOIN v USING (vec_id)),
{",".join(chr(10) + s for s in steps)},
r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r JOIN k USING (vec_id) GROUP BY 1),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS j FROM c{ROUNDS}))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h
"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}
