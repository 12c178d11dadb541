"""Product codes of vectors by Lloyd's algorithm whose members stay where they are.

A vector's integer components are cut into equal parts; each part position has a codebook. Parts
live with their owner, (position, entry, salt), in one table that is bucketed by owner. The table
is a log: a part arrives at an owner, and departs when another entry becomes nearer. Each round
the owners add up their resident members (the last event of a member is its arrival), the sums of
all owners give the new codebooks, and the owners compare their members with them. Only parts
whose entry changes are written: a departure at the old owner, an arrival at the new one; that is
the next shuffle. Residents are read in place, bucket by bucket, and never shuffled or rewritten.
Salts split an entry's members among owners of at most OWNER parts, however uneven entries are.

All arithmetic is in integers, so the result doesn't depend on the order of anything. Codebooks
are positions x entries x components numbers; they and their sums are all that the driver sees.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
nor do vectors of another length than that of the smallest vec_id whose length can be cut, or with
a component of 2^14 or more in size, whose squares would leave the integers (a
label's sum beyond a long is null). Every other row is
coded, rows of one vec_id each by itself and rows without vec_id too; the first entries are the
smallest distinct vec_ids (the smallest vector of each), fewer if there are fewer; an empty table
gives no rows; a nearest entry among equals is the one of smaller index. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.tables import parts_for, shared_dir, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts at one owner, parts in a bucket of the log.
OWNER, BUCKET = 4096, 100_000
#: Integer components are smaller than this in size.
LARGEST = 1 << 26
LOG = "position int, entry int, salt int, row long, round int, part binary"
_LOG = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("row", pa.int64()), ("round", pa.int32()), ("part", pa.binary())])


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer components (int32) of the vectors that can be coded."""
    for batch in batches:
        column = batch.column("embedding")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == dim)
            values = np.floor(flat[starts[rows][:, None] + np.arange(dim)] * SCALE)
            good = (np.abs(values) < LARGEST).all(axis=1)  # false for what is no number or not finite
            whole = values[good].astype("<i4")
            picked = [batch.column(x).take(pa.array(rows[good])) for x in ("row", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(np.full(len(whole), dim, np.int32)), pa.array([x.tobytes() for x in whole], pa.binary())], names=["row", "vec_id", "label", "dim", "whole"])


def nearest_entry(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of smallest squared distance (of equals the first) and that distance, for each row of parts."""
    best, gap = np.zeros(len(parts), np.int64), None
    for k, entry in enumerate(codebook):
        here = ((parts - entry) ** 2).sum(axis=1)
        if gap is None:
            gap = here
        else:
            best[here < gap] = k
            gap = np.minimum(gap, here)
    return best, gap


def _salts(row: np.ndarray, salts: int) -> np.ndarray:
    mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(salts)).astype(np.int32)


def _events(position: np.ndarray, entry: np.ndarray, row: np.ndarray, parts: list, round_: int, salts: int) -> dict:
    return {"position": position.astype(np.int32), "entry": entry.astype(np.int32), "salt": _salts(row, salts), "row": row, "round": np.full(len(row), round_, np.int32), "part": parts}


def _batch(events: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(events[f.name], f.type) for f in _LOG], schema=_LOG)


def _first_arrivals(codebooks: np.ndarray, salts: int):
    def arrive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            whole = np.frombuffer(b"".join(batch.column("whole").to_pylist()), "<i4").reshape(len(row), -1)
            for position, part in enumerate(np.split(whole, len(codebooks), axis=1)):
                entry, _ = nearest_entry(part.astype(np.int64), codebooks[position])
                yield _batch(_events(np.full(len(row), position), entry, row, [x.tobytes() for x in part], 0, salts))

    return arrive


def residents(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of an owner's log: members whose last event brought them."""
    table = table.sort_by([("row", "ascending"), ("round", "ascending")])
    row = table["row"].to_numpy()
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    here = np.flatnonzero(last & table["part"].is_valid().to_numpy(zero_copy_only=False))
    parts = table["part"].take(pa.array(here)).to_pylist()
    return row[here], np.frombuffer(b"".join(parts), "<i4").reshape(len(here), -1) if parts else np.zeros((0, 0), "<i4")


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    row, parts = residents(table)
    total = parts.astype(np.int64).sum(axis=0) if len(row) else np.zeros(0, np.int64)
    return pa.table({"position": [key[0].as_py()], "entry": [key[1].as_py()], "members": [len(row)], "total": [total.tolist()]}, schema=pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("members", pa.int64()), ("total", pa.list_(pa.int64()))]))


def _migrants(codebooks: np.ndarray, round_: int, salts: int):
    def move(key: tuple, table: pa.Table) -> pa.Table:
        position, entry = key[0].as_py(), key[1].as_py()
        row, parts = residents(table)
        if not len(row):
            return _LOG.empty_table()
        now, _ = nearest_entry(parts.astype(np.int64), codebooks[position])
        gone = np.flatnonzero(now != entry)
        at = np.full(len(gone), position)
        leave = _events(at, np.full(len(gone), entry), row[gone], [None] * len(gone), round_, salts)
        come = _events(at, now[gone], row[gone], [x.tobytes() for x in parts[gone]], round_, salts)
        return pa.Table.from_batches([_batch(leave), _batch(come)])

    return move


def _coded(codebooks: np.ndarray):
    schema = pa.schema([("row", pa.int64()), ("position", pa.int32()), ("entry", pa.int32()), ("error", pa.int64())])

    def code(key: tuple, table: pa.Table) -> pa.Table:
        position, entry = key[0].as_py(), key[1].as_py()
        row, parts = residents(table)
        if not len(row):
            return schema.empty_table()
        error = ((parts.astype(np.int64) - codebooks[position][entry]) ** 2).sum(axis=1)
        return pa.table([pa.array(row), pa.array(np.full(len(row), position, np.int32)), pa.array(np.full(len(row), entry, np.int32)), pa.array(error)], schema=schema)

    return code


class Log:
    """The log of all owners: one table in the shared folder, bucketed by owner."""

    OWNER = ("position", "entry", "salt")

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.name = spark, buckets, f"lodeframe_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"

    def append(self, events: DataFrame) -> None:
        """The shuffle of a round: events go to their owners."""
        moved = events.repartition(self.buckets, *self.OWNER)
        moved.write.mode("append").bucketBy(self.buckets, *self.OWNER).option("path", self.path).saveAsTable(self.name)

    def owners(self):
        return self.spark.table(self.name).groupBy(*self.OWNER)

    def close(self) -> None:
        """Forgets the name; the files stay in the shared folder, like those of written()."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def updated(codebooks: np.ndarray, log: Log) -> np.ndarray:
    """Codebooks of the floors of the members' means; an entry without members stays."""
    sums = log.owners().applyInArrow(_summed, "position int, entry int, members long, total array<long>").where("members > 0")
    dim = codebooks.shape[2]
    added = sums.groupBy("position", "entry").agg(F.sum("members").alias("members"), *(F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(dim)))
    codebooks = codebooks.copy()
    for r in added.collect():  # one row an entry
        codebooks[r["position"], r["entry"]] = [r[f"t{k}"] // r["members"] for k in range(dim)]
    return codebooks


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the smallest vec_ids: (part, entry, component)."""
    ids = kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    few = kept.where(F.col("vec_id").isin([r["vec_id"] for r in ids.collect()]))
    # a repeated vec_id may have many rows: the smallest is an aggregate
    whole = _with_numbers(few).groupBy("vec_id").agg(F.min("signed").alias("signed")).orderBy("vec_id").collect()
    if not whole:  # no row has a vec_id
        whole = _with_numbers(kept).orderBy("signed").limit(entries).collect()
    return np.stack(np.split(np.array([r["signed"] for r in whole], np.int64), parts, axis=1))


def _with_numbers(kept: DataFrame) -> DataFrame:
    """The components as an array of numbers, so that vectors have an order."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x, "<i4").tolist() for x in batch.column("whole").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(values, pa.list_(pa.int32()))], names=["vec_id", "signed"])

    return kept.select("vec_id", "whole").mapInArrow(numbers, "vec_id long, signed array<int>")


def fitted_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner: int = OWNER) -> tuple[DataFrame, np.ndarray | None]:
    """vectors (vec_id, embedding, label) -> (row, vec_id, label, entries by part, error), and the codebooks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "label", "embedding").where("embedding is not null")
    label = vectors.schema["label"].dataType.simpleString()
    usable = written(rows.mapInArrow(_integers, f"row long, vec_id long, label {label}, dim int, whole binary"))
    fits = usable.where(F.col("dim") % parts == 0)
    length = fits.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "dim")).alias("first")).first()
    empty = "row long, vec_id long, label " + label + ", codes array<int>, error long"
    if not length["n"]:
        return spark.createDataFrame([], empty), None
    dim = length["first"]["dim"]
    kept = fits.where(F.col("dim") == dim)
    codebooks = first_codebooks(kept, parts, entries)
    count = kept.count()
    salts = -(-count // owner)
    log = Log(spark, parts_for(spark, count * parts, BUCKET))
    log.append(kept.mapInArrow(_first_arrivals(codebooks, salts), LOG))
    for turn in range(1, rounds + 1):
        codebooks = updated(codebooks, log)
        log.append(log.owners().applyInArrow(_migrants(codebooks, turn, salts), LOG))
    coded = log.owners().applyInArrow(_coded(codebooks), "row long, position int, entry int, error long")
    by_position = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"])
    found = written(coded.groupBy("row").agg(by_position.alias("codes"), F.sum("error").alias("error")))
    log.close()
    return kept.select("row", "vec_id", "label").join(found, "row"), codebooks


def decoded(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """codes (..., codes array<int>) with `vector`, the components that the codes stand for."""
    books = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in entry)) for entry in book)) for book in codebooks))
    one = F.transform("codes", lambda code, part: F.get(F.get(books, part), code))
    return codes.withColumn("vector", F.transform(F.flatten(one), lambda x: x / F.lit(float(SCALE))))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, owner: int = OWNER) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256."""
    coded, codebooks = fitted_codes(vectors, parts, entries, rounds, owner)
    spelt = "" if codebooks is None else ",".join(str(x) for x in codebooks.ravel().tolist())
    code = F.concat_ws("", F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")))
    coded = written(coded.select("vec_id", "label", code.alias("code"), "error"))
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(spelt.encode()).hexdigest()).alias("codebooks_sha256"))
