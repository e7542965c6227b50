"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to integers, each row gets its index on the Hilbert
curve through that grid, rows are sorted by the index and runs of the order become
shards. Neighbours on the curve differ by one step in one dimension, so every shard
covers a compact box of the metadata space and file statistics prune on each dimension.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def curve_steps(n: int) -> list[int]:
    """Transitions of the ``n``-dimensional Hilbert curve, by state and cell.

    A state is the entry corner ``e`` and direction ``d`` of a sub-cube; the cell holds
    one bit of each dimension. An entry packs the cell's place along the curve (low
    ``n`` bits) and the state of the sub-cube entered there. Derived from the Gray code:
    place ``w`` is entered at corner gray(2*floor((w-1)/2)), along the axis given by the
    trailing ones of ``w`` or ``w-1``.
    """
    size, mask = 1 << n, (1 << n) - 1

    def left(x: int, k: int) -> int:
        return ((x << k % n) | (x >> (n - k % n))) & mask

    def place(gray: int) -> int:
        return reduce(lambda w, k: w ^ (gray >> k), range(1, n), gray)

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    def step(e: int, d: int, cell: int) -> int:
        w = place(left(cell ^ e, n - (d + 1) % n))
        even = 2 * ((w - 1) // 2) if w else 0
        e2 = e ^ left(even ^ (even >> 1), d + 1)
        turn = 0 if w == 0 else trailing_ones(w if w & 1 else w - 1)
        return ((e2 * n + (d + turn % n + 1) % n) << n) | w

    return [step(e, d, cell) for e in range(size) for d in range(n) for cell in range(size)]


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a point whose coordinates are in [0, 2**bits)."""
    n = len(dims)
    if n * bits > 62:
        raise ValueError("dimensions times bits must be at most 62")
    table = F.array(*[F.lit(x) for x in curve_steps(n)])
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"), table.alias("t"), *[d.cast("int").alias(f"x{i}") for i, d in enumerate(dims)])

    def step(acc: Column, bit: Column) -> Column:
        cell = reduce(lambda a, b: a + b, [F.pmod(F.floor(acc[f"x{i}"] / F.pow(F.lit(2.0), bit)), F.lit(2)) * (1 << i) for i in range(n)])
        packed = F.element_at(acc["t"], (acc["s"] * (1 << n) + cell + 1).cast("int"))
        return F.struct(
            (acc["h"] * (1 << n) + packed.bitwiseAND((1 << n) - 1)).alias("h"),
            F.shiftright(packed, n).alias("s"),
            acc["t"].alias("t"),
            *[acc[f"x{i}"].alias(f"x{i}") for i in range(n)],
        )

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def numeric_bin(df: DataFrame, value: Column, bits: int) -> Column:
    """Logarithmic bins of equal width between the table's least and largest value; null and negative values go to bin 0.

    Two numbers reach the driver.
    """
    top, scale = 1 << bits, F.log2(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)
    low, high = df.agg(F.min(scale), F.max(scale)).first()
    if low is None or low == high:
        return F.lit(0)
    return F.least(F.lit(top - 1), F.floor((scale - low) / (high - low) * top)).cast("int")


def with_ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``__rank`` (from 0) in the given order, and ``__total``, the number of rows.

    Rows are range-partitioned and sorted once; each partition's first rank is the prefix
    sum of the counts before it, a table of one row per partition.
    """
    n = shared.partitions(df.sparkSession)
    # partition number and row number within it, kept in a written table so that a lost task cannot number anew
    placed = shared.materialize(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__place", 33))
        .withColumn("__row", F.col("__place").bitwiseAND((1 << 33) - 1))
        .drop("__place"),
        "order",
    )
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    return placed.join(F.broadcast(bases), "__part").withColumn("__rank", F.col("__base") + F.col("__row")).drop("__part", "__row", "__base")


def category_bin(df: DataFrame, column: str, bits: int) -> Column:
    """The value's rank among the column's n distinct values, spread over the bins: (rank + 1) * 2**bits // (n + 1); null: bin 0.

    So values keep their order however many there are. Spread ranks differ in their high
    bits, which part the curve first. The least value of each bin, at most 2**bits, reach the driver.
    """
    room = 1 << bits
    values = with_ranks(df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct(), [F.col("v")])
    bins = values.groupBy(F.expr(f"CAST((__rank + 1) * {room} DIV (__total + 1) AS INT)").alias("bin")).agg(F.min("v").alias("v"))
    found = sorted((r["bin"], r["v"]) for r in bins.collect())
    if not found:
        return F.lit(0)
    firsts, numbers = (F.array(*[F.lit(x) for x in side]) for side in ([v for _, v in found], [b for b, _ in found]))
    at = F.size(F.filter(firsts, lambda v: v <= F.col(column)))
    return F.when(F.col(column).isNull(), 0).otherwise(F.get(numbers, at - 1)).cast("int")


def cut_runs(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Add ``__shard`` and ``__slot``: runs of the order whose row counts differ by one at most."""
    ranked = with_ranks(df, [F.col(c).asc_nulls_first() for c in order])
    return (
        ranked.withColumn("__shard", F.expr(f"CAST(__rank * {shards} DIV __total AS INT)"))
        .withColumn("__slot", F.col("__rank") - F.expr(f"(CAST(__shard AS BIGINT) * __total + {shards - 1}) DIV {shards}"))
        .drop("__total", "__rank")
    )


def _on_curve(docs: DataFrame, bits: int, columns: list[str]) -> DataFrame:
    """``columns`` with size (UTF-8 bytes plus one, a null text has none), text_crc32 and hilbert."""
    text = shared.text_or_empty()
    rows = docs.select(
        *columns,
        (F.octet_length(text) + 1).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).cast("long").alias("__crc"),
    )
    dims = [category_bin(docs, "source", bits), category_bin(docs, "lang", bits), numeric_bin(rows, F.col("__size"), bits)]
    return rows.withColumn("__hilbert", hilbert_index(dims, bits))


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 8) -> DataFrame:
    """One row per document: doc_id, source, lang, size, text_crc32, hilbert, shard, slot.

    Dimensions: source, lang and size. Rows that tie on the curve follow doc_id, then the
    text's checksum; null ids come first. Repeated rows each get a slot; texts of any
    length count by their size. An empty table gives no rows. Other columns of ``docs`` are
    ignored.
    """
    rows = _on_curve(docs, bits, ["doc_id", "source", "lang"])
    placed = cut_runs(rows, ["__hilbert", "doc_id", "__crc"], shards)
    return placed.withColumnsRenamed({"__size": "size", "__crc": "text_crc32", "__hilbert": "hilbert", "__shard": "shard", "__slot": "slot"})


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = 8) -> None:
    """Write whole documents as one folder of Parquet files per shard, in curve order.

    All columns but ``shard`` are those of ``docs``; a column of that name is replaced.
    Whole rows are sorted once and cut where they lie, so rows of null or repeated ids are
    written as they are. An empty table writes no shard.
    """
    rows = cut_runs(_on_curve(docs, bits, [c for c in docs.columns if c != "shard"]), ["__hilbert", "doc_id", "__crc"], shards)
    n = shared.partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    ordered.select(*[c for c in docs.columns if c != "shard"], F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(path)
