"""Sharding along a Hilbert curve through the metadata.

Each dimension is cut into 2**bits ranges of about equal row counts, by value (nulls first). The ranges' numbers are the
coordinates of a cell, and the cell's place on the Hilbert curve orders the rows: neighbours on the curve are neighbours
in every dimension, so a run of it spans a small box and a reader that filters by any of the dimensions skips most files by
their smallest and largest values. The curve is cut into runs whose row counts differ by one at most.

Rows of one cell are ordered by a hash of the key, then the key. A cell or value with any share of the rows is cut like
all others, since the sort key is nearly unique. Repeated rows are further ordered by size and checksum; rows equal in all of
these are interchangeable. Nulls: a null text has size 1 and checksum 0, a null key sorts first. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dyadspark.session import fan_out, materialise


def range_starts(rows: DataFrame, dimension: str, bits: int) -> list:
    """Values at which the ranges of a dimension begin, at most 2**bits - 1 of them, from the counts of all its values.

    The value counts are sorted by ranges; each task's running sums are set off by the sums of the tasks before it.
    """
    counts = rows.groupBy(F.col(dimension).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = materialise(
        counts.orderBy(F.col("value").asc_nulls_first()).withColumn("place", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("place", 33))
    totals = placed.groupBy("part").agg(F.sum("n").alias("total"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("part")
    before = totals.select(
        "part",
        (F.sum("total").over(in_order) - F.col("total")).alias("before"),
        F.sum("total").over(Window.partitionBy(F.lit(0))).alias("all"),
    )
    so_far = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("before") + F.sum("n").over(so_far) - F.col("n")
    bins = placed.join(before, "part").withColumn("bin", F.floor(first * (1 << bits) / F.col("all")))
    starts = bins.where(F.col("value").isNotNull()).groupBy("bin").agg(F.min("value").alias("start")).orderBy("bin")
    return [r.start for r in starts.collect() if r.bin > 0]


def coordinate(value: Column, starts: list) -> Column:
    """Number of range starts at or below the value; 0 for null."""
    if not starts:
        return F.lit(0)
    return F.when(value.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= value)))


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve, by Skilling's transform ("Programming the Hilbert curve", 2004).

    Every step is named inside one struct chain, so that the expression grows with the steps and not with their product.
    """
    n = len(coordinates)
    state = F.struct(*[c.cast("long").alias(f"x{i}") for i, c in enumerate(coordinates)])

    def step(q: int, i: int):
        low = q - 1

        def apply(s: Column) -> Column:
            x = [s[f"x{j}"] for j in range(n)]
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(F.lit(low))
            on = x[i].bitwiseAND(F.lit(q)) != 0
            out = list(x)
            if i == 0:
                out[0] = F.when(on, x[0].bitwiseXOR(F.lit(low))).otherwise(x[0])
            else:
                out[0] = F.when(on, x[0].bitwiseXOR(F.lit(low))).otherwise(x[0].bitwiseXOR(swap))
                out[i] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(swap))
            return F.struct(*[c.cast("long").alias(f"x{j}") for j, c in enumerate(out)])

        return apply

    def named(s: Column, f) -> Column:
        # a lambda over an array of one names the state once for each step
        return F.element_at(F.transform(F.array(s), f), 1)

    for b in range(bits - 1, 0, -1):
        for i in range(n):
            state = named(state, step(1 << b, i))

    def finish(s: Column) -> Column:
        x = [s[f"x{j}"] for j in range(n)]
        for j in range(1, n):
            x[j] = x[j].bitwiseXOR(x[j - 1])
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = F.when(x[n - 1].bitwiseAND(F.lit(1 << b)) != 0, t.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(t)
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for j in range(n):
                bit = F.shiftright(x[j].bitwiseXOR(t), b).bitwiseAND(F.lit(1))
                index = F.shiftleft(index, 1).bitwiseOR(bit)
        return index

    return named(state, finish)


def hilbert_shards(
    rows: DataFrame, dimensions: list[str], key: str, ties: list[str] = (), shards: int = 16, bits: int = 5
) -> DataFrame:
    """``rows`` with hilbert, shard (0 to shards - 1) and slot (0.. in its shard) added.

    Give only the columns to carry: they are sorted and written once. Names of the added columns must be free.
    """
    taken = {"hilbert", "shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    rows = materialise(rows)
    cells = [coordinate(F.col(d), range_starts(rows, d, bits)) for d in dimensions]
    order = ["hilbert", "_hash", F.col(key).asc_nulls_first(), *ties]
    keyed = rows.withColumns({"hilbert": hilbert_index(cells, bits), "_hash": F.xxhash64(key)})
    parts = fan_out(rows.sparkSession)
    # written once: a range sort samples, so a second run of it could cut elsewhere
    placed = materialise(
        keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()).drop("_hash")
    ).withColumns({"_part": F.shiftright("_place", 33), "_at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("_part")
    # one row for each partition of the sort
    offsets = counts.select(
        "_part", (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.col("_before") + F.col("_at")
    shard = F.expr(f"(_rank * {shards}) div _all")
    start = F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_rank", rank).withColumn("_shard", shard).withColumn("slot", F.col("_rank") - start)
        .withColumn("shard", F.col("_shard").cast("int"))
        .drop("_part", "_at", "_place", "_before", "_all", "_rank", "_shard")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in curve order; readers skip files by the dimensions' smallest and largest values."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def shard_boxes(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """The box of each shard: rows, and the smallest and largest value of each dimension."""
    bounds = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All documents in shards by language, source and length: doc_id, size, text_crc32, lang, source, n_chars, hilbert,
    shard, slot. The length is taken from the text, so rows need no ``n_chars``."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"),
    )
    return hilbert_shards(rows, ["lang", "source", "n_chars"], "doc_id", ["size", "text_crc32"], shards)
