r"""Shards along a Hilbert curve through the metadata (operator 13), in DataFrame functions only.

Each metadata column is cut into cells of about equal numbers of rows, the cells are a point of a grid, and rows are
ordered by the point's index on the Hilbert curve. A run of that order is a compact region of the grid, so that a shard
or a file of it holds a narrow range of every column at once: readers that filter on any of them skip most files by
their footers' least and greatest values. Runs are cut into shards of equal rows or of equal bytes.

The curve is an automaton, made by ``curve_table`` from its rule: in each of its states, the corner of a cell gives one
digit of the index and the next state, from the coarsest level to the finest.

Defined cases: null values of a column are its first cell; null text has no bytes and size 1; rows of one index lie by
id, null first, then by size and checksum, and wholly equal rows are placed one after the other; a table of fewer rows
than shards leaves shards empty; an empty table gives no rows. Only the columns named are read, so other columns of any
name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.manifest import sql_crc32
from driftwell.llm.places import with_positions
from driftwell.llm.tokens import unused
from driftwell.operators.graph import cut, running_sums

SHARDS, BITS = 16, 5
DIMENSIONS = ("source", "lang", "doc_id")


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of the Hilbert curve by state * 2 ** dims + corner, states numbered from 0 as they are met.

    A state is the corner where the curve enters a cell and the axis along which it crosses it. Parts of a cell follow
    in Gray-code order, turned and mirrored so that each begins where the one before ended.
    """
    size = 1 << dims
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & (size - 1)
    gray = lambda k: k ^ (k >> 1)
    rank = {gray(k): k for k in range(size)}
    ones = lambda k: ((k ^ (k + 1)).bit_length() - 1) % dims  # noqa: E731  trailing ones
    known, digits, follow, todo = {(0, 0): 0}, [], [], [(0, 0)]
    for entry, axis in todo:  # grows while it is gone through
        for corner in range(size):
            k = rank[turn(corner ^ entry, dims - axis - 1)]
            into = 0 if k == 0 else gray(2 * ((k - 1) // 2))
            along = 0 if k == 0 else ones(k - 1 if k % 2 == 0 else k)
            state = (entry ^ turn(into, axis + 1), (axis + along + 1) % dims)
            if state not in known:
                known[state] = len(known)
                todo.append(state)
            digits.append(k)
            follow.append(known[state])
    return digits, follow


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a point, one integer column of ``bits`` bits a dimension."""
    digits, follow = curve_table(len(cells))
    size, states = 1 << len(cells), max(follow) + 1
    table = F.array(*[F.lit(d * states + s) for d, s in zip(digits, follow, strict=True)])  # digit and next state in one number

    def level(seen: Column, k: Column) -> Column:
        corner = sum((F.call_function("shiftright", c.cast("int"), k).bitwiseAND(F.lit(1)) * (1 << j) for j, c in enumerate(cells)), F.lit(0))
        step = F.element_at(table, ((seen % states) * size + corner + 1).cast("int"))
        return F.floor(seen / states) * (size * states) + step

    seen = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), level)
    return F.floor(seen / states).cast("long")


def cell_bounds(values: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """One row: ``bounds``, the least value of each cell that holds any, and ``cells``, those cells' numbers.

    A value's cell is 2 ** bits times the share of rows before it, so that cells hold about equally many rows and a hot
    value fills one alone. At most 2 ** bits values are kept, however many there are.
    """
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = cut(running_sums(counts, [F.col("value").asc_nulls_first()], {"before": F.col("n")}))
    total = ranked.agg(F.sum("n").alias("total"))
    cell = F.floor(F.col("before") * (1 << bits) / F.col("total")).cast("int")
    first = ranked.crossJoin(F.broadcast(total)).where("value is not null").groupBy(cell.alias("cell")).agg(F.min("value").alias("value"))  # one row of totals
    return first.agg(F.array_sort(F.collect_list(F.struct("value", "cell"))).alias("x")).select(F.col("x.value").alias("bounds"), F.col("x.cell").alias("cells"))


def range_bounds(values: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """The same for an integer column of very many values: cells of equal width between its least and greatest value."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    cells, lo, hi = F.sequence(F.lit(0), F.lit((1 << bits) - 1)), F.col("lo").cast("decimal(30,0)"), F.col("hi").cast("decimal(30,0)")
    at = lambda k: (lo + F.ceil((hi - lo + 1) * k / (1 << bits))).cast("long")
    return ends.select(F.transform(cells, at).alias("bounds"), cells.alias("cells"))


def cell_of(value: Column, bounds: Column, cells: Column) -> Column:
    """The cell of a value: that of the last bound not above it; null and what is under the first bound: 0."""
    at = F.size(F.filter(bounds, lambda b: b <= value))
    return F.when(at > 0, F.element_at(cells, at)).otherwise(0)


def along_curve(rows: DataFrame, dims=DIMENSIONS, bits: int = BITS, name: str = "curve") -> DataFrame:
    """Adds the Hilbert index of the columns ``dims``; integers of name ``*_id`` are cut by width, others by rank."""
    kinds = dict(rows.dtypes)
    for k, c in enumerate(dims):
        values = rows.select(F.col(c).alias("v"))
        wide = kinds[c] in ("bigint", "int") and c.endswith("_id")
        bounds = (range_bounds if wide else cell_bounds)(values, "v", bits)
        rows = rows.crossJoin(F.broadcast(bounds.select(F.struct("bounds", "cells").alias(f"_b{k}"))))  # one row of at most 2 ** bits values
    point = [cell_of(F.col(c), F.col(f"_b{k}.bounds"), F.col(f"_b{k}.cells")) for k, c in enumerate(dims)]
    rows = rows.withColumn("_point", F.array(*point))
    index = curve_index([F.col("_point")[k] for k in range(len(dims))], bits)
    return rows.withColumn(name, index).drop("_point", *[f"_b{k}" for k in range(len(dims))])


def assign(rows: DataFrame, order: list[Column], shards: int = SHARDS, law: str = "rows", size: str = "size") -> DataFrame:
    """Adds shard and slot to the rows, cut into runs of ``order``.

    Law ``rows``: shard k has the positions from k * n / shards up, so counts are at most one apart. Law ``bytes``: a row
    goes where the middle of its bytes falls, so that a shard's bytes are off by less than its largest rows.
    """
    placed = with_positions(rows, order)
    if law == "rows":
        n = placed.agg(F.count("*").alias("n"))
        shard = F.floor(F.col("position") * shards / F.col("n"))
        out = placed.crossJoin(F.broadcast(n)).withColumn("shard", shard.cast("int"))  # one row
        return out.withColumn("slot", F.col("position") - F.ceil(F.col("shard") * F.col("n") / shards)).drop("n", "position")
    if law != "bytes":
        raise ValueError("law is rows or bytes")
    placed = cut(running_sums(placed, [F.col("position")], {"before": F.col(size)}))
    total = placed.agg(F.sum(size).alias("total"))
    shard = F.floor((F.col("before") * 2 + F.col(size)) * shards / (F.col("total") * 2))
    out = cut(placed.crossJoin(F.broadcast(total)).withColumn("shard", shard.cast("int")))  # one row
    first = out.groupBy("shard").agg(F.min("position").alias("first"))  # a row a shard
    return out.join(F.broadcast(first), "shard").withColumn("slot", F.col("position") - F.col("first")).drop("before", "total", "first", "position")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", dims=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document; texts are read once and stay."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(*dict.fromkeys(("doc_id", *dims)), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_crc")))
    order = [F.col("_curve").asc(), F.col("doc_id").asc_nulls_first(), F.col("_size").asc(), F.col("_crc").asc()]
    out = assign(along_curve(rows, dims, bits, "_curve").select("doc_id", "_size", "_crc", "_curve"), order, shards, law, "_size")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "rows", dims=DIMENSIONS, bits: int = BITS, files: int | None = None) -> None:
    """Writes ``docs`` as Parquet in folders ``_shard=k`` (more underscores if ``docs`` has that column), rows in curve order, in about ``files`` files.

    Each file covers a short run of the curve, so its footer prunes on every one of ``dims``. Columns of any name pass
    through, those that bear the names used here included.
    """
    spark, packed = docs.sparkSession, "_packed"
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select(*[F.col(c).alias(f"_d{k}") for k, c in enumerate(dims)], F.col("doc_id").alias("_id"), size.alias("_size"), F.struct(*docs.columns).alias(packed))
    keys = {f"_d{k}" if not c.endswith("_id") else f"_d{k}_id": F.col(f"_d{k}") for k, c in enumerate(dims)}
    rows = rows.select("_id", "_size", packed, *[c.alias(k) for k, c in keys.items()])
    placed = assign(along_curve(rows, tuple(keys), bits, "_curve"), [F.col("_curve").asc(), F.col("_id").asc_nulls_first(), F.col("_size").asc()], shards, law, "_size")
    n = files or max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = placed.select("shard", "slot", packed).repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    folder = unused(docs, "_shard")
    out.select(F.col("shard").alias(folder), f"{packed}.*").write.partitionBy(folder).parquet(path)


def _sql_curve(cells: list[str], bits: int = BITS) -> str:
    digits, follow = curve_table(len(cells))
    size, states = 1 << len(cells), max(follow) + 1
    table = [d * states + s for d, s in zip(digits, follow, strict=True)]
    corner = " + ".join(f"(({c} >> k) & 1) * {1 << j}" for j, c in enumerate(cells))
    return f"list_reduce({list(range(bits - 1, -1, -1))}::BIGINT[], lambda x, k: (x // {states}) * {size * states} + ({table}::BIGINT[])[(x % {states}) * {size} + {corner} + 1], 0::BIGINT) // {states}"


_rank = lambda c: f"(SELECT {c} AS v, {1 << BITS} * coalesce(sum(count(*)) OVER (ORDER BY {c} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // (SELECT count(*) FROM documents) AS cell FROM documents GROUP BY {c})"
ORACLE = f"""
WITH e AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents),
d AS (SELECT doc_id, coalesce(text, '') AS t, s.cell AS s, l.cell AS l, coalesce((doc_id - lo) * {1 << BITS} // (hi - lo + 1), 0) AS i FROM documents, e,
      {_rank("source")} s, {_rank("lang")} l WHERE s.v IS NOT DISTINCT FROM source AND l.v IS NOT DISTINCT FROM lang),
c AS (SELECT doc_id, strlen(t)::BIGINT + 1 AS size, {sql_crc32("list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)")} AS text_crc32, {_sql_curve(["s", "l", "i"])} AS curve FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32) - 1 AS position, count(*) OVER () AS n FROM c)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * {SHARDS} // n)::INT AS shard, position - (((position * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS}) AS slot, NULL::INT AS grown_shard FROM p
"""
