"""N-gram Jaccard join by T-occurrence (operator 7): documents whose shingle sets overlap enough are linked.

A pair with 100 * |x & y| >= 75 * |x | y| shares at least ceil(75 |x| / 100) shingles of x, so the T-occurrence problem
"in at least T of x's inverted lists" has its lists split as DivideSkip does: the rare shingles of x, |x| - T + 1 of
them, are its short lists and the rest its long ones. Every partner of x is in a short list of both. Short lists are
merged in sorted order, which gives candidates; each candidate is then probed by binary search in the other's whole
set, and the probe stops once the required overlap is reached or out of reach.

How it spreads:

1. Each document becomes (class, n): class is a 64-bit hash of the whole set and its size, so exact copies fall together
   and each is sent once by a map task. Sets are written once as compressed sorted arrays of 64-bit shingle hashes.
2. How common a shingle is comes from a count over all documents, folded to a table of fixed size (2^24 slots of one
   byte, the largest log2 count in the slot). Any fixed order of shingles keeps the join exact; this one puts common
   shingles last, so shared passages are long lists and never merged.
3. Short lists are dealt by shingle, with each class's size and the shingle's place in its order. Two classes that meet
   first at places i and j share min(|x| - i, |y| - j) shingles at most; pairs that this or their sizes rule out go.
   Lists of up to ``SMALL_LIST`` classes give all other pairs, longer ones only those with their middle class. Very
   common shingles (2^``HOT_LEVEL`` documents or more) are dealt in as many parts as keep a part near that size.
4. Candidates are probed on the 64-bit sets; those that reach the threshold are links, and links make components.
   Of the longer lists only those whose classes are still in different components are met again: their pairs across
   components, under the same bounds, in blocks of ``BLOCK`` classes. A group of near copies is one component by then and
   costs one probe a class; no pair inside it becomes a row.

Two different shingles share a 64-bit hash with probability 2^-64, and so do the sets of two classes; a false link needs
that inside one candidate pair.

Defined cases: null, empty or white-space texts have no shingles and link with nothing (component: their own id); fewer
than five words make one shingle; a null doc_id takes no part in links and has a null component; rows that repeat a
doc_id are linked by each of their texts; an empty table gives no rows; texts are read whole; other columns, whatever
their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.blobs import bucket_edges, pack_small, pack_sorted, rows_by_key, unpack_small, unpack_sorted
from driftwell.llm.tokens import mix, shingles, sub_batches, words
from driftwell.operators.graph import connected_components, cut

PERCENT = 75
KEY_BITS = 40
LEVEL_BITS = 24
SMALL_LIST = 4
HOT_LEVEL = 12
BLOCK = 2048
FLUSH = 3_000_000
_U = np.uint64


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _class_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set and its size."""
    place = np.arange(1, len(s) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s + place)) + _U(len(s))], _U)).view(np.int64)[0])


def required(na, nb):
    """The least overlap of sets of these sizes that reaches the threshold."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def shingle_sets(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class, n, shingles): the packed set only with the first document of a class in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            cls, sizes, packed = [], [], []
            known = ids.is_valid().to_pylist()
            for _, part in sub_batches(texts):
                for s in shingles(words(part), n):
                    c = _class_of(s) if len(s) and known[len(cls)] else None
                    cls.append(c)
                    sizes.append(len(s))
                    packed.append(pack_sorted(s) if c is not None and c not in seen else None)
                    seen.add(c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "class", "n", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, class long, n long, shingles binary")


def _levels(sets: DataFrame) -> np.ndarray:
    """The fixed-size table of how common shingles are: 2^LEVEL_BITS bytes, whatever the corpus."""
    nb = _buckets(sets.sparkSession)

    def send(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held) >> _U(64 - KEY_BITS), return_counts=True)
            edges = bucket_edges(keys, nb, KEY_BITS)
            full = [k for k in range(nb) if edges[k + 1] > edges[k]]
            cols = [pa.array(full, pa.int32()), pa.array([pack_sorted(keys[edges[k] : edges[k + 1]]) for k in full], pa.binary()), pa.array([pack_small(counts[edges[k] : edges[k + 1]]) for k in full], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["bucket", "keys", "counts"])

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(unpack_sorted(x))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches):
        for _, parts in rows_by_key(batches):
            keys, counts = np.concatenate([unpack_sorted(p[0]) for p in parts]), np.concatenate([unpack_small(p[1]) for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
            level = np.floor(np.log2(np.add.reduceat(counts, starts))).astype(np.uint8)
            many = level >= 2
            slot, level = (keys[starts][many] >> _U(KEY_BITS - LEVEL_BITS)).astype(np.int64), level[many]
            order = np.lexsort((level, slot))
            slot, level = slot[order], level[order]
            last = np.flatnonzero(np.diff(slot, append=-1) != 0)
            yield pa.RecordBatch.from_arrays([pa.array([pack_sorted(slot[last].astype(_U))], pa.binary()), pa.array([pack_small(level[last])], pa.binary())], names=["slots", "levels"])

    sent = sets.select("shingles").mapInArrow(send, "bucket int, keys binary, counts binary").repartition(nb, "bucket").sortWithinPartitions("bucket")
    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    for r in sent.mapInArrow(count, "slots binary, levels binary").collect():  # at most one byte or two a slot, however large the corpus
        slot = unpack_sorted(r.slots).astype(np.int64)
        table[slot] = np.maximum(table[slot], unpack_small(r.levels).astype(np.uint8))
    return table


def _fits(na, pa_, nb, pb):
    """Whether sizes and the places of a shared shingle leave room for the required overlap, if it is the first shared one."""
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= required(na, nb))


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def _pairs_of_lists(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs inside lists that start at ``starts`` and have few members."""
    left, right = [], []
    for m in range(2, SMALL_LIST + 1):
        i, j = np.triu_indices(m, 1)
        s = starts[lens == m]
        left.append((s[:, None] + i).ravel())
        right.append((s[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _merged_lists(sets: DataFrame, levels: np.ndarray) -> DataFrame:
    """What merging the short lists gives: candidate pairs (a, b), and for longer lists (token, members array of (class, n, place))."""
    spark = sets.sparkSession
    nb, table = _buckets(spark), spark.sparkContext.broadcast(levels)

    def send(batches):
        tokens, owner, places, salts, classes, sizes, held = [], [], [], [], [], [], 0

        def flush():
            t, o, p, g = np.concatenate(tokens), np.concatenate(owner), np.concatenate(places), np.concatenate(salts)
            order = np.lexsort((t, g))
            t, o, p, g = t[order], o[order], p[order], g[order]
            c, s = np.array(classes, np.int64), np.array(sizes, np.int64)
            rows = []
            for salt in np.unique(g).tolist():
                first = int(np.searchsorted(g, salt))
                edges = first + bucket_edges(t[first : np.searchsorted(g, salt, "right")], nb, KEY_BITS)
                for k in range(nb):
                    lo, hi = edges[k], edges[k + 1]
                    if hi > lo:
                        mine, local = np.unique(o[lo:hi], return_inverse=True)
                        rows.append((salt * nb + k, pack_sorted(t[lo:hi]), pack_small(local), pack_small(p[lo:hi]), c[mine].tobytes(), pack_small(s[mine])))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[1:]]], names=["bucket", "tokens", "owner", "places", "classes", "sizes"])

        for b in batches:
            for cls, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = unpack_sorted(x)
                short = len(s) - -(-PERCENT * len(s) // 100) + 1
                level = table.value[(s >> _U(64 - LEVEL_BITS)).astype(np.int64)]
                rare = np.argsort(level, kind="stable")[:short]
                tokens.append(s[rare] >> _U(64 - KEY_BITS))
                level = level[rare].astype(np.int64)
                salts.append(np.where(level < HOT_LEVEL, 0, 1 + (cls & 0xFFFFFF) % (1 << np.clip(level - HOT_LEVEL, 0, 20))))
                owner.append(np.full(short, len(classes)))
                places.append(np.arange(short))
                classes.append(cls)
                sizes.append(len(s))
                held += short
                if held >= FLUSH:
                    yield flush()
                    tokens, owner, places, salts, classes, sizes, held = [], [], [], [], [], [], 0
        if classes:
            yield flush()

    def merge(batches):
        for bucket, parts in rows_by_key(batches):
            t, c, n, p = [], [], [], []
            for tokens, owner, places, classes, sizes in parts:
                local = unpack_small(owner)
                t.append(unpack_sorted(tokens))
                c.append(np.frombuffer(classes, np.int64)[local])
                n.append(unpack_small(sizes)[local])
                p.append(unpack_small(places))
            t, c, n, p = (np.concatenate(x) for x in (t, c, n, p))
            order = np.lexsort((p, c, t))  # the merge of sorted lists: equal shingles stand together
            t, c, n, p = t[order], c[order], n[order], p[order]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, n, p = t[fresh], c[fresh], n[fresh], p[fresh]
            order = np.lexsort((c, p, t))
            t, c, n, p = t[order], c[order], n[order], p[order]
            starts = np.flatnonzero(np.diff(t, prepend=~t[:1]) != 0)
            lens = np.diff(np.append(starts, len(t)))
            long = (lens > SMALL_LIST) | (bucket >= nb)  # a part of a very long list is long however few it holds
            i, j = _pairs_of_lists(starts[~long], lens[~long])
            # the class with the fewest rarer shingles comes first: of a group of near copies the one in the middle, in all their lists
            many = lens[long] - 1
            first = np.repeat(starts[long], many)
            other = first + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i, j = np.concatenate([i, first]), np.concatenate([j, other])
            good = _fits(n[i], p[i], n[j], p[j])
            a, b = _distinct_pairs(c[i[good]], c[j[good]])
            for lo in range(0, len(a), 50_000):
                part = slice(lo, lo + 50_000)
                m = len(a[part])
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.nulls(m, pa.int64()), pa.nulls(m, kind)], names=names)
            at, size = starts[long], lens[long]
            for block in np.array_split(np.arange(len(at)), max(1, int(size.sum()) // 100_000)):
                if len(block):
                    s = size[block]
                    take = np.repeat(at[block], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                    one = pa.StructArray.from_arrays([pa.array(c[take]), pa.array(n[take]), pa.array(p[take])], names=["class", "n", "place"])
                    members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(s)]), pa.int32()), one)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(block), pa.int64()), pa.nulls(len(block), pa.int64()), pa.array(t[at[block]].astype(np.int64)), members], names=names)

    names, kind = ["a", "b", "token", "members"], pa.list_(pa.struct([("class", pa.int64()), ("n", pa.int64()), ("place", pa.int64())]))
    sent = sets.select("class", "shingles").mapInArrow(send, "bucket int, tokens binary, owner binary, places binary, classes binary, sizes binary")
    return sent.repartition(nb, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "a long, b long, token long, members array<struct<class:long,n:long,place:long>>")


def _wanted(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of the given classes, one row a class; a bitmap of fixed size (2^LEVEL_BITS bits) spares most others the join."""
    named = cut(classes.distinct())
    h = F.pmod("class", F.lit(1 << LEVEL_BITS)) + 1
    parts = named.groupBy(F.bitmap_bucket_number(h).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).collect()
    bitmap = np.zeros((1 << LEVEL_BITS) // 8, np.uint8)
    for r in parts:
        bitmap[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    packed = sets.sparkSession.sparkContext.broadcast(bitmap)

    def may_be_named(batches):
        for b in batches:
            slot = (b.column(0).to_numpy(zero_copy_only=False).view(_U) & _U((1 << LEVEL_BITS) - 1)).astype(np.int64)
            yield b.filter(pa.array((packed.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))

    few = sets.mapInArrow(may_be_named, sets.schema).join(named, "class", "left_semi")
    return cut(few.groupBy("class").agg(F.first("shingles").alias("shingles")), fresh=True, placed=True)


def reaches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold, by binary probes of the smaller one in the larger."""
    if len(x) > len(y):
        x, y = y, x
    need, both, at = required(len(x), len(y)), 0, 0
    for part in np.array_split(x, max(1, len(x) // 256)):  # stops when the overlap is reached or out of reach
        spot = np.searchsorted(y, part)
        both += int((y[np.minimum(spot, len(y) - 1)] == part).sum())
        at += len(part)
        if both >= need or both + len(x) - at < need:
            break
    return both >= need


def probe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that reach the threshold."""

    def run(batches):
        for b in batches:
            good = [reaches(unpack_sorted(x), unpack_sorted(y)) for x, y in zip(b.column(2), b.column(3), strict=True) for x, y in [(x.as_py(), y.as_py())]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = _wanted(sets, pairs.select(F.explode(F.array("a", "b")).alias("class")))
    left = found.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = found.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    # the sets lie dealt by class: only the pairs move, and then with the set of one end
    return right.join(pairs.hint("shuffle_hash"), "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(member: DataFrame) -> DataFrame:
    """Pairs (a, b) worth a probe from classes of one list in different components; ``member``: token, n_list, class, n, place, component."""
    nb = _buckets(member.sparkSession)
    blocks = F.ceil(F.col("n_list") / BLOCK).cast("int")
    rows = member.withColumn("mine", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "class", "n", "place", "component")

    def work(lo, hi, group):
        mine, cls, n, place, comp = (np.array(x, np.int64) for x in zip(*group, strict=True))
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        out = []
        for part in np.array_split(left, max(1, len(left) * len(right) // 2_000_000)):
            i, j = part[:, None], right[None, :]
            x, y = np.nonzero(_fits(n[i], place[i], n[j], place[j]) & (comp[i] != comp[j]))
            out.append((cls[part[x]], cls[right[y]]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def run(batches):
        key, group, a, b = None, [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def give():
            x, y = _distinct_pairs(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            for *k, mine, cls, n, place, comp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if group:
                        x, y = work(*key[1:], group)
                        a.append(x)
                        b.append(y)
                    if sum(map(len, a)) > FLUSH // 4:
                        yield give()
                        a, b = [], []
                        a.append(np.zeros(0, np.int64))
                        b.append(np.zeros(0, np.int64))
                    key, group = k, []
                group.append((mine, cls, n, place, comp))
        if group:
            x, y = work(*key[1:], group)
            a.append(x)
            b.append(y)
        yield give()

    dealt = rows.repartition(nb, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def class_links(docs: DataFrame, n: int = 5, **cols) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, class, n; components of linked classes as class, component)."""
    rows = cut(shingle_sets(docs, n, **cols))
    sets = rows.where("shingles is not null").select("class", "shingles")
    lists = cut(_merged_lists(sets, _levels(sets)), fresh=True)
    pairs = cut(lists.where("a is not null").select("a", "b").distinct(), fresh=True)
    parts = connected_components(probe(pairs, sets), "a", "b").select(F.col("node").alias("class"), "component")
    # what is left: classes of one long list in different components
    member = lists.where("token is not null").select("token", F.explode("members").alias("m")).select("token", "m.*")
    member = member.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = member.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n_list")).where("lo < hi").select("token", "n_list")
    more = cut(_across(member.join(mixed, "token")).join(pairs, ["a", "b"], "left_anti"), fresh=True)
    if not more.isEmpty():
        ends = probe(more, sets)
        for k in ("a", "b"):
            ends = ends.join(parts.select(F.col("class").alias(k), F.col("component").alias("to")), k, "left").withColumn(k, F.coalesce("to", k)).drop("to")
        merged = connected_components(ends, "a", "b")
        # a component that merges takes its new name, and so does a class that had no link before
        parts = parts.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("class", F.coalesce("to", "component").alias("component"))
        parts = cut(parts.unionByName(merged.select(F.col("node").alias("class"), "component").join(parts.select("class"), "class", "left_anti")))
    return rows.select("doc_id", "class", "n"), parts


def components(docs: DataFrame, n: int = 5, **cols) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    rows, parts = class_links(docs, n, **cols)
    known = rows.where("doc_id is not null and class is not null")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(classes.join(smallest, "component").select("class", "component_id"))
    # rows that repeat a doc_id tie the components of their texts together
    many = known.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("doc_id")
    ties = cut(known.join(many, "doc_id", "left_semi").join(named, "class").select("doc_id", "component_id"))
    if not ties.isEmpty():
        ties = ties.groupBy("doc_id").agg(F.min("component_id").alias("low")).join(ties, "doc_id")
        merged = connected_components(ties, "low", "component_id").select(F.col("node").alias("component_id"), F.col("component").alias("to"))
        named = named.join(merged, "component_id", "left").select("class", F.coalesce("to", "component_id").alias("component_id"))
    out = rows.join(named, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5) -> DataFrame:
    """One document of each component, that of the smallest doc_id; columns as they were.

    Documents without shingles or without an id link with nothing and stay. Of rows that repeat a doc_id the smallest stays.
    """
    found = cut(components(docs, n))
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS g FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, b AS to_node FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.to_node = e.a),
k AS (SELECT node, least(node, min(to_node)) AS component FROM r GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(k.component, c.rep, d.doc_id) AS component_id FROM d LEFT JOIN c ON d.s = c.s LEFT JOIN k ON k.node = c.rep
"""
