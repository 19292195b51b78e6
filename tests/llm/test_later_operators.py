"""Manifest, filter audit and sharding against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import random
import zlib
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from driftwell.llm import filter_audit, manifest, sharding
from driftwell.llm.places import with_positions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(5)


# 11: Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(said(v) for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root of the digests and, for each, its siblings left and right at every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def manifest_rows(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf(*r), r))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: climb([x[1] for x in sorted(by[v], key=lambda x: x[:2])]) for v in langs}
    root, upper = climb([trees[v][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for (_, d, r), path in zip(sorted(by[v], key=lambda x: x[:2]), trees[v][1], strict=True):
            path = path + upper[k]
            again = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                again = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for a, b in path:
                again = sha(a + again + b)
            out.append((r[0], d, trees[v][0], root, sha("".join(a + b for a, b in path)), again, again == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {"en": 700, "de": 65, None: 8, "": 1, "é": 64, "z": 3}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(None if rng.random() < 0.02 else rng.randrange(500), rng.choice([None, "", "Öl x", "AbC" * rng.randint(0, 400), "lower"]), v, rng.choice([None, "", "s:1"]), rng.choice([None, 3])) for v, n in sizes.items() for _ in range(n)]
    rows += rows[:2]  # wholly equal rows are leaves each
    d = table(spark, rows).withColumn("tree", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("lo", F.lit(0))
    assert sorted((tuple(r) for r in manifest.drill(d).collect()), key=repr) == manifest_rows(rows)


def test_manifest_nodes_cover_their_children(spark):
    rows = [(k, f"t{k}", "en" if k % 3 else None, "s", k) for k in range(1000)]
    nodes = manifest.manifest(table(spark, rows)).collect()
    for v, n in (("en", 666), (None, 334)):
        mine = [r for r in nodes if r.lang == v]
        for level in range(max(r.level for r in mine) + 1):
            spans = sorted((r.lo, r.hi) for r in mine if r.level == level)
            assert [a for a, _ in spans] == list(range(0, n, 8**level)) and [b for _, b in spans] == [min(n, a + 8**level) for a, _ in spans]


def test_manifest_of_nothing(spark):
    d = table(spark, [], SCHEMA)
    assert manifest.drill(d).count() == 0 and manifest.manifest(d).count() == 0


def test_no_text_goes_through_a_shuffle(spark):
    d = table(spark, [(k, "word " * 50, "en", "s", 1) for k in range(50)])
    assert "text" not in with_positions(d.select("doc_id"), [F.col("doc_id")]).columns
    got = with_positions(d.select(F.lit(1).alias("same")), [F.col("same")]).collect()
    assert sorted(r.position for r in got) == list(range(50))


# 12: filter audit


def fails(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    caps = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * caps > 5 * len(text)) + 8 * any(c in "#$%&*|" for c in text)


def audit_rows(docs, labels):
    marks = {}
    for i, quality, toxic in [x for x in labels if x[0] is not None]:
        a = marks.setdefault(i, [0, 0])
        a[0], a[1] = a[0] or int(quality == 1), a[1] or int(toxic == 1)
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = [(s or "", fails(t or "") + 16 * (i is not None and i > least[t or ""]), *marks.get(i, (0, 0))) for i, t, _, s, _ in docs]
    out = []
    for part in {s for s, *_ in seen}:
        mine, shapley = [x for x in seen if x[0] == part], {}
        rows = []
        for order in permutations("ABCDE"):
            gone = 0
            for step, letter in enumerate(order, 1):
                b = 1 << "ABCDE".index(letter)
                now = [x for x in mine if x[1] & b and not x[1] & gone]
                shapley[letter] = shapley.get(letter, 0) + len(now)
                again = sum(bool(x[1] & b and x[1] & gone) for x in mine)
                gone |= b
                kept = sum(not x[1] & gone for x in mine)
                rows.append((part, "".join(order), step, kept, len(now), again, sum(x[1] == b for x in mine), sum(x[2] for x in now), sum(x[3] for x in now), letter))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(4)
    long = lambda k: " ".join(f"w{j}" for j in range(k, k + 60))
    texts = [None, "", " \t", long(0), long(1), long(0).upper(), "same " * 70, "a#b " + long(5), "$ " + "same " * 60, "X" * 9, "é " * 80, long(9) + "\x0b" + "end\x0c\r"] + [long(k) for k in range(20, 30)]
    docs = [(None if rng.random() < 0.05 else rng.randrange(120), rng.choice(texts), "en", rng.choice(["a", "a", None, ""]), 1) for _ in range(300)]
    docs += docs[:5]
    labels = [(rng.randrange(150), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = table(spark, docs).withColumn("mask", F.lit(3)).withColumn("part", F.lit("x")).withColumn("n", F.lit(2)).withColumn("quality", F.lit(1))
    assert sorted(tuple(r) for r in filter_audit.audit(d, lab).collect()) == audit_rows(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    none = filter_audit.audit(table(spark, [(1, None, None, None, None)]), lab.limit(0)).collect()
    assert len(none) == 600 and sum(r.removed for r in none) == 120 and {r.shapley for r in none} == {0, 120}


def test_intervals_of_other_numbers_of_filters(spark):
    for n in (1, 2, 3, 4):
        counts = spark.createDataFrame([("p", m, 1 << m, 1, 0) for m in range(1 << n)], "part string, mask int, n long, good long, toxic long")
        got = {(r.filter_order, r.step): r for r in filter_audit.every_order(counts, "ABCD"[:n]).collect()}
        assert len(got) == len(list(permutations(range(n)))) * n
        for order in permutations(range(n)):
            gone = 0
            for step, f in enumerate(order, 1):
                r = got["".join("ABCD"[x] for x in order), step]
                assert r.removed == sum(1 << m for m in range(1 << n) if m >> f & 1 and not m & gone)
                assert r.redundant == sum(1 << m for m in range(1 << n) if m >> f & 1 and m & gone) and r.unique_fails == 1 << (1 << f)
                gone |= 1 << f
                assert r.kept == sum(1 << m for m in range(1 << n) if not m & gone)


# 13: sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_is_a_hilbert_curve(spark, dims, bits):
    points = list(product(range(1 << bits), repeat=dims))
    d = spark.createDataFrame(points, ", ".join(f"x{k} int" for k in range(dims)))
    rows = d.select("*", sharding.curve_index([F.col(f"x{k}") for k in range(dims)], bits).alias("at")).collect()
    along = [tuple(r)[:-1] for r in sorted(rows, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in rows) == list(range(len(points)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(along, along[1:], strict=False))


def some_documents(n):
    rng = random.Random(n)
    rows = [(rng.randrange(-5, 400) if rng.random() < 0.97 else None, rng.choice([None, "", "ä" * rng.randint(0, 90), "word " * rng.randint(0, 2000)]), rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 9 + ["b", "é", None]), 1) for _ in range(n)]
    return rows + [(7, "same", "en", "hot", 1)] * (n // 2)  # a third of all rows are equal


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("n", [0, 3, 900])
def test_shards(spark, law, n):
    docs = some_documents(n)
    d = table(spark, docs).withColumn("shard", F.lit("x")).withColumn("position", F.lit(1)).withColumn("size", F.lit(1)).withColumn("_size", F.lit(1))
    rows = sharding.shard_documents(d, law=law).collect()
    data = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(((i, len(data(t)) + 1, zlib.crc32(data(t))) for i, t, *_ in docs), key=repr)
    shards = {k: [r for r in rows if r["shard"] == k] for k in range(16)}
    assert sum(map(len, shards.values())) == len(rows) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    if law == "rows":
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    elif rows:
        share, largest = sum(r.size for r in rows) / 16, max(r.size for r in rows)
        assert all(abs(sum(r.size for r in s) - share) <= largest for s in shards.values())
    again = sharding.shard_documents(d.repartition(3), law=law).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_cells_hold_equal_shares(spark):
    d = spark.createDataFrame([(k % 100 if k % 3 else 7, k - 500) for k in range(3000)], "v int, i_id long")
    b = sharding.cell_bounds(d, "v", 3).first()
    cell = lambda v: max([c for x, c in zip(b.bounds, b.cells, strict=True) if x <= v], default=0)
    before = lambda v: sum((k % 100 if k % 3 else 7) < v for k in range(3000))
    assert all(cell(v) == before(v) * 8 // 3000 for v in range(100))
    r = sharding.range_bounds(d, "i_id", 3).first()
    assert all(max(c for x, c in zip(r.bounds, r.cells, strict=True) if x <= v) == (v + 500) * 8 // 3000 for v in range(-500, 2500))
    ends = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "i_id long")
    assert sharding.range_bounds(ends, "i_id", 1).first().bounds == [-(2**63), 0]


def test_written_shards_prune(spark, tmp_path):
    docs = [(k, f"text {k}", ("en", "de", "fr", "es")[k * 7 % 4], f"s{k * 13 % 8}", 1) for k in range(4096)]
    d = table(spark, docs).withColumn("slot", F.lit(1)).withColumn("_id", F.lit("kept"))
    sharding.write_shards(d, str(tmp_path / "curve"), files=64)
    back = spark.read.parquet(str(tmp_path / "curve"))
    assert sorted((r.doc_id, r.text, r["_id"], r.slot) for r in back.collect()) == sorted((k, t, "kept", 1) for k, t, *_ in docs)
    files = back.groupBy(F.input_file_name().alias("f")).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("source", "lang", "doc_id") for f in (F.min, F.max)]).collect()
    met = lambda c, v: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in files) / len(files)
    assert len(files) >= 32 and met("source", "s3") < 0.5 and met("lang", "fr") < 0.6 and met("doc_id", 2000) < 0.5


# earlier operators, at scale


def test_mixing_moves_no_text(spark):
    from driftwell.llm import mixing

    d = table(spark, [(k, f"word {k}", "en", f"s{k % 3}", 1) for k in range(60)])
    plan = mixing.mix_documents(d)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("text#")] if "text#" in plan else plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(source" not in above


def test_many_spans_take_linear_time(spark):
    import time

    from driftwell.llm import pii

    took = []
    for n in (10_000, 40_000):
        d = spark.createDataFrame([(1, "mail 1.2.3.4 Öx " * n)], "doc_id long, text string")
        pii.digest(d.limit(0)).count()
        began = time.time()
        r = pii.digest(d).first()
        took.append(time.time() - began)
        assert r.n_ip == n and r.spans.endswith(f"ip:{16 * (n - 1) + 5}:{16 * (n - 1) + 12}")
    assert took[1] < 4 * took[0] + 10
    mixed = "call +1 (555) 010-2030 at 10.0.0.1, " * 700 + "x" * 2500
    out = pii.redact(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).first().text
    assert out == "call [PHONE] at [IP], " * 700 + "x" * 2500
