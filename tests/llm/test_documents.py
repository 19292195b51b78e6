"""Operators over documents against brute force, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from driftwell.llm import decontaminate, jaccard_join, mixing, pii, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA).repartition(3)


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


# 4: mixing


def fill(sizes, share=1.5, cap=2):
    """Targets by capping and sharing again until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        left = share * sum(sizes.values()) - sum(capped.values())
        free = [s for s in names if s not in capped]
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if t[s] > cap * sizes[s]}
        if not over:
            return {**capped, **t}
        capped.update(over)


def test_mixing(spark):
    rng = random.Random(2)
    names = ["b", "a", None, "é", "z", "Z", "aa"]
    texts = [" ".join(["w"] * rng.randint(0, 400)) for _ in range(900)] + [None, "", " \t\n"]
    sources = [names[min(6, int(rng.expovariate(0.7)))] for _ in texts]
    d = frame(spark, texts, sources)
    rows = mixing.plan_mix(d).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    want, by = fill(sizes), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        by[s] += r.taken
    big = max(sizes, key=sizes.get)
    assert abs(by[big] - want[big]) < 0.1 * want[big]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.plan_mix(d).collect()))
    mixed = mixing.mix_documents(d)
    assert mixed.columns == [*d.columns, "_copy"] and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.plan_mix(d.limit(0)).count() == 0 and mixing.plan_mix(frame(spark, [None, ""])).count() == 2


def test_mixing_keeps_clashing_columns_and_null_ids(spark):
    d = frame(spark, [f"w{k} x" for k in range(60)] + ["y"]).withColumn("doc_id", F.when(F.col("doc_id") < 20, F.col("doc_id")))
    for c in ("_copy", "_s", "_ss", "_t", "_n", "_size", "plan", "plan_source", "size", "target"):
        d = d.withColumn(c, F.lit(c))
    mixed = mixing.mix_documents(d)
    assert mixed.columns == [*d.columns, "__copy"] and mixed.select("plan", "_copy").distinct().collect() == [("plan", "_copy")]
    by_text = {r.text: r.n for r in mixed.groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert len(set(by_text.values())) == 2  # rows without an id do not all decide alike
    assert mixing.plan_mix(d).columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]


# 10: personal data


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"[^0-9]", "", s))]
    return sum(v if k % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for k, v in enumerate(d)) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(m)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    out = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]
    return ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(out))


def test_pii(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "x.y+z@mail-1.example.org.", "a@b.c_d@e.f", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.04", "+49 (30) 1234-5678", "++1 2", "+1", "é😀", "12 34 56", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "123-45-6789", "...", "-", "0", "\n", "a" * 50]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", ", "x"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    texts += [None, "", "7" * 30000, "a" * 30000 + "@b.cc", "a." * 20000 + "@x", "1." * 20000, "a@b" + ".c" * 20000]
    d = frame(spark, texts)
    for r in pii.digest(d).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:200]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert r.n_email == want.count("email") and r.n_card == want.count("card")
    one = lambda t: pii.digest(frame(spark, [t])).first().spans
    assert one("IBAN DE89 3704 0044 0532 0130 00.") == "iban:5:32" and one("DE88370400440532013000") == ""
    assert one("her ssn is 123-45-6789") == "ssn:11:22" and one("part 123-45-6789") == ""
    assert pii.redact(frame(spark, ["mail a@b.co now", None])).orderBy("doc_id").select("text").collect()[0].text == "mail [EMAIL] now"
    assert pii.digest(d.limit(0)).count() == 0 and pii.find_spans(d).columns == [*d.columns, "spans"]


def test_pii_secrets_and_long_runs(spark):
    one = lambda t: pii.digest(frame(spark, [t])).first().spans
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert one(f'token = "{key}" x') == "secret:9:49" and one(f"see {key}") == "" and one("token = " + "a" * 40) == ""
    long = ["7" * 1_000_000 + " ssn 123-45-6789", "10.0.0.1 " * 4000, "1-" * 200_000, "a1" * 400_000 + " token"]
    got = {r.doc_id: r for r in pii.digest(frame(spark, long)).collect()}
    assert got[0].spans == "ssn:1000005:1000016" and got[1].n_ip == 4000 and got[1].spans.endswith(":35991:35999") and got[3].spans == "secret:0:800000"
    d = frame(spark, ["mail a@b.co", None]).withColumn("spans", F.lit(1)).withColumn("work", F.lit(2)).withColumn("_t", F.lit(3))
    out = pii.redact(d)
    assert out.columns == d.columns and [tuple(r) for r in out.orderBy("doc_id").select("text", "spans", "work", "_t").collect()] == [("mail [EMAIL]", 1, 2, 3), (None, 1, 2, 3)]


def test_redaction_leaves_no_tail_of_overlapping_spans(spark):
    texts = ["call +1 (555) 123-4567bob@x.com now", "from 10.0.0.0 4111 1111 1111 1111, a@b.co", "a@b.co +49 (30) 1234-5678"]
    got = [r.text for r in pii.redact(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == "call [PHONE] now" and got[2] == "[EMAIL] [PHONE]"
    assert "bob" not in got[0] and "1111" not in got[1] and got[1].endswith(", [EMAIL]")


# 7: Jaccard join


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both, a, b = len(sets[i] & sets[j]), find(ids[i]), find(ids[j])
            if sets[i] and sets[j] and a != b and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets, strict=True))


def test_jaccard_components(spark):
    rng, v = random.Random(7), vocabulary(400)
    line = " ".join(rng.choice(v) for _ in range(40))
    texts = [None, "", " \n ", "One two", "one TWO", "a b c d e", "A B C D E", "a b c d f"]
    for _ in range(6):
        base = [rng.choice(v) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(2, 40)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(v)
            texts.append(" ".join(w) + (" " + line if rng.random() < 0.3 else ""))
    texts += [line + " " + " ".join(rng.choice(v) for _ in range(rng.randint(5, 60))) for _ in range(40)] + [texts[10]] * 30 + [" ".join(rng.choice(v) for _ in range(9000))]
    ids = rng.sample(range(10_000), len(texts))
    ids[3] = ids[20]  # a repeated id ties its texts together
    d = frame(spark, texts, ids=ids)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(d).collect())
    assert got == brute_components(ids, texts)
    kept = [r.doc_id for r in jaccard_join.keep_one_of_each(d).collect()]
    assert sorted(kept) == sorted({c for _, _, c in got})
    assert jaccard_join.components(d.limit(0)).count() == 0
    null_id = d.where("text is not null").limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard_join.components(null_id).first().component_id is None


def test_jaccard_probe():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(2000):
        whole = np.unique(rng.integers(0, 2**40, rng.integers(1, 700))).astype(np.uint64)
        x, y = (np.sort(whole[rng.random(len(whole)) < rng.uniform(0.6, 1)]) for _ in range(2))
        if len(x) and len(y):
            both = len(np.intersect1d(x, y))
            assert jaccard_join.reaches(x, y) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_jaccard_long_lists(spark):
    """Texts around one long shared passage: some link, some do not, and a chain links only through its middle."""
    rng, v = random.Random(23), vocabulary(3000, 5)
    passage = [rng.choice(v) for _ in range(90)]
    texts = [" ".join(passage + [rng.choice(v) for _ in range(rng.randint(0, 40))]) for _ in range(150)]
    texts += [" ".join(passage[k : k + 60]) for k in range(0, 31, 2)]
    ids = rng.sample(range(10_000), len(texts))
    d = frame(spark, texts, ids=ids).withColumn("class", F.lit("x")).withColumn("shingles", F.lit(1)).withColumn("token", F.lit(2)).withColumn("n", F.lit(3))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(d).collect())
    assert got == brute_components(ids, texts)
    assert jaccard_join.keep_one_of_each(d).columns == d.columns


def test_jaccard_keeps_shingles_of_equal_leading_bits_apart(spark):
    d = frame(spark, ["a b c d 1430860", "a b c d 3284479", "a b c d 3284479"], ids=[1, 2, 3])
    assert {r.doc_id: r.component_id for r in jaccard_join.components(d).collect()} == {1: 1, 2: 2, 3: 2}


# 8: repeated byte strings


def test_suffix_dedup(spark):
    rng, v = random.Random(9), vocabulary(500)
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    passage, other = say(60), "é" * 150
    texts = [None, "", say(10), passage, "x" * 199, "x" * 205, other + say(20), say(50) + other]
    texts += [say(rng.randint(5, 80)) + passage[rng.randint(0, 40) :] + say(rng.randint(5, 80)) for _ in range(12)]
    texts += [texts[10]] * 3 + [say(2000), passage * 3, "y" * 200, "y" * 200]
    enc = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in enc for k in range(len(b) - 199))
    want = {}
    for i, b in enumerate(enc):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup.repeated_bytes(frame(spark, texts)).collect()}
    assert got == want
    c = suffix_dedup.COVER
    assert len({(a - b) % suffix_dedup.PERIOD for a in c.tolist() for b in c.tolist() if a != b}) == suffix_dedup.PERIOD - 1
    assert suffix_dedup.repeated_bytes(frame(spark, ["a"]).limit(0)).count() == 0


# 6: decontamination


def test_decontamination(spark):
    rng, v = random.Random(11), vocabulary(3000)
    say = lambda n: [rng.choice(v) for _ in range(n)]
    items = [say(rng.randint(12, 60)) for _ in range(30)] + [["only", "two"], ["one"]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    texts, want = [None, "", " ".join(say(5000))], {}
    for n in range(200):
        k = rng.randrange(30)
        w, edits = list(items[k]), rng.randint(0, decontaminate.allowed(len(items[k])))
        for _ in range(edits):
            p, how = rng.randrange(len(w)), rng.random()
            w[p : p + 1] = [] if how < 0.3 else ["new", w[p]] if how < 0.6 else ["new"]
        want[len(texts)] = (k, edits)
        texts.append(" ".join(say(rng.randint(0, 80)) + [x.upper() if n % 2 else x for x in w] + say(rng.randint(0, 80))))
    texts += ["they are only two of us", "only too"]
    d = frame(spark, texts)
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(d, bench).collect()}
    exact = {i for i, (_, e) in want.items() if e == 0}
    assert all((i, want[i][0]) in got for i in exact) and sum((i, k) in got for i, (k, _) in want.items()) >= 0.95 * len(want)
    assert {i for i, _ in got} <= {*want, len(texts) - 2} and (len(texts) - 2, 30) in got and all(e <= want[i][1] for (i, k), e in got.items() if i in want and k == want[i][0])
    clean = {r.doc_id for r in decontaminate.drop_leaks(d, bench).collect()}
    assert {0, 1, 2, len(texts) - 1} <= clean and not clean & exact
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), bench).count() == 0


def test_edit_distance_and_embedding():
    import numpy as np

    a = np.arange(1, 12, dtype=np.uint64)
    assert decontaminate.edits_within(a, a, 2) == 0 and decontaminate.edits_within(a, np.delete(a, 4), 2) == 1
    assert decontaminate.edits_within(a, np.insert(a, 3, 99)[:13], 2) == 1 and decontaminate.edits_within(a, a[::-1].copy(), 2) == 3
    at = decontaminate.embed(a, 0, 33)
    assert (np.diff(at, axis=0) >= 0).all() and (np.diff(at, axis=0) <= 1).all() and at.max() == len(a)
    for p, h in enumerate(a):  # the same word moves every walk alike at the same step
        assert all((at[j + 1, i] - at[j, i]) == (at[j + 1, k] - at[j, k]) for j in range(5) for i in range(11) for k in range(11) if at[j, i] == at[j, k] == p), h
    assert decontaminate.repeats_for(0.95, 0.5) == 5 and decontaminate.repeats_for(0.95, 1.0) == 1


def leaks_of(items, texts):
    """The operator's leaks of each text, without Spark."""
    ready = decontaminate.prepare(list(range(len(items))), items)
    out = []
    for _, part in decontaminate.sub_batches(texts):
        w = decontaminate.words(part)
        out += decontaminate.leaks(w.hashes, w.first, ready)
    return out, ready


def test_recall_at_the_full_edit_budget():
    rng, v = random.Random(19), vocabulary(3000)
    say = lambda n: [rng.choice(v) for _ in range(n)]
    kinds = {"drop": lambda w: [], "add": lambda w: ["new", w], "put": lambda w: ["new"], "mix": lambda w: rng.choice([[], ["new", w], ["new"]])}
    found = total = 0
    for n in (8, 10, 20, 30, 40, 60, 100, 200):
        for change in kinds.values():
            items, texts = [say(n) for _ in range(15)], []
            for item in items:
                edited = set(rng.sample(range(n), decontaminate.allowed(n)))
                texts.append(" ".join(say(50) + [x for k, w in enumerate(item) for x in (change(w) if k in edited else [w])] + say(50)))
            got, _ = leaks_of([" ".join(x) for x in items], texts)
            hit = sum(any(i == k for i, _, _ in x) for k, x in enumerate(got))
            assert hit >= 13, (n, hit)
            found, total = found + hit, total + len(items)
    assert found >= 0.98 * total


def test_decontamination_against_all_windows():
    """Every start of every text is aligned with every item; texts of few words make chance leaks and near misses."""
    rng, v = random.Random(29), vocabulary(60)
    say = lambda n: [rng.choice(v) for _ in range(n)]
    items = [say(n) for n in (8, 9, 12, 15, 25, 40, 1, 2, 5, 7)]
    texts = [say(rng.randint(0, 120)) for _ in range(60)]
    for k, t in enumerate(texts[:40]):
        w = list(items[k % len(items)])
        for _ in range(rng.randint(0, len(w) // 4)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["new", w[p]], ["new"]])
        t[5:5] = w
    got, ready = leaks_of([" ".join(x) for x in items], [" ".join(t) for t in texts])
    want = {}
    for k, t in enumerate(texts):
        (_, part), = decontaminate.sub_batches([" ".join(t)])
        h = decontaminate.words(part).hashes
        for i, s in enumerate(ready.seqs):
            e = int(decontaminate.edits_by_start(s, h).min())
            if e <= decontaminate.allowed(len(s)):
                want[k, i] = e
    have = {(k, i): e for k, x in enumerate(got) for i, _, e in x}
    assert set(have) <= set(want) and len(have) >= 0.98 * len(want) and sum(have[x] == want[x] for x in have) >= 0.98 * len(have)


def test_decontamination_keeps_clashing_columns(spark):
    d = frame(spark, ["one two", None]).withColumn("leaks", F.lit(1)).withColumn("_leaks", F.lit(2))
    kept = decontaminate.drop_leaks(d, spark.createDataFrame([(1, "two")], "item_id long, text string"))
    assert kept.columns == d.columns and [(r.doc_id, r.leaks, r._leaks) for r in kept.collect()] == [(1, 1, 2)]


# 1: toxicity


def test_toxicity(spark):
    rng, v = random.Random(13), vocabulary(600)
    bad = ["grumblesnark", "vexworth", "sludgehead"]
    texts, labels = [], []
    for k in range(240):
        w = [rng.choice(v) for _ in range(rng.choice([5, 60, 900]))]
        if k % 4 == 0:
            for _ in range(max(1, len(w) // 100)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((k, 1, int(k % 4 == 0)))
    texts += [None, "", "a grumblesnarks vexworthy", "quite harmless words"]
    d = frame(spark, texts)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, lab).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(r.predicted, i % 4 == 0) for i, r in got.items() if r.held_out and i < 240]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert got[242].predicted == 1 and got[243].predicted == 0 and got[240].score == got[241].score
    named = d.withColumn("score", F.lit("s")).withColumn("_score", F.lit(1))
    kept = toxicity.drop_toxic(named, lab)
    assert kept.columns == named.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    other = d.withColumn("source", F.col("text")).withColumn("lang", F.col("text"))
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score_documents(other, flipped).collect()} == {i: r.score for i, r in got.items()}
    one = toxicity.score_documents(d, lab.where("toxic = 0"))
    assert one.agg(F.max("predicted")).first()[0] == 0
    assert toxicity.score_documents(d.limit(0), lab).count() == 0


def test_toxicity_window_logit_against_counting():
    """A document's logit is the best mean of slot values over the words of a window and their 3- to 6-grams with both ends marked."""
    import numpy as np

    text = "one  Three\tfifteen x abcdefgh y"
    values = np.random.default_rng(3).normal(size=toxicity.SLOTS)
    (_, run), = toxicity.sub_batches([text])
    slot_of = {}
    for w in text.lower().split():
        (_, part), = toxicity.sub_batches([w])
        slots, at, _ = toxicity.features(part)
        assert (at == 0).all() and len(slots) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.NGRAMS)
        slot_of[w] = slots
    w = text.lower().split()
    want = max(np.concatenate([values[slot_of[x]] for x in w[k : k + toxicity.WINDOW]]).mean() for k in range(0, len(w), toxicity.WINDOW)) + 0.5
    assert abs(toxicity.window_logits(run, values, 0.5)[0] - want) < 1e-9


# 5: token counts


def test_token_counts(spark):
    import tiktoken

    rng, v = random.Random(17), vocabulary(300)
    texts = [" ".join(rng.choice(v) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "é😀\n\n  x's", "<|endoftext|>", "z" * 5000]
    d = frame(spark, texts)
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_vocabulary(token_counts.VOCABULARY), special_tokens={})
    lens = [len(coder.encode_ordinary(t or "")) for t in texts]
    assert coder.decode(coder.encode_ordinary(texts[-3])) == texts[-3]
    h = token_counts.histogram(d).cache()
    for r in h.collect():
        assert r.n_docs == lens.count(r.n_tokens) and r.docs_above == sum(x > r.n_tokens for x in lens) and r.tokens_above == sum(x for x in lens if x > r.n_tokens)
        assert r.tokens_total == sum(lens) and r.truncated_total == sum(min(x, r.n_tokens) for x in lens)
    for r in token_counts.at_limits(h, [1, 17, 10**9]).collect():
        assert (r.docs_over, r.truncated_total) == (sum(x > r.context for x in lens), sum(min(x, r.context) for x in lens))
    assert {r.share: r.n_tokens for r in token_counts.quantiles(h, [0.5, 1.0]).collect()} == {0.5: sorted(lens)[-(-len(lens) // 2) - 1], 1.0: max(lens)}
    assert token_counts.histogram(d.limit(0)).count() == 0
