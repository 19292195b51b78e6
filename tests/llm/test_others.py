"""Operators over pages, vectors and conversations, and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from driftwell.llm import html_content, nearest, preferences
from tests.conftest import SF


def test_html(spark):
    model = html_content.train(html_content.labelled_pages())
    page = (
        "<html><head><title>T</title><style>x</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-banner'><p>We use cookies.</p></div>"
        "<article><h1>Fish &amp; chips</h1><p>The  first\n paragraph of a long story about <b>fish</b> and more.<p>A second one, with &eacute; and <script>no()</script>chips in it.<ul><li>One item of the story.<li>Another item.</ul></article>"
        "<form><p>Your name please</p></form><section class='comments'><p>I liked it. Great read.</p></section><footer>&copy; us</footer></body></html>"
    )
    want = "Fish & chips\n\nThe first paragraph of a long story about fish and more.\n\nA second one, with é and chips in it.\n\nOne item of the story.\n\nAnother item."
    assert html_content.extract(page, model) == want
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>tags & <i>more"), (5, "u", "<" * 50)], "page_id long, url string, html string")
    out = html_content.main_text(rows, model=model)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.columns == ["page_id", "url", "text"] and got[1] == want and got[2] == got[3] == "" and len(got) == 5
    assert html_content.main_text(rows.limit(0), model=model).count() == 0


def test_html_without_end_of_head_and_with_math():
    model = html_content.train(html_content.labelled_pages())
    story = "<h1>Fish</h1><p>The first paragraph of a long story about fish and more.<p>A second one of the story, with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in it.</article>"
    want = "Fish\n\nThe first paragraph of a long story about fish and more.\n\nA second one of the story, with x=2 in it."
    head = "<title>T</title><meta charset=utf-8><noscript><img src=p><p>no</p></noscript><style>x</style><script>y</script>"
    for start in ("<html><head>" + head + "</head><body>", "<html><head>" + head + "<body>", "<html><head>" + head, head, "<head>" + head + "</head>", ""):
        assert html_content.extract(start + "<article class='content'>" + story, model) == want, start
    assert [t for _, _, t in html_content.parse("<head><title>T</title>A line of plain text.").texts] == ["A line of plain text."]


def test_sum_product_is_exact():
    rng = np.random.default_rng(3)
    parent, unary, pair = [-1, 0, 0, 1, 1, 2], rng.normal(size=6), rng.normal(size=(2, 2))
    total, one, joint = 0.0, np.zeros(6), np.zeros((6, 2, 2))
    for bits in range(64):
        y = [(bits >> k) & 1 for k in range(6)]
        p = np.exp(sum(unary[k] * y[k] for k in range(6)) + sum(pair[y[parent[k]], y[k]] for k in range(1, 6)))
        total += p
        one += p * np.array(y)
        for k in range(1, 6):
            joint[k, y[parent[k]], y[k]] += p
    got, both = html_content.marginals(parent, unary.tolist(), pair.tolist(), joints=True)
    assert np.allclose(got, one / total) and np.allclose(both[1:], joint[1:] / total)


def test_pages_of_the_table(spark):
    import html
    import re

    for r in html_content.main_text(spark.read.parquet(f"{SF}/pages.parquet").withColumn("h", F.col("html"))).collect():
        a = re.search(r"<article>(.*?)</article>", r.h, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", a))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16)) * 3, np.repeat(centres[:1], 60, 0)]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [1.0] * 3, 1), (None, [1.0] * 16, 1), (2100, [], 1)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {}
    for r in nearest.nearest(d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y, hit, total = x.astype(float), 0, 0
    assert set(got) == set(range(0, len(x), 20))
    for q, found in got.items():
        found.sort()
        s = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        hit += len({i for _, i, _ in found} & set(order))
        total += 20
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-12 for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
    assert hit >= 0.9 * total
    few = d.where("vec_id in (0, 1, 2, 20)")
    assert nearest.nearest(few).count() == 6 and nearest.nearest(d.limit(0)).count() == 0 and nearest.nearest(d.where("vec_id = 2000")).count() == 0


def test_nearest_shard_against_brute_force():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[:1000] = x[0]  # a third is one vector
    ids, y = np.arange(3000) * 7 - 50, x.astype(float)
    norm, k = float(np.linalg.norm(y, axis=1).max()), 5
    asked = np.arange(0, 3000, 50)
    for least, fitted in ((1, None), (0.9, (4, 3.0, 324)), (0, (4, 0.5, 30)), (0, (6, 0.75, 40)), (0.9, nearest.fit(y[::2], y[asked], norm, k, 3000))):
        shard = nearest.Shard(ids, x, norm, k, fitted)
        assert len(shard.ids) <= 2000 + k + 1
        got, hit = {q: (i, s) for q, i, s in shard.nearest(ids[asked], y[asked])}, 0
        for n in asked:
            s = (y * y[n]).sum(1)
            want = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            i, score = got[ids[n]]
            assert ids[n] not in i and len(set(i)) == k == len(i) and all(abs(s[(j + 50) // 7] - v) < 1e-12 for j, v in zip(i, score, strict=True))
            assert sorted(zip(-score, i, strict=True)) == list(zip(-score, i, strict=True))
            hit += len(set(ids[want]) & set(i))
        assert hit >= least * k * len(asked), fitted


def test_nearest_with_other_columns(spark):
    rows = [(n, [float(n % 7 + 1), float(n % 5), 1.0], "x", [0], 3, 4) for n in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v array<int>, shard int, side int")
    got = sorted(map(tuple, nearest.nearest(d, k=3).collect()))
    want = []
    for q in (0, 20):
        s = {n: sum(a * b for a, b in zip(rows[n][1], rows[q][1], strict=True)) for n in range(40) if n != q}
        want += [(q, r + 1, n, s[n]) for r, n in enumerate(sorted(s, key=lambda n: (-s[n], n))[:3])]
    assert got == want


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 1, "assistant", "bad"), (2, 2, "user", "why"), (3, 0, None, None), (None, 0, "user", "x")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(9))
    rows = preferences.format_pairs(preferences.pair_up(preferences.conversations(d))).collect()
    r = next(r for r in rows if r.chosen_id == 1)
    assert len(rows) == 2 and (r.rejected_id, r.n_prompt_turns, r.prompt) == (2, 1, "<|user|>\nhi\n<|end|>\n")
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good\n<|end|>\n"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["bad\n<|end|>\n"]
    alone = next(r for r in rows if r.chosen_id == 3)
    assert (alone.rejected_id, alone.prompt, alone.rejected, alone.n_prompt_turns) == (None, "", None, 0)
    assert preferences.digest(d.limit(0)).count() == 0
    same = preferences.format_pairs(preferences.pair_up(preferences.conversations(spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")))).first()
    assert (same.n_prompt_turns, same.chosen, same.rejected) == (1, "", "")


def test_an_odd_group_does_not_part_the_later_ones(spark):
    import hashlib

    names = sorted("abcdefg", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    sizes = dict(zip(names, (1, 2, 2, 3, 4, 2, 1), strict=True))
    prompts = [t for t in names for _ in range(sizes[t])]
    turns = [(i, 0, "user", t) for i, t in enumerate(prompts)] + [(i, 1, "assistant", f"answer {i}") for i in range(len(prompts))]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    rows = preferences.digest(d).collect()
    assert sorted(x for r in rows for x in (r.chosen_id, r.rejected_id) if x is not None) == list(range(len(prompts)))
    same = [prompts[r.chosen_id] for r in rows if r.rejected_id is not None and prompts[r.chosen_id] == prompts[r.rejected_id]]
    assert {t: same.count(t) for t in names} == {t: n // 2 for t, n in sizes.items()}
    assert all(r.n_prompt_turns == 1 for r in rows if r.rejected_id is not None and prompts[r.chosen_id] == prompts[r.rejected_id])
    assert len({r.pair_id for r in rows}) == len(rows) == 8 and sum(r.rejected_id is None for r in rows) == 1


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF).cache()
        if name != "mixing":
            assert out.columns == docs.columns and 0.5 * seen.count() < out.count() <= seen.count()
        seen = out
    assert seen.columns == [*docs.columns, "_copy"]
    assert corpus_pipeline.run(spark, SF).count() == seen.count()


def true_text(page):
    """What the marks of a labelled page say its text is."""
    tree = html_content.parse(page)
    y = [False] * len(tree.tag)
    for k in range(1, len(y)):
        y[k] = y[tree.parent[k]] if tree.marked[k] is None else tree.marked[k] == "1"
    blocks = {}
    for e, serial, t in tree.texts:
        blocks.setdefault(serial, [y[tree.block[e]], ""])[1] += t
    return "\n\n".join(x for x in (" ".join(t.split()) for keep, t in blocks.values() if keep) if x)


def test_html_on_unseen_layouts():
    from collections import Counter

    model, both, got, want = html_content.default_model(), 0, 0, 0
    for page in html_content.labelled_pages(300, seed=7):
        a, b = Counter(true_text(page).split()), Counter(html_content.extract(page, model).split())
        both, got, want = both + sum((a & b).values()), got + sum(b.values()), want + sum(a.values())
    assert both / got > 0.97 and both / want > 0.94


def test_html_plain_pages():
    model = html_content.default_model()
    story = "<p>A full paragraph of the article, which goes on for a while. It has sentences.</p>"
    want = "A full paragraph of the article, which goes on for a while. It has sentences."
    assert html_content.extract(f"<html><body><article>{story}</article></body></html>", model) == want
    assert html_content.extract(f"<article><h1>Title</h1><p class='comment-free'>{want}</p><p>And more of it here.</p></article>", model) == f"Title\n\n{want}\n\nAnd more of it here."
    box = "<div><h3>Comments</h3><div><b>Bob</b><p>I like this a lot. Thanks for it.</p></div></div><footer>Filed under news.</footer>"
    assert html_content.extract(f"<body><article><h1>Title</h1>{story * 3}{box}</article><div><h3>Subscribe</h3><p>Get our letter each week.</p></div></body>", model) == "\n\n".join(["Title", *[want] * 3])


def test_html_never_fails_and_takes_linear_time():
    import random
    import time

    model, rng = html_content.default_model(), random.Random(1)
    assert html_content.parse("<![foo[bar]]>x").texts[0][2] == "x"
    for _ in range(2000):
        page = "".join(rng.choice("<>/!-[]=\"' abpdivtableCDATA&#x;\n") for _ in range(rng.randint(0, 60))) + rng.choice(["<![", "<!", "</", "<a", "<!--", "<?x", "<![CDATA[", ""])
        assert isinstance(html_content.extract(page, model), str)
    for unit in ("<div>", "<b>", "<b><div>", "<li>", "</x><div>", "<p><b>", "<td><i>", "<div>x"):
        began = time.process_time()
        html_content.extract(unit * 30_000 + "x", model)
        assert time.process_time() - began < 20, unit
