"""Page text, vector search, and the pipeline, against brute force."""

import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import language, page_text, secret_scan, vector_search
from sieveline.llm.common import plain_words, table


def article(source):
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?p>|</?h1>", inside)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks) if x)


def test_articles_of_all_pages(spark):
    pages = table(spark, SMALL, "pages")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in page_text.extract(pages).collect()}
    assert got == want


PAGE = "<html><head><title>t</title></head><body><div class='menu'>Menu</div><p>All rights reserved here</p><div>%s</div><p>Contact us today</p><script>var a='<p>no</p>'</script></body>"


def test_shared_lines_go_and_others_stay(spark):
    rows = [(i, f"http://h.example/a/{i}", PAGE % f"Story number {i} &amp; more<br>of  it") for i in range(4)]
    rows += [(9, "http://alone.example/x", PAGE % "Single &lt;story&gt;"), (10, None, None), (11, "not a url", ""), (12, "http://h.example/a/2", rows[2][2])]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (0, 1, 3):
        assert got[i] == f"Story number {i} & more of it"
    assert got[9] == "All rights reserved here\nSingle <story>\nContact us today"
    assert got[10] == got[11] == ""


def test_copies_are_no_neighbours(spark):
    """Repeated rows, the same URL and the same page under adjacent URLs, with other furniture: each copy keeps its text."""
    rows = [(i, f"http://h.example/a/{i}", PAGE % f"Story number {i}") for i in range(4)]
    rows += [(10 + i, f"http://h.example/a/2{'x' * (i % 3)}", rows[2][2].replace("Menu", f"Menu {i}")) for i in range(20)]
    rows += [(40 + i, "http://copies.example/", PAGE % "Copied") for i in range(3)]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(4):
        assert got[i] == f"Story number {i}"
    for i in range(20):
        assert got[10 + i] == "Story number 2"
    for i in range(3):
        assert got[40 + i] == "All rights reserved here\nCopied\nContact us today"


@pytest.mark.parametrize("parts", [1, 3, 60])
def test_ranges_do_not_change_texts(spark, parts):
    """However few pages of a host a range holds, each meets its neighbours; runs of copies may fill several ranges."""
    rows = [(100 * h + i, f"http://h{h}.example/a/{i:02}", PAGE % f"Story number {min(i, 5) if h % 2 else i}") for h in range(4) for i in range(12)]
    rows += [(900, "http://one.example/", PAGE % "One")]
    keys = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = [(r.page_id, r.text) for r in page_text.extract(pages).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [(100 * h + i, f"Story number {min(i, 5) if h % 2 else i}") for h in range(4) for i in range(12)]
    assert sorted(got) == [*want, (900, "All rights reserved here\nOne\nContact us today")]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><h1>A</h1><p>b <b>c</b><br>d<p>e<aside>x</aside><section class='comments'><p>y</p></section></article><p>z", "A\nb c d\ne"),
        ("<header>Site</header><article><header><h1>T</h1></header><div class='post-header'>by</div><footer>f</footer>x</article>", "T\nby\nx"),
        ("<main><nav>n</nav><p>one</p><form>f</form><p>two</p></main><footer>q</footer>", "one\ntwo"),
        ("<p>a &copy; b&#33; &nbsp; c</p><!-- <p>d</p> --><p hidden>e</p><p>f", "a © b! c\nf"),
        ("<div class='ad-banner'>buy</div><div class='headline'>news</div><style>p{}</style><p>x<wbr>y</p>", "news\nxy"),
        ("<div><div class=notice>cookie</div>text</div></div></p>more", "text\nmore"),
        ("<p", ""),
        ("", ""),
    ],
)
def test_markup(source, want):
    assert page_text.main_text(page_text.lines_of(source), None) == want


def test_differencing_beside_markup():
    def text(source, neighbour):
        return page_text.main_text(page_text.lines_of(source), page_text.lines_of(neighbour))

    teaser = "<article>Read %s</article><p>Same on all pages</p><div>Body of page %s</div>"
    assert text(teaser % (1, 1), teaser % (2, 2)) == "Read 1\nBody of page 1"
    beside = "<main><p>Opening hours</p><p>A long story of its own, number %s</p></main><p>Beside %s</p><p>Address</p>"
    assert text(beside % (1, 1), beside % (2, 2)) == "A long story of its own, number 1\nBeside 1"
    copy = "<main><p>The same long story on two pages</p><p>Part %s</p></main>"
    assert text(copy % 1, copy % 2) == "The same long story on two pages\nPart 1"
    inside = "<article><p>The same long story</p></article><p>Address</p><p>%s</p>"
    assert text(inside % 1, inside % 2) == "The same long story\n1"


def brute_neighbour(pages, i):
    """Of the pages in the order of host and path, the nearest of its host with other lines on either side; the nearer one by path, or the first."""
    host, path, digest, _ = pages[i]
    near = []
    for side, others in ((0, range(i - 1, -1, -1)), (1, range(i + 1, len(pages)))):
        found = next((j for j in others if pages[j][0] != host or pages[j][2] != digest), None)
        if found is not None and pages[found][0] == host:
            same = sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(path, pages[found][1])))
            near.append((-same, side, found))
    return min(near)[2] if near else None


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_differencing_of_whole_pages(spark):
    """Pages whose markup tells nothing: each loses as many lines as the longest common subsequence with its nearest page has, and no others."""
    rows = [(r.page_id, r.url, re.sub(r"<(/?)(?:article|nav|footer|div)\b[^>]*>", r"<\1section>", r.html)) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    rows += [(10_000 + i, f"http://many.example/{'ab'[i % 2]}/{i:03}", f"<p>Top</p><p>Old news</p><p>{i // 3}</p><p>{i % 5} of five</p><p>Old news</p><p>End</p>") for i in range(60)]
    rows += [(20_000 + i, u, h) for i, u, h in rows[:20]]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in page_text.extract(docs.repartition(7)).collect()}
    assert len(got) == len(rows)
    lines = {i: [t for t, _ in page_text.lines_of(h)] for i, _, h in rows}
    pages = sorted((*page_text.address(u), page_text.digest_of(page_text.lines_of(h)), i) for i, u, h in rows)
    changed = 0
    for n, (*_, i) in enumerate(pages):
        other = brute_neighbour(pages, n)
        left = got[i].split("\n") if got[i] else []
        common = brute_common(lines[i], lines[pages[other][-1]]) if other is not None else 0
        assert len(left) == len(lines[i]) - common
        rest = iter(lines[i])
        assert all(x in rest for x in left)
        gone = Counter(lines[i]) - Counter(left)
        assert other is None or not gone - Counter(lines[pages[other][-1]])
        changed += bool(common)
    print(f"differencing changed {changed} of {len(rows)} pages")
    assert changed > 80


def test_common_subsequence():
    def brute(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 9))) for _ in range(2))
        found = sorted(page_text.shared_lines(a, b))
        assert len(found) == brute(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_pages_edge_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.extract(none).count() == 0


def brute_search(rows, every, top):
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted(((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q))[:top]
            out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize(("sf", "sizes"), [("sf0.001", {}), ("sf0.1", {}), ("sf0.1", {"shard_rows": 300, "query_rows": 40})])
def test_recall_of_search(spark, sf, sizes):
    """With the registered parameters, and with many shards and blocks of queries."""
    vectors = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in vectors.collect()]
    want = brute_search(rows, 20, 20)
    got: dict = {}
    for r in vector_search.search(vectors, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - exact[(q, i)]) < 1e-12 for q in got for _, i, s in got[q] if (q, i) in exact)
    assert all([n for n, _, _ in x] == list(range(1, len(x) + 1)) and all(a[2] >= b[2] for a, b in zip(x, x[1:])) for x in got.values())


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]), (40, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (9, [1.0, 2.0, 3.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.search(df).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(20, 1, 1, 2.0), (20, 2, 3, 2.0), (20, 3, 3, 2.0), (20, 4, 40, 0.0)]
    assert {q for q, *_ in got} == {20, 40} and len(got) == 8
    assert vector_search.search(df.where("vec_id = 4")).count() == 0


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SMALL, "documents").cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        kept[name] = (before, docs)
        assert docs.count() > 0
        if name != "mixture":
            assert docs.columns == before.columns
    before, after = kept["language_id"]
    assert after.count() >= 0.97 * before.count()

    before, after = kept["near_duplicates"]
    # Five words and a similarity of 0.8: what near-duplicate stages take.
    sets = {r.doc_id: frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) for r in before.collect() if (w := plain_words(r.text))}
    linked = {i: {j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    left = {r.doc_id for r in after.collect()}
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - group
            group |= new
            todo += new
        assert (i in left) == (i == min(group))

    before, after = kept["decontamination"]
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    items = [word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in table(spark, SMALL, "benchmark").collect()]
    windows = {" ".join(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        text = f" {' '.join(word.findall(re.sub('[A-Z]', lambda m: m[0].lower(), r.text)))} "
        assert (r.doc_id not in left) == any(f" {w} " in text for w in windows)

    before, after = kept["secrets"]
    assert after.count() == before.count()
    secret = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    assert not [r for r in after.collect() if secret.search(r.text)]
    clean = {r.doc_id: r.text for r in before.collect() if not re.search(r"(?i)token|secret|passw|api_?key|AKIA|[0-9a-f]{24}", r.text)}
    assert all(r.text == clean[r.doc_id] for r in after.collect() if r.doc_id in clean)

    before, after = kept["mixture"]
    sums = after.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 3 * 32 for r in sums)
    assert {r.doc_id: r.size for r in after.collect()} == {r.doc_id: len(plain_words(r.text)) for r in before.collect()}


def test_pipeline_rejects_ties_of_two_languages(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join("".join(rng.choice(list(letters), 6)) for _ in range(400)) for letters in ("abcdefgh", "ijklmnop", "qrstuvwx"))
    texts = {1: c[700:900], 2: a[700:1900], 4: b}
    tied = {"x": a.encode(), "y": a.encode(), "z": c.encode(), "w": b.encode()}
    assert language.Classifier(tied).classify(texts[2])[0] == "x" and language.Classifier(tied).classify(texts[2])[2] == 0
    two = language.Classifier({"x": a.encode(), "y": a.encode()}).classify(texts[2])
    assert two == ("x", 0.5, 0.0)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def kept(found):
        monkeypatch.setattr(corpus_pipeline.language, "fit", lambda docs: found)
        return {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SMALL).collect()}

    assert kept(tied) == {1, 4}
    assert kept({"x": a.encode(), "y": a.encode()}) == set()


@pytest.mark.parametrize("most", [500_000, 0])
def test_near_duplicates_of_repeated_ids(spark, monkeypatch, most):
    """Rows are told apart by id and text: another text under a dropped id stays, repeats and null ids are thinned, other columns are carried."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "other")
    rows = [(3, a, "x"), (5, near, "x"), (5, b, "y"), (None, a, "x"), (3, a, None), (3, a, "w"), (-4, f"{b} end", "v"), (None, c, "z"), (None, c, "z"), (7, "", "x"), (7, "", "x"), (8, None, "x")]
    docs = spark.createDataFrame([(i, t, None, s, len(t or ""), f"k{s}") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", most)
    found = corpus_pipeline.one_of_each(spark, docs, SMALL)
    assert found.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.source, r["_key"]) for r in found.collect()), key=str)
    assert got == sorted([(3, a, None, "kNone"), (-4, f"{b} end", "v", "kv"), (None, c, "z", "kz"), (7, "", "x", "kx"), (7, "", "x", "kx"), (8, None, "x", "kx")], key=str)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_edge_cases(spark, stage):
    """Nulls in every column, empty and long texts, ties and repeated rows, clashing and extra columns, and an empty table."""
    name, function = stage
    long = " ".join(f"the quiet river {i} runs" for i in range(20_000))
    rows = [(1, "the cat sat on the mat today", "en", "a", 28, "m"), (1, "the cat sat on the mat today", "en", "a", 28, "m"), (2, None, None, None, None, None), (3, "", "en", "b", 0, ""),
            (None, "password = abcdef1234 le chat", "fr", None, None, "q"), (4, long, "en", "c", len(long), "l"), (5, "1234 !!!", None, "a", 8, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.createDataFrame([(*r[:5], r[5]) for r in rows], schema)
    for clash in ("score", "margin", "spans", "items", "taken", "_key", "_hash", "component_id"):
        own = docs.withColumnRenamed("score", clash)
        found = function(spark, own, SMALL)
        if name != "mixture":
            assert found.columns == own.columns
            kept = {(r.doc_id, r[clash]) for r in found.collect()}
            assert kept <= {(r[0], r[5]) for r in rows}
            # Long and clean documents stay.
            assert (4, "l") in kept and (1, "m") in kept
        else:
            assert found.count() == len(rows)
        if name in ("near_duplicates", "mixture"):
            break
    assert function(spark, docs.where("doc_id = -1"), SMALL).count() == 0


def test_assigned_secrets_go(spark):
    """Of each spans' judgement, measured on the whole small corpus: no live one is left, and copied ones are few."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    before = secret_scan.scan(docs).agg(F.sum("n_live").alias("live"), F.sum("n_copied").alias("copied")).collect()[0]
    clean = corpus_pipeline.without_secrets(spark, docs, SMALL)
    after = secret_scan.scan(clean).agg(F.sum("n_live").alias("live"), F.sum("n_copied").alias("copied")).collect()[0]
    assert before.live > 0 and (after.live or 0) == 0 and after.copied == before.copied
    assert clean.where("n_chars <> length(text)").count() == 0


def test_near_duplicates_at_other_figures(spark):
    docs = table(spark, SMALL, "documents").cache()
    sets = {r.doc_id: frozenset(zip(w, w[1:], w[2:])) for r in docs.collect() if len(w := plain_words(r.text)) >= 3}
    linked = {i: {j for j in sets if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])} for i in sets}
    left = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SMALL, width=3, percent=90).collect()}
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - group
            group |= new
            todo += new
        assert (i in left) == (i == min(group))
