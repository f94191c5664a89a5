"""Vectors and pages: small cases, brute force and the SQL of what SQL can express."""

import hashlib
import html as markup
import random
import re
import time
import struct
from pathlib import Path

import crosscheck
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from headcount.llm import ann, embeddings, html_text, queries, url_filter, warc
from headcount.llm.vectors import vectors

VECS = "vec_id long, embedding array<float>, label int"


def table(spark, vecs):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], VECS)


ODD = [None, [], [0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0]]


def test_unusable_vectors(spark):
    got = {r["id"]: r["vec"] for r in vectors(table(spark, [*ODD, [-0.0, 1.0], [0.0, 1.0]]), "vec_id", "embedding").collect()}
    assert all(got[i] is None for i in range(len(ODD)))
    assert got[6] == got[7] is not None


# Near-duplicate vectors


def brute_links(vecs, least=0.9):
    x = {i: np.array(v, float) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    label, count = {i: i for i in range(len(vecs))}, dict.fromkeys(range(len(vecs)), 0)

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in x:
        for b in x:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= least:
                count[a] += 1
                count[b] += 1
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: (count[i], root(i), root(i) == i) for i in count}


def clusters(seed, dims=24):
    """Clusters whose members lie around the threshold, and exact copies."""
    r = np.random.default_rng(seed)
    out = []
    for spread in (0.05, 0.15, 0.25, 0.35):
        for _ in range(6):
            centre = r.standard_normal(dims)
            centre /= np.linalg.norm(centre)
            for _ in range(10):
                step = r.standard_normal(dims)
                out.append((centre + spread * step / np.linalg.norm(step) * r.uniform(0.5, 2)).astype(np.float32).tolist())
    return out + [out[0]] * 7 + [[2 * c for c in out[20]]] + r.standard_normal((60, dims)).tolist()


@pytest.mark.parametrize("block", [256, 4, 40])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "SMALL", min(block, 32))
    vecs = clusters(block) + ODD + [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0]]
    vecs = [v if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in vecs]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table(spark, vecs)).collect()}
    assert got == brute_links(vecs)


def test_pairs_at_the_threshold_share_a_bucket():
    r = np.random.default_rng(1)
    x = embeddings._unit(r.standard_normal((4000, 64)))
    y = r.standard_normal((4000, 64))
    y = embeddings._unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    a, b = (embeddings.probes(v, embeddings._signs(64)) for v in (x, 0.9 * x + np.sqrt(0.19) * y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.999


def test_hadamard_is_orthogonal():
    h = embeddings.hadamard(np.eye(16))
    assert np.array_equal(h @ h.T, 16 * np.eye(16)) and set(np.unique(h)) == {-1, 1}


def test_vectors_of_odd_tables(spark):
    none = spark.createDataFrame([], VECS)
    assert embeddings.near_duplicates(none).count() == 0 and ann.nearest(none, "id % 20 = 0").count() == 0
    vecs = table(spark, [[1.0, 0.0], [1.0, 0.0], None])
    vecs = vecs.unionByName(vecs).unionByName(vecs.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    vecs = vecs.withColumn("id", F.lit("x")).withColumn("vec", F.lit("y"))
    got = sorted(map(tuple, embeddings.near_duplicates(vecs).collect()), key=str)
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (None, 0, None, True)]
    assert [tuple(r) for r in ann.nearest(vecs, "id = 0").collect()] == [(0, 1, 1, 1.0)]


def test_each_row_without_an_id_stays(spark):
    some = table(spark, [[1.0, 0.0], [0.0, 1.0], None]).withColumn("vec_id", F.expr("IF(vec_id = 0, 0, NULL)"))
    got = sorted(map(tuple, embeddings.near_duplicates(some).collect()), key=str)
    assert got == [(0, 0, 0, True), (None, 0, None, True), (None, 0, None, True)]


# Nearest neighbours


def test_bounds_hold():
    r = np.random.default_rng(2)
    for dims in (1, 7, 64, 2000):
        x, y = r.standard_normal((40, dims)) * r.uniform(1e-6, 1e6, (40, 1)), r.standard_normal((50, dims))
        near, error = ann.bounds(x, y)
        assert (np.abs(near - x @ y.T) <= error).all()


@pytest.mark.parametrize("stripe", [64, 2])
def test_nearest_equals_brute_force_with_ties(spark, monkeypatch, stripe):
    monkeypatch.setattr(ann, "QUERIES", 3)
    monkeypatch.setattr(ann, "GROUP", 5 if stripe == 2 else 16_384)
    monkeypatch.setattr(ann, "CANDIDATES", 16)
    monkeypatch.setattr(ann, "STRIPE", stripe)
    r = np.random.default_rng(8)
    vecs = r.standard_normal((150, 8)).astype(np.float32).tolist()
    vecs += [vecs[0]] * 30 + ODD + [[1.0, 2.0]]
    want = []
    good = {i: np.array(v, float) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    for q in (i for i in good if i % 20 == 0):
        near = sorted((-sum(float(a) * float(b) for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:20])]
    got = sorted(map(tuple, ann.nearest(table(spark, vecs), "id % 20 = 0").collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-14)


@pytest.mark.parametrize("key", queries.ORACLE)
def test_query_equals_sql(spark, sf_dir, key):
    assert crosscheck.compare(spark, crosscheck.connect(sf_dir), sf_dir, queries.QUERIES[key], queries.ORACLE[key]) == []


# Main text

WEIGHTS = {}


def test_pages_equal_their_articles(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html_text.op6_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(markup.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def brute_region(scores):
    best = (0.0, 0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if (s := sum(scores[i:j])) > 0 and (s, j - i) > best[:2]:
                best = (s, j - i, i, j)
    return best


def test_best_region_equals_brute_force():
    pick = random.Random(5)
    for _ in range(500):
        scores = [pick.choice([-2, -1, 0, 1, 2]) for _ in range(pick.randrange(0, 14))]
        start, end = html_text.best_region(scores)
        want = brute_region(scores)
        assert (sum(scores[start:end]), end - start) == want[:2], scores


def test_main_text_of_odd_pages():
    def text(page):
        return html_text.main_text(page, WEIGHTS)

    assert text("") == text("<p></p><!-- x -->") == ""
    assert text("just text &amp; more <") == "just text & more <"
    page = (
        "<header><p>Site</p></header><div class='sidebar'><p>one two</p></div><main><h1>Title&nbsp; here</h1><p>a &lt;b&gt;\n c"
        "<div class='ad'>buy</div><p>d<br>e <b>f</b>g<form>q</form><ul><li>one two<li>three four</ul><pre>1\n 2</pre></main>"
        "<div id=comments><p>many words of a reader</div><script>var a = '<p>no</p>'</script><footer>end</footer>"
    )
    assert text(page) == "Title here\na <b> c\nd e fg\none two\nthree four\n1 2"
    assert text("<p>" * 30_000 + "x" * 50_000) == "x" * 50_000
    assert text("<" * 50_000 + "a" + "<!--" * 20_000)[-1:] != ">"


ARTICLE = "<h1>A title here</h1>" + "".join(f"<p>Sentence {i} of the story with some more words.</p>" for i in range(12))
PLAIN = "\n".join(["A title here", *(f"Sentence {i} of the story with some more words." for i in range(12))])
AROUND = "<header><p>Site name</p></header><nav><a href='/'>Home</a></nav>{}<footer>All rights</footer>"


@pytest.mark.parametrize("mark", ["{}", "<article>{}</article>", "<main>{}</main>", "<article class='post related-none'>{}</article>"])
@pytest.mark.parametrize(
    "wrapper",
    ["<div class='layout has-sidebar'>{}</div>", "<form method=post>{}</form>", "<div id='search-app'>{}</div>",
     "<section class='post related-none'>{}</section>", "<div class=menu>{}</div>", "<form><div class='page has-banner'>{}</div></form>"],
)
def test_wrappers_with_unlucky_names_hold_the_article(wrapper, mark):
    page = AROUND.format(wrapper.format(mark.format(ARTICLE)))
    assert html_text.main_text(page, WEIGHTS) == PLAIN


@pytest.mark.parametrize("mark", ["{}", "<article>{}</article>"])
def test_hinted_parts_beside_the_article_stay_out(mark):
    aside = "".join(f"<p>Other words {i} of somebody else, quite a few of them.</p>" for i in range(25))
    for part in ("<div class='sidebar'>{}</div>", "<section class='comments'><article>{}</article></section>", "<div id=comments>{}</div>",
                 "<aside>{}</aside>", "<div class='cookie'>{}</div>", "<footer>{}</footer>"):
        for page in (mark.format(ARTICLE) + part.format(aside), part.format(aside) + mark.format(ARTICLE)):
            assert html_text.main_text(f"<body>{page}</body>", WEIGHTS) == PLAIN, (mark, part)
    inside = f"<div class='layout has-sidebar'><div class='sidebar'>{aside}</div><article>{ARTICLE}<form>Sign up now</form></article></div>"
    assert html_text.main_text(inside, WEIGHTS) == PLAIN


def brute_tree(page):
    """Closest block, and the open tags, of each text, walking the stack for each tag."""
    stack, out = [], []
    for m in re.finditer(r"<(/?)([a-z0-9]+)>|([^<]+)", page):
        if m[3]:
            out.append((m[3], next((t for t in reversed(stack) if t in html_text.BLOCK), "body")))
            continue
        tag = m[2]
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == tag:
                    del stack[i:]
                    break
                if tag not in html_text.BLOCK and stack[i] in html_text.BLOCK:
                    break
            continue
        if tag in html_text.ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == "p":
                    del stack[i:]
                    break
                if stack[i] in html_text.BLOCK:
                    break
        if tag == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == "li":
                    del stack[i:]
                    break
                if stack[i] in ("ul", "ol", "menu"):
                    break
        stack.append(tag)
    return out


def test_open_elements_equal_a_walk_of_the_stack():
    pick = random.Random(2)
    for _ in range(1500):
        page = "".join(pick.choice([f"<{t}>", f"</{t}>", "w "]) for t in pick.choices("p div li ul ol i b a td table span section".split(), k=40))
        page = re.sub(r"(w )+", "w ", page)
        assert [(v, b) for k, v, _, b, _ in html_text.pieces(page) if k == "text"] == brute_tree(page), page


def test_time_is_linear_in_unbalanced_markup():
    pages = ["<i>" * 120_000 + "x</b>" * 120_000, "<div>" * 100_000 + "</p>" * 100_000, "<select>" * 100_000 + "x", "<svg>x" * 100_000]
    pages += ["<div class=menu>" * 30_000 + "x" * 100, "<li><p>" * 100_000, "<p><i>" * 100_000, "<ul><li>" * 60_000 + "</li>" * 100_000]
    for page in pages:
        begin = time.time()
        html_text.main_text(page, WEIGHTS)
        assert time.time() - begin < 20 * len(page) / 1e6, page[:20]


def test_extract_of_odd_tables(spark):
    schema = "page_id long, url string, html string"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "<p>a b"), (None, "u", "")], schema).withColumn("text", F.lit(1))
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", "a b"]


# Url rules


def test_borders_come_from_a_bounded_sample(spark):
    rows = spark.range(200_000).selectExpr("concat('h', lpad(CAST(id AS STRING), 9, '0')) AS __key", "xxhash64(id) AS __salt")
    sizes = []
    plain = type(rows).collect
    type(rows).collect = lambda df: (found := plain(df), sizes.append((len(found), df._jdf.queryExecution().executedPlan().toString())))[0]
    try:
        borders = url_filter._borders(rows, 20)
    finally:
        type(rows).collect = plain
    assert len(borders) == 19 and borders == sorted(borders)
    assert abs(sizes[0][0] - 20 * url_filter.SAMPLE) < 5 * (20 * url_filter.SAMPLE) ** 0.5 and "TakeOrdered" not in sizes[0][1]
    assert abs(int(borders[9][0][1:]) - 100_000) < 25_000


def brute_rule(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v, h) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (len(f[0]), len(f[2]))) if fits else (None, default)
    return host, path, *best[:2]


def test_rules_equal_brute_force(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    pick = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "bexample.org", "com", "x.com", "net", "", "EXAMPLE.org", "org.", "é.org"]
    urls = [None, "", "no scheme/org", "http://", "://org/", "a://b://org/x", "http://org?x/", "http://org/#/en"]
    urls += [f"http{pick.choice(['', 's'])}://{pick.choice(hosts)}{pick.choice(['', '/', '/en', '/en/1', '/en/12?q#f', '/es/', '/es'])}" for _ in range(600)]
    urls += ["https://hot.example.org/en/1"] * 400
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "", "block"), ("a.example.org", "/e", "allow"), ("b.a.example.org", "", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("n", F.lit(2))
    got = url_filter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: tuple(r)[3:] for r in got.collect()} == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_rules_of_odd_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, rules).count() == 0
    some = spark.createDataFrame([(None, "http://x.org/" + "y" * 100_000), (None, None)], "page_id long, url string")
    assert sorted(r["verdict"] for r in url_filter.filter_urls(some, rules.limit(0)).collect()) == ["allow", "allow"]
    twice = rules.unionByName(rules.withColumn("verdict", F.lit("block")))
    assert {r["rule"]: r["verdict"] for r in url_filter.filter_urls(some, twice).collect()} == {"org/": "allow", None: "allow"}


# WARC


def test_archive_round_trip_and_layout():
    records = [warc.record(i, f"http://x/{i}\r\n", b"<p>%d</p>" % i * 40, None, False) for i in range(50)]
    records.append(warc.record(50, None, b"<p>1</p>" * 40, 1, True))
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.SKIPPABLE and size > 0
    got = list(warc.read_archive(data))
    assert [r["payload"] for r in got[:50]] == [b"<p>%d</p>" % i * 40 for i in range(50)]
    assert got[50]["refers_to"] == 1 and got[50]["payload"] is None and got[50]["payload_bytes"] == 320
    assert got[50]["payload_digest"] == got[1]["payload_digest"] == hashlib.sha256(b"<p>1</p>" * 40).hexdigest()
    # Any Zstandard reader with the dictionary reads a frame.
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert plain.decompressobj().decompress(data[8 + size :]) == records[0]


def test_broken_archives_raise():
    good = warc.record(1, "u", b"payload" * 30, None, False)
    data = warc.archive([good] * 3)
    broken = [
        good.replace(b"WARC/1.1", b"XARC/1.1"), good.replace(b"payloadp", b"payloadq"), good[:-1], good + b"x",
        good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"sha256:", b"sha1:"),
        re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: 9\r\n\r\nHTTP", good),
    ]
    for record in broken:
        with pytest.raises(ValueError):
            warc.parse(record)
    for bad in (b"", data[:4], data[:-3], data[8:], struct.pack("<II", warc.SKIPPABLE, 1 << 30) + data[8:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


def test_archives_of_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    long = "<p>é</p>" * 60_000
    data = [(3, "u", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (1, "u", long), (6, "u", "x" * 100), (7, "u", "x" * 100), (8, "u", "x" * 99), (9, "u", "x" * 99)]
    pages = spark.createDataFrame(data, schema).withColumn("digest", F.lit(1)).withColumn("first_id", F.lit(2))
    written = warc.write_archives(pages, str(tmp_path / "a"))
    got = warc.read_archives(written).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 6), (8, "response", None), (9, "response", None)]
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 3)} == {len(long.encode())}
    assert sum(1 for _ in Path(tmp_path / "a").iterdir()) == written.count()
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], schema), str(tmp_path / "b"))).count() == 0
