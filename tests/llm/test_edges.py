"""Very long and oddly marked pages, deep and very long urls, batches by size."""

import random
import time

from pyspark.sql import functions as F

from stellagrid.llm import common, html, urls


def test_class_words_drop_no_article_text():
    page = (
        '<article><header><h1>Title</h1><p>By A.</p></header><div class="post-header"><h2>Part</h2></div><p>Body text.</p><section class="related-work"><p>Prior work.</p></section>'
        '<p class="notice">A notice in the text.</p><div class="social"><p>Social life.</p></div><div class="share"><a href="#">Tweet</a> <a href="#">Mail</a></div>'
        '<div class="comments"><p>First!</p></div><footer>f</footer></article>'
    )
    assert html.extract(page) == "Title By A. Part Body text. Prior work. A notice in the text. Social life."
    assert html.extract("<body><div class='banner'>Buy</div><p>Text.</p></body>") == "Text."


def wrapper_of(pages):
    spec = html.structure(pages[:3])
    t = html.Template(html.json.loads(spec))
    slots = {}
    for p in pages:
        for a, b in html.aligned(html.Shape([html.parse(p)]), t):
            if a.text:
                slots.setdefault(b.slot, []).append(a.text)
    top = {k: (max(map(v.count, v)), html.text_hash(max(v, key=v.count)), len(max(v, key=v.count)), sum(map(len, v))) for k, v in slots.items()}
    return html.Template(html.json.loads(html.judge(spec, len(pages), top)))


def test_a_headline_before_the_article_stays():
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))
    made = [(prose(4), [prose(30) for _ in range(3)]) for _ in range(8)]
    for tag in ("article", "div"):
        pages = [f"<html><body><nav><a>Home</a></nav><h1>{h}</h1><{tag}><section>{''.join(f'<p>{p}</p>' for p in ps)}</section></{tag}><footer>(c) us</footer></body></html>" for h, ps in made]
        w = wrapper_of(pages)
        assert [html.extract(p, w) for p in pages] == [" ".join([h, *ps]) for h, ps in made], tag


def slow_match(a, b):
    """The size by the plain recursion."""
    if a.tag != b.tag:
        return 0
    size = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + slow_match(x, y))
    return size[-1][-1] + 1


def some_page(r, depth=0):
    return "".join(f"<{t}>{'x' if depth == 3 or r.random() < 0.4 else some_page(r, depth + 1)}</{t}>" for t in (r.choice(["div", "ul", "section", "p"]) for _ in range(r.randint(1, 7))))


def test_matching_is_largest_and_ordered(monkeypatch):
    r = random.Random(6)
    for held in (1 << 20, 4):  # with and without dividing
        monkeypatch.setattr(html, "HELD", held)
        for _ in range(120):
            a, b = (html.Shape([html.parse(some_page(r))]) for _ in range(2))
            size, pairs = html.match(a, b)
            assert size == slow_match(a, b) == len(pairs) and all(x.tag == y.tag for x, y in pairs)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
            first, second = ({id(n): k for k, n in enumerate(t.walk())} for t in (a, b))
            by = sorted((first[id(x)], second[id(y)]) for x, y in pairs)
            assert [q for _, q in by] == sorted(q for _, q in by)


def test_a_long_page(spark):
    """A megabyte of 50,000 alternating blocks."""
    page = lambda word: "<html><body><nav><a>Home</a></nav><article>" + "".join(f"<p>{word} {k}</p><ul><li>item</li></ul>" for k in range(25_000)) + "</article></body></html>"
    began = time.time()
    a, b = (html.Shape([html.parse(page(w))]) for w in ("one", "other"))
    assert html.match(a, b)[0] == a.count > 75_000 and time.time() - began < 30
    rows = [(k, f"http://a.b/{k}", page(f"w{k}")) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith(f"w{k} 0 ") and f"w{k} 24999" in got[k] and "Home" not in got[k] for k in range(3))


def test_labels_that_differ_deep_down(spark):
    """Labelled and unlabelled pages go together for seven levels and part at the eighth."""
    deep = "/a/b/c/d/e/f/g"
    rules = [("block", "x.org", f"{deep}/bad/1"), ("allow", "x.org", f"{deep}/good/1")]
    rows = [(k, f"http://x.org{deep}/{kind}/{n}-{k}") for k, (kind, n) in enumerate([(kind, n) for kind in ("bad", "good") for n in (1, 2) for _ in range(25)])]
    rows += [(900, "http://y.org/" + "/".join(f"s{k}" for k in range(20_000)) + "x" * 1000), (901, "http://y.org/" + "z" * 100_000), (902, None)]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("template", F.lit("odd")), rules).collect()}
    assert len(got) == len(rows)
    for k in range(100):
        assert got[k]["verdict"] == ("block" if k < 50 else "allow"), got[k]
    assert got[900]["template"].endswith("/**") and len(got[900]["path"]) > 100_000 and got[901]["path"] == "/" + "z" * 100_000
    assert got[902]["host"] == "" and got[902]["path"] == ""


def test_batches_by_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        common.small_batches(spark)
        assert int(spark.conf.get(name)) == common.BATCH_BYTES
        spark.conf.set(name, "1mb")
        common.small_batches(spark)
        assert spark.conf.get(name) == "1mb"
    finally:
        spark.conf.set(name, before)
