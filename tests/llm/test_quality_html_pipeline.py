"""Quality classifier, HTML extraction and the corpus pipeline."""

import random

import numpy as np
import pytest

from ledgerline.llm import html_extract, ngram_join, quality


def text_of(rng, bad):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "tree", "river", "stone"]) for _ in range(40)]
    return " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."


def test_quality_learns_and_scores(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, i % 3 == 0), "clash") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (902, "river " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(5, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels)
    out = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    assert all(out[i]["predicted"] == int(i % 3 != 0) for i in range(200, 300))
    assert out[900]["score"] == out[901]["score"] and 0 <= out[902]["score"] <= 1
    assert quality.classify(docs.where("false"), model).count() == 0


@pytest.mark.parametrize(("labels", "low", "high"), [([], 0.5, 0.5), ([(1, 1), (2, 1)], 0.7, 0.8)])
def test_quality_without_two_classes(spark, labels, low, high):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert all(low <= r["score"] <= high for r in quality.classify(docs, model).collect())


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    signs = np.array([1 if r[0] < 3 else -1 for r in rows])
    ratio = rng.normal(size=12)
    w, b = quality.dual_coordinate_descent(rows, signs, ratio, rounds=400)
    x = np.zeros((60, 13))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[k, 12] = 1
    value = lambda u: 0.5 * (u @ u) + np.maximum(0, 1 - signs * (x @ u)).sum()
    best = value(np.append(w, b))
    assert all(value(np.append(w, b) + 0.05 * rng.normal(size=13)) >= best - 1e-3 for _ in range(300))


def test_features_do_not_depend_on_the_cache():
    texts = [b"One two two THREE!! | four", b"", None, "Élan vital".encode()]
    first = quality.Features()
    list(first.of([b"words that come before", b"two THREE!!"]))
    for a, b in zip(first.of(texts), quality.Features().of(texts), strict=True):
        assert (a == b).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no";</script><style>p{}</style></head><body class=page>
<header><h2>Site</h2></header><nav><ul><li>Menu<li>More</ul></nav><aside class="sidebar"><p>Side</p></aside><!-- <p>gone</p> --><div class="cookie-notice">Cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>er &lt;tag&gt; {n}<p>Second&nbsp;part<br>line <a href="x">link</a>{n}
<div class="ad">Buy</div><form><input value=x><button>Go</button></form><ul><li>one</li><li>two</ul><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; foot</footer></body></html>"""
WANT = "Title & more First bolder <tag> {n} Second part line link{n} one two"


@pytest.mark.parametrize("copies", [1, 15])
def test_extraction(spark, copies):
    rows = [(i, "http://h.example/x", PAGE.replace("{n}", f"n{i}"), "clash") for i in range(copies)]
    rows += [(100, None, None, "x"), (101, "http://e.example/", "", "x"), (102, "http://e.example/", "just text & no tags", "x"), (103, "http://e.example/", PAGE.split("Second")[0] + "cut <str", "x"), (104, "http://e.example/", "<div>" * 3000 + "deep", "x")]
    out = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    for i in range(copies):
        assert out[i]["text"] == WANT.replace("{n}", f"n{i}") and out[i]["n_chars"] == len(out[i]["text"])
    assert [out[i]["text"] for i in (100, 101, 102)] == ["", "", "just text & no tags"]
    assert out[103]["text"] == "Title & more First bolder <tag> {n} cut" and out[104]["text"] == "deep"


def test_template_without_article_tag(spark):
    page = '<html><body><div class="x1"><a>Home</a><a>About</a></div><div class="x2"><h2>Head {n}</h2><p>Body text of page number {n} that goes on.</p><p>And more {n}.</p></div><div class="x3">Always the same words here</div></body></html>'
    rows = [(i, f"http://t.example/{i}", page.replace("{n}", str(i))) for i in range(12)]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"Head {r['page_id']} Body text of page number {r['page_id']} that goes on. And more {r['page_id']}." for r in out)


def test_repeated_paragraphs_stay(spark):
    page = "<html><body><nav>N</nav><article><h1>Same title</h1><p>Same line.</p><p>Own {n}</p></article></body></html>"
    rows = [(i, "http://r.example/", page.replace("{n}", str(i))) for i in range(20)]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"Same title Same line. Own {r['page_id']}" for r in out)
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def facts(rows):
    """Tokens from (path, vector[, below hash range]) with a path's parts between >; the root is the empty path."""
    out = []
    for path, vector, *same in rows:
        low, high = same[0] if same else (1, 2)
        up = path.rpartition(">")[0]
        out.append({"token": hash(path) if path else 0, "parent": (hash(up) if up else 0) if path else -1, "tag": path.rpartition(">")[2].split(".")[0], "outside": False, "either": ".share" in path,
                    "pages": 20, "uses": 20, "v1": vector, "v2": vector, "below": 10, "low": low, "high": high})
    return out


def main_of(rows, broken=()):
    tokens = facts(rows)
    classes = html_extract.candidate_classes(tokens)
    found = html_extract.deduce(tokens, html_extract.valid_tokens(classes, set(broken)))[0]
    return next((p for p, *_ in rows if found and hash(p) == found), None)


def test_template_is_made_of_whole_classes():
    root = [(p, 1) for p in ("", ">html", ">html>body")]
    article, heading = ">html>body>article", ">html>body>article>h1"
    assert main_of([*root, (article, 7), (heading, 7)]) == article
    assert main_of([*root, (article, 7), (heading, 8)]) is None  # as often, on other pages
    assert main_of([*root, (">html>body>div", 1), (article, 7), (heading, 7), (">html>body>div>b", 7)]) is None  # over two slots
    assert main_of([*root, (article, 7), (heading, 7)], broken=[1]) is None  # a class that does not hold on all pages
    assert main_of([*root, (article, 7), (heading, 7)], broken=[0]) is None  # nor one around it


def test_either_names_are_template_only_where_constant():
    root = [("", 1), (">html", 1), (">html>article", 1)]
    share = ">html>article>div.share"
    for span, want in (((5, 5), [hash(share)]), ((5, 6), [])):
        tokens = facts([*root, (share, 1, span)])
        assert html_extract.deduce(tokens, html_extract.valid_tokens(html_extract.candidate_classes(tokens), set()))[1] == want


def brute_template(pages):
    """Tokens of the template by explicit occurrence vectors, orders and slots, in plain Python."""
    distinct = sorted(set(pages))
    reads = [html_extract.Page(p) for p in distinct]
    vectors, parent, depth = {}, {}, {0: 0}
    for k, read in enumerate(reads):
        for node in read.nodes:
            token = node[1]
            vectors.setdefault(token, [0] * len(reads))[k] += node[7]
            if node[0] >= 0:
                parent[token] = read.nodes[node[0]][1]
                depth[token] = depth[parent[token]] + 1
    support = max(html_extract.MIN_SUPPORT, html_extract.MIN_SHARE * len(reads))
    classes = {}
    for token, v in vectors.items():
        if sum(x > 0 for x in v) >= support:
            classes.setdefault(tuple(v), set()).add(token)
    opens = [[read.nodes[k][1] for k in read.opens] for read in reads]

    def holds(c, around):
        orders = set()
        for events in opens:
            mine = [(t, sum(x in around for x in events[:i])) for i, t in enumerate(events) if t in c]
            for i in range(0, len(mine), len(c)):
                run = mine[i : i + len(c)]
                if len({p for _, p in run}) > 1 or len({t for t, _ in run}) < len(c):
                    return False
                orders.add(tuple(t for t, _ in run))
        return len(orders) == 1

    root = next(c for c in classes.values() if 0 in c)
    whole = set()
    for token in sorted(root, key=depth.get):
        if token == 0 or parent[token] in whole:
            whole.add(token)
    if len(root) < 2 or not holds(whole, set()):
        return set()
    good, taken = [whole], {t: whole for t in whole}
    for c in sorted((c for c in classes.values() if 0 not in c and len(c) > 1), key=lambda c: (min(map(depth.get, c)), sorted(c))):
        slots = {parent[t] for t in c if parent[t] not in c}
        if len(slots) == 1 and slots <= taken.keys():
            around = taken[next(iter(slots))]
            taken.update(dict.fromkeys(c, c))
            if around in good and holds(c, around):
                good.append(c)
    return set().union(*good)


def made_host(rng, n):
    """Pages with parts that repeat, move, swap and go missing."""
    out = []
    for k in range(n):
        rows = "".join(f'<li class="row"><b class="name">n{k}{i}</b><i class="price">{rng.random()}</i></li>' for i in range(rng.randrange(4)))
        card = [f'<div class="card-a"><h2 class="t">A{k}</h2></div>', f'<div class="card-b"><h3 class="u">B{k}</h3></div>']
        if rng.random() < 0.4:
            card.reverse()
        extra = '<section class="more"><p class="x">m</p></section>' if rng.random() < 0.5 else ""
        out.append(f'<html><head><title>t</title></head><body><div class="top"><span class="logo">L</span></div><ul class="list">{rows}</ul>{extra}{"".join(card)}<div class="end">e{rng.randrange(3)}</div></body></html>')
    return out + out[:2]


@pytest.mark.parametrize("seed", range(4))
def test_deduction_against_plain_python(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pages = made_host(rng, 25)
    frame = spark.createDataFrame([("h", p) for p in pages], "_host string, _html string").repartition(3)
    seen = []
    tokens = html_extract.host_tokens(frame).where("pages >= 3").collect()
    kept = [t.asDict() for t in tokens if t["pages"] >= html_extract.MIN_SHARE * 25]
    classes = html_extract.candidate_classes(kept)
    orders = [html_extract.Page(p).class_orders(classes) for p in pages]
    broken = {c for c, _, _ in classes if len({o[c][0] for o in orders if c in o}) != 1 or any(o[c][1] for o in orders if c in o)}
    assert html_extract.valid_tokens(classes, broken) == brute_template(pages)
    assert broken or seed != 0


def test_order_and_slots_decide(spark):
    """Two articles' worth of tokens with equal vectors: in one order on all pages they are template, else not."""
    fixed = [f'<html><body><div class="a"><p class="x">Text {k}</p></div><div class="same"><b class="z">Same</b></div></body></html>' for k in range(12)]
    mixed = [p if k % 2 else p.replace('<div class="same"><b class="z">Same</b></div>', "").replace("<body>", '<body><div class="same"><b class="z">Same</b></div>') for k, p in enumerate(fixed)]
    for host, pages, want in (("f", fixed, "Text {k}"), ("m", mixed, None)):
        rows = [(k, f"http://{host}.example/", p) for k, p in enumerate(pages)]
        out = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        assert all(("Same" in out[k]) == (want is None) and f"Text {k}" in out[k] for k in out)


@pytest.mark.parametrize("html, want", [
    ('<article><div class="share-price"><p>Up 3</p></div><div class="legal-analysis">Law</div><div class="responses"><p>Survey answers</p></div><div class="share"><a href=x>Tweet</a></div></article>', "Up 3 Law Survey answers"),
    ('<body><div class="share">Tweet</div><div class="search-box">Find</div><p>Text</p></body>', "Text"),
    ('<body><p title="a>b">one<p data-x=\'">\'>two', "one two"),
    ('<body><p title="never closed>one<p>two', "one two"),
    ("a < b <3 c", "a < b <3 c")])
def test_names_and_quotes(html, want):
    assert html_extract.Page(html).text() == want


def test_hostile_pages_are_read_in_linear_time():
    import time

    t = time.time()
    assert html_extract.Page('<body><a "' + '"' * 10_001 + ">x").text().endswith("x")
    html_extract.Page("<a x='\"" * 20_000).text()
    html_extract.Page('<a=">"' * 40_000).text()
    assert html_extract.Page("<div>" * 200_000 + "deep" + "</div>" * 100_000 + "<nav>menu").text() == "deep"
    assert html_extract.Page("<ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000).text() == " ".join(["x"] * 20_000)
    assert html_extract.Page("<p>" + "<b>" * 50_000 + "</i>" * 50_000 + "y").text() == "y"
    assert time.time() - t < 20


def test_columns_that_clash(spark):
    rows = [(1, "http://k.example/x", "<article>A</article>", "m", "s", "p", "h", "t")]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, main string, same string, path string, host string, token string")).collect()[0].asDict()
    assert out == {"page_id": 1, "url": "http://k.example/x", "main": "m", "same": "s", "path": "p", "host": "h", "token": "t", "text": "A", "n_chars": 1}


def test_slots_that_vary_are_all_text(spark):
    page = '<html><body><div class="x1">Always the same</div><div class="x2"><p>Long text of {n} here, and on it goes.</p></div><div class="x3"><p>A second text {n}.</p></div>{extra}</body></html>'
    rows = [(i, "http://v.example/", page.replace("{extra}", "<div class=ps>Only here</div>" if i == 4 else "").replace("{n}", str(i))) for i in range(20)]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(out[i] == f"Long text of {i} here, and on it goes. A second text {i}." + (" Only here" if i == 4 else "") for i in range(20))


@pytest.mark.parametrize("copies", [9, 10, 12, 200])
def test_copies_are_no_template(spark, copies):
    page = '<html><body><div class="top">Top</div><div class="story"><div class="summary">Sum.</div><div class="main-part">Text of {n}, longer than all of the others taken together.</div></div></body></html>'
    story = lambda n: page.replace("{n}", str(n))
    article = '<html><body><article><h1>T{n}</h1>{x}<div class="part">Text {n}</div></article></body></html>'
    rows = [(i, "http://c.example/", story(1)) for i in range(copies)] + [(1000 + i, "http://c.example/", story(2 + i).replace("Sum.", f"Sum of {i}.")) for i in range(3)]
    rows += [(2000 + i, "http://d.example/", article.replace("{x}", '<div class="summary">S</div>').replace("{n}", "0")) for i in range(copies)]
    rows += [(3000 + i, "http://d.example/", article.replace("{x}", "").replace("{n}", str(1 + i))) for i in range(48)]
    rows += [(4000 + i, "http://e.example/", story(1)) for i in range(copies)] + [(5000, "http://e.example/", "<html><body><div class=story><div class=main-part>" + "Other words. " * 500 + "</div></div></body></html>")]
    out = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = "Top Sum. Text of 1, longer than all of the others taken together."
    assert all(out[i] == want and out[2000 + i] == "T0 S Text 0" and out[4000 + i] == want for i in range(copies))
    assert all(out[1000 + i] == f"Top Sum of {i}. Text of {2 + i}, longer than all of the others taken together." for i in range(3)) and len(out) == len(rows)


@pytest.mark.parametrize("depth", [10, 63, 64, 65, 300])
def test_depth_hides_nothing(depth):
    deep = "<div>" * depth
    boilerplate = '<nav>Menu</nav><aside>Side</aside><form>Go</form><div class="ad">Buy</div>'
    assert html_extract.Page(f"<body>{deep}one {boilerplate}<p>two<section id=comments><p>Nice!</section></body>").text() == "one two"
    assert html_extract.Page(f"<body>{deep}before {boilerplate}<article>Text{boilerplate}<p>more</article>after</body>").text() == "Text more"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    words = {"en": ["the", "river", "was", "cold", "and", "deep", "when", "we", "walked", "along"], "es": ["el", "rio", "era", "frio", "y", "profundo", "cuando", "caminamos", "por", "la"]}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "es"
        body = " ".join(rng.choice(words[lang]) + str(rng.choice(["", "s", "en"])) for _ in range(60)).capitalize() + "."
        rows.append((i, body.upper().replace(" ", "!! ") if i % 5 == 0 else body, lang, "s", len(body)))
    rows += [(200 + i, rows[i][1], rows[i][2], "s", 1) for i in range(1, 20, 3)] + [(300, None, None, None, None), (301, "123 456", "en", "s", 7), (302, "", "en", "s", 0), rows[1]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted(r[0] for r in docs.select("doc_id").collect())
        if name != "packing":
            assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
    assert not {300, 301, 302} & set(seen["language_id"]) and len(seen["language_id"]) == len(rows) - 3
    assert all(i % 5 for i in seen["quality"] if i < 100)
    sets = {i: ngram_join.shingle_hashes(t.encode()).tobytes() for i, t, *_ in rows if t}
    assert len(seen["near_duplicates"]) == len(set(seen["near_duplicates"])) == len({sets[i] for i in seen["quality"]})
    assert set(seen["packing"]) == set(seen["near_duplicates"])
    names = {name for name, _ in corpus_pipeline.STAGES}
    assert len(names) == 4 and corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
