"""Personal data, ranked search and the prefix trie against brute force, and on awkward inputs."""

import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import html_extract, lexical_search, pii, prefix_trie, warc
from ledgerline.llm import registry as llm

from ..oracle import assert_equal

FOLDER = "/root/testdata/sf0.001"

# --- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and doubled % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    found = sorted((m.start(), i, m.end()) for i, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if passes(kind, m.group()))
    return [f"{BASE[i][0]}:{a}:{b}" for a, i, b in found]


def spans_of(spark, rows, schema="doc_id bigint, text string"):
    frame = pii.find_personal_data(spark.createDataFrame(rows, schema))
    return frame.select("doc_id", pii.as_text(frame["base"]).alias("base"), pii.as_text(frame["spans"]).alias("spans")).collect()


def test_base_spans_against_plain_patterns(spark):
    g = random.Random(1)
    rows = [(i, "".join(g.choice("0123456789 .-+@aZ_()é𝄞" if g.random() < 0.5 else "0123456789 .-") for _ in range(g.randint(0, 90)))) for i in range(1_500)]
    rows += [(5_000, None), (5_001, ""), (5_002, "x 4111 1111 1111 1111, 4111-1111-1111-1112"), (5_003, "a@b.cc_d@e.f a@b@c.d"), (5_004, "256.1.1.1 0255.1.1.1 1.2.3.4.5.6.7.8"), (5_005, "𝄞𝄞 +49 (30) 1234567 +1 2"), (5_005, "𝄞𝄞 +49 (30) 1234567 +1 2")]
    out = spans_of(spark, rows)
    assert len(out) == len(rows)
    want = {}
    for i, text in rows:
        want[i] = ",".join(base_spans(text))
    assert all(r["base"] == want[r["doc_id"]] for r in out)
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in out)


def test_long_runs_need_no_stack(spark):
    rows = [(1, "1" * 300_000 + " a@b.c"), (2, "a" * 300_000 + "@"), (3, "a@b" + ".c" * 60_000), (4, "+1" + "-1" * 60_000), (5, "1.2.3.4 " * 4_000)]
    out = {r["doc_id"]: r["base"] for r in spans_of(spark, rows)}
    assert out[1].startswith("email:300001:") and out[2] == "" and out[3] == f"email:0:{3 + 120_000}" and out[4] == ""
    assert out[5].count("ip:") == 4_000 and out[5].endswith(f"ip:{8 * 3_999}:{8 * 3_999 + 7}")


def test_added_spans_are_those_the_labelers_trust(spark):
    rows = [(i, f"word contact: user{i}@mail.example.com or call +1 ({200 + i % 700}) 555-{1000 + i % 9000} soon") for i in range(400)]
    rows += [(1_000, "reach ann (at) example (dot) com today"), (1_001, "my phone (017) 555-7713 rings"), (1_002, "order 1234567812345678 shipped"), (1_003, "plain words and 12 numbers, 3.5 of them"), (1_004, "my ssn is 219-09-9999 ok")]
    rows += [(2_000 + i, f"my phone ({100 + i}) 555-{7000 + i} rings") for i in range(60)]
    out = {r["doc_id"]: r for r in spans_of(spark, rows)}
    assert out[1_000]["spans"] == "email:6:32" and out[1_001]["spans"] == "phone:9:23"
    assert out[1_002]["spans"] == "" and out[1_003]["spans"] == ""
    assert all(out[i]["spans"] == out[i]["base"] for i in range(400))


def test_expectation_maximisation_finds_the_reliable_labeler():
    g = np.random.default_rng(3)
    truth = g.random(20_000) < 0.4
    votes = np.stack([np.where(g.random(20_000) < right, truth, ~truth).astype(int) for right in (0.95, 0.9, 0.8, 0.55)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, says = pii.label_probabilities(patterns, counts.astype(float), strength=0.01)
    place = {tuple(x): i for i, x in enumerate(patterns)}
    sure = np.array([p[place[tuple(v)]] for v in votes]) > 0.5
    assert (sure == truth).mean() > 0.93
    right = [(says[1, j, 1] + says[0, j, 0]) / 2 for j in range(4)]
    assert right[0] > right[1] > right[2] > right[3]


def test_pii_of_nothing_and_clashing_columns(spark):
    assert spans_of(spark, []) == []
    frame = pii.find_personal_data(spark.createDataFrame([(1, "a@b.com", "x", "y", "z")], "doc_id bigint, text string, _email string, cands string, _row string"))
    row = frame.first()
    assert row["_email"] == "x" and row["_row"] == "z" and len(row["base"]) == 1 and "text" not in frame.columns


def test_op11_query(spark):
    out = llm.queries()["op11_pii"](spark, FOLDER).toPandas()
    texts = pd.read_parquet(f"{FOLDER}/documents.parquet").set_index("doc_id")["text"]
    assert len(out) == len(texts)
    for r in out.itertuples():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.n_email == sum(x.startswith("email") for x in want) and set(want) <= set(filter(None, r.spans.split(",")))


# --- ranked search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, k=10):
    import math
    from collections import Counter

    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    N, L = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for d, bag, n in bags:
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * (10 + (90 * n * N) // L))) for t in set(words(text)) if t in bag)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture
def small_index(monkeypatch):
    for name, value in (("LEAF_DOCS", 16), ("SHARD_POSTINGS", 300), ("FIRST_VISITS", 1), ("WINDOW_BYTES", 50), ("FIT_DOCS", 200)):
        monkeypatch.setattr(lexical_search, name, value)


def test_search_of_many_shards_equals_brute_force(spark, small_index):
    g = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    common = [f"c{i}" for i in range(10)]
    text = lambda k, n: " ".join(g.choice(topics[k] if g.random() < 0.6 else common) + g.choice(["", ",", "!"]) for _ in range(n))
    docs = [(i, text(i % 6, g.randint(1, 40))) for i in range(400)] + [(1_000 + i, "T0W1 c1 été") for i in range(150)] + [(7, "c1 c2"), (7, "c1 c2"), (2_000, None), (2_001, ""), (2_002, "..."), (None, "t1w1 t1w2"), (2_003, "x" * 400 + " c3")]
    items = [(i, text(i % 6, 12)) for i in range(20)] + [(90, None), (91, "nowhere"), (92, "c1"), (92, "c1"), (93, "x" * 400), (None, "ÉTÉ été c1")]
    out = lexical_search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, out.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items)


def test_search_in_blocks_and_of_nothing(spark, small_index, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    docs, items = [(i, f"a{i % 5} b{i % 3} c") for i in range(60)], [(i, f"a{i} b{i}") for i in range(7)]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, lexical_search.search(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items)
    for a, b in ((d.where("false"), q), (d, q.where("false"))):
        out = lexical_search.search(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_bisection_parts_two_topics():
    g = np.random.default_rng(1)
    topic = np.arange(200) // 100
    rows = np.repeat(np.arange(200), 8)
    terms = g.integers(0, 20, 1_600) + 20 * topic[rows]
    mixed = g.permutation(200)
    weights, threshold = lexical_search.bisect(terms, mixed[rows], 200, 40)
    leaf = lexical_search.walk(terms, rows, 200, [(weights[None], np.array([threshold]))])
    assert leaf[:100].std() < 0.2 and leaf[100:].std() < 0.2 and leaf[0] != leaf[199]


def test_op12_query(spark):
    assert_equal(llm.queries()["op12_lexical_search"](spark, FOLDER).toPandas(), llm.oracle_sql()["op12_lexical_search"], FOLDER)


# --- prefix trie


def trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    rebuilt = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = by.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        kids = lambda s: [x for x in nodes if len(x) == len(s) + 1 and x[:-1] == s]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(seq))
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids(seq)), sum(not kids(s) for s in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    out = prefix_trie.trie_nodes(prefix_trie.prefixes(prefix_trie.with_shared_heads(prefix_trie.turns(frame))))
    return sorted(map(tuple, out.select(*COLUMNS).collect()), key=str)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    g = random.Random(4)
    rows = [(c, t, g.choice(["user", "assistant", None]), g.choice(["a", "bé", "", None])) for c in range(-7, 60) for t in range(g.randint(1, 12))]
    rows += [(100 + c, t, "user", "same") for c in range(0, 40) for t in range(4)] + [(501, None, "user", "first"), (501, 0, "user", "then"), (None, 0, "user", "x")]
    assert nodes_of(spark, rows) == trie(rows)


def test_turnless_and_deep_conversations(spark):
    assert nodes_of(spark, []) == []
    alone = [(11, 0, "user", "only")]
    assert nodes_of(spark, alone) == trie(alone)
    deep = [(0, t, "user", f"t{t}") for t in range(30_000)]
    out = nodes_of(spark, deep)
    assert len(out) == 30_001 and {r[5] for r in out} == {1} and max(r[1] for r in out) == 30_000


def test_role_and_text_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "ab", "c")]
    assert nodes_of(spark, rows) == trie(rows)


def test_op13_query(spark):
    assert_equal(llm.queries()["op13_conversation_trie"](spark, FOLDER).toPandas(), llm.oracle_sql()["op13_conversation_trie"], FOLDER)


# --- archives and pages


def test_archives_are_read_in_slices():
    parts = [os.urandom(k % 300) + b"x" * (41 * k) for k in range(400)]
    members = b"".join(gzip.compress(p) for p in parts) + b"\0" * 3_000_000
    assert warc._open(members).read() == b"".join(parts)
    assert warc._open(gzip.compress(b"0" * 20_000_000)).read() == b"0" * 20_000_000
    with pytest.raises(ValueError, match="cut off"):
        warc._open(gzip.compress(os.urandom(3 << 20))[:-1_000]).read()


def test_two_articles_of_a_template_both_stay(spark):
    page = "<html><body><nav>N</nav><article class=lead><p>Lead {n}</p></article><div>between</div><article class=rest><p>Rest {n}</p></article></body></html>"
    rows = [(i, "http://two.example/", page.replace("{n}", str(i))) for i in range(14)]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"Lead {r['page_id']} Rest {r['page_id']}" for r in out)
