"""URL filter, WARC archives and packing on small and awkward inputs."""

import hashlib
import random

import pytest

from ledgerline.llm import packing, url_filter, warc
from ledgerline.llm.common import fresh_path

PAGES = "page_id bigint, url string, html string"
BIG = "<p>" + "long payload " * 20 + "é</p>"


def judged(spark, rows, rules=url_filter.RULES, listed=()):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    out = url_filter.url_filter(pages, spark.createDataFrame(list(rules), "action string, entry string"), spark.createDataFrame([(x,) for x in listed], "entry string"))
    return {r["page_id"]: r for r in out.collect()}


def test_rules_and_list(spark):
    rows = [(1, "http://a.net/x", "clash"), (2, "https://WWW.Example.NET/en/1?q#f", None), (3, "http://example.net/en", None), (4, "http://example.com/de/", None), (5, "http://badexample.com/de/1", None),
            (6, None, None), (7, "no scheme", None), (8, "http://x.org/fr/a/b", None), (9, "http://h.net", None), (10, "http://spam.example.org/a/b", None), (11, "http://m.spam.example.org?x", None), (12, "", None)]
    out = judged(spark, rows, listed=["spam.example.org/"])
    assert out[1]["rule"] == "net/" and out[1]["verdict"] == "block"
    assert out[2]["rule"] == "example.net/en/" and out[2]["verdict"] == "allow" and out[2]["host"] == "www.example.net" and out[2]["path"] == "/en/1"
    assert out[3]["rule"] == "net/"
    assert out[4]["rule"] == "example.com/de/" and out[5]["rule"] is None and out[5]["verdict"] == "allow"
    assert (out[6]["host"], out[6]["path"], out[6]["verdict"]) == ("", "", "allow") and out[7]["host"] == "" and out[12]["host"] == ""
    assert out[8]["verdict"] == "allow" and out[8]["rule"] == "org/fr/"
    assert out[9]["path"] == "" and out[9]["rule"] is None
    assert out[10]["verdict"] == "block" and out[10]["rule"] is None and out[10]["listed"] == "spam.example.org/"
    assert out[11]["path"] == "" and out[11]["verdict"] == "allow"


def test_url_filter_keeps_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "a", "h", "p", "k", "b"), (2, None, "a", "h", "p", "k", "b"), (2, None, "a", "h", "p", "k", "b")], "page_id bigint, url string, action string, _h string, _p string, _k string, block string")
    out = url_filter.url_filter(pages, spark.createDataFrame(url_filter.RULES, "action string, entry string"), spark.createDataFrame([], "entry string")).collect()
    assert sorted((r["page_id"], r["action"], r["_h"], r["_k"], r["block"], r["verdict"]) for r in out) == [(1, "a", "h", "k", "b", "block"), (2, "a", "h", "k", "b", "allow"), (2, "a", "h", "k", "b", "allow")]


def test_bloom_holds_all_keys_and_few_others(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    bloom, blocks = url_filter.blocked_bloom(keys, "key", 5000)
    assert url_filter.probe(keys, "key", bloom, blocks).count() == 5000
    others = spark.range(20000).selectExpr("concat('o', id) as key")
    assert url_filter.probe(others, "key", bloom, blocks).count() < 800


def test_bloom_is_bounded(spark):
    _, blocks = url_filter.blocked_bloom(spark.createDataFrame([("a",)], "key string"), "key", 10**9, max_filter_mb=1)
    assert blocks * 32 <= 1 << 20


def test_url_filter_on_empty_inputs_and_repeats(spark):
    assert judged(spark, [], listed=["a.com/"]) == {}
    assert judged(spark, [(1, "http://a.net/", None)], rules=[])[1]["verdict"] == "allow"
    pages = spark.createDataFrame([(1, "http://a.net/x")] * 3, "page_id bigint, url string")
    assert url_filter.url_filter(pages, spark.createDataFrame(url_filter.RULES, "action string, entry string"), spark.createDataFrame([], "entry string")).where("verdict = 'block'").count() == 3


@pytest.mark.parametrize("rows", [[], [(1, "http://a.net/x", BIG), (2, "http://b.net/y\r\nX: 1", BIG), (5, None, BIG), (3, "u", None), (4, "u", "short"), (6, "v", "short"), (None, "w", "line\r\n\r\nWARC/1.1\r\n" + BIG), (1, "http://a.net/x", BIG)]])
def test_warc_round_trip(spark, rows):
    path = fresh_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    if not rows:
        assert warc.assemble(warc.read_warc(spark, path)).count() == 0
        return
    out = warc.assemble(warc.read_warc(spark, path)).collect()
    assert len(out) == len(rows)
    facts = [(dict(r["metadata"][0]["fields"]), r) for r in out]
    for f, r in facts:
        assert len(r["metadata"]) == 1 and r["request"] is not None
        if r["response"]["warc_type"] == "response":
            page = int(f["page-id"]) if "page-id" in f else None
            html = {p: (h or "") for p, _, h in rows}[page].encode()
            assert bytes(r["response"]["payload"]) == html and r["response"]["payload_digest"] == hashlib.sha256(html).hexdigest()
        else:
            assert f["refers-to-page-id"] == "1" and r["response"]["refers_to"] and len(r["response"]["payload"]) == 0
    kinds = sorted((int(f.get("page-id", -1)), r["response"]["warc_type"]) for f, r in facts)
    assert kinds == [(-1, "response"), (1, "response"), (1, "revisit"), (2, "revisit"), (3, "response"), (4, "response"), (5, "revisit"), (6, "response")]


def test_cut_off_archive_is_an_error(spark):
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 10\r\n\r\n12345"
    with pytest.raises(ValueError):
        list(warc.parse_records(good))


def test_assembly_takes_links_in_both_directions(spark):
    base = {"target_uri": None, "warc_date": None, "refers_to": None, "payload_digest": None, "content_type": "", "block_bytes": 0, "payload_bytes": 0, "payload_sha256": "", "fields": {}, "payload": b""}
    rows = [base | {"record_id": "r", "warc_type": "response", "concurrent_to": ["q"]}, base | {"record_id": "q", "warc_type": "request", "concurrent_to": []}, base | {"record_id": "m", "warc_type": "metadata", "concurrent_to": ["r"]}, base | {"record_id": "lone", "warc_type": "response", "concurrent_to": []}]
    out = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert out["r"]["request"]["record_id"] == "q" and out["r"]["metadata"][0]["record_id"] == "m"
    assert out["lone"]["request"] is None


def test_pack_lengths_is_best_fit_and_downsizes():
    where, start, used, final, opened = packing.pack_lengths([900, 600, 400, 100, 20], [512, 1024])
    assert sum(used) == 2020 and all(u <= c for u, c in zip(used, final, strict=True))
    assert all(c == 512 for u, c in zip(used, final, strict=True) if u <= 512)
    assert where[3] == where[0] and start[3] == 900  # the bin with least room that holds it


def least_cost(lengths, capacities, cost):
    """The least cost of any partition into bins, by trying all."""
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(cost(next(c for c in capacities if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacities[-1]:
                bins[i] += lengths[k]
                place(k + 1, bins)
                bins[i] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("overhead", [0.0, 64.0, 2000.0])
def test_layouts_are_near_the_optimum(overhead):
    rng = random.Random(int(overhead))
    cost = lambda c: packing.bin_cost(c, overhead)
    capacities, opened = [4, 8, 16, 32], set()
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 8))), reverse=True)
        where, start, used, final, sizes = packing.cheapest_layout(lengths, capacities, cost)
        opened.update(sizes)
        assert all(sum(n for n, w in zip(lengths, where, strict=True) if w == b) == used[b] <= final[b] for b in range(len(used)))
        assert sum(map(cost, final)) <= 1.25 * least_cost(lengths, capacities, cost) + 1e-9
    assert opened == set(capacities) if overhead < 100 else 32 in opened


def test_a_mix_beats_the_size_that_looks_cheapest():
    lengths = [512] * 5 + [500] * 5
    used = lambda out: sum(packing.bin_cost(c, 0.0) for c in out[3])
    assert used(packing.cheapest_layout(lengths, cost=lambda c: packing.bin_cost(c, 0.0))) <= used(packing.pack_lengths(lengths))
    assert set(packing.cheapest_layout([1000], packing.CAPACITIES)[4]) == {1024} and set(packing.cheapest_layout([300], packing.CAPACITIES)[4]) == {512}


def test_packing_keeps_every_token(spark):
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "  \n "), (5, "w " * 9000), (None, "x y"), (7, "one"), (7, "one")]
    docs = packing.with_token_count(spark.createDataFrame(texts, "doc_id bigint, text string"))
    out = packing.best_fit_pack(docs, shard_docs=3).toPandas()
    assert out["piece_tokens"].sum() == 4 + 9001 + 3 + 2 + 2
    assert out[out["n_tokens"] == 0]["bin_id"].isna().all() and len(out[out["n_tokens"] == 0]) == 3
    bins = out.dropna(subset=["bin_id"]).groupby("bin_id")
    assert (bins["piece_tokens"].sum() == bins["bin_used"].first()).all() and (bins["bin_used"].first() <= bins["capacity"].first()).all()
    spans = out.dropna(subset=["bin_id"]).sort_values(["bin_id", "bin_start"])
    ends = spans["bin_start"] + spans["piece_tokens"]
    same = spans["bin_id"].eq(spans["bin_id"].shift())
    assert (spans["bin_start"][same] == ends.shift()[same]).all()
    assert packing.best_fit_pack(docs.where("false")).count() == 0
    made = packing.sequences(packing.best_fit_pack(docs, shard_docs=3)).collect()
    assert sum(p["piece_tokens"] for r in made for p in r["parts"]) == out["piece_tokens"].sum()
    for r in made:
        ends = [0]
        for part in r["parts"]:
            assert part["bin_start"] == ends[-1]
            ends.append(part["bin_start"] + part["piece_tokens"])
        assert ends[-1] == r["bin_used"] <= r["capacity"]
