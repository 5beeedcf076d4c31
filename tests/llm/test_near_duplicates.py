"""N-gram join, SpotSigs and embedding near-dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import lattice_dedup, ngram_join, spotsigs
from ledgerline.llm.common import connected_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    random.seed(3)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    want = components({x for l in links for x in l}, links)
    assert {n: found.get(n, n) for n in want} == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def words_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            rows.append(edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06])))
        if rng.random() < 0.4:
            rows.append(passage + " " + " ".join(rng.choice(vocabulary) for _ in range(80)))
    group = [rng.choice(vocabulary) for _ in range(150)]
    rows += [edited(rng, group, rng.choice([0.002, 0.01, 0.03])) for _ in range(80)]  # longer lists than LONG
    rows += [None, "", " \n\t ", "one", "ONE", "one\ttwo", "One Two", "long " * 4000]
    rng.shuffle(rows)
    return rows


def test_shingle_hashes_count_and_agree(corpus):
    for text in corpus:
        assert len(ngram_join.shingle_hashes((text or "").encode())) == len(words_set(text))
    a, b = ngram_join.shingle_hashes(b"A  b\tc d e f"), ngram_join.shingle_hashes(b"a b c d e g")
    assert len(np.intersect1d(a, b)) == 1


def test_jaccard_components_against_all_pairs(spark, corpus):
    sets = [words_set(t) for t in corpus]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(range(len(sets)), links)
    rows = [(i, t, "clash") for i, t in enumerate(corpus)] + [(None, corpus[0], "null id")]
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string").repartition(3)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_jaccard_without_rows(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    empty = ngram_join.jaccard_components(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in empty) == [(1, 0, 1), (2, 0, 2)]


def test_jaccard_with_a_repeated_doc_id(spark):
    out = ngram_join.jaccard_components(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1), (1, 1), (2, 1)]


def test_t_occurrence_against_sets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 200, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 2**60, 200, dtype=np.uint64), base)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    i, j = ngram_join.t_occurrence(sets, 80)
    want = {(a, b) for b in range(41) for a in range(b) if len(sets[a]) and len(sets[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def marks(keys):
    words = np.zeros(1 << 12, np.uint32)
    for x in ngram_join.Marks.places(np.asarray(keys, np.uint64), 1 << 17):
        np.bitwise_or.at(words, x >> 5, np.left_shift(1, x & 31).astype(np.uint32))
    return ngram_join.Marks(words)


def test_filing_shares_enough_keys():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        m = marks(rng.choice(a >> np.uint64(16), int(len(a) * rng.choice([0.1, 0.5, 0.95]))))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            (x, held_a), (y, held_b) = ngram_join.filing_keys(a, m, 80), ngram_join.filing_keys(b, m, 80)
            shared = np.intersect1d(x, y)
            assert len(shared) >= ngram_join.needed(np.int64(min(len(a), len(b))))
            if min(held_a, held_b) >= 0:  # short lists are counted in full
                t = -(-(len(a) + len(b)) * 80 // 180)
                assert (~m.holds(shared)).sum() >= t - min(held_a, held_b)
            else:
                assert (~m.holds(shared)).sum() >= ngram_join.needed(np.int64(min(len(a), len(b))))


def test_merge_skip_against_counts():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(12))) for _ in range(rng.randrange(9))]
        least = rng.randrange(1, 6)
        counts = {x: sum(x in y for y in lists) for y in lists for x in y}
        assert list(ngram_join.merge_skip(lists, least)) == sorted((x, n) for x, n in counts.items() if n >= least)


def shared_passage(n, words=120, passage=60, seed=3):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(passage)]
    return [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range((words - passage) // 2)] + common + [f"w{rng.randrange(10**6)}" for _ in range((words - passage) // 2)])) for i in range(n)]


@pytest.mark.parametrize("share", [60, 100])
def test_documents_that_share_a_passage_are_no_candidates(spark, monkeypatch, share):
    seen = []
    verify, rest = ngram_join._verify_pairs, ngram_join._verify_rest
    monkeypatch.setattr(ngram_join, "_verify_pairs", lambda pairs, *x: seen.append(pairs.count()) or verify(pairs, *x))
    monkeypatch.setattr(ngram_join, "_verify_rest", lambda clusters, *x: seen.append(clusters.count()) or rest(clusters, *x))
    for n in (100, 400):
        out = ngram_join.jaccard_components(spark.createDataFrame(shared_passage(n, passage=share), "doc_id bigint, text string").repartition(3))
        assert out.where("doc_id <> component_id").count() == 0
    assert seen == [0, 0]


def test_large_group_of_near_copies_with_stragglers(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, edited(rng, base, rng.choice([0.002, 0.01, 0.02, 0.03]))) for i in range(150)]
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    sets = {i: words_set(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(sets, links)
    assert 1 < len(set(want.values())) < 100
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_a_doc_id_with_several_texts_is_one_node(spark):
    a, b = "a b c d e f", "g h i j k l"
    out = ngram_join.jaccard_components(spark.createDataFrame([(10, a), (10, b), (1, a), (2, b), (3, "x")], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1), (2, 1), (3, 3), (10, 1), (10, 1)]


DOCS = [(1, "the cat sat on the mat and the dog was in the garden by the wall"), (2, "short"), (5, None), (3, ""), (9, "| one | two | three | four | five"), (7, "The cat sat on the mat, and the dog was in the garden by the wall!"), (12, "é" * 30), (None, "null id")]


def spot_edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_spotsigs_edits_against_plain_python(spark):
    rows = [r for r in DOCS if r[0] is not None]
    df = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id bigint, text string").repartition(3)
    led = spotsigs.with_next(df, "doc_id", spotsigs.F.octet_length("text"), ["text"]).collect()
    order = sorted((i, t or "") for i, t in rows)
    assert {r["doc_id"]: r["next_text"] for r in led} == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


def test_next_with_ties_nulls_one_row_and_none(spark):
    df = spark.createDataFrame([(2, "a"), (2, "b"), (None, "n"), (1, "c")], "doc_id bigint, text string")
    led = {(r["doc_id"], r["text"]): r["next_text"] for r in spotsigs.with_next(df, "doc_id", spotsigs.F.lit(100_000_000), ["text"]).collect()}
    assert led[None, "n"] == "c" and led[1, "c"] in "ab" and {led[2, "a"], led[2, "b"]} in ({"b", "n"}, {"a", "n"})
    assert spotsigs.with_next(df.where("doc_id = 1"), "doc_id", spotsigs.F.lit(1), ["text"]).first()["next_text"] == "c"
    assert spotsigs.with_next(df.where("false"), "doc_id", spotsigs.F.lit(1), ["text"]).count() == 0


def test_next_with_outlying_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_BYTES", 500)
    ids = [*range(4000), 2**60, -(2**50)]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id bigint, text string").repartition(3)
    led = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df, "doc_id", spotsigs.F.lit(1), ["text"]).collect()}
    order = sorted(ids)
    assert led == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


def plain_signatures(text):
    """SpotSigs in plain Python: for each anchor the anchor and the next content words."""
    import re

    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    common = set(spotsigs.COMMON_WORDS)
    out = set()
    for i, w in enumerate(words):
        if w in common or not any(x in common for x in words[max(0, i - spotsigs.GAP) : i]):
            chain = [x for x in words[i + 1 : i + 1 + spotsigs.REACH] if x not in common][: spotsigs.CHAIN]
            out.add((w, *chain))
    return out or {("", text)}


def test_fingerprints_against_plain_python(spark, tmp_path):
    rng = random.Random(9)
    pool = [*spotsigs.COMMON_WORDS[:30], *[f"w{i}" for i in range(60)], "Élan", "x,y"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(40)] + [(50, "!!"), (51, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in spotsigs.op4_spotsigs(spark, str(tmp_path)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        a, b, e = plain_signatures(t), plain_signatures(following), plain_signatures(spot_edited(t, following))
        assert len(out[i]["fingerprint"]) == 8 * len(a)
        assert out[i]["near_next"] == pytest.approx(len(a & b) / len(a | b)) and out[i]["near_edited"] == pytest.approx(len(a & e) / len(a | e))


def test_spotsigs_likeness(spark):
    df = spotsigs.with_fingerprint(spark.createDataFrame(DOCS, "doc_id bigint, text string"), "text", "sigs")
    sigs = {r["doc_id"]: r["sigs"] for r in df.collect()}
    assert all(len(s) > 0 for s in sigs.values()) and sigs[1] == sigs[7] and sigs[5] == sigs[3]
    both = df.where("doc_id in (1, 9)").agg(spotsigs.F.min_by("sigs", "doc_id").alias("a"), spotsigs.F.max_by("sigs", "doc_id").alias("b"))
    assert both.select(spotsigs.likeness(both["a"], both["b"]).alias("x")).first()["x"] == 0
    same = spotsigs.near_duplicates(df)
    assert {r["doc_id"]: r["component_id"] for r in same.collect()}[7] == 1


def test_spotsigs_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "is"]
    rows = []
    for i in range(25):
        base = [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(100)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, edited(rng, base, 0.02)), (3 * i + 2, edited(rng, base, 0.1))]
    df = spotsigs.with_fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string"), "text", "sigs")
    sets = {r["doc_id"]: set(r["sigs"]) for r in df.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(df).collect()} == components(sets, links)


def test_op4_digest_columns(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in DOCS if i], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in spotsigs.op4_spotsigs(spark, str(tmp_path)).collect()}
    order = sorted((i, t or "") for i, t in DOCS if i)
    for k, (i, t) in enumerate(order):
        e = spot_edited(t, order[(k + 1) % len(order)][1])
        assert out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        assert 0 <= out[i]["near_edited"] <= 1


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    p = lattice_dedup.nearest_e8(x)
    doubled = np.rint(p * 2)
    assert np.allclose(doubled, p * 2) and np.all(np.rint(p.sum(1)) % 2 == 0)
    assert (((doubled % 2) == doubled[:, :1] % 2).all(1)).all()
    best = ((x - p) ** 2).sum(1)
    for v in lattice_dedup.e8_minimal():
        assert (((x - p - v) ** 2).sum(1) >= best - 1e-9).all()


def brute_vectors(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    sound = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(np.array(r[1], float))}
    sound = {k: v / np.abs(v).max() for k, v in sound.items()}  # lengths do not matter, overflow would
    label = {r[0]: r[2] for r in rows}
    links = [(a, b) for a in sound for b in sound if a < b and label[a] == label[b] and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.sqrt((sound[a] @ sound[a]) * (sound[b] @ sound[b])) >= threshold]
    return components([i for i in ids if i is not None], links), links


@pytest.mark.parametrize("small", [2, 16, 1000])
def test_near_vectors_against_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(40):
        base = rng.normal(size=32)
        for noise in (0, 0.02, 0.1, 0.15, 0.4)[: rng.integers(1, 6)]:
            rows.append((k, [float(x) for x in base + noise * rng.normal(size=32)], int(rng.integers(0, 2))))
            k += 1
    hot = rng.normal(size=32)
    rows += [(k + i, [float(x) for x in hot + 0.1 * rng.normal(size=32)], 1) for i in range(60)]  # more than a block
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], None), (902, None, 1), (903, [0.0] * 32, 1), (904, [float("nan")] * 32, 1), (905, [1.0, None] * 16, 1), (906, [1e200] * 32, 1), (907, [1e300] * 32, 1), (908, [2.0] * 5, 1), (909, [], 1)]
    monkeypatch.setattr(lattice_dedup, "BLOCK", 16)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], 1, "x")], "vec_id bigint, embedding array<double>, label int, n_links string")
    out = {r["vec_id"]: r for r in lattice_dedup.near_vectors(df.repartition(3), small=small).collect()}
    assert out.pop(None)["component_id"] is None
    want, links = brute_vectors(rows)
    counts = {i: 0 for i in want}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    got = sum(r["n_links"] for r in out.values())
    assert 0.97 * sum(counts.values()) <= got <= sum(counts.values())
    assert all(out[i]["n_links"] <= counts[i] for i in want)
    assert out[900]["component_id"] == want[900] and all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (901, 902, 903, 904, 905, 909))
    assert out[906]["component_id"] == out[907]["component_id"] == 906


@pytest.mark.parametrize("d", [3, 16, 64])
def test_sketches_lose_no_close_pair(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(3000, d))
    b = a + rng.normal(size=a.shape) * rng.choice([0.01, 0.2, 0.35, 0.6], (3000, 1)) * np.linalg.norm(a, axis=1, keepdims=True) / np.sqrt(d)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    far = np.linalg.norm(lattice_dedup.sketches(a, 1).astype(float) - lattice_dedup.sketches(b, 1), axis=1)
    assert (far[(a * b).sum(1) >= 0.93] <= lattice_dedup.sketch_bound(0.93)).all()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        a, z = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        z -= z @ a * a
        z /= np.linalg.norm(z)
        rows += [(2 * i, [float(x) for x in a], 1), (2 * i + 1, [float(x) for x in 0.9301 * a + np.sqrt(1 - 0.9301**2) * z], 1)]
    out = lattice_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert out.where("n_links > 0").count() >= 0.95 * 600


def test_near_vectors_without_rows(spark):
    assert lattice_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0
