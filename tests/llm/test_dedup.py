"""Operators 2, 3, 6 and 7 against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tickflow.llm import line_dedup, shingles, simhash, suffix_dedup
from tickflow.llm.common import WHITE
from tickflow.llm.exact_dedup import exact_duplicates
from tickflow.llm.graph import components


def test_exact_duplicates_on_odd_rows(odd_docs, no_docs):
    got = Counter(tuple(r) for r in exact_duplicates(odd_docs).collect())
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter()
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want[i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    assert exact_duplicates(no_docs).count() == 0


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    ids = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                ids[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(ids[key(x)]) < 2 or i == min(ids[key(x)])]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_duplicates_on_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(tuple(r) for r in line_dedup.line_duplicates(odd_docs).collect()) == brute_lines(rows)
    assert line_dedup.line_duplicates(no_docs).count() == 0


def test_line_duplicates_random(make_docs):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["ab", "CD", "é", "long-word"]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(80)]
    rows += [(200 + k, "the same line in every document\n" + str(k)) for k in range(100)]
    assert Counter(tuple(r) for r in line_dedup.line_duplicates(make_docs(rows)).collect()) == brute_lines(rows)


# --- SimHash ------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in WHITE}).split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=3):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                up[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(fps))]


@pytest.mark.parametrize("fine_from", [0, 1 << 28])
def test_near_duplicates_equal_brute_force(odd_docs, no_docs, make_docs, monkeypatch, fine_from):
    monkeypatch.setattr(simhash, "FINE_FROM", fine_from)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([2, 30, 300, 600]))]
        for j in range(rng.randint(1, 5)):
            edited = list(base)
            for _ in range(j):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, " ".join(edited)))
    fps = [plain_fingerprint(t) for _, t in rows]
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components([i for i, _ in rows], fps), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(make_docs(rows)).collect()) == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("codes", [simhash.GOLAY, simhash.FINE])
def test_every_word_is_within_the_radius_of_one_anchor_and_pairs_meet(codes):
    tables = [(c, *simhash.near_words(c, 2)) for c in codes]
    assert all(((costs == 0).sum(axis=1) == 1).all() for *_, costs in tables)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for x in base:
        bits = rng.choice(64, 3, replace=False)
        pair = np.array([x, x ^ np.uint64(sum(1 << int(b) for b in bits))], np.uint64)
        row, key = simhash.anchors(pair, tables, 2, 1)
        near = {k >> 1 for r, k in zip(row, key, strict=True) if r == 0 and not k & 1}
        assert near & {k >> 1 for r, k in zip(row, key, strict=True) if r == 1}


def test_large_groups_give_spanning_links_not_all_pairs():
    rng = np.random.default_rng(6)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(40, 2, replace=False)) for _ in range(3000)], np.uint64))
    for large in (10, 10**6):
        simhash.LARGE, keep = large, simhash.LARGE
        try:
            links = simhash.linked(np.zeros(len(fps), np.int64), fps, 3)
        finally:
            simhash.LARGE = keep
        assert len(links) <= len(fps)
        assert len(set(brute_components(list(range(len(fps))), [int(f) for f in fps]))) == len(fps) - len(simhash._forest(len(fps), links))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_paths_stars_and_rings(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2000 + (k + 1) % 9) for k in range(9)] + [(5, 5)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {0, 1000, 2000} and len(got) == 61 + 200 + 9
    assert all(got[k] == (0 if k < 100 else 1000 if k < 1500 else 2000) for k in got)


# --- repeated passages --------------------------------------------------------------------------------------


def brute_passages(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_passages_equal_brute_force(make_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_SPANS", 0)
    rng = random.Random(11 + broadcast)
    noise = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    base = [noise(rng.randint(300, 2500)) for _ in range(8)]
    texts = [None, "", "short", noise(7, "ab") * 90, "aaaa" * 300]
    for _ in range(50):
        b, kind = rng.choice(base), rng.random()
        if kind < 0.2:
            texts.append(b)
        elif kind < 0.6:
            edited = list(b)
            for _ in range(rng.randint(1, 6)):
                edited[rng.randrange(len(edited))] = rng.choice("xyz")
            texts.append("".join(edited))
        else:
            size = rng.choice([380, 398, 399, 400, 401, 402, 440])
            at = rng.randrange(max(1, len(b) - size))
            texts.append(noise(rng.randint(0, 500)) + b[at : at + size] + noise(rng.randint(0, 500)) + (b[:450] if kind > 0.95 else ""))
    passage = noise(390)
    texts += [noise(300) + passage + noise(300) for _ in range(20)]
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.repeated_passages(make_docs(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == brute_passages(texts)


def test_repeated_passages_on_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter((i, *r) for (i, _), r in zip(rows, brute_passages([t for _, t in rows]), strict=True))
    assert Counter(tuple(r)[:5] for r in suffix_dedup.repeated_passages(odd_docs).collect()) == want
    assert suffix_dedup.repeated_passages(no_docs).count() == 0


def test_merge_keeps_order_and_shared_lengths():
    rng = random.Random(3)
    items = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(400)})
    for n in (1, 2, 3, 7):
        runs = [suffix_dedup.front_coded([(x, b"o", 1) for x in items if rng.random() < 0.6]) for _ in range(n)]
        want = sorted(x for r in runs for _, x, _, _ in suffix_dedup.decoded(r))
        out = list(suffix_dedup.merged(runs))
        assert [x for _, x, _, _ in out] == want
        assert all(s == suffix_dedup.common(a, b) for a, (s, b, _, _) in zip(want, out[1:], strict=False))


# --- near copies by shingles --------------------------------------------------------------------------------


def jaccard(a, b, n=5):
    sets = []
    for text in (a, b):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in WHITE}).split()
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_find_pairs_of_similarity_and_no_others(spark, make_docs, odd_docs, no_docs):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 10_000]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 150, 600]))]
        for j in range(rng.randint(1, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(edited) // 40))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, " ".join(edited)))
    base = [rng.choice(words) for _ in range(100)]  # each is near the one before, the ends are far apart
    for j in range(30):
        base[3 * j] = "new"
        rows.append((5000 + j, " ".join(base)))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    rows_by_id = {i: t or "" for i, t in rows}
    whole = {i: root(k) for k, (i, _) in enumerate(rows)}
    want = Counter((i, least.get(root(k))) for k, (i, _) in enumerate(rows))
    got = shingles.near_copies(make_docs(rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    named = {r.doc_id: r.component_id for r in got}
    assert all(whole[i] == whole[c] for i, c in named.items() if i is not None and c is not None)  # no pair that is not near
    near = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8 and None not in (rows[a][0], rows[b][0])]
    assert sum(named[a] == named[b] for a, b in near) >= 0.95 * len(near) > 90
    assert all(named[a] == named[b] for a, b in near if Counter(rows_by_id[a].lower().split()) == Counter(rows_by_id[b].lower().split()))
    assert shingles.near_copies(no_docs).count() == 0
    gone = {i for (i, c) in want if i != c}
    assert len(gone) > 60
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), "").collect()} == {i for i, _ in rows} - gone


def test_near_copies_of_one_word_set_in_many_orders(spark, make_docs):
    """Pairs that are near each other while all texts have the same words, so that their fingerprints don't tell them apart."""
    rng = random.Random(9)
    words, rows = [f"w{k}" for k in range(300)], []
    for k in range(40):
        text = rng.sample(words, len(words))
        rows.append((2 * k, " ".join(text)))
        text[150], text[151] = text[151], text[150]
        rows.append((2 * k + 1, " ".join(text)))
    assert all(jaccard(rows[k][1], rows[k + 1][1]) >= 0.94 for k in range(0, 80, 2))
    named = {r.doc_id: r.component_id for r in shingles.near_copies(make_docs(rows)).collect()}
    assert all(c <= i <= c + 1 and c % 2 == 0 for i, c in named.items())
    assert sum(named[2 * k + 1] == 2 * k for k in range(40)) >= 36


def test_sketches_clear_small_sets_and_never_similar_ones(spark):
    """Sets under 128 shingles had no sketch: all pairs of a large group of short texts went on to the texts."""
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    similar, apart = [], []
    for n in (1, 3, 20, 60, 127, 128, 200, 255):
        for _ in range(30):
            a = draw(n)
            b = np.unique(np.r_[a[: n - n // 12], draw(n // 12)])
            assert shingles.similarity(a, b) >= 0.8
            similar.append((a, b))
            if n >= 20:
                apart.append((a, np.unique(np.r_[a[: n // 2], draw(n - n // 2)])))
    for pairs, passed in ((similar, True), (apart, False)):
        kept = shingles.maybe_similar(*([shingles.sketch(p[k]) for p in pairs] for k in (0, 1)), 0.8)
        assert kept.all() if passed else not kept.any()
    assert shingles.maybe_similar([], [], 0.8).tolist() == []
    assert shingles.maybe_similar([shingles.sketch(draw(250))], [shingles.sketch(draw(260))], 0.8).all()  # of two kinds: the texts decide
    pairs = spark.createDataFrame([(1, k) for k in range(2, 40)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(k, bytearray(shingles.sketch(draw(60)))) for k in range(1, 40)], "key bigint, sketch binary")
    assert shingles._alike(shingles.written(pairs), nodes, 38, 0.8).count() == 0


def test_candidates_are_joined_once(spark):
    """The rows of the first join were made again to count the keys of the second."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pairs = shingles.written(spark.createDataFrame([(k, 1000 + k % 7) for k in range(500)], "a bigint, b bigint"))
    values = shingles.written(spark.range(2000).selectExpr("id AS key", "cast(id AS string) AS text")).mapInArrow(counted, "key bigint, text string")
    rows = shingles._joined(pairs, values, "text", 500).collect()
    assert sorted((r.a, r.b, r.text_a, r.text_b) for r in rows) == [(k, 1000 + k % 7, str(k), str(1000 + k % 7)) for k in range(500)]
    assert seen.value <= 2 * 2000
