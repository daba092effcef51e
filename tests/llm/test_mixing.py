"""Operator 4: targets, limits and repeatability."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickflow.llm.mixing import GOLDEN, mixed


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Share by weight, stop at twice the size, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    words, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = words - sum(full.values())
        level = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if level[s] > 2 * sizes[s]]
        if not above:
            return full | level
        full |= {s: 2.0 * sizes[s] for s in above}


def check(docs, tolerance):
    out = mixed(docs).collect()
    rows = [(r.doc_id, len((r.text or "").split()), r.source) for r in docs.collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in out) == sorted((i is None, i or 0, n) for i, n, _ in rows)
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    by_size = {(n, round(targets[s], 6)): s for s, n in sizes.items()}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[by_size[r.source_size, round(r.target, 6)]] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= tolerance(t, sizes[s]), (s, taken[s], t)
    return out


def test_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = check(docs, lambda t, n: 160)
    assert sorted(out) == sorted(mixed(docs.repartition(7)).collect())


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, lambda t, n: max(160, 0.05 * t))
    assert mixed(no_docs).count() == 0


@pytest.mark.parametrize("rows", [[(1, None), (2, "")], [(1, "a b c")], [(k, "w " * (100 + k % 7), None, f"s{k % 7:02d}" if k else None) for k in range(60)]])
def test_few_sources(make_docs, rows):
    check(make_docs(rows), lambda t, n: 160)


def test_schedule_equals_plain_python(make_docs):
    """Golden-ratio points, ranks and blocks one slot at a time."""
    rng = random.Random(4)
    docs = make_docs([(k, "w " * rng.choice([0, 1, 9, 40, 300]), "en", rng.choice("abcde")) for k in range(150)])
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("h")).collect()}
    rows = [(r.doc_id, len(r.text.split()), r.source) for r in docs.collect()]
    names = sorted({s for *_, s in rows})
    sizes = {s: sum(n for _, n, t in rows if t == s) for s in names}
    targets, blocks = plain_targets(sizes), {s: max(1, sizes[s] // 32) for s in names}
    wanted = [targets[s] * blocks[s] / sizes[s] for s in names]
    ends = [round(sum(wanted[: k + 1]) / sum(wanted) * 2**32) for k in range(len(names))]
    rank, times = dict.fromkeys(names, 0), defaultdict(int)
    for slot in range(round(sum(wanted))):
        point = slot * GOLDEN % 2**32
        source = names[next(k for k, end in enumerate(ends) if point < end)]
        if rank[source] < 2 * blocks[source]:
            times[source, rank[source] % blocks[source]] += 1
        rank[source] += 1
    want, start = {}, dict.fromkeys(names, 0)
    for i, n, s in sorted(rows, key=lambda r: (hashed[r[0]], r[0])):
        words = range(start[s], start[s] + n)
        want[i] = sum(times[s, min(w // 32, blocks[s] - 1)] for w in words)
        start[s] += n
    assert {r.doc_id: r.taken for r in mixed(docs).collect()} == want


def test_pipeline_mixing_stage_repeats_documents_towards_the_targets(spark, make_docs):
    rng = random.Random(5)
    docs = make_docs([(k, "w " * rng.randint(5, 60), "en", "abc"[min(2, k % 7)]) for k in range(600)])
    out = corpus_pipeline.mix(spark, docs, "")
    assert out.columns == docs.columns
    copies = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies.values()) <= {1, 2}
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixed(docs).collect()}
    assert copies == {i: n for i, (t, size) in taken.items() if (n := int(t / size + 0.5))}
    got, want = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        got[r.source] += copies.get(r.doc_id, 0) * len(r.text.split())
        want[r.source] += taken[r.doc_id][0]
    assert all(abs(got[s] - want[s]) <= 130 for s in want)
