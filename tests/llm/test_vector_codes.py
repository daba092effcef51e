"""Operator 13 against plain Python."""

import hashlib
import math
import random

from tickflow.llm.vector_codes import vector_codes


def plainly(rows, length, parts=16, entries=64, rounds=2):
    """{(vec_id, code, error)}, label errors and the codebooks' digest, one comparison at a time."""
    width = -(-length // parts)
    kept = [(i, lab, [math.floor(256 * x) for x in v] + [0] * (width * parts - length)) for i, v, lab in rows if v and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for (i, lab, _), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, code, e, total[lab], digest) for i, lab, code, e in out), key=repr)


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int, length int, vector string, e int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(3)


def exact(rng, n):
    return [rng.randrange(-1024, 1024) / 512 for _ in range(n)]


def test_codes_equal_plain_python(spark):
    rng = random.Random(1)
    rows = [(k, exact(rng, 32), rng.choice([None, 1, 2])) for k in range(300)]
    # copies of one vector, repeated and null ids, ties, far values
    rows += [(k, rows[5][1], 1) for k in range(300, 450)] + [(3, exact(rng, 32), 2), (None, exact(rng, 32), None), (500, [100.0] * 32, 2)]
    bad = [(600, None, 1), (601, [], 1), (602, [None] + [0.0] * 31, 1), (603, [float("nan")] * 32, 1), (604, [float("inf")] + [0.0] * 31, 1), (605, [0.5] * 16, 1)]
    assert got(vector_codes(frame(spark, rows + bad))) == plainly(rows, 32)


def test_length_that_parts_do_not_divide(spark):
    rng = random.Random(2)
    rows = [(k, exact(rng, 20), 1) for k in range(90)]
    assert got(vector_codes(frame(spark, rows))) == plainly(rows, 20)


def test_few_rows_and_none(spark):
    rng = random.Random(3)
    rows = [(k, exact(rng, 16), k) for k in range(5)]
    found = got(vector_codes(frame(spark, rows)))
    assert found == plainly(rows, 16) and all(e == 0 for _, _, e, *_ in found)
    empty = vector_codes(frame(spark, rows).where("false"))
    assert empty.count() == 0 and vector_codes(frame(spark, [(1, None, 1)])).columns == empty.columns
