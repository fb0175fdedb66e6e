import math

import numpy as np

from volspark.llm import codes, exact


def brute(rows, parts=4, entries=256, rounds=4):
    """Whole Lloyd rounds in Python integers. rows: (id, vector) of one length; code and error of each kept row, and the codebooks."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    first = {}
    for i, x in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, x)
    s = len(kept[0][1]) // parts
    books = [[x[p * s : (p + 1) * s] for x in list(first.values())[:entries]] for p in range(parts)]

    def assign(x):
        return [min((sum((a - b) ** 2 for a, b in zip(x[p * s : (p + 1) * s], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        at = [assign(x) for _, x in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p * s : (p + 1) * s] for (_, x), a in zip(kept, at, strict=True) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = sorted((-1 if i is None else i, "".join(f"{e:02x}" for _, e in a), min(sum(d for d, _ in a), (1 << 63) - 1)) for (i, _), a in ((r, assign(r[1])) for r in kept))
    return out, books


def run(spark, rows, **more):
    d = spark.createDataFrame([(i, v, 1, "c", "w") for i, v in rows], "vec_id long, embedding array<float>, x int, code string, was string").repartition(3)
    out, books, code, error = codes.vector_codes(d, **more)
    got = out.collect()
    assert all((r["x"], r["code"], r["was"]) == (1, "c", "w") for r in got)
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r[code].hex(), r[error]) for r in got), books and [p.tolist() for p in books.entries]


def test_equals_whole_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).round(1).tolist()) for i in rng.permutation(200)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # copies
    rows += [(3, [9.0] * 8), (None, [2.0] * 8), (2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8)]
    for more in ({"entries": 12}, {"entries": 20, "parts": 2, "rounds": 1}, {"entries": 5, "rounds": 0}, {}):
        assert run(spark, rows, **more) == brute(rows, **more)


def test_equal_ids_and_entries(spark):
    rows = [(1, [1.0, 2.0])] * 40 + [(2, [1.0, 2.0]), (3, [5.0, 5.0]), (4, [1.0, 2.5])]
    assert run(spark, rows, parts=2, entries=3) == brute(rows, parts=2, entries=3)


def test_values_of_any_size(spark):
    rng = np.random.default_rng(2)
    for scale in (1e3, 1e8, 1e20):
        rows = [(i, (rng.normal(size=4) * scale).tolist()) for i in range(60)]
        rows += [(100, [0.001, 0.002, 0.003, 0.004])]
        assert run(spark, rows, parts=2, entries=6) == brute(rows, parts=2, entries=6)


def test_few_rows_and_lengths(spark):
    assert run(spark, []) == ([], None)
    assert run(spark, [(1, None), (2, [1.0, 2.0, 3.0]), (None, [1.0] * 4)]) == ([], None)  # no id to start from
    assert run(spark, [(5, [1.0] * 4)]) == ([(5, "00000000", 0)], [[[1024]]] * 4)
    assert [r[0] for r in run(spark, [(1, [1.0] * 4), (2, [2.0] * 4), (3, [1.0] * 8), (4, [1.0] * 3)])[0]] == [1, 2]


def test_only_changes_are_shuffled(spark, monkeypatch):
    """The contributions of a round are those of changed parts: none once the assignment stands still."""
    seen = []

    def counted(partial, keys):
        seen.append(partial.count())
        return exact.exact_sums(partial, keys)

    monkeypatch.setattr(codes, "exact_sums", counted)
    rows = [(i, [float(i % 3) * 100] * 4) for i in range(60)]
    assert run(spark, rows, entries=3) == brute(rows, entries=3)
    assert seen[0] > 0 and seen[1:] == [0, 0, 0]


def test_packed_rows():
    import pyarrow as pa

    small, large = np.array([[-32768.0, 32767.0]]), np.array([[1e9, -5.0]])
    rows = codes.packed(small) + codes.packed(large)
    assert [len(r) for r in rows] == [4, 16]
    assert codes.unpacked(pa.array(rows), 2).tolist() == [small[0].tolist(), large[0].tolist()]


def test_jobs_do_not_grow_with_partitions(spark):
    """Sums of changed parts come to the driver in one job a round, not one for each shuffle partition."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(40)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("codes-jobs", "codes-jobs")
    try:
        run(spark, rows, entries=4, rounds=2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("codes-jobs")
        spark.sparkContext.setJobGroup("rest", "rest")
    assert 0 < len(jobs) < 40
