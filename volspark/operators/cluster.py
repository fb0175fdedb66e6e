"""Seeded one-dimensional k-means over value counts, seeds, and the choice among runs.

Voxels are read once, for the counts of distinct values. A volume's counts, where they are at most FEW_VALUES, are a bounded group and
its rounds run in one task, on prefix sums. Counts of larger volumes are sorted by Spark and cut into runs; the rounds need the sums of whole
runs, at most some RUNS of them, and the values of those runs alone in which two clusters meet, which are fetched as the rounds come there.
So rounds are no jobs, however many they are, and neither a task nor the driver holds a large volume's values.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volspark.functions.stats import percentiles, value_counts
from volspark.session import cut


def uniform_seeds(vox: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """k evenly spaced values from the least to the greatest v > 0; an error for more than most, if given."""
    if most is not None and k > most:
        raise ValueError(f"at most {most} clusters")
    r = vox.where("v > 0").groupBy("vol_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / max(1, k - 1))
    return r.select("vol_id", at.alias("seeds"))


def dedupe_seeds(column: str, tolerance: float = 1e-4):
    """Sorted seeds; one nearer than tolerance to its predecessor becomes the predecessor plus tolerance."""
    step = lambda a, s: F.concat(a, F.array(F.when((F.size(a) > 0) & (s - F.element_at(a, F.greatest(F.size(a), F.lit(1))) < tolerance), F.element_at(a, F.greatest(F.size(a), F.lit(1))) + tolerance).otherwise(s)))
    return F.aggregate(F.array_sort(column), F.expr("cast(array() as array<double>)"), lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(step(a, s)))


def quantile_seeds(vox: DataFrame, k: int) -> DataFrame:
    """Percentiles 2 to 98 in k steps of v > 0, deduped."""
    ps = [(2 + 96 * i / max(1, k - 1)) / 100 for i in range(k)]
    p = percentiles(vox.where("v > 0"), ps)
    return p.select("vol_id", dedupe_seeds("p").alias("seeds"))


def warm_seeds(means: DataFrame, vox: DataFrame, k: int) -> DataFrame:
    """k - 1 means and the midpoint of the largest gap, gaps to the range of v > 0 included; no row if the size is wrong."""
    r = vox.where("v > 0").groupBy("vol_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    m = means.join(r, "vol_id").withColumn("e", F.array_sort(F.concat(F.array("lo"), "means", F.array("hi"))))
    gaps = F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.element_at("e", i + 1) - F.element_at("e", i))
    m = m.withColumn("g", gaps).withColumn("i", F.array_position("g", F.array_max("g")).cast("int"))
    mid = (F.element_at("e", F.col("i")) + F.element_at("e", F.col("i") + 1)) / 2
    return m.withColumn("seeds", F.concat("means", F.array(mid))).where(F.size("seeds") == k).select("vol_id", dedupe_seeds("seeds").alias("seeds"))


#: The bound after which a run is an error rather than an answer.
MOST_ROUNDS = 20_000
#: Distinct values of a volume (16 bytes each) that one task may hold.
FEW_VALUES = 2_000_000
#: Runs into which the values of all larger volumes are cut (a few more, as a run lies in one volume and task).
RUNS = 65_536
#: Values of runs that the driver may hold for a volume; runs that are needed again are fetched again.
HELD_VALUES = 500_000


class Values:
    """Sorted distinct values of a volume with prefix sums of counts and of values."""

    def __init__(self, v: np.ndarray, n: np.ndarray):
        order = np.argsort(v)
        self.v, self.n = v[order], n[order].astype(np.int64)
        self.c = np.concatenate(([0], np.cumsum(self.n)))
        self.centre = float(self.v @ self.n / self.c[-1])
        self.s = np.concatenate(([0.0], np.cumsum(self.n * (self.v - self.centre))))

    def above(self, least: float) -> Values:
        keep = self.v > least
        return Values(self.v[keep], self.n[keep])

    def ends(self) -> tuple[float, float]:
        return self.v[0], self.v[-1]

    def quantiles(self, ps: np.ndarray) -> np.ndarray:
        place = np.asarray(ps) * (self.c[-1] - 1)
        low = np.floor(place).astype(np.int64)
        at = lambda r: self.v[np.searchsorted(self.c[1:], r, side="right")]
        a, b = at(low), at(np.minimum(low + 1, self.c[-1] - 1))
        return a + (b - a) * (place - low)

    def edges(self, means: np.ndarray) -> np.ndarray:
        """Where the values of each mean's cluster start, and the end; ties go to the smaller mean."""
        return np.concatenate(([0], np.searchsorted(self.v, (means[1:] + means[:-1]) / 2, side="right"), [len(self.v)]))

    def lloyd(self, means: list[float], rounds: int | None) -> np.ndarray:
        means, sizes = np.sort(np.asarray(means, float)), None
        for _ in range(MOST_ROUNDS if rounds is None else rounds):
            e = self.edges(means)
            n = np.diff(self.c[e])
            means = np.where(n > 0, np.diff(self.s[e]) / np.maximum(n, 1) + self.centre, means)
            if sizes is not None and np.array_equal(n, sizes):
                return means
            sizes = n
        if rounds is None:
            raise RuntimeError(f"clusters still change after {MOST_ROUNDS} rounds")
        return means

    def scores(self, means: np.ndarray) -> tuple[float | None, float]:
        """Calinski-Harabasz (None where undefined) and mean silhouette of the values labelled by nearest mean."""
        e = self.edges(means)
        n, sums = np.diff(self.c[e]), np.diff(self.s[e])
        own = np.repeat(np.arange(len(means)), np.diff(e))
        held = n > 0
        k, total = int(held.sum()), int(self.c[-1])
        m = np.where(held, sums / np.maximum(n, 1), 0.0)
        d = self.v - self.centre
        within = float(self.n @ (d - m[own]) ** 2)
        ch = float(n[held] @ m[held] ** 2) / (k - 1) / (within / (total - k)) if k > 1 and total > k and within > 0 else None
        a, b = np.full(len(d), np.nan), np.full(len(d), np.inf)
        for j in np.flatnonzero(held):
            at = np.clip(np.arange(1, len(d) + 1), e[j], e[j + 1])  # members of j up to each value
            c, s = self.c[at] - self.c[e[j]], self.s[at] - self.s[e[j]]
            away = d * c - s + (sums[j] - s) - d * (n[j] - c)
            mine = own == j
            if n[j] > 1:
                a[mine] = away[mine] / (n[j] - 1)
            b[~mine] = np.minimum(b[~mine], away[~mine] / n[j])
        if k < 2:
            return ch, 0.0
        top = np.maximum(a, b)
        one = np.where(np.isnan(a) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))
        return ch, float(self.n @ one / total)


class Runs:
    """The sorted distinct values of a volume as runs: of each its ends, count, and sums of values and squares, less the volume's mean. The values of a
    run, of which few are needed, come from fetch(lows of runs), a dict from low to values and counts. above: values up to it do not count."""

    def __init__(self, runs: np.ndarray, centre: float, size: int, fetch, above: float | None = None, held: dict | None = None):
        self.lo, self.hi, n, s, q = runs
        self.rows, self.centre, self.size, self.fetch = runs, centre, size, fetch
        self.c = np.concatenate(([0], np.cumsum(n.astype(np.int64))))
        self.s, self.q = (np.concatenate(([0.0], np.cumsum(x))) for x in (s, q))
        self.held = {} if held is None else held
        self.floor = above
        self.base = np.zeros(3) if above is None else self.sums(np.array([above]))[0]

    def above(self, least: float) -> Runs:
        return Runs(self.rows, self.centre, self.size, self.fetch, least, self.held)

    def total(self) -> int:
        return int(self.c[-1] - self.base[0])

    def load(self, runs: set[int]) -> None:
        """Holds the values of these runs (at most some HELD_VALUES)."""
        new = [i for i in sorted(runs) if i not in self.held]
        if (len(self.held) + len(new)) * self.size > HELD_VALUES:
            for i in [i for i in self.held if i not in runs]:
                del self.held[i]
        if new:
            got = self.fetch(self.lo[new].tolist())
            for i in new:
                v, n = got[self.lo[i]]
                d = v - self.centre
                self.held[i] = (v, *[np.concatenate(([0], np.cumsum(x))) for x in (n, n * d, n * d * d)])

    def _most(self) -> int:
        return max(8, HELD_VALUES // self.size)

    def guessed(self, places: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Count, sum and squares of the values up to each place, and the runs in which places lie; of those not held the part is estimated."""
        out, inside = np.zeros((len(places), 3)), set()
        for k, (p, i) in enumerate(zip(places.tolist(), np.searchsorted(self.hi, places, side="right").tolist(), strict=True)):
            out[k] = self.c[i], self.s[i], self.q[i]
            if i < len(self.lo) and self.lo[i] <= p:
                inside.add(i)
                if i in self.held:
                    v, *sums = self.held[i]
                    j = np.searchsorted(v, p, side="right")
                    out[k] += [x[j] for x in sums]
                else:
                    part = (p - self.lo[i]) / (self.hi[i] - self.lo[i])
                    out[k] += [part * (x[i + 1] - x[i]) for x in (self.c, self.s, self.q)]
        return out, inside

    def sums(self, places: np.ndarray) -> np.ndarray:
        """The same, exact, and less what does not count."""
        places = np.asarray(places, float)
        if self.floor is not None:
            places = np.maximum(places, self.floor)
        self.load(self.guessed(places)[1])
        return self.guessed(places)[0] - (self.base if self.floor is not None and hasattr(self, "base") else 0)

    def ends(self) -> tuple[float, float]:
        return float(self.quantiles(np.array([0.0]))[0]), float(self.hi[-1])

    def quantiles(self, ps: np.ndarray) -> np.ndarray:
        base = int(self.base[0])
        place = np.asarray(ps) * (self.total() - 1)
        low = np.floor(place).astype(np.int64)

        def at(ranks: np.ndarray) -> np.ndarray:
            out = []
            for r in (ranks + base).tolist():
                i = int(np.searchsorted(self.c[1:], r, side="right"))
                self.load({i})
                v, n = self.held[i][:2]
                out.append(v[np.searchsorted(n[1:], r - self.c[i], side="right")])
            return np.array(out)

        a, b = at(low), at(np.minimum(low + 1, self.total() - 1))
        return a + (b - a) * (place - low)

    def lloyd(self, means: list[float], rounds: int | None) -> np.ndarray:
        """Rounds go on by estimates where values are missing, to learn which runs they come by; these are fetched, and the rounds
        repeated from the first one that was estimated, until all are exact."""
        most = MOST_ROUNDS if rounds is None else rounds
        exact = (0, np.sort(np.asarray(means, float)), None)
        while True:
            (done, means, sizes), wanted, guess = exact, set(), False
            while done < most:
                got, inside = self.guessed((means[1:] + means[:-1]) / 2)
                if guess and len(wanted | inside) > self._most():
                    break
                guess = guess or not inside <= self.held.keys()
                wanted = wanted | inside if guess else set()
                ends = np.concatenate(([[0.0] * 3], got, [[self.c[-1], self.s[-1], self.q[-1]]]))
                n, s = np.rint(np.diff(ends[:, 0])).astype(np.int64), np.diff(ends[:, 1])
                means = np.sort(np.where(n > 0, s / np.maximum(n, 1) + self.centre, means))
                done += 1
                if sizes is not None and np.array_equal(n, sizes):
                    if not guess:
                        return means
                    break
                sizes = n
                if not guess:
                    exact = (done, means, sizes)
            if not guess:
                if rounds is None:
                    raise RuntimeError(f"clusters still change after {MOST_ROUNDS} rounds")
                return means
            self.load(wanted)

    def clusters(self, means: np.ndarray) -> np.ndarray:
        """Count, sum and squares up to where each mean's cluster starts, and the end."""
        got = self.sums((means[1:] + means[:-1]) / 2)
        return np.concatenate((np.zeros((1, 3)), got, [[self.c[-1], self.s[-1], self.q[-1]] - self.base]))

    def scores(self, means: np.ndarray) -> tuple[float | None, float]:
        """Calinski-Harabasz as Values has it; the silhouette (of silhouettes()) is not known yet."""
        n, s, q = np.diff(self.clusters(means), axis=0).T
        held, total = n > 0, self.total()
        k, m = int(held.sum()), s / np.maximum(n, 1)
        within = float((q - n * m * m)[held].sum())
        between = float((n * (m - s.sum() / max(total, 1)) ** 2)[held].sum())
        return between / (k - 1) / (within / (total - k)) if k > 1 and total > k and within > 0 else None, float("nan")


_RUN = "vol_id string, lo double, hi double, n long, s double, q double, v binary, c binary"


def _in_runs(n: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Value counts of sizes' volumes, sorted over all tasks, as runs of size values (see Runs); s and q less the volume's mean."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            held = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            vols = held.column("vol_id").to_pandas().to_numpy()
            cuts = [0, *(np.flatnonzero(vols[1:] != vols[:-1]) + 1).tolist(), len(vols)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                whole = end if end < len(vols) else end - (end - start) % size
                yield from rows(held.slice(start, whole - start))
            rest = held.slice(whole)
        if rest is not None:
            yield from rows(rest)

    def rows(held: pa.Table) -> Iterator[pa.RecordBatch]:
        if not held.num_rows:
            return
        v, c = held.column("v").to_numpy().astype(np.float64), held.column("n").to_numpy().astype(np.int64)
        d = v - held.column("centre")[0].as_py()
        at = np.arange(0, len(v), size)
        ends = np.append(at[1:], len(v))
        some = [[x[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)] for x in (v, c)]
        arrays = [pa.array([held.column("vol_id")[0].as_py()] * len(at)), pa.array(v[at]), pa.array(v[ends - 1]), *[pa.array(np.add.reduceat(x, at)) for x in (c, c * d, c * d * d)], *[pa.array(x, pa.binary()) for x in some]]
        yield pa.RecordBatch.from_arrays(arrays, names=["vol_id", "lo", "hi", "n", "s", "q", "v", "c"])

    own = n.join(F.broadcast(sizes.select("vol_id", "centre")), "vol_id").select("vol_id", F.col("v").cast("double").alias("v"), "n", "centre")
    tasks = int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(own.repartitionByRange(tasks, "vol_id", "v").sortWithinPartitions("vol_id", "v").mapInArrow(gather, _RUN))


def _large(n: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None, dict[str, Runs]]:
    """Value counts of the volumes of at most bound values, and the others as runs."""
    sizes = cut(n.groupBy("vol_id").agg(F.count("*").alias("k"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("centre")))
    total = sizes.where(F.col("k") > bound).agg(F.sum("k")).first()[0]
    if total is None:
        return n, None, {}
    size = max(16, -(-total // RUNS))
    table = _in_runs(n, sizes.where(F.col("k") > bound), size)
    centres = {r["vol_id"]: r["centre"] for r in sizes.where(F.col("k") > bound).collect()}
    ends = table.select("vol_id", "lo", "hi", "n", "s", "q").toPandas().sort_values(["vol_id", "lo"])

    def fetch(vol: str):
        def of(lows: list[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
            at = table.where((F.col("vol_id") == vol) & F.col("lo").between(min(lows), max(lows)) & F.col("lo").isin(lows)).select("lo", "v", "c").collect()
            return {r["lo"]: (np.frombuffer(r["v"], np.float64), np.frombuffer(r["c"], np.int64)) for r in at}

        return of

    runs = {vol: Runs(own[["lo", "hi", "n", "s", "q"]].to_numpy(float).T, centres[vol], size, fetch(vol)) for vol, own in ends.groupby("vol_id")}
    return n.join(F.broadcast(sizes.where(F.col("k") <= bound).select("vol_id")), "vol_id", "left_semi"), table, runs


def _each(f, runs: dict[str, Runs]) -> list:
    """f(volume, its runs) of all volumes, whose jobs overlap."""
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(lambda item: f(*item), runs.items()))


def kmeans(vox: DataFrame, seeds: DataFrame, rounds: int | None = None, bound: int = FEW_VALUES) -> DataFrame:
    """vol_id, means (sorted) after Lloyd rounds over the whole volume, until no voxel changes its cluster or, if given, so many rounds;
    ties to the smaller mean; an empty cluster keeps its mean.

    Clusters are intervals of values, so equal cluster sizes in two rounds on end are equal clusters: a test in whole
    numbers, which does not depend on the order in which sums are added."""
    schema = "vol_id string, means array<double>"
    n, _, runs = _large(cut(value_counts(vox).where("v is not null")), bound)

    def run(counts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(counts) or not len(own):
            return pd.DataFrame({"vol_id": [], "means": []}, dtype=object)
        means = Values(counts["v"].to_numpy(float), counts["n"].to_numpy()).lloyd(own["seeds"].iloc[0], rounds)
        return pd.DataFrame({"vol_id": [own["vol_id"].iloc[0]], "means": [means.tolist()]})

    found = n.groupBy("vol_id").cogroup(seeds.groupBy("vol_id")).applyInPandas(run, schema)
    if not runs:
        return found
    own = {r["vol_id"]: r["seeds"] for r in seeds.where(F.col("vol_id").isin(list(runs))).collect()}
    made = _each(lambda vol, r: (vol, r.lloyd(own[vol], rounds).tolist()), {vol: r for vol, r in runs.items() if vol in own})
    return found.unionByName(vox.sparkSession.createDataFrame(made, schema))


def silhouettes(table: DataFrame, runs: dict[str, Runs], rows: list[tuple]) -> list[float]:
    """The mean silhouette of v > 0 for each of rows (volume, k, name, means), in one pass over the runs of all volumes. Clusters are intervals, so the mean
    distance to another cluster is that to its mean, and the one to the own cluster follows from the count and sum of its members up to a value."""
    known: dict[str, list] = {}
    for i, row in enumerate(rows):
        ahead, means = runs[row[0]].above(0.0), np.asarray(row[3])
        edges = ahead.clusters(means)
        known.setdefault(row[0], []).append((i, (means[1:] + means[:-1]) / 2, edges[:, 0], edges[:, 1]))
    start = {vol: (r.lo, r.c, r.s, r.centre, r.above(0.0).base) for vol, r in runs.items() if vol in known}
    shared = table.sparkSession.sparkContext.broadcast((known, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = shared.value
        out: dict[int, float] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["vol_id"] not in known:
                    continue
                lows, c0, s0, centre, base = start[r["vol_id"]]
                v, n = np.frombuffer(r["v"], np.float64), np.frombuffer(r["c"], np.int64)
                at = int(np.searchsorted(lows, r["lo"]))
                keep = v > 0
                if not keep.any():
                    continue
                d = v - centre
                c, s = (c0[at] - base[0] + np.cumsum(n))[keep], (s0[at] - base[1] + np.cumsum(n * d))[keep]
                v, n, d = v[keep], n[keep], d[keep]
                for i, mids, ends, sums in known[r["vol_id"]]:
                    out[i] = out.get(i, 0.0) + _run_silhouette(v, n, d, c, s, mids, ends, sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.float64())], names=["i", "t"])

    got = {r["i"]: r["t"] for r in table.select("vol_id", "lo", "v", "c").mapInArrow(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()}
    return [got.get(i, 0.0) / max(1, runs[row[0]].above(0.0).total()) for i, row in enumerate(rows)]


def _run_silhouette(v: np.ndarray, n: np.ndarray, d: np.ndarray, c: np.ndarray, s: np.ndarray, mids: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> float:
    size, total = np.diff(ends), np.diff(sums)
    held = np.flatnonzero(size > 0)
    if len(held) < 2:
        return 0.0
    own = np.searchsorted(mids, v, side="left")
    m = total[held] / size[held]
    c, s = c - ends[own], s - sums[own]
    away = d * c - s + (total[own] - s) - d * (size[own] - c)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(size[own] > 1, away / (size[own] - 1), np.nan)
    b = np.where(held[None, :] == own[:, None], np.inf, np.abs(d[:, None] - m[None, :])).min(axis=1)
    top = np.maximum(a, b)
    return float(n @ np.where(np.isnan(a) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top)))


def label_by_means(vox: DataFrame, means: DataFrame) -> DataFrame:
    """vol_id, z, y, x, v, label: nearest mean, ties to the smaller."""
    label = F.size(F.filter(F.sequence(F.lit(2), F.size("means")), lambda j: F.col("v") > (F.element_at("means", j - 1) + F.element_at("means", j)) / 2))
    return vox.join(F.broadcast(means), "vol_id").select("vol_id", "z", "y", "x", "v", F.when(F.size("means") > 1, label).otherwise(0).alias("label"))


def _deduped(seeds: np.ndarray, tolerance: float = 1e-4) -> list[float]:
    out: list[float] = []
    for s in np.sort(seeds).tolist():
        out.append(out[-1] + tolerance if out and s - out[-1] < tolerance else s)
    return out


def _warm(means: np.ndarray, lo: float, hi: float) -> list[float]:
    e = np.sort(np.concatenate(([lo], means, [hi])))
    i = int(np.argmax(np.diff(e)))
    return _deduped(np.concatenate((means, [(e[i] + e[i + 1]) / 2])))


def _sweep_values(vol_id: str, whole: Values | Runs, ks: list[int], rounds: int | None) -> list[tuple]:
    ahead, out, previous = whole.above(0.0), [], None
    for k in ks:
        runs = {"quantile_anchored": _deduped(ahead.quantiles(np.array([(2 + 96 * i / max(1, k - 1)) / 100 for i in range(k)])))}
        if previous is not None and len(previous) == k - 1:
            runs["warm_start"] = _warm(previous, *ahead.ends())
        rows = []
        for name, seeds in runs.items():
            means = whole.lloyd(seeds, rounds)
            rows.append((vol_id, k, name, means.tolist(), *ahead.scores(means)))
        out += rows
        scored = [r for r in rows if r[4] is not None]
        previous = np.array(max(scored, key=lambda r: r[4])[3]) if scored else None  # of equals the first
    return out


def sweep(vox: DataFrame, ks: range, rounds: int | None = None, bound: int = FEW_VALUES) -> DataFrame:
    """k, strategy, means, ch, silhouette (both of v > 0). Warm starts need the means of k - 1 (of its better strategy by ch), so k runs in order;
    volumes are independent."""
    n, table, runs = _large(cut(value_counts(vox).where("v is not null")), bound)
    numbers, schema = list(ks), "vol_id string, k int, strategy string, means array<double>, ch double, silhouette double"

    def run(counts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if (counts["v"] > 0).any():
            rows = _sweep_values(counts["vol_id"].iloc[0], Values(counts["v"].to_numpy(float), counts["n"].to_numpy()), numbers, rounds)
        return pd.DataFrame(rows, columns=["vol_id", "k", "strategy", "means", "ch", "silhouette"]).astype({"ch": "float64"})

    found = n.groupBy("vol_id").applyInPandas(run, schema)
    found = found.withColumn("ch", F.when(~F.isnan("ch"), F.col("ch")))
    if not runs:
        return found
    rows = [r for some in _each(lambda vol, r: _sweep_values(vol, r, numbers, rounds) if r.above(0.0).total() else [], runs) for r in some]
    rows = [(*r[:5], float(x)) for r, x in zip(rows, silhouettes(table, runs, rows), strict=True)]
    return found.unionByName(vox.sparkSession.createDataFrame(rows, schema))


def spread_labels(labels: DataFrame, k: int) -> DataFrame:
    """Labels 0 .. k - 1 as values over the range of a byte, 255 // k - 1 apart."""
    return labels.withColumn("label", (F.col("label") * (255 // k - 1)).cast("int"))


def best_runs(rows: DataFrame) -> DataFrame:
    """The run of greatest ch of each volume; of equals the smaller k, then the strategy that comes first. Undefined ch never wins."""
    w = Window.partitionBy("vol_id").orderBy(F.desc_nulls_last("ch"), "k", "strategy")
    return rows.where("ch is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_per_k(rows: DataFrame) -> DataFrame:
    """vol_id, best: a map from k to strategy, ch and silhouette of the run of greatest ch."""
    w = Window.partitionBy("vol_id", "k").orderBy(F.desc_nulls_last("ch"), "strategy")
    top = rows.where("ch is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.groupBy("vol_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.struct("strategy", "ch", "silhouette"))))).alias("best"))
