"""Most similar vectors for every vector: shifted Hilbert orderings of projected vectors.

Each of ``CURVES`` curves projects the unit vectors on ``DIMENSIONS`` axes, shifts the grid, and orders the
vectors along a Hilbert curve. The axes are random rotations within the ``SPREAD`` directions of greatest
variance, which are fitted on at most about ``FIT_ROWS`` vectors of a space, chosen by a hash of the id;
every vector is placed on every curve. Spark range-partitions and sorts the curves by key and id, so a key
of any frequency is spread over partitions, and each partition is read as a stream: a vector is compared
with the ``WINDOW`` vectors on either side of it, as products of small matrices, and no partition is ever
held in memory. What travels along the curves is an id and two bytes per number; each curve's best
``k + SPARE`` finds are merged, and those are reranked by the exact cosine of the whole vectors, which are
joined once. A partition's ends cut some windows off, at other places on every curve.

Equal vectors of one model are first reduced to one (the smallest id), and their members are brought in
afterwards from at most ``k + 1`` of the smallest ids of each group, so a group of any size stays linear.
The only thing gathered on the driver are the axes: one row per space.

The result is approximate. Recall against brute force stands in the README; ``exact_neighbours`` gives the
exact answer for a stated set of queries by comparing it, in blocks, with all vectors.

Defined results: null, empty and all-zero vectors and those with a null, infinite or NaN number take no
part; vectors of another length count as another space; ties in similarity go to the smaller id; rows
repeated under the same id count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtmill.session import checkpoint

CURVES = 12
DIMENSIONS = 6
BITS = 6
SPREAD = 16
FIT_ROWS = 20_000
WINDOW = 1_024
SPARE = 2
#: Rows compared with their windows at a time.
ROWS_AT_ONCE = 512
QUERIES_AT_ONCE = 10_000
K = 5
#: Greatest error of a similarity of vectors in two bytes a number, with room to spare.
BYTE_ERROR = 0.001
#: Places to which similarities are ranked: what differs less is a tie.
PLACES = 9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer grid cells, shape (rows, dimensions); bits * dimensions <= 62."""
    x = cells.astype(np.uint32).T.copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        mask = np.uint32(q - 1)
        for i in range(dims):
            swap = (x[0] ^ x[i]) & mask
            flip = (x[i] & np.uint32(q)) != 0
            x[0] ^= np.where(flip, mask, swap)
            x[i] ^= np.where(flip, np.uint32(0), swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> np.uint32(bit)) & 1).astype(np.int64)
    return key


class Axes:
    """Mean, directions of greatest variance and their variances, of one space."""

    def __init__(self, unit: np.ndarray):
        width = unit.shape[1]
        self.mean = unit.mean(axis=0)
        _, values, directions = np.linalg.svd(unit - self.mean, full_matrices=False)
        if len(directions) < min(SPREAD, width):  # fewer vectors than directions: any axes will do
            values, directions = np.ones(width), np.eye(width)
        self.directions = directions[:SPREAD]
        self.variance = np.maximum((values**2 / len(unit))[:SPREAD], 1e-12)

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        """The vectors' keys on a curve."""
        spread = len(self.directions)
        dims = min(DIMENSIONS, spread)
        rng = np.random.default_rng([curve, spread])
        turn = np.linalg.qr(rng.normal(size=(spread, spread)))[0][:, :dims]
        place = (unit - self.mean) @ (self.directions.T @ turn) / np.sqrt((turn**2).T @ self.variance) + rng.uniform(-0.4, 0.4, size=dims)
        return hilbert_keys(np.clip((place + 3.0) / 6.0 * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _units(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length scaled to length 1."""
    whole = np.stack(vectors.to_numpy()).astype(np.float64)
    return whole / np.linalg.norm(whole, axis=1, keepdims=True)


def to_bytes(unit: np.ndarray) -> list[bytes]:
    """Each vector as its greatest absolute number (4 bytes) and two signed bytes per number."""
    scale = np.abs(unit).max(axis=1, keepdims=True).astype(np.float32)
    packed = np.concatenate([scale.view(np.int16), np.rint(unit / scale * 32767).astype(np.int16)], axis=1)
    return [row.tobytes() for row in packed]


def of_bytes(codes: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), dtype=np.int16).reshape(len(codes), -1)
    return packed[:, 2:].astype(np.float32) * (packed[:, :2].copy().view(np.float32) / np.float32(32767))


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, space, v, h1, h2) of the vectors that take part, each id once."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    kept = embeddings.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & fine)
    space = F.concat_ws("\u0001", F.coalesce("model_id", F.lit("\u0000")), F.size("vector").cast("string"))
    vector = F.transform("vector", lambda x: x.cast("float") + F.lit(0.0).cast("float"))  # -0.0 equals 0.0
    rows = kept.select("id", space.alias("space"), vector.alias("v"))
    if not embeddings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["id"])
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("copy"), F.reverse("v"))})


def fitted(reps: DataFrame) -> dict[str, tuple[int, Axes]]:
    """The axes of each space and its number; a task fits at most about FIT_ROWS vectors."""
    sizes = reps.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    chance = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = reps.join(F.broadcast(sizes), "space").filter(chance * F.col("n") < FIT_ROWS).select("space", "id", "v")  # sizes has a row per space

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        axes = Axes(_units(frame.sort_values("id")["v"]))
        return pd.DataFrame({"space": [frame["space"].iloc[0]], "mean": [axes.mean], "directions": [axes.directions.ravel()], "variance": [axes.variance]})

    rows = sample.groupBy("space").applyInPandas(fit, "space string, mean array<double>, directions array<double>, variance array<double>").collect()
    missing = {r.space for r in sizes.collect()} - {r.space for r in rows}
    out: dict[str, Axes] = {}
    for r in rows:
        axes = Axes.__new__(Axes)
        axes.mean, axes.variance = np.array(r["mean"]), np.array(r.variance)
        axes.directions = np.array(r.directions).reshape(-1, len(axes.mean))
        out[r.space] = axes
    for space in missing:  # the hash chose no vector of a tiny space
        out[space] = Axes(np.eye(int(space.rsplit("\u0001", 1)[1])))
    return {s: (i, out[s]) for i, s in enumerate(sorted(out))}


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(curve, ids, vectors) of runs of rows on one curve, in order."""
    for batch in batches:
        curve = batch["curve"].to_numpy()
        edges = np.flatnonzero(np.diff(curve)) + 1
        for low, high in zip([0, *edges], [*edges, len(batch)], strict=True):
            if high > low:
                yield int(curve[low]), batch["id"].to_numpy()[low:high], of_bytes(batch["code"].iloc[low:high].tolist())


def _best(score: np.ndarray, keep: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``keep`` greatest scores that are at least ``floor``."""
    good = score >= floor
    crowded = np.flatnonzero(good.sum(axis=1) > keep)
    if len(crowded):
        part = score[crowded]
        at = np.argpartition(-part, keep - 1, axis=1)[:, :keep]
        only = np.zeros(part.shape, dtype=bool)
        np.put_along_axis(only, at, True, axis=1)
        good[crowded] &= only
    return np.nonzero(good)


def _along(batches: Iterator[pd.DataFrame], window: int, keep: int, floor: float) -> Iterator[pd.DataFrame]:
    """Finds (a, b, near) of a partition sorted along its curves; holds a window's rows only."""
    curve, ids, vectors, start = -1, np.empty(0, np.int64), np.empty((0, 0), np.float32), 0

    def compare(low: int, high: int) -> pd.DataFrame:
        left, right = max(0, low - window), min(len(ids), high + window)
        score = vectors[low:high] @ vectors[left:right].T
        score[np.arange(high - low), np.arange(low - left, high - left)] = -9.0
        row, column = _best(score, keep, max(floor, -2.0))
        return pd.DataFrame({"a": ids[low:high][row], "b": ids[left:right][column], "near": score[row, column]})

    def rest() -> Iterator[pd.DataFrame]:
        for low in range(start, len(ids), ROWS_AT_ONCE):
            yield compare(low, min(len(ids), low + ROWS_AT_ONCE))

    for now, more_ids, more in _stretches(batches):
        if now != curve:
            yield from rest()
            curve, ids, vectors, start = now, more_ids, more, 0
        else:
            ids, vectors = np.concatenate([ids, more_ids]), np.concatenate([vectors, more])
        while len(ids) - start >= ROWS_AT_ONCE + window:
            yield compare(start, start + ROWS_AT_ONCE)
            start += ROWS_AT_ONCE
        past = max(0, start - window)
        ids, vectors, start = ids[past:], vectors[past:], start - past
    yield from rest()


def on_curves(reps: DataFrame, curves: int) -> DataFrame:
    """(curve, k, id, code): every vector on every curve; ``curve`` numbers the curves of all spaces."""
    axes = reps.sparkSession.sparkContext.broadcast(fitted(reps))  # a row per space

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, part in batch.groupby("space", sort=False):
                number, fit = axes.value[space]
                unit, ids = _units(part["v"]), part["id"].to_numpy()
                codes = to_bytes(unit)
                for c in range(curves):
                    yield pd.DataFrame({"curve": np.full(len(ids), number * curves + c, dtype="int32"), "k": fit.keys(unit, c), "id": ids, "code": codes})

    return reps.select("id", "space", "v").mapInPandas(place, "curve int, k bigint, id bigint, code binary")


def exact_similarity(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, similarity) of (a, b), by the whole vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["va"].map(len), sort=False):
                similarity = np.round(np.einsum("ij,ij->i", _units(part["va"]), _units(part["vb"])), PLACES)
                yield pd.DataFrame({"a": part["a"].to_numpy(), "b": part["b"].to_numpy(), "similarity": similarity})

    of_a, of_b = (reps.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in ("a", "b"))
    return pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("a", "b", "va", "vb").mapInPandas(run, "a bigint, b bigint, similarity double")


def _top(pairs: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc(by), "b")
    return pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")


def group_neighbours(reps: DataFrame, k: int, curves: int, window: int, min_similarity: float | None) -> DataFrame:
    """(a, b, similarity): for each vector up to ``k`` of its nearest ones, found on the curves."""
    floor = -2.0 if min_similarity is None else min_similarity - BYTE_ERROR
    keep = k + SPARE
    ordered = on_curves(reps, curves).repartitionByRange("curve", "k", "id").sortWithinPartitions("curve", "k", "id")
    finds = ordered.select("curve", "id", "code").mapInPandas(lambda batches: _along(batches, window, keep, floor), "a bigint, b bigint, near float")
    merged = _top(finds.groupBy("a", "b").agg(F.max("near").alias("near")), keep, "near")
    exact = exact_similarity(merged, reps)
    fine = exact if min_similarity is None else exact.filter(F.col("similarity") >= min_similarity - 1e-9)
    return _top(fine, k, "similarity")


def neighbours(embeddings: DataFrame, k: int = K, min_similarity: float | None = None, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """(id, neighbour_id, similarity, rank): for every usable vector up to ``k`` of the most similar ones.

    With ``min_similarity`` less similar vectors are left out, which spares ranking them.
    """
    rows = usable(embeddings)
    key = ["space", "h1", "h2"]
    order = Window.partitionBy(*key).orderBy("id")
    heads = checkpoint(rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1))  # each vector about once; read four times
    reps = heads.filter("rn = 1").select("id", "space", "v")
    group = heads.groupBy(*key).agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members"))  # at most k + 1 members
    copied = group.filter(F.size("members") > 1)
    # Copies: each member with the smallest other ids of its group.
    others = rows.select("id", *key).join(copied, key).select("id", F.slice(F.array_except("members", F.array("id")), 1, k).alias("others"))
    same = others.select("id", F.posexplode("others").alias("pos", "neighbour_id")).select("id", "neighbour_id", F.lit(1.0).alias("similarity"), (F.col("pos") + 1).alias("rank"))
    # Other groups: members of groups with fewer than k other copies still have room.
    near = group_neighbours(reps, k, curves, window, min_similarity)
    named = group.select("rep", "members")
    wide = near.join(named.select(F.col("rep").alias("a"), F.col("members").alias("ids")), "a").filter(F.size("ids") <= k)
    wide = wide.join(named.select(F.col("rep").alias("b"), F.col("members").alias("theirs")), "b")
    pairs = wide.select(F.explode("ids").alias("id"), (F.size("ids") - 1).alias("taken"), "similarity", "theirs").select("id", "taken", "similarity", F.explode("theirs").alias("neighbour_id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")) + F.col("taken")
    other = pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "neighbour_id", F.least("similarity", F.lit(1.0)).alias("similarity"), "rank")
    return same.unionByName(other)


def close_pairs(embeddings: DataFrame, k: int = K, min_similarity: float = 0.9) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs at least that similar of which one is among the other's ``k`` nearest."""
    found = neighbours(embeddings, k, min_similarity)
    return found.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def exact_neighbours(queries: DataFrame, embeddings: DataFrame, k: int = K, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(id, neighbour_id, similarity, rank) of the stated ``queries`` (id) by comparison with all vectors.

    The queries go out in blocks of ``at_once``; each partition of the vectors keeps ``k`` finds a query.
    """
    rows = usable(embeddings).select("id", "space", "v")
    asked = rows.join(queries.select("id").distinct(), "id", "left_semi")
    numbered = checkpoint(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(-(-asked.count() // at_once) or 1)).cast("int")))
    spark, found = embeddings.sparkSession, None
    for block in sorted(r.block for r in numbered.select("block").distinct().collect()):
        frame = numbered.filter(F.col("block") == block).select("id", "space", "v").toPandas()  # about `at_once` rows
        sought = spark.sparkContext.broadcast({s: (p["id"].to_numpy(), _units(p["v"])) for s, p in frame.groupby("space")})

        def run(batches: Iterator[pd.DataFrame], sought=sought) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for space, part in batch.groupby("space", sort=False):
                    if space in sought.value:
                        ids, unit = sought.value[space]
                        score = np.round(unit @ _units(part["v"]).T, PLACES)
                        mine = part["id"].to_numpy()
                        score[ids[:, None] == mine[None, :]] = -9.0
                        order = np.lexsort((np.broadcast_to(mine, score.shape), -score), axis=1)[:, :k]
                        row, column = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
                        fine = score[row, column] > -9.0
                        yield pd.DataFrame({"a": ids[row], "b": mine[column], "similarity": score[row, column]})[fine]

        part = _top(rows.mapInPandas(run, "a bigint, b bigint, similarity double"), k, "similarity")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "id bigint, neighbour_id bigint, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return found.select(F.col("a").alias("id"), F.col("b").alias("neighbour_id"), "similarity", rank.alias("rank"))
