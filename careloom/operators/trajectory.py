"""Trajectories (ordered item sequences), warping distances, clusters and their features.

A trajectory is a long table (person, position, item, ...). Distances cut both sides of a pair into
chunks of at most ``chunk_len`` steps. The warping grid of the pair falls into blocks (chunk of one, chunk
of the other), which run in anti-diagonal rounds: a block takes the costs along its upper and left
border and hands on those along its lower and right one. No row, task or driver ever holds a whole
trajectory; a pair of short ones is a single block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careloom.functions import warping
from careloom.operators.ordering import with_position
from careloom.session import cut_lineage

CHUNK = 16_384
# Cells of a padded matrix of sequences that a task works on at once.
CELLS = 1 << 21


def trajectories(
    df: DataFrame, key: str, item: str, ts: str, tie: Sequence[str] = (), mode: str = "date",
    days: str = "days_to_target_event", keep: Sequence[str] = (), bucket: Column | None = None,
) -> DataFrame:
    """Numbered steps of each person, by range partitions or by a ``bucket`` that follows the order.

    ``mode='date'`` orders by time; ``mode='days'`` by falling days to the target (unknown last),
    then time. The temporal position is the days to the target, 0 when unknown.
    """
    rows = df.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    if mode == "days":
        late = F.col(days).isNull().cast("int")
        order = [late, F.col(days).desc(), F.col(ts), *map(F.col, tie)]
        position = F.coalesce(F.col(days).cast("double"), F.lit(0.0))
    else:
        order = [F.col(ts), *map(F.col, tie)]
        position = F.lit(0.0)
    numbered = with_position(rows, [key], order, bucket, "position")
    return numbered.select(
        F.col(key).alias("person"), "position", F.col(item).alias("item"), F.col(ts).alias("ts"),
        position.alias("temporal_position"), *keep,
    )


def sequence_encode(traj: DataFrame) -> DataFrame:
    """Add ``item_id``, the rank of the item in the sorted vocabulary (from 0)."""
    words = traj.select("item").distinct()
    ranked = with_position(words, [], [F.col("item")], None, "__r")
    ids = ranked.select("item", (F.col("__r") - 1).cast("int").alias("item_id"))
    return traj.join(ids, "item")


def _chunks(traj: DataFrame, value: str, chunk_len: int) -> tuple[DataFrame, int]:
    """(person, chunk, chunks, values in order), at most ``chunk_len`` steps each; the most chunks of a person."""
    chunk = F.floor((F.col("position") - 1) / chunk_len).alias("chunk")
    steps = F.struct("position", F.col(value).alias("v"))
    grouped = traj.groupBy("person", chunk).agg(F.sort_array(F.collect_list(steps)).alias("s"))
    cut = cut_lineage(grouped.select("person", "chunk", F.col("s.v").alias("values")))
    most = cut.agg(F.max("chunk")).first()[0]
    if not most:
        return cut.withColumn("chunks", F.lit(1).cast("bigint")), 1
    spans = cut.groupBy("person").agg((F.max("chunk") + 1).alias("chunks"))
    return cut.join(spans, "person"), most + 1


def pick_prototypes(traj: DataFrame, k: int = 20) -> DataFrame:
    """Trajectories of the k smallest person ids, whatever their length."""
    chosen = traj.select("person").distinct().orderBy("person").limit(k)
    return traj.join(chosen, "person", "left_semi")


def _by_cells(lengths: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """Row numbers in groups of like length, of at most so many cells when padded."""
    order = np.argsort(lengths, kind="stable")
    out, start = [], 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * lengths[order[i]] > cells:
            out.append(order[start:i])
            start = i
    return out


def _padded(lists: pa.ListArray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and their flat values in rows filled up with -1."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.full((len(lists), int(lengths.max(initial=0))), -1.0)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return lengths, out


def _values(a: pa.ListArray, b: pa.ListArray, cost: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat numeric values of both sides; for mismatches equal numbers stand for equal values."""
    flat_a, flat_b = a.flatten(), b.flatten()
    if cost == "mismatch":
        codes = pa.concat_arrays([flat_a, flat_b]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return codes[: len(flat_a)].astype(float), codes[len(flat_a):].astype(float)
    return tuple(x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (flat_a, flat_b))


def _border(lists: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The borders of the rows, infinite where there is none or where it ends."""
    out = np.full((len(rows), width), np.inf)
    for k, i in enumerate(rows):
        if lists[int(i)].is_valid:
            values = lists[int(i)].values.to_numpy()
            out[k, : len(values)] = values
    return out


def _blocks(cost: str):
    """Batch function over blocks: the distance of a pair's last block, or borders for its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from advanced(batch)

    def advanced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        col = {n: batch.column(n) for n in batch.schema.names}
        i, j, na, nb = (col[n].to_numpy() for n in ("i", "j", "na", "nb"))
        flat_a, flat_b = _values(col["a"], col["b"], cost)
        ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(col[n]).to_numpy(zero_copy_only=False))]) for n in "ab"]
        for part in _by_cells(np.maximum(np.diff(ends[0]), np.diff(ends[1]))):
            pick = pa.array(part)
            (la, a), (lb, b) = (
                _padded(col[n].take(pick), np.concatenate([flat[e[k]: e[k + 1]] for k in part]))
                for n, flat, e in (("a", flat_a, ends[0]), ("b", flat_b, ends[1]))
            )
            top = _border(col["top"], part, b.shape[1] + 1)
            top[(i[part] == 0) & (j[part] == 0), 0] = 0.0
            state, right = warping.block(top, _border(col["left"], part, a.shape[1]), a, la, b, lb, cost)
            yield handed_on(batch.take(pick), state, right, la, lb, *(x[part] for x in (i, j, na, nb)))

    def handed_on(batch, state, right, la, lb, i, j, na, nb) -> pa.RecordBatch:
        last, below, beside = (i + 1 == na) & (j + 1 == nb), i + 1 < na, j + 1 < nb
        order = np.concatenate([np.flatnonzero(x) for x in (last, below, beside)])
        n = [int(x.sum()) for x in (last, below, beside)]
        step = np.repeat([[0, 0], [1, 0], [0, 1]], n, axis=0)
        none = [None]
        tops = none * n[0] + [state[k, : lb[k] + 1] for k in np.flatnonzero(below)] + none * n[2]
        lefts = none * (n[0] + n[1]) + [right[k, : la[k]] for k in np.flatnonzero(beside)]
        far = [float(state[k, lb[k]]) for k in np.flatnonzero(last)] + none * (n[1] + n[2])
        ids = [batch.column(c).take(pa.array(order)) for c in ("id_a", "id_b")]
        whole = [pa.array(x, pa.int64()) for x in (i[order] + step[:, 0], j[order] + step[:, 1], na[order], nb[order])]
        vectors = [pa.array(x, pa.list_(pa.float64())) for x in (tops, lefts)]
        return pa.RecordBatch.from_arrays([*ids, *whole, *vectors, pa.array(far, pa.float64())], names=names)

    names = ["id_a", "id_b", "i", "j", "na", "nb", "top", "left", "distance"]
    return run


def _warped(pairs: DataFrame, left: DataFrame, right: DataFrame, rounds: int, cost: str) -> DataFrame:
    """(id_a, id_b, distance) of distinct pairs, infinite where a side has no steps.

    ``left`` and ``right`` are chunk rows; ``rounds`` is the number of anti-diagonals of the largest grid.
    """
    a = left.select(F.col("person").alias("id_a"), F.col("chunk").alias("i"), F.col("values").alias("a"), F.col("chunks").alias("na"))
    b = right.select(F.col("person").alias("id_b"), F.col("chunk").alias("j"), F.col("values").alias("b"), F.col("chunks").alias("nb"))
    border = T.ArrayType(T.DoubleType())
    zero = F.lit(0).cast("bigint")
    start = pairs.select("id_a", "id_b", zero.alias("i"), zero.alias("j"))
    now = start.join(a, ["id_a", "i"], "left").join(b, ["id_b", "j"], "left")
    empty = now.filter("a is null or b is null").select("id_a", "id_b", F.lit(float("inf")).alias("distance"))
    now = now.filter("a is not null and b is not null").withColumns({"top": F.lit(None).cast(border), "left": F.lit(None).cast(border)})
    kinds = {f.name: f.dataType for f in now.schema}
    whole = [T.StructField(c, T.LongType()) for c in ("i", "j", "na", "nb")]
    schema = T.StructType([
        *(T.StructField(c, kinds[c]) for c in ("id_a", "id_b")), *whole,
        T.StructField("top", border), T.StructField("left", border), T.StructField("distance", T.DoubleType()),
    ])
    done = empty
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for i in range(rounds):
        blocks = now.select("id_a", "id_b", "i", "j", "na", "nb", "a", "b", "top", "left")
        # a block's work is the product of its sides: few bytes are no reason for few tasks
        blocks = blocks.repartition(tasks, "id_a", "id_b", "i")
        step = blocks.mapInArrow(_blocks(cost), schema)
        if rounds > 1:
            step = cut_lineage(step)
        done = done.unionByName(step.filter("distance is not null").select("id_a", "id_b", "distance"))
        if i + 1 < rounds:
            met = step.filter("distance is null").groupBy("id_a", "id_b", "i", "j", "na", "nb").agg(F.max("top").alias("top"), F.max("left").alias("left"))
            now = met.join(a.drop("na"), ["id_a", "i"]).join(b.drop("nb"), ["id_b", "j"])
    return done


def dtw_to_prototypes(
    traj: DataFrame, protos: DataFrame, value: str = "item", cost: str = "mismatch",
    chunk_len: int = CHUNK,
) -> DataFrame:
    """Warping distance of every person to every prototype: (person, prototype, distance).

    ``prototype`` counts from 1 in the order of the prototype ids; only these ids reach the driver. With
    ``cost='abs'`` the value column must be numeric. The result is small next to what it costs, so its
    lineage is cut.
    """
    others, longest = _chunks(protos, value, chunk_len)
    listed = [r[0] for r in others.filter("chunk = 0").select("person").orderBy("person").collect()]
    if not listed:
        raise ValueError("no prototypes")
    steps, most = _chunks(traj, value, chunk_len)
    ids = F.array(*[F.lit(p).cast(traj.schema["person"].dataType) for p in listed])
    pairs = steps.filter("chunk = 0").select(F.col("person").alias("id_a"), F.explode(ids).alias("id_b"))
    found = cut_lineage(_warped(pairs, steps, others, most + longest - 1, cost))
    return found.select(
        F.col("id_a").alias("person"), F.array_position(ids, F.col("id_b")).cast("int").alias("prototype"),
        F.col("id_b").alias("prototype_id"), "distance",
    )


def distances_wide(distances: DataFrame, k: int) -> DataFrame:
    """One row per person with the columns dtw_dist_proto_1 .. k."""
    pick = [
        F.max(F.when(F.col("prototype") == i, F.col("distance"))).alias(f"dtw_dist_proto_{i}")
        for i in range(1, k + 1)
    ]
    return distances.groupBy("person").agg(*pick)


def dtw_pairs(
    traj: DataFrame, pairs: DataFrame, value: str = "item_id", cost: str = "mismatch", chunk_len: int = CHUNK,
) -> DataFrame:
    """Warping distance of the distinct listed pairs (id_a, id_b), whatever their lengths.

    The pairs are the caller's list: a full distance matrix of all persons is not formed. A pair with a
    person without steps is infinitely far apart.
    """
    pairs = pairs.select("id_a", "id_b").distinct()
    wanted = pairs.select(F.explode(F.array("id_a", "id_b")).alias("person")).distinct()
    steps, most = _chunks(traj.join(wanted, "person", "left_semi"), value, chunk_len)
    return _warped(pairs, steps, steps, 2 * most - 1, cost)


# --- clusters -----------------------------------------------------------------------------


def assign_clusters(distances: DataFrame) -> DataFrame:
    """Nearest prototype of each person, with the distance and the simplified silhouette.

    The silhouette compares the nearest with the second nearest prototype; infinite distances
    count as twice the largest finite one.
    """
    top = distances.filter(F.col("distance") < float("inf")).agg(
        F.max("distance").alias("m")
    ).scalar()
    capped = F.when(F.col("distance") < float("inf"), F.col("distance")).otherwise(2 * top)
    near = F.struct(capped.alias("d"), F.col("prototype").alias("p"))
    # At most k prototypes per person.
    ranked = distances.groupBy("person").agg(F.sort_array(F.collect_list(near)).alias("r"))
    first, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    width = F.greatest(first["d"], second["d"])
    return ranked.select(
        "person", first["p"].alias("cluster"), first["d"].alias("distance"),
        F.when(width > 0, (second["d"] - first["d"]) / width).otherwise(0.0).alias("silhouette"),
    )


def trajectory_lengths(traj: DataFrame) -> DataFrame:
    return traj.groupBy("person").agg(F.max("position").alias("length"))


def archetypes(clusters: DataFrame, lengths: DataFrame) -> DataFrame:
    """Person of each cluster whose length is closest to the whole part of the median length."""
    rows = clusters.select("person", "cluster").join(lengths, "person")
    histogram = rows.groupBy("cluster", "length").agg(F.count(F.lit(1)).alias("__c"))
    medians = histogram.groupBy("cluster").agg(
        F.floor(F.percentile("length", 0.5, F.col("__c"))).alias("median_length")
    )
    gap = F.abs(F.col("length") - F.col("median_length"))
    return rows.join(medians, "cluster").groupBy("cluster", "median_length").agg(
        F.min_by("person", F.struct(gap, F.col("person"))).alias("archetype")
    )


def cluster_summary(
    clusters: DataFrame, lengths: DataFrame, labels: DataFrame | None = None,
    label: str = "is_target_case",
) -> DataFrame:
    """Size, mean length, mean silhouette and target rate of each cluster."""
    rows = clusters.join(lengths, "person")
    if labels is not None:
        rows = rows.join(labels.select("person", F.col(label).alias("__l")), "person", "left")
    aggregates = [
        F.count(F.lit(1)).alias("cluster_size"),
        F.avg("length").alias("cluster_avg_length"),
        F.avg("silhouette").alias("cluster_silhouette"),
    ]
    if labels is not None:
        aggregates.append(F.avg(F.coalesce("__l", F.lit(0))).alias("cluster_target_rate"))
    return rows.groupBy("cluster").agg(*aggregates)


def archetype_match(
    traj: DataFrame, clusters: DataFrame, types: DataFrame, value: str = "item",
    cost: str = "mismatch", chunk_len: int = CHUNK,
) -> DataFrame:
    """Distance of each person to its cluster's archetype, match score and rank in the cluster."""
    own = clusters.select("person", "cluster").join(types.select("cluster", "archetype"), "cluster")
    pairs = own.select(F.col("person").alias("id_a"), F.col("archetype").alias("id_b"))
    distances = dtw_pairs(traj, pairs, value, cost, chunk_len)
    matched = own.join(
        distances.withColumnsRenamed({"id_a": "person", "id_b": "archetype"}), ["person", "archetype"]
    ).withColumn("match_score", 1 / (1 + F.col("distance")))
    return with_position(
        matched, ["cluster"], [F.col("distance"), F.col("person")], F.floor("distance"),
        "match_rank",
    )


def target_distances(distances: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean and smallest distance of each person to the prototypes that are target persons."""
    target_protos = targets.select(F.col("person").alias("prototype_id")).distinct()
    rows = distances.join(target_protos, "prototype_id", "left_semi")
    return rows.groupBy("person").agg(
        F.avg("distance").alias("avg_distance_to_targets"),
        F.min("distance").alias("min_distance_to_targets"),
        F.min_by("prototype_id", F.struct("distance", "prototype_id")).alias("closest_target"),
    )


def trajectory_features(traj: DataFrame, days: str | None = None) -> DataFrame:
    """Length, diversity, span and events per 30 days; with ``days`` also the timing statistics."""
    span = F.datediff(F.max("ts"), F.min("ts"))
    timing: list[Column] = []
    if days:
        timing = [
            F.max(days).alias("first_event_days_before_target"),
            F.min(days).alias("last_event_days_before_target"),
            F.avg(days).alias("temporal_mean"),
            F.stddev_samp(days).alias("temporal_std"),
            F.skewness(days).alias("temporal_skew"),
            (F.count(days) > 0).cast("int").alias("has_temporal_alignment"),
        ]
    items = traj.groupBy("person", "item").agg(F.lit(1).alias("__one"))
    diversity = items.groupBy("person").agg(F.count(F.lit(1)).alias("diversity"))
    base = traj.groupBy("person").agg(
        F.count(F.lit(1)).alias("length"), span.alias("span_days"), *timing
    )
    return base.join(diversity, "person").withColumn(
        "density", F.try_divide(F.col("length"), F.col("span_days") / 30)
    )


def cluster_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether a person's cluster in ``b`` is the most common one of its cluster in ``a``."""
    both = a.select("person", F.col("cluster").alias("cluster_a")).join(
        b.select("person", F.col("cluster").alias("cluster_b")), "person"
    )
    counts = both.groupBy("cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("cluster_a").agg(
        F.min_by("cluster_b", F.struct(-F.col("n"), "cluster_b")).alias("__usual")
    )
    return both.join(usual, "cluster_a").select(
        "person", "cluster_a", "cluster_b",
        (F.col("cluster_b") == F.col("__usual")).cast("int").alias("cluster_match"),
    )
