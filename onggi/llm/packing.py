"""Documents in containers of fixed capacity: best-fit decreasing in blocks, certified by lower bounds, and repacked.

A document above the capacity is cut into full containers and a rest; no other document is cut. Blocks of a bounded
number of pieces are packed in parallel by best-fit decreasing. Dual feasible functions give each block a number of
containers that no packing of it can beat; a block that reaches it is done. The others have gaps: they give up their
emptiest containers, whose pieces are exchanged (regrouped across blocks) and packed again. The new packing of what one
capacity gave up replaces the old containers only where it needs fewer of them. The same functions over the counts of all
sizes certify the whole packing (certificates).

Defined results: documents of 0 tokens (null and empty texts) need no container and have none; repeated documents are
packed each; ties of sizes go by document id; an empty table gives no container; capacities must be positive, and more
than MOST_PACKS of them are an error, as their list goes to every task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onggi.session import materialize

BLOCK_PIECES = 20_000
MOST_PACKS = 10_000


def pieces(sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(pack_name, capacity, id, piece_no, size): what is to be packed; full pieces of long documents come first."""
    caps = packs.select("pack_name", F.col("capacity").cast("bigint").alias("capacity")).where("capacity > 0")
    if caps.limit(MOST_PACKS + 1).count() > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    rows = sizes.where("n_tokens > 0").select(F.col(id_col).alias("id"), "n_tokens").crossJoin(F.broadcast(caps))
    last = ((F.col("n_tokens") - 1) / F.col("capacity")).cast("bigint")
    return rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "pack_name", "capacity", "id", "piece_no", F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).alias("size")
    )


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; pieces come in falling order of size."""
    free: list[int] = []  # distinct free spaces, sorted
    by_free: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(free, s)
        if k < len(free):
            space = free[k]
            bins = by_free[space]
            b = bins.pop()
            if not bins:
                del by_free[space]
                free.pop(k)
        else:
            b, space = n, capacity
            n += 1
        out[i] = b
        rest = space - s
        if rest:
            if rest in by_free:
                by_free[rest].append(b)
            else:
                by_free[rest] = [b]
                insort(free, rest)
    return out


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest number of containers that a dual feasible function proves necessary; `counts`: how often each size is."""
    if not len(sizes):
        return 0
    order = np.argsort(sizes, kind="stable")
    x = sizes[order].astype(np.int64)
    c = np.ones(len(x), np.int64) if counts is None else counts[order].astype(np.int64)
    number = np.concatenate(([0], np.cumsum(c)))
    total = np.concatenate(([0], np.cumsum(c * x)))
    best = -(-int(total[-1]) // capacity)
    #: u_e: sizes above capacity - e count as a whole container, sizes below e as nothing.
    for e in np.unique(x[x <= capacity // 2]):
        lo, hi = int(np.searchsorted(x, e, side="left")), int(np.searchsorted(x, capacity - e, side="right"))
        big = int(number[-1] - number[hi])
        best = max(best, big + -(-int(total[hi] - total[lo]) // capacity))
    #: f_k: sizes are rounded to multiples of 1 / k, and multiples of 1 / (k + 1) stay as they are.
    for k in range(1, 21):
        y = (k + 1) * x
        whole = y % capacity == 0
        value = np.where(whole, x * k, (y // capacity) * capacity)
        best = max(best, -(-int((value * c).sum()) // (k * capacity)))
    return best


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("id", "ascending"), ("piece_no", "ascending")])
    sizes = table.column("size").to_numpy()
    capacity = int(table.column("capacity")[0].as_py())
    bins = best_fit_decreasing(sizes, capacity)
    n = int(bins.max()) + 1
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
    bound = lower_bound(sizes, capacity)
    rank = np.empty(n, np.int64)
    rank[np.argsort(fill, kind="stable")] = np.arange(n)
    for name, values in (("bin", bins), ("fill", fill[bins]), ("emptiness", rank[bins]), ("n_bins", np.full(len(bins), n)), ("bound", np.full(len(bins), bound))):
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table


def _packed(rows: DataFrame, id_type: str) -> DataFrame:
    schema = f"pack_name string, capacity bigint, id {id_type}, piece_no bigint, size bigint, block bigint, bin bigint, fill bigint, emptiness bigint, n_bins bigint, bound bigint"
    return rows.select("pack_name", "capacity", "id", "piece_no", "size", "block").groupBy("pack_name", "block").applyInArrow(_pack, schema)


def pack(sizes: DataFrame, packs: DataFrame, id_col: str = "doc_id", block_pieces: int = BLOCK_PIECES, rounds: int = 2, release: int = 12) -> DataFrame:
    """(pack_name, capacity, id, piece_no, size, container, fill) of every piece.

    `release`: containers that a block gives up per container above its bound. What is sent to every task has a row per
    capacity, of which there are at most MOST_PACKS."""
    id_type = sizes.schema[id_col].dataType.simpleString()
    todo = pieces(sizes, packs, id_col)
    #: Full pieces fill a container each and need no packing.
    full = todo.where("size = capacity").select("pack_name", "capacity", "id", "piece_no", "size", F.concat_ws(":", F.lit("full"), F.col("id").cast("string"), F.col("piece_no").cast("string")).alias("container"), F.col("size").alias("fill"))
    rest = materialize(todo.where("size < capacity"), "pack-pieces")
    number = rest.groupBy("pack_name").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_pieces)).cast("bigint").alias("n_blocks"))
    current = rest.join(F.broadcast(number), "pack_name").withColumn("block", F.pmod(F.xxhash64("id", "piece_no"), F.col("n_blocks")))
    done: list[DataFrame] = []
    name = lambda k: F.concat_ws(":", F.lit(f"r{k}"), F.col("block").cast("string"), F.col("bin").cast("string"))
    keep = ["pack_name", "capacity", "id", "piece_no", "size", "container", "fill"]
    state = materialize(_packed(current, id_type), "pack-round-0").withColumn("container", name(0))
    for k in range(1, rounds + 1):
        gives = (F.col("n_bins") > F.col("bound")) & (F.col("emptiness") < release * (F.col("n_bins") - F.col("bound")))
        done.append(state.where(~gives).select(*keep))
        given = state.where(gives)
        per_pack = given.groupBy("pack_name").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("container").alias("had"))
        #: Pieces of containers that blocks gave up meet those of other blocks.
        regroup = given.drop("n_bins", "bound", "emptiness", "bin").withColumnRenamed("block", "old_block").withColumnRenamed("container", "old_container").withColumnRenamed("fill", "old_fill")
        regroup = materialize(regroup.join(F.broadcast(per_pack), "pack_name").withColumn("block", F.pmod(F.xxhash64("id", "piece_no", F.lit(k)), F.greatest(F.lit(1), F.ceil(F.col("m") / block_pieces)).cast("bigint"))), f"pack-given-{k}")
        again = materialize(_packed(regroup, id_type), f"pack-round-{k}").withColumn("container", name(k))
        need = again.groupBy("pack_name").agg(F.countDistinct("container").alias("need"))
        had = regroup.groupBy("pack_name").agg(F.max("had").alias("had"))
        better = had.join(need, "pack_name").where("need < had").select("pack_name")
        old = regroup.join(F.broadcast(better), "pack_name", "left_anti").select("pack_name", "capacity", "id", "piece_no", "size", F.col("old_container").alias("container"), F.col("old_fill").alias("fill"))
        done.append(old)
        state = again.join(F.broadcast(better), "pack_name", "left_semi")
    done.append(state.select(*keep))
    out = full
    for d in done:
        out = out.unionByName(d)
    return out.withColumnRenamed("id", id_col)


def container_fills(packed: DataFrame) -> DataFrame:
    """(pack_name, container, capacity, n_pieces, used, fill_share) of every container."""
    return packed.groupBy("pack_name", "container").agg(
        F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("used"), F.round(F.sum("size") / F.max("capacity"), 6).alias("fill_share")
    )


def certificates(packed: DataFrame) -> DataFrame:
    """(pack_name, capacity, n_containers, bound, n_above): containers in use, the number that no packing can beat, and how
    many are above it. Sizes are counted first, so a capacity has at most as many rows as it has tokens."""
    counts = packed.groupBy("pack_name", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))

    def run(table: pa.Table) -> pa.Table:
        capacity = table.column("capacity")[0]
        bound = lower_bound(table.column("size").to_numpy(), int(capacity.as_py()), table.column("n").to_numpy())
        return pa.table({"pack_name": table.column("pack_name")[:1], "capacity": pa.array([capacity.as_py()], pa.int64()), "bound": pa.array([bound], pa.int64())})

    bounds = counts.groupBy("pack_name", "capacity").applyInArrow(run, "pack_name string, capacity bigint, bound bigint")
    #: A container is counted by its first piece; no two-column distinct over all pieces.
    used = packed.groupBy("pack_name", "container").agg(F.lit(1).alias("one")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"))
    return bounds.join(used, "pack_name").select("pack_name", "capacity", "n_containers", "bound", (F.col("n_containers") - F.col("bound")).alias("n_above"))
