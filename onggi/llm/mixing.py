"""Records combined from several sources so that each gives its target share of the total size.

The total is the largest at which every source with content can give its share with at most `max_repeats` copies of a
record; shares of sources without content are shared out among the others in proportion. A source then needs its
records r = share * total / size times on average: each record is taken floor(r) times, and once more with probability
r - floor(r). Which ones is drawn by the cube method: probabilities move along vectors that leave the balancing totals
(number of records, and their size) as they are, until each is 0 or 1. Blocks of bounded size do this in parallel; a
block leaves at most two records undecided, and those of many blocks form the blocks of the next round, until one block
per source is left, whose last records are rounded to the nearest total (landing).

Defined results: records with a null or blank output have no size and are not chosen; records of sources without a
target are not chosen; a source with a target and no content has a share of 0; source names are compared in canonical
spelling; repeated records are records of their own; with no targets, or none that has content, nothing is chosen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onggi.llm.budget import canonical_source
from onggi.session import materialize

BLOCK_ROWS = 20_000


def sized_records(df: DataFrame, id_col: str = "rec_id", source_col: str = "source", text_col: str = "output") -> DataFrame:
    """(id, source, size) of records with content."""
    size = F.length(df[text_col])
    has = F.length(F.regexp_replace(df[text_col], r"[ \t\r\n]+", "")) > 0
    return df.where(has).select(df[id_col].alias("id"), canonical_source(df[source_col]).alias("source"), size.cast("bigint").alias("size"))


def mixing_plan(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_records, size, repeats): how often each source's records are needed."""
    wanted = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size").alias("size"))
    plan = wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("size", F.lit(0)).alias("size"))
    usable = (F.col("size") > 0) & (F.col("target_share") > 0)
    whole = plan.agg(F.sum(F.when(usable, F.col("target_share"))).alias("share_sum"), F.min(F.when(usable, F.col("size") * F.col("max_repeats") / F.col("target_share"))).alias("scale"))
    repeats = F.when(usable, F.least(F.col("target_share") * F.col("scale") / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return plan.crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", "n_records", "size", repeats.alias("repeats"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities along the null space of (1, size) until at most two are fractional."""
    out = p.tolist()
    s = size.tolist()
    draws = rng.random(len(out) + 3).tolist()
    live: list[int] = []
    k = 0
    eps = 1e-9
    for i, x in enumerate(out):
        if eps < x < 1 - eps:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for j, v in zip(live, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - out[j]) / v), min(down, out[j] / v)
            elif v < 0:
                up, down = min(up, out[j] / -v), min(down, (1 - out[j]) / -v)
        #: The two steps are drawn so that each probability stays as it is on average.
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for j, v in zip(live, u, strict=True):
            out[j] = min(1.0, max(0.0, out[j] + step * v))
        live = [j for j in live if eps < out[j] < 1 - eps]
    return np.array(out)


def _landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractional probabilities to the nearest total size (fewer records on ties)."""
    at = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    best = min(range(1 << len(at)), key=lambda m: (abs(sum(size[i] * ((m >> j & 1) - p[i]) for j, i in enumerate(at))), m))
    out = np.round(p)
    for j, i in enumerate(at):
        out[i] = best >> j & 1
    return out


def _round(blocks: DataFrame, land: bool, seed: int, id_type: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        p, size = table.column("p").to_numpy(), table.column("size").to_numpy().astype(float)
        key = int(table.column("block")[0].as_py()) * 1_000_003 + len(p) * 7919 + int(size.sum()) + seed
        out = flight(p, size, np.random.default_rng(key))
        if land:
            out = _landing(out, size)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out))

    return blocks.groupBy("source", "block").applyInArrow(run, f"id {id_type}, source string, size bigint, base int, p double, block bigint")


def mix(records: DataFrame, targets: DataFrame, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, source, size, repeats) of the chosen records of (id, source, size)."""
    id_type = records.schema["id"].dataType.simpleString()
    plan = materialize(mixing_plan(records, targets), "mix-plan")
    base = F.floor(F.col("repeats") + 1e-9).cast("int")
    rows = records.join(plan.where("repeats > 0").select("source", "repeats", "n_records"), "source").select(
        "id", "source", "size", base.alias("base"), F.greatest(F.lit(0.0), F.col("repeats") - base).alias("p"), "n_records"
    )
    #: Blocks of a bounded number of rows, by hash, however large a source is.
    number = F.greatest(F.lit(1), F.ceil(F.col("n_records") / block_rows)).cast("bigint")
    open_rows = rows.where("p > 1e-9").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), number)).drop("n_records")
    done = [rows.where("p <= 1e-9").select("id", "source", "size", F.col("base").alias("repeats"))]
    most = plan.agg(F.max("n_records")).first()[0] or 0
    left = -(-most // block_rows)
    current, k = open_rows, 0
    while True:
        last = left <= 1
        result = materialize(_round(current, last, seed + k, id_type), f"mix-round-{k}")
        fixed = (F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)
        done.append(result.where(fixed).select("id", "source", "size", (F.col("base") + F.round("p").cast("int")).alias("repeats")))
        if last:
            break
        #: At most two rows of each block go on, so block_rows // 2 blocks make one of the next round.
        current = result.where(~fixed).withColumn("block", F.floor(F.col("block") / (block_rows // 2)).cast("bigint"))
        left, k = -(-left // (block_rows // 2)), k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.where("repeats > 0")


def mixing_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_records, n_copies, size, actual_share) of every target, also of those without records."""
    wanted = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("repeats").alias("n_copies"), F.sum(F.col("size") * F.col("repeats")).alias("size"))
    total = got.agg(F.sum("size").alias("total"))
    rows = wanted.join(got, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select("source", "target_share", zero("n_records"), zero("n_copies"), zero("size"), F.round(F.coalesce(F.col("size") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
