"""Problem 7: filling fixed-capacity containers with items.

Only the histogram of item sizes reaches the driver: at most ``capacity`` numbers.  Over it the configuration linear
program (how many blocks of each combination of sizes cover all items with the fewest blocks) is solved by
multiplicative weights: a size's price is its length times a weight that falls exponentially as the size is covered
ahead of the others; a knapsack dynamic program finds the most valuable combination, and those of the sizes that
lag behind, which are used a little more.  The prices are also a dual solution, so each round gives a lower bound of
the number of blocks, and the program ends when its cover is within ``gap`` of the best bound.

The cover is then rounded: combinations are used for whole blocks, then for one more where their items remain, and
what is left is packed by best fit over the histogram.  Best fit alone is packed as well, and the fewest blocks
are kept.  The blocks are then dealt out to the items by their rank among the items of one size, which is a prefix
count over the partitions and a sort of none but each partition's own rows.

Of a capacity over GRID the program sees sizes rounded up to GRID steps; the blocks hold the sizes as they are.

An item larger than the capacity is cut into full blocks and a rest, which is packed like an item.  An item
of size 0 (null or empty text) needs no block and gets none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise

#: The cover is at most so much larger than the lower bound, unless ROUNDS end it.
GAP, ROUNDS = 0.02, 4000
GRID = 1024
#: Combinations of each round, the share of its scarcest size that one covers, and how sharply weights fall.
COLUMNS, STEP, RATE = 8, 0.1, 8.0
#: Parts of the cover that are rounded; the rest is left to best fit.
PARTS = (1.0, 0.95)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the greatest value of each capacity, and a size to take there (0: leave one unit empty)."""
    sizes = np.flatnonzero(value > 0)
    gain = value[sizes]
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            total = best[c - sizes[:k]] + gain[:k]
            j = int(total.argmax())
            if total[j] > best[c] + 1e-15:
                best[c], pick[c] = total[j], sizes[j]
    return best, pick


def taken(pick: np.ndarray, capacity: int, first: int = 0) -> tuple[tuple[int, int], ...]:
    """The combination that the table holds for a capacity, besides one item of the size ``first``: (size, count) by size."""
    out = Counter([first] if first else [])
    c = capacity - first
    while c > 0:
        out[int(pick[c])] += 1
        c -= int(pick[c]) or 1
    del out[0]
    return tuple(sorted(out.items()))


@dataclass
class Cover:
    """A fractional cover: blocks of each combination, their number, and a lower bound of any cover's."""

    blocks: dict[tuple[tuple[int, int], ...], float] = field(default_factory=dict)
    value: float = 0.0
    bound: float = 0.0
    rounds: int = 0


def covered(need: np.ndarray, gap: float = GAP, rounds: int = ROUNDS) -> Cover:
    """The configuration linear program for need[size] items of each size, by multiplicative weights."""
    capacity = len(need) - 1
    sizes = np.flatnonzero(need)
    if not len(sizes):
        return Cover()
    n = need.astype(np.float64)
    volume = n * np.arange(capacity + 1)
    done = np.zeros(capacity + 1)
    used: Counter[tuple[tuple[int, int], ...]] = Counter()
    out = Cover(bound=float(volume.sum()) / capacity, value=np.inf)
    total = 0.0
    for r in range(rounds):
        z = done[sizes]
        low = float(z.min())
        # coverage in units of the least covered size, so that late rounds weigh relative differences
        price = np.zeros(capacity + 1)
        price[sizes] = sizes * np.exp(np.clip(-RATE * (z - z.mean()) / max(low, 1.0), -60, 60))
        best, pick = knapsack(price, capacity)
        out.bound = max(out.bound, float((price * n).sum() / best[capacity]))
        columns = {taken(pick, capacity)}
        for s in sizes[np.argsort(z, kind="stable")[: COLUMNS - 1]].tolist():
            if price[s] + best[capacity - s] >= (1 - gap) * best[capacity]:
                columns.add(taken(pick, capacity, s))
        for c in columns:
            more = STEP * min(n[s] / k for s, k in c)
            used[c] += more
            total += more
            for s, k in c:
                done[s] += more * k / n[s]
        low = float(done[sizes].min())
        if low > 0 and total / low < out.value:
            out.value, out.rounds, scale = total / low, r + 1, low
            if low >= 1 and out.value <= (1 + gap) * out.bound:
                break
    low = float(done[sizes].min())
    if low > 0:
        out.value = total / low
        out.blocks = {c: x / low for c, x in used.items()}
    return out


def rounded(cover: Cover, need: np.ndarray, part: float = 1.0) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole blocks of a part of the cover whose items are all there, ``need`` at most of each size."""
    left = need.astype(np.int64).copy()
    out: Counter[tuple[tuple[int, int], ...]] = Counter()
    fits = lambda c: min(int(left[s]) // k for s, k in c)
    for c, x in sorted(cover.blocks.items(), key=lambda y: (-y[1], y[0])):
        if times := min(int(x * part), fits(c)):
            out[c] += times
            for s, k in c:
                left[s] -= times * k
    # then one more of those with the greatest fractions
    for c, x in sorted(cover.blocks.items(), key=lambda y: (int(y[1] * part) - y[1] * part, y[0])):
        if fits(c) and x * part - int(x * part) > 0.5:
            out[c] += 1
            for s, k in c:
                left[s] -= k
    return list(out.items())


def best_fit(need: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Best fit by falling size over the histogram, equal blocks at once."""
    left = need.astype(np.int64).copy()
    capacity = len(need) - 1
    room: Counter[bytes] = Counter()
    spare: dict[int, set[bytes]] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            r = min((r for r in spare if r >= size and spare[r]), default=None)
            if r is None:
                per = capacity // size
                blocks = max(1, n // per)
                per = min(per, n)
                base = np.zeros(capacity + 1, np.int64)
            else:
                key = min(spare[r])
                base = np.frombuffer(key, np.int64)
                per = min(r // size, n)
                blocks = min(room[key], max(1, n // per))
                room[key] -= blocks
                if not room[key]:
                    spare[r].discard(key)
            conf = base.copy()
            conf[size] += per
            n -= per * blocks
            rest = capacity - int((conf * np.arange(capacity + 1)).sum())
            room[conf.tobytes()] += blocks
            spare.setdefault(rest, set()).add(conf.tobytes())
    return [(np.frombuffer(k, dtype=np.int64), n) for k, n in room.items() if n]


def _real(blocks: list[tuple[tuple[tuple[int, int], ...], int]], need: np.ndarray, unit: int) -> list[tuple[np.ndarray, int]]:
    """Blocks of grid sizes as blocks of the sizes themselves, the largest of a grid size first."""
    stock: dict[int, list[list[int]]] = {}
    for s in np.flatnonzero(need)[::-1].tolist():
        stock.setdefault(-(-s // unit), []).append([s, int(need[s])])
    out: Counter[bytes] = Counter()
    for c, times in blocks:
        while times:
            n = min([times, *(stock[g][0][1] // k for g, k in c)])
            conf = np.zeros(len(need), dtype=np.int64)
            for g, k in c:
                own = k
                while own:
                    head = stock[g][0]
                    take = own if n else min(own, head[1])
                    conf[head[0]] += take
                    head[1] -= take * max(n, 1)
                    own -= take
                    if not head[1]:
                        stock[g].pop(0)
            out[conf.tobytes()] += max(n, 1)
            times -= max(n, 1)
    return [(np.frombuffer(k, dtype=np.int64), n) for k, n in out.items()]


def plan(need: np.ndarray, gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, int]], Cover]:
    """Combinations (counts by size) and how many blocks have each, which together hold exactly ``need``; and the program's solution."""
    need = need.astype(np.int64).copy()
    need[0] = 0
    capacity = len(need) - 1
    unit = -(-capacity // GRID)
    grid = np.zeros(max(capacity // unit, 1) + 1, dtype=np.int64)
    of = -(-np.arange(capacity + 1) // unit)
    np.add.at(grid, np.where(of < len(grid), of, 0), need)
    grid[0] = 0
    cover = covered(grid, gap, rounds)
    own = need.copy()
    own[of >= len(grid)] = 0
    if unit > 1:
        # the program's bound is one for sizes rounded up
        cover.bound = float((need * np.arange(capacity + 1)).sum()) / capacity
    best = best_fit(need)
    for part in PARTS if cover.blocks else ():
        first = _real(rounded(cover, grid, part), own, unit)
        left = need - sum((c * n for c, n in first), np.zeros(capacity + 1, np.int64))
        both = first + best_fit(left)
        best = min(best, both, key=lambda b: sum(n for _, n in b))
    return best, cover


def _deal(blocks: list[tuple[np.ndarray, int]], capacity: int, first: int) -> dict[int, np.ndarray]:
    """For each size rows (first rank, first block, items of the size in a block)."""
    out: dict[int, list] = {}
    rank = np.zeros(capacity + 1, dtype=np.int64)
    for conf, n in blocks:
        for s in np.flatnonzero(conf).tolist():
            out.setdefault(s, []).append((rank[s], first, conf[s]))
            rank[s] += n * conf[s]
        first += n
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


def packed(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 512, gap: float = GAP, rounds: int = ROUNDS) -> DataFrame:
    """(key, piece, block_id, n_tokens): the pieces of each item and their blocks.

    piece counts from 0; an item up to the capacity has one.  Blocks have ids without gaps, those of cut items
    first.  Rows with a null key are items like others; null and negative sizes count as 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = sized.select(F.col(key).cast("long").alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    # the written files fix which rows are in which partition, and in which order
    rows = materialise(items.withColumn("part", F.spark_partition_id()))
    hist_schema = pa.schema([("part", pa.int32()), ("size", pa.int64()), ("n", pa.int64())])

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, np.ndarray] = {}
        for b in batches:
            part, s = b.column(2).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                own = s[part == p]
                # slot 0: full blocks of cut items
                c = count.setdefault(p, np.zeros(capacity + 1, dtype=np.int64))
                whole, rest = own // capacity, own % capacity
                exact = own == capacity
                c[0] += whole[~exact].sum()
                c += np.bincount(np.where(exact, capacity, rest), minlength=capacity + 1) * (np.arange(capacity + 1) > 0)
        for p, c in count.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(at), pa.array(c[at])], schema=hist_schema)

    by_part = materialise(rows.mapInArrow(histogram, "part int, size long, n long").groupBy("part", "size").agg(F.sum("n").alias("n")))
    need = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect():
        need[r["size"]] = r["n"]
    cut = int(need[0])
    need[0] = 0
    blocks, _ = plan(need, gap, rounds)
    table = _deal(blocks, capacity, cut)
    shared = sized.sparkSession.sparkContext.broadcast(table)
    # what stands before each partition's items of one size: one window over (partition, size) counts, not over items
    before = by_part.alias("x").selectExpr("part", "size", "sum(n) over (partition by size order by part) - n as before")
    both = before.selectExpr("part", "0 as kind", "before as key", "size").union(rows.selectExpr("part", "1 as kind", "key", "size"))
    schema = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("block_id", pa.int64()), ("n_tokens", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank: dict[int, np.ndarray] = {}
        for b in batches:
            part, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                r = rank.setdefault(p, np.zeros(capacity + 1, dtype=np.int64))
                head = b.filter(pa.array((part == p) & (kind == 0)))
                r[head.column(3).to_numpy()] = head.column(2).to_numpy()
                own = b.filter(pa.array((part == p) & (kind == 1)))
                if own.num_rows:
                    yield _placed(own, r, shared.value, capacity, schema)

    n_parts = max(1, rows.rdd.getNumPartitions())
    out = both.repartition(n_parts, "part").sortWithinPartitions("part", "kind", "size", "key").mapInArrow(place, "key long, piece long, block_id long, n_tokens long")
    return out.withColumnRenamed("key", key)


def _placed(own: pa.RecordBatch, rank: np.ndarray, table: dict[int, np.ndarray], capacity: int, schema: pa.Schema) -> pa.RecordBatch:
    keys, size = own.column(2).to_numpy(zero_copy_only=False), own.column(3).to_numpy()
    null = own.column(2).is_null().to_numpy(zero_copy_only=False)
    exact = size == capacity
    whole = np.where(exact, 0, size // capacity)
    rest = np.where(exact, capacity, size % capacity)
    # full blocks of cut items
    row = np.repeat(np.arange(len(size)), whole)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    block = rank[0] + np.arange(len(row))
    rank[0] += len(row)
    # the others by their rank among equal sizes
    item = np.flatnonzero((rest > 0) | (size == 0))
    order = item[np.argsort(rest[item], kind="stable")]
    s = rest[order]
    at = np.arange(len(s)) - np.searchsorted(s, s, side="left") + np.where(s > 0, rank[s], 0)
    target = np.full(len(s), -1, dtype=np.int64)
    for v in np.unique(s[s > 0]).tolist():
        of, t = s == v, table[v]
        k = np.searchsorted(t[:, 0], at[of], side="right") - 1
        target[of] = t[k, 1] + (at[of] - t[k, 0]) // t[k, 2]
        rank[v] += int(of.sum())
    rows = np.concatenate([row, order])
    blocks = np.concatenate([block, target])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(null, 0, keys)[rows].astype(np.int64), mask=null[rows]), pa.array(np.concatenate([piece, whole[order]])),
            pa.array(blocks, mask=blocks < 0), pa.array(np.concatenate([np.full(len(row), capacity), s]).astype(np.int64)),
        ],
        schema=schema,
    )
