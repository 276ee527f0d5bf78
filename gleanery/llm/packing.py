"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost (its length and a fixed overhead by default). A document longer than
the greatest is cut into full pieces and a rest; nothing is dropped. Pieces, longest first, go into the open bin with the least
room that holds them. If none does, a bin is opened at the size of least cost: its price less what its room beyond the piece is
worth at the best size's price a token. The sizes are optimised jointly: besides that rule, each permitted size in turn is tried
as the size to open, and the packing that costs least is kept. At the end every bin is cut down to the least permitted size that
holds its contents, which is the size that is paid.

Pieces are dealt evenly to shards of at most about shard_items, by their rows' place in the input and not by a key, so no key or
source is hot; each shard is packed on its own by one task. Shards grow in number, not in size, with the input; the loss is one
part-filled bin or so a shard.

Cases: rows with null or no tokens have one piece of 0 tokens and a null bin. Documents of any length are packed whole. Ties in
length go by key, then piece. Repeated rows are packed each. An empty table gives none. Only the columns named are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def words(text: str = "text") -> Column:
    """The number of runs of characters other than white space; null as 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def pack(lengths: Sequence[int], capacities: Sequence[int], overhead: float) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, its offset in the bin, size of each bin). lengths: longest first, none above the greatest capacity."""
    caps = sorted(capacities)
    price = {c: c + overhead for c in caps}
    worth = min(price[c] / c for c in caps)
    best = None
    for only in [None, *caps]:
        bins, offsets, used = _best_fit(lengths, caps, price, worth, only)
        sizes = [caps[bisect_left(caps, u)] for u in used]
        cost = sum(price[c] for c in sizes)
        if best is None or cost < best[0]:
            best = cost, bins, offsets, sizes
    return best[1:]


def _best_fit(lengths: Sequence[int], caps: list[int], price: dict[int, float], worth: float, only: int | None) -> tuple[list[int], list[int], list[int]]:
    bins, offsets, used, size = [], [], [], []
    room: list[int] = []  # the different rooms of open bins, in order
    at: dict[int, list[int]] = {}  # bins by room
    for n in lengths:
        k = bisect_left(room, n)
        if k < len(room):
            r = room[k]
            b = at[r].pop()
            if not at[r]:
                del at[r], room[k]
        else:
            fits = caps[bisect_left(caps, n) :]
            r = max(only, fits[0]) if only else min(fits, key=lambda c: (price[c] - worth * (c - n), c))
            b = len(used)
            used.append(0)
            size.append(r)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        r -= n
        if r:
            if r not in at:
                insort(room, r)
                at[r] = []
            at[r].append(b)
    return bins, offsets, used


def packed(docs: DataFrame, tokens: Column | None = None, key: str = "doc_id", text: str = "text", capacities: Sequence[int] = CAPACITIES, overhead: float = 16.0, shard_items: int = 1 << 16) -> DataFrame:
    """A row for each piece: key, piece, start and n_tokens in the document, bin_id, offset in the bin, bin_size, bin_tokens."""
    top = max(capacities)
    n = F.coalesce((words(text) if tokens is None else tokens).cast("bigint"), F.lit(0).cast("bigint"))
    items = docs.select(F.col(f"`{key}`").alias("k"), n.alias("n"))
    total = items.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_items))
    # multiplied by an odd constant: neighbours in the input land in different shards
    row = F.monotonically_increasing_id()
    items = items.withColumn("row", row).select("k", "n", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.col("n") - 1), F.lit(top).cast("bigint"))).alias("piece", "start"), "row")
    items = items.select("k", "piece", "start", F.least(F.lit(top).cast("bigint"), F.col("n") - F.col("start")).alias("n"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    kind = docs.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = group.sort_by([("n", "descending"), ("k", "ascending"), ("piece", "ascending")])
        lengths = order.column("n").to_pylist()
        full = len(lengths) - lengths.count(0)  # pieces of 0 tokens come last
        bins, offsets, sizes = pack(lengths[:full], capacities, overhead)
        held = [0] * len(sizes)
        for b, m in zip(bins, lengths):
            held[b] += m
        first = order.column("shard")[0].as_py() << 32
        none = [None] * (len(lengths) - full)
        return pa.table({
            key: order.column("k"), "piece": order.column("piece"), "start": order.column("start"), "n_tokens": order.column("n"), "bin_id": pa.array([first + b for b in bins] + none, pa.int64()),
            "offset": pa.array(offsets + none, pa.int64()), "bin_size": pa.array([sizes[b] for b in bins] + none, pa.int64()), "bin_tokens": pa.array([held[b] for b in bins] + none, pa.int64()),
        })

    return items.groupBy("shard").applyInArrow(run, f"`{key}` {kind}, piece int, start bigint, n_tokens bigint, bin_id bigint, offset bigint, bin_size bigint, bin_tokens bigint")
