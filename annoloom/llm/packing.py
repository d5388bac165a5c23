"""Fixed-capacity containers by bounded-space online best-fit.

A fixed number of bins is open at a time, as a bitset over their free space. An item goes into the open bin it leaves
least room in, found as the lowest set bit at or above its size; where none fits, the fullest bin closes first. Items come
in an order of their own hash, in shards whose number follows the data: memory is the open bins', and a lost task gives
the same containers when run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shards

OUT = "capacity_name string, capacity_tokens long, item_id long, piece long, container_id string, start_token long, n_tokens long"


class Packer:
    """One capacity. put() gives the number of the container that takes an item of 1..capacity."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most, self.open, self.used = capacity, open_bins, 0, 0
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins: dict[int, list[int]] = {}  # free space -> numbers of the open bins

    def _take(self, space: int) -> int:
        own = self.bins[space]
        number = own.pop()
        if not own:
            del self.bins[space]
            self.free ^= 1 << space
        return number

    def put(self, size: int) -> int:
        above = self.free >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, space = self.used, self.capacity
            self.used += 1
            self.open += 1
        space -= size
        if space:
            self.bins.setdefault(space, []).append(number)
            self.free |= 1 << space
        else:
            self.open -= 1
        return number


def pack(sizes: DataFrame, capacities: DataFrame, open_bins: int = 64, tokens_per_shard: int = 20_000_000) -> DataFrame:
    """Every item's pieces and their containers, for every capacity: one row for each (capacity, item, piece).

    sizes: item_id long, n_tokens; capacities: capacity_name, capacity_tokens (a handful of rows; null or < 1 is left
    out). An item over the capacity is cut into full pieces and a rest, other items stay whole. An item of no tokens needs
    no room: one row with a null container. Equal item_ids are items of their own. No items: no rows.
    """
    limits = [(r.capacity_name, int(r.capacity_tokens)) for r in capacities.orderBy("capacity_name").collect() if r.capacity_tokens and r.capacity_tokens > 0]
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    n = shards(total, tokens_per_shard)
    schema = pa.schema([("capacity_name", pa.string()), ("capacity_tokens", pa.int64()), ("item_id", pa.int64()), ("piece", pa.int64()), ("container_id", pa.string()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packers = None, {}
        for batch in batches:
            ids, counts, at = (batch.column(i).to_pylist() for i in (0, 1, 2))
            cols: list[list] = [[] for _ in schema]
            for item, size, s in zip(ids, counts, at):
                if s != shard:
                    shard, packers = s, {name: Packer(c, open_bins) for name, c in limits}
                for name, capacity in limits:
                    if not size:
                        pieces = [(None, 0, 0)]
                    else:
                        put = packers[name].put
                        pieces = [(f"{name}-{shard}-{put(k)}", a, k) for a in range(0, size, capacity) for k in (min(capacity, size - a),)]
                    for i, (where, start, k) in enumerate(pieces):
                        for col, x in zip(cols, (name, capacity, item, i, where, start, k)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    order = F.xxhash64(F.lit(29), "item_id", "n_tokens")
    ready = sizes.select("item_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.pmod(order, F.lit(n)).alias("shard"), order.alias("place"))
    return ready.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "place", "item_id").select("item_id", "n_tokens", "shard").mapInArrow(run, OUT)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, cut items, and the share of room left unused."""
    per = packed.filter("container_id is not null").groupBy("capacity_name", "capacity_tokens")
    return per.agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("piece") == 1).alias("n_cut_items")).withColumn(
        "unused_share", 1 - F.try_divide(F.col("n_tokens"), F.col("n_containers") * F.col("capacity_tokens"))
    )
