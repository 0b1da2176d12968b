"""Best-fit packing into sequences of several permitted lengths.

A document takes one place per word and one for its end mark; what is longer than the largest capacity is cut into pieces
of that capacity and a rest, so nothing is dropped. Only (doc_id, piece, length) is dealt out, to shards of about
``shard_pieces`` rows; a shard is packed in one task. There pieces go, longest first, into the open bin with the least
room that still fits. Where none fits, a bin of the size with the least expected cost per filled place is opened. At the
end each bin is cut down to the smallest permitted size that holds its contents. The whole shard is packed under several
opening rules and the cheapest outcome stays.

The cost of a sequence of c places is c * (1 + c / knee): linear work and attention. Defined results: null and empty texts
have length 1 (their end mark). Pieces of equal length are taken by doc_id, null ids first, then by piece. Rows that
repeat an id are packed each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Pack:
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    knee: float = 8192.0
    shard_pieces: int = 1 << 16

    def cost(self, capacity: int) -> float:
        return capacity * (1 + capacity / self.knee)


def pieces(docs: DataFrame, how: Pack = Pack()) -> DataFrame:
    """doc_id, piece (from 0), length."""
    top = max(how.capacities)
    length = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint") + 1
    rows = docs.select("doc_id", length.alias("total"))
    return (rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / top))))
            .select("doc_id", "piece", F.least(F.lit(top).cast("bigint"), F.col("total") - F.col("piece") * top).alias("length")))


def _opened(length: int, rest: int, least: int, how: Pack, rule: str, sizes: list[int]) -> int:
    """Capacity of the bin to open for a piece; rest: places that later pieces need, least: the shortest of them."""
    fitting = [c for c in sizes if c >= length]
    if rule == "smallest":
        return fitting[0]
    if rule == "largest":
        return fitting[-1]

    def expected(c: int) -> float:
        room = c - length
        return how.cost(c) / (length + (min(room, rest) if least <= room else 0))

    return min(fitting, key=lambda c: (expected(c), c))


def best_fit(lengths: np.ndarray, how: Pack, rule: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece (lengths in falling order), and the final capacity of each bin."""
    sizes = sorted(how.capacities)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    room: dict[int, list[int]] = {}  # bins by free places
    open_rooms = 0  # bit r is set where room[r] has a bin
    rest = int(lengths.sum())
    least = int(lengths[-1]) if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        rest -= length
        above = open_rooms >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            k = room[free].pop()
            if not room[free]:
                open_rooms ^= 1 << free
        else:
            k = len(used)
            used.append(0)
            free = _opened(length, rest, least, how, rule, sizes)
        bins[i], offsets[i] = k, used[k]
        used[k] += length
        free -= length
        room.setdefault(free, []).append(k)
        open_rooms |= 1 << free
    return bins, offsets, [next(c for c in sizes if c >= u) for u in used]


def pack_shard(rows: pa.Table, how: Pack) -> pa.Table:
    """Adds bin, offset and capacity to the rows (doc_id, piece, length) of one shard. Ids keep their type: they are only sorted."""
    keys = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
    lengths = rows["length"].to_numpy()
    outcomes = [best_fit(lengths, how, rule) for rule in ("expected", "largest", "smallest")]
    bins, offsets, capacity = min(outcomes, key=lambda o: sum(map(how.cost, o[2])))
    for name, column in (("bin", bins), ("offset", offsets), ("capacity", np.array(capacity, np.int64)[bins])):
        rows = rows.append_column(name, pa.array(column, pa.int64()))
    return rows


def packed(docs: DataFrame, how: Pack = Pack()) -> DataFrame:
    """doc_id, piece, length, bin_id, offset, capacity: the place of every piece."""
    rows = cut_lineage(pieces(docs, how))
    shards = -(-rows.count() // how.shard_pieces) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(shard: pa.Table) -> pa.Table:
        out, name = pack_shard(shard.drop_columns("shard"), how), shard["shard"][0].as_py()
        out = out.append_column("bin_id", pa.array([f"{name}-{b}" for b in out["bin"].to_pylist()], pa.string()))
        return out.select(["doc_id", "piece", "length", "bin_id", "offset", "capacity"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece bigint, length bigint, bin_id string, offset bigint, capacity bigint")
