"""Best-fit packing of documents into training sequences of several permitted lengths.

Rows of lengths only are dealt into groups of bounded size, and each group is packed by itself: longest piece first,
into the open sequence that it fills best; if none has room, a sequence of the least-cost length is opened. Each
permitted length is tried as the least length to open, and so is the length that costs least for what is still to
come; in the end every sequence shrinks to the least permitted length that holds its contents, and the cheapest of
these plans stands.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

LENGTHS = (512, 1024, 2048, 4096)
#: Tokens, and rows, of a group: what one task holds at a time.
GROUP_TOKENS = 1 << 22
GROUP_ROWS = 50_000


def words(text: str = "text") -> Column:
    """Number of words of a text column."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def sequence_cost(length: int) -> float:
    """Cost of computing a sequence: a part for each token, a small one for each pair of tokens, and a fixed one."""
    return 32 + length + length * length / 65536


def best_fit(sizes: Sequence[int], lengths: Sequence[int], opens: Callable[[int, int], int]) -> tuple[list[int], list[int], list[int]]:
    """Bin of each size, its place in it, and the bins' used room; sizes must be in descending order.

    opens: length of the sequence to open for a size when so much is left in all.
    """
    bins, places, used, full = [], [], [], []
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r: some open sequence has exactly r tokens of room
    left = sum(sizes)
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = free[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room = opens(size, left)
            b = len(used)
            used.append(0)
            full.append(room)
        bins.append(b)
        places.append(used[b])
        used[b] += size
        room = full[b] - used[b]
        free.setdefault(room, []).append(b)
        rooms |= 1 << room
        left -= size
    return bins, places, used


def cheapest(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each size, and each bin's length, under the cheapest plan."""
    lengths = sorted(lengths)
    holds = lambda n: next(x for x in lengths if x >= n)

    def least_cost(size: int, left: int) -> int:
        return min((x for x in lengths if x >= size), key=lambda x: (cost(x) / max(1, min(x, left)), x))

    plans = [least_cost] + [lambda size, left, least=x: holds(max(size, least)) for x in lengths]
    best = None
    for opens in plans:
        bins, places, used = best_fit(sizes, lengths, opens)
        final = [holds(u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, places, final
    return best[1:]


PIECES = "group long, bin long, bin_length int, place int, piece int, start long, length int"


def pack(docs: DataFrame, size: Column, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_length, place: where each piece of each document goes.

    A document longer than the greatest permitted length is cut into pieces of that length and a rest. A size of
    null or 0 makes one empty piece. ``bin_id`` is group * 2**32 + number in the group. Repeated rows are packed
    each, spread over the groups. Other columns are not carried; an empty table gives no rows.
    """
    most = max(lengths)
    # slim rows, written down: sizes are counted once, and each row's number spreads repeated rows over the groups
    rows = written(docs.select("doc_id", F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    total = rows.agg(F.sum("size").alias("tokens"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / most))).alias("pieces")).first()
    groups = max(1, -(-(total["tokens"] or 0) // GROUP_TOKENS), -(-(total["pieces"] or 0) // GROUP_ROWS))
    last = F.greatest(F.lit(0), F.expr(f"(size - 1) div {most}"))
    pieces = rows.select("doc_id", "size", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("group"),
        "doc_id",
        F.col("piece").cast("int"),
        (F.col("piece") * most).alias("start"),
        F.least(F.lit(most), F.col("size") - F.col("piece") * most).cast("int").alias("length"),
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, places, final = cheapest(rows["length"].tolist(), lengths, cost)
        bins = np.array(bins, np.int64)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
                "bin_id": (rows["group"].to_numpy().astype(np.int64) << 32) + bins, "bin_length": np.array(final, np.int32)[bins], "place": places,
            }
        )

    return pieces.groupBy("group").applyInPandas(run, "doc_id long, piece int, start long, length int, bin_id long, bin_length int, place int")
