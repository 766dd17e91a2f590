"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Pieces are counted by length, which leaves at most one row per length; best fit in order of decreasing length is then
run on counts, on the driver, for whole runs of equal bins at a time. What it decides for "the r-th piece of length l"
is applied to the pieces by a join on length, so no task sees more than its share of pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import shared, token_files

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its capacity, in tokens.
OVERHEAD = 64
#: A plan of more rows than this isn't broadcast.
BROADCAST_ROWS = 200_000


@dataclass
class Plan:
    """placements: (length, first rank, end rank, first bin, offset in it, pieces in each bin); bins: (first, end, used)."""

    placements: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)

    def cost(self, capacities: Sequence[int], overhead: int) -> int:
        return sum((end - first) * (downsized(used, capacities) + overhead) for first, end, used in self.bins)


def downsized(used: int, capacities: Sequence[int]) -> int:
    return capacities[bisect.bisect_left(capacities, used)]


def best_fit(counts: dict[int, int], capacities: Sequence[int], overhead: int, opening: int | None = None) -> Plan:
    """Best fit on counts of pieces by length. opening: the bin size to open where the piece fits it.

    Without opening, the bin with the least cost per token that it can expect to hold is opened: of the piece at hand
    as many as there are and fit, and of the rest what shorter pieces are left to fill it with.
    """
    plan, rooms, held = Plan(), [], {}  # rooms: free space of open bins, ascending; held: their runs (first, end, used)
    shorter = sum(length * n for length, n in counts.items())
    n_bins = 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if run[0] == run[1]:
            return
        if room not in held:
            bisect.insort(rooms, room)
            held[room] = []
        held[room].append(run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        shorter -= length * left
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fitting = [c for c in capacities if c >= length]
                if opening is not None:
                    size = opening if opening >= length else fitting[0]
                else:
                    def price(c: int) -> float:
                        per = min(c // length, left)
                        bins = -(-left // (c // length))
                        return (c + overhead) / min(c, per * length + shorter / bins)
                    size = min(fitting, key=lambda c: (price(c), c))
                new = -(-left // (size // length))
                put(size, (n_bins, n_bins + new, 0))
                n_bins += new
                continue
            room = rooms[at]
            first, end, used = held[room].pop()
            if not held[room]:
                del held[room], rooms[at]
            each = room // length
            whole = min(end - first, left // each)
            if whole:
                plan.placements.append((length, rank, rank + whole * each, first, used, each))
                put(room - each * length, (first, first + whole, used + each * length))
                left, rank = left - whole * each, rank + whole * each
            first += whole
            if left and first < end:  # fewer are left than one more bin holds
                plan.placements.append((length, rank, rank + left, first, used, left))
                put(room - left * length, (first, first + 1, used + left * length))
                first, left = first + 1, 0
            put(room, (first, end, used))
    plan.bins = sorted(run for runs in held.values() for run in runs)
    return plan


def optimise(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The least costly of the plans that open by price or always one size; each bin counts as downsized to its contents."""
    plans = [best_fit(counts, capacities, overhead, opening) for opening in (None, *capacities)]
    return min(plans, key=lambda p: p.cost(capacities, overhead))


def placement_rows(plan: Plan, capacities: Sequence[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Placements cut where their bins end up at different capacities, with that capacity."""
    firsts, rows = [b[0] for b in plan.bins], []
    for length, rank, stop, bin_first, offset, each in plan.placements:
        k = bisect.bisect_right(firsts, bin_first) - 1
        while rank < stop:
            end = plan.bins[k][1]
            until = min(stop, rank + (end - bin_first) * each)
            capacity = downsized(plan.bins[k][2], capacities)
            if rows and rows[-1][0] == length and rows[-1][2] == rank and rows[-1][5:] == (each, capacity) and rows[-1][4] == offset and rows[-1][3] + (rank - rows[-1][1]) // each == bin_first:
                rows[-1] = (*rows[-1][:2], until, *rows[-1][3:])
            else:
                rows.append((length, rank, until, bin_first, offset, each, capacity))
            bin_first, rank, k = end, until, k + 1
    return rows


def n_tokens(text_col: str = "text"):
    """Words of a text and one end mark; a null text has the mark only."""
    return F.coalesce(F.regexp_count(text_col, F.lit(r"\S+")), F.lit(0)) + 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", length: object = None, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: doc_id, piece, doc_start, length, bin_id, bin_offset, capacity.

    length: a column with each document's tokens (by default the words of column text, and one end mark). Documents of
    more than the largest capacity are cut into pieces of it and a rest; null or non-positive lengths give no piece;
    repeated rows and null ids are packed like others. Bins are numbered from 0; an empty table gives no rows.
    """
    capacities, spark = sorted(capacities), docs.sparkSession
    most = capacities[-1]
    size = (n_tokens() if length is None else length).cast("long")
    measured = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"))
    cut = measured.select("doc_id", "size", F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / most)))).alias("piece"))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    pieces = cut.select("doc_id", "piece", F.least(F.lit(most), F.col("size") - F.col("piece") * most).alias("length"), spread.alias("part"))
    pieces = shared.stored(pieces, "pieces")
    in_parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in in_parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    rows = placement_rows(optimise(counts, capacities, overhead), capacities)
    kind = "length long, low long, high long, first_bin long, first_offset long, each long, capacity long"
    plan = spark.createDataFrame(rows, kind)
    if len(rows) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = in_parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("within", within).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(plan, "length").where("rank >= low and rank < high").withColumn("step", F.col("rank") - F.col("low"))
    return placed.select(
        "doc_id", "piece", (F.col("piece") * most).alias("doc_start"), "length",
        (F.col("first_bin") + F.floor(F.col("step") / F.col("each"))).alias("bin_id"),
        (F.col("first_offset") + F.col("step") % F.col("each") * F.col("length")).alias("bin_offset"), "capacity",
    )


def pack_files(manifest: DataFrame, **options) -> DataFrame:
    """pack() for the documents of token files (see token_files.write_tokens), with path and at: where each piece's ids are."""
    docs = token_files.read_tokens(manifest, with_place=True).select(F.struct("doc_id", "path", "at").alias("doc"), "n_tokens")
    found = pack(docs, id_col="doc", length=F.col("n_tokens"), **options).withColumnRenamed("doc_id", "doc")
    return found.select("doc.doc_id", *[c for c in found.columns if c != "doc"], "doc.path", (F.col("doc.at") + F.col("doc_start")).alias("at"))


def sequences(packed: DataFrame) -> DataFrame:
    """bin_id, capacity, ids: the training sequences of what pack_files() gave, read from the files. A bin holds capacity ids at most."""
    runs = packed.select("path", "at", F.col("length").alias("n"), "bin_id", "bin_offset", "capacity")
    pieces = token_files.read_runs(runs).groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "ids"))).alias("pieces"))
    return pieces.select("bin_id", "capacity", F.flatten("pieces.ids").alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed by their numbers of tokens as op3 writes them; odd rows as pack() says, null texts have an end mark only."""
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, length=token_files.n_tokens(F.col("text"), public_tokenizers.path("word_bpe_49k.json")))
