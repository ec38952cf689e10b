"""Shards of near-equal size from contiguous ranges of atomic groups.

Rows with equal texts form a group that is never split. Groups lie in the order of a 64-bit hash. The
smallest feasible capacity is found by binary search: a capacity is feasible if filling shards one
after the other, each as far as the next group still fits, needs no more shards than there are. The
cuts keep that capacity and lie as near to even shares as it allows.

The driver never sees the groups. It works on totals of key ranges (atoms), at first 2**14 equal
ones. Where a cut may fall at any capacity that is still open, atoms are split further in a Spark
job, until each of them holds one group; elsewhere their totals are enough. So the result is that of
the search over all groups.

A group larger than an even share gets a shard of its own, and the search runs over the rest with the
shards that are left; there are fewer such groups than shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import stored

SHARDS, OVERHEAD = 40, 16
#: Key bits of the first atoms, the number of atoms that a refinement aims at, rows numbered by a task.
BITS, ATOMS, NUMBERED = 14, 1 << 15, 50_000


@dataclass(frozen=True)
class Atom:
    """Keys that start with the given bits."""

    bits: int
    prefix: int
    weight: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << (64 - self.bits)


def fill(weights: list[int], ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where each shard ends (as an index of weights) if greedy filling succeeds; ``ends``: running sums."""
    cuts, at = [], 0
    for _ in range(shards):
        done = ends[at - 1] if at else 0
        at = bisect_right(ends, done + capacity)
        cuts.append(at)
        if at == len(weights):
            return cuts + [at] * (shards - len(cuts))
    return None


def even_cuts(weights: list[int], ends: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts that keep the capacity and leave each shard as near to an even share of the rest as they can."""
    total, last = ends[-1], len(weights)
    back = [last]  # the earliest end of each shard from which the later ones can hold the rest
    for _ in range(shards - 1):
        end = back[-1]
        need = (ends[end - 1] if end else 0) - capacity
        back.append(bisect_left(ends, need) + 1 if need > 0 else 0)
    back.reverse()
    cuts, at = [], 0
    for j in range(shards):
        done = ends[at - 1] if at else 0
        most = bisect_right(ends, done + capacity)
        share = done + (total - done) / (shards - j)
        i = bisect_right(ends, share)
        if i < last and ends[i] - share < share - (ends[i - 1] if i else 0):
            i += 1
        at = min(max(i, back[j], at), most)
        cuts.append(at)
    return cuts


def smallest_capacity(weights: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts."""
    ends = list(accumulate(weights))
    total = ends[-1] if ends else 0
    low, high = max([-(-total // shards), *weights]), total
    while low < high:
        mid = (low + high) // 2
        if fill(weights, ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, fill(weights, ends, low, shards) or [0] * shards


def open_atoms(atoms: list[Atom], shards: int, low: int, high: int) -> set[int]:
    """Atoms in which a cut may fall for a capacity from low to high."""
    ends = list(accumulate(a.weight for a in atoms))
    found: set[int] = set()
    least = most = 0  # bounds of the running sum at the cut
    for _ in range(shards):
        # the earliest cut: at low, and in front of the atom that does not fit as a whole
        i = bisect_right(ends, least + low)
        j = bisect_right(ends, most + high)
        found.update(k for k in range(i, min(j, len(atoms) - 1) + 1) if atoms[k].groups > 1)
        least = ends[i - 1] if i else 0
        most = min(most + high, ends[-1]) if j < len(atoms) and atoms[j].groups > 1 else (ends[j - 1] if j else 0)
        if least >= ends[-1]:
            break
    return found


def _totals(groups: DataFrame, bits: int) -> list[Atom]:
    prefix = F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
    rows = groups.groupBy(prefix.alias("p")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    return [Atom(bits, r.p & ((1 << 64) - 1), int(r.w), r.n) for r in rows]


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity, and the key (unsigned) at which each shard but the first starts; 2**64 if none is left.

    ``groups``: ``(h, weight)`` with distinct h.
    """
    atoms = sorted(_totals(groups, BITS), key=lambda a: a.start)
    if not atoms or not shards:
        return 0, [1 << 64] * max(shards - 1, 0)
    total = sum(a.weight for a in atoms)
    while True:
        high, at = smallest_capacity([a.weight for a in atoms], shards)
        low = max(-(-total // shards), max(a.weight for a in atoms if a.groups == 1) if any(a.groups == 1 for a in atoms) else 0)
        split = open_atoms(atoms, shards, min(low, high), high)
        if not split:
            break
        by_bits: dict[int, list[Atom]] = {}
        for k in split:
            by_bits.setdefault(atoms[k].bits, []).append(atoms[k])
        atoms = [a for k, a in enumerate(atoms) if k not in split]
        for bits, coarse in by_bits.items():
            finer = min(64, bits + max(1, (ATOMS // len(coarse)).bit_length() - 1))
            signed = [(a.prefix - (1 << 64) if a.prefix >> 63 else a.prefix,) for a in coarse]
            wanted = F.broadcast(groups.sparkSession.createDataFrame(signed, "p long"))  # at most the atoms held here
            inside = groups.withColumn("p", F.shiftrightunsigned("h", 64 - bits)).join(wanted, "p", "left_semi").drop("p")
            atoms += _totals(inside, finer)
        atoms.sort(key=lambda a: a.start)
    weights = [a.weight for a in atoms]
    at = even_cuts(weights, list(accumulate(weights)), high, shards)
    starts = [a.start for a in atoms] + [1 << 64]
    return high, [starts[k] for k in at[:-1]]


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    A null text has no bytes and falls into one group with empty texts. Ids may be null or repeat.
    An empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(content) + overhead).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.xxhash64(content).alias("h"),
        ),
        "sizes",
    )
    groups = stored(rows.groupBy("h").agg(F.sum("size").alias("weight")), "groups")
    whole = groups.agg(F.sum("weight").alias("total")).first().total or 0
    alone: dict[int, int] = {}
    rest = whole
    for r in groups.orderBy(F.desc("weight"), "h").limit(shards).collect():  # no more can exceed an even share
        if len(alone) < shards - 1 and r.weight * (shards - len(alone)) > rest:
            alone[r.h] = len(alone)
            rest -= r.weight
    others = groups.where(~F.col("h").isin(list(alone))) if alone else groups
    _, starts = cuts(others, shards - len(alone))
    flip = -(1 << 63)
    ordered = F.col("h").bitwiseXOR(F.lit(flip).cast("long"))
    shard = F.lit(len(alone))
    for s in starts:
        if s < 1 << 64:
            shard = shard + (ordered >= F.lit(s + flip).cast("long")).cast("int")
    for h, n in alone.items():
        shard = F.when(F.col("h") == h, F.lit(n)).otherwise(shard)
    dealt = rows.withColumn("shard", shard.cast("int"))
    salts = max(1, -(-rows.count() // (shards * NUMBERED)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salts)))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "salt").count().select("shard", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id"))
    return (
        dealt.withColumn("number", number)
        .join(offsets, ["shard", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
