"""Column expressions of the data model: orders, identifiers, strands, phasings, sizes.

Relations and their columns:

    segments     chr, start, end [, sid, extra]       closed, start on strand -, end on strand +
    adjacencies  aid, chr1, coord1, strand1, chr2, coord2, strand2 [, at, extra]
    breakends    aid, side (0 or 1), chr, coord, strand
    scnt         sid, clone, hap (A or B), cn          copy numbers of segments
    scnb         sid, clone, hap, bound (l or u), value
    acnt         aid, clone, phasing (AA AB BA BB), cn
    groups       gid, agt (M, L or N), fp, aids, agl
    regions      rid, chr, start, end
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
FAR = 3_000_000_000
PHASINGS = ("AA", "AB", "BA", "BB")
HAPLOTYPES = ("A", "B")
MAIN_CHROMOSOMES = (*(str(i) for i in range(1, 23)), "X", "Y")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strand_ord(strand: Column | str) -> Column:
    """- comes before +."""
    return F.when(c(strand) == "+", 1).otherwise(0)


def chr_key(chr_: Column | str) -> Column:
    """Chromosomes by length of the name, then by the name: 5 before 10."""
    return F.struct(F.length(c(chr_)).alias("n"), c(chr_).alias("chr"))


def position_key(chr_, coord, strand) -> Column:
    """Structs compare field by field: chromosome, coordinate, strand."""
    return F.struct(F.length(c(chr_)).alias("n"), c(chr_).alias("chr"), c(coord).alias("coord"), strand_ord(strand).alias("s"))


def model_order(chr_="chr", coord="coord", strand="strand", *ties) -> list[Column]:
    return [F.length(c(chr_)), c(chr_), c(coord), strand_ord(strand), *map(c, ties)]


def position_id(chr_, coord, strand, hap=None) -> Column:
    parts = [c(chr_), F.lit(":")]
    if hap is not None:
        parts += [c(hap), F.lit(":")]
    return F.concat(*parts, c(strand), c(coord).cast("string"))


def segment_id(chr_="chr", start="start", end="end") -> Column:
    return F.concat(c(chr_), F.lit(":"), c(start).cast("string"), F.lit("-"), c(end).cast("string"))


def adjacency_id(at=None) -> Column:
    """Of the two ends in model order, and the type (N unless given)."""
    one, two = position_id("chr1", "coord1", "strand1"), position_id("chr2", "coord2", "strand2")
    return F.concat(F.lit("["), one, F.lit("]-["), two, F.lit("]"), F.lit("N") if at is None else c(at))


def reciprocal_coord(coord, strand) -> Column:
    """(x, +) faces (x + 1, -)."""
    return F.when(c(strand) == "+", c(coord) + 1).otherwise(c(coord) - 1)


def flipped_strand(strand) -> Column:
    return F.when(c(strand) == "+", "-").otherwise("+")


def segment_length(start="start", end="end") -> Column:
    return c(end) - c(start) + 1


def scaled_length(k: int, start="start", end="end") -> Column:
    """ceil((end - start) / k): without the 1 that ``segment_length`` adds."""
    return F.ceil((c(end) - c(start)) / F.lit(k)).cast("long")


def distance() -> Column:
    """Between the ends of an adjacency; -1 across chromosomes."""
    return F.when(c("chr1") == c("chr2"), F.abs(c("coord1") - c("coord2"))).otherwise(F.lit(-1)).cast("long")


def strand_distance(chr1, coord1, strand1, chr2, coord2, strand2) -> Column:
    """FAR if chromosome or strand differ."""
    same = (c(chr1) == c(chr2)) & (c(strand1) == c(strand2))
    return F.when(same, F.abs(c(coord1) - c(coord2))).otherwise(F.lit(FAR)).cast("long")


def flipped_phasing(phasing) -> Column:
    return F.reverse(c(phasing))


def stable_phasing(phasing, in_order) -> Column:
    """As seen with the ends in order; AA where there is none."""
    return F.coalesce(F.when(c(in_order), c(phasing)).otherwise(flipped_phasing(phasing)), F.lit("AA"))


def adjacency_size(svlen=None, sequence=None, svtype=None) -> Column:
    """Of the extras: |svlen| (fraction cut off), else the length of the inserted sequence, else the distance."""
    options = []
    if svlen is not None:
        options.append(F.abs(c(svlen).try_cast("double").cast("long")))
    if sequence is not None:
        options.append(F.length(c(sequence)).cast("long"))
    size = F.coalesce(*options, distance())
    return size if svtype is None else F.when(F.lower(c(svtype)) == "ins", F.coalesce(*options, F.lit(0).cast("long"))).otherwise(size)


def strip_chr(name) -> Column:
    """Without a leading ``chr``."""
    return F.regexp_replace(c(name), "^chr", "")


def reference_phasing(side, hap) -> Column:
    """Of a reference adjacency: both ends on one haplotype."""
    return F.concat(c(hap), c(hap))


def novel_phasing(side, hap, other) -> Column:
    """With the given end on ``hap`` and the other end on ``other``."""
    return F.when(c(side) == 0, F.concat(c(hap), c(other))).otherwise(F.concat(c(other), c(hap)))
