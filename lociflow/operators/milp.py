"""The integer program of the inference as tables of variables and constraint rows, and its checks.

    variables    name, kind (B or I or C), lb, ub
    constraints  row, sense (<=, >=, =), rhs
    entries      row, name, coef
    objective    name, coef

Rows are made by joins; nothing is looped over on the driver. ``lp_lines`` writes them in LP format for a solver,
``solve_tiny`` solves small instances exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.model import PHASINGS, position_id, scaled_length
from lociflow.operators.scan import numbered
from lociflow.shared import cut

#: Kept from the model of the inference: at most this many copies of an adjacency where bounds don't say.
TOP = 20
#: Names of variables that are sent to all tasks; more meet by a shuffle.
SENT = 200_000


@dataclass
class Model:
    variables: DataFrame
    constraints: DataFrame
    entries: DataFrame
    objective: DataFrame


@dataclass
class Inputs:
    """``segments`` (sid, fid, chr, start, end), ``scnt`` (sid, clone, hap, cn), ``bounds`` (sid, clone, hap, l, u), ``adjacencies``
    (aid, chr1 .. strand2, at), ``telomeres`` (chr, coord, strand), ``groups`` (gid, agt, fp, aids, agl) or None."""

    segments: DataFrame
    scnt: DataFrame
    bounds: DataFrame
    adjacencies: DataFrame
    telomeres: DataFrame
    groups: DataFrame | None = None
    overall_fp: float = 0.1
    length: int = 10
    haploid: bool = False
    clones: DataFrame | None = None  # those of ``scnt``, written when first asked for


def name(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def _clones(i: Inputs) -> DataFrame:
    """A handful. They are found once, and a cross join sends them around, not the adjacencies, whose files may be smaller than Spark's estimate of the copy numbers."""
    if i.clones is None:
        i.clones = cut(i.scnt.select("clone").distinct(), "clones", rows=1)
    return F.broadcast(i.clones)


def _phasings(i: Inputs) -> Column:
    return F.explode(F.array(*map(F.lit, ("AA",) if i.haploid else PHASINGS)))


def _any_clone(i: Inputs) -> DataFrame:
    """One row if there is a clone, for rows that all clones share."""
    return F.broadcast(_clones(i).limit(1).select(F.lit(True).alias("some")))


def _phased(i: Inputs, *keep: str) -> DataFrame:
    """``(aid, at, clone, phasing, ...)``"""
    return i.adjacencies.select("aid", "at", *keep, _phasings(i).alias("phasing")).crossJoin(_clones(i))


def variables(i: Inputs) -> DataFrame:
    """Per fragment a flip bit; per clone, segment and haplotype copies and their distance; per clone and adjacency its copies
    (whole and by phasing), presence by phasing; presence over all clones; bits for groups."""
    num = lambda x: (F.lit(x) if not isinstance(x, Column) else x).cast("double")
    of = lambda df, n, kind, lb, ub: df.select(n.alias("name"), F.lit(kind).alias("kind"), num(lb).alias("lb"), num(ub).alias("ub"))
    flip = of(i.segments.select("fid").distinct(), name("flip", "fid"), "B", 1 if i.haploid else 0, 1)
    cn = of(i.bounds, name("cn", "clone", "sid", "hap"), "I", F.when(F.lit(i.haploid) & (F.col("hap") == "B"), 0).otherwise(F.col("l")), F.when(F.lit(i.haploid) & (F.col("hap") == "B"), 0).otherwise(F.col("u")))
    delta = of(i.bounds, name("delta", "clone", "sid", "hap"), "C", 0, F.lit(None))
    a = _phased(i)
    product = of(a, name("acn", "clone", "aid", "phasing"), "I", 0, F.lit(None))
    present = of(a, name("present", "clone", "aid", "phasing"), "B", 0, 1)
    refs = of(a.where("at = 'R'"), name("rcn", "clone", "aid", "phasing"), "I", 1, F.lit(None))
    novel = of(i.adjacencies.where("at = 'N'").crossJoin(_clones(i)), name("ncn", "clone", "aid"), "I", 1, F.lit(None))
    overall = of(i.adjacencies.select("aid", _phasings(i).alias("phasing")), name("overall", "aid", "phasing"), "B", 0, 1)
    out = flip.unionByName(cn).unionByName(delta).unionByName(refs).unionByName(novel).unionByName(present).unionByName(product).unionByName(overall)
    if i.groups is not None:
        m = i.groups.where("agt = 'M'").crossJoin(_clones(i))
        out = out.unionByName(of(m, name("mol", "gid", "clone"), "B", 0, 1))
        l = i.groups.where("agt = 'L'").select("gid", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hap"))
        out = out.unionByName(of(l, name("lab", "gid", "hap"), "B", 0, 1))
    return out


def _rows(df: DataFrame, row: Column, sense: str, rhs, *terms: tuple[Column, object], alone: bool = False) -> tuple[DataFrame, DataFrame]:
    """``alone``: each row of ``df`` makes a constraint of its own, so none is there twice."""
    none = "array<struct<name:string,coef:double>>"
    own = df.select(row.alias("row"), F.lit(sense).alias("sense"), (rhs if isinstance(rhs, Column) else F.lit(rhs)).cast("double").alias("rhs"), F.array(*(F.struct(n.alias("name"), (k if isinstance(k, Column) else F.lit(k)).cast("double").alias("coef")) for n, k in terms)).cast(none).alias("t"))
    made = own.select("row", "sense", "rhs")
    return made if alone else made.distinct(), own.select("row", F.explode("t").alias("t")).select("row", "t.name", "t.coef").where("coef <> 0")


def bound_rows(i: Inputs):
    """With the flip bit the bounds of the haplotypes change places: four rows a clone and segment."""
    both = i.bounds.groupBy("sid", "clone").agg(*(F.max(F.when(F.col("hap") == h, F.col(b))).alias(f"{b}{h}") for h in "AB" for b in "lu")).join(i.segments.select("sid", "fid"), "sid")
    flip = name("flip", "fid")
    out = []
    for h, o in (("A", "B"), ("B", "A")):
        cn = name("cn", "clone", "sid", F.lit(h))
        # cn >= l * flip + l_other * (1 - flip), and the same from above.
        out.append(_rows(both, name("low" + h, "clone", "sid"), ">=", F.col(f"l{o}"), (cn, 1), (flip, F.col(f"l{o}") - F.col(f"l{h}")), alone=True))
        out.append(_rows(both, name("high" + h, "clone", "sid"), "<=", F.col(f"u{o}"), (cn, 1), (flip, F.col(f"u{o}") - F.col(f"u{h}")), alone=True))
    return out


def _incident_top(i: Inputs) -> DataFrame:
    """``(aid, at, clone, phasing, top)``: the least upper bound of the segments at either end.

    Bounds at an end are one row, so an adjacency meets each of its ends once and not for every clone and phasing.
    """
    b = i.segments.join(i.bounds, "sid")
    ends = b.select("clone", "hap", "u", F.explode(F.array(F.struct(F.col("chr"), F.col("start").alias("coord"), F.lit("-").alias("strand")), F.struct(F.col("chr"), F.col("end").alias("coord"), F.lit("+").alias("strand")))).alias("e")).select("clone", "hap", "u", "e.*")
    ends = ends.groupBy("chr", "coord", "strand").agg(F.collect_list(F.struct("clone", "hap", "u")).alias("b"))
    a = i.adjacencies.select("aid", "at", "chr1", "coord1", "strand1", "chr2", "coord2", "strand2")
    for k in (1, 2):
        a = a.join(ends.select(*(F.col(x).alias(f"{x}{k}") for x in ("chr", "coord", "strand", "b"))), [f"{x}{k}" for x in ("chr", "coord", "strand")], "left")
    a = a.select("aid", "at", "b1", "b2", _phasings(i).alias("phasing")).crossJoin(_clones(i))
    # Each of an end's bounds for the clone and haplotype, or none: as many rows as a join gives.
    of = lambda k: F.filter(f"b{k}", lambda x: (x["clone"] == F.col("clone")) & (x["hap"] == F.substring("phasing", k, 1)))
    for k in (1, 2):
        a = a.withColumn(f"u{k}", F.explode_outer(F.transform(of(k), lambda x: x["u"])))
    return a.select("aid", "at", "clone", "phasing", F.coalesce(F.least("u1", "u2"), F.lit(TOP)).alias("top"))


def product_lists(i: Inputs) -> DataFrame:
    """``(clone, aid, phasing, rows)``: the four rows of ``product_rows`` (row, sense, rhs, terms) of each clone, adjacency and phasing together, not moved once made."""
    a = _incident_top(i)
    acn, present = name("acn", "clone", "aid", "phasing"), name("present", "clone", "aid", "phasing")
    whole = F.when(F.col("at") == "R", name("rcn", "clone", "aid", "phasing")).otherwise(name("ncn", "clone", "aid"))
    top = F.col("top")
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    term = lambda n, k: F.struct(n.alias("name"), number(k).alias("coef"))

    def row(k, sense, rhs, *terms):
        own = F.filter(F.array(*(term(*t) for t in terms)), lambda t: t["coef"] != 0)
        return F.struct(name(f"big{k}", "clone", "aid", "phasing").alias("row"), F.lit(sense).alias("sense"), number(rhs).alias("rhs"), own.alias("terms"))

    rows = F.array(row(1, "<=", 0, (acn, 1), (present, -top)), row(2, "<=", 0, (acn, 1), (whole, -1)), row(3, ">=", -top, (acn, 1), (whole, -1), (present, -top)), row(4, ">=", 0, (acn, 1)))
    return a.select("clone", "aid", "phasing", rows.alias("rows"))


def product_rows(i: Inputs):
    """acn = copies * present, made linear by the largest number of copies."""
    rows = product_lists(i).select(F.explode("rows").alias("x"))
    return [(rows.select("x.row", "x.sense", "x.rhs"), rows.select("x.row", F.explode("x.terms").alias("t")).select("row", "t.name", "t.coef"))]


def labeling_rows(i: Inputs):
    """Reference adjacencies stay on one haplotype. A novel one's phasing is there overall if in any clone, and at most one
    is; a loop has no mixed one."""
    out = []
    if not i.haploid:
        refs = _phased(i).where("at = 'R' and phasing in ('AB', 'BA')")
        out.append(_rows(refs, name("ref", "clone", "aid", "phasing"), "=", 0, (name("present", "clone", "aid", "phasing"), 1), alone=True))
    novel = _phased(i, "chr1", "coord1", "strand1", "chr2", "coord2", "strand2").where("at = 'N'")
    overall, present = name("overall", "aid", "phasing"), name("present", "clone", "aid", "phasing")
    out.append(_rows(novel, name("or_low", "clone", "aid", "phasing"), ">=", 0, (overall, 1), (present, -1), alone=True))
    up = name("or_high", "aid", "phasing")
    one = i.adjacencies.where("at = 'N'").select("aid", _phasings(i).alias("phasing"))
    c, e1 = _rows(one.crossJoin(_any_clone(i)), up, "<=", 0, (overall, 1), alone=True)
    _, e2 = _rows(novel, up, "<=", 0, (present, -1))
    out.append((c, e1.unionByName(e2)))
    once = lambda df, *terms: _rows(df, name("once", "aid"), "<=", 1, *terms, alone=True)
    out.append((once(i.adjacencies.where("at = 'N'"))[0], once(one, (name("overall", "aid", "phasing"), 1))[1]))
    if not i.haploid:
        loops = i.adjacencies.where("at = 'N' and chr1 = chr2 and coord1 = coord2 and strand1 = strand2").select("aid", F.explode(F.array(F.lit("AB"), F.lit("BA"))).alias("phasing"))
        out.append(_rows(loops, name("loop", "aid", "phasing"), "=", 0, (name("overall", "aid", "phasing"), 1), alone=True))
    return out


def overall_rows(i: Inputs):
    """At least 1 - fp of the novel adjacencies are there."""
    one = i.adjacencies.where("at = 'N'")
    n = one.agg(F.count("*").alias("n"))
    rows = one.select("aid", _phasings(i).alias("phasing")).crossJoin(F.broadcast(n))  # one row
    return [_rows(rows, F.lit("fp"), ">=", F.lit(1 - i.overall_fp) * F.col("n"), (name("overall", "aid", "phasing"), 1))]


def reciprocal_names(i: Inputs) -> DataFrame | None:
    """``(row, names)``: the variables of each row of ``reciprocal_rows``, in order of their names; None for a haploid model.

    A reference adjacency between m and n novel ends gives m n pairs and twice as many rows, so ends are made distinct before they
    meet: no row comes twice, and rows aren't moved once they are made.
    """
    if i.haploid:
        return None
    end = lambda k: position_id(f"chr{k}", f"coord{k}", f"strand{k}")
    novel = i.adjacencies.where("at = 'N'").select("aid", F.posexplode(F.array(end(1), end(2))).alias("side", "node")).distinct()
    refs = i.adjacencies.where("at = 'R'").select(end(1).alias("u"), end(2).alias("v")).distinct()
    on = lambda k, hap: F.transform(F.filter(F.array(*map(F.lit, PHASINGS)), lambda p: F.substring(p, F.col("side") + 1, F.lit(1)) == hap), lambda p: F.concat_ws("|", F.lit("overall"), F.col("aid"), p)).alias(f"{k}{hap}")
    # The variables of an end are listed before it meets others.
    side = lambda k, node: novel.select(F.col("aid").alias(k), F.col("side").cast("string").alias(f"s{k}"), F.col("node").alias(node), *(on(k, h) for h in "AB"))
    pairs = refs.join(side("a", "u"), "u").join(side("b", "v"), "v")
    rows = F.explode(F.array(*(F.struct(name(f"side{k}", "u", "v", "a", "b", "sa", "sb").alias("row"), F.array_sort(F.array_distinct(F.concat(f"a{h}", f"b{o}"))).alias("names")) for k, (h, o) in enumerate((("A", "B"), ("B", "A")))))).alias("x")
    return pairs.select(rows).select("x.row", "x.names")


def reciprocal_rows(i: Inputs):
    """Novel adjacencies at the two sides of a reference adjacency use one haplotype: two rows for each such pair."""
    rows = reciprocal_names(i)
    if rows is None:
        return []
    return [(rows.select("row", F.lit("<=").alias("sense"), F.lit(1.0).alias("rhs")), rows.select("row", F.explode("names").alias("name"), F.lit(1.0).alias("coef")))]


def group_rows(i: Inputs):
    if i.groups is None:
        return []
    out = []
    held = i.groups.where("size(aids) > 0").withColumn("n", F.size("aids"))
    whole = held.where("agt = 'M'").crossJoin(_clones(i))
    m = whole.select("gid", "clone", F.explode("aids").alias("aid")).select("*", _phasings(i).alias("phasing"))
    row = name("mol", "gid", "clone")
    c, e2 = _rows(whole, row, ">=", 0, (name("mol", "gid", "clone"), -(1 - F.coalesce("fp", F.lit(0.1))) * F.col("n")), alone=True)
    _, e1 = _rows(m, row, ">=", 0, (name("present", "clone", "aid", "phasing"), 1))
    out.append((c, e1.unionByName(e2)))
    out.append(_rows(i.groups.where("agt = 'M'").crossJoin(_clones(i)), name("mol_any", "gid"), ">=", 1, (name("mol", "gid", "clone"), 1)))
    general = held.where("agt = 'N'")
    n = general.select("gid", F.explode("aids").alias("aid")).select("*", _phasings(i).alias("phasing"))
    c, _ = _rows(general, name("gen", "gid"), ">=", (1 - F.coalesce("fp", F.lit(0.1))) * F.col("n"), alone=True)
    out.append((c, _rows(n, name("gen", "gid"), ">=", 0, (name("overall", "aid", "phasing"), 1))[1]))
    if not i.haploid:
        l = i.groups.where("agt = 'L'").select("gid", F.posexplode("aids").alias("pos", "aid"), "agl").select("gid", "aid", F.try_element_at("agl", F.col("pos") + 1).alias("side"), _phasings(i).alias("phasing"))
        l = l.withColumn("hap", F.when(F.col("side") == 0, F.substring("phasing", 1, 1)).otherwise(F.substring("phasing", 2, 1)))
        out.append(_rows(l, name("lab_or", "gid", "hap", "aid", "phasing"), ">=", 0, (name("lab", "gid", "hap"), 1), (name("overall", "aid", "phasing"), -1)))
        one = i.groups.where("agt = 'L'").select("gid", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hap"))
        out.append(_rows(one, name("lab_once", "gid"), "<=", 1, (name("lab", "gid", "hap"), 1)))
    return out


def balance_rows(i: Inputs):
    """Per clone, node and haplotype: copies of the segment less those of the adjacencies, a loop counting at both its ends;
    not negative at telomeres, none elsewhere."""
    seg = i.segments.select("sid", F.explode(F.array(position_id("chr", "start", F.lit("-")), position_id("chr", "end", F.lit("+")))).alias("node"))
    haps = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hap")
    s = seg.crossJoin(_clones(i)).select("node", "clone", haps, "sid")
    s = s.select(name("node", "clone", "node", "hap").alias("row"), "node", name("cn", "clone", "sid", "hap").alias("name"), F.lit(1.0).alias("coef"))
    a = _phased(i, "chr1", "coord1", "strand1", "chr2", "coord2", "strand2")
    ends = F.posexplode(F.array(*(position_id(f"chr{k}", f"coord{k}", f"strand{k}") for k in (1, 2)))).alias("side", "node")
    a = a.select("aid", "clone", "phasing", ends)
    a = a.select(name("node", "clone", "node", F.substring(F.col("phasing"), F.col("side") + 1, F.lit(1))).alias("row"), "node", name("acn", "clone", "aid", "phasing").alias("name"))
    a = a.groupBy("row", "node", "name").agg((-F.count("*")).cast("double").alias("coef"))
    t = i.telomeres.select(position_id("chr", "coord", "strand").alias("node")).distinct().withColumn("t", F.lit(True))
    rows = s.select("row", "node").distinct().join(t, "node", "left").select("row", F.when(F.col("t"), ">=").otherwise("=").alias("sense"), F.lit(0.0).alias("rhs"))
    return [(rows, s.select("row", "name", "coef").unionByName(a.select("row", "name", "coef")))]


def delta_rows(i: Inputs):
    """delta >= |copies - the input's copies, exchanged unless flipped|."""
    both = i.scnt.groupBy("sid", "clone").agg(*(F.coalesce(F.max(F.when(F.col("hap") == h, F.col("cn"))), F.lit(0)).alias(f"i{h}") for h in "AB")).join(i.segments.select("sid", "fid"), "sid")
    flip, out = name("flip", "fid"), []
    for h, o in (("A", "B"), ("B", "A")):
        d, cn = name("delta", "clone", "sid", F.lit(h)), name("cn", "clone", "sid", F.lit(h))
        turn = F.col(f"i{h}") - F.col(f"i{o}")
        out.append(_rows(both, name("over" + h, "clone", "sid"), ">=", -F.col(f"i{o}"), (d, 1), (cn, -1), (flip, turn), alone=True))
        out.append(_rows(both, name("under" + h, "clone", "sid"), ">=", F.col(f"i{o}"), (d, 1), (cn, 1), (flip, -turn), alone=True))
    return out


def objective(i: Inputs) -> DataFrame:
    rows = i.bounds.join(i.segments.select("sid", scaled_length(i.length).alias("w")), "sid")
    return rows.select(name("delta", "clone", "sid", "hap").alias("name"), F.col("w").cast("double").alias("coef"))


def model(i: Inputs) -> Model:
    parts = [*bound_rows(i), *product_rows(i), *labeling_rows(i), *overall_rows(i), *reciprocal_rows(i), *group_rows(i), *balance_rows(i), *delta_rows(i)]
    c, e = parts[0]
    for x, y in parts[1:]:
        c, e = c.unionByName(x), e.unionByName(y)
    return Model(variables(i), c, e, objective(i))


def lp_lines(m: Model) -> DataFrame:
    """``(section, k, n, value)``: the lines of the model in LP format, in this order. Variables and rows are numbered in order of
    their names, ``x1``, ... and ``c1``, ...; comments say which is which. A term has a line of its own."""
    spark = m.variables.sparkSession
    xs = cut(numbered(m.variables.groupBy("name").agg(F.max("kind").alias("kind"), F.max("lb").alias("lb"), F.min("ub").alias("ub")), "x", "name"), "lp-variables")
    cs = cut(numbered(m.constraints, "c", "row"), "lp-rows")
    number = lambda v: F.when(F.col(v) == F.floor(v), F.col(v).cast("long").cast("string")).otherwise(F.col(v).cast("string"))
    sign = F.when(F.col("coef") < 0, "-").otherwise("+")
    term = F.concat(F.lit("  "), sign, F.lit(" "), number("size"), F.lit(" x"), F.col("x").cast("string"))
    line = lambda rows, section, k, n, value: rows.select(F.lit(section).alias("section"), k.cast("long").alias("k"), n.cast("long").alias("n"), value.alias("value"))
    x, c, zero = F.col("x"), F.col("c"), F.lit(0)
    terms = lambda rows, *by: rows.groupBy(*by, "name").agg(F.sum("coef").alias("coef")).where("coef <> 0").join(xs.select("name", "x"), "name").withColumn("size", F.abs("coef"))
    own = terms(m.entries, "row").join(cs.select("row", "c"), "row")
    heads = spark.createDataFrame([(1, 0, 0, "Minimize"), (2, 0, 0, " obj:"), (4, 0, 0, "Subject To"), (6, 0, 0, "Bounds"), (8, 0, 0, "Generals"), (10, 0, 0, "End")], "section int, k long, n long, value string")
    bound = F.concat(F.lit(" "), F.coalesce(number("lb"), F.lit("-inf")), F.lit(" <= x"), x.cast("string"), F.lit(" <= "), F.coalesce(number("ub"), F.lit("+inf")))
    return (
        heads.unionAll(line(xs, 0, x, zero, F.concat(F.lit("\\ x"), x.cast("string"), F.lit(" "), "name")))
        .unionAll(line(terms(m.objective), 3, x, zero, term))
        .unionAll(line(cs, 5, c, F.lit(-1), F.concat(F.lit(" c"), c.cast("string"), F.lit(":"))))
        .unionAll(line(own, 5, c, x, term))
        .unionAll(line(cs, 5, c, F.lit((1 << 62)), F.concat(F.lit("  "), "sense", F.lit(" "), number("rhs"))))
        .unionAll(line(xs, 7, x, zero, bound))
        .unionAll(line(xs.where("kind <> 'C'"), 9, x, zero, F.concat(F.lit(" x"), x.cast("string"))))
    )


def write_lp(m: Model, path: str) -> None:
    """The lines in order in text files that follow one another, the head in the first."""
    lines = lp_lines(m)
    lines.repartitionByRange("section", "k", "n").sortWithinPartitions("section", "k", "n").select("value").write.text(path)


def solution(spark: SparkSession, path: str, numbered_names: DataFrame) -> DataFrame:
    """``(name, value)`` of a solver's text of lines ``x<k> value``; others are comments. Variables that it leaves out are 0."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^x\d+\s")).select(F.expr("cast(substring(split(trim(value), '\\\\s+')[0], 2) as long)").alias("x"), p[1].cast("double").alias("value"))
    return numbered_names.join(rows, "x", "left").select("name", F.coalesce("value", F.lit(0.0)).alias("value"))


def infeasible_rows(m: Model, rounds: int = 200, slack: float = 1e-6) -> DataFrame:
    """``row``: rows that bound propagation shows to have no common solution; none if it finds no conflict.

    Each round gives every row its least and greatest value within the variables' bounds, and every variable the bounds that its rows leave
    it, rounded for whole numbers; a conflict is a row out of reach or a variable of some row with crossed bounds. The rows named are those
    of the conflicts and those whose bounds led there, found backwards through the rounds. Without a conflict in ``rounds`` rounds none is named.
    """
    inf = float("inf")
    signs = m.constraints.select("row", F.explode(F.when(F.col("sense") == "=", F.array(F.lit(1.0), F.lit(-1.0))).when(F.col("sense") == "<=", F.array(F.lit(1.0))).otherwise(F.array(F.lit(-1.0)))).alias("s"), "rhs")
    # Every row as sum(w x) <= r, equations twice.
    terms = cut(m.entries.groupBy("row", "name").agg(F.sum("coef").alias("coef")).where("coef <> 0").join(signs, "row").select("row", "s", "name", (F.col("s") * F.col("coef")).alias("w"), (F.col("s") * F.col("rhs")).alias("r")), "terms")
    bare = signs.join(m.entries.select("row").distinct(), "row", "left_anti").where(F.col("s") * F.col("rhs") < -slack).select("row").distinct()
    # Bounds are followed only for variables that some row has: those of adjacencies may be far more, and no row rests on them.
    named = cut(terms.select("name").distinct(), "names")
    named = F.broadcast(named) if named.count() <= SENT else named
    kinds = m.variables.join(named, "name", "left_semi").groupBy("name").agg((F.max("kind") != "C").alias("whole"), F.coalesce(F.max("lb"), F.lit(-inf)).alias("lo"), F.coalesce(F.min("ub"), F.lit(inf)).alias("hi"))
    state, logs = cut(kinds, "bounds"), []
    for _ in range(rounds):
        used = F.when(F.col("w") > 0, F.col("lo")).otherwise(F.col("hi"))
        here = terms.join(state, "name").withColumn("open", F.abs(used) == inf).withColumn("least", F.when(F.col("open"), 0.0).otherwise(F.col("w") * used))
        sums = here.groupBy("row", "s").agg(F.sum("least").alias("sum"), F.sum(F.col("open").cast("int")).alias("free"), F.first("r").alias("r"))
        broken = cut(sums.where((F.col("free") == 0) & (F.col("sum") > F.col("r") + slack)).select("row", "s"), "broken")
        crossed = cut(state.where(F.col("lo") > F.col("hi") + slack).select("name"), "crossed")
        if not broken.isEmpty() or not crossed.isEmpty():
            return cut(_at_fault(terms, logs, broken, crossed).unionByName(bare).distinct(), "fault")
        room = here.join(sums.select("row", "s", "sum", "free"), ["row", "s"]).where((F.col("free") == 0) | ((F.col("free") == 1) & F.col("open")))
        left = (F.col("r") - F.col("sum") + F.col("least")) / F.col("w")
        room = room.withColumn("side", F.when(F.col("w") > 0, "hi").otherwise("lo")).withColumn("new", F.when(~F.col("whole"), left).when(F.col("w") > 0, F.floor(left + 1e-7).cast("double")).otherwise(F.ceil(left - 1e-7).cast("double")))
        tighter = room.where(F.when(F.col("w") > 0, F.col("new") < F.col("hi") - slack).otherwise(F.col("new") > F.col("lo") + slack))
        best = F.when(F.col("side") == "hi", F.col("new")).otherwise(-F.col("new"))
        log = cut(tighter.groupBy("name", "side").agg(F.min_by(F.struct("new", "row", "s"), F.struct(best, "row", "s")).alias("x")).select("name", "side", "x.new", "x.row", "x.s"), "tighter")
        if log.isEmpty():
            break
        logs.append(log)
        move = log.groupBy("name").agg(*(F.max(F.when(F.col("side") == k, F.col("new"))).alias(f"new_{k}") for k in ("lo", "hi")))
        state = cut(state.join(move, "name", "left").select("name", "whole", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_hi", "hi").alias("hi")), "bounds")
    return bare


def _at_fault(terms: DataFrame, logs: list[DataFrame], broken: DataFrame, crossed: DataFrame) -> DataFrame:
    """The conflicting rows and those that set the bounds they rest on, round by round backwards."""
    side = F.when(F.col("w") > 0, "lo").otherwise("hi")
    rests_on = lambda rows: terms.join(rows, ["row", "s"]).select("name", side.alias("side"))
    rows = broken.select("row")
    facts = rests_on(broken).unionByName(crossed.select("name", F.explode(F.array(F.lit("lo"), F.lit("hi"))).alias("side"))).distinct()
    for log in reversed(logs):
        set_here = cut(log.join(facts, ["name", "side"]).select("name", "side", "row", "s"), "set")
        rows = rows.unionByName(set_here.select("row"))
        # A row that bounds a variable rests on the bounds of its others.
        more = terms.join(set_here.select("row", "s", F.col("name").alias("of")), ["row", "s"]).where("name <> of").select("name", side.alias("side"))
        facts = cut(facts.join(set_here.select("name", "side"), ["name", "side"], "left_anti").unionByName(more).distinct(), "facts")
    return rows.distinct()


def solve_tiny(m: Model, most: int = 200_000) -> dict[str, float] | None:
    """An optimum of a small instance by depth-first search over whole numbers, None if there is no solution.

    For tests: variables without an upper bound reach TOP, and the search gives up beyond ``most`` nodes. Deltas
    take their least value.
    """
    import numpy as np

    v = {r["name"]: r for r in m.variables.collect()}
    rows: dict[str, tuple[str, float, dict[str, float]]] = {r["row"]: (r["sense"], r["rhs"], {}) for r in m.constraints.collect()}
    for r in m.entries.collect():
        own = rows[r["row"]][2]
        own[r["name"]] = own.get(r["name"], 0.0) + r["coef"]
    weight = {r["name"]: r["coef"] for r in m.objective.collect()}
    names = sorted(v, key=lambda n: (v[n]["kind"] == "C", v[n]["ub"] is None, n))
    lb = np.array([v[n]["lb"] for n in names], float)
    ub = np.array([TOP if v[n]["ub"] is None else v[n]["ub"] for n in names], float)
    at = {n: k for k, n in enumerate(names)}
    cons = []
    for sense, rhs, terms in rows.values():
        k = np.array([at[n] for n in terms], int)
        w = np.array(list(terms.values()), float)
        if sense in ("<=", "="):
            cons.append((k, w, rhs))
        if sense in (">=", "="):
            cons.append((k, -w, -rhs))
    of = [[] for _ in names]
    for c, (k, _, _) in enumerate(cons):
        for x in k:
            of[x].append(c)
    cost = np.array([weight.get(n, 0.0) for n in names])
    best: list = [np.inf, None]
    nodes = 0

    def tighten(lo, hi, todo) -> bool:
        """Each row's least value leaves room that bounds each of its variables."""
        todo = list(todo)
        while todo:
            k, w, rhs = cons[todo.pop()]
            least = np.where(w > 0, w * lo[k], w * hi[k])
            room = rhs - least.sum() + 1e-9
            if room < 0:
                return False
            for x, c, l in zip(k, w, least):
                if c > 0:
                    new = np.floor((room + l) / c + 1e-7)
                    if new < hi[x]:
                        hi[x] = new
                        todo += of[x]
                elif c < 0:
                    new = np.ceil((room + l) / c - 1e-7)
                    if new > lo[x]:
                        lo[x] = new
                        todo += of[x]
                if lo[x] > hi[x]:
                    return False
        return True

    def search(lo, hi) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > most:
            raise RuntimeError("too large for an exact search")
        if cost @ lo >= best[0]:
            return
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            best[:] = [float(cost @ lo), lo.copy()]
            return
        x = open_[0]
        for value in np.arange(lo[x], hi[x] + 1):
            a, b = lo.copy(), hi.copy()
            a[x] = b[x] = value
            if tighten(a, b, of[x]):
                search(a, b)

    if tighten(lb, ub, range(len(cons))):
        search(lb, ub)
    return None if best[1] is None else dict(zip(names, best[1].tolist()))


def solution_tensors(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sid, clone, hap, cn)`` and ``(aid, clone, phasing, cn)`` of a solution (name, value), rounded half to even."""
    p = F.split("name", r"\|")
    whole = F.bround("value", 0).cast("int").alias("cn")
    cn = values.where(F.col("name").startswith("cn|")).select(p[2].alias("sid"), p[1].alias("clone"), p[3].alias("hap"), whole)
    acn = values.where(F.col("name").startswith("acn|")).select(p[2].alias("aid"), p[1].alias("clone"), p[3].alias("phasing"), whole)
    return cn, acn


def synced(scnt: DataFrame, flips: DataFrame, segments: DataFrame) -> DataFrame:
    """Copies with the haplotypes exchanged where a fragment isn't flipped (fid, flip)."""
    rows = scnt.join(segments.select("sid", "fid"), "sid").join(flips, "fid")
    return rows.select("sid", "clone", F.when(F.col("flip") == 1, F.col("hap")).when(F.col("hap") == "A", "B").otherwise("A").alias("hap"), "cn")


def violations(m: Model, values: DataFrame, slack: float = 1e-6) -> DataFrame:
    """``(row, value, sense, rhs)`` of rows that a solution breaks."""
    sums = m.entries.join(values, "name", "left").groupBy("row").agg(F.sum(F.col("coef") * F.coalesce("value", F.lit(0.0))).alias("value"))
    rows = m.constraints.join(sums, "row", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    over, under = F.col("value") > F.col("rhs") + slack, F.col("value") < F.col("rhs") - slack
    broken = F.when(F.col("sense") == "<=", over).when(F.col("sense") == ">=", under).otherwise(over | under)
    return rows.where(broken).select("row", "value", "sense", "rhs")


def by_chromosome(adjacencies: DataFrame) -> DataFrame:
    """Adjacencies within a chromosome with ``part``, its name: the parts of a presolve, each a model of its own."""
    return adjacencies.where("chr1 = chr2").withColumn("part", F.col("chr1"))


def presolve_fp(fp: float, fraction: float) -> float:
    """What is left of the overall rate for a chromosome, once the share across chromosomes is taken off."""
    return max(0.0, fp - fraction)


def presolve_rates(i: Inputs) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """``(part, n, fp)`` of each chromosome's novel adjacencies, and the row of the rate for each: what the share of adjacencies across chromosomes leaves of it."""
    novel = i.adjacencies.where("at = 'N'")
    share = novel.agg(F.coalesce(F.avg((F.col("chr1") != F.col("chr2")).cast("int")), F.lit(0.0))).first()[0]
    inner = by_chromosome(novel)
    parts = inner.groupBy("part").agg(F.count("*").alias("n")).withColumn("fp", F.lit(presolve_fp(i.overall_fp, share)))
    rates = inner.select("aid", "part", _phasings(i).alias("phasing")).join(parts, "part")
    return parts, _rows(rates, name("fp", "part"), ">=", (1 - F.col("fp")) * F.col("n"), (name("overall", "aid", "phasing"), 1))


def presolved(i: Inputs) -> Model:
    """All chromosomes' models in one: adjacencies across chromosomes are left out, so no row has variables of two chromosomes, and the row of
    the overall rate is one for each chromosome."""
    own = replace(i, adjacencies=by_chromosome(i.adjacencies).drop("part"))
    made = [*bound_rows(own), *product_rows(own), *labeling_rows(own), *reciprocal_rows(own), *group_rows(own), *balance_rows(own), *delta_rows(own), presolve_rates(i)[1]]
    c, e = made[0]
    for x, y in made[1:]:
        c, e = c.unionByName(x), e.unionByName(y)
    return Model(variables(own), c, e, objective(own))


def start_vector(m: Model, solutions: DataFrame) -> DataFrame:
    """``(name, value)`` for every variable of the whole model: of the parts' solutions (name, value), rounded for whole numbers, else its lower bound."""
    rows = m.variables.groupBy("name").agg(F.max("kind").alias("kind"), F.coalesce(F.max("lb"), F.lit(0.0)).alias("lb")).join(solutions, "name", "left")
    return rows.select("name", F.coalesce(F.when(F.col("kind") == "C", F.col("value")).otherwise(F.bround("value", 0)), "lb").alias("value"))
