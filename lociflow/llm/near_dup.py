"""SimHash near-duplicates found with BK-trees.

Fingerprints are sharded before the trees are built: two prints within radius 3 agree in whole blocks of
bits (pigeonhole), so each print goes to one shard key per choice of blocks, and a tree stands over each
key. A tree of all prints, broadcast, would put the fingerprints of all documents through the driver and
would have no size bound; here a shard's trees are built and searched where the shard's prints are.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.bktree import Forest, Sets, spanning_links
from lociflow.llm.encoding import portions
from lociflow.llm.text import ascii_words, shingle_hashes
from lociflow.operators.components import connected_components
from lociflow.shared import BATCH_ROWS, cut, discard, ensure_importable, folder_of

BITS = 64
#: Prints for each key value that a pigeonhole scheme may have before a finer one is taken.
PER_KEY = 64


#: Bytes n as eight lanes of one bit each, so that up to 255 of them can be added up.
_LANES = np.array([sum((n >> k & 1) << 8 * k for k in range(8)) for n in range(256)], np.uint64)
#: Hashes whose bits are added up at a time.
_AT_ONCE = 1 << 15


def majorities(hashes: list[np.ndarray], words64: int = 1) -> np.ndarray:
    """For each array of hashes ``words64`` 64-bit words: a bit is 1 if it is set in over half the hashes. Further words are
    made from the same hashes, each hashed once again. No hashes: 0."""
    out = np.zeros((len(hashes), words64), np.uint64)
    some = [i for i, h in enumerate(hashes) if len(h)]
    size = np.array([len(hashes[i]) for i in some], np.int64)
    # Lanes hold 255, so longer arrays are added up in parts.
    parts = -(-size // 255)
    owner = np.repeat(np.arange(len(some)), parts)
    piece = 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) + np.repeat(np.cumsum(size) - size, parts)
    h = np.concatenate([hashes[i] for i in some]) if some else np.empty(0, np.uint64)
    ends, first = np.append(piece[1:], len(h)), np.cumsum(parts) - parts
    for n in range(words64 if some else 0):
        ones = np.empty((len(piece), 64), np.uint8)
        b = 0
        while b < len(piece):
            e = max(b + 1, int(np.searchsorted(ends, piece[b] + _AT_ONCE, "right")))
            own = np.ascontiguousarray(h[piece[b] : ends[e - 1]].astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)
            ones[b:e] = np.add.reduceat(_LANES[own], piece[b:e] - piece[b], axis=0).astype("<u8").view(np.uint8).reshape(-1, 64)
            b = e
        whole = np.add.reduceat(ones, first, axis=0, dtype=np.int32) if len(first) < len(piece) else ones.astype(np.int32)
        out[some, n] = np.packbits(2 * whole > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return out


def simhash(words: list[bytes], k: int) -> int:
    """64 bits; a bit is 1 if it is set in over half the hashes of the ``k``-word shingles. No words: 0."""
    return int(majorities([shingle_hashes(words, k)])[0, 0])


def distinct_shingles(words: list[bytes], k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, k))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long."""
    ensure_importable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts, prints = batch.column(1).to_pylist(), [np.empty(0, np.uint64)]
            for b, e in portions(texts):
                prints.append(majorities([shingle_hashes(ascii_words(x), k) for x in texts[b:e]])[:, 0])
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _blocks(count: int, radius: int, bits: int) -> tuple[int, list[int]]:
    m = 1
    while count > PER_KEY << (bits * m // (radius + m)) and m < 4:
        m += 1
    return m, [bits * i // (radius + m) for i in range(radius + m + 1)]


def pigeonhole_masks(count: int, radius: int, bits: int = BITS) -> list[int]:
    """The bits that each of the keys of ``pigeonhole`` holds, in the keys' order."""
    m, edges = _blocks(count, radius, bits)
    one = [((1 << edges[b + 1]) - (1 << edges[b])) for b in range(radius + m)]
    return [sum(one[b] for b in blocks) for blocks in combinations(range(radius + m), m)]


def pigeonhole(fp: Column, count: int, radius: int, bits: int = BITS) -> Column:
    """Array of keys; two prints within the radius have one in common, whatever the count.

    The bits are cut into ``radius + m`` blocks, of which ``m`` must agree. The count of distinct prints
    only sets ``m``: more prints, longer keys, so the members of a key stay few.
    """
    m, edges = _blocks(count, radius, bits)
    keys = []
    for which, blocks in enumerate(combinations(range(radius + m), m)):
        key = F.lit(which)
        for b in blocks:
            width = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key.cast("long"), width).bitwiseOR(part)
        keys.append(key.cast("long"))
    return F.array(*keys)


def print_links(prints: DataFrame, count: int, radius: int) -> DataFrame:
    """``(a, b)``: links between distinct prints that connect just what all pairs within the radius connect."""
    spark = prints.sparkSession
    keyed = prints.select("fp", F.explode(pigeonhole(F.col("fp"), count, radius)).alias("key"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 250_000)

    def run(batches):
        found = [(b.column(1).to_numpy(), b.column(0).to_numpy()) for b in batches]
        if found:
            keys, own = (np.concatenate(x) for x in zip(*found))
            a, b = spanning_links(keys, own.view(np.uint64), radius)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keyed.repartition(shards, "key").mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)`` for each row of ``docs``.

    Rows whose prints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id
    reachable. A null or empty text, or one without words, has print 0 and is linked like any other. Rows
    that repeat an id keep their own prints. A row with a null id keeps it and links what it lies between;
    a component without any id has a null ``component_id``. An empty table gives an empty one, and further
    columns of ``docs`` play no part, whatever their names.

    Copies meet in one print first (a combined aggregate), so a group of copies of any size is one node.
    """
    prints = cut(with_fingerprints(docs, id_col, text_col, k), "prints")
    groups = cut(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "print-groups", prints.count())
    found = connected_components(print_links(groups, groups.count(), radius))
    tied = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("comp"))
    lows = tied.where("comp <> fp").select("comp").distinct()
    # Only prints with several rows or with links need a look-up; any other row is its own component.
    several = tied.join(lows, "comp", "left_semi").unionByName(tied.where("n > 1").join(lows, "comp", "left_anti"), allowMissingColumns=True)
    names = several.groupBy("comp").agg(F.min("low").alias("component_id"))
    look = several.select("fp", "comp").join(names, "comp").select("fp", "component_id", F.lit(True).alias("known"))
    return prints.join(look, "fp", "left").select(
        F.col("id").alias(id_col), "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def sampled_keys(fp: Column, count: int, radius: int, miss: float = 0.01, bits: int = BITS) -> Column:
    """Array of keys of some sampled bits each; two prints at the radius have none in common with probability ``miss``.

    For radii at which whole blocks would be too short to tell prints apart. More prints, more bits a key.
    """
    width = max(8, int(np.ceil(np.log2(max(count, 1) / 64))))
    tables = int(np.ceil(np.log(miss) / np.log1p(-((1 - radius / bits) ** width))))
    draw = np.random.Generator(np.random.PCG64(5))
    masks = np.array([sum(1 << b for b in draw.choice(bits, width, replace=False).tolist()) for _ in range(tables)], np.uint64)
    # One short expression: an operation for each bit of each key made half a megabyte of plan text, which the driver keeps for every query.
    return F.transform(F.lit(masks.view(np.int64)), lambda mask, which: F.xxhash64(which, fp.bitwiseAND(mask)))


#: What keys are sampled for; how far loose links reach in 64 and in 128 bits; 64-bit words of a wide print, and how
#: far links reach in it. Texts that share 0.8 of their shingles differ in 0.15 of the bits: in 19 of 128 (deviation
#: 4) and 78 of 512 (deviation 8); unlike texts in 64 and 256. REACH lies almost 4 deviations above, so that the shingles decide.
SAMPLED, LOOSE, LOOSE_WHOLE, WIDE, REACH = 12, 18, 32, 8, 108
#: How far links reach in families that are searched again: two deviations above, as those of variants just under the
#: similarity are very many.
AGAIN = 94
#: Columns of a link: its nodes, their prints and their labels.
_LINK = ("node", "lead", "fp", "lead_fp", "label", "lead_label")


def _loose_links(groups: DataFrame, count: int) -> DataFrame:
    keyed = groups.select("node", "fp", "fp2", F.explode(sampled_keys(F.col("fp"), count, SAMPLED)).alias("key"))
    shards = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 50_000)

    def run(batches):
        found = [tuple(b.column(k).to_numpy() for k in range(4)) for b in batches]
        if found:
            node, fp, fp2, keys = (np.concatenate(x) for x in zip(*found))
            a, b = spanning_links(keys, fp.view(np.uint64), LOOSE, node, fp2.view(np.uint64), LOOSE_WHOLE)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return keyed.repartition(shards, "key").mapInArrow(run, "a long, b long").distinct()


def _wide_links(members: DataFrame, failed: DataFrame | None, count: int, forests: int, reach: int) -> DataFrame:
    """``(node, lead, fp, lead_fp, label, lead_label)``: links within ``reach`` of wide prints between nodes of different ``label``,
    the nearest pairs of a key first.

    Within a key the first forest takes a pair whose ends it doesn't connect yet, else the second does, and so on; a
    pair that all ``forests`` connect is left out, and so is one of ``failed`` (node, lead, key).
    """
    keyed = members.select("node", "fp", "wide", "label", F.lit(None).cast("long").alias("lead"), F.explode(sampled_keys(F.col("fp"), count, SAMPLED)).alias("key"))
    if failed is not None:
        none = lambda kind: F.lit(None).cast(kind)
        keyed = keyed.unionByName(failed.select("node", none("long").alias("fp"), none("binary").alias("wide"), none("long").alias("label"), "lead", "key"))
    shards = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 20_000)

    def run(batches):
        found, failed = [], set()
        for b in batches:
            told = b.filter(pc.is_valid(b.column("lead")))
            failed.update(zip(told.column("node").to_pylist(), told.column("lead").to_pylist()))
            b = b.filter(pc.is_null(b.column("lead")))
            found.append((*(b.column(x).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for x in ("node", "fp", "label", "key")), b"".join(b.column("wide").to_pylist())))
        if not found:
            return
        node, fp, label, keys = (np.concatenate([f[k] for f in found]) for k in range(4))
        wide = np.frombuffer(b"".join(f[4] for f in found), "<u8").reshape(-1, WIDE)
        names = node.tolist()
        order = np.lexsort((label, keys))
        again = np.flatnonzero((keys[order][1:] == keys[order][:-1]) & (label[order][1:] == label[order][:-1])) + 1
        base, links = Sets(len(node)), []
        for x, y in zip(order[again].tolist(), order[again - 1].tolist()):
            base.join(x, y)  # what hangs together already does so in every forest
        sets = [base.copy()]
        _, tree, size = np.unique(keys, return_inverse=True, return_counts=True)
        some = np.flatnonzero(size[tree] > 1)
        for i, j in Forest(keys[some], fp[some].view(np.uint64)).neighbours(LOOSE) if len(some) else ():
            i, j = some[i], some[j]
            far = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
            far[label[i] == label[j]] = reach + 1
            order = np.argsort(far, kind="stable")[: int((far <= reach).sum())]
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if names[x] < names[y]:
                    x, y = y, x
                if (names[x], names[y]) in failed:
                    continue
                if not any(s.join(x, y) for s in sets):
                    if len(sets) == forests:
                        continue
                    sets.append(base.copy())
                    sets[-1].join(x, y)
                links.append((x, y))
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.record_batch([pa.array(x) for x in (node[a], node[b], fp[a], fp[b], label[a], label[b])], [*_LINK])

    return keyed.repartition(shards, "key").mapInArrow(run, ", ".join(f"{x} long" for x in _LINK)).distinct()


def _verified(pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """``pairs`` with ``held`` in place of ``text`` and ``lead_text``: whether the texts' sets of shingles have that Jaccard similarity."""
    kept = [x for x in pairs.columns if x not in ("text", "lead_text")]
    kinds = ", ".join(f"{x} {pairs.schema[x].dataType.simpleString()}" for x in kept)

    def run(batches):
        set_of = lru_cache(64)(lambda text: distinct_shingles(ascii_words(text), k))
        for batch in batches:
            held = []
            for a, b in zip(batch.column("text"), batch.column("lead_text")):  # texts one at a time: a batch may hold many long ones
                x, y = set_of(a.as_py()), set_of(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                held.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.record_batch([*(batch.column(x) for x in kept), pa.array(held, pa.bool_())], [*kept, "held"])

    return pairs.mapInArrow(run, f"{kinds}, held boolean")


#: Bits of a sieve for each key in it, and at most: a sieve of more keys lets more rows through, and is no larger.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 24


def marked(rows: DataFrame, wanted: DataFrame, *cols: str) -> DataFrame:
    """``rows`` with ``__maybe``: true for each one whose ``cols`` are those of a row of ``wanted``, and for few others.

    Hashes of ``wanted`` set bits of a table of at most SIEVE_MOST bits, which is broadcast, so wide rows that nothing is looked up for needn't be
    shuffled; a join of those that are true decides."""
    bits = 1 << 12
    count = wanted.count()
    while bits < SIEVE_MOST and bits < SIEVE_BITS * count:
        bits *= 2
    slot = F.pmod(F.xxhash64(*cols), F.lit(bits))
    told = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("__bits"))
    told = cut(told, "sieve", bits // 64)
    out = rows.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(told), "__word", "left")  # a bounded table
    return out.withColumn("__maybe", F.expr("coalesce(getbit(__bits, int(__slot & 63)) = 1, false)")).select(*rows.columns, "__maybe")


def _families(members: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """``(node, label)`` of all ``members``: nodes have a label in common if links of ``similarity`` connect them, of all pairs
    under a common key and within REACH (AGAIN if a link that fails hides them).

    A link that doesn't hold may have kept another pair of the same sets from being looked at. So the families that
    one lies between are searched again, for links between them other than those that failed, with more forests each
    time, until none lies between two families or no pair is left. Links that failed in earlier rounds hide nothing, as
    they weren't taken again; they are kept with the keys that both of their ends have.
    """
    nodes = lambda df, *cols: reduce(DataFrame.unionByName, [df.select(F.col(c).alias("node")) for c in cols]).distinct()
    labels = members.select("node", F.col("node").alias("label"))
    count, now, failed, forests = max(1, members.count()), members.withColumn("label", F.col("node")), None, 1
    spark = members.sparkSession
    while True:
        links = cut(_wide_links(now, failed, count, forests, REACH if forests == 1 else AGAIN), "wide-links")
        if links.isEmpty():
            return labels
        # One text for each print that has a link, its document's with the smallest id.
        linked = cut(now.select("node", "id", "tie").join(nodes(links, "node", "lead"), "node"), "linked", count)
        some = texts if forests > 1 else marked(texts, linked, "id", "tie").where("__maybe")
        held = cut(some.join(linked, ["id", "tie"]).groupBy("node").agg(F.min("text").alias("text")), "linked-texts")
        pairs = links.join(held, "node").join(held.select(F.col("node").alias("lead"), F.col("text").alias("lead_text")), "lead")
        rows = spark.conf.get(BATCH_ROWS)
        spark.conf.set(BATCH_ROWS, "64")  # a row has two texts, which may be long
        try:
            new = cut(_verified(pairs, k, similarity), "verified")
        finally:
            spark.conf.set(BATCH_ROWS, rows)
        discard(spark, folder_of(held), folder_of(links), folder_of(linked))
        joined = connected_components(new.where("held"), "label", "lead_label").select(F.col("node").alias("label"), "component")
        labels = cut(labels.join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("label")), "families", count)
        ends = new.where("not held").join(joined, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
        ends = ends.join(joined.withColumnRenamed("label", "lead_label"), "lead_label", "left").withColumn("lead_label", F.coalesce("component", "lead_label"))
        ends = cut(ends.where("label <> lead_label").select(*_LINK), "failed-links", count)
        now = cut(members.join(labels.join(nodes(ends, "label", "lead_label").withColumnRenamed("node", "label"), "label", "left_semi"), "node"), "searched-again", count)
        if now.isEmpty():
            return labels
        own, others = (sampled_keys(F.col(x), count, SAMPLED) for x in ("fp", "lead_fp"))
        without = cut(ends.select("node", "lead", F.explode(F.array_intersect(own, others)).alias("key")), "failed-keys", 8 * count)
        failed = without if failed is None else failed.unionByName(without)
        if forests == 1:
            wanted = now.select("id", "tie").distinct()
            texts = cut(marked(texts, wanted, "id", "tie").where("__maybe").drop("__maybe").join(wanted, ["id", "tie"], "left_semi"), "family-texts")
        forests *= 4


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id.

    Prints that lie loosely near another in 128 bits are linked where their wide prints (512 bits) are near; a link
    holds if the texts share ``similarity`` of their sets of ``k``-word shingles, and groups are what links that hold
    connect. Links are found under keys of sampled bits, the nearest first; families with one that doesn't hold are
    searched again until nothing changes. Texts with equal sets of shingles are one group, those with equal prints only
    if they share enough; all texts without words have print 0 and are one group. A null id counts as the largest. Rows
    that repeat an id stay if it is the smallest of any group; of those with equal texts one stays. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))

    def run(batches):
        for batch in batches:
            texts, sets, own = batch.column(1).to_pylist(), [], [np.empty((0, WIDE), np.uint64)]
            for b, e in portions(texts):
                shingles = [distinct_shingles(ascii_words(x), k) for x in texts[b:e]]
                own.append(majorities(shingles, WIDE))
                sets += [xxhash.xxh128_digest(x.astype("<u8").tobytes()) for x in shingles]
            own = np.concatenate(own).astype("<u8")
            one, two = (own[:, n].astype(np.uint64).view(np.int64) for n in (0, 1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(one), pa.array(two), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(sets, pa.binary())], ["id", "tie", "fp", "fp2", "wide", "shingles"])

    texts = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"))
    prints = cut(texts.mapInArrow(run, "id long, tie long, fp long, fp2 long, wide binary, shingles binary"), "pair-prints")
    groups = prints.groupBy("fp", "fp2", "shingles").agg(F.min(F.struct("id", "tie")).alias("first"), F.min("wide").alias("wide"))
    groups = cut(groups.select("fp", "fp2", "wide", "first.id", "first.tie", F.monotonically_increasing_id().alias("node")), "pair-groups", prints.count())
    left = cut(_loose_links(groups, groups.count()), "loose-links")  # read twice: which links span a set isn't settled
    near = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    members = cut(groups.join(near, "node"), "loose")
    discard(spark, folder_of(left))
    tied = groups.select("node", "id").join(_families(members, texts, k, similarity), "node")
    first = tied.groupBy("label").agg(F.min(F.struct("id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    gone = tied.select("node").join(first, "node", "left_anti")
    stays = groups.select("node", "id").join(gone, "node", "left_anti").select(F.col("id").alias("__low"))
    stays = cut(stays.distinct(), "stays", prints.count())
    # Rows that aren't marked stay; the few others are looked up.
    gone = cut(prints.select(F.col("id").alias("__key")).distinct().join(stays, F.col("__key") == F.col("__low"), "left_anti"), "gone")
    rows = marked(docs.withColumn("__key", key), gone, "__key")
    out = rows.where("not __maybe").unionByName(rows.where("__maybe").join(stays, F.col("__key") == F.col("__low"), "left_semi")).drop("__maybe")
    repeated = prints.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return out.drop("__key")
    return out.dropDuplicates(["__key", text_col]).drop("__key")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")
