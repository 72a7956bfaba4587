"""SimHash, BK-trees, suffix arrays and fuzzy lines against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from lociflow.llm import suffix_array as S
from lociflow.llm.bktree import Forest, spanning_links
from lociflow.llm.fuzzy_lines import dedup_lines, edit_distance, normal, removed_lines
from lociflow.llm.near_dup import near_duplicates, simhash, simhash_components
from lociflow.llm.suffix_dedup import remove_repeats


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(pairs, radius=3):
    """pairs: (id, print)"""
    prints = sorted({p for _, p in pairs})
    comp = {p: p for p in prints}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                comp[root(a)] = root(b)
    low = {}
    for i, p in pairs:
        if i is not None:
            low[root(p)] = min(low.get(root(p), i), i)
    return sorted(((i, p, low.get(root(p))) for i, p in pairs), key=repr)


def test_trees_find_all_pairs_in_reach():
    draw = np.random.default_rng(0)
    p = np.unique(draw.integers(0, 1 << 14, 900).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    p = np.unique(np.concatenate([p, p[:200] ^ np.uint64(5), p[:90] ^ np.uint64(1 << 40)]))
    keys = np.arange(len(p)) % 3
    got = {(i, j) for a, b in Forest(keys, p).neighbours(3) for i, j in zip(a.tolist(), b.tolist())}
    far = np.bitwise_count(p[:, None] ^ p[None])
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(far <= 3))) if j < i and keys[i] == keys[j]}
    assert got == want
    a, _ = spanning_links(np.zeros(len(p), int), p, 64)
    assert len(a) == len(p) - 1


def test_simhash_components(spark, odd, some, empty):
    for docs in (odd, some):
        rows = docs.select("doc_id", "text").collect()
        pairs = [(r["doc_id"], brute_print(r["text"])) for r in rows]
        got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_components(docs).collect()), key=repr)
        assert got == brute_components(pairs)
    assert simhash_components(empty).count() == 0
    assert simhash([], 3) == 0


def test_near_duplicates_leave_one_of_a_group(spark, odd, empty):
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_duplicates(odd).collect())
    ids = [i for null, i in kept if not null]
    assert 1 in ids and 2 not in ids and len(ids) == len(set(ids)) and {6, 7, 8} <= set(ids)
    assert len({3, 4, 5} & set(ids)) == 1  # texts without words are one group
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_by_shared_shingles(spark):
    base = [f"w{k}" for k in range(300)]
    near = base.copy()
    near[10], near[200] = "x", "y"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:150])), (4, " ".join(f"z{k}" for k in range(300)))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


@pytest.mark.parametrize("few", [1, 1024])
def test_suffix_arrays(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    draw = np.random.default_rng(1)
    for _ in range(150):
        t = draw.integers(0, draw.integers(1, 5), draw.integers(0, 50))
        assert S.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_common_prefixes():
    t = np.frombuffer(b"abcabcabcxabcabcabcy" * 2, np.uint8)
    sa = S.suffix_array(t)
    for n, lane in ((3, 512), (9, 7), (12, 512), (12, 3)):
        S.LANE = lane
        got = S.repeats_before(t, sa, n)
        raw = t.tobytes()
        for r, i in enumerate(sa.tolist()):
            same = r > 0 and len(raw) - i >= n and raw[i : i + n] == raw[sa[r - 1] : sa[r - 1] + n]
            assert got[i] == same


def brute_removed(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            key = float("inf") if i is None else i
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (float("inf") if i is None else i):
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_are_removed(spark, odd, some, empty):
    for docs in (odd, some):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        want = brute_removed(rows)
        assert sorted(map(tuple, remove_repeats(docs, digest=True).collect()), key=repr) == want
        assert sorted(map(tuple, remove_repeats(docs, digest=True, hot=1).collect()), key=repr) == want
    assert remove_repeats(empty).count() == 0


def test_long_texts_are_cut_and_still_compared(spark):
    from lociflow.llm import suffix_dedup as D

    draw = np.random.default_rng(4)
    long = bytes(draw.integers(97, 100, D.SLICE + 5000).astype(np.uint8)).decode()
    rows = [(1, long), (2, "xy" + long[1000:]), (3, "z" * 200 + long[D.SLICE - 60 : D.SLICE + 60])]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got == {1: 0, 2: len(long) - 1000, 3: 120}


def brute_lines(rows):
    from lociflow.llm.fuzzy_lines import Prints, similar

    found = []
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        found += [(i, t, n, x) for n, line in enumerate((t or "").split("\n")) if (x := normal(line))]
    texts = sorted({x for *_, x in found})
    prints = dict(zip(texts, Prints()(texts).tolist()))
    comp = {x: x for x in texts}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and similar(a, b, 0.8):
                comp[root(a)] = root(b)
    kept, gone = set(), {}
    for i, t, n, x in found:
        if root(x) in kept:
            gone[(i, t)] = gone.get((i, t), 0) + 1
        kept.add(root(x))
    return sorted(((i, gone.get((i, t), 0)) for i, t in rows), key=repr)


def test_fuzzy_lines(spark, odd, some, empty):
    for docs in (odd, some):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, dedup_lines(docs).select("doc_id", "n_removed").collect()), key=repr) == brute_lines(rows)
    assert dedup_lines(empty).count() == 0
    assert edit_distance("kitten", "sitting") == 3 and edit_distance("", "ab") == 2


def test_fuzzy_lines_by_edit_similarity_alone(spark, odd, some, sf):
    from lociflow.llm.fuzzy_lines import op8, similar

    for docs in (odd, some):
        rows = [tuple(r) for r in docs.select("doc_id", "text").distinct().collect()]
        found = [(i, t, x) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for line in (t or "").split("\n") if (x := normal(line))]
        texts = sorted({x for *_, x in found}, key=len)
        comp = {x: x for x in texts}

        def root(x):
            while comp[x] != x:
                x = comp[x]
            return x

        for k, a in enumerate(texts):
            for b in texts[k + 1 :]:
                if 4 * len(b) > 5 * len(a):
                    break
                if sum(abs(a.count(c) - b.count(c)) for c in "aeinrst") <= 0.4 * len(b) and similar(a, b, 0.8):
                    comp[root(a)] = root(b)
        kept, gone = set(), {}
        for i, t, x in found:
            gone[(i, t)] = gone.get((i, t), 0) + (root(x) in kept)
            kept.add(root(x))
        got = {(r["doc_id"], r["n_removed"]) for r in dedup_lines(docs, radius=None).collect()}
        assert got == {(i, gone.get((i, t), 0)) for i, t in rows}
    edited = spark.createDataFrame([(1, "one small line about nothing"), (2, "one large line about nothing")], "doc_id long, text string")
    assert sum(r["n_removed"] for r in dedup_lines(edited, radius=None).collect()) == 1
    assert sum(r["n_removed"] for r in op8(spark, sf).collect()) == sum(r["n_removed"] for r in dedup_lines(some, radius=None).collect())


def test_near_duplicates_just_over_the_similarity(spark):
    from lociflow.llm.text import shingle_hashes

    draw, rows = np.random.default_rng(8), []
    while len(rows) < 160:
        a = [b"w%d" % x for x in draw.integers(0, 10**6, 300)]
        b = a.copy()
        for j in draw.choice(300, 7, replace=False):
            b[j] = b"v%d" % draw.integers(10**6)
        x, y = (set(shingle_hashes(t, 5).tolist()) for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.82:
            rows += [(len(rows) + k, b" ".join(t).decode()) for k, t in enumerate((a, b))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r["doc_id"] % 2 for r in out.collect()) <= 2


def test_near_duplicates_count_a_shingle_once(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words[40:60] * 60))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in out.collect()] == [1]


def test_near_duplicates_verify_equal_prints(spark, monkeypatch):
    from lociflow.llm import near_dup

    # Unlike texts with equal prints, whatever they are made from.
    monkeypatch.setattr(near_dup, "majorities", lambda hashes, words64: np.full((len(hashes), words64), 7, np.uint64))
    line = [f"r{k}" for k in range(21)] * 100
    rows = [(i, " ".join(line + [f"u{i}x{k}" for k in range(60)])) for i in range(4)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3]


def test_near_duplicates_of_a_family_just_under_the_similarity(spark):
    """Each of 40 texts has a copy with one word replaced, and all are variants of one text that share less than 0.8."""
    draw, base, rows = np.random.default_rng(5), [f"w{k}" for k in range(400)], []
    for n in range(40):
        own = base.copy()
        for j in draw.choice(400, 9, replace=False):
            own[j] = f"v{n}x{j}"
        copy = own.copy()
        copy[200] = f"c{n}"
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(copy))]
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    assert 25 < len({root(i) for i in sets}) <= 40
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({root(i) for i in sets})


def test_near_duplicates_shuffle_few_texts(spark):
    """Texts that nothing is near to aren't shuffled, also where no table is small enough to be broadcast unasked."""
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in draw.integers(0, 10**6, 2000))) for i in range(300)]
    rows.append((300, rows[0][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    store, before = spark._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def sent():
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = sent()
        assert sorted(r["doc_id"] for r in near_duplicates(docs).select("doc_id").collect()) == list(range(300))
        assert sent() - start < sum(len(t) for _, t in rows) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_normal_lines():
    import re

    from lociflow.llm.fuzzy_lines import normal_lines

    other = re.compile(r"(?:[^\w\n]|_)+")
    draw = np.random.default_rng(2)
    odd = ["\n", " ", "_", "a", "Z", "é", "İ", "Σ", "\ud800", "𝔸", "😀", "½", "中", "\r", "\x1c", "٣", "9", ".", "\u0301", "\0"]
    for n in range(2000):
        text = "".join(odd[k] for k in draw.integers(0, len(odd), n % 25))
        assert normal_lines(text) == [x.strip(" ") for x in other.sub(" ", text.lower()).split("\n")]


def test_fuzzy_lines_move_a_text_once(spark, monkeypatch):
    """Before candidates are looked for, a text is moved with its group, and not once more to be joined to it."""
    from lociflow.llm import fuzzy_lines

    monkeypatch.setattr(fuzzy_lines, "similar_links", lambda lines, least: spark.createDataFrame([], "a long, b long"))
    draw = np.random.default_rng(7)
    rows = [(i, draw.integers(97, 123, 4000).astype(np.uint8).tobytes().decode()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    store, before = spark._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def sent():
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = sent()
        assert removed_lines(docs, radius=None).count() == 0
        assert sent() - start < 1.6 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_majorities():
    from lociflow.llm import near_dup

    draw, step = np.random.default_rng(6), near_dup._AT_ONCE
    try:
        for near_dup._AT_ONCE in (step, 300):
            hashes = [draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(n % 2) for n in (0, 1, 2, 255, 256, 1000, 0, 3)]
            got = near_dup.majorities(hashes, 3)
            want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h)) for h in hashes]
            assert got[:, 0].tolist() == want and len(set(got[3].tolist())) == 3
    finally:
        near_dup._AT_ONCE = step


def test_sampled_keys_are_a_short_expression(spark):
    """The driver keeps every query's plan; keys bit by bit made one of half a megabyte."""
    from pyspark.sql import functions as F

    from lociflow.llm.near_dup import SAMPLED, sampled_keys

    draw = np.random.default_rng(3)
    a = draw.integers(0, 1 << 63, 500).astype(np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in draw.choice(64, SAMPLED, replace=False)) for _ in a], np.uint64)
    prints = spark.createDataFrame([tuple(x) for x in np.stack([a, b], 1).view(np.int64).tolist()], "a long, b long")
    keys = lambda c: sampled_keys(F.col(c), 250_000, SAMPLED)
    both = prints.select(F.size(F.array_intersect(keys("a"), keys("b"))).alias("n"), F.size(keys("a")).alias("all"))
    assert len(both._jdf.queryExecution().toString()) < 100_000
    rows = both.collect()
    assert sum(r["n"] > 0 for r in rows) >= 480 and sum(r["n"] for r in rows) < 0.2 * sum(r["all"] for r in rows)


def test_many_pairs_of_lines_are_compared_at_once(monkeypatch):
    """Equal to one comparison after another, which only few pairs of a kind have."""
    from lociflow.llm import fuzzy_lines as L

    draw, lines = np.random.default_rng(3), []
    letters = list("abcdefgh éü漢𝔸 ")
    for n in (1, 2, 5, 20, 63, 64, 65, 128, 129, 300) * 60:
        own = [letters[k] for k in draw.integers(0, len(letters), n)]
        lines.append("".join(own))
        for _ in range(int(draw.integers(0, 1 + n // 3))):
            k = int(draw.integers(0, max(1, len(own))))
            own[k : k + int(draw.integers(0, 2))] = letters[int(draw.integers(0, len(letters)))] * int(draw.integers(0, 2))
        lines.append("".join(own))
    x, y = np.arange(0, len(lines), 2), np.arange(1, len(lines), 2)
    x, y = np.concatenate([x, draw.permutation(x), draw.permutation(y)]), np.concatenate([y, x, y])
    expected, one = [L.similar(lines[i], lines[j], 0.8) for i, j in zip(x.tolist(), y.tolist())], L.edit_distance
    calls = []
    monkeypatch.setattr(L, "edit_distance", lambda *a: calls.append(a) or one(*a))
    assert L.Lines(lines).similar(x, y, 0.8).tolist() == expected and 0.1 < np.mean(expected) < 0.9
    assert len(calls) < len(x) / 4
    # Sets are those that all pairs connect.
    group, own = draw.integers(0, 40, 2000), draw.integers(0, len(lines), 2000)
    label = L._join_similar(lines, np.zeros(len(lines), np.uint64), group, own, 0.8)
    comp = list(range(len(lines)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for g in range(40):
        some = sorted(set(own[group == g].tolist()))
        for i in some:
            for j in some:
                if i < j and L.similar(lines[i], lines[j], 0.8):
                    comp[root(i)] = root(j)
    assert len({(root(k), int(label[k])) for k in range(len(lines))}) == len(set(label.tolist())) == len({root(k) for k in range(len(lines))})
