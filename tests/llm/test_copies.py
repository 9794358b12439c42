"""Near copies with contiguous edits, and crowded components."""
import numpy as np
import pyarrow as pa

from pixelloom.llm import simhash


def jaccard(a, b):
    a, b = (set(simhash._shingles(x.encode().split()).tolist()) for x in (a, b))
    return len(a & b) / len(a | b)


def planted():
    """Pairs of texts over 0.8 whose edit is a block: appended, put in front, or replaced."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000]
    for i in range(400):
        n = int(rng.integers(150, 900))
        w = words(n)
        cut = int(rng.integers(0, n - n // 11))
        copy = [w + words(n * 22 // 100), words(n * 15 // 100) + w, w[:cut] + words(n * 9 // 100) + w[cut + n * 9 // 100 :]][i % 3]
        a, b = " ".join(w), " ".join(copy)
        if jaccard(a, b) >= 0.8:
            yield a, b


def test_block_edits_are_found(spark):
    rows = [(10 * i + k, t) for i, pair in enumerate(planted()) for k, t in enumerate(pair)]
    assert len(rows) > 600
    groups = {r["doc_id"]: r["group_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert groups == {d: d // 10 * 10 for d, _ in rows}


def test_every_pair_of_a_crowded_component_is_compared(spark):
    """Texts over one set of words: blocks in another order, of which twins differ in one block of few words."""
    rng = np.random.default_rng(6)
    blocks = [[f"b{k}x{j}" for j in range(20)] for k in range(12)]
    rows = []
    for i in range(60):
        mixed = [list(rng.permutation(b)) if rng.random() < 0.25 else b for b in blocks]
        twin = [*mixed[:-1], list(rng.permutation(mixed[-1]))]
        rows += [(2 * i, " ".join(w for b in mixed for w in b)), (2 * i + 1, " ".join(w for b in twin for w in b))]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    got = {r["doc_id"]: r["group_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(group)) and 3 < len(set(group)) < len(rows)


def test_a_crowd_around_one_text_is_linked_by_its_middle():
    """Copies with an edit each are near the text that they come from, not each other: the hubs of the balls find it."""
    rng = np.random.default_rng(8)
    base = [f"w{int(x)}" for x in rng.integers(0, 9999, 54)]
    texts = [base]
    for _ in range(600):
        w = list(base)
        w[int(rng.integers(5, 49))] = f"x{int(rng.integers(0, 10**9))}"
        texts.append(w)
    sets = [set(simhash._shingles([x.encode() for x in t]).tolist()) for t in texts]
    prints = np.array([simhash._prints(np.array(sorted(s), np.uint64)) for s in sets])
    proved = set()
    for t in range(simhash.TABLES):
        f, first = np.unique(prints[:, t], return_index=True)
        for bucket in range(256):
            for a, b in simhash._forest(len(f), simhash._meetings(f, np.arange(len(f)), bucket, 8, 2, 48)).tolist():
                a, b = first[a], first[b]
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    proved |= {a, b}
    assert len(proved) > 0.95 * len({p.tobytes() for p in prints})


def test_rivals_are_given_once(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**48, (3, 12), np.uint64)
    rows = []
    for i in range(90):
        f = base[i % 3].copy()
        for t in range(12):
            f[t] ^= np.uint64(sum(1 << int(k) for k in rng.choice(48, int(rng.integers(0, 6)), replace=False)))
        rows.append((i * 7 - 300, i % 4, [int(x) for x in f]))
    df = spark.createDataFrame(rows, "th bigint, g bigint, fps array<bigint>").selectExpr("posexplode(fps) AS (t, fp)", "th", "g", "fps", "10L AS size", "array(5L) AS sk")
    got = [(r["a"], r["b"]) for r in simhash.rivals(df, 2, 48, 70, 0.8).collect()]
    far = lambda x, y: [bin(a ^ b).count("1") for a, b in zip(x, y)]
    want = {(min(x[0], y[0]), max(x[0], y[0])) for x in rows for y in rows if x[1] < y[1] and min(far(x[2], y[2])) <= 4 and sum(far(x[2], y[2])) <= 70}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_parities_rule_out_no_copy_and_most_others():
    """Sets of all sizes, of which some are compared across lengths of parities: none of 0.8 or more is ruled out, of those below 0.72 next to all are."""
    rng = np.random.default_rng(9)
    sets, pairs = [np.zeros(0, np.uint64)], []
    for i in range(600):
        n = int(np.exp(rng.uniform(0, 9)))
        a = rng.integers(0, 2**64, n, np.uint64)
        b = np.concatenate((a[int(n * rng.uniform(0, 0.3)) :], rng.integers(0, 2**64, int(n * rng.uniform(0, 0.25)), np.uint64)))
        pairs.append((len(sets), len(sets) + 1))
        sets += [np.unique(a), np.unique(b)]
    rows = pa.array([simhash.parities(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
    x, y = np.array(pairs).T
    got = simhash._Parities(rows, np.array([len(s) for s in sets]), 0.8).may_overlap(x, y)
    true = np.array([len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b]))) for a, b in pairs])
    large = np.array([len(sets[a]) > 50 for a in x])
    assert got[true >= 0.8].all() and (true >= 0.8).sum() > 100
    assert got[(true < 0.72) & large].mean() < 0.02 and ((true < 0.72) & large).sum() > 50


def test_copies_for_buckets_are_made_by_bytes():
    """Rows of 4 KB, each for 37 buckets: 300 MB in one piece before."""
    wide = pa.array([[i] * 512 for i in range(2000)], pa.list_(pa.int64()))
    b = pa.RecordBatch.from_arrays([pa.array([3] * 2000, pa.int32()), pa.array([i << 40 for i in range(2000)], pa.int64()), wide], names=["t", "fp", "sk"])
    made = list(simhash._spreader(8, 2, 48)([b, b.slice(0, 0)]))
    assert max(m.nbytes for m in made) <= 1.1 * simhash.SPREAD_BYTES
    rows = [r for m in made for r in zip(m.column("bucket").to_pylist(), m.column("fp").to_pylist(), m.column("sk").values.to_numpy()[m.column("sk").offsets.to_numpy()[:-1]].tolist())]
    tops = [0, *(1 << i for i in range(8)), *(1 << i | 1 << j for i in range(8) for j in range(i))]
    assert sorted(rows) == sorted((3 << 40 | (i ^ x), i << 40, i) for i in range(2000) for x in tops)


def test_a_crowd_has_a_few_candidate_pairs_a_text(spark, monkeypatch):
    """Copies of one text with two edits each: at no time are more pairs joined with the shingle sets than a text has fingerprints (before, 51 a text)."""
    rng = np.random.default_rng(12)
    base = [f"w{int(x)}" for x in rng.integers(0, 9999, 150)]
    texts = [base]
    for _ in range(400):
        w = list(base)
        for at in rng.integers(0, 145, 2):
            w[at : at + 3] = [f"x{int(x)}" for x in rng.integers(0, 10**9, 3)]
        texts.append(w)
    sizes, real = [], simhash.materialize

    def counted(df, name):
        out = real(df, name)
        if name in ("copies-candidates", "copies-rest"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    rows = [(d, " ".join(w)) for d, w in enumerate(texts)]
    groups = {r["doc_id"]: r["group_id"] for r in simhash.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert groups == dict.fromkeys(range(len(texts)), 0) and max(sizes) <= simhash.TABLES * len(texts)


def test_hubs_are_one_a_fingerprint_and_of_another_group(spark):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**48, (3, 2), np.uint64)
    rows = []
    for i in range(150):
        f = [int(x) ^ sum(1 << int(k) for k in rng.choice(48, int(rng.integers(0, 6)), replace=False)) for x in base[i % 3]]
        rows.append((i * 7 - 300, 0 if i % 3 == 0 and i < 120 else i % 5, f))
    by = {r[0]: r for r in rows}
    df = spark.createDataFrame(rows, "th bigint, g bigint, fps array<bigint>").selectExpr("posexplode(fps) AS (t, fp)", "th", "g", "fps")
    far = lambda x, y, t: bin(x[2][t] ^ y[2][t]).count("1")
    want = {(t, x[0]) for t in (0, 1) for x in rows for y in rows if x[1] != y[1] and far(x, y, t) <= 4}
    for marked in (df.drop("fps"), df):
        got = [(r["t"], r["th"], r["hub"]) for r in simhash.hubs(marked, 2, 48).collect()]
        assert len(got) == len(want) and {g[:2] for g in got} == want and len(want) > 100
        assert all(by[a][1] != by[b][1] and far(by[a], by[b], t) <= 4 for t, a, b in got)
    alone = {(t, r[2][t]) for t in (0, 1) for r in rows}
    got = [(r["t"], r["th"], r["hub"]) for r in simhash.hubs(df.select("t", "fp").distinct(), 2, 48).collect()]
    near = {(t, f) for t, f in alone for s, e in alone if s == t and e != f and bin(e ^ f).count("1") <= 4}
    assert {g[:2] for g in got} == near and len(got) == len(near) and all((t, h) in alone and 0 < bin(f ^ h).count("1") <= 4 for t, f, h in got)
