import random

from pixelloom.llm import substring

from . import brute


def run(spark, rows, window=13, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = substring.remove_repeats(docs, window, **more)
    return sorted([tuple(r)[:4] for r in out.collect()], key=str)


def test_planted_passages(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 30, 200)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += [word() + str(rng.randrange(50)) for _ in range(rng.randrange(0, 30))] + rng.choice(passages)[rng.randrange(3) :]
        rows.append((d * 10**11 * (-1) ** d, " ".join(w) if d % 3 else "\t " + "\n".join(w) + " "))
    for window in (2, 13, 50):
        assert run(spark, rows, window) == sorted(brute.substring(rows, window), key=str)


def test_common_passages_over_many_slices(spark, monkeypatch):
    """Passages of nearly all documents, within a slice and over slices, in texts that repeat words."""
    rng = random.Random(2)
    passages = [" ".join(rng.choice("abc") + str(rng.randrange(20)) for _ in range(n)) for n in (13, 20, 40)]
    rows = [(rng.randrange(10**6), " ".join(rng.choice([*passages, "the the the the", f"u{k} v{k}", "x " * 30]) for _ in range(rng.randrange(1, 7)))) for k in range(150)]
    for slice_, bucket in ((1 << 22, 1 << 22), (2000, 3000), (1, 10_000)):
        monkeypatch.setattr(substring, "BLOCK_BYTES", slice_)
        monkeypatch.setattr(substring, "BUCKET_BYTES", bucket)
        assert run(spark, rows) == sorted(brute.substring(rows, 13), key=str)


def test_nulls_ties_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, "x " + long), (2, None), (3, ""), (4, " \n "), (None, long), (None, None), (5, long), (5, long), (6, "short text"), (7, "short text"), (2**63 - 1, long), (-(2**63), "y " * 20)]
    assert run(spark, rows) == sorted(brute.substring(rows, 13), key=str)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, part int, th bigint")
    assert substring.remove_repeats(docs).count() == 0
    t = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(1, t, 5, "a"), (2, "z " + t, 6, None)], "doc_id bigint, text string, part int, doc string")
    out = sorted(map(tuple, substring.clean_passages(docs, 50).collect()))
    assert docs.columns == substring.clean_passages(docs, 50).columns
    assert out == [(1, t, 5, "a"), (2, "z", 6, None)]
