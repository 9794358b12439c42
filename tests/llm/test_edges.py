"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""
import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelloom.llm import ann, bpe, chat, chunks, licenses, mixing, quality, rans, simhash

from . import brute

LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "one two three", "Same text here, with some more words. " * 3, "Same text here, with some more words. " * 3, "SAME text here, with some more words. " * 3, LONG, LONG + " tail",
         "a  b   c \n d  ", "tail  ", "<|endoftext|> it's   ́é ñ日本語 12345 don't  'll", "aaaa" * 300, "ab" * 400 + "\n\n\n  x", "MIT License. Licensed under the Apache License, Version 2.0; GNU General Public License v3 or mit license",
         "### $$$ *** " * 40, "x y z " * 100]
ROWS = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s1"), (5, TEXTS[5], "en", "s1"), (6, "another text", "en", "s1")]
KIND = "doc_id bigint, text string, lang string, source string, q string, row string, kept boolean, bucket int, th string, fp string, ids string, h int, size string, copies string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "q", "r", True, 1, "t", "f", "i", 2, "z", "c") for r in ROWS], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_quality(docs, none):
    out = quality.quality_report(docs).drop("kept").collect()
    same(out, [(d, *brute.quality(t)) for d, t, _, _ in ROWS])
    assert quality.quality_report(none).count() == 0 and quality.quality_filter(none).columns == none.columns
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {8, 9}


def test_quality_fences_reject_outliers(spark):
    good = [(i, " ".join(f"word{(i * 31 + j * j) % 5003}" for j in range(120)), "en", f"s{i % 3}") for i in range(300)]
    bad = [(1000 + i, " ".join(f"wor$$$***{(i * 7 + j * j) % 4001}" for j in range(120)), "en", f"s{i % 3}") for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.quality_report(df).filter("kept").collect()}
    assert kept == {r[0] for r in good}


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs, 4).collect()
    same([(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in out], brute.simhash([(d, t) for d, t, _, _ in ROWS]))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_finds_every_pair_in_the_ball(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 4, 4, 5):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)))
    df = spark.createDataFrame([(0, f) for f in fps], "t int, fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    values = sorted(fps)
    group = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= 4:
                x, y = group[a], group[b]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    assert {v: roots.get(v, v) for v in values} == group


def test_simhash_recursion_over_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 3000)
    rng = np.random.default_rng(1)
    low = sum(1 << k for k in range(56))
    f = np.unique(np.array([0, 3, 15, 255, 1 << 40, (1 << 40) | 7, *(int(a) & low for a in rng.integers(0, 2**62, 30)), *(int(np.bitwise_or.reduce(1 << rng.choice(56, 3))) for _ in range(60))], np.uint64))
    n = len(f)
    near = {(a, b) for a in range(n) for b in range(a + 1, n) if bin(int(f[a]) ^ int(f[b])).count("1") <= 4}
    every = lambda groups: (m for bucket in range(256) for m in simhash._meetings(f, np.arange(n), bucket, 8, 2, 64, groups))
    group = np.arange(n) % 3
    assert {tuple(x) for x in simhash._unique_pairs(every(group)).tolist()} == {(a, b) for a, b in near if group[a] != group[b]}
    forest = simhash._forest(n, every(None)).tolist()
    roots = {}
    for edges in (near, forest):
        parent = list(range(n))
        for a, b in edges:
            x, y = simhash._root(parent, a), simhash._root(parent, b)
            parent[max(x, y)] = min(x, y)
        roots[len(roots)] = [simhash._root(parent, k) for k in range(n)]
    assert roots[0] == roots[1] and len(forest) < len(near)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, k) for k in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[k] == 1000 for k in range(1000, 1100))
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies(spark):
    rng = np.random.default_rng(2)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, want = [], {}
    for g in range(20):
        w = text(300)
        rows.append((g * 10, " ".join(w)))
        rows.append((g * 10 + 1, "  ".join(w).upper()))
        near = list(w)
        near[150] = "changed"
        rows.append((g * 10 + 2, " ".join(near)))
        half = w[:150] + text(150)
        rows.append((g * 10 + 3, " ".join(half)))
        want |= {g * 10: g * 10, g * 10 + 1: g * 10, g * 10 + 2: g * 10, g * 10 + 3: g * 10 + 3}
    rows += [(900, None), (901, ""), (902, "short one"), (903, "short one"), (903, "short one")]
    want |= {900: 900, 901: 901, 902: 902, 903: 902}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["group_id"] for r in simhash.copy_groups(df).collect()} == want
    left = simhash.drop_copies(df)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, v in want.items() if k == v) and left.columns == df.columns
    assert simhash.drop_copies(df.limit(0)).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs).collect()
    src, size, taken, target = {}, {}, {}, {}
    for r in out:
        s = r["source"]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 2
    want = brute.targets(size)
    assert len(out) == len(ROWS) and all(target[s] == pytest.approx(want[s]) for s in want)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), f"s{s}") for i, (n, s) in enumerate(zip(rng.integers(1, 400, 3000), rng.choice(6, 3000, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 10


def test_licenses(docs, none):
    out = licenses.scan_licenses(docs)
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out.collect()], [(d, *brute.licenses(t)) for d, t, _, _ in ROWS])
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in out.collect())
    assert licenses.scan_licenses(none).count() == 0
    _, _, _, _, _, labels, score, found = licenses.scan("Licensed under CC BY-NC 4.0. SPDX-License-Identifier: BSD-3-Clause")
    assert labels == "bsd,cc-by-nc" and score == 1.0 and len(found) == 2  # "cc by" lies within "cc by nc" and is suppressed
    assert len(licenses.rules()) > 300
    assert licenses.scan("the mit of apache boost")[5] == ""


def test_rans_round_trip(spark, docs, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = str(tmp_path / "tokens")
    rans.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
    got = [tuple(r) for r in rans.read_tokens(spark, path, 50_257).collect()]
    at = 0
    for d, start, n, crc, ids in sorted(got, key=lambda r: r[1]):
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += n
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, _, _ in ROWS]
    same([(r[0], tuple(r[4])) for r in got], [(d, tuple(x)) for d, x in want])
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(r[0] for r in ROWS)


def test_rans_empty_and_null_ids(spark, none, tmp_path):
    for k, df in enumerate((none, spark.createDataFrame([(None, "a"), (3, None)], "doc_id bigint, text string"))):
        path = str(tmp_path / f"t{k}")
        rans.write_tokens(df, path, public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
        out = rans.read_tokens(spark, path, 50_257, with_ids=False).collect()
        assert len(out) == df.count()
        if out:
            assert min(out, key=lambda r: r["start"])["doc_id"] is None


def test_rans_special_tokens_and_several_blocks(spark, tmp_path, monkeypatch):
    """``start`` runs on over blocks and shards; control strings in a text are what the library makes of them."""
    monkeypatch.setattr(rans, "BLOCK_IDS", 300)
    monkeypatch.setattr(rans, "SHARD_BYTES", 2000)
    path, t = str(tmp_path / "tokens"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>\n y", " <|endoftext|><|endoftext|> ", "word " * 400, "", None] * 9
    rans.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
    assert spark.read.parquet(path + "/blocks").count() > 9
    at = 0
    for r, x in zip(rans.read_tokens(spark, path, 50_257).orderBy("doc_id").collect(), texts):
        want = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert r["ids"] == want and r["start"] == at and r["n_tokens"] == len(want)
        at += len(want)


def test_piece_cache_turnover(monkeypatch):
    """Pieces that are dropped and learnt again, in slices of a few texts."""
    monkeypatch.setattr(chunks, "MOST", 20)
    monkeypatch.setattr(chunks, "SLICE", 200)
    monkeypatch.setattr(chunks, "IDS", 30)
    path, t = public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(["ab", "cde", " ", "\n", ".", "é", "1", "'s", "\u3000", "\t", "##"], 60)) for _ in range(200)] + ["", "one two. one", "p q!\nr"]
    cache = chunks.PieceCache(rans._Encoder(path))
    got = [x.tolist() for _, _, flat, n in cache.encode_texts(pa.array(texts)) for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_rans_blocks():
    rng = np.random.default_rng(1)
    for n in (1, 5, 1023, 1024, 1025, 200_001):
        ids = (rng.zipf(1.3, n) % 500).astype(np.uint32)
        table = rans.Table(rans.scaled_frequencies(np.bincount(ids, minlength=600)))
        b = rans.encode_block(ids, table)
        assert (rans.decode_block(b, n, table) == ids).all()
        checks = len(np.frombuffer(b["check_at"], np.int64))
        if checks > 1:  # decoding may start at a checkpoint
            tail = rans.decode_block(b, n, table, checks - 1)
            assert (tail == ids[(checks - 1) * rans.CHECK_ROWS * b["lanes"] :]).all()
        with pytest.raises(ValueError, match="checksum"):
            rans.decode_block(b | {"crc": b["crc"] ^ 1}, n, table)
    f = rans.scaled_frequencies(np.ones(50_000, np.int64))
    assert f.sum() == 1 << rans.SCALE and f.min() >= 1


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    same([(r["doc_id"], tuple(r["ids"]), bytes(r["decoded"]).decode()) for r in out], [(d, tuple(enc.encode_ordinary(t or "")), t or "") for d, t, _, _ in ROWS])
    same([tuple(r) for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()], [tuple(r) for r in out])
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    bad = none.sparkSession.createDataFrame([(1, [99_999_999])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, path, public_tokenizers.PATTERN).collect()


def test_bpe_words_of_any_length():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeinorst"), n)) for n in (1, 2, 3, 9, 40, 256, 257, 900)] + ["a" * 999, "ab" * 333, "é" * 200]
    words += ["ATAT", "中文字符" * 50, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))]
    flat, start, count = codec.words([w.encode() for w in words])
    for w, a, n in zip(words, start, count):
        assert flat[a : a + n].tolist() == enc.encode_ordinary(w), w[:20]
    _, _, count = codec.words([b"a" * 1_000_000])
    assert count.sum() == 250_000
    bpe.check_ranks(path)


def test_bpe_rejects_ranks_with_unreachable_tokens(tmp_path):
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"bcd", b"abcd", b"cd"]  # "abcd" would take ab, then cd, and bcd needs b beside cd
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate([*ranks, b"xyz"])))
    with pytest.raises(ValueError, match="do not encode to themselves"):
        bpe.check_ranks(str(path))


def test_ann(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(40)]  # copies of one vector
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0] * 15 + [float("nan")], 1), (403, [1.0] * 15 + [None], 1), (404, [1.0] * 15 + [float("inf")], 1), (None, [1.0] * 16, 1), (405, [1.0] * 3, 1), (406, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    good = ann.clean(df)
    got = {}
    for r in ann.search(good, good.filter("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    ids = np.array([r[0] for r in rows[:340]])
    x = np.array([r[1] for r in rows[:340]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in ids[ids % 10 == 0]:
        s = x @ x[list(ids).index(q)]
        order = [int(ids[k]) for k in np.lexsort((ids, -s.round(12))) if ids[k] != q][:5]
        assert [i for _, i in sorted(got[int(q)])] == order
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>, label int")
    assert ann.search(ann.clean(few), ann.clean(few), 5).count() == 6
    empty = ann.clean(df.limit(0))
    assert ann.search(empty, empty, 5).count() == 0


def test_ann_ascends_and_splits_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 50)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((20, 24))
    v = np.concatenate([centre[k] + 0.2 * rng.standard_normal((60, 24)) for k in range(20)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    good = ann.clean(df)
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(good, good.filter("vec_id % 20 = 0"), 5, trees=12, share=0.0, least=150, prefix=3).collect()}
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, len(v), 20):
        s = x @ x[q]
        s[q] = -9
        want |= {(q, int(k)) for k in np.argsort(-s)[:5]}
    assert len(got & want) / len(want) >= 0.9


def test_chat_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "hi"), ("t", 2, 1, 1.0, "assistant", "bad"), ("t", 3, 1, 2.0, "assistant", "good <s> [x] \\l"), ("t", 4, 3, 1.0, "user", None), ("t", 5, 2, 9.0, "user", "far"),
            ("u", 1, 99, 0.0, None, "orphan"), ("c", 1, 2, 0.0, "user", "circle"), ("c", 2, 1, 0.0, "user", "circle"), (None, 7, None, 0.0, "user", "nowhere")]
    m = spark.createDataFrame(rows, "tree string, id bigint, parent bigint, score double, role string, text string")
    out = {(r["tree"], r["rank"]): r for r in chat.format_paths(chat.root_paths(m, None), m).withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("m", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == {("t", 1), ("t", 2), ("u", 1), (None, 1)}
    assert [(t["role"], t["text"]) for t in out["t", 1]["turns"]] == [("user", "hi"), ("assistant", "bad"), ("user", "far")]
    assert out["t", 2]["m"] == "good <s> [x] \\l" and [t["text"] for t in out["t", 2]["turns"]] == ["hi", "good <s> [x] \\l", ""]
    best = chat.root_paths(m, 1)
    assert {r["path"] for r in best.filter("tree = 't'").collect()} == {5}


def test_chat_long_chain_and_ties(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"</s>[:]<s>{t}\\") for t in range(300)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r["tree"]: r for r in chat.format_conversations(df).withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("m", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [t["text"] for t in out[1]["turns"]] == [r[3] for r in rows[:300]]
    assert out[1]["m"] == "".join(r[3] for r in rows[:300] if r[2] == "assistant")
    assert [t["text"] for t in out[2]["turns"]] == ["a", "a", "b"] and out[None]["n_turns"] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_words_longer_than_a_window(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})._core_bpe.encode_single_piece
    rng = np.random.default_rng(2)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 30_000))
    words = ["x" + "a" * 9001, letters, "q" + "abc" * 3000, "short", "é日" * 3000, "".join("a" * int(k) + "the" * int(k % 7) for k in rng.integers(1, 400, 60))]
    for window in (256, 1024, 1 << 17):
        monkeypatch.setattr(bpe, "WINDOW", window)
        flat, start, count = codec.words([w.encode() for w in words])
        assert [flat[a : a + n].tolist() for a, n in zip(start, count)] == [plain(w.encode()) for w in words]
    monkeypatch.setattr(bpe, "DECODED", 100)
    ids = [flat[a : a + n] for a, n in zip(start, count)] + [flat[:0]]
    assert codec.decode(np.concatenate(ids), np.array([len(x) for x in ids])) == [w.encode() for w in words] + [b""]
    huge = b"a" * 4_000_000
    flat, _, _ = codec.words([huge])
    assert codec.decode(flat, np.array([len(flat)])) == [huge] and len(flat) == 1_000_000
    codec.rest()


def test_bpe_works_in_small_steps():
    """What a worker holds beside its memory of pieces follows the bytes of a slice and of a query."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec, plain = bpe.Codec(path, public_tokenizers.PATTERN), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng, slices, asked, cut, query = np.random.default_rng(3), [], [], codec.cache._cut, codec._query
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 900_000)
    words = ["".join(letters[k : k + 9]) for k in range(0, 900_000, 9)]
    texts = [" ".join(words[k : k + 2000]) for k in range(0, len(words), 2000)] * 5
    codec.cache._cut = lambda t: slices.append(pc.sum(pc.binary_length(t)).as_py()) or cut(t)
    codec._query = lambda w: asked.append(sum(map(len, w))) or query(w)
    got = [x.tolist() for a, b, flat, count in codec.cache.encode_texts(pa.array(texts)) for x in np.split(flat, np.cumsum(count)[:-1])]
    codec.rest()
    assert got == [plain.encode_ordinary(t) for t in texts]
    assert max(slices) <= 2 << 20 and max(asked) <= 128 << 10 and len(slices) > 1


def test_memory_of_long_pieces_is_bounded():
    """Pieces of 20,000 characters: the memory is bounded by what they hold, not by their number alone."""
    encode = lambda pieces: (np.zeros(sum(map(len, pieces)), np.uint32), np.array([len(x) for x in pieces], np.int64))
    cache = chunks.PieceCache(encode, slice_bytes=1 << 20)
    for k in range(40):
        texts = pa.array([f"{k}x{n}" + "a" * 20_000 for n in range(50)])
        assert [n for _, _, _, count in cache.encode_texts(texts) for n in count] == [len(t) for t in texts.to_pylist()]
        assert cache.young.held() <= chunks.HELD + (6 << 20) and cache.old.held() <= chunks.HELD + (6 << 20)
    assert sum(map(len, cache.young.known)) < 400
