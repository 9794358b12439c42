"""Merkle manifest, line dedup and conversation trie against brute force: odd tables, and every registered query against its SQL."""
import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import lines, merkle, queries, trie

from .brute import sha

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, s int, idx string, level string, d string, h string, gone int, leaf string"
EXTRA = (1, "i", "l", "d", "h", 2, "f")


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(nodes):
    """The last node of a tree over ``nodes``, and the siblings on the way to it for each of them."""
    ways, level = [[] for _ in nodes], [(d, [i]) for i, d in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 3):
            run = level[k : k + 3]
            for j, (_, below) in enumerate(run):
                for i in below:
                    ways[i] += [d for q, (d, _) in enumerate(run) if q != j]
            above.append((sha("".join(d for d, _ in run)), sum((b for _, b in run), [])))
        level = above
    return level[0][0], ways


def brute_manifest(rows):
    by = defaultdict(list)
    for d, text, lang, source, n in rows:
        by[source].append((d is not None, d or 0, sha("".join(map(field, (d, source, lang, n, text)))), d))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(by[s]), grown([x[2] for x in sorted(by[s])])) for s in order]
    if not trees:
        return []
    root, over = grown([t[0] for _, t in trees])
    return [(x[3], x[2], top, root, sha("".join(way + up))) for (leaves, (top, ways)), up in zip(trees, over) for x, way in zip(leaves, ways)]


def brute_lines(rows):
    """rows: distinct ids"""
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for d, ls in cut:
        for x in ls:
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    out = []
    for d, ls in cut:
        kept = [x for x in ls if not (len(holders.get(key(x), ())) >= 3 and d < max(holders[key(x)]))]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32], t))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if full[c] == p))) for p, m in members.items()]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28, 2300])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = [(i, f"text {i}\nü", "en" if i % 3 else None, "hot" if i % 3 == 0 else f"s{rng.randrange(7)}", i) for i in range(n)]
    if n > 20:
        rows += [(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0), (6, "x" * 200_000, "é", "", None), (7, None, "en", "ß", 3)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)
    m = merkle.manifest(df, carry={"old": F.col("leaf")})
    same(m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof"))).collect(), brute_manifest(rows))
    assert m.filter((merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")) | (F.col("old") != "f")).count() == 0
    assert m.filter(merkle.fold(F.lit(sha("other")), F.col("proof")) == F.col("root")).count() == 0


def test_manifest_of_nothing_and_of_many_groups(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "t", None, f"g{i // 2}", 1) for i in range(900)]
    m = merkle.manifest(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS))
    same(m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof"))).collect(), brute_manifest(rows))


def test_manifest_by_merge_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = [(i, "t", None, f"g{i % 2}", 1) for i in range(1600)]
    m = merkle.manifest(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS))
    same(m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof"))).collect(), brute_manifest(rows))


def report(df):
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()


def test_lines(spark):
    rng = random.Random(3)
    pool = [f"  Line number {i} of the Pool ÄÉ\t" if i % 2 else f"line NUMBER {i} of the pool" for i in range(40)] + ["short", "", "x" * 19, "y" * 20, "É" * 20, "é" * 20, "Straße der Üblichen ZEILEN"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(("", "", f" {i}")) for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "y" * 20 + "\n" + "Y" * 20 + " \n" + "y" * 20), (-4, "y" * 20), (204, "\n".join(["long " * 9 + str(i % 5000) for i in range(20_000)])), (205, "\n".join(["long " * 9 + str(i) for i in range(5000)])), (206, "LONG " * 9 + "77")]
    df = spark.createDataFrame([(d, t, None, None, None, *EXTRA) for d, t in rows], DOCS).repartition(4)
    same(report(lines.dedup_lines(df)), brute_lines(rows))
    same(report(lines.dedup_lines(df, batches=1)), brute_lines(rows))
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_of_repeated_and_missing_ids(spark):
    a, b = "one line of many characters", "another line of many characters"
    rows = [(1, f"{a}\n{b}"), (1, f"{b}\n{a}"), (1, f"{b}\n{a}"), (2, a), (None, f"x\n{a}\n{b}"), (None, f"{b}\n{a}")]
    got = lines.dedup_lines(spark.createDataFrame([(d, t, None, None, None, *EXTRA) for d, t in rows], DOCS))
    same(got.select("doc_id", "n_dropped", "kept").collect(), [(1, 1, b), (1, 1, b), (1, 1, b), (2, 0, a), (None, 2, "x"), (None, 2, "")])


def test_runs_settle_keys_in_any_order_of_batches(spark):
    h = lambda *k: [(x.encode(), n, top) for x, n, top in k]
    runs = lines.Runs(spark)
    try:
        for batch in (h(("a", 3, 5), ("b", 1, 5)), h(("a", 1, 9), ("b", 1, 7)), h(("a", 9, 8), ("c", 3, 1)), h(("b", 1, 2), ("d", 2, 1)), h(("e", 4, 4))):
            runs.add(spark.createDataFrame(batch, "h binary, docs bigint, top bigint"))
        assert [len(x) for x in runs.levels] == [1, 0, 1]
        same([(bytes(r["h"]), r["top"]) for r in runs.settled().collect()], [(b"a", 9), (b"b", 7), (b"c", 1), (b"e", 4)])
    finally:
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


CONV = "conv_id bigint, turn bigint, role string, text string, p string, seq int, weight int, key string"


def test_trie(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("hi", "yes", "no é", "", None))) for c in range(260) for t in range(rng.randrange(1, 7)) if c % 7]
    rows += [(300, None, "user", "first"), (300, 2, "a", "b"), (300, 2, "a", "b"), (300, 2, "", "ab"), (None, 1, "user", "nobody"), (None, None, None, None), (-150, 0, "user", "hi"), (-200, 0, "user", "hi"), (-200, 1, "u", "x" * 300_000)]
    rows += [(1000 + c, t, "user", "same") for c in range(120) for t in range(3)] + [(2000, t, "user", f"turn {t}") for t in range(700)]
    df = spark.createDataFrame([(*r, "p", 1, 2, "k") for r in rows], CONV).repartition(5)
    same(trie.prefix_trie(df).collect(), brute_trie(rows))
    assert trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0


def test_trie_of_lists_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 16)
    rows = [(c, t, "user", "same") for c in range(-50, 150) for t in range(2)]
    same(trie.prefix_trie(spark.createDataFrame([(*r, "p", 1, 2, "k") for r in rows], CONV)).collect(), brute_trie(rows))


@pytest.mark.parametrize("name", ["op11_merkle", "op12_lines", "op13_trie"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    same(df.collect(), want)
