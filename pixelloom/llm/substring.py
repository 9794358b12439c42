"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words, so that any window of ``window`` words holds
a whole one. The blocks are indexed and probed with the rolling block at every word. A hit is extended by the windows that hold
it: those that also stand in a document of smaller id are joined into the maximal repeat, whose words are covered. Windows are told apart by
a 64-bit hash of two independent hashes of each word, not word by word.

Rows are packed: a task sends, for each bucket of hash values, one row with the arrays of all its entries, so the shuffles carry a few
bytes a word. Buckets are counted from the size of the input, which keeps the entries of a bucket, and the chance of a false hit
in it, alike at every size. What a task sees in several documents it settles itself, and sends one or two entries of it on, so that a passage
that stands everywhere fills no bucket. Tables between the steps are written to the shared folder.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard_tables, materialize, release, shuffle_partitions

#: Bytes of text whose words make the entries of one bucket.
BUCKET_BYTES = 4 << 20
#: Bytes of text that a task hashes at a time.
BLOCK_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_NONE = np.iinfo(np.int64).max


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    return h


def word_hashes(texts: list[bytes], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts in order, number of words of each text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[data]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    chars = data[inside]
    cum = np.cumsum(inside)
    first = cum[starts] - 1
    size = np.diff(np.concatenate((first, [len(chars)])))
    at = np.arange(len(chars)) - np.repeat(first, size)
    powers = np.full(int(size.max()), _random(seed + 100, 1)[0], np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    return _mix(np.add.reduceat(_random(seed, 256)[chars] * powers[at], first) + size.astype(np.uint64)), counts


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each position; shorter by k - 1 than ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_random(seed, k)):
        out += h[j : j + n] * c
    return _mix(out)


def _places(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all k-word windows that lie in one text: index among all words, text number, position in the text."""
    offsets = np.concatenate(([0], np.cumsum(counts)))
    n = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    pos = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return offsets[text] + pos, text, pos


_PACKED = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("th", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])
_PACKED_SQL = "bucket int, h binary, doc binary, th binary, n binary, pos binary"


def _small(a: np.ndarray) -> bytes:
    """Integers in the smallest type that holds them, behind a letter for the type."""
    for kind in "bhiq":
        t = np.dtype(kind)
        if not len(a) or (a.min() >= np.iinfo(t).min and a.max() <= np.iinfo(t).max):
            return kind.encode() + a.astype(t).tobytes()
    raise ValueError("not a signed integer array")


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, raw[:1].decode(), offset=1).astype(np.int64)


def _pack(bucket: np.ndarray, h: np.ndarray | None, doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row per bucket. Entries of one document stand together: its id (as a difference to the one before) and its text hash (nothing
    where all are 0) are stored once with a count."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    bucket, doc, th, pos = bucket[order], doc[order], th[order], pos[order].astype(np.uint32)
    h = None if h is None else h[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, bool)
    runs = np.flatnonzero(fresh)
    run_n = np.diff(np.concatenate((runs, [len(bucket)]))).astype(np.uint32)
    run_at = np.searchsorted(runs, np.concatenate((cuts, [len(bucket)])))
    rows = {name: [] for name in _PACKED.names}
    for k, (a, b) in enumerate(zip(cuts, np.concatenate((cuts[1:], [len(bucket)])))):
        r = slice(run_at[k], run_at[k + 1])
        p = pos[a:b]
        rows["bucket"].append(int(bucket[a]))
        rows["h"].append(b"" if h is None else h[a:b].tobytes())
        d, t = doc[runs[r]], th[runs[r]]
        rows["doc"].append(d[:1].tobytes() + (_small(np.diff(d)) if -(2**62) < d.min() and d.max() < 2**62 else b"x" + d.tobytes()))
        rows["th"].append(t.tobytes() if t.any() else b"")
        rows["n"].append(_small(run_n[r]))
        rows["pos"].append((p.astype(np.uint16) if p.max() < 65536 else p).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _PACKED], schema=_PACKED)


def _unpack(table: pa.Table, hash_type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hs, docs, ths, poss = [], [], [], []
    for h, d, t, n, p in zip(*(table.column(c).to_pylist() for c in _PACKED.names[1:])):
        n = _wide(n)
        total = int(n.sum())
        hs.append(np.frombuffer(h, hash_type))
        docs.append(np.repeat(np.frombuffer(d, np.int64, offset=9) if d[8:9] == b"x" else np.cumsum(np.concatenate((np.frombuffer(d[:8], np.int64), _wide(d[8:])))), n))
        ths.append(np.repeat(np.frombuffer(t, np.int64) if t else np.zeros(len(n), np.int64), n))
        poss.append(np.frombuffer(p, np.uint16 if len(p) == 2 * total else np.uint32).astype(np.uint32))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(hs, hash_type), cat(docs, np.int64), cat(ths, np.int64), cat(poss, np.uint32)


def _part(doc: np.ndarray, th: np.ndarray, parts: int) -> np.ndarray:
    return ((th ^ doc) % parts).astype(np.int32)  # as Spark's pmod in _slim


def _groups(h: np.ndarray, doc: np.ndarray, as_reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: smallest reference document and largest document with its hash."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    sizes = np.diff(np.concatenate((cuts, [len(s)])))
    low, high = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(np.where(as_reference, doc, _NONE)[order], cuts), sizes)
    high[order] = np.repeat(np.maximum.reduceat(doc[order], cuts), sizes)
    return low, high


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries by hash and document, where each hash starts in it, and which hashes stand in several documents."""
    order = np.lexsort((doc, h))
    s, d = h[order], doc[order]
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    last = np.concatenate((cuts[1:], [len(s)])) - 1
    return order, cuts, d[cuts] != d[last]


def _own(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by part as rows that pass the next step unchanged: their bucket is below 0."""
    part = batch.column(0).to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(-1 - part), *batch.columns[1:]], schema=_PACKED)


def _passed(table: pa.Table) -> pa.Table:
    return table.set_column(0, _PACKED.field(0), pa.array(-1 - table.column(0).to_numpy(), pa.int32()))


def _slices(docs: list, ths: list, texts: list, most: int):
    """The rows in runs of about ``most`` bytes of text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most or k == len(texts) - 1:
            yield docs[at : k + 1], ths[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0


def covered_windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """``docs``: doc (bigint, not null), th (bigint), part (int), text (binary). Returns packed rows by part: document, th and the start of
    every window whose words also start in a document of smaller id."""
    block = (window + 1) // 2

    def probe(batches):
        for b in batches:
            for doc, th, texts in _slices(*(b.column(k).to_pylist() for k in (0, 1, 2)), BLOCK_BYTES):
                h, counts = word_hashes(texts)
                idx, text, pos = _places(counts, block)
                if len(idx):
                    r, d, t = rolling(h, block, 7)[idx], np.array(doc, np.int64)[text], np.array(th, np.int64)[text]
                    order, cuts, common = _runs(r, d)
                    sizes = np.diff(np.concatenate((cuts, [len(r)])))
                    here = order[np.repeat(common, sizes)]
                    send = np.ones(len(r), bool)
                    if len(here):
                        # A block of several documents of this slice is a hit in all of them. Others must know its largest and its smallest reference document.
                        yield _own(_pack(_part(d[here], t[here], buckets), None, d[here], t[here], pos[here]))
                        send[here] = False
                        send[order[(cuts + sizes - 1)[common]]] = True
                        first = np.minimum.reduceat(np.where(pos[order] % block == 0, np.arange(len(r)), len(r)), cuts)[common]
                        send[order[first[first < len(r)]]] = True
                    r, d, t, pos = r[send], d[send], t[send], pos[send]
                    yield _pack(((r >> _U(32)) % _U(buckets)).astype(np.int32), r.astype(np.uint32), d, t, pos)

    def hit(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _passed(table)
        h, doc, th, pos = _unpack(table, np.uint32)
        reference = pos % block == 0
        low, high = _groups(h, doc, reference)
        mark = (low < doc) | (reference & (doc < high))
        doc, th, pos = doc[mark], th[mark], pos[mark]
        return pa.Table.from_batches([_pack(_part(doc, th, buckets), None, doc, th, pos)])

    probes = docs.select("doc", "th", "text").mapInArrow(probe, _PACKED_SQL)
    marks = materialize(probes.groupBy("bucket").applyInArrow(hit, _PACKED_SQL), "substring-marks")
    del probes
    release(docs.sparkSession)

    def extend(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, d, t, p = _unpack(right, np.uint8)
        order = np.lexsort((p, t, d))
        d, t, p = d[order], t[order], p[order]
        cuts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))) if len(d) else []
        marks = {(int(d[a]), int(t[a])): p[a:b] for a, b in zip(cuts, [*cuts[1:], len(d)])}
        out, rows = [], {}
        for doc, th, text in zip(*(left.column(c).to_pylist() for c in ("doc", "th", "text"))):
            if (doc, th) in marks:
                rows[doc, th] = text  # rows that are repeated as a whole count once
        keys = list(rows)
        for doc, th, texts in _slices([k[0] for k in keys], [k[1] for k in keys], list(rows.values()), BLOCK_BYTES):
            h, counts = word_hashes(texts)
            idx, text, pos = _places(counts, window)
            if not len(idx):
                continue
            offsets = np.concatenate(([0], np.cumsum(counts)))
            flag = np.zeros(len(h) + 1, np.int64)
            for k, key_ in enumerate(zip(doc, th)):
                flag[offsets[k] + marks[key_].astype(np.int64) + 1] = 1
            flag = np.cumsum(flag)
            near = flag[idx + window - block + 1] > flag[idx]
            idx, text, pos = idx[near], text[near], pos[near]
            second, _ = word_hashes(texts, 2)
            a, b = rolling(h, window, 8)[idx], rolling(second, window, 9)[idx]
            r, d, t = _mix(a + b * _U(3)), np.array(doc, np.int64)[text], np.array(th, np.int64)[text]
            if not len(r):
                continue
            # A window of several documents of this part is covered in all but the smallest, which alone others need to settle.
            order, cuts, _ = _runs(r, d)
            low = np.empty(len(r), np.int64)
            low[order] = np.repeat(d[order][cuts], np.diff(np.concatenate((cuts, [len(r)]))))
            sure = low < d
            if sure.any():
                out.append(_own(_pack(_part(d[sure], t[sure], buckets), None, d[sure], t[sure], pos[sure])))
            out.append(_pack((a[~sure] % _U(buckets)).astype(np.int32), r[~sure], d[~sure], t[~sure], pos[~sure]))
        return pa.Table.from_batches(out, schema=_PACKED)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _passed(table)
        h, doc, th, pos = _unpack(table, np.uint64)
        low, _ = _groups(h, doc, np.ones(len(doc), bool))
        mark = low < doc
        doc, th, pos = doc[mark], th[mark], pos[mark]
        return pa.Table.from_batches([_pack(_part(doc, th, buckets), None, doc, th, pos)])

    windows = docs.groupBy("part").cogroup(marks.withColumnRenamed("bucket", "part").groupBy("part")).applyInArrow(extend, _PACKED_SQL)
    found = materialize(windows.groupBy("bucket").applyInArrow(settle, _PACKED_SQL), "substring-hits")
    del windows
    discard_tables(marks)
    release(docs.sparkSession)
    return found


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_RESULT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, spans array<struct<start:bigint,end:bigint>>"


def _slim(docs: DataFrame, text: str, key: str, carry: bool) -> tuple[DataFrame, int]:
    """(doc, th, part, text, and if asked rest: the other columns) and the number of buckets and parts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = int(max(shuffle_partitions(docs.sparkSession), total // BUCKET_BYTES + 1))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # Where an id stands twice, the hash of the text tells the rows apart; elsewhere the id is enough.
    twice = docs.groupBy(F.col(key).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("k").isNotNull() & (F.col("n") > 1)).limit(1).count()
    th = F.xxhash64(raw) if twice else F.lit(0).cast("long")
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")] if carry else []
    slim = docs.select(F.col(key).cast("long").alias("doc"), th.alias("th"), raw.alias("text"), *rest)
    part = F.pmod(F.col("th").bitwiseXOR(F.coalesce("doc", F.lit(0).cast("long"))), F.lit(buckets).cast("long"))
    return slim.withColumn("part", part.cast("int")), buckets


def remove_repeats(docs: DataFrame, window: int = 13, text: str = "text", key: str = "doc_id", with_text: bool = True, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (word ranges
    [start, end) removed), if ``with_text`` kept (the text itself where nothing is removed, else the kept words joined by one
    space), and if ``carry`` rest (a struct of the other columns).

    A null or empty text has no words. A document without an id is neither a reference nor cleaned. Rows with one id do not
    count as repeats of each other. Texts shorter than the window keep all words; texts of any length are read whole; an empty table gives an empty
    result; other columns only come along with ``carry``."""
    slim, buckets = _slim(docs, text, key, carry)
    found = covered_windows(slim.filter(F.col("doc").isNotNull()).drop("rest"), window, buckets)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, d, t, p = _unpack(right, np.uint8)
        order = np.lexsort((p, t, d))
        d, t, p = d[order], t[order], p[order]
        cuts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))) if len(d) else []
        hits = {(int(d[a]), int(t[a])): p[a:b].astype(np.int64) for a, b in zip(cuts, [*cuts[1:], len(d)])}
        rows = []
        for doc, th, raw in zip(*(left.column(c).to_pylist() for c in ("doc", "th", "text"))):
            words, spans, n = raw.split(), [], 0
            starts = hits.get((doc, th)) if doc is not None else None
            total = len(words)
            if starts is not None:
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n = int(gone.sum())
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            rows.append((doc, total, n, hashlib.sha256(kept).hexdigest(), (kept if n else raw).decode("utf-8", "replace") if with_text else None, spans))
        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _RESULT)]
        names = list(_RESULT.names)
        if carry:
            cols, names = [*cols, left.column("rest")], [*names, "rest"]
        return pa.Table.from_arrays(cols, names=names)

    schema = _RESULT_SQL + (f", rest {slim.schema['rest'].dataType.simpleString()}" if carry else "")
    return slim.groupBy("part").cogroup(found.withColumnRenamed("bucket", "part").groupBy("part")).applyInArrow(finish, schema)


def clean_passages(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every passage of ``window`` or more words taken out that also stands in a document of smaller id; columns unchanged."""
    out = remove_repeats(docs, window, text, key, carry=True)
    return out.select(*[F.col("kept").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
