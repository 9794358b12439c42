"""Token ids in a binary format with a static range asymmetric numeral system (rANS).

All blocks share one frequency table, counted over the corpus. A block holds the ids of whole documents, encoded backwards in
interleaved lanes (lane j has symbols j, j + lanes, ..), with a checkpoint of the lane states every CHECK_ROWS rows, from which a
reader may start, and a checksum of the ids. The files are Parquet tables whose rows are blocks, in ascending order of documents.
"""
from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import PieceCache, gather
from .common import discard, materialize, release, scratch, shuffle_partitions

#: The frequencies sum to 2 ** SCALE; states live in [LOW, LOW << 32).
SCALE, LOW = 20, 1 << 31
LANES, CHECK_ROWS, BLOCK_IDS = 4096, 128, 1 << 20
#: Bytes of text whose ids make a shard of the files; shards grow beyond it where there would be more than SHARDS.
SHARD_BYTES, SHARDS = 32 << 20, 20_000
_U = np.uint64


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** SCALE, at least 1 for every symbol that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(counts.astype(np.float64) * ((1 << SCALE) / total), 1).astype(np.int64), 0)
    rest = (1 << SCALE) - int(f.sum())
    order = np.argsort(-f, kind="stable")
    k = 0
    while rest:
        j = order[k % len(order)]
        step = rest if rest > 0 else -min(-rest, max(int(f[j]) // 2, 0))
        if f[j] > 1 or step > 0:
            f[j] += step
            rest -= step
        k += 1
    return f.astype(np.uint64)


class Table:
    """The shared frequency table with its running sums and the symbol of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> dict:
    n = len(ids)
    lanes = max(1, min(LANES, n))
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words, checks = [], []
    limit = _U((LOW >> SCALE) << 32)
    for r in range(rows - 1, -1, -1):
        s = ids[r * lanes : (r + 1) * lanes]
        live = x[: len(s)]
        f = table.freq[s]
        full = live >= limit * f
        words.append((live[full] & _U(0xFFFFFFFF)).astype(np.uint32))
        live = np.where(full, live >> _U(32), live)
        q = live // f
        x[: len(s)] = (q << _U(SCALE)) + (live - q * f) + table.start[s]
        if r % CHECK_ROWS == 0:
            checks.append(x.copy())
    words.reverse()
    sizes = np.cumsum([0, *map(len, words)])
    return {"lanes": lanes, "words": np.concatenate(words).tobytes() if words else b"", "check_at": sizes[: rows : CHECK_ROWS].astype(np.int64).tobytes(),
            "states": np.concatenate(checks[::-1]).tobytes() if checks else b"", "crc": zlib.crc32(ids.astype("<u4").tobytes())}


def decode_block(block: dict, n: int, table: Table, check: int = 0) -> np.ndarray:
    """The ids from checkpoint ``check`` on. A whole block is held against its checksum."""
    lanes = block["lanes"]
    rows = -(-n // lanes)
    words = np.frombuffer(block["words"], np.uint32)
    at = int(np.frombuffer(block["check_at"], np.int64)[check]) if rows else 0
    x = np.frombuffer(block["states"], np.uint64)[check * lanes : (check + 1) * lanes].copy()
    first = check * CHECK_ROWS
    out = np.empty(max(n - first * lanes, 0), np.uint32)
    mask, low = _U((1 << SCALE) - 1), _U(LOW)
    for r in range(first, rows):
        m = min(lanes, n - r * lanes)
        live = x[:m]
        slot = live & mask
        s = table.symbol[slot]
        live = table.freq[s] * (live >> _U(SCALE)) + slot - table.start[s]
        need = live < low
        k = int(need.sum())
        live[need] = (live[need] << _U(32)) | words[at : at + k]
        at += k
        x[:m] = live
        out[(r - first) * lanes : (r - first) * lanes + m] = s
    if check == 0 and zlib.crc32(out.astype("<u4").tobytes()) != block["crc"]:
        raise ValueError("a block's ids do not match its checksum")
    return out


#: Pieces that are encoded as one text.
_JOINED = 2000
_TOKENIZERS: dict = {}


class _Encoder:
    """Ids of many short pieces. Pieces that neither start (behind their space) nor end with white space are encoded as one
    text, which the split pattern cuts between them, and told apart by the lengths of their bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.short, self.control = min(map(len, self.special), default=1 << 60), re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.size[k] = len(token)  # a byte-level token has one character a byte

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bytes_ = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy(zero_copy_only=False)
        joined = [k for k, x in enumerate(pieces) if len(x) > 1 and x[0] == " " and not x[1].isspace() and not x[-1].isspace() and (len(x) < self.short or not self.control(x))]
        order, counts, flats, rest = [], [], [], np.ones(len(pieces), bool)
        groups = [np.array(joined[at : at + _JOINED]) for at in range(0, len(joined), _JOINED)]
        for group, ids in zip(groups, self._ids(["".join([pieces[k] for k in g]) for g in groups])):
            ends, reached = np.cumsum(bytes_[group]), np.cumsum(self.size[ids])
            cut = np.searchsorted(reached, ends) + 1
            if len(ids) and cut[-1] <= len(ids) and (reached[cut - 1] == ends).all():
                order.append(group)
                counts.append(np.diff(np.concatenate(([0], cut))))
                flats.append(ids)
                rest[group] = False
        alone = np.flatnonzero(rest)
        ids = self._ids([pieces[k] for k in alone])
        order.append(alone)
        counts.append(np.array([len(x) for x in ids], np.int64))
        order, size, flat = np.concatenate(order), np.concatenate(counts), np.concatenate([*flats, *ids, np.zeros(0, np.uint32)])
        start, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        start[order], count[order] = np.cumsum(size) - size, size
        return gather(flat, start, count), count


def _pieces(path: str) -> PieceCache:
    """The tokenizer of a worker, with its memory of pieces."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _Encoder(path)
        _TOKENIZERS[path] = PieceCache(encoder, encoder.special)
    return _TOKENIZERS[path]


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_RAW_SQL = "shard int, block int, docs array<bigint>, lengths array<bigint>, ids binary"
_RAW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents in ascending order (null ids first, rows of one id by text hash), cut into blocks of whole documents: shard, block,
    docs, lengths, ids (packed, ``end_id`` after each document). A null text is empty and has the end id alone."""
    kind = _kind(vocabulary)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = int(max(shuffle_partitions(docs.sparkSession), min(total // SHARD_BYTES + 1, SHARDS)))

    def run(batches):
        cache, shard, block = _pieces(tokenizer), TaskContext.get().partitionId(), 0
        names, lengths, ids = [], [], []

        def flush():
            row = (shard, block, np.concatenate(names), np.concatenate(lengths), np.concatenate(ids).astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _RAW)], schema=_RAW)

        for b in batches:
            docs_ = b.column(0).to_pylist()
            for at, to, flat, count in cache.encode_texts(b.column(1)):
                ends = np.cumsum(count + 1)
                data = np.full(int(ends[-1]), end_id, np.uint32)
                data[np.delete(np.arange(len(data)), ends - 1)] = flat
                a = 0
                while a < to - at:
                    # Documents up to the one with which the block is full.
                    room = BLOCK_IDS - sum(map(len, ids))
                    z = min(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + room)) + 1, to - at)
                    names.append(np.array(docs_[at + a : at + z], object))
                    lengths.append(count[a:z] + 1)
                    ids.append(data[ends[a - 1] if a else 0 : ends[z - 1]])
                    if sum(map(len, ids)) >= BLOCK_IDS:
                        yield flush()
                        names, lengths, ids, block = [], [], [], block + 1
                    a = z
        if names:
            yield flush()

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("o", F.xxhash64("t"))
    first = F.col("doc_id").asc_nulls_first()
    return slim.repartitionByRange(shards, first, "o").sortWithinPartitions(first, "o").select("doc_id", "t").mapInArrow(run, _RAW_SQL)


def count_ids(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs. Tasks count whole blocks; what reaches the driver is one number per id of the vocabulary."""
    kind = _kind(vocabulary)

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in blocks.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("lanes", pa.int32()), ("words", pa.binary()), ("check_at", pa.binary()), ("states", pa.binary()), ("crc", pa.int64())])
_BLOCK_SQL = "shard int, block int, n_ids bigint, docs array<bigint>, lengths array<bigint>, lanes int, words binary, check_at binary, states binary, crc bigint"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, text: str = "text", key: str = "doc_id") -> None:
    """Write the ids of ``docs`` and the frequency table under ``path``. Nulls, empty texts, repeated rows and ties are as in ``token_blocks``; other columns
    are ignored; an empty table gives files without blocks."""
    spark, kind = docs.sparkSession, _kind(vocabulary)
    raw = scratch(spark, "tokens-raw")
    token_blocks(docs, tokenizer, end_id, vocabulary, text, key).write.option("compression", "zstd").parquet(raw)
    release(spark)
    blocks = spark.read.schema(_RAW_SQL).parquet(raw)
    freq = scaled_frequencies(count_ids(blocks, vocabulary))

    def run(batches):
        table = Table(freq)
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], kind).astype(np.uint32)
                b = encode_block(ids, table) | {k: r[k] for k in ("shard", "block", "docs", "lengths")} | {"n_ids": len(ids)}
                yield pa.RecordBatch.from_arrays([pa.array([b[f.name]], f.type) for f in _BLOCK], schema=_BLOCK)

    blocks.mapInArrow(run, _BLOCK_SQL).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    discard(spark, raw)


def read_table(spark: SparkSession, path: str, vocabulary: int) -> np.ndarray:
    """The frequency table of files: at most one row per id of the vocabulary."""
    freq = np.zeros(vocabulary, np.uint64)
    for r in spark.read.schema("id int, freq bigint").parquet(f"{path}/table").collect():
        freq[r["id"]] = r["freq"]
    return freq


def read_tokens(spark: SparkSession, path: str, vocabulary: int, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids (array)."""
    freq = read_table(spark, path, vocabulary)
    blocks = spark.read.schema(_BLOCK_SQL).parquet(f"{path}/blocks")

    def run(batches):
        table = Table(freq)
        for b in batches:
            for r in b.to_pylist():
                ids = decode_block(r, r["n_ids"], table)
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                parts = [ids[a:z] for a, z in zip(starts, ends)]
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                n = len(parts)
                cols = [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["docs"], pa.int64()), pa.array(starts), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(parts, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = blocks.mapInArrow(run, "shard int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))
    heads = blocks.select("shard", "block", "n_ids")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard stands in this window; the blocks of a shard are summed within it.
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = heads.withColumn("in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards.hint("merge"), "shard").select("shard", "block", (F.col("base") + F.col("in")).alias("base"))
    out = rows.join(materialize(base, "tokens-bases").hint("merge"), ["shard", "block"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
