"""Byte-level BPE by recursive queries in DuckDB, one in-memory database per worker.

A worker cuts its texts into pieces, the pieces into words by the split pattern, and encodes every distinct word once: rows of
token positions join the merge table, each step contracts the pair of least rank of every word at its places from the left, and the
recursion ends where no pair is left. Decoding joins ids to the vocabulary and aggregates the bytes in order.

All places of a word's least pair are contracted in one step. Contracting the leftmost alone, again and again, comes to the same as long as every
token of the vocabulary encodes to itself: then a pair that arises from a token never ranks below it. ``check_ranks`` proves that of
a rank file. Words are cut where two bytes meet that stand side by side in no token, since no pair can span that place.

A long word is encoded in windows from left to right. Each begins at a token of the one before, some way from its end. Two encodings that stand side by side
are the encoding of both texts together if the tokens that meet encode, as one text, to themselves; where they do not, the window begins earlier.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PieceCache, gather
from .common import give_back

#: Bytes of words in a recursive query, and what a database may hold of memory.
QUERY_BYTES, MEMORY = 128 << 10, "800MB"
#: Bytes of text whose new pieces are encoded together: their arrays lie beside the memory of pieces, in each of an executor's workers.
SLICE = 2 << 20
#: Distinct pieces in the younger half of a worker's memory.
PIECES = 320_000
#: Bytes of a window of a longer word, and ids of a text that are decoded in one string.
WINDOW, DECODED = 128 << 10, 1 << 18

# The recursion keeps one row for each place g of a token t in part w of a word, with the place ng and token nt after it; a step
# changes the rows of contracted places, and puts -1 where a token has gone. In a run of one token every second place is taken.
_ENCODE = """
WITH RECURSIVE s(g, w, t, ng, nt) USING KEY (g) AS (
  SELECT g, w, t, ng, nt FROM words
  UNION
  (WITH q AS (SELECT * FROM recurring.s WHERE t >= 0 AND w IN (SELECT w FROM s)),
   c AS (SELECT g, w, ng, m, t = nt AS twin FROM q JOIN merges ON l = t AND r = nt),
   least_ AS (SELECT w, min(m) AS m FROM c GROUP BY w),
   o AS (SELECT c.* FROM c JOIN least_ ON least_.w = c.w AND least_.m = c.m),
   runs AS (SELECT x.*, y.g IS NULL AS fresh, row_number() OVER (ORDER BY x.g) AS n FROM o x LEFT JOIN o y ON y.ng = x.g WHERE x.twin),
   f AS (SELECT g, w, ng, m FROM o WHERE NOT twin
         UNION ALL
         SELECT g, w, ng, m FROM (SELECT *, n - max(CASE WHEN fresh THEN n END) OVER (ORDER BY n) AS nth FROM runs) WHERE nth % 2 = 0)
   SELECT f.g, f.w, f.m, n.ng, coalesce(f2.m, n.nt) FROM f JOIN q n ON n.g = f.ng LEFT JOIN f f2 ON f2.g = n.ng
   UNION ALL SELECT ng, w, -1, -1, -1 FROM f
   UNION ALL SELECT q.g, q.w, q.t, q.ng, f.m FROM q JOIN f ON f.g = q.ng ANTI JOIN (SELECT unnest([g, ng]) AS d FROM f) ON d = q.g))
SELECT g, t FROM s WHERE t >= 0 ORDER BY g"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The vocabulary of a rank file in a database of its own."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joined = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        triples = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tables = {"merges": pa.table([pa.array(c, pa.int32()) for c in zip(*triples)], names=["l", "r", "m"]),
                       "vocabulary": pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array([t.hex() for t in ranks])], names=["id", "bytes"])}
        self._db = None
        self.cache = PieceCache(self._pieces, most=PIECES, slice_bytes=SLICE)

    @property
    def db(self):
        if self._db is None:
            import duckdb

            self._db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
            for name, rows in self.tables.items():
                self._db.register("arrow_rows", rows)
                self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_rows")
                self._db.unregister("arrow_rows")
        return self._db

    def rest(self) -> None:
        """Give the database's memory back: a worker outlives its task, and others run in between."""
        if self._db is not None:
            self._db.close()
            self._db = None
        give_back()

    def _query(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last = np.append(~self.joined[data[:-1], data[1:]], True)
        last[ends - 1] = True
        t, g = self.byte_id[data], np.arange(len(data), dtype=np.int32)
        rows = {"g": g, "w": (np.cumsum(last) - last).astype(np.int32), "t": t, "ng": np.where(last, -1, g + 1).astype(np.int32), "nt": np.where(last, -1, np.append(t[1:], -1)).astype(np.int32)}
        self.db.register("words", pa.table(rows))
        found = self.db.execute(_ENCODE).fetchnumpy()
        self.db.unregister("words")
        return found["t"].astype(np.uint32), np.diff(np.concatenate(([0], np.searchsorted(found["g"], ends))))

    def _windows(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length, window by window."""
        ids, ends = self._window(word, 0)
        while ends[-1] < len(word):
            # Begin at the end of a token a quarter of a window back, or further where the tokens do not go together.
            back = WINDOW // 4
            while True:
                k = int(np.searchsorted(ends, ends[-1] - back, "right")) - 1
                if k < 0:
                    raise ValueError(f"no two windows of a word of {len(word)} bytes go together")
                more, at = self._window(word, int(ends[k]))
                met = word[int(ends[k - 1]) if k else 0 : int(at[0])]
                if np.array_equal(self._query([met])[0], [ids[k], more[0]]):
                    break
                back *= 2
            ids, ends = np.concatenate((ids[: k + 1], more)), np.concatenate((ends[: k + 1], at))
        return ids

    def _window(self, word: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the window that begins at ``start``, and where each ends in the word."""
        ids = self._query([word[start : start + WINDOW]])[0]
        return ids, start + np.cumsum(self.size[ids])

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words (none empty) in a row, and where each begins and how many it has. Words of like length share a query, as they end after like numbers
        of steps; words longer than a window are encoded by themselves."""
        long = [k for k, w in enumerate(words) if len(w) > WINDOW]
        if long:
            flat, start, count = self.words([w for w in words if len(w) <= WINDOW])
            at = np.array([k for k, w in enumerate(words) if len(w) <= WINDOW], np.int64)
            starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            starts[at], counts[at] = start, count
            flats, end = [flat], len(flat)
            for k in long:
                flats.append(self._windows(words[k]))
                starts[k], counts[k] = end, len(flats[-1])
                end += len(flats[-1])
            return np.concatenate(flats), starts, counts
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        full = np.cumsum(size[order])
        flats, counts, a = [], [], 0
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(full, (full[a - 1] if a else 0) + QUERY_BYTES, "right")))
            flat, n = self._query([words[k] for k in order[a:b]])
            flats.append(flat)
            counts.append(n)
            a = b
        count = np.zeros(len(words), np.int64)
        if len(words):
            count[order] = np.concatenate(counts)
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(flats) if flats else np.zeros(0, np.uint32), start, count

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.split(x) for x in pieces]
        known = {w: k for k, w in enumerate(dict.fromkeys(w for c in cut for w in c))}
        flat, start, count = self.words([w.encode("utf-8", "replace") for w in known])
        at = np.array([known[w] for c in cut for w in c], np.int64)
        n = np.concatenate(([0], np.cumsum(count[at])))
        ends = np.cumsum([len(c) for c in cut])
        return gather(flat, start[at], count[at]), np.diff(np.concatenate(([0], n[ends])))

    def decode(self, flat: np.ndarray, count: np.ndarray) -> list[bytes]:
        """``flat``: the ids of texts in a row, ``count``: how many each has."""
        parts = -(-count // DECODED)
        text = np.repeat(np.arange(len(count)), parts)
        size = np.full(len(text), DECODED, np.int64)
        last = np.cumsum(parts)[parts > 0] - 1
        size[last] = count[parts > 0] - (parts[parts > 0] - 1) * DECODED
        out: list[list[bytes]] = [[] for _ in count]
        ends, a = np.cumsum(size), 0
        while a < len(text):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * DECODED, "right")))
            for k, x in zip(text[a:z].tolist(), self._decoded(flat[(ends[a - 1] if a else 0) : ends[z - 1]], size[a:z])):
                out[k].append(x)
            a = z
        return [b"".join(x) for x in out]

    def _decoded(self, flat: np.ndarray, count: np.ndarray) -> list[bytes]:
        d = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.db.register("ids", pa.table({"d": d, "p": np.arange(len(flat), dtype=np.int32), "t": flat.astype(np.int32)}))
        rows = self.db.execute("SELECT d, count(*) AS n, string_agg(bytes, '' ORDER BY p) AS x FROM ids JOIN vocabulary ON id = t GROUP BY d").fetchall()
        self.db.unregister("ids")
        out = [b""] * len(count)
        for d, found, x in rows:
            if found != count[d]:
                raise ValueError("an id is not in the vocabulary")
            out[d] = bytes.fromhex(x)
        if len(rows) != len(count):
            raise ValueError("an id is not in the vocabulary")
        return out


_CODECS: dict = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


@lru_cache(maxsize=8)
def check_ranks(path: str) -> None:
    """Raise if a token of the rank file does not encode to itself."""
    ranks = read_ranks(path)
    codec = Codec(path, r".+")
    _, _, count = codec.words(list(ranks))
    codec.rest()
    if (count != 1).any():
        raise ValueError(f"{int((count != 1).sum())} tokens of {path} do not encode to themselves")


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _body(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (array) of every row of ``docs``. A null or empty text has no ids; repeated rows are encoded alike; other columns
    are ignored; an empty table gives an empty result. Texts of any length are encoded whole; a rank file with tokens that do not encode to themselves is an error."""
    check_ranks(ranks)

    def run(batches):
        give_back()
        codec = _codec(ranks, pattern)
        try:
            for b in batches:
                for at, to, flat, count in codec.cache.encode_texts(b.column(1)):
                    give_back()
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), _lists(flat, count)], names=["doc_id", "ids"])
        finally:
            codec.rest()

    return _body(docs, text, key).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``encode`` with decoded (binary), what ``decode`` makes of the ids, by one codec in one pass."""
    check_ranks(ranks)

    def run(batches):
        give_back()
        codec = _codec(ranks, pattern)
        try:
            for b in batches:
                for at, to, flat, count in codec.cache.encode_texts(b.column(1)):
                    give_back()
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), _lists(flat, count), pa.array(codec.decode(flat, count), pa.binary())], names=["doc_id", "ids", "decoded"])
        finally:
            codec.rest()

    return _body(docs, text, key).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``tokens``: doc_id, ids. Adds decoded (binary). Null ids count as none; an id that is not in the vocabulary is an error."""

    def run(batches):
        codec = _codec(ranks, pattern)
        try:
            for b in batches:
                count = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(count)
                a = 0
                while a < len(count):
                    z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 19), "right")))
                    lo, hi = int(ends[a - 1]) if a else 0, int(ends[z - 1])
                    part = b.slice(a, z - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(flat[lo:hi], count[a:z]), pa.binary())], names=["doc_id", "ids", "decoded"])
                    a = z
        finally:
            codec.rest()

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
