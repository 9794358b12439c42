"""The registered queries of the training-data operators, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann, bpe, chat, licenses, lines, merkle, mixing, quality, rans, simhash, substring, trie, warc
from .common import materialize, read_table, scratch


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    out = materialize(chat.format_conversations(turns.unionByName(extra)), "chat-formatted")
    back = out.select(F.col("tree").alias("conv_id"), "formatted", chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"))
    flat = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("t").cast("long").alias("n_turns"), sha(flat).alias("turns_sha256"), F.length("m").cast("long").alias("loss_chars"), sha(F.col("m")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(10 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents"), 13, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
h AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS win FROM g),
f AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM h JOIN f USING (win) WHERE first < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
p AS (SELECT w.doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM w),
k AS (SELECT p.doc_id, array_to_string(list(words[p.j] ORDER BY p.j), ' ') AS kept, count(*) AS n FROM p ANTI JOIN c ON c.doc_id = p.doc_id AND c.j = p.j GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""".replace("\\\\", "\\")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.drop("detections")


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    rans.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
    return rans.read_tokens(spark, path, 50_257, with_ids=False)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.clean(read_table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(read_table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, payload_bytes, min(page_id) AS first FROM d GROUP BY ALL),
b AS (SELECT d.*, f.first, list_transform(range(0, 8), lambda k: ('0x' || substr(d.h, 1 + 5 * k::INT, 5))::BIGINT) AS g FROM d JOIN f USING (h, payload_bytes))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g[1 + j // 4] >> (15 - 5 * (j % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    broken = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = merkle.leaf_of(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    m = merkle.manifest(docs, carry={"tampered": F.when(broken, cut)})
    m = m.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Unsigned CRC-32 of a decimal text (ASCII).
_CRC32 = "xor(list_reduce(list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.COLUMNS[:-1]) + " || " + _FIELD + ")"
OP11_SQL = f"""
WITH RECURSIVE leaf AS (SELECT doc_id, source, {_LEAF.format('text')} AS leaf, CASE WHEN {_CRC32.format('doc_id::VARCHAR')} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS bad FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
n AS (SELECT 0 AS l, s, i, leaf AS d, count(*) OVER (PARTITION BY s) AS n FROM placed
  UNION ALL SELECT l + 1, s, i // 3, sha256(string_agg(d, '' ORDER BY i)), count(*) OVER (PARTITION BY s) FROM n WHERE n > 1 GROUP BY l + 1, s, i // 3),
subs AS (SELECT s, d AS subroot FROM n WHERE n = 1),
u AS (SELECT 0 AS l, s - 1 AS i, subroot AS d, count(*) OVER () AS n FROM subs
  UNION ALL SELECT l + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), count(*) OVER () FROM u WHERE n > 1 GROUP BY l + 1, i // 3),
run AS (SELECT l, s, i // 3 AS r, list(d ORDER BY i) AS ds FROM n WHERE n > 1 GROUP BY ALL), urun AS (SELECT l, i // 3 AS r, list(d ORDER BY i) AS ds FROM u WHERE n > 1 GROUP BY ALL),
walk AS (SELECT s, i AS place, 0 AS l, i, coalesce(bad, leaf) AS f, '' AS proof FROM placed
  UNION ALL SELECT w.s, place, w.l + 1, i // 3, sha256(array_to_string(ds[:i % 3] || [f] || ds[i % 3 + 2:], '')), proof || array_to_string(ds[:i % 3] || ds[i % 3 + 2:], '') FROM walk w JOIN run ON run.s = w.s AND run.l = w.l AND r = i // 3),
whole AS (SELECT s, place, 0 AS l, s - 1 AS i, arg_max(f, l) AS f, arg_max(proof, l) AS proof FROM walk GROUP BY s, place
  UNION ALL SELECT s, place, w.l + 1, i // 3, sha256(array_to_string(ds[:i % 3] || [f] || ds[i % 3 + 2:], '')), proof || array_to_string(ds[:i % 3] || ds[i % 3 + 2:], '') FROM whole w JOIN urun ON urun.l = w.l AND r = i // 3),
done AS (SELECT s, place, arg_max(f, l) AS f, arg_max(proof, l) AS proof FROM whole GROUP BY s, place)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM placed JOIN done ON done.s = placed.s AND place = i JOIN subs ON subs.s = placed.s, (SELECT d AS root FROM u WHERE n = 1)"""


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top > doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR top <= doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC32.format('c::VARCHAR')} % 6 AS h, c - (c % 100 + 100) % 100 AS b FROM t),
q AS (SELECT h.c, coalesce(b.ts[:h.h], []) || h.ts[h.h + 1:] AS ts FROM h LEFT JOIN t b ON b.c = h.b),
p AS (SELECT c, d, len(ts) AS n, sha256(ts[:d]::VARCHAR) AS p, CASE WHEN d > 0 THEN sha256(ts[:d - 1]::VARCHAR) END AS up, CASE WHEN d > 0 THEN length(ts[d].t) ELSE 0 END AS len FROM q, LATERAL (SELECT unnest(range(0, len(ts) + 1)) AS d)),
v AS (SELECT p, any_value(d) AS depth, any_value(up) AS up, any_value(len) AS len, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256 FROM p GROUP BY p),
k AS (SELECT up AS p, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT DISTINCT x.p AS low, y.p AS high FROM p x JOIN p y ON x.c = y.c AND y.d <= x.d),
s AS (SELECT high AS p, count(*) FILTER (k.p IS NULL) AS n_leaves, sum((n_convs - 1) * len)::BIGINT AS saved_tokens FROM a JOIN v ON v.p = low LEFT JOIN k ON k.p = low GROUP BY high)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (p) LEFT JOIN k USING (p) LEFT JOIN v u ON u.p = v.up"""


QUERIES = {"op1_chat": op1_chat, "op2_substring": op2_substring, "op3_simhash": op3_simhash, "op4_mixing": op4_mixing, "op5_licenses": op5_licenses, "op6_rans": op6_rans, "op7_bpe": op7_bpe, "op8_ann": op8_ann, "op9_warc": op9_warc, "op10_quality": op10_quality, "op11_merkle": op11_merkle, "op12_lines": op12_lines, "op13_trie": op13_trie}
SQL = {"op1_chat": OP1_SQL, "op2_substring": OP2_SQL, "op9_warc": OP9_SQL, "op11_merkle": OP11_SQL, "op12_lines": OP12_SQL, "op13_trie": OP13_SQL}
