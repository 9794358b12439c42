"""Queries over manifests: scans of lines, validation, joins, unions, statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as AU
from ..operators import manifest as MF
from ..sources import files as FL
from ..sources import readers as RD
from ..sources.scratch import materialize, scratch
from . import views as V

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = V.with_views(sql)
        return fn

    return add


_VALID = "json_valid(trim(line)) AND json_type(trim(line)) = 'OBJECT'"
_RECORDS = f"""SELECT line_no, j->>'$.image_path' AS image_path, j->>'$.caption' AS caption, j->>'$.mask_path' AS mask_path
  FROM (SELECT line_no, trim(line)::JSON AS j FROM (SELECT * FROM manifest_lines WHERE trim(line) <> '' AND {_VALID}) t)
  WHERE list_contains(json_keys(j), 'image_path') AND list_contains(json_keys(j), 'caption')"""


@query("s1_tolerant_jsonl", f"SELECT line_no, image_path, caption, mask_path, mask_path IS NULL AS text_only FROM ({_RECORDS})")
def s1(spark, sf):
    return MF.parse_lines(V.manifest_lines(spark, sf), "line_no").select("line_no", "image_path", "caption", "mask_path", "text_only")


@query("p1_required_keys", f"SELECT line_no, NOT (list_contains(json_keys(j), 'image_path') AND list_contains(json_keys(j), 'caption')) AS missing FROM (SELECT line_no, trim(line)::JSON AS j FROM (SELECT * FROM manifest_lines WHERE trim(line) <> '' AND {_VALID}) t)")
def p1(spark, sf):
    c = MF.classify_lines(V.manifest_lines(spark, sf))
    return c.filter(F.col("reason").isin("ok", "missing_key")).select("line_no", (F.col("reason") == "missing_key").alias("missing"))


@query("p2_text_only_flag", f"SELECT line_no, mask_path IS NULL AS text_only FROM ({_RECORDS})")
def p2(spark, sf):
    return MF.parse_lines(V.manifest_lines(spark, sf), "line_no").select("line_no", "text_only")


_REASON = f"CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(trim(line)) THEN 'bad_json' WHEN json_type(trim(line)) <> 'OBJECT' THEN 'not_object' WHEN NOT (list_contains(json_keys(trim(line)), 'image_path') AND list_contains(json_keys(trim(line)), 'caption')) THEN 'missing_key' ELSE 'ok' END"


@query("a2_load_counters", f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM manifest_lines) GROUP BY reason")
def a2(spark, sf):
    return MF.classify_lines(V.manifest_lines(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("p3_resolve_path", "SELECT doc_id, CASE WHEN p LIKE '/%' THEN p ELSE 'base/' || p END AS path FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/abs/' || image_path ELSE image_path END AS p FROM manifest)")
def p3(spark, sf):
    m = V.manifest(spark, sf).withColumn("p", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/abs/"), "image_path")).otherwise(F.col("image_path")))
    return m.select("doc_id", X.resolve_path(F.col("p"), "base").alias("path"))


def listed(spark, names: DataFrame) -> DataFrame:
    """Files of the given names (name), written to a new folder and listed: path (relative, as manifests have it), length. The list is written out, as its size is
    known only then."""
    path = scratch(spark, "files")
    FL.write_files(names, path)
    return materialize(FL.walk_files(spark, path).select(F.col("name").alias("path"), "length"), "listing")


def listing(spark, sf) -> DataFrame:
    """The image files that exist: none where the id is a multiple of 7; names in other case where it is one of 5; empty ones where it is one of 11."""
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, F.concat(F.substring_index("image_path", ".", 1), F.lit(".PNG"))).otherwise(F.col("image_path"))
    return listed(spark, V.manifest(spark, sf).filter(i % 7 != 0).select(name.alias("name"), F.when(i % 11 != 0, F.encode("grp", "utf-8")).alias("data")))


_LIST = "(SELECT image_path AS path FROM manifest WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0)"


@query("p4_resolve_or_null", f"SELECT m.doc_id, l.path AS resolved FROM manifest m LEFT JOIN {_LIST} l ON l.path = m.image_path")
def p4(spark, sf):
    return MF.resolve_existing(V.manifest(spark, sf), listing(spark, sf), "image_path").select("doc_id", "resolved")


@query("p5_join_root", "SELECT doc_id, 'root/' || image_path AS image, 'root/' || grp AS path FROM manifest")
def p5(spark, sf):
    m = V.manifest(spark, sf).select("doc_id", F.col("image_path").alias("image"), F.col("grp").alias("path"))
    return MF.prefix_paths(m, "root")


@query("p6_source_attribute", "SELECT doc_id, CASE WHEN label % 2 = 0 THEN '/mnt/' || grp END AS _image_root, CASE WHEN label % 2 = 0 THEN '/mnt/' || grp || '/' ELSE '' END || image_path AS image FROM manifest")
def p6(spark, sf):
    """Sources by group, every second label's without a root; the attribute then resolves the paths."""
    m = V.manifest(spark, sf)
    parts = [MF.with_root(m.filter(F.col("label") % 2 == k), F.concat(F.lit("/mnt/"), "grp") if k == 0 else None) for k in (0, 1)]
    return MF.union_all(parts).select("doc_id", "_image_root", F.concat_ws("/", "_image_root", "image_path").alias("image"))


_REQ = "(SELECT doc_id, mask_path, CASE WHEN doc_id % 4 = 0 THEN '' ELSE grp END AS text, CASE WHEN doc_id % 6 = 0 THEN 'None' ELSE label::VARCHAR END AS grade, doc_id % 2 = 0 AS use_mask, doc_id % 11 - 5 AS seed FROM manifest)"
_CAPTION = "CASE {} WHEN '0' THEN 'No diabetic retinopathy' WHEN '1' THEN 'Mild non-proliferative diabetic retinopathy' WHEN '2' THEN 'Moderate non-proliferative diabetic retinopathy' WHEN '3' THEN 'Severe non-proliferative diabetic retinopathy' WHEN '4' THEN 'Proliferative diabetic retinopathy' END"


def requests(spark, sf) -> DataFrame:
    m, i = V.manifest(spark, sf), F.col("doc_id")
    return m.select("doc_id", "mask_path", F.when(i % 4 == 0, "").otherwise(F.col("grp")).alias("text"), F.when(i % 6 == 0, "None").otherwise(F.col("label").cast("string")).alias("grade"), (i % 2 == 0).alias("use_mask"), (i % 11 - 5).alias("seed"))


@query("p7_request_filter", f"SELECT doc_id FROM {_REQ} WHERE NOT (mask_path IS NULL AND text = '' AND grade = 'None')")
def p7(spark, sf):
    return MF.valid_requests(requests(spark, sf)).select("doc_id")


@query("p8_caption_precedence", f"SELECT doc_id, CASE WHEN grade <> 'None' THEN {_CAPTION.format('grade')} WHEN text <> '' THEN text ELSE 'Diabetic retinopathy fundus image' END AS caption FROM {_REQ}")
def p8(spark, sf):
    return requests(spark, sf).select("doc_id", MF.request_caption().alias("caption"))


@query("p9_request_record", f"SELECT doc_id, CASE WHEN use_mask THEN mask_path END AS mask_path, CASE WHEN seed >= 0 THEN seed END AS seed, nullif(grade, 'None') AS dr_grade, use_mask FROM {_REQ}")
def p9(spark, sf):
    return MF.normalise_requests(requests(spark, sf)).select("doc_id", "mask_path", "seed", "dr_grade", "use_mask")


@query("p10_item_validity", f"SELECT m.doc_id, l.path AS image, CASE WHEN l.path IS NULL THEN '' ELSE m.caption END AS caption, CASE WHEN l.path IS NULL THEN '' ELSE m.grp END AS kind FROM manifest m LEFT JOIN {_LIST} l ON l.path = m.image_path AND m.caption IS NOT NULL")
def p10(spark, sf):
    m = MF.resolve_existing(V.manifest(spark, sf), listing(spark, sf), "image_path")
    ok = F.col("resolved").isNotNull() & F.col("caption").isNotNull()
    return m.select("doc_id", F.when(ok, F.col("resolved")).alias("image"), F.when(ok, F.col("caption")).otherwise("").alias("caption"), F.when(ok, F.col("grp")).otherwise("").alias("kind"))


_AUDIT = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/data/' || image_path WHEN doc_id % 5 = 1 THEN '/other/' || image_path WHEN doc_id % 5 = 2 THEN grp ELSE image_path END AS p FROM manifest)"


def audited(spark, sf) -> DataFrame:
    k, p = F.col("doc_id") % 5, F.col("image_path")
    return V.manifest(spark, sf).select("doc_id", F.when(k == 0, F.concat(F.lit("/data/"), p)).when(k == 1, F.concat(F.lit("/other/"), p)).when(k == 2, F.col("grp")).otherwise(p).alias("p"))


@query("p13_path_audit", f"SELECT doc_id, contains(p, '/') AS looks_like_path, NOT starts_with(p, '/') OR starts_with(p, '/data/') AS valid, CASE WHEN starts_with(p, '/') AND NOT starts_with(p, '/data/') THEN regexp_replace(p, '^/+', '') END AS suggestion FROM {_AUDIT}")
def p13(spark, sf):
    p = F.col("p")
    return audited(spark, sf).select("doc_id", AU.looks_like_path(p).alias("looks_like_path"), AU.is_valid_path(p, "/data").alias("valid"), AU.suggestion(p, "/data").alias("suggestion"))


@query("p14_flatten_config", """SELECT doc_id, key, value FROM (SELECT doc_id, unnest(['data.image_path', 'data.mask[0]', 'data.mask[1]', 'name']) AS key, unnest([image_path, grp, label::VARCHAR, grp]) AS value FROM manifest)""")
def p14(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.col("image_path"), F.array("grp", F.col("label").cast("string")).alias("mask")).alias("data"), F.col("grp").alias("name")))
    return AU.flatten_config(V.manifest(spark, sf).select("doc_id", doc.alias("config")), "config").select("doc_id", "key", "value")


_OPS = "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ': Renamed ' || event_type || ' to b' || event_id WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ': Deleted ' || event_type WHEN 2 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ': Moved x' END AS line FROM events)"


def ops_lines(spark, sf) -> DataFrame:
    e, k = V.table(spark, sf, "events"), F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.when(k == 0, F.concat(stamp, F.lit(": Renamed "), "event_type", F.lit(" to b"), "event_id")).when(k == 1, F.concat(stamp, F.lit(": Deleted "), "event_type")).when(k == 2, "").otherwise(F.concat(stamp, F.lit(": Moved x")))
    return e.select("event_id", line.alias("line"))


@query("p15_ops_log", f"SELECT event_id, regexp_extract(line, '^([^:]*:[^:]*:[^:]*):', 1) AS at, CASE WHEN line LIKE '%: Renamed %' THEN 'rename' WHEN line LIKE '%: Deleted %' THEN 'delete' ELSE 'unknown' END AS kind, CASE WHEN line LIKE '%: Renamed %' THEN regexp_extract(line, ': Renamed (\\S+) to ', 1) END AS old_path, CASE WHEN line LIKE '%: Renamed %' THEN regexp_extract(line, ' to (\\S+)$', 1) END AS new_path, CASE WHEN line LIKE '%: Deleted %' THEN regexp_extract(line, ': Deleted (\\S+)', 1) END AS path FROM {_OPS} WHERE trim(line) <> ''")
def p15(spark, sf):
    return AU.parse_ops(ops_lines(spark, sf), "line").select("event_id", "at", "kind", "old_path", "new_path", "path")


@query("s13_ops_log_lines", f"SELECT event_id, trim(line) AS line FROM {_OPS} WHERE trim(line) <> ''")
def s13(spark, sf):
    return ops_lines(spark, sf).select("event_id", X.strip(F.col("line")).alias("line")).filter(F.length("line") > 0)


@query("l7_reverse_replay", f"SELECT event_id, row_number() OVER (ORDER BY event_id DESC)::INT AS replay FROM {_OPS} WHERE trim(line) <> ''")
def l7(spark, sf):
    from ..operators.sampling import global_index

    lines = ops_lines(spark, sf).filter(F.trim("line") != "").select("event_id")
    return global_index(lines, [-F.col("event_id")]).select("event_id", (F.col("idx") + 1).cast("int").alias("replay"))


@query("p18_augmented_label", f"SELECT doc_id, coalesce(g, 0) AS label, {_CAPTION.format('coalesce(g, 0)::VARCHAR')} AS caption, NULL::VARCHAR AS mask_path FROM (SELECT doc_id, CASE WHEN mask_path IS NOT NULL THEN label END AS g FROM manifest)")
def p18(spark, sf):
    m = V.manifest(spark, sf).select("doc_id", F.when(F.col("mask_path").isNotNull(), F.col("label")).alias("g"))
    label = F.coalesce("g", F.lit(0))
    return m.select("doc_id", label.alias("label"), X.label_to_caption(label.cast("string")).alias("caption"), F.lit(None).cast("string").alias("mask_path"))


_HASH = "((doc_id * 1103515245 + {} * 12345) % 2147483648)"


@query("p20_caption_choice", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN grp WHEN 1 THEN [grp, image_path, 'x'][1 + {_HASH.format(4)} % 3] ELSE '' END AS train, CASE doc_id % 3 WHEN 0 THEN grp WHEN 1 THEN grp ELSE '' END AS infer FROM manifest")
def p20(spark, sf):
    i = F.col("doc_id") % 3
    caps = F.when(i == 0, F.array("grp")).when(i == 1, F.array("grp", "image_path", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    m = V.manifest(spark, sf).withColumn("captions", caps)
    h = X.mix_hash(F.col("doc_id"), 4)
    return m.select("doc_id", X.choose_caption(F.col("captions"), h).alias("train"), X.choose_caption(F.col("captions"), None).alias("infer"))


@query("p21_caption_dropout", f"SELECT doc_id, CASE WHEN {_HASH.format(9)} / 2147483648.0 < 0.1 THEN '' ELSE grp END AS caption FROM manifest")
def p21(spark, sf):
    return V.manifest(spark, sf).select("doc_id", X.drop_caption(F.col("grp"), X.mix_hash(F.col("doc_id"), 9), 0.1).alias("caption"))


@query("p22_label_dropout", f"SELECT doc_id, CASE WHEN {_HASH.format(5)} / 2147483648.0 < 0.2 OR doc_id % 50 = 0 THEN 5 ELSE label END AS label FROM manifest")
def p22(spark, sf):
    return V.manifest(spark, sf).select("doc_id", X.drop_label(F.col("label"), X.mix_hash(F.col("doc_id"), 5), 0.2, 5, F.col("doc_id") % 50 == 0).alias("label"))


_LABEL_TEXTS = "CASE doc_id % 4 WHEN 0 THEN label::VARCHAR WHEN 1 THEN ' ' || label || chr(9) WHEN 2 THEN '+' || label ELSE '-0' || label END"


@query("p24_label_cast", f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN -label ELSE label END AS label FROM (SELECT doc_id, label, {_LABEL_TEXTS} AS t FROM manifest)")
def p24(spark, sf):
    """Labels as texts of several forms; a text that is no integer is an error (tests)."""
    i, label = F.col("doc_id") % 4, F.col("label").cast("string")
    t = F.when(i == 0, label).when(i == 1, F.concat(F.lit(" "), label, F.lit("\t"))).when(i == 2, F.concat(F.lit("+"), label)).otherwise(F.concat(F.lit("-0"), label))
    return V.manifest(spark, sf).select("doc_id", X.integer_label(t).alias("label"))


@query("p25_mask_downgrade", "SELECT m.doc_id, d.mask AS mask, m.mask_path IS NULL OR d.mask IS NULL AS text_only FROM manifest m LEFT JOIN (SELECT mask_path AS mask FROM manifest WHERE mask_path IS NOT NULL AND doc_id % 3 <> 0) d ON d.mask = m.mask_path")
def p25(spark, sf):
    """The masks of every third document are files that break off."""
    m, path = V.manifest(spark, sf), scratch(spark, "masks")
    there = m.filter(F.col("mask_path").isNotNull()).select(F.col("mask_path").alias("name"), F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("channels"), F.array_repeat((F.col("doc_id") % 256).cast("int"), 16).alias("px"))
    cut = F.regexp_extract("name", r"(\d+)", 1).cast("long") % 3 == 0
    FL.write_files(FL.to_png(there).select("name", F.when(cut, F.substring("data", 1, 40)).otherwise(F.col("data")).alias("data")), path)
    decoded = materialize(RD.scan_masks(spark, path).select(F.regexp_extract("path", "(masks/[^/]+)$", 1).alias("mask")), "decoded")
    return MF.attach_masks(m, decoded).select("doc_id", "mask", "text_only")


_TEXTS = "CASE doc_id % 5 WHEN 0 THEN label::VARCHAR WHEN 1 THEN ' 2 ' WHEN 2 THEN '3.0' WHEN 3 THEN '9' ELSE grp END"


@query("f1_label_to_caption", f"SELECT doc_id, CASE WHEN regexp_full_match(t, '\\s*[+-]?\\d+\\s*') THEN coalesce({_CAPTION.format('trim(t)')}, 'Unknown grade: ' || trim(t)) ELSE t END AS caption FROM (SELECT doc_id, {_TEXTS} AS t FROM manifest)")
def f1(spark, sf):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.col("label").cast("string")).when(k == 1, " 2 ").when(k == 2, "3.0").when(k == 3, "9").otherwise(F.col("grp"))
    return V.manifest(spark, sf).select("doc_id", X.label_to_caption(t).alias("caption"))


@query("f2_custom_mapping", "SELECT doc_id, CASE label WHEN 0 THEN 'none' WHEN 1 THEN 'some' ELSE 'Unknown grade: ' || label END AS caption FROM manifest")
def f2(spark, sf):
    return V.manifest(spark, sf).select("doc_id", X.label_to_caption(F.col("label").cast("string"), {0: "none", 1: "some"}).alias("caption"))


@query("f3_caption_length", "SELECT doc_id, length(coalesce(caption, ''))::INT AS n FROM manifest")
def f3(spark, sf):
    return V.manifest(spark, sf).select("doc_id", F.char_length(F.coalesce("caption", F.lit(""))).alias("n"))


@query("f7_batch_id")
def f7(spark, sf):
    return V.run_log(spark, sf).select("step", X.batch_id(F.col("ts")).alias("batch_id"))


@query("s9_caption_lines", "SELECT item_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS caption FROM benchmark WHERE length(trim(text)) > 0")
def s9(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", X.strip(F.col("text")).alias("caption")).filter(F.length("caption") > 0)


# --- joins

@query("j4_existing_rows", f"SELECT m.doc_id FROM manifest m SEMI JOIN {_LIST} l ON l.path = m.image_path")
def j4(spark, sf):
    return V.manifest(spark, sf).join(listing(spark, sf), F.col("image_path") == F.col("path"), "left_semi").select("doc_id")


@query("j5_mask_existence", "SELECT m.doc_id, d.p AS mask_path, d.p IS NULL AS text_only FROM manifest m LEFT JOIN (SELECT mask_path AS p FROM manifest WHERE doc_id % 2 = 0 AND mask_path IS NOT NULL) d ON d.p = m.mask_path")
def j5(spark, sf):
    m = V.manifest(spark, sf)
    there = listed(spark, m.filter((F.col("doc_id") % 2 == 0) & F.col("mask_path").isNotNull()).select(F.col("mask_path").alias("name"), F.lit(None).cast("binary").alias("data")))
    return MF.attach_masks(m, there.select(F.col("path").alias("mask"))).select("doc_id", F.col("mask").alias("mask_path"), "text_only")


_SIDE = "(SELECT doc_id::VARCHAR AS suffix, grp AS s_caption, label AS s_grade FROM manifest WHERE doc_id % 3 = 0)"
_DEFAULT = "(SELECT grp AS dir, min(caption) AS d_caption FROM manifest WHERE doc_id % 3 = 1 GROUP BY grp)"


def sidecars(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = V.manifest(spark, sf)
    own = m.filter(F.col("doc_id") % 3 == 0).select(F.col("doc_id").cast("string").alias("suffix"), F.col("grp").alias("s_caption"), F.col("label").alias("s_grade"))
    return own, m.filter(F.col("doc_id") % 3 == 1).groupBy(F.col("grp").alias("dir")).agg(F.min("caption").alias("d_caption"))


@query("j6_sidecar_fallback", f"SELECT m.doc_id, coalesce(s.s_caption, d.d_caption) AS caption, s.s_grade AS grade FROM manifest m LEFT JOIN {_SIDE} s ON s.suffix = m.doc_id::VARCHAR LEFT JOIN {_DEFAULT} d ON d.dir = m.grp")
def j6(spark, sf):
    own, default = sidecars(spark, sf)
    images = V.manifest(spark, sf).select("doc_id", F.concat(F.lit("image_"), F.col("doc_id")).alias("stem"), F.col("grp").alias("dir"))
    return MF.with_sidecar(images.withColumn("suffix", X.stem_suffix(F.col("stem"))), own, default).select("doc_id", "caption", F.col("s_grade").alias("grade"))


@query("j7_sidecar_by_stem", f"SELECT m.doc_id, coalesce(s.s_caption, d.d_caption) AS caption FROM manifest m LEFT JOIN {_SIDE} s ON s.suffix = m.doc_id::VARCHAR LEFT JOIN {_DEFAULT} d ON d.dir = m.grp")
def j7(spark, sf):
    own, default = sidecars(spark, sf)
    images = V.manifest(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("suffix"), F.col("grp").alias("dir"))
    return MF.with_sidecar(images, own, default).select("doc_id", "caption")


@query("j8_grades_with_lesions", f"SELECT g.doc_id, g.label, a.p AS hard, b.p AS soft FROM (SELECT m.* FROM manifest m SEMI JOIN {_LIST} l ON l.path = m.image_path) g LEFT JOIN (SELECT doc_id, 'hard/' || doc_id AS p FROM manifest WHERE doc_id % 2 = 0) a USING (doc_id) LEFT JOIN (SELECT doc_id, 'soft/' || doc_id AS p FROM manifest WHERE doc_id % 3 = 0) b USING (doc_id)")
def j8(spark, sf):
    m = V.manifest(spark, sf)
    one = lambda kind, k: m.filter(F.col("doc_id") % k == 0).select("doc_id", F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}/"), F.col("doc_id")).alias("p"))
    return MF.grades_with_lesions(m.select("doc_id", "label", "image_path"), listing(spark, sf), one("hard", 2).unionByName(one("soft", 3)), ("hard", "soft")).select("doc_id", "label", "hard", "soft")


@query("j12_label_dimension", f"SELECT doc_id, label, {_CAPTION.format('label::VARCHAR')} AS grade_text FROM manifest")
def j12(spark, sf):
    dim = spark.createDataFrame(sorted(X.GRADES.items()), "grade int, grade_text string")
    return V.manifest(spark, sf).join(F.broadcast(dim), F.col("label") == F.col("grade"), "left").select("doc_id", "label", "grade_text")


# --- unions

@query("u1_union_files", "SELECT doc_id, grp FROM manifest WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, grp FROM manifest WHERE doc_id % 2 = 1")
def u1(spark, sf):
    m = V.manifest(spark, sf).select("doc_id", "grp")
    return MF.union_all([m.filter(F.col("doc_id") % 2 == 0), m.filter(F.col("doc_id") % 2 == 1)])


@query("u2_generated_and_original", "SELECT image_path, caption, mask_path, 'generated' AS source FROM manifest WHERE doc_id % 4 = 0 UNION ALL SELECT image_path, '' AS caption, NULL AS mask_path, 'original' AS source FROM manifest WHERE doc_id % 4 <> 0")
def u2(spark, sf):
    m = V.manifest(spark, sf)
    return MF.tagged_union(m.filter(F.col("doc_id") % 4 == 0).select("image_path", "caption", "mask_path"), m.filter(F.col("doc_id") % 4 != 0).select("image_path"))


@query("u3_original_and_augmented", "SELECT doc_id, label FROM manifest UNION ALL SELECT doc_id, label FROM manifest WHERE doc_id % 3 = 0")
def u3(spark, sf):
    m = V.manifest(spark, sf).select("doc_id", "label")
    return m.unionByName(m.filter(F.col("doc_id") % 3 == 0))


@query("u4_type_major", "SELECT doc_id, grp, (row_number() OVER (ORDER BY grp, doc_id) - 1)::BIGINT AS idx FROM manifest")
def u4(spark, sf):
    from ..operators.sampling import global_index

    return global_index(V.manifest(spark, sf).select("doc_id", "grp"), ["grp", "doc_id"]).select("doc_id", "grp", "idx")


# --- statistics

@query("a1_manifest_statistics", "SELECT count(*) AS total, count(mask_path) AS with_mask, count(*) - count(mask_path) AS text_only, round(100.0 * count(mask_path) / count(*), 6) AS with_mask_pct, round(100.0 * (count(*) - count(mask_path)) / count(*), 6) AS text_only_pct, min(length(coalesce(caption, '')))::INT AS min_len, max(length(coalesce(caption, '')))::INT AS max_len, round(avg(length(coalesce(caption, ''))), 6) AS avg_len FROM manifest")
def a1(spark, sf):
    return MF.statistics(V.manifest(spark, sf))


@query("a10_batch_summary", "SELECT doc_id // 16 AS batch, count(*) AS n, string_agg(doc_id || ':' || grp, ',' ORDER BY doc_id) AS results FROM manifest GROUP BY 1")
def a10(spark, sf):
    b = V.manifest(spark, sf).groupBy(F.floor(F.col("doc_id") / 16).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "grp"))).alias("r"))
    return b.select("batch", "n", F.array_join(F.transform("r", lambda x: F.concat(x["doc_id"], F.lit(":"), x["grp"])), ",").alias("results"))


@query("a11_rows_per_tag", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'generated' ELSE 'original' END AS source, count(*) AS n FROM manifest GROUP BY 1")
def a11(spark, sf):
    return u2(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("a12_rows_per_file_and_type", "SELECT grp, label, count(*) AS n FROM manifest GROUP BY ROLLUP (grp, label)")
def a12(spark, sf):
    return V.manifest(spark, sf).rollup("grp", "label").agg(F.count(F.lit(1)).alias("n"))


@query("w14_line_numbers", "SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)")
def w14(spark, sf):
    return MF.numbered_lines(V.table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


# --- jobs

@query("e1_ingest", f"SELECT line_no, image_path, caption, CASE WHEN line_no % 4 = 0 THEN mask_path END AS mask_path, CASE WHEN line_no % 4 = 0 THEN mask_path END IS NULL AS text_only FROM ({_RECORDS}) WHERE line_no % 7 <> 0")
def e1(spark, sf):
    lines = V.manifest_lines(spark, sf)
    records = MF.parse_lines(lines, "line_no")
    i, k = F.col("line_no"), F.col("line_no") % 10
    file = lambda folder: F.concat(F.lit(folder), i, F.lit(".png"))
    names = F.filter(F.array(F.when((i % 7 != 0) & (k > 2), file("img/")), F.when((i % 4 == 0) & k.between(4, 6), file("m/"))), lambda x: x.isNotNull())
    files = listed(spark, lines.select(F.explode(names).alias("name"), F.lit(None).cast("binary").alias("data")))
    kept = records.join(files, F.col("image_path") == F.col("path"), "left_semi")
    there = files.filter(F.col("path").startswith("m/")).select(F.col("path").alias("mask"))
    return MF.attach_masks(kept, there).select("line_no", "image_path", "caption", F.col("mask").alias("mask_path"), "text_only")


@query("e6_training_export", f"SELECT 'generated' AS source, m.image_path, coalesce(s.s_caption, d.d_caption, '') AS caption FROM manifest m LEFT JOIN {_SIDE} s ON s.suffix = m.doc_id::VARCHAR LEFT JOIN {_DEFAULT} d ON d.dir = m.grp WHERE m.doc_id % 4 = 0 UNION ALL SELECT 'original', image_path, '' FROM manifest WHERE doc_id % 4 <> 0")
def e6(spark, sf):
    own, default = sidecars(spark, sf)
    m = V.manifest(spark, sf)
    made = MF.with_sidecar(m.filter(F.col("doc_id") % 4 == 0).select("image_path", F.col("doc_id").cast("string").alias("suffix"), F.col("grp").alias("dir")), own, default)
    return MF.tagged_union(made.select("image_path", F.coalesce("caption", F.lit("")).alias("caption"), F.lit(None).cast("string").alias("mask_path")), m.filter(F.col("doc_id") % 4 != 0).select("image_path")).select("source", "image_path", "caption")


@query("e8_dataset_preparation", f"SELECT g.doc_id, g.label, coalesce(a.p, b.p) AS lesion, CASE WHEN pos % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM manifest) g LEFT JOIN (SELECT doc_id, 'hard/' || doc_id AS p FROM manifest WHERE doc_id % 2 = 0) a USING (doc_id) LEFT JOIN (SELECT doc_id, 'soft/' || doc_id AS p FROM manifest WHERE doc_id % 3 = 0) b USING (doc_id) SEMI JOIN {_LIST} l ON l.path = g.image_path")
def e8(spark, sf):
    from ..operators.sampling import global_index, split_by_position

    split = split_by_position(global_index(V.manifest(spark, sf).select("doc_id"), ["doc_id"])).select("doc_id", "split")
    return j8(spark, sf).join(split, "doc_id").select("doc_id", "label", F.coalesce("hard", "soft").alias("lesion"), "split")


@query("e9_batches", """WITH r AS (SELECT g.image_id, g.image_id // 4 AS batch, m.image_id IS NOT NULL AS masked, unnest(range(0, 64)) AS i, unnest(coalesce(m.px, list_transform(range(0, 64), lambda i: 0))) AS v FROM gray_images g LEFT JOIN masks m USING (image_id))
SELECT batch, count(DISTINCT image_id) AS n, count(DISTINCT image_id) FILTER (masked) AS with_mask, array_to_string(list(v::INT ORDER BY image_id, i), ',') AS masks FROM r GROUP BY batch""")
def e9(spark, sf):
    """Batches of four images with their masks; text-only rows get zero masks of the image's size."""
    from ..functions import image as I

    m = V.masks(spark, sf).select("image_id", F.col("px").alias("mask"))
    rows = V.gray_images(spark, sf).select("image_id", "height", "width").join(m, "image_id", "left")
    rows = rows.select(F.floor(F.col("image_id") / 4).alias("batch"), F.struct("image_id", I.zero_mask(F.col("mask"), F.col("height"), F.col("width")).cast("array<int>").alias("m")).alias("r"), F.col("mask").isNotNull().cast("long").alias("masked"))
    b = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("masked").alias("with_mask"), F.sort_array(F.collect_list("r")).alias("r"))
    return b.select("batch", "n", "with_mask", F.array_join(F.flatten(F.transform("r", lambda x: x["m"])).cast("array<string>"), ",").alias("masks"))


def item_view(items: DataFrame, images: DataFrame, masks: DataFrame, size: int, auto_caption: bool) -> DataFrame:
    """``items``: doc_id, label, caption. Training items: the prepared image, the caption (``auto_caption``: that of the label), the mask resized to the image
    or null, and whether the item is text-only."""
    from ..functions import image as I
    from ..operators import kernels as K

    pixels = materialize(K.map_images(images, lambda im, _: K.prepare(im, size)).select(F.col("image_id").alias("pid"), "px"), "items-pixels")
    m = masks.select(F.col("image_id").alias("mid"), I.nearest_resize(F.col("px"), F.col("height"), F.col("width"), size, size).alias("mask"))
    out = items.join(pixels.hint("merge"), F.col("doc_id") == F.col("pid")).join(m.hint("merge"), F.col("doc_id") == F.col("mid"), "left")
    caption = X.label_to_caption(F.col("label").cast("string")) if auto_caption else F.col("caption")
    return out.select("doc_id", caption.alias("caption"), F.col("mask").isNull().alias("text_only"), "mask", "px")


def _items_sql() -> str:
    from .q_images import _GRAY, _MICRO, _PREPARED, gathered_sql, resample_sql

    value = _MICRO.format(_PREPARED)
    px = gathered_sql(resample_sql(_GRAY, 8, 4), f"concat({value}, ',', {value}, ',', {value})")
    half = "array_to_string(list_transform(range(0, 16), lambda k: px[(2 * (k // 4) + 1) * 8 + 2 * (k % 4) + 2]), ',')"
    return f"SELECT doc_id, {_CAPTION.format('label::VARCHAR')} AS caption, m.image_id IS NULL AS text_only, {half.replace('px[', 'm.px[')} AS mask, p.px FROM manifest d JOIN ({px}) p ON p.image_id = d.doc_id LEFT JOIN masks m ON m.image_id = d.doc_id"


@query("e11_item_view", _items_sql())
def e11(spark, sf):
    items = item_view(V.manifest(spark, sf).select("doc_id", "label", "caption"), V.gray_images(spark, sf), V.masks(spark, sf), 4, auto_caption=True)
    px = F.array_join(F.transform("px", lambda v: F.round(v * 1e6).cast("long").cast("string")), ",")
    return items.select("doc_id", "caption", "text_only", F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"), px.alias("px"))
