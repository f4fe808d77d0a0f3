"""The registered queries of the snapshot engine and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, codec
from ..operators import audit, compare, history, packs, trees
from ..operators.storage import written
from . import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VF = f"WITH RECURSIVE {fixture.SQL}"


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL (`{VF}` opens the fixture's WITH)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{VF}", VF)
        return f

    return add


# ---------------------------------------------------------------- diffs

_DIFF = """, a AS (SELECT path, blob_hash AS old_hash FROM vf WHERE snapshot_id = {0}), b AS (SELECT path, blob_hash AS new_hash FROM vf WHERE snapshot_id = {1}),
d AS (SELECT path, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed' WHEN old_hash <> new_hash THEN 'modified' ELSE 'unchanged' END AS change, old_hash, new_hash FROM a FULL OUTER JOIN b USING (path))"""


@query("{VF}" + _DIFF.format(2, 3) + " SELECT * FROM d")
def diff_snapshots(spark, sf):
    f = fixture.files(spark, sf)
    return compare.diff(f.where("snapshot_id = 2"), f.where("snapshot_id = 3"))


@query("{VF}" + _DIFF.format(2, 3) + " SELECT count(*) FILTER (change='added') AS added, count(*) FILTER (change='modified') AS modified, count(*) FILTER (change='removed') AS removed, count(*) FILTER (change='unchanged') AS unchanged, count(*) FILTER (change<>'unchanged') = 0 AS is_empty FROM d")
def diff_summary(spark, sf):
    return compare.diff_summary(diff_snapshots(spark, sf))


@query("{VF}" + _DIFF.format(4, 3) + " SELECT * FROM d WHERE change <> 'unchanged'")
def restore_preview(spark, sf):
    f = fixture.files(spark, sf)
    return compare.restore_preview(f.where("snapshot_id = 4"), f.where("snapshot_id = 3"))


# ---------------------------------------------------------------- deduplication and reports

_STATS = """, n AS (SELECT *, row_number() OVER (PARTITION BY blob_hash ORDER BY snapshot_id, string_split(path, '/')) = 1 AS is_new FROM vf),
st AS (SELECT snapshot_id, count(*) AS files, count(*) FILTER (is_new) AS new_objects, count(*) FILTER (NOT is_new) AS reused_objects, sum(size)::BIGINT AS original_bytes, coalesce(sum(size) FILTER (is_new), 0)::BIGINT AS new_bytes FROM n GROUP BY ALL)"""


@query("{VF}" + _STATS + " SELECT * FROM st")
def snapshot_stats(spark, sf):
    return compare.snapshot_stats(fixture.files(spark, sf))


@query("{VF}" + _STATS + """ SELECT snapshot_id, files, new_objects, reused_objects, round(100.0::DOUBLE * reused_objects / files, 4) AS dedup_ratio_pct, original_bytes, new_bytes AS stored_bytes,
greatest(0, original_bytes - new_bytes) AS storage_saved_bytes, round(100.0::DOUBLE * greatest(0, original_bytes - new_bytes) / original_bytes, 4) AS storage_saved_pct FROM st""")
def explain_snapshot(spark, sf):
    return compare.explain(snapshot_stats(spark, sf))


_SNAPS = """, s AS (SELECT snapshot_id AS id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS parent, files, bytes FROM (SELECT snapshot_id, count(*) AS files, sum(size)::BIGINT AS bytes FROM vf GROUP BY 1))"""


@query("{VF}" + _SNAPS + " SELECT id, parent, (1000 + id)::DOUBLE AS timestamp, files, bytes FROM s")
def list_snapshots(spark, sf):
    totals = fixture.files(spark, sf).groupBy("snapshot_id").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
    live = history.adjacent(totals)  # a row per snapshot
    return totals.join(live, "snapshot_id").select(F.col("snapshot_id").alias("id"), F.col("previous").alias("parent"), (F.col("snapshot_id") + 1000).cast("double").alias("timestamp"), "files", "bytes")


@query("""{VF}, o AS (SELECT blob_hash, max(size) AS size FROM vf GROUP BY 1) SELECT (SELECT count(*) FROM vf) AS total_files, (SELECT sum(size)::BIGINT FROM vf) AS total_snapshot_data_bytes, count(*) AS objects, sum(size)::BIGINT AS stored_on_disk_bytes,
4::BIGINT AS snapshots, 4::BIGINT AS last_snapshot, (SELECT count(*) FROM documents WHERE doc_id % 97 = 0) AS corrupted_count, (SELECT count(*) FROM documents WHERE doc_id % 97 = 0) = 0 AS integrity_ok FROM o""")
def repo_status(spark, sf):
    return compare.status(fixture.files(spark, sf), list_snapshots(spark, sf), verify_objects(spark, sf))


@query("{VF} SELECT blob_hash AS obj_hash, max(size) AS size, count(*) AS n_files FROM vf GROUP BY 1")
def dedup_objects(spark, sf):
    return compare.objects(fixture.files(spark, sf))


@query("{VF} SELECT blob_hash AS obj_hash, count(*) AS n_files, string_agg(DISTINCT path, '|' ORDER BY path) AS names FROM vf GROUP BY 1 HAVING count(DISTINCT path) > 1")
def dedup_groups(spark, sf):
    return compare.dedup_groups(fixture.files(spark, sf)).withColumn("names", F.array_join("names", "|"))


@query("{VF}, a AS (SELECT DISTINCT blob_hash FROM vf WHERE snapshot_id = 4) SELECT DISTINCT blob_hash AS obj_hash, size FROM vf WHERE snapshot_id = 3 AND blob_hash NOT IN (SELECT blob_hash FROM a)")
def put_new_objects(spark, sf):
    f = fixture.files(spark, sf).select("snapshot_id", F.col("blob_hash").alias("obj_hash"), "size")
    return compare.new_objects(f.where("snapshot_id = 3").drop("snapshot_id"), f.where("snapshot_id = 4"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(text) = sha256(concat(text, '')) AS same FROM documents")
def content_hash(spark, sf):
    h = binary.content_hash(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", h.alias("content_hash"), (h == binary.content_hash(F.col("text").cast("binary"))).alias("same"))


@query("{VF} SELECT count(*) AS rows, count(DISTINCT blob_hash) AS distinct_hashes, count(*) - count(DISTINCT blob_hash) AS duplicates FROM vf")
def duplicate_ids(spark, sf):
    return fixture.files(spark, sf).agg(F.count("*").alias("rows"), F.countDistinct("blob_hash").alias("distinct_hashes")).withColumn("duplicates", F.col("rows") - F.col("distinct_hashes"))


@query("{VF} SELECT a.blob_hash AS obj_hash, CASE WHEN blob_hash IN (SELECT blob_hash FROM vf WHERE snapshot_id = 4) THEN 0 ELSE 1 END::INTEGER AS tier FROM (SELECT DISTINCT blob_hash FROM vf WHERE snapshot_id IN (3, 4)) a")
def tiered_lookup(spark, sf):
    f = fixture.files(spark, sf).select("snapshot_id", F.col("blob_hash").alias("obj_hash"))
    return packs.tiered([f.where("snapshot_id = 4"), f.where("snapshot_id = 3")])


@query("{VF}, a AS (SELECT DISTINCT blob_hash FROM vf WHERE snapshot_id = 1), b AS (SELECT DISTINCT blob_hash FROM vf WHERE snapshot_id = 4) SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS in_any, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS in_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_last")
def hash_set_operations(spark, sf):
    f = fixture.files(spark, sf)
    sides = f.where("snapshot_id IN (1, 4)").groupBy("blob_hash").agg(F.bool_or(F.col("snapshot_id") == 1).alias("a"), F.bool_or(F.col("snapshot_id") == 4).alias("b"))
    return sides.agg(F.count("*").alias("in_any"), F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_last"))


# ---------------------------------------------------------------- trees

_ENTRY = "concat(kindhex, lpad(printf('%X', octet_length(encode(name))), 4, '0'), hex(name), hex(child))"
_HASH = f"sha256(from_hex(string_agg({_ENTRY}, '' ORDER BY encode(name))))"
_TREES = f""", p AS (SELECT snapshot_id, string_split(path, '/') AS parts, blob_hash FROM vf),
e4 AS (SELECT snapshot_id, array_to_string(parts[1:3], '/') AS dir, parts[4] AS name, '62' AS kindhex, blob_hash AS child FROM p WHERE len(parts) = 4),
h4 AS (SELECT snapshot_id, dir, {_HASH} AS tree_hash FROM e4 GROUP BY ALL),
e3 AS (SELECT snapshot_id, array_to_string(parts[1:2], '/') AS dir, parts[3] AS name, '62' AS kindhex, blob_hash AS child FROM p WHERE len(parts) = 3
       UNION ALL SELECT snapshot_id, array_to_string(string_split(dir, '/')[1:2], '/'), string_split(dir, '/')[3], '74', tree_hash FROM h4),
h3 AS (SELECT snapshot_id, dir, {_HASH} AS tree_hash FROM e3 GROUP BY ALL),
e2 AS (SELECT snapshot_id, string_split(dir, '/')[1] AS dir, string_split(dir, '/')[2] AS name, '74' AS kindhex, tree_hash AS child FROM h3),
h2 AS (SELECT snapshot_id, dir, {_HASH} AS tree_hash FROM e2 GROUP BY ALL),
e1 AS (SELECT snapshot_id, '' AS dir, dir AS name, '74' AS kindhex, tree_hash AS child FROM h2),
h1 AS (SELECT snapshot_id, dir, {_HASH} AS tree_hash FROM e1 GROUP BY ALL),
th AS (FROM h4 UNION ALL FROM h3 UNION ALL FROM h2 UNION ALL FROM h1),
te AS (SELECT snapshot_id, dir, name, CASE kindhex WHEN '62' THEN 'blob' ELSE 'tree' END AS kind, child AS child_hash FROM (FROM e4 UNION ALL FROM e3 UNION ALL FROM e2 UNION ALL FROM e1))"""
_WALK = """, w(snapshot_id, path, kind, object, depth) AS (
  SELECT snapshot_id, name, kind, child_hash, 1 FROM te WHERE dir = ''
  UNION ALL SELECT w.snapshot_id, concat(w.path, '/', te.name), te.kind, te.child_hash, w.depth + 1 FROM w JOIN te ON w.kind = 'tree' AND te.snapshot_id = w.snapshot_id AND te.dir = w.path)"""


def _trees(spark, sf):
    return trees.build_trees(fixture.files(spark, sf))


def _walked(spark, sf):
    entries, roots = _trees(spark, sf)
    return trees.walk(entries, roots), entries, roots


@query("{VF}" + _TREES + " SELECT snapshot_id, dir, tree_hash FROM th")
def merkle_dir_hash(spark, sf):
    return _trees(spark, sf)[0].select("snapshot_id", "dir", "tree_hash").distinct()


@query("{VF}" + _TREES + " SELECT snapshot_id, tree_hash AS root_tree_hash FROM h1")
def merkle_root(spark, sf):
    return trees.tree_roots(trees.tree_levels(fixture.files(spark, sf)))


@query("{VF}" + _TREES + " SELECT te.snapshot_id, tree_hash, te.dir, name, kind, child_hash FROM te JOIN th USING (snapshot_id, dir)")
def tree_entries(spark, sf):
    return _trees(spark, sf)[0].select("snapshot_id", "tree_hash", "dir", "name", "kind", "child_hash")


@query("{VF} SELECT snapshot_id, path, blob_hash FROM vf")
def flatten_tree(spark, sf):
    return trees.flatten(_walked(spark, sf)[0])


@query("{VF}" + _TREES + _WALK + " SELECT row_number() OVER (ORDER BY string_split(w.path, '/')) AS place, w.path, w.kind, s.size, object FROM w LEFT JOIN (SELECT DISTINCT blob_hash, size FROM vf) s ON w.kind = 'blob' AND s.blob_hash = object WHERE snapshot_id = 4")
def show_snapshot(spark, sf):
    walked = _walked(spark, sf)[0].where("snapshot_id = 4")
    sizes = fixture.files(spark, sf).groupBy(F.col("blob_hash").alias("object")).agg(F.max("size").alias("size"))
    from pyspark.sql import Window

    parts = F.split("path", "/")
    top = walked.groupBy(parts[0].alias("top")).agg(F.count("*").alias("n"))  # a row per top entry
    before = top.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = walked.withColumn("top", parts[0]).join(before, "top")
    place = F.row_number().over(Window.partitionBy("top").orderBy(parts)) + F.col("before")
    return rows.select(place.cast("long").alias("place"), "path", "kind", "object").join(sizes, "object", "left").select("place", "path", "kind", F.when(F.col("kind") == "blob", F.col("size")).alias("size"), "object")


_REACH = _TREES + ", reach AS (SELECT snapshot_id, child_hash AS object FROM te UNION SELECT snapshot_id, tree_hash FROM h1)"


@query("{VF}" + _REACH + " SELECT object, string_agg(snapshot_id::VARCHAR, ',' ORDER BY snapshot_id) AS snapshots FROM reach GROUP BY 1")
def reachable_objects(spark, sf):
    return trees.reachable(*_trees(spark, sf)).groupBy("object").agg(F.array_join(F.transform(F.sort_array(F.collect_set("snapshot_id")), lambda x: x.cast("string")), ",").alias("snapshots"))


@query("{VF}" + _REACH + " SELECT DISTINCT object AS obj_hash FROM reach WHERE object NOT IN (SELECT object FROM reach WHERE snapshot_id <> 2)")
def gc_garbage(spark, sf):
    reach = trees.reachable(*_trees(spark, sf))
    return audit.garbage(reach.select(F.col("object").alias("obj_hash")).distinct(), reach.where("snapshot_id <> 2"))


_CANDIDATES = """, edges AS (SELECT n.snapshot_id AS sid, n.path, n.blob_hash AS nw, o.blob_hash AS od FROM vf n JOIN vf o ON o.snapshot_id = n.snapshot_id - 1 AND o.path = n.path AND o.blob_hash <> n.blob_hash),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sid, encode(path)) AS i, nw, od FROM edges),
fold(i, m) AS (SELECT 0::BIGINT, MAP {}::MAP(VARCHAR, VARCHAR) UNION ALL
  SELECT fold.i + 1, CASE WHEN len(m[od]) > 0 THEN m ELSE map_concat(m, MAP {nw: od}) END FROM fold JOIN numbered e ON e.i = fold.i + 1),
cand AS MATERIALIZED (SELECT unnest(map_entries(m), recursive := true) FROM (SELECT m FROM fold ORDER BY i DESC LIMIT 1))"""


@query("{VF}, edges AS (SELECT DISTINCT n.blob_hash AS target, o.blob_hash AS base FROM vf n JOIN vf o ON o.snapshot_id = n.snapshot_id - 1 AND o.path = n.path AND o.blob_hash <> n.blob_hash), c(owner, object) AS (SELECT DISTINCT blob_hash, blob_hash FROM vf WHERE snapshot_id = 4 UNION SELECT c.owner, e.base FROM c JOIN edges e ON e.target = c.object) SELECT DISTINCT object FROM c")
def delta_gc_closure(spark, sf):
    f = fixture.files(spark, sf)
    links = written(history.modified_edges(f).select(F.col("nw").alias("target"), F.col("od").alias("base")).distinct(), "links")
    start = f.where("snapshot_id = 4").select(F.col("blob_hash").alias("owner"), F.col("blob_hash").alias("object"))
    return trees.closure(links, start).select("object").distinct()


_TRACED = "(SELECT min(blob_hash) FROM (SELECT blob_hash FROM vf GROUP BY 1 HAVING count(DISTINCT path) > 1))"


@query("{VF} SELECT snapshot_id, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM vf WHERE blob_hash = " + _TRACED + " GROUP BY 1")
def trace_object(spark, sf):
    walked, _, roots = _walked(spark, sf)
    found = fixture.files(spark, sf).groupBy("blob_hash").agg(F.countDistinct("path").alias("n")).where("n > 1").agg(F.min("blob_hash")).first()[0]
    return audit.trace(walked, roots, found or "").withColumn("paths", F.array_join("paths", "|"))


# ---------------------------------------------------------------- audits


def _stored(spark, sf):
    """An object table with planted damage: documents divisible by 97 lost their last byte's value."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.sha2("text", 256).alias("obj_hash"), F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))


@query("SELECT sha256(text) AS obj_hash, sha256(concat(text, '!')) AS actual FROM documents WHERE doc_id % 97 = 0")
def verify_objects(spark, sf):
    return audit.verify(_stored(spark, sf))


_RECOVER = """, ref AS (SELECT path, CASE WHEN path LIKE '%3.txt' AND blob_hash LIKE '0%' THEN 'zz' || blob_hash ELSE blob_hash END AS object FROM vf WHERE snapshot_id = 4),
first AS (SELECT object, arg_min(path, string_split(path, '/')) AS place FROM ref GROUP BY 1),
obj AS (SELECT DISTINCT blob_hash AS obj_hash, blob_hash NOT LIKE '1%' AS ok FROM vf WHERE blob_hash NOT LIKE 'a%'),
quar AS (SELECT DISTINCT blob_hash AS obj_hash, 'pack-' || substr(blob_hash, 2, 1) AS pack_name FROM vf WHERE blob_hash LIKE 'a%' AND substr(blob_hash, 2, 1) < '8'),
man AS (SELECT DISTINCT n.blob_hash AS target, o.blob_hash AS base FROM vf n JOIN vf o ON o.snapshot_id = 3 AND n.snapshot_id = 4 AND o.path = n.path AND o.blob_hash <> n.blob_hash),
iss AS (SELECT place, object, CASE WHEN NOT regexp_full_match(object, '[0-9a-f]{64}') THEN 'malformed hash' WHEN ok IS NULL AND pack_name IS NOT NULL THEN 'stranded in ' || pack_name WHEN ok IS NULL THEN 'missing' WHEN NOT ok THEN 'corrupted' END AS detail
  FROM first LEFT JOIN obj ON obj.obj_hash = object LEFT JOIN quar ON quar.obj_hash = object
  UNION ALL SELECT place, base, 'missing delta base' FROM first JOIN man ON man.target = object WHERE base NOT IN (SELECT obj_hash FROM obj))"""


def _recover(spark, sf):
    f = fixture.files(spark, sf)
    bad = F.col("path").like("%3.txt") & F.col("blob_hash").like("0%")
    refs = f.where("snapshot_id = 4").select("path", F.when(bad, F.concat(F.lit("zz"), "blob_hash")).otherwise(F.col("blob_hash")).alias("object"))
    objs = f.where("blob_hash NOT LIKE 'a%'").select(F.col("blob_hash").alias("obj_hash"), (~F.col("blob_hash").like("1%")).alias("ok")).distinct()
    quarantined = f.where("blob_hash LIKE 'a%' AND substr(blob_hash, 2, 1) < '8'").select(F.col("blob_hash").alias("obj_hash"), F.concat(F.lit("pack-"), F.substring("blob_hash", 2, 1)).alias("pack_name")).distinct()
    manifest = history.modified_edges(f).where("sid = 4").select(F.col("nw").alias("target"), F.col("od").alias("base")).distinct()
    return refs, objs, quarantined, manifest, audit.recover_issues(refs, objs, manifest, quarantined)


@query("{VF}" + _RECOVER + " SELECT place AS path, object, detail FROM iss WHERE detail IS NOT NULL")
def recover_check(spark, sf):
    return _recover(spark, sf)[-1].withColumnRenamed("where", "path")


@query("{VF}" + _RECOVER + " SELECT (SELECT count(*) FROM first) AS objects_checked, (SELECT count(*) FROM first WHERE object IN (SELECT obj_hash FROM quar)) AS packed_objects, (SELECT count(DISTINCT target) FROM first JOIN man ON target = object) AS delta_dependencies, count(*) AS issues, count(*) = 0 AS recoverable FROM iss WHERE detail IS NOT NULL")
def recover_summary(spark, sf):
    refs, _, quarantined, manifest, issues = _recover(spark, sf)
    return audit.recover_report(refs, issues, quarantined, manifest)


_INDEX = """, e AS (SELECT DISTINCT 'pack-' || (1 + snapshot_id % 2) AS pack_name, blob_hash AS obj_hash, size AS length FROM vf),
idx AS (SELECT pack_name, obj_hash, (8 + coalesce(sum(length) OVER (PARTITION BY pack_name ORDER BY obj_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", length FROM e)"""


def _index(spark, sf):
    e = fixture.files(spark, sf).select(F.concat(F.lit("pack-"), (1 + F.col("snapshot_id") % 2).cast("string")).alias("pack_name"), F.col("blob_hash").alias("obj_hash"), F.col("size").alias("length")).distinct()
    return packs.pack_offsets(e)


@query("{VF}" + _INDEX + ' SELECT pack_name, obj_hash, "offset", length FROM idx')
def pack_offsets(spark, sf):
    return _index(spark, sf)


@query("{VF}, n AS (SELECT ('0x' || substr(blob_hash, 1, 2))::INTEGER AS b, count(DISTINCT blob_hash) AS n FROM vf GROUP BY 1) SELECT r.range AS bucket, (sum(coalesce(n, 0)) OVER (ORDER BY r.range))::BIGINT AS cumulative FROM range(256) r LEFT JOIN n ON n.b = r.range")
def fanout_table(spark, sf):
    return packs.fanout(fixture.files(spark, sf).select(F.col("blob_hash").alias("obj_hash")).distinct())


@query("{VF}" + _INDEX + ', probe AS (SELECT DISTINCT blob_hash AS obj_hash FROM vf WHERE snapshot_id = 4) SELECT obj_hash, max(pack_name) AS pack_name, arg_max("offset", pack_name) AS "offset", arg_max(length, pack_name) AS length FROM idx WHERE obj_hash IN (FROM probe) GROUP BY 1')
def pack_point_lookup(spark, sf):
    probe = fixture.snapshot(spark, sf, 4).select(F.col("blob_hash").alias("obj_hash")).distinct()
    return packs.locate(_index(spark, sf).join(probe, "obj_hash", "left_semi"))


_BOUNDS = """, bad AS (SELECT pack_name, obj_hash, CASE WHEN obj_hash LIKE 'ff%' THEN "offset" - 9000000000 ELSE "offset" END AS "offset", CASE WHEN obj_hash LIKE 'f0%' THEN -1 ELSE length END AS length FROM idx),
chk AS (SELECT pack_name, obj_hash, CASE WHEN "offset" < 8 THEN 'offset inside header' WHEN length < 0 THEN 'negative length' WHEN "offset" + length > 3000000 THEN 'entry passes end' END AS reason FROM bad)"""


@query("{VF}" + _INDEX + _BOUNDS + " SELECT pack_name, arg_min(reason, obj_hash) AS reason FROM chk WHERE reason IS NOT NULL GROUP BY 1")
def pack_bounds_check(spark, sf):
    bad = _index(spark, sf).select("pack_name", "obj_hash", F.when(F.col("obj_hash").like("ff%"), F.col("offset") - 9000000000).otherwise(F.col("offset")).alias("offset"), F.when(F.col("obj_hash").like("f0%"), -1).otherwise(F.col("length")).alias("length"))
    sizes = bad.select("pack_name").distinct().select("pack_name", F.lit(3000000).cast("long").alias("size"), F.lit("PACK").alias("magic"))
    return packs.bounds_problems(bad, sizes)


# ---------------------------------------------------------------- history

_HISTORY = ", hist AS (SELECT path, snapshot_id, blob_hash FROM (SELECT *, lag(blob_hash) OVER (PARTITION BY path ORDER BY snapshot_id) AS b FROM vf) WHERE b IS NULL OR b <> blob_hash)"
_RENAMES = """, gone AS (SELECT a.snapshot_id + 1 AS sid, a.path, a.blob_hash FROM vf a WHERE a.snapshot_id < 4 AND NOT EXISTS (FROM vf b WHERE b.snapshot_id = a.snapshot_id + 1 AND b.path = a.path)),
come AS (SELECT a.snapshot_id AS sid, a.path, a.blob_hash FROM vf a WHERE a.snapshot_id > 1 AND NOT EXISTS (FROM vf b WHERE b.snapshot_id = a.snapshot_id - 1 AND b.path = a.path)),
ren AS (SELECT g.path AS old_path, c.path AS new_path, sid AS snapshot_id FROM (SELECT sid, blob_hash, min(path) AS path FROM gone GROUP BY 1, 2 HAVING count(*) = 1) g JOIN (SELECT sid, blob_hash, min(path) AS path FROM come GROUP BY 1, 2 HAVING count(*) = 1) c USING (sid, blob_hash))"""
_CHAIN = """, later AS (SELECT old_path, arg_max(new_path, snapshot_id) AS nxt FROM ren GROUP BY 1), earlier AS (SELECT new_path, arg_max(old_path, snapshot_id) AS prior FROM ren GROUP BY 1),
start AS (SELECT max(new_path) AS p FROM ren),
back(name, place, seen) AS (SELECT p, 0, [p] FROM start UNION ALL SELECT prior, place - 1, list_append(seen, prior) FROM back JOIN earlier ON new_path = name WHERE NOT list_contains(seen, prior)),
forth(name, place, seen) AS (SELECT p, 0, [p] FROM start UNION ALL SELECT nxt, place + 1, list_append(seen, nxt) FROM forth JOIN later ON old_path = name WHERE NOT list_contains(seen, nxt)),
chain AS (SELECT name, min(place) AS place FROM (SELECT name, place FROM back UNION ALL SELECT name, place FROM forth) WHERE name IS NOT NULL GROUP BY 1)"""


@query("{VF}" + _HISTORY + " SELECT * FROM hist")
def path_history(spark, sf):
    return history.path_history(fixture.files(spark, sf))


@query("{VF}" + _RENAMES + " SELECT * FROM ren")
def rename_links(spark, sf):
    return history.renames(fixture.files(spark, sf))


def _chain(spark, sf):
    links = written(rename_links(spark, sf), "renames")
    start = links.agg(F.max("new_path")).first()[0] or ""
    return history.name_chain(spark, links, start), start


@query("{VF}" + _HISTORY + _RENAMES + _CHAIN + " SELECT snapshot_id, place::BIGINT AS place, path AS path_at, blob_hash FROM hist JOIN chain ON name = path")
def lineage(spark, sf):
    return history.lineage(path_history(spark, sf), _chain(spark, sf)[0])


@query("{VF}" + _RENAMES + _CHAIN + " SELECT p AS path, (SELECT string_agg(name, '|' ORDER BY name) FROM chain WHERE name <> p) AS also_known_as FROM start")
def also_known_as(spark, sf):
    chain, start = _chain(spark, sf)
    return chain.agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("name") != start, F.col("name")))), "|").alias("also_known_as")).select(F.lit(start).alias("path"), "also_known_as")


@query("{VF}" + _CANDIDATES + " SELECT key AS target_hash, value AS base_hash FROM cand")
def delta_candidates(spark, sf):
    return history.delta_candidates(fixture.files(spark, sf))


_NEAREST = """, v AS (SELECT blob_hash AS obj_hash, size, row_number() OVER (ORDER BY sid, blob_hash) AS seq FROM (SELECT blob_hash, max(size) AS size, min(snapshot_id) AS sid FROM vf GROUP BY 1)),
near AS (SELECT obj_hash, base_hash, distance FROM (SELECT x.obj_hash, y.obj_hash AS base_hash, abs(y.size - x.size) AS distance, row_number() OVER (PARTITION BY x.seq ORDER BY abs(y.size - x.size), y.seq) AS r FROM v x JOIN v y ON y.seq BETWEEN x.seq - 10 AND x.seq - 1) WHERE r = 1)"""


def _nearest(spark, sf):
    from pyspark.sql import Window

    seen = fixture.files(spark, sf).groupBy(F.col("blob_hash").alias("obj_hash")).agg(F.max("size").alias("size"), F.min("snapshot_id").alias("sid"))
    # dense numbers without one global window: places within (snapshot, first byte), plus the totals before
    seen = seen.withColumn("byte", F.substring("obj_hash", 1, 2))
    cell = seen.groupBy("sid", "byte").agg(F.count("*").alias("n"))  # 256 rows a snapshot at most
    before = cell.select("sid", "byte", F.coalesce(F.sum("n").over(Window.orderBy("sid", "byte").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    seq = F.row_number().over(Window.partitionBy("sid", "byte").orderBy("obj_hash")) + F.col("before")
    versions = written(seen.join(before, ["sid", "byte"]).select("obj_hash", "size", seq.alias("seq")), "versions")
    return compare.nearest_size_base(versions)


@query("{VF}" + _NEAREST + " SELECT * FROM near")
def size_proximity_base(spark, sf):
    return _nearest(spark, sf)


@query("{VF}" + _NEAREST + ", names AS (SELECT blob_hash, list(DISTINCT path) AS names FROM vf GROUP BY 1) SELECT obj_hash, base_hash, len(list_intersect(a.names, b.names)) > 0 AS same_file FROM near JOIN names a ON a.blob_hash = obj_hash JOIN names b ON b.blob_hash = base_hash")
def false_pairings(spark, sf):
    names = fixture.files(spark, sf).groupBy(F.col("blob_hash").alias("obj_hash")).agg(F.collect_set("path").alias("names"))
    return compare.false_pairs(_nearest(spark, sf), names)


# ---------------------------------------------------------------- scalar functions

_BYTE = "('0x' || substr(block, 2 * j + 1, 2))::INTEGER"
_BLOCKS = f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, unnest(range((strlen(h) + 127) // 128)) AS i, h FROM d),
b AS (SELECT doc_id, i, substr(h, i * 128 + 1, 128) AS block FROM c), w AS (SELECT doc_id, i, block, strlen(block) // 2 AS n FROM b),
x AS (SELECT doc_id, i, (list_sum([(n - j) * {_BYTE} FOR j IN range(n)]) % 65536 * 65536 + list_sum([{_BYTE} FOR j IN range(n)]) % 65536)::BIGINT AS weak, substr(sha256(from_hex(block)), 1, 16) AS strong FROM w)"""


def _blocks(spark, sf):
    """Every 64-byte block of every text, the last one shorter; an empty text has none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("t"))
    starts = F.sequence(F.lit(0).cast("long"), (F.floor((F.octet_length("t") - 1) / codec.BLOCK)).cast("long"))
    docs = docs.where(F.octet_length("t") > 0).select("doc_id", "t", F.explode(starts).alias("i"))
    return docs.select("doc_id", "i", F.substring(F.col("t"), (F.col("i") * codec.BLOCK + 1).cast("int"), F.lit(codec.BLOCK)).alias("block"))


@query(_BLOCKS + " SELECT doc_id, i, weak FROM x")
def weak_checksum_blocks(spark, sf):
    return _blocks(spark, sf).select("doc_id", "i", binary.weak_checksum(F.col("block")).alias("weak"))


@query(_BLOCKS + " SELECT doc_id, i, strong FROM x")
def strong_checksum_blocks(spark, sf):
    return _blocks(spark, sf).select("doc_id", "i", binary.strong_checksum(F.col("block")).alias("strong"))


@query(_BLOCKS + " SELECT doc_id, weak, strong, string_agg((i * 64)::VARCHAR, ',' ORDER BY i) AS offsets FROM x GROUP BY ALL")
def block_signatures(spark, sf):
    """Each text's signature: weak and strong sum of its blocks with the offsets where they occur."""
    blocks = _blocks(spark, sf).select("doc_id", "i", binary.weak_checksum(F.col("block")).alias("weak"), binary.strong_checksum(F.col("block")).alias("strong"))
    offsets = F.transform(F.sort_array(F.collect_list("i")), lambda i: (i * codec.BLOCK).cast("string"))
    return blocks.groupBy("doc_id", "weak", "strong").agg(F.array_join(offsets, ",").alias("offsets"))


@query("{VF}, refs AS (SELECT unnest(['2', 'release', '99', 'nope', '4']) AS ref), tags AS (SELECT 'release' AS name, 3::BIGINT AS snapshot_id), ids AS (SELECT DISTINCT snapshot_id FROM vf) SELECT ref, coalesce(i.snapshot_id, t.snapshot_id) AS snapshot_id FROM refs LEFT JOIN ids i ON regexp_full_match(ref, '[0-9]+') AND i.snapshot_id = try_cast(ref AS BIGINT) LEFT JOIN tags t ON NOT regexp_full_match(ref, '[0-9]+') AND name = ref")
def tag_resolve(spark, sf):
    refs = spark.createDataFrame([(x,) for x in ("2", "release", "99", "nope", "4")], "ref string")
    tags = spark.createDataFrame([("release", 3)], "name string, tagged long")
    ids = fixture.files(spark, sf).select("snapshot_id").distinct()
    digits = F.col("ref").rlike("^[0-9]+$")
    r = refs.join(ids, digits & (F.expr("try_cast(ref AS bigint)") == F.col("snapshot_id")), "left").join(F.broadcast(tags), ~digits & (F.col("name") == F.col("ref")), "left")
    return r.select("ref", F.coalesce("snapshot_id", "tagged").alias("snapshot_id"))


@query("SELECT url, regexp_extract(url, '[^/]*$') AS name, length(regexp_extract(url, '[^/]*$')) > 0 AND regexp_extract(url, '[^/]*$') NOT IN ('.', '..') AND NOT contains(regexp_extract(url, '[^/]*$'), chr(92)) AS valid, FALSE AS url_valid FROM pages")
def entry_name_validate(spark, sf):
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return spark.read.parquet(f"{sf}/pages.parquet").select("url", name.alias("name"), binary.is_entry_name(name).alias("valid"), binary.is_entry_name(F.col("url")).alias("url_valid"))


@query("{VF} SELECT DISTINCT blob_hash, TRUE AS valid, blob_hash = upper(blob_hash) AS upper_valid, FALSE AS short_valid FROM vf")
def hash_format_validate(spark, sf):
    return fixture.files(spark, sf).select("blob_hash", binary.is_hash(F.col("blob_hash")).alias("valid"), binary.is_hash(F.upper("blob_hash")).alias("upper_valid"), binary.is_hash(F.substring("blob_hash", 1, 63)).alias("short_valid")).distinct()


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS human FROM (SELECT doc_id, strlen(text)::BIGINT * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 4000 ELSE 5000000 END) AS n FROM documents)""")
def human_bytes(spark, sf):
    scale = F.element_at(F.array(*map(F.lit, (1, 10, 4000, 5000000))), (F.col("doc_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", binary.human_bytes(F.octet_length("text").cast("long") * scale).alias("human"))


@query("{VF}, q AS (SELECT *, CASE WHEN hash(path) % 1 = 0 AND path LIKE '%7.txt' THEN replace(path, '/', '/.git/') ELSE path END AS p FROM vf WHERE snapshot_id = 1) SELECT p AS path FROM q WHERE len(list_intersect(string_split(p, '/'), ['.vault', '.git', '__pycache__', '.venv', 'node_modules'])) = 0")
def ignore_filter(spark, sf):
    p = F.when(F.col("path").like("%7.txt"), F.replace("path", F.lit("/"), F.lit("/.git/"))).otherwise(F.col("path"))
    return fixture.snapshot(spark, sf, 1).select(p.alias("path")).where(~binary.is_ignored(F.col("path")))


@query("""{VF}""" + _SNAPS + """ SELECT id, printf('{"bytes":%d,"files":%d,"id":%d,"parent":%s}', bytes, files, id, coalesce(parent::VARCHAR, 'null')) AS record FROM s""")
def snapshot_json(spark, sf):
    rows = list_snapshots(spark, sf)
    return rows.select("id", F.to_json(F.struct("bytes", "files", "id", "parent"), {"ignoreNullFields": "false"}).alias("record"))


# ---------------------------------------------------------------- codecs: no SQL twin, held against exact round trips in the tests


def _contents(spark, sf):
    return fixture.bodies(spark, sf).select(F.sha2("body", 256).alias("obj_hash"), F.col("body").cast("binary").alias("content"))


@query()
def encode_sizes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("content"))
    rows = docs.select("doc_id", "content", codec.encoded(F.col("content")).alias("stored"))
    rows = rows.withColumn("back", codec.decoded(F.col("stored"), F.sha2("content", 256)))
    return rows.select("doc_id", F.octet_length("content").cast("long").alias("original_size"), F.octet_length("stored").cast("long").alias("stored_size"), F.substring(F.col("stored"), 2, 1).cast("string").alias("encoding"), F.col("back.ok").alias("ok"))


def _pairs(spark, sf):
    """Targets with their base's content, each content once (a version pair per edited file)."""
    edges = history.modified_edges(fixture.files(spark, sf)).select("nw", "od").distinct()
    c = _contents(spark, sf).dropDuplicates(["obj_hash"])
    t = c.select(F.col("obj_hash").alias("nw"), F.col("content").alias("target"))
    b = c.select(F.col("obj_hash").alias("od"), F.col("content").alias("base"))
    return edges.join(t, "nw").join(b, "od")


@query()
def delta_roundtrip(spark, sf):
    steps = _pairs(spark, sf).withColumn("steps", codec.delta(F.col("base"), F.col("target")))
    back = binary.apply_delta(F.col("base"), F.col("steps"))
    return steps.select(F.col("nw").alias("target_hash"), F.col("od").alias("base_hash"), F.size("steps").cast("long").alias("n_steps"), (F.sha2(back, 256) == F.col("nw")).alias("ok"))


def _chosen(spark, sf):
    f = fixture.files(spark, sf)
    contents = written(_contents(spark, sf).dropDuplicates(["obj_hash"]), "contents")
    return written(packs.choose_entries(contents, history.delta_candidates(f)), "chosen")


@query()
def pack_choose_fd(spark, sf):
    return _chosen(spark, sf).select("obj_hash", "kind", "base_hash", "full_length", "delta_length")


@query()
def delta_savings(spark, sf):
    return packs.savings(_chosen(spark, sf))


@query("{VF}" + _TREES + " SELECT DISTINCT tree_hash, name, kind, child_hash FROM te JOIN th USING (snapshot_id, dir)")
def parse_trees(spark, sf):
    """All trees, each once, to their binary form and back through the table function."""
    entries = _trees(spark, sf)[0].drop("snapshot_id", "dir").distinct()
    hexed = F.concat(F.when(F.col("kind") == "blob", F.lit("62")).otherwise(F.lit("74")), binary.big_endian(F.octet_length("name"), 2), F.hex("name"), F.hex("child_hash"))
    stored = entries.groupBy("tree_hash").agg(F.array_sort(F.collect_list(F.struct("name", hexed.alias("h")))).alias("e")).select("tree_hash", F.unhex(F.array_join(F.transform("e", lambda x: x["h"]), "")).alias("content"))
    spark.udtf.register("tree_entries_of", codec.TreeEntries)
    return spark.sql("SELECT t.tree_hash, e.name, e.kind, e.child_hash FROM {stored} t, LATERAL tree_entries_of(t.content) e", stored=stored)


@query('{VF}' + _INDEX + ' SELECT pack_name, obj_hash, "offset", length FROM idx')
def parse_pack_indexes(spark, sf):
    """Pack indexes to their binary form and back through the table function."""
    spark.udtf.register("pack_index_of", codec.PackIndexEntries)
    return spark.sql("SELECT p.pack_name, e.obj_hash, e.offset, e.length FROM {stored} p, LATERAL pack_index_of(p.idx) e", stored=packs.index_bytes(_index(spark, sf)))
