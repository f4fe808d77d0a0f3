"""A repository of snapshots: tables written by Spark, made visible by small records that the driver renames into place.

Layout: ``objects/`` and ``trees/`` generations (Parquet), ``packs/<name>/`` (Parquet), ``CURRENT`` (which generations are
live), ``snapshots/<id>.json``, ``tags.json``, ``next_id``, ``lock``. A snapshot exists once its record does; everything
written before that is unreachable and goes with the next collection. Content is joined in only where it is asked for.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.binary import EMPTY_HASH, big_endian
from ..operators import audit, compare, history, packs, trees
from ..operators.storage import written
from ..sources.directory import DirectorySource
from . import schemas
from .lock import RepositoryLock


class RepositoryError(Exception):
    pass


class IntegrityError(RepositoryError):
    pass


def _replace(path: str, text: str) -> None:
    temp = f"{path}.tmp-{uuid.uuid4().hex}"
    with open(temp, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


STATS = ("files", "new_objects", "reused_objects", "original_bytes", "compressed_bytes")


def parse_record(text: str) -> dict:
    """A snapshot record; anything but the exact shape is an error."""
    try:
        r = json.loads(text)
        ok = isinstance(r["id"], int) and isinstance(r["timestamp"], (int, float)) and (r["parent"] is None or isinstance(r["parent"], int)) and isinstance(r["root_tree_hash"], str) and isinstance(r["message"], str) and set(r["stats"]) == set(STATS)
    except (ValueError, KeyError, TypeError) as error:
        raise RepositoryError(f"corrupted snapshot record: {error}") from error
    if not ok:
        raise RepositoryError("corrupted snapshot record")
    return r


class Repository:
    def __init__(self, spark: SparkSession, path: str, lock_timeout: float = 30.0):
        self.spark, self.path, self.lock_timeout = spark, os.path.abspath(path), lock_timeout
        if not os.path.exists(self._at("CURRENT")):
            raise RepositoryError(f"no repository at {self.path}")
        spark.dataSource.register(DirectorySource)
        self._checked, self._bad = (), {}

    @classmethod
    def init(cls, spark: SparkSession, path: str) -> Repository:
        if os.path.exists(os.path.join(path, "CURRENT")):
            raise RepositoryError("repository exists")
        for d in ("snapshots", "objects", "trees", "packs"):
            os.makedirs(os.path.join(path, d), exist_ok=True)
        _replace(os.path.join(path, "CURRENT"), json.dumps({"objects": [], "trees": [], "packs": []}))
        return cls(spark, path)

    @staticmethod
    def find(start: str) -> str | None:
        """The nearest folder upwards that holds a ``.vault`` repository."""
        at = os.path.abspath(start)
        while True:
            if os.path.exists(os.path.join(at, ".vault", "CURRENT")):
                return os.path.join(at, ".vault")
            if at == os.path.dirname(at):
                return None
            at = os.path.dirname(at)

    # ------------------------------------------------------------ storage

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def lock(self, timeout: float | None = None) -> RepositoryLock:
        return RepositoryLock(self._at("lock"), self.lock_timeout if timeout is None else timeout)

    def _current(self) -> dict:
        with open(self._at("CURRENT")) as f:
            return json.load(f)

    def _publish(self, live: dict) -> None:
        _replace(self._at("CURRENT"), json.dumps(live))

    def _table(self, kind: str, schema: str) -> DataFrame:
        dirs = [self._at(kind, d) for d in self._current()[kind]]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def _append(self, kind: str, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(self._at(kind, name))
        return name

    def objects(self) -> DataFrame:
        return self._table("objects", schemas.OBJECTS)

    def tree_entries(self) -> DataFrame:
        return self._table("trees", schemas.TREE_ENTRIES)

    def every_packed(self) -> DataFrame:
        return self._table("packs", "pack_name string, obj_hash string, kind string, base_hash string, entry binary, offset bigint, length bigint, size bigint")

    def quarantine(self) -> dict[str, str]:
        """Damaged packs with the reason: none of their objects is read. Looked up once per set of packs."""
        now = tuple(self._current()["packs"])
        if now and self._checked != now:
            self._bad = {r.pack_name: r.reason for r in packs.damaged_packs(self.every_packed()).collect()}  # a row per damaged pack
            self._checked = now
        return self._bad if now else {}

    def packed(self) -> DataFrame:
        bad = self.quarantine()
        return self.every_packed().where(~F.col("pack_name").isin(*bad)) if bad else self.every_packed()

    def delta_manifest(self) -> DataFrame:
        """(target, base) of every delta of the sound packs; the last pack by name wins."""
        deltas = self.packed().where("kind = 'D'")
        return deltas.groupBy(F.col("obj_hash").alias("target")).agg(F.max_by("base_hash", "pack_name").alias("base"))

    def quarantined(self) -> DataFrame:
        """(pack_name, obj_hash) of what damaged packs hold."""
        bad = self.quarantine()
        return self.every_packed().where(F.col("pack_name").isin(*bad) if bad else F.lit(False)).select("pack_name", "obj_hash")

    def stored(self) -> DataFrame:
        """(obj_hash, original_size, stored_size) of every tier, each object once."""
        loose = self.objects().select("obj_hash", "original_size", "stored_size")
        packed = self.packed().select("obj_hash", F.col("size").alias("original_size"), F.col("length").alias("stored_size"))
        return loose.unionByName(packed).dropDuplicates(["obj_hash"])

    def contents(self, wanted: DataFrame) -> DataFrame:
        """(obj_hash, content, problem) of the wanted hashes, loose or packed; delta bases are resolved level by level."""
        wanted = wanted.select("obj_hash").distinct()
        loose = self.objects().join(wanted, "obj_hash", "left_semi").select("obj_hash", codec.decoded(F.col("content"), F.col("obj_hash")).alias("d"))
        loose = loose.select("obj_hash", F.col("d.content").alias("content"), F.col("d.reason").alias("problem"))
        entries = self.packed().dropDuplicates(["obj_hash"])
        if not self._current()["packs"]:
            return loose
        links = entries.where("kind = 'D'").select(F.col("obj_hash").alias("target"), F.col("base_hash").alias("base"))
        need = trees.closure(links, wanted.select(F.col("obj_hash").alias("owner"), F.col("obj_hash").alias("object"))).select(F.col("object").alias("obj_hash")).distinct()
        entries = written(entries.join(need, "obj_hash", "left_semi"), "entries")
        full = entries.where("kind = 'F'").select("obj_hash", codec.decoded(F.expr("substring(entry, 2)"), F.col("obj_hash")).alias("d"))
        known = written(full.select("obj_hash", F.col("d.content").alias("content"), F.col("d.reason").alias("problem")), "contents")
        waiting = entries.where("kind = 'D'")
        while not waiting.isEmpty():
            base = known.unionByName(loose).select(F.col("obj_hash").alias("base_hash"), F.col("content").alias("base"))
            ready = waiting.join(base, "base_hash").select("obj_hash", codec.undelta(F.col("obj_hash"), F.col("entry"), F.col("base")).alias("d"))
            more = written(ready.select("obj_hash", F.col("d.content").alias("content"), F.col("d.reason").alias("problem")), "contents")
            if more.isEmpty():
                known = known.unionByName(waiting.select("obj_hash", F.lit(None).cast("binary").alias("content"), F.lit("missing delta base").alias("problem")))
                break
            known = known.unionByName(more)
            waiting = written(waiting.join(more, "obj_hash", "left_anti"), "waiting")
        return loose.unionByName(known).join(wanted, "obj_hash", "left_semi").groupBy("obj_hash").agg(F.min_by("content", F.col("problem").isNotNull()).alias("content"), F.min_by("problem", F.col("problem").isNotNull()).alias("problem"))

    # ------------------------------------------------------------ records

    def ids(self) -> list[int]:
        return sorted(int(n[:-5]) for n in os.listdir(self._at("snapshots")) if n.endswith(".json") and n[:-5].isdigit())

    def load(self, k: int) -> dict:
        try:
            with open(self._at("snapshots", f"{k}.json")) as f:
                return parse_record(f.read())
        except FileNotFoundError:
            raise RepositoryError(f"no snapshot {k}; there are {self.ids()}") from None

    def list(self) -> list[dict]:
        return [self.load(k) for k in self.ids()]

    def records(self) -> DataFrame:
        rows = [(r["id"], float(r["timestamp"]), r["parent"], r["root_tree_hash"], r["message"], tuple(r["stats"][s] for s in STATS)) for r in self.list()]
        return self.spark.createDataFrame(rows, schemas.SNAPSHOTS)

    def _next_id(self) -> int:
        try:
            with open(self._at("next_id")) as f:
                k = int(f.read())
        except FileNotFoundError:
            k = max(self.ids(), default=0) + 1
        _replace(self._at("next_id"), str(k + 1))  # an id is used up even if its snapshot fails
        return k

    def tags(self) -> dict[str, int]:
        try:
            with open(self._at("tags.json")) as f:
                found = json.load(f)
        except FileNotFoundError:
            return {}
        except ValueError as error:
            raise RepositoryError("corrupted tags") from error
        if not isinstance(found, dict) or not all(isinstance(v, int) for v in found.values()):
            raise RepositoryError("corrupted tags")
        return found

    def tag(self, name: str, k: int) -> None:
        if not name or name.isdigit():
            raise RepositoryError("a tag needs a name that is no number")
        self.load(k)
        _replace(self._at("tags.json"), json.dumps(self.tags() | {name: k}, sort_keys=True, indent=2))

    def resolve(self, ref: str | int) -> int:
        if str(ref).isdigit():
            return self.load(int(ref))["id"]
        try:
            return self.load(self.tags()[ref])["id"]
        except KeyError:
            raise RepositoryError(f"no snapshot or tag {ref!r}") from None

    # ------------------------------------------------------------ snapshots

    def _scan(self, folder: str) -> DataFrame:
        if not os.path.isdir(folder):
            raise RepositoryError(f"{folder} is no folder")
        return self.spark.read.format("directory").load(os.path.abspath(folder))

    def snapshot(self, folder: str, message: str = "", when: float | None = None) -> dict:
        with self.lock():
            seen = self._scan(folder).withColumn("obj_hash", F.sha2("content", 256))
            files = written(seen.where("kind = 'blob'").select("path", "obj_hash", "content"), "scan")
            empty = seen.where("kind = 'tree'").select("path")
            parents = seen.where("path LIKE '%/%'").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).distinct()
            empty = empty.join(parents, "path", "left_anti").select(F.lit(0).cast("long").alias("snapshot_id"), "path")
            flat = files.select(F.lit(0).cast("long").alias("snapshot_id"), "path", F.col("obj_hash").alias("blob_hash"))
            if flat.isEmpty() and empty.isEmpty():
                root, entries = EMPTY_HASH, self.spark.createDataFrame([], schemas.TREE_ENTRIES)
            else:
                entries, roots = trees.build_trees(flat, empty)
                root = roots.first()["root_tree_hash"]
                entries = entries.select("tree_hash", "name", "kind", "child_hash").distinct()
            entries = written(entries, "entries")
            hexed = F.concat(F.when(F.col("kind") == "blob", F.lit("62")).otherwise(F.lit("74")), big_endian(F.octet_length("name"), 2), F.hex("name"), F.hex("child_hash"))
            tree_objects = entries.groupBy("tree_hash").agg(F.array_sort(F.collect_list(F.struct("name", hexed.alias("h")))).alias("e")).select(F.col("tree_hash").alias("obj_hash"), F.unhex(F.array_join(F.transform("e", lambda x: x["h"]), "")).alias("content"))
            tree_objects = tree_objects.unionByName(self.spark.createDataFrame([(EMPTY_HASH, bytearray())], "obj_hash string, content binary").where(F.lit(root == EMPTY_HASH or not empty.isEmpty())))
            before = self.stored().select("obj_hash")
            fresh = compare.new_objects(files.select("obj_hash", "content"), before)
            new_files = fresh.count()
            fresh = compare.new_objects(files.select("obj_hash", "content").unionByName(tree_objects), before)  # anti-joined before the codec
            stored = fresh.select("obj_hash", F.substring("obj_hash", 1, 2).alias("shard"), F.octet_length("content").cast("long").alias("original_size"), codec.encoded(F.col("content")).alias("stored"))
            stored = stored.select("obj_hash", "shard", "original_size", F.octet_length("stored").cast("long").alias("stored_size"), F.expr("cast(substring(stored, 2, 1) AS string)").alias("encoding"), F.col("stored").alias("content"))
            live = self._current()
            live["objects"].append(self._append("objects", stored))
            live["trees"].append(self._append("trees", entries))
            self._publish(live)
            n = files.join(self.stored(), "obj_hash").agg(F.count("*").alias("files"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("a"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("b")).first()
            k = self._next_id()
            record = {"id": k, "timestamp": when if when is not None else time.time(), "parent": max(self.ids(), default=None), "root_tree_hash": root, "message": message, "stats": {"files": n["files"], "new_objects": new_files, "reused_objects": n["files"] - new_files, "original_bytes": int(n["a"]), "compressed_bytes": int(n["b"])}}
            _replace(self._at("snapshots", f"{k}.json"), json.dumps(record))  # the commit
            return record

    def remove(self, k: int) -> None:
        with self.lock():
            self.load(k)
            os.unlink(self._at("snapshots", f"{k}.json"))

    def _roots(self, ids: list[int] | None = None) -> DataFrame:
        rows = [(r["id"], r["root_tree_hash"]) for r in self.list() if ids is None or r["id"] in ids]
        return self.spark.createDataFrame(rows, "snapshot_id long, root_tree_hash string")

    def walk(self, ids: list[int] | None = None) -> DataFrame:
        return trees.walk(self.tree_entries(), self._roots(ids))

    def files(self, ids: list[int] | None = None) -> DataFrame:
        return trees.flatten(self.walk(ids))

    def show(self, k: int) -> DataFrame:
        sizes = self.stored().select(F.col("obj_hash").alias("object"), F.col("original_size").alias("size"))
        rows = self.walk([k]).join(sizes, "object", "left")
        return rows.select("path", "kind", F.when(F.col("kind") == "blob", F.col("size")).alias("size"), "object").orderBy(F.split("path", "/"))

    # ------------------------------------------------------------ comparing and restoring

    def diff(self, a: str | int, b: str | int) -> DataFrame:
        a, b = self.resolve(a), self.resolve(b)
        both = written(self.files([a, b]), "files")
        return compare.diff(both.where(F.col("snapshot_id") == a), both.where(F.col("snapshot_id") == b))

    def preview(self, ref: str | int, folder: str) -> DataFrame:
        """What a restore would do: added and modified are written, removed stay on disk; ``ok``: the content is sound.

        An absent folder counts as empty.
        """
        if os.path.exists(folder):
            disk = self._scan(folder).where("kind = 'blob'").select("path", F.sha2("content", 256).alias("blob_hash"))
        else:
            disk = self.spark.createDataFrame([], "path string, blob_hash string")
        changes = written(compare.restore_preview(disk, self.files([self.resolve(ref)])), "preview")
        wanted = changes.where("change <> 'removed'").select(F.col("new_hash").alias("obj_hash"))
        sound = self.contents(wanted).select(F.col("obj_hash").alias("new_hash"), F.col("problem").isNull().alias("ok"))
        return changes.join(sound, "new_hash", "left").select("path", "change", "old_hash", "new_hash", F.coalesce("ok", F.col("change") == "removed").alias("ok"))

    def restore(self, ref: str | int, folder: str) -> int:
        """Writes added and modified files; nothing at all, not even an absent folder, if any is unsound. Returns how many."""
        k = self.resolve(ref)
        if not trees.lost_trees(self.tree_entries(), self.walk([k]), self._roots([k])).isEmpty():
            raise IntegrityError("a tree of the snapshot is lost; nothing was written")
        plan = written(self.preview(ref, folder), "plan")
        if not plan.where("NOT ok").isEmpty():
            raise IntegrityError("damaged objects; nothing was written")
        todo = plan.where("change <> 'removed'").select("path", F.col("new_hash").alias("obj_hash"))
        top = os.path.abspath(folder)
        os.makedirs(top, exist_ok=True)

        def write(rows) -> None:
            for r in rows:
                if r["path"].startswith("/") or ".." in r["path"].split("/"):
                    raise IntegrityError(f"unsafe path {r['path']!r}")
                target = os.path.join(top, r["path"])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temp = f"{target}.tmp-{uuid.uuid4().hex}"
                with open(temp, "wb") as f:
                    f.write(bytes(r["content"]))
                os.replace(temp, target)

        todo.join(self.contents(todo), "obj_hash").select("path", "content").foreachPartition(write)
        return todo.count()

    # ------------------------------------------------------------ audits

    def verify(self) -> DataFrame:
        """(obj_hash, problem) of every damaged object in any tier."""
        return self.contents(self.stored()).where("problem IS NOT NULL").select("obj_hash", "problem")

    def recover_check(self, ref: str | int) -> tuple[dict, list[dict]]:
        k = self.resolve(ref)
        record = self.load(k)
        walked = self.walk([k])
        refs = walked.select("path", "object").unionByName(self.spark.createDataFrame([(".", record["root_tree_hash"])], "path string, object string"))
        objs = self.contents(refs.select(F.col("object").alias("obj_hash"))).select("obj_hash", F.col("problem").isNull().alias("ok"))
        packed = self.packed()
        manifest = self.delta_manifest()
        everything = objs.unionByName(self.stored().select("obj_hash", F.lit(True).alias("ok"))).groupBy("obj_hash").agg(F.bool_and("ok").alias("ok"))
        lost = trees.lost_trees(self.tree_entries(), walked, self._roots([k])).select(F.col("path").alias("where"), "object", F.lit("unreadable tree").alias("detail"))
        found = audit.recover_issues(refs, everything, manifest, self.quarantined())
        later = [r["id"] for r in self.list() if r["parent"] is not None and r["parent"] >= r["id"]]  # a parent comes before its snapshot
        chain = self.spark.createDataFrame([(f"snapshot {i}", "", "parent is not older") for i in later], "where string, object string, detail string")
        issues = written(found.unionByName(lost.join(found.select("object"), "object", "left_anti")).unionByName(chain), "issues")
        report = audit.recover_report(refs, issues, packed, manifest).first().asDict()
        return {"snapshot": k, "message": record["message"], "root_tree_hash": record["root_tree_hash"], **report}, [r.asDict() for r in issues.orderBy("where", "object").collect()]

    def reachable(self) -> DataFrame:
        """(owner, object) of everything that live snapshots need, delta bases included."""
        roots = self._roots()
        base = trees.reachable(self.tree_entries(), roots).select(F.col("snapshot_id").alias("owner"), "object")
        links = self.packed().where("kind = 'D'").select(F.col("obj_hash").alias("target"), F.col("base_hash").alias("base"))
        return trees.closure(links, base) if self._current()["packs"] else base

    def gc(self) -> dict:
        """Drops what no live snapshot needs: new generations are written, then CURRENT is replaced, then old folders go."""
        with self.lock():
            if self.quarantine():
                raise IntegrityError(f"damaged packs {sorted(self.quarantine())}; nothing was deleted")
            need = written(self.reachable().select("object").distinct(), "need")
            known = self.tree_entries().select(F.col("tree_hash").alias("object")).distinct()
            below = self.tree_entries().where("kind = 'tree'").select(F.col("child_hash").alias("object"), F.col("tree_hash").alias("target")).join(need.withColumnRenamed("object", "target"), "target", "left_semi").select("object")
            asked = self._roots().select(F.col("root_tree_hash").alias("object")).unionByName(below).where(F.col("object") != EMPTY_HASH)
            if not asked.join(known, "object", "left_anti").isEmpty():  # what they lead to is unknown, and may be all that is left
                raise IntegrityError("the rows of a live tree are lost; nothing was deleted")
            missing = self.tree_entries().where("kind = 'tree'").select(F.col("child_hash").alias("object")).distinct().join(need, "object", "left_semi")
            if not missing.join(self.stored().select(F.col("obj_hash").alias("object")), "object", "left_anti").isEmpty():
                raise IntegrityError("a live tree is missing; nothing was deleted")
            lost = audit.garbage(self.stored(), need).agg(F.count("*").alias("n"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("b")).first()
            old = self._current()
            keep = need.withColumnRenamed("object", "obj_hash")
            new = {"objects": [self._append("objects", self.objects().join(keep, "obj_hash", "left_semi"))], "trees": [self._append("trees", self.tree_entries().distinct().join(need.withColumnRenamed("object", "tree_hash"), "tree_hash", "left_semi"))], "packs": []}
            if old["packs"]:
                new["packs"] = [self._append("packs", self.packed().join(keep, "obj_hash", "left_semi"))]
            self._publish(new)
            for kind, names in old.items():
                for name in names:
                    shutil.rmtree(self._at(kind, name), ignore_errors=True)
            return {"deleted": lost["n"], "bytes_reclaimed": int(lost["b"])}

    def trace(self, obj_hash: str) -> dict:
        exists = not self.stored().where(F.col("obj_hash") == obj_hash).isEmpty()
        found = {r.snapshot_id: r.paths for r in audit.trace(self.walk(), self._roots(), obj_hash).collect()} if self.ids() else {}
        return {"exists": exists, "locations": found, "would_gc_delete": exists and not found}

    # ------------------------------------------------------------ packs

    def pack(self, name: str | None = None) -> dict:
        """Loose objects into a pack, full or as deltas; verified by reading back before the loose ones go."""
        with self.lock():
            old = self._current()
            name = name or f"pack-{len(old['packs']) + 1}-{uuid.uuid4().hex[:8]}"
            if not self.packed().where(F.col("pack_name") == name).isEmpty():
                raise RepositoryError(f"pack {name} exists")
            read = written(self.contents(self.objects()), "read")
            damaged = read.where("problem IS NOT NULL OR content IS NULL").count()
            if damaged or self.objects().select("obj_hash").distinct().join(read, "obj_hash", "left_anti").count():
                raise IntegrityError(f"{damaged} damaged loose objects; nothing was packed or deleted")
            loose = read.select("obj_hash", "content")
            candidates = history.delta_candidates(self.files()) if len(self.ids()) > 1 else self.spark.createDataFrame([], "target_hash string, base_hash string")
            chosen = written(packs.choose_entries(loose, candidates), "chosen")
            sizes = loose.select("obj_hash", F.octet_length("content").cast("long").alias("size"))
            places = packs.pack_offsets(chosen.select(F.lit(name).alias("pack_name"), "obj_hash", F.octet_length("entry").cast("long").alias("length")))
            rows = places.join(chosen.select("obj_hash", "kind", "base_hash", "entry"), "obj_hash").join(sizes, "obj_hash")
            part = self._append("packs", rows.select("pack_name", "obj_hash", "kind", "base_hash", "entry", "offset", "length", "size"))
            self._publish({**old, "objects": [], "packs": [*old["packs"], part]})
            bad = self.contents(loose).where("problem IS NOT NULL OR content IS NULL").count()
            if bad or self.contents(loose).count() != loose.count():
                self._publish(old)
                raise IntegrityError("the pack does not read back; loose objects stay")
            for d in old["objects"]:
                shutil.rmtree(self._at("objects", d), ignore_errors=True)
            s = chosen.agg(F.count_if(F.col("kind") == "F").alias("full"), F.count_if(F.col("kind") == "D").alias("delta"), F.coalesce(F.sum(F.when(F.col("kind") == "D", F.col("full_length") - F.col("delta_length"))), F.lit(0)).alias("saved")).first()
            return {"pack": name, "full": s["full"], "delta": s["delta"], "bytes_saved": int(s["saved"])}

    # ------------------------------------------------------------ reports

    def log(self, path: str) -> dict:
        files = written(self.files(), "files")
        chain = history.name_chain(self.spark, written(history.renames(files), "renames"), path)
        rows = history.lineage(history.path_history(files), chain).orderBy("snapshot_id", "place").collect()
        names = sorted(r["name"] for r in chain.collect() if r["name"] != path)
        about = {r["id"]: {"timestamp": r["timestamp"], "message": r["message"]} for r in self.list()}
        return {"path": path, "entries": [{"snapshot": r.snapshot_id, "blob_hash": r.blob_hash, "path_at": r.path_at, **about[r.snapshot_id]} for r in rows], "also_known_as": names}

    def status(self, deep: bool = False) -> dict:
        n = self.stored().agg(F.count("*").alias("n"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("b")).first()
        records = self.list()
        last = max(records, key=lambda r: (r["timestamp"], -r["id"]), default=None)
        bad = self.verify().count() if deep else 0
        here = self.stored().select(F.col("obj_hash").alias("object"))
        gone = self.reachable().select("object").distinct().join(here, "object", "left_anti").count() if records else 0
        return {"snapshots": len(records), "objects": n["n"], "total_snapshot_data_bytes": sum(r["stats"]["original_bytes"] for r in records), "stored_on_disk_bytes": int(n["b"]), "last_snapshot": last and {k: last[k] for k in ("id", "message", "timestamp")}, "integrity_ok": not bad and not gone, "corrupted_count": bad}

    def explain(self, ref: str | int) -> dict:
        r = self.load(self.resolve(ref))
        s = r["stats"]
        n, saved = s["new_objects"] + s["reused_objects"], max(0, s["original_bytes"] - s["compressed_bytes"])
        return {"id": r["id"], "message": r["message"], "parent": r["parent"], "files": s["files"], "new_objects": s["new_objects"], "reused_objects": s["reused_objects"], "dedup_ratio_pct": 100.0 * s["reused_objects"] / n if n else 0.0, "original_bytes": s["original_bytes"], "stored_bytes": s["compressed_bytes"], "storage_saved_bytes": saved, "storage_saved_pct": 100.0 * saved / s["original_bytes"] if s["original_bytes"] else 0.0}
