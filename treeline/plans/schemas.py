"""Schemas of the stored tables; nothing is inferred."""

STATS = "struct<files:bigint,new_objects:bigint,reused_objects:bigint,original_bytes:bigint,compressed_bytes:bigint>"
OBJECTS = "obj_hash string, shard string, original_size bigint, stored_size bigint, encoding string, content binary"
TREE_ENTRIES = "tree_hash string, name string, kind string, child_hash string"
SNAPSHOTS = f"id bigint, timestamp double, parent bigint, root_tree_hash string, message string, stats {STATS}"
TAGS = "name string, snapshot_id bigint"
PACK_INDEX = "pack_name string, obj_hash string, offset bigint, length bigint"
DELTA_MANIFEST = "pack_name string, target_hash string, base_hash string"
PATH_HISTORY = "path string, snapshot_id bigint, blob_hash string"
PATH_RENAMES = "seq bigint, old_path string, new_path string, snapshot_id bigint"
