"""Schemas of the tables the operators work on.  Extra columns are welcome everywhere."""

FILES = "file_id string, node_id string, name string, path string, size bigint, mime_type string, type string, last_updated timestamp, content_hash string, is_replica boolean, replica_source string, replicated_at timestamp"
CONTENTS = "file_id string, name string, content string"
NODES = "node_id string, name string, ip_address string, port int, status string, last_seen timestamp, shared_files_count int"
NODE_LOADS = "node_id string, active_queries int, cpu_usage double, memory_usage double, document_count bigint, last_updated timestamp"
VECTORS = "file_id string, filename string, node_id string, embedding array<double>, metadata map<string,string>"
ACTIVITIES = "user_id string, action string, details string, timestamp timestamp"
FAILURES = "node_id string, type string, timestamp timestamp, details map<string,string>, status string, recovery_time timestamp, downtime_seconds double"
PATHS = "path string, parent_path string, name string, is_file boolean, file_id string, metadata map<string,string>"
ALIASES = "alias string, real_path string"
CHECKPOINTS = "node_id string, timestamp timestamp, files_count bigint, checkpoint_hash string, files_snapshot array<struct<content_hash:string,file_id:string,last_updated:timestamp>>"
MESSAGES = "type string, sender_id string, payload map<string,string>, timestamp timestamp"
