"""Column functions for ids, types, paths, sizes, states and messages."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension, in the order in which they are tried.
EXTENSIONS = {
    "document": [".txt", ".doc", ".docx", ".pdf", ".rtf", ".odt", ".md", ".tex"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico"],
    "video": [".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a"],
    "code": [".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt"],
    "data": [".json", ".xml", ".yaml", ".yml", ".csv", ".sql", ".db", ".sqlite"],
    "archive": [".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz"],
    "executable": [".exe", ".msi", ".sh", ".bat", ".cmd", ".ps1"],
}
#: Media types by extension, as Python's standard library has them without those of the machine.
MEDIA = dict(sorted(mimetypes.MimeTypes().types_map[True].items()))
STATES = ["online", "offline", "unknown"]


def suffix(name: Column) -> Column:
    """The lower-cased extension with its dot, '' if there is none; a leading dot isn't one."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))


def lookup(values: dict[str, str], key: Column, default: str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def type_by_extension(name: Column) -> Column:
    """One of eight classes, or other."""
    by: dict[str, str] = {}
    for kind, endings in EXTENSIONS.items():
        for e in endings:
            by.setdefault(e, kind)
    return lookup(by, suffix(name), "other")


def media_type(name: Column) -> Column:
    return lookup(MEDIA, suffix(name), "application/octet-stream")


def _by_top(mime: Column, document: Column, end: str = "") -> Column:
    out = F
    for top in ("image", "video", "audio"):
        out = out.when(mime.startswith(top + end), top)
    return out.when(document, "document").otherwise("other")


def type_by_media_scan(mime: Column) -> Column:
    """Any text, or anything with 'document' in it, is a document."""
    return _by_top(mime, mime.startswith("text") | mime.contains("document"))


def type_by_media_upload(mime: Column) -> Column:
    """Plain text, PDF and Word alone are documents."""
    return _by_top(mime, mime.isin("text/plain", "application/pdf", "application/msword"), "/")


def scan_id(node: Column, relative: Column, content_hash: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", node, relative, content_hash).cast("binary"), 256), 1, 16)


def upload_id(node: Column, content_hash: Column) -> Column:
    return F.concat(node, F.lit("_"), F.substring(content_hash, 1, 16))


def import_id(node: Column, relative: Column) -> Column:
    return F.concat(node, F.lit("_"), F.md5(relative.cast("binary")))


def document_text(name: Column, content: Column, description: Column, tags: Column) -> Column:
    """What is embedded of a document: name, first 1000 characters, description, tags; nulls are left out."""
    return F.concat_ws(" ", name, F.substring(content, 1, 1000), description, F.array_join(tags, " "))


def truncate_bytes(text: Column, limit: int = 200_000) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that doesn't cut a character."""
    data = text.cast("binary")
    cut = F.lit(limit)
    for _ in range(3):  # a byte 10xxxxxx behind the cut belongs to a character that began before it
        follows = F.substring(F.hex(F.substring(data, cut + 1, 1)), 1, 1).isin("8", "9", "A", "B")
        cut = F.when(follows, cut - 1).otherwise(cut)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(data, 1, cut), "UTF-8"))


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def normal_path(path: Column) -> Column:
    """A leading slash, no empty parts."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/"))


def human_size(size: Column) -> Column:
    """1536 -> 1.5 KB; from B to PB."""
    value, out = size.cast("double"), None
    units = ["B", "KB", "MB", "GB", "TB"]
    for k, unit in enumerate(units):
        text = F.format_string(f"%.1f {unit}", F.bround(value / float(1024**k), 1))
        out = F.when(value < float(1024 ** (k + 1)), text) if out is None else out.when(value < float(1024 ** (k + 1)), text)
    return out.otherwise(F.format_string("%.1f PB", F.bround(value / float(1024**5), 1)))


def normal_status(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.contains("online"), "online").when(s.contains("offline"), "offline").otherwise("unknown")


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def progress(completed: Column, targets: Column) -> Column:
    return F.when(F.size(targets) == 0, 1.0).otherwise(F.size(completed) / F.size(targets))


def public_url(host: Column, port: Column, file_id: Column) -> Column:
    return F.concat(F.lit("http://"), host, F.lit(":"), port.cast("string"), F.lit("/download/"), file_id)


def megabytes(size: Column, digits: int = 2) -> Column:
    return F.round(size / F.lit(1048576.0), digits)


# The frame of a binary message.
MAGIC, MOST = "44534D01", 65_507
TYPES = ["PING", "PONG", "ELECTION", "ELECTION_OK", "COORDINATOR", "REGISTER_CONTENT", "QUERY_ROUTING", "REPLICATE", "SYNC_REQUEST", "SYNC_RESPONSE", "STATUS_REQUEST", "STATUS_RESPONSE"]
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_BODY = "sender_id string, payload map<string,string>, timestamp timestamp"


def message(kind: str, sender: Column, timestamp: Column, payload: Column | None = None) -> Column:
    """A message of one of the TYPES as JSON."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), sender.alias("sender_id"), (F.create_map().cast("map<string,string>") if payload is None else payload).alias("payload"), timestamp.alias("timestamp")))


def announce(node: Column, host: Column, port: Column, timestamp: Column) -> Column:
    """A discovery announcement as JSON."""
    return F.to_json(F.struct(F.lit("announce").alias("type"), node.alias("node_id"), host.alias("ip_address"), port.alias("port"), timestamp.alias("timestamp")))


def join(node: Column, host: Column, port: Column, timestamp: Column) -> Column:
    return message("JOIN", node, timestamp, F.create_map(F.lit("host"), host, F.lit("port"), port.cast("string")))


def leave(node: Column, timestamp: Column) -> Column:
    return message("LEAVE", node, timestamp)


def coordinator(node: Column, timestamp: Column) -> Column:
    return message("COORDINATOR", node, timestamp, F.create_map(F.lit("new_master"), node))


def iso(timestamp: Column) -> Column:
    """A time in ISO form with microseconds."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def frame(kind: Column, sender: Column, payload: Column, timestamp: Column) -> Column:
    """Magic, one byte for the type, JSON; null if it is too long or of no known type."""
    number = F.array_position(F.array(*[F.lit(t) for t in TYPES]), kind)
    body = F.to_json(F.struct(sender.alias("sender_id"), payload.alias("payload"), timestamp.alias("timestamp")), _TIMES).cast("binary")
    framed = F.concat(F.unhex(F.lit(MAGIC)), F.unhex(F.lpad(F.hex(number), 2, "0")), body)
    return F.when((number > 0) & (F.octet_length(framed) <= MOST), framed)


def unframe(data: Column) -> Column:
    """struct of type, sender_id, payload, timestamp; null if malformed."""
    number = F.conv(F.hex(F.substring(data, 5, 1)), 16, 10).cast("int")
    body = F.from_json(F.decode(F.substring(data, 6, MOST), "UTF-8"), _BODY, _TIMES)
    good = (F.hex(F.substring(data, 1, 4)) == MAGIC) & number.between(1, len(TYPES)) & body["sender_id"].isNotNull()
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.greatest(F.least(number, F.lit(len(TYPES))), F.lit(1)))
    return F.when(good, F.struct(kind.alias("type"), body["sender_id"].alias("sender_id"), body["payload"].alias("payload"), body["timestamp"].alias("timestamp")))
