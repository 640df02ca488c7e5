"""Column expressions: ids, classes, ranges, encodings, tags, tree records. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunklake import schemas

# Fixed values. Types and endings are sets, in alphabetical order.
#: Content type families and single types that are stored as they are.
RAW_FAMILIES = ("audio/", "image/", "video/")
RAW_TYPES = (
    "application/gzip", "application/octet-stream-tensor", "application/vnd.safetensors", "application/x-7z-compressed", "application/x-bzip2", "application/x-gzip", "application/x-lz4", "application/x-npy",
    "application/x-npz", "application/x-numpy", "application/x-pytorch", "application/x-safetensors", "application/x-xz", "application/x-zstd", "application/zip", "application/zstd", "tensor/gpu-loadable",
)
#: File name endings of model weights.
MODEL_ENDINGS = (".bin", ".ckpt", ".ggml", ".gguf", ".npy", ".npz", ".onnx", ".pt", ".pth", ".safetensors")
#: Kinds of error in the order in which they are tried, and the words (case counts) that name them.
ERROR_KINDS = (
    ("not_found", ("no rows", "not found", "NoSuchKey", "NotFound")),
    ("already_exists", ("already exists", "duplicate", "AlreadyExists")),
    ("range", ("InvalidRange", "invalid range")),
    ("auth", ("expired", "AccessDenied", "ExpiredToken", "InvalidAccessKeyId", "Unauthorized", "permission denied")),
    ("conflict", ("conflict", "Conflict", "serialize", "serialization", "deadlock")),
    ("timeout", ("timeout", "deadline")),
)
#: Codes of changes.
MKNOD, MKDIR, UNLINK, RMDIR, RENAME, SETATTR, WRITE, SYMLINK, LINK = range(1, 10)


def blob_id(kind: str, domain: Column, hash_: Column) -> Column:
    """<kind>-<domain>-<hash>, with _ for no domain."""
    return F.concat(F.lit(f"{kind}-"), F.coalesce(F.when(domain != "", domain), F.lit("_")), F.lit("-"), hash_)


def effective(first: Column, other: Column) -> Column:
    """first, or other where first is null or empty: the domain of a tenant, the context of an owner."""
    return F.coalesce(F.when(first != "", first), other)


def version_string(at: Column, tail: Column) -> Column:
    """A version whose string order is its time order: a fixed number of fraction digits, and six hex digits."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("-"), F.substring(F.md5(tail.cast("string").cast("binary")), 1, 6))


def raw_content_type(content_type: Column) -> Column:
    """Whether a content type is stored as it is: parameters don't count, nor does case; an unknown type compresses."""
    base = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    out = base.isin(*RAW_TYPES)
    for family in RAW_FAMILIES:
        out = out | base.startswith(family)
    return out


def codec_of(tag: Column, content_type: Column) -> Column:
    """A tag's codec, else none for what doesn't compress and zstd for the rest."""
    return F.coalesce(F.when(tag.isin("none", "zstd", "gzip"), tag), F.when(raw_content_type(content_type), "none").otherwise("zstd"))


def codec_byte(codec: Column) -> Column:
    """0 none, 1 zstd, 2 gzip, 3 chunked; null for others."""
    return F.when(codec == "none", 0).when(codec == "zstd", 1).when(codec == "gzip", 2).when(codec == "chunked", 3)


def store_class(name: Column, default: int) -> Column:
    """1 (raw) by a model file's ending, else the default."""
    return F.when(F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).isin(*MODEL_ENDINGS), 1).otherwise(F.lit(default))


def error_kind(message: Column) -> Column:
    """A bounded label of an error text: ok for none (null), other where no word fits. A context that ran out or was canceled goes before all words."""
    out = F.lit("other")
    for kind, words in reversed(ERROR_KINDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | message.contains(w)
        out = F.when(hit, kind).otherwise(out)
    out = F.when(message.contains("context deadline exceeded"), "timeout").when(message.contains("context canceled"), "canceled").otherwise(out)
    return F.when(message.isNull(), "ok").otherwise(out)


def integrity_kind(corrupt: Column, missing: Column) -> Column:
    """corrupt, not_found, or '' for any other fault."""
    return F.when(corrupt, "corrupt").when(missing, "not_found").otherwise("")


def integrity(expected_hash: Column, expected_size: Column, hash_: Column, size: Column) -> Column:
    """Why content is refused: empty, size or hash (case doesn't count); null where it is as expected. A size of 0 or less, or an empty hash, isn't checked."""
    sized = expected_size > 0
    return F.when(sized & (size == 0), "empty").when(sized & (size != expected_size), "size").when((expected_hash != "") & (F.lower(expected_hash) != F.lower(hash_)), "hash")


def valid_tenant(name: Column) -> Column:
    return (F.length(name) > 0) & ~name.rlike(r"[. *>]")


def safe_tenant(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]+$")


def chunked(tags: Column) -> Column:
    return F.coalesce(tags["chunked_format"].isin("v1", "v2"), F.lit(False))


def byte_range(header: Column, size: Column) -> Column:
    """struct<start, length, status> of an HTTP range over `size` bytes: whole where there is none or it isn't one range, partial, or unsatisfiable beyond the end."""
    pattern = r"^bytes=([0-9]{0,18})-([0-9]{0,18})$"
    text = F.trim(F.coalesce(header, F.lit("")))
    a, b = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    lo, hi = F.when(a != "", a).cast("bigint"), F.when(b != "", b).cast("bigint")
    one = text.rlike(pattern) & ~((a == "") & (b == "")) & ~(lo.isNotNull() & hi.isNotNull() & (lo > hi))
    start = F.when(lo.isNull(), F.greatest(size - hi, F.lit(0))).otherwise(lo)
    end = F.when(lo.isNull() | hi.isNull(), size - 1).otherwise(F.least(hi, size - 1))
    bad = (start >= size) | (lo.isNull() & (hi == 0))
    status = F.when(~one, "whole").when(bad, "unsatisfiable").otherwise("partial")
    zero = F.lit(0).cast("bigint")
    return F.struct(F.when(status == "partial", start).otherwise(zero).alias("start"), F.when(status == "whole", size).when(status == "partial", end - start + 1).otherwise(zero).alias("length"), status.alias("status"))


def encode_user_tags(meta: Column) -> Column:
    """Keys under u.; null for none."""
    return F.when(F.size(meta) > 0, F.transform_keys(meta, lambda k, _: F.concat(F.lit("u."), k)))


def decode_user_tags(tags: Column) -> Column:
    """The tags under u., without it; null for none."""
    own = F.map_filter(tags, lambda k, _: k.startswith("u."))
    return F.when(F.size(own) > 0, F.transform_keys(own, lambda k, _: F.substring(k, F.lit(3), F.length(k))))


def parse_tags(text: Column) -> Column:
    """struct<tags, corrupt> of a JSON object of strings; null or empty text has no tags and isn't corrupt. A value that is no string (null aside) makes the whole text corrupt, and it then has no tags."""
    tags, kinds = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    full = text.isNotNull() & (F.trim(text) != "") & (F.trim(text) != "{}")
    strings = F.forall(F.map_values(kinds), lambda v: F.coalesce(F.schema_of_variant(v).isin("STRING", "VOID"), F.lit(True)))
    bad = full & (tags.isNull() | (F.size(tags) == 0) | ~F.coalesce(strings, F.lit(False)))
    return F.struct(F.when(full & ~bad, tags).alias("tags"), bad.alias("corrupt"))


def parse_locks(text: Column) -> Column:
    return F.from_json(text, schemas.PLOCKS)


def human_bytes(n: Column) -> Column:
    """B below 1024, else one decimal and KiB .. EiB; null for null. The decimal is that of the number as a double, ties to the even one, as in Go and C; Java's format rounds them up."""
    out = F.format_string("%d B", n)
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        scaled = n / F.lit(float(1 << (10 * i)))
        whole = F.floor(scaled)
        tenfold = ((scaled - whole) * F.lit(float(1 << 52))).cast("long") * 10  # all bits of the fraction: 52 at most, as the number is 1 or more
        down, rest = F.shiftright(tenfold, 52), tenfold.bitwiseAND(F.lit((1 << 52) - 1))
        tenths = whole * 10 + down + F.when((rest > 1 << 51) | ((rest == 1 << 51) & (down % 2 == 1)), 1).otherwise(0)
        out = F.when(n >= (1 << (10 * i)), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def uri_encode(text: Column, slash: bool = True) -> Column:
    """Percent-encoding that keeps letters, digits and - . _ ~ (and / unless `slash`)."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return out if slash else F.replace(out, F.lit("%2F"), F.lit("/"))


def continuation_token(key: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(key, "UTF-8")), "[\\r\\n]", "")


_UNSAFE = r"""[/\\:*?"<>|\x00]"""


def sanitized(segment: Column) -> Column:
    """A file name for any text: _ for none, base64url where a character would break a path, else itself."""
    coded = F.regexp_replace(F.translate(F.base64(F.encode(segment, "UTF-8")), "+/", "-_"), "[=\\r\\n]", "")
    return F.when(segment == "", "_").when(segment.rlike(_UNSAFE), coded).otherwise(segment)


def unsanitized(name: Column) -> Column:
    """The text of a file name; what decodes to a text that needed no coding is taken as it stands."""
    right = name.rlike("^[A-Za-z0-9_-]*$") & (F.length(name) % 4 != 1)
    padded = F.rpad(F.translate(name, "-_", "+/"), (F.ceil(F.length(name) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(F.when(right, padded), F.lit("base64"))
    text = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
    return F.when(name == "_", "").when(text.rlike(_UNSAFE), text).otherwise(name)


def multipart_etag(part_md5s: Column) -> Column:
    """md5 of the parts' raw md5s in order, and their number. part_md5s: array of hex strings."""
    return F.concat(F.md5(F.unhex(F.array_join(part_md5s, ""))), F.lit("-"), F.size(part_md5s).cast("string"))


def inode(prefix: Column, counter: Column) -> Column:
    """A region's prefix above 48 bits of counter; from region 128 on the sign bit is set, and decimal(20,0) gives the order."""
    return F.shiftleft(prefix.cast("bigint"), 48).bitwiseOR(counter.bitwiseAND(F.lit((1 << 48) - 1)))


def scope_key(first: Column) -> Column:
    return F.concat(F.lit("ino:"), first.cast("string"))


def framing(data: Column) -> Column:
    """struct<framed, codec> of a pack's first bytes: a magic and a codec byte; without it the pack is raw."""
    framed = F.substring(data, 1, 4) == F.lit(schemas.PACK_MAGIC)
    return F.struct(framed.alias("framed"), F.when(framed, F.conv(F.hex(F.substring(data, 5, 1)), 16, 10).cast("int")).alias("codec"))


def stored_span(entries: Column, lo: Column, hi: Column) -> Column:
    """struct<stored_off, stored_len> of the index entries that overlap the window [lo, hi)."""
    hit = F.filter(entries, lambda e: (e["off"] < hi) & (e["off"] + e["len"] > lo))
    start = F.array_min(F.transform(hit, lambda e: e["stored_off"]))
    return F.struct(start.alias("stored_off"), (F.array_max(F.transform(hit, lambda e: e["stored_off"] + e["stored_len"])) - start).alias("stored_len"))


def invalidations(ino: Column, op: Column, payload: Column) -> Column:
    """What a change makes stale: array<struct<kind, ino, name>> of 0 to 4 entries (a name in a directory) and inodes."""
    p = F.from_json(payload, "parent bigint, name string, src_parent bigint, src_name string, dst_parent bigint, dst_name string")
    item = lambda kind, i, n: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("ino"), n.cast("string").alias("name"))
    none = F.array().cast("array<struct<kind:string,ino:bigint,name:string>>")
    node = F.array(item("inode", ino, F.lit(None)))

    def slot(parent: Column, name: Column) -> Column:
        return F.when(F.coalesce(parent, F.lit(0)) != 0, F.array(item("entry", parent, name), item("inode", parent, F.lit(None)))).otherwise(none)

    here = slot(p["parent"], p["name"])
    moved = F.concat(slot(p["src_parent"], p["src_name"]), slot(p["dst_parent"], p["dst_name"]))
    return F.when(op.isin(WRITE, SETATTR), node).when(op.isin(MKNOD, MKDIR, SYMLINK, LINK), here).when(op.isin(UNLINK, RMDIR), F.concat(here, node)).when(op == RENAME, moved).otherwise(none)
