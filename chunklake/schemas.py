"""Schemas of the tables that the operators read and return. Times are timestamp_ntz in UTC, names are strings in byte order."""

# The layouts of stored records.
#: First bytes of a framed pack.
PACK_MAGIC = b"CPK\x01"
#: A log record: seq, op, inode, indx, off, slice_id, size, slice_off, slice_len: 45 bytes, big-endian.
LOG_LAYOUT = ">QBQIIQIII"
#: An entry of a pack's chunk index: offset, length, stored offset, stored length, codec: 25 bytes, big-endian.
ENTRY_LAYOUT = ">QIQIB"

OBJECTS = "domain string, ref string, doc_id bigint, content_hash string, size_b bigint, pending boolean, created_at timestamp_ntz"
CHUNKS = "domain string, doc_id bigint, ref string, seq bigint, chunk_hash string, size bigint"
PACKS = "domain string, pack_no bigint, size bigint, chunks bigint"
MANIFESTS = "owner_key string, version string, created_at timestamp_ntz, payload binary"
MANIFEST_PAYLOAD = "struct<format:string,total_size:bigint,tenant:string,chunks:array<struct<h:string,p:string,o:int,s:int>>>"
PLOCKS = "array<struct<t:int,s:bigint,e:bigint,p:bigint>>"
CHANGELOG = "lsn bigint, ino bigint, op int, payload string, ts timestamp_ntz"
SLICES = "inode bigint, id bigint, slice_id bigint, pos bigint, slen bigint, soff bigint"
NODES = "inode bigint, type string, name string, parent bigint"
WAL_RECORD = "seq bigint, op int, inode bigint, indx bigint, off bigint, slice_id bigint, size bigint, slice_off bigint, slice_len bigint"
PACK_INDEX = "array<struct<off:bigint,len:bigint,stored_off:bigint,stored_len:bigint,codec:int>>"
ACL = "array<struct<tag:int,perm:int,id:bigint>>"
