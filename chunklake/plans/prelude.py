"""DuckDB twins of the derived tables in sources.fixtures, as CTEs; with_() gives those that a query names, and what they need."""

from __future__ import annotations

import re

T0 = "TIMESTAMP '2024-01-01 00:00:00'"

CTES = {
    "objects": f"SELECT lang AS domain, lang || '/' || source || '/' || doc_id AS ref, doc_id, sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS size_b, doc_id % 17 = 0 AS pending, {T0} + to_seconds(doc_id // 3) AS created_at FROM documents",
    "bytes_": "SELECT lang AS domain, doc_id, lang || '/' || source || '/' || doc_id AS ref, encode(text) AS b FROM documents WHERE octet_length(encode(text)) > 0",
    "chunks": "SELECT domain, doc_id, ref, seq, sha256(b[seq * 256 + 1:(seq + 1) * 256]) AS chunk_hash, CAST(octet_length(b[seq * 256 + 1:(seq + 1) * 256]) AS BIGINT) AS size FROM (SELECT *, unnest(range(0, (octet_length(b) + 255) // 256)) AS seq FROM bytes_)",
    "owned": "SELECT *, min(doc_id) OVER (PARTITION BY domain, chunk_hash) AS owner FROM chunks",
    "idx": "SELECT domain, chunk_hash, doc_id, seq, size FROM chunks QUALIFY row_number() OVER (PARTITION BY domain, chunk_hash ORDER BY doc_id, seq) = 1",
    "new_chunks": "SELECT *, row_number() OVER (PARTITION BY domain ORDER BY doc_id, seq) AS rn FROM owned WHERE owner = doc_id",
    "fold": "SELECT domain, rn, doc_id, seq, ref, chunk_hash, size, 0::BIGINT AS pack_no, size AS filled FROM new_chunks WHERE rn = 1 UNION ALL SELECT n.domain, n.rn, n.doc_id, n.seq, n.ref, n.chunk_hash, n.size, CASE WHEN f.filled >= 4096 THEN f.pack_no + 1 ELSE f.pack_no END, CASE WHEN f.filled >= 4096 THEN n.size ELSE f.filled + n.size END FROM fold f JOIN new_chunks n ON n.domain = f.domain AND n.rn = f.rn + 1",
    "packs": "SELECT domain, pack_no, CAST(sum(size) AS BIGINT) AS size, count(*) AS chunks, CAST(sum(size) AS BIGINT) * 6 // 10 AS stored FROM fold GROUP BY domain, pack_no",
    "chunk_pack": "SELECT domain, chunk_hash, min(pack_no) AS pack_no FROM fold GROUP BY domain, chunk_hash",
    "assoc": "SELECT DISTINCT c.domain, p.pack_no, c.ref AS context FROM chunks c JOIN chunk_pack p USING (domain, chunk_hash)",
    "manifests": f"SELECT CAST(conv_id AS VARCHAR) AS owner_key, lpad(CAST(turn AS VARCHAR), 6, '0') AS version, {T0} + to_hours(turn) AS created_at, encode(text) AS payload, turn, role FROM conversations",
    "changelog": "SELECT event_id AS lsn, user_id AS ino, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS op, props AS payload, ts, value FROM events",
    "slices": "SELECT *, inode * 100 + id AS slice_id FROM (SELECT CAST(l_orderkey AS BIGINT) AS inode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, CAST((l_partkey % 50) * 10 AS BIGINT) AS pos, CAST(CAST(l_quantity AS INTEGER) * 4 AS BIGINT) AS slen, 0::BIGINT AS soff FROM lineitem)",
    "nodes": "SELECT 1::BIGINT AS inode, 'dir' AS type, '' AS name, 0::BIGINT AS parent, 0::BIGINT AS length UNION ALL SELECT r_regionkey + 10, 'dir', r_name, 1, 0 FROM region UNION ALL SELECT n_nationkey + 100, 'dir', n_name, n_regionkey + 10, 0 FROM nation UNION ALL SELECT c_custkey + 1000, 'file', c_name, c_nationkey + 100, CAST(greatest(floor(c_acctbal), 0) AS BIGINT) FROM customer",
    "keys": "SELECT regexp_replace(url, '^https?://', '') AS key, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages",
    "requests": "SELECT user_id AS bucket_key, event_id, epoch_ms(ts) AS ms, value, event_type FROM events",
}


def with_(sql: str) -> str:
    """sql behind the CTEs that it names."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b(?!\s*\()", text):
                need.append(name)
                add(CTES[name])

    add(sql)
    order = [n for n in CTES if n in need]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + " " + sql if order else sql
