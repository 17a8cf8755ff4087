"""DuckDB counterparts of the numbered queries that SQL can express."""

from __future__ import annotations

from kerbwise.llm.url_filter import BLOCK_WORDS

_RANKED = "(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END)"

ORACLE: dict[str, str] = {}

ORACLE["op5_exact_dedup"] = f"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS t, length(coalesce(text, '')) AS points FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
  WINDOW w AS (PARTITION BY t ORDER BY points DESC, {_RANKED}, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""

ORACLE["op6_url_filter"] = f"""
WITH u AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(rule, host, path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fit AS (
  SELECT u.page_id, u.host, u.path, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS place
  FROM u LEFT JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(BLOCK_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM fit WHERE place = 1
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {s}) & 31)::INT, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

ORACLE["op10_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT page_id, octet_length(encode(html)) AS n, {_BASE32} AS digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM r
"""

#: CRC-32 of the ASCII text of a number: the reflected polynomial, a bit at a time.
_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: "
    "list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
)


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))


def _tree(name: str, leaves: str) -> str:
    """Levels of trees over (tree, place, hash): level, tree, place, size and hash of every node."""
    return f"""{name}(level, tree, place, size, hash) AS (
  SELECT 0, tree, place, (count(*) OVER (PARTITION BY tree))::BIGINT, hash FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, place // 3, ((max(size) + 2) // 3)::BIGINT, sha256(string_agg(hash, '' ORDER BY place)) FROM {name}
  WHERE size > 1 GROUP BY level, tree, place // 3
)"""


def _siblings(name: str) -> str:
    """For each node below the top of its tree the hashes before and after it in its run."""
    return f"""{name}_run AS (
  SELECT n.level, n.tree, n.place,
         coalesce(string_agg(o.hash, '' ORDER BY o.place) FILTER (WHERE o.place < n.place), '') AS lefts,
         coalesce(string_agg(o.hash, '' ORDER BY o.place) FILTER (WHERE o.place > n.place), '') AS rights
  FROM {name} n JOIN {name} o ON n.level = o.level AND n.tree = o.tree AND n.place // 3 = o.place // 3
  WHERE n.size > 1 GROUP BY n.level, n.tree, n.place
)"""


ORACLE["op12_merkle"] = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, sha256({_FIELDS} || {_field("text")}) AS hash,
         CASE WHEN {_CRC} % 2 = 0 THEN sha256({_FIELDS} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_FIELDS} || {_field("text")}) END AS after,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST) - 1 AS place
  FROM documents
), {_tree("low", "l")}, {_siblings("low")},
s AS (SELECT 0 AS tree, tree AS place, hash FROM low WHERE size = 1),
{_tree("high", "s")}, {_siblings("high")},
root AS (SELECT hash AS root FROM high WHERE size = 1),
climb(doc_id, level, tree, place, folded, proof) AS (
  SELECT doc_id, 0, tree, place, after, '' FROM l
  UNION ALL
  SELECT c.doc_id, c.level + 1, c.tree, c.place // 3, sha256(r.lefts || c.folded || r.rights), c.proof || r.lefts || r.rights
  FROM climb c JOIN low_run r ON c.level = r.level AND c.tree = r.tree AND c.place = r.place
), upper AS (
  SELECT c.doc_id, c.tree, c.folded, c.proof FROM climb c JOIN low n ON c.level = n.level AND c.tree = n.tree AND c.place = n.place WHERE n.size = 1
), climb_high(doc_id, level, place, folded, proof) AS (
  SELECT doc_id, 0, tree, folded, proof FROM upper
  UNION ALL
  SELECT c.doc_id, c.level + 1, c.place // 3, sha256(r.lefts || c.folded || r.rights), c.proof || r.lefts || r.rights
  FROM climb_high c JOIN high_run r ON c.level = r.level AND c.place = r.place
)
SELECT l.doc_id, l.hash AS leaf, t.hash AS subroot, root.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root.root AS verified
FROM l JOIN s t ON l.tree = t.place CROSS JOIN root
JOIN climb_high c ON l.doc_id = c.doc_id JOIN high n ON c.level = n.level AND c.place = n.place AND n.size = 1
"""
