"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g') AS body FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM g
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _places(kind: int, pattern: str, head: str = "0", keep: str = "true") -> str:
    """Spans of a pattern: what lies between matches and the matches alternate; ``head`` is the length of what stands before the span itself."""
    return f"""SELECT r, {kind} AS kind, CAST(list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : k - 1], lambda x: length(x))), 0) + {head} AS BIGINT) AS a,
    CAST(list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + list_sum(list_transform(found[1 : k], lambda x: length(x))) AS BIGINT) AS e
  FROM (SELECT r, found, gaps, unnest(generate_series(1, len(found))) AS k FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE {keep}"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ACCOUNT = """(^|[^A-Za-z0-9_])(?i:user(?:name)?|login|client_?id|account)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9._@-]{3,}"""
_ENDPOINT = """(^|[^A-Za-z0-9_])(?i:https?|wss?|postgres|mysql|mongodb|redis|s3)://[^\\x00-\\x20"''<>]+"""
_BEFORE = "length(regexp_extract(found[k], '^[^A-Za-z0-9_]'))"
_NAMES = "['assign', 'access', 'hex', 'linked_account', 'linked_secret', 'linked_endpoint']"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_places(0, _ASSIGN, keep="length(regexp_extract(found[k], '" + _ASSIGN + "', 1)) >= 6")} UNION ALL {_places(1, "AKIA[A-Z0-9]+", keep="length(found[k]) >= 20")} UNION ALL {_places(2, "[0-9a-f]+", keep="length(found[k]) >= 24")}),
cand AS (SELECT * FROM ({_places(3, _ACCOUNT, _BEFORE)} UNION ALL {_places(4, "[A-Za-z0-9+/_-]{20,}", keep="regexp_matches(found[k], '[0-9]') AND regexp_matches(found[k], '[a-z]') AND regexp_matches(found[k], '[A-Z]')")} UNION ALL {_places(5, _ENDPOINT, _BEFORE)}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.a < w.e AND w.a < b.e)),
weak AS (SELECT * FROM cand w WHERE kind <> 4 OR NOT EXISTS (SELECT 1 FROM cand o WHERE o.r = w.r AND o.kind <> 4 AND o.a < w.e AND w.a < o.e)),
part AS (SELECT r, a, CASE WHEN kind IN (0, 2, 4) THEN 'secret' WHEN kind = 5 THEN 'endpoint' ELSE 'account' END AS role, kind IN (1, 3) AND NOT EXISTS (SELECT 1 FROM weak x WHERE x.r = p.r AND x.kind = 5 AND x.a < p.e AND p.a < x.e) AS apart
  FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) p),
met AS (SELECT w.r, w.kind, w.a, w.e, bool_or(p.role = 'secret') AS has_secret, bool_or(p.role = 'account') AS has_account, bool_or(p.apart) AS has_apart FROM weak w JOIN part p ON p.r = w.r AND abs(p.a - w.a) <= 200 GROUP BY ALL),
linked AS (SELECT r, kind, a, e FROM met WHERE CASE kind WHEN 3 THEN has_secret WHEN 4 THEN has_account ELSE has_secret AND has_apart END),
written AS (SELECT r, string_agg({_NAMES}[kind + 1] || ':' || a || ':' || e, ',' ORDER BY a, kind, e) AS s FROM (SELECT * FROM base UNION SELECT * FROM linked) GROUP BY r),
counted AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, string_agg({_NAMES}[kind + 1] || ':' || a || ':' || e, ',' ORDER BY a, kind) AS s FROM base GROUP BY r),
more AS (SELECT r, count(DISTINCT (kind, a, e)) AS n FROM linked GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(counted.s, '')) AS base_sha256, coalesce(written.s, '') AS spans, coalesce(more.n, 0) AS n_linked
FROM d LEFT JOIN counted USING (r) LEFT JOIN written USING (r) LEFT JOIN more USING (r)
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, doc_id, k, list_filter(string_split_regex(l[k], '{SPACE}+'), lambda x: x <> '') AS w FROM (SELECT *, unnest(generate_series(1, len(l))) AS k FROM (SELECT r, doc_id, string_split(t, chr(10)) AS l FROM d))),
solid AS (SELECT r, doc_id, k, w, CAST(sum(len(w)) OVER (PARTITION BY r ORDER BY k) - len(w) AS BIGINT) AS a FROM lines WHERE len(w) > 0),
text AS (SELECT r, doc_id, flatten(list(w ORDER BY k)) AS w FROM solid GROUP BY r, doc_id),
v AS (SELECT *, list_transform(generate_series(1, len(v) - 2), lambda i: (v[i] + 1000003 * v[i + 1] + 998244353 * v[i + 2]) % 4294967291) AS m FROM (SELECT *, list_transform(w, lambda x: CAST('0x' || md5(x)[1:8] AS BIGINT)) AS v FROM text WHERE len(w) >= 26)),
here AS (SELECT r, s + 26 - list_position(list_reverse(m[s + 1 : s + 26]), list_min(m[s + 1 : s + 26])) AS a FROM (SELECT r, m, unnest(generate_series(0, len(v) - 51)) AS s FROM v WHERE len(v) > 50)
  UNION SELECT r, 0 FROM v UNION SELECT r, len(w) - 26 FROM v UNION SELECT r, a FROM solid WHERE len(w) >= 26 UNION SELECT r, a + len(w) - 26 FROM solid WHERE len(w) >= 26),
windows AS (SELECT 1 AS kind, r, doc_id, a, a + 26 AS e, [w[a + 1 : a + 26]] AS g FROM here JOIN text USING (r)
  UNION ALL SELECT 2, r, doc_id, a, a + len(w) + len(w2) + len(w3), [w, w2, w3] FROM (SELECT *, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM solid WINDOW p AS (PARTITION BY r ORDER BY k)) WHERE w3 IS NOT NULL),
later AS (SELECT r, a, e FROM (SELECT *, row_number() OVER (PARTITION BY kind, g ORDER BY doc_id NULLS FIRST, a) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(a, e)) AS p FROM later),
runs AS (SELECT r, min(p) AS a, max(p) + 1 AS e FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM gone) GROUP BY r, island),
told AS (SELECT r, sum(e - a) AS n, string_agg(a || '-' || e, ',' ORDER BY a) AS removed FROM runs GROUP BY r),
stay AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS s FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM text) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(s, '')) AS words_sha256
FROM d LEFT JOIN text USING (r) LEFT JOIN told USING (r) LEFT JOIN stay USING (r)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

def _seats(parties: str, within: str, party: str, votes: str, seats: str) -> str:
    """Seats by the highest quotients, all of them listed: party and quota."""
    return f"""SELECT {within}, {party}, count(*) FILTER (WHERE place <= {seats}) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY {votes} / (2 * k + 1) DESC, {party}, k) AS place FROM (SELECT *, unnest(generate_series(0, most - 1)) AS k FROM {parties})) GROUP BY {within}, {party}"""


OP5 = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT *, CAST([1, 2, 3][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM s WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN level * weight > cap THEN cap ELSE weight * (SELECT arg_min(level, (cap / weight, rank)) FROM lv WHERE level * weight <= cap) END AS target, CAST(greatest(ceil(source_size / 1000000), 1) AS BIGINT) AS n_shards FROM lv),
placed AS (SELECT doc_id, size, rank, shard, CAST(sum(size) OVER (PARTITION BY rank, shard ORDER BY md5('18|' || doc_id), doc_id) AS BIGINT) AS till
  FROM (SELECT d.*, rank, CAST('0x' || md5('17|' || doc_id)[1:8] AS BIGINT) % n_shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0)),
sh AS (SELECT rank, shard, shard // 1000 AS bundle, max(till) AS shard_size, CAST(greatest(round(max(till) / 128), 1) AS BIGINT) AS n_blocks, 3 * CAST(greatest(round(max(till) / 128), 1) AS BIGINT) AS most FROM placed GROUP BY ALL),
bu AS (SELECT rank, bundle, CAST(sum(shard_size) AS BIGINT) AS words, CAST(sum(most) AS BIGINT) AS most FROM sh GROUP BY rank, bundle),
v AS (SELECT 1 AS one, t.rank, target, CAST(sum(bu.most) AS BIGINT) AS most, (SELECT CAST(round(sum(target) / 128) AS BIGINT) FROM t) AS seats FROM t JOIN bu USING (rank) GROUP BY t.rank, target),
q AS ({_seats("v", "one", "rank", "target", "seats")}),
vb AS (SELECT bu.*, quota AS seats FROM bu JOIN q USING (rank)),
qb AS ({_seats("vb", "rank", "bundle", "words", "seats")}),
w AS (SELECT sh.*, rank || '|' || bundle AS of_bundle, quota AS seats FROM sh JOIN qb USING (rank, bundle)),
sq AS ({_seats("w", "of_bundle, rank", "shard", "shard_size", "seats")}),
m AS (SELECT *, md5('19|' || rank || '|' || shard) AS h FROM sh JOIN sq USING (rank, shard)),
b AS (SELECT *, quota // n_blocks + CASE WHEN ([2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497][CAST('0x' || h[1:8] AS BIGINT) % 8 + 1] * block + CAST('0x' || h[9:16] AS BIGINT)) % n_blocks < quota % n_blocks THEN 1 ELSE 0 END AS times,
    CAST(floor(block * shard_size / n_blocks) AS BIGINT) AS lo, CAST(floor((block + 1) * shard_size / n_blocks) AS BIGINT) AS hi FROM (SELECT *, unnest(generate_series(0, n_blocks - 1)) AS block FROM m)),
x AS (SELECT doc_id, CAST(sum(times * (least(till, hi) - greatest(till - size, lo))) AS BIGINT) AS taken FROM placed p JOIN b ON p.rank = b.rank AND p.shard = b.shard AND hi > till - size AND lo < till GROUP BY doc_id)
SELECT d.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON d.doc_id = x.doc_id
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i : i + 12] AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(g) AS n FROM win),
said AS (SELECT r, n, p, w[p : p + n - 1] AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, size WHERE len(w) >= n)),
hit AS (SELECT r, p, n, g FROM said WHERE g IN (SELECT g FROM win)),
place AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS spot FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit JOIN win USING (g)) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN place USING (r) LEFT JOIN item USING (r)
"""

OP8 = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 12 + 10 + 11 AS n FROM m
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
"""

OP9 = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, url AS request_target, true AS has_metadata
FROM p LEFT JOIN f ON p.digest = f.digest
"""

OP10 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k
  FROM pages
), l(h, p, v, late) AS (VALUES
  ('net', '/', 'block', false), ('example.net', '/en/', 'allow', false), ('example.com', '/de/', 'block', false), ('org', '/fr/', 'allow', false)
  UNION ALL
  SELECT name || '.example.' || top, '/', 'block', true FROM (VALUES ('ads-track'), ('casino-win'), ('free-bets'), ('spam-farm')) AS a(name), (VALUES ('com'), ('net'), ('org')) AS b(top)
), fits AS (
  SELECT k, h || p AS name, v, late, row_number() OVER (PARTITION BY k ORDER BY late, length(h || p) DESC, h || p) AS n
  FROM u JOIN l ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
)
SELECT page_id, host, path, CASE WHEN NOT late THEN name END AS rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN fits ON u.k = fits.k AND n = 1
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS g FROM (SELECT *, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
later AS (SELECT r, s FROM (SELECT *, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 50)) AS p FROM later),
runs AS (SELECT r, min(p) AS a, max(p) + 1 AS e FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM gone) GROUP BY r, island),
told AS (SELECT r, sum(e - a) AS n, string_agg(a || '-' || e, ',' ORDER BY a) AS removed FROM runs GROUP BY r),
stay AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS s FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN stay USING (r)
"""

#: CRC-32 of a text's bytes: the polynomial is 0xEDB88320, each step takes one bit.
_BITS = "list_reduce(range(0, 8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
_CRC32 = "xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: " + _BITS.format("xor(c, x)") + ", 4294967295))"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC32} AS h, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT *, (h // 10) % greatest(len(w), 1) AS a FROM d),
t AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(0, len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM c),
words AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM t),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i),
parts AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 1 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM parts WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s, min((-length, start, period)) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
stay AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_runs, 0) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period, CAST(-1000 * best[1] // best[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(told.s, '')) AS runs_sha256, sha256(coalesce(stay.s, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (r) LEFT JOIN stay USING (r)
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1, "op2_secret_scan": OP2, "op3_line_dedup": OP3, "op4_near_dedup": OP4, "op5_mixing": OP5, "op6_decontamination": OP6, "op8_chat_format": OP8, "op9_warc": OP9, "op10_url_filter": OP10, "op11_periodic_runs": OP11, "op12_hard_negatives": OP12, "op13_substring_dedup": OP13}
