"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, {_WORDS})) END::BIGINT AS size,
         ('0x' || substr(md5('mix ' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::BIGINT AS weight FROM s),
l AS (SELECT *, source_size::DOUBLE / weight AS level FROM w),
p AS (
  SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (
           ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM l),
f AS (SELECT *, remaining * weight <= 200 * source_size * open_weight AS fits FROM p),
first AS (SELECT remaining AS r, open_weight AS o FROM f WHERE fits ORDER BY level, source NULLS LAST LIMIT 1),
g AS (SELECT *, bool_or(fits) OVER (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS free FROM f),
t AS (
  SELECT source, source_size, CASE WHEN free THEN (r * weight)::DOUBLE / (100 * o)::DOUBLE ELSE (200 * source_size)::DOUBLE / 100 END AS target
  FROM g LEFT JOIN first ON true),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS until, sum(size) OVER (PARTITION BY source, key) AS here FROM d),
m AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget, c.until, c.here
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + CASE
          WHEN budget % source_size >= until THEN size
          WHEN budget % source_size > until - here THEN ((budget % source_size - until + here) * size) // here
          ELSE 0 END END)::BIGINT AS taken
FROM m
"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_TERM}), []) AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all({_LOWER}, {_TERM}), []) AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), 13) AS k, array_to_string(words[i:i + 12], ' ') AS pattern
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d JOIN sizes ON len(words) >= k),
hits AS (
  SELECT p.doc_id, p.i, p.k, x.item
  FROM (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS pattern FROM places) p JOIN windows x ON x.pattern = p.pattern AND x.k = p.k),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit > 0 AND 20 * n.n_hit >= len(d.words), false) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

_CONTROL = r"'</?s>|\[/?(INST|ANSWER|ROLE)\]|\[TEXT\]|&(lt|lb|amp);'"


def _escaped(text: str) -> str:
    out = f"replace({text}, '&', '&amp;')"
    for c in ("</s>", "<s>", "[/INST]", "[INST]", "[/ANSWER]", "[ANSWER]", "[/ROLE]", "[ROLE]", "[TEXT]"):
        out = f"replace({out}, '{c}', '{('&lt;' if c[0] == '<' else '&lb;') + c[1:]}')"
    return out


OP8 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, CASE WHEN regexp_matches(role, {_CONTROL}) OR regexp_matches(text, {_CONTROL}) THEN {_escaped('text')} ELSE text END AS body,
         CASE WHEN regexp_matches(role, {_CONTROL}) OR regexp_matches(text, {_CONTROL}) THEN {_escaped('role')} ELSE role END AS name FROM rows),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(body) + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 26 ELSE 30 + length(name) END) AS chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars
FROM g
"""

_HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '')"

OP10 = rf"""
WITH p AS (SELECT page_id, {_HOST} AS host, DATE '2024-01-01' + (page_id * 37 % 366)::INTEGER AS fetched FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM p WHERE host IS NOT NULL),
x AS (SELECT host, array_to_string(labels[i:], '.') AS entry, i FROM (SELECT host, labels, unnest(range(1, greatest(1, len(labels) - 1) + 1)) AS i FROM h)),
e AS (SELECT DISTINCT entry, ('0x' || substr(md5(entry), 1, 4))::INTEGER AS number FROM x WHERE i <= 2),
c AS (
  SELECT entry, (['ads', 'gambling', 'malware'])[(number // 3) % 3 + 1] AS category,
         DATE '2024-01-01' + ((number * 7 + k * 97) % 366)::INTEGER AS changed, CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action
  FROM e, range(0, 4) AS r(k) WHERE number % 3 = 0),
state AS (
  SELECT p.page_id, c.entry, c.category, arg_max(c.action, (c.changed, c.action)) AS last
  FROM p JOIN x ON x.host = p.host JOIN c ON c.entry = x.entry AND c.changed <= p.fetched GROUP BY ALL),
a AS (
  SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries
  FROM state WHERE last = 'add' GROUP BY page_id)
SELECT p.page_id, p.host, p.fetched::DATE::VARCHAR AS fetched, a.page_id IS NOT NULL AS blocked, coalesce(a.categories, '') AS categories, coalesce(a.entries, '') AS entries
FROM p LEFT JOIN a ON a.page_id = p.page_id
"""

OP3 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_GAP, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

OP11 = rf"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_GAP}*{_SOLID}+|{_GAP}+') AS tokens, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain,
         ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm FROM h),
c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS lo, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS hi FROM d),
p AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, array_to_string(tokens[1:lo], '') AS prefix,
         array_to_string(tokens[lo + 1:hi], '') AS middle, array_to_string(tokens[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP12 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 5) AS r(k) WHERE len(words) >= k),
f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * c.a // (x.f + y.f))::HUGEINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(words[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(words[s:s + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, words, k, m, unnest(range(1, k - m + 2)) AS s FROM c, range(2, 4) AS q(m) WHERE m < k)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.most IS NULL OR 100 * o.most::HUGEINT < 80 * b.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT x.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score
FROM ranked x JOIN n ON n.lang = x.lang WHERE rank <= 2000
"""


def _network_sql(rows: str) -> str:
    """Six rounds over (x, y) of a * b numbers."""
    for r in range(6):
        m, c, s = (f"(('0x' || sha256('42:{r}:{name}')[1:7])::BIGINT | 1)" for name in "mcs")
        own, other, size = ("x", "y", "a") if r % 2 == 0 else ("y", "x", "b")
        mixed = f"({other} * {m} + {c})"
        drawn = f"(((xor({mixed}, {mixed} >> 14) & 2147483647) * {s}) >> 20)"
        rows = f"(SELECT i, k, a, b, n, ({own} + {drawn}) % {size} AS {own}, {other} FROM {rows})"
    return rows


# the CRC goes by half bytes, low half first
OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () - 1 AS i FROM documents),
half AS (
  SELECT list(list_reduce([v, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t FROM range(16) AS q(v)),
size AS (SELECT count(*) AS n FROM documents),
square AS (SELECT n, max(a) AS a, (n + max(a) - 1) // max(a) AS b FROM size, range(1, 1000000) AS q(a) WHERE a * a <= n AND (a - n % a) % a <= 16 GROUP BY n),
walk AS (
  SELECT i, 0 AS k, i AS p, a, b, n FROM d, square
  UNION ALL
  SELECT i, k + 1, y * a + x, a, b, n FROM {_network_sql("(SELECT i, k, a, b, n, p % a AS x, p // a AS y FROM walk WHERE k = 0 OR p >= n)")}),
places AS (SELECT i, arg_max(p, k) AS p FROM walk GROUP BY i),
halves AS (SELECT i, list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\\2\\1', 'g'), ''), lambda v: ('0x' || v)::BIGINT) AS v FROM d WHERE text <> ''),
crc AS (SELECT i, xor(list_reduce(list_prepend(4294967295, v), lambda c, z: xor(t[(xor(c, z) & 15) + 1], c >> 4)), 4294967295) AS crc FROM halves, half)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, coalesce(crc, 0)::BIGINT AS text_crc32, 'rows' AS law, (p % 16)::INTEGER AS shard, (p // 16)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM d JOIN places ON places.i = d.i LEFT JOIN crc ON crc.i = d.i
"""

#: The other queries have models or sketches of their own that SQL cannot express; the tests hold them against brute force.
ORACLES = {"op1_mix_sources": OP1, "op2_minhash_dedup": OP2, "op3_nearest": OP3, "op4_decontaminate": OP4, "op8_chat": OP8, "op10_url_filter": OP10,
           "op11_fill_in_middle": OP11, "op12_phrases": OP12, "op13_shards": OP13}
