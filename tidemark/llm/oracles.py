"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.llm.license_scan import BASE, BASE_CONFIDENCE, CONFIDENCE, license_rules
from tidemark.llm.url_filters import RULES, Spread

WORD = r"[^\x20\x09-\x0D]+"


def _ascii_lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, text: str) -> str:
    """Rows (key, s) of the distinct 5-word shingles of every text that has words."""
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, regexp_extract_all({text}, '{WORD}') AS w FROM {table} WHERE text IS NOT NULL)"""


def _components(nodes: str, links: str) -> str:
    """Recursive tables: reach(a, b) of everything that links reach; links has both directions."""
    return f"reach(a, b) AS (SELECT id, id FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a)"


OP1 = f"""
WITH d AS ({_shingles("documents", "doc_id", "lower(text)")}), i AS ({_shingles("benchmark", "item_id", "lower(text)")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM p JOIN n USING (item_id) WHERE 4 * shared >= 3 * item_shingles
"""


def _op2(how: Spread = Spread(), rounds: int = 80) -> str:
    """Scores after so many steps that no more changes."""
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    by_rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    text = f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, coalesce({_ascii_lower("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, {rule} AS rule, {by_rule} AS by_rule FROM u),
h AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM v WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, {_ascii_lower("unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?(?:[a-z]+:)?//([^\"''/?#>\\s]+)', 1))")} AS dst FROM v WHERE html IS NOT NULL),
hosts AS (SELECT host FROM v WHERE host <> '' UNION SELECT dst FROM links WHERE dst <> ''),
split AS (SELECT string_split(host, '.') AS p FROM hosts),
family AS (SELECT DISTINCT array_to_string(p[i:], '.') AS child, array_to_string(p[i + 1:], '.') AS parent
           FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM split WHERE len(p) >= 3)),
e AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT src, dst FROM links UNION ALL SELECT child, parent FROM family
      UNION ALL SELECT parent, child FROM family) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)"""
    for kind, src, dst in (("allowed", "src", "dst"), ("blocked", "dst", "src")):
        text += f""",
g_{kind} AS (SELECT {src} AS src, {dst} AS dst, w / sum(w) OVER (PARTITION BY {src}) AS share FROM e),
s_{kind} AS (SELECT host, {kind} / (SELECT sum({kind}) FROM h) AS seed FROM h WHERE {kind} > 0),
{kind}_0 AS (SELECT host, seed AS score FROM s_{kind})"""
        for i in range(rounds):
            text += f""",
{kind}_{i + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (
  SELECT g.dst AS host, p.score * g.share * {how.damping} AS score FROM {kind}_{i} p JOIN g_{kind} g ON g.src = p.host
  UNION ALL SELECT host, seed * {1 - how.damping} FROM s_{kind}) GROUP BY host)"""
    return text + f"""
SELECT page_id, v.host, path, rule,
       coalesce(by_rule, CASE WHEN coalesce(b.score, 0) > {how.factor} * coalesce(a.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN allowed_{rounds} a ON a.host = v.host LEFT JOIN blocked_{rounds} b ON b.host = v.host
"""


OP3 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 49)) AS p, x FROM t WHERE len(x) >= 100),
k AS (SELECT doc_id, p, x[2 * p + 1:2 * p + 100] AS s FROM w),
f AS (SELECT s, min(doc_id) AS first_doc FROM k GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS b FROM k JOIN f USING (s) WHERE first_doc < doc_id),
g AS (SELECT doc_id, list(b) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n_spans FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.b = c.b - 1) GROUP BY doc_id),
b AS (SELECT doc_id, unnest(range(0, len(x) // 2)) AS b, x FROM t SEMI JOIN g USING (doc_id)),
kept AS (SELECT b.doc_id, string_agg(x[2 * b.b + 1:2 * b.b + 2], '' ORDER BY b.b) AS y FROM b ANTI JOIN c ON c.doc_id = b.doc_id AND c.b = b.b GROUP BY b.doc_id)
SELECT t.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN g.doc_id IS NULL THEN x ELSE coalesce(y, '') END)) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_components("v", "links")},
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.id AS vec_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, min(b) AS component_id, v.id = min(b) AS kept
FROM v JOIN reach ON reach.a = v.id LEFT JOIN n ON n.a = v.id GROUP BY v.id
"""

OP6 = f"""
WITH c AS (SELECT source, lang, text, doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
t AS (SELECT source, lang, unnest([{{'v': 'words-1', 'n': len(regexp_extract_all(coalesce(text, ''), '{WORD}'))}},
                                   {{'v': 'bytes-1', 'n': strlen(coalesce(text, ''))}}]) AS x
      FROM c WHERE NOT coalesce(doc_id > first_id, false))
SELECT source, lang, x.v AS tokenizer_version, count(*) AS docs, sum(x.n)::BIGINT AS tokens FROM t GROUP BY ALL
"""

OP7 = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM t WHERE len(w) >= 20)),
r AS (SELECT doc_id, p, (doc_id, p) > min((doc_id, p)) OVER (PARTITION BY s) AS later FROM k),
c AS (SELECT doc_id, list(DISTINCT b) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS b FROM r WHERE later) GROUP BY doc_id),
m AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN c USING (doc_id)),
o AS (SELECT doc_id, b, x FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS b, unnest(w) AS x FROM m)),
kept AS (SELECT o.doc_id, string_agg(x, ' ' ORDER BY o.b) AS y FROM o ANTI JOIN (SELECT doc_id, unnest(gone) AS b FROM m) g ON g.doc_id = o.doc_id AND g.b = o.b GROUP BY o.doc_id)
SELECT m.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(y, '')) AS kept_sha256 FROM m LEFT JOIN kept USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS ({_shingles("documents", "doc_id", _ascii_lower("text"))}),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),
{_components("nodes", "links")}
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM nodes JOIN reach ON reach.a = id LEFT JOIN n ON n.doc_id = id GROUP BY id
"""



def _op11(phrases: Sequence[tuple[str, str]] = BASE) -> str:
    """Base places by position in the list of words; rules by the pieces between their matches."""
    rules = ", ".join(f"({i}, '{r.label}', '{r.keyword}', '{r.pattern}', {r.priority})" for i, r in enumerate(license_rules()))
    sure = "CASE priority " + " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items()) + " END"
    places = " UNION ALL ".join(
        f"SELECT id, '{label}' AS label, p FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS p FROM t WHERE len(w) >= {n}) "
        f"WHERE w[p:p + {n - 1}] = [{', '.join(repr(x) for x in phrase.split())}]"
        for phrase, label in phrases for n in [len(phrase.split())])
    return f"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_ascii_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS ({places}),
base AS (SELECT id, count(*) AS n, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY id),
rules(number, label, keyword, pattern, priority) AS (VALUES {rules}),
lines AS (SELECT id, ' ' || array_to_string(w, '  ') || ' ' AS line, ' ' || array_to_string(w, ' ') || ' ' AS single FROM t WHERE len(w) > 0),
ran AS (SELECT id, number, label, priority, regexp_extract_all(line, ' ' || replace(pattern, ' ', '  ') || ' ') AS found, string_split_regex(line, ' ' || replace(pattern, ' ', '  ') || ' ') AS rest
        FROM lines JOIN rules ON contains(single, keyword)),
hit AS (SELECT * FROM ran WHERE len(found) > 0),
k AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM hit),
d AS (SELECT id, number, label, priority, list_sum([length(x) FOR x IN rest[1:k]]) + coalesce(list_sum([length(x) FOR x IN found[1:k - 1]]), 0) AS s, length(found[k]) AS n FROM k),
kept AS (SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.id = a.id AND b.number <> a.number AND b.s <= a.s AND b.s + b.n >= a.s + a.n AND b.priority >= a.priority
         AND (b.priority > a.priority OR b.n > a.n OR b.number < a.number))),
more AS (SELECT id, list(DISTINCT label) AS labels, max({sure})::DOUBLE AS score FROM kept GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       greatest(CASE WHEN base.n > 0 THEN {BASE_CONFIDENCE} ELSE 0 END, coalesce(more.score, 0))::DOUBLE AS score
FROM t LEFT JOIN base USING (id) LEFT JOIN more USING (id)
"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ascii_lower("text")}, '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_ascii_lower("text")}, '{TERM}')) AS t FROM benchmark),
f AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
g AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN g USING (t), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

#: crc32 of a decimal number, bit by bit.
CRC32 = """(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)))"""
OP13 = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
                    md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS s, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS hub, xor({CRC32}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
again AS (SELECT c.conv_id, own.i, s, n, 0 AS mine FROM c JOIN own ON own.conv_id = c.hub AND own.i < h
         UNION ALL SELECT conv_id, own.i, s, n, 1 FROM c JOIN own USING (conv_id) WHERE own.i >= h),
t AS (SELECT conv_id, row_number() OVER w AS depth, n, md5(string_agg(s, '') OVER w) AS k FROM again WINDOW w AS (PARTITION BY conv_id ORDER BY mine, i)),
p AS (SELECT conv_id, depth, n, k FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id),
ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS x FROM e GROUP BY k),
node AS (SELECT k, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(n) AS n, count(*) AS n_convs FROM p GROUP BY k),
up AS (SELECT a.k, a.conv_id, a.depth, a.n_convs, a.n, b.k AS above FROM node a LEFT JOIN p b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
kids AS (SELECT above AS k, count(*) AS n_children FROM up WHERE above IS NOT NULL GROUP BY above),
sub AS (SELECT b.k AS top, sum((a.n_convs - 1) * a.n) AS saved, count(*) FILTER (kids.k IS NULL) AS n_leaves
        FROM node a JOIN p b ON b.conv_id = a.conv_id AND b.depth <= a.depth LEFT JOIN kids ON kids.k = a.k GROUP BY b.k)
SELECT u.conv_id, u.depth, parent.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens,
       coalesce(ends.x, sha256('')) AS ends_sha256
FROM up u LEFT JOIN node parent ON parent.k = u.above LEFT JOIN kids ON kids.k = u.k LEFT JOIN ends ON ends.k = u.k JOIN sub ON sub.top = u.k
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op2_url_filters": _op2(),
    "op3_suffix_dedup": OP3,
    "op4_embedding_dedup": OP4,
    "op6_token_counts": OP6,
    "op7_substring_dedup": OP7,
    "op10_jaccard_join": OP10,
    "op11_license_scan": _op11(),
    "op12_lexical_search": OP12,
    "op13_prefix_trie": OP13,
}
