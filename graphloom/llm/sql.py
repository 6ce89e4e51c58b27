"""SQL of the document operators that SQL can express: their definitions, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Sequence

from graphloom.llm.weighted_tree import Shard, children_of, regular_topology, with_new_shard

WORD = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sets of five-word shingles, all pairs that share one, the links among them, and what links reach.
COUNT_RTREE = f"""
WITH RECURSIVE w AS (SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN LEN(ws) = 0 THEN [] WHEN LEN(ws) < 5 THEN [ARRAY_TO_STRING(ws, ' ')]
           ELSE LIST_TRANSFORM(RANGE(1, LEN(ws) - 3), lambda i: ARRAY_TO_STRING(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
rc AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT rc.d, ln.b FROM rc JOIN ln ON ln.a = rc.r),
least AS (SELECT d AS doc_id, MIN(r) AS component_id FROM rc GROUP BY 1)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)"""

#: All strings of 50 bytes, as hexadecimal digits, the smallest document of each, and the bytes that others' cover.
REPEAT_SUFFIXES = """
WITH hx AS (SELECT doc_id, REGEXP_EXTRACT_ALL(HEX(ENCODE(COALESCE(text, ''))), '..') AS bs FROM documents),
s1 AS (SELECT doc_id, CAST(UNNEST(RANGE(LEN(bs))) AS BIGINT) AS j, UNNEST(bs) AS b FROM hx),
s2 AS (SELECT *, b || LEAD(b, 1) OVER w AS two FROM s1 WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
s4 AS (SELECT *, two || LEAD(two, 2) OVER w AS four FROM s2 WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
s8 AS (SELECT * EXCLUDE four, four || LEAD(four, 4) OVER w AS eight FROM s4 WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
s16 AS (SELECT * EXCLUDE eight, eight || LEAD(eight, 8) OVER w AS sixteen FROM s8 WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
st AS (SELECT doc_id, j, b, sixteen || LEAD(sixteen, 16) OVER w || LEAD(sixteen, 32) OVER w || LEAD(two, 48) OVER w AS s FROM s16
       WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
fs AS (SELECT s, MIN(doc_id) AS d FROM st WHERE s IS NOT NULL GROUP BY s HAVING COUNT(*) > 1),
hit AS (SELECT st.doc_id, st.j, st.b, CAST(fs.d IS NOT NULL AS INT) AS later FROM st LEFT JOIN fs ON fs.s = st.s AND fs.d < st.doc_id),
cov AS (SELECT doc_id, j, b, MAX(later) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
run AS (SELECT *, gone = 1 AND COALESCE(LAG(gone) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 AS begins FROM cov),
found AS (SELECT doc_id, COUNT(*) AS n_bytes, CAST(SUM(gone) AS BIGINT) AS n_removed, COUNT(*) FILTER (WHERE begins) AS n_spans,
                 STRING_AGG(b, '' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM run GROUP BY 1)
SELECT doc_id, COALESCE(n_bytes, 0) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
       SHA256(UNHEX(COALESCE(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN found USING (doc_id)"""

#: All runs of up to ten lines with a word that have ten words, and single shorter lines that two documents hold.
LINE_RUNS = f"""
WITH ln AS (SELECT doc_id, UNNEST(ls) AS t, UNNEST(RANGE(LEN(ls))) AS i FROM (SELECT doc_id, STRING_SPLIT(COALESCE(text, ''), CHR(10)) AS ls FROM documents)),
lw AS (SELECT doc_id, i, t, LEN(REGEXP_EXTRACT_ALL(t, {WORD})) AS words FROM ln),
ten AS (SELECT doc_id, LIST(t) OVER ahead AS ts, LIST(words) OVER ahead AS ws, LIST(i) OVER ahead AS lines FROM lw WHERE words > 0
        WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
runs AS (SELECT doc_id, lines[1] AS i, lines[1:m] AS lines, ARRAY_TO_STRING(ts[1:m], CHR(10)) AS run FROM ten, UNNEST(RANGE(1, LEN(ts) + 1)) t(m) WHERE LIST_SUM(ws[1:m]) >= 10),
first AS (SELECT run, MIN(CAST(doc_id AS HUGEINT) * 1000000000 + i) AS p FROM runs GROUP BY 1),
short AS (SELECT t, MIN(CAST(doc_id AS HUGEINT) * 1000000000 + i) AS p FROM lw WHERE words BETWEEN 1 AND 9 GROUP BY 1 HAVING COUNT(*) > 1),
gone AS (SELECT doc_id, UNNEST(lines) AS i FROM runs JOIN first USING (run) WHERE CAST(doc_id AS HUGEINT) * 1000000000 + i > p UNION
         SELECT doc_id, i FROM lw JOIN short USING (t) WHERE CAST(doc_id AS HUGEINT) * 1000000000 + i > p),
cut AS (SELECT lw.doc_id, COUNT(*) AS n, COUNT(g.i) AS lost, COUNT(*) FILTER (WHERE g.i IS NULL AND words > 0) AS content,
               STRING_AGG(t, CHR(10) ORDER BY lw.i) FILTER (WHERE g.i IS NULL) AS kept FROM lw LEFT JOIN gone g ON g.doc_id = lw.doc_id AND g.i = lw.i GROUP BY 1)
SELECT doc_id, CASE WHEN lost = 0 THEN text WHEN content = 0 THEN '' ELSE kept END AS text,
       CASE WHEN lost = 0 OR content > 0 THEN lost ELSE n END AS n_lines_removed FROM documents JOIN cut USING (doc_id)"""


def _descent_sql(name: str, topology: Sequence[Shard]) -> str:
    """CTEs of <name>(doc_id, shard): each level's child of the smallest draw."""
    rows = ", ".join(f"('{parent}', '{path}', {weight}::DOUBLE)" for parent, kids in children_of(topology).items() for path, weight in kids.items())
    found = [f"{name}_kids AS (SELECT * FROM (VALUES {rows}) t(parent, path, weight))", f"{name}_0 AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS key, '' AS node FROM documents)"]
    for level in (1, 2, 3):
        draw = "-LN((CAST('0x' || SUBSTR(MD5(key || '|' || path), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE) / weight"
        found.append(f"{name}_{level} AS (SELECT doc_id, key, ARG_MIN(path, {draw}) AS node FROM {name}_{level - 1} JOIN {name}_kids ON parent = node GROUP BY 1, 2)")
    return ",\n".join([*found, f"{name} AS (SELECT doc_id, CAST(STRING_SPLIT(node, '/')[-1] AS INT) AS shard FROM {name}_3)"])


#: The table of crc32 by eight steps for each byte.
_CRC_TABLE = """
tab AS (SELECT LIST(c ORDER BY b) AS tab FROM (SELECT b, LIST_REDUCE(RANGE(8), lambda c, k: CASE WHEN c % 2 = 1 THEN XOR(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
        FROM (SELECT CAST(UNNEST(RANGE(256)) AS BIGINT) AS b)))"""


def _crc32(text: str) -> str:
    """crc32 over the bytes of a text, by the table ``tab``."""
    bytes_ = f"LIST_TRANSFORM(REGEXP_EXTRACT_ALL(HEX(ENCODE({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"XOR(LIST_REDUCE({bytes_}, lambda c, b: XOR(c >> 8, tab[(XOR(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


_CRC = f"""{_CRC_TABLE},
crc AS (SELECT doc_id, {_crc32("COALESCE(text, '')")} AS text_crc32, OCTET_LENGTH(ENCODE(COALESCE(text, ''))) + 1 AS size
        FROM documents CROSS JOIN tab)"""

WEIGHTED_HASH_TREE = f"""
WITH {_descent_sql('now', regular_topology())},
{_descent_sql('later', with_new_shard(regular_topology()))},{_CRC}
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, now.shard AS shard,
       ROW_NUMBER() OVER (PARTITION BY now.shard ORDER BY CAST('0x' || SUBSTR(MD5(doc_id || '|' || text_crc32), 1, 8) AS BIGINT) % 1024, doc_id, text_crc32, size) - 1 AS slot, later.shard AS grown_shard
FROM crc JOIN now USING (doc_id) JOIN later USING (doc_id)"""

#: All prefixes of all rebuilt conversations; what lies below a node is found along its smallest conversations.
PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
own AS (SELECT conv_id AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
               SHA256(CAST(OCTET_LENGTH(ENCODE(COALESCE(role, ''))) AS VARCHAR) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS k, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i FROM own),
conv AS (SELECT c, c - c % 100 AS head, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM own) CROSS JOIN tab),
both_ AS (SELECT conv.c, 0 AS part, i, k, text FROM conv JOIN placed ON placed.c = head AND i <= h
          UNION ALL SELECT conv.c, 1, i, k, text FROM conv JOIN placed ON placed.c = conv.c AND i > h),
turns AS (SELECT c, ROW_NUMBER() OVER (PARTITION BY c ORDER BY part, i) AS d, k, LENGTH(text) AS size FROM both_),
pre AS (SELECT c, d, size, STRING_AGG(k, '') OVER (PARTITION BY c ORDER BY d) AS p, d = MAX(d) OVER (PARTITION BY c) AS ended FROM turns
        UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM turns) FROM conv),
node AS (SELECT d, p, MIN(c) AS c, COUNT(*) AS n, MAX(size) AS size, COALESCE(STRING_AGG(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '') AS ends FROM pre GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, SUBSTR(p, 1, 64 * (d - 1)) AS p, COUNT(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT node.*, COALESCE(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
below AS (SELECT pre.d, pre.p, COUNT(*) FILTER (WHERE n_children = 0) AS n_leaves, SUM((n - 1) * f.size) AS saved FROM full_ f JOIN pre ON pre.c = f.c AND pre.d <= f.d GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d AS depth, up.c AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, SHA256(f.ends) AS ends_sha256
FROM full_ f JOIN below USING (d, p) LEFT JOIN node up ON up.d = f.d - 1 AND up.p = SUBSTR(f.p, 1, 64 * (f.d - 1))"""

#: The level that fills sources by rising 3 x size / weight, then all finish times in order.
FAIR_QUEUE = f"""
WITH docs AS (SELECT ROW_NUMBER() OVER () AS id, doc_id, source, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), {WORD})) AS size,
                     CAST('0x' || SUBSTR(MD5(COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || MD5(COALESCE(text, ''))), 1, 15) AS BIGINT) AS place FROM documents),
src AS (SELECT source, number, S, [5, 2, 1][number % 3 + 1] AS w FROM
        (SELECT source, CAST(SUM(size) AS BIGINT) AS S, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM docs GROUP BY source)),
steps AS (SELECT 3 * S / w AS full_at, number, (SELECT SUM(S) FROM src) - COALESCE(SUM(3 * S) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 SUM(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM src WINDOW o AS (ORDER BY 3 * S / w, number)),
lvl AS (SELECT FIRST(CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) ORDER BY full_at, number) FILTER (WHERE CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) <= full_at) AS l FROM steps),
goal AS (SELECT *, CASE WHEN l IS NULL OR w * l > 3 * S THEN CAST(3 * S AS DOUBLE) ELSE w * l END AS target FROM src CROSS JOIN lvl),
waits AS (SELECT id, doc_id, size, number, S, target, SUM(size) OVER (PARTITION BY number ORDER BY place, doc_id NULLS FIRST, size, id) AS words
          FROM docs JOIN goal ON goal.source IS NOT DISTINCT FROM docs.source),
queue AS (SELECT id, size, number, words + p * S AS ends, CAST(words + p * S AS DOUBLE) / target AS finish FROM waits, UNNEST(RANGE(3)) t(p) WHERE size > 0),
served AS (SELECT id, size, SUM(size) OVER (ORDER BY finish, number, ends) AS s FROM queue),
got AS (SELECT id, SUM(size) AS taken FROM served WHERE s <= (SELECT SUM(S) FROM src) GROUP BY 1)
SELECT doc_id, size, S AS source_size, target, CAST(COALESCE(taken, 0) AS BIGINT) AS taken FROM waits LEFT JOIN got USING (id)"""

#: Words that one deletion makes equal, or that are what a deletion leaves.
SPELLING_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, TRANSLATE(run, '{UPPER}', '{LOWER}') AS run, COUNT(*) AS n FROM
         (SELECT doc_id, UNNEST(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE LENGTH(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc32("COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs CROSS JOIN tab),
words AS MATERIALIZED (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM
          (SELECT n, CASE WHEN h % 31 = 0 THEN SUBSTR(run, 1, h % LENGTH(run)) || SUBSTR(run, h % LENGTH(run) + 2) ELSE run END AS word FROM hashed)
          WHERE LENGTH(word) >= 7 GROUP BY 1 HAVING SUM(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, SUBSTR(word, 1, i - 1) || SUBSTR(word, i + 1) AS rest FROM words, UNNEST(RANGE(1, LENGTH(word) + 1)) t(i)),
pair AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.rest UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.rest),
best AS (SELECT word, COUNT(*) AS n_near, MIN(ROW(-n, near)) AS b FROM pair GROUP BY 1),
found AS (SELECT words.word, words.n, COALESCE(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * words.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * words.n THEN -b[1] END AS form_n
          FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, 0 AS k FROM words UNION ALL SELECT way.word, form, k + 1 FROM way JOIN found ON found.word = way.root WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN (SELECT word, ARG_MAX(root, k) AS root FROM way GROUP BY 1) USING (word)"""

ORACLE_SQL = {
    "op3_weighted_hash_tree": WEIGHTED_HASH_TREE,
    "op5_count_rtree": COUNT_RTREE,
    "op6_repeat_suffixes": REPEAT_SUFFIXES,
    "op7_line_runs": LINE_RUNS,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_fair_queue": FAIR_QUEUE,
    "op13_spelling_trie": SPELLING_TRIE,
}
