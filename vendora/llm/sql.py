"""DuckDB SQL of the operators that SQL can express."""

from vendora.llm.urlfilter import IP_HOST, TWO_LABEL_SUFFIXES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(column: str) -> str:
    """Lower-cased word list of a text column."""
    return (f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def op1_sql(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {words_sql('text')} AS w FROM {documents}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words_sql('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[i + 1:i + 13] AS g
        FROM (SELECT item, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (SELECT rid, n, i, w[i + 1:i + n] AS g
          FROM (SELECT rid, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)),
occ AS (SELECT rid, i, n, item FROM grams JOIN win USING (g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
        FROM occ WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""


ORACLE_OP1 = op1_sql()

SUFFIX_LIST = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
ORACLE_OP10 = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                        ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
r AS (SELECT host, path, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS ruled
      FROM (SELECT DISTINCT host, path FROM p) JOIN rules
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS y,
              regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site
       FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(site, '.') AS parts, regexp_matches(site, '{IP_HOST}') AS ip FROM h0),
h2 AS (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({SUFFIX_LIST}) THEN 2 ELSE 1 END AS depth FROM h1),
h AS (SELECT host, n, y, CASE WHEN ip THEN site ELSE array_to_string(parts[-(depth + 1):], '.') END AS domain,
             CASE WHEN ip THEN '' ELSE array_to_string(parts[-depth:], '.') END AS suffix FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (SELECT (sum(y) + 0.5::DOUBLE) / (sum(n) + 1) FROM h) AS m FROM d GROUP BY suffix),
ks AS (SELECT 1 / least(greatest(sum(n * pow(y / n - m, 2) - m * (1 - m)) / sum(m * (1 - m) * (n - 1)), 0.001), 0.999) - 1 AS k FROM s WHERE n > 0),
sm AS (SELECT suffix, (y + k * m) / (n + k) AS m FROM s, ks),
dm0 AS (SELECT domain, suffix, n, y, m FROM d JOIN sm USING (suffix)),
kd AS (SELECT 1 / least(greatest(sum(n * pow(y / n - m, 2) - m * (1 - m)) / sum(m * (1 - m) * (n - 1)), 0.001), 0.999) - 1 AS k FROM dm0 WHERE n > 0),
dm AS (SELECT domain, suffix, (y + k * m) / (n + k) AS m FROM dm0, kd),
hm AS (SELECT host, n, y, m FROM h JOIN dm USING (domain, suffix)),
kh AS (SELECT 1 / least(greatest(sum(n * pow(y / n - m, 2) - m * (1 - m)) / sum(m * (1 - m) * (n - 1)), 0.001), 0.999) - 1 AS k FROM hm WHERE n > 0),
post AS (SELECT host, n + k AS w, (y + k * m) / (n + k) AS mean FROM hm, kh),
bad AS (SELECT host FROM post WHERE mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.3)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r USING (host, path)"""

ORACLE_OP4 = """
WITH RECURSIVE s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS total, sum(pow(size, 0.5::DOUBLE)) FILTER (WHERE size > 0) AS wall FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5::DOUBLE) / wall * total * 1.0::DOUBLE / size ELSE 1.0::DOUBLE END AS rate FROM s, t),
m AS (SELECT source, CAST(greatest(ceil(rate / 16), 1) AS INTEGER) AS draws,
             rate / CAST(greatest(ceil(rate / 16), 1) AS INTEGER) AS mean FROM r),
cdf AS (SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM m
        UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 79),
table_of AS (SELECT source, draws, list(c) AS cdf FROM cdf GROUP BY source, draws),
n AS (SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cdf, lambda c:
               c <= CAST(CAST('0x' || substr(md5('17:n:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || j), 1, 13) AS BIGINT) AS DOUBLE)
                    / 4503599627370496.0::DOUBLE)))) AS n
      FROM documents d JOIN table_of USING (source)),
x AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(CAST(n AS BIGINT))) AS INTEGER) AS copy FROM n)
SELECT *, substr(md5('17:s:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 16) AS shuffle_key FROM x"""

# The control strings of the chat template, the longest first.
CONTROLS = ["<</TURN>>", "<<TEXT>>", "<<TURN>>", "<</SYS>>", "<<SYS>>", "[/INST]", "[INST]", "</s>", "<s>"]


def _escaped(column: str) -> str:
    sql = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROLS:
        sql = f"replace({sql}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return sql


ORACLE_OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS k, lag(role, 1, 'start') OVER w AS was, lead(role) OVER w AS next_role FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)),
f AS (SELECT *, length({_escaped('text')}) + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
                  ELSE 25 + length({_escaped('role')}) END AS chars,
             (was, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS fine
      FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fine) AND arg_max(role, k) = 'assistant' AS valid,
       coalesce(min_by('turn ' || (k - 1) || ': ' || role || ' after ' || was, k) FILTER (WHERE NOT fine),
                CASE WHEN arg_max(role, k) <> 'assistant' THEN 'ends after ' || arg_max(role, k) END) AS fault
FROM f GROUP BY conv_id"""

ORACLE_OP8 = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
l0 AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM d),
l AS (SELECT rid, doc_id, no, {words_sql('line')} AS w FROM l0),
o AS (SELECT rid, no, w, array_to_string(w, ' ') AS t, row_number() OVER (ORDER BY doc_id, no, rid) AS o FROM l WHERE len(w) >= 1),
c AS (SELECT t, any_value(w) AS w, min(o) AS f FROM o GROUP BY t),
v AS (SELECT t, f, p, array_to_string(w[1:p] || w[p + 2:], ' ') AS v FROM (SELECT t, f, w, unnest(range(len(w))) AS p FROM c WHERE len(w) >= 5)),
near AS (SELECT v.t FROM v JOIN (SELECT v, p, min(f) AS m FROM v GROUP BY v, p) g ON v.v = g.v AND v.p = g.p WHERE g.m < v.f
         UNION SELECT v.t FROM v JOIN c ON c.t = v.v WHERE c.f < v.f AND len(c.w) >= 5
         UNION SELECT c.t FROM v JOIN c ON c.t = v.v WHERE v.f < c.f AND len(c.w) >= 5),
gone AS (SELECT rid, no FROM o JOIN c USING (t) WHERE o.o > c.f OR t IN (SELECT t FROM near)),
kept AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE g.no IS NOT NULL) AS dropped,
                coalesce(string_agg(line, chr(10) ORDER BY l0.no) FILTER (WHERE g.no IS NULL), '') AS text
         FROM l0 LEFT JOIN gone g USING (rid, no) GROUP BY rid)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE k.n END AS n_lines, coalesce(dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN kept k USING (rid)"""


def _merkle_sql(leaf_levels: int = 6, source_levels: int = 3, fan: int = 16) -> str:
    """The manifest level by level, enough of them for ``fan`` to their power."""
    def field(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || {column} END"
    own = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    # CRC-32 bit by bit: each byte is mixed in, then eight shifts (marked -1).
    crc = ("list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: "
           "[CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: "
           "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)")
    sql = f"""
WITH d AS (SELECT doc_id, source, sha256({own} || {field('text')}) AS leaf, sha256({own} || {field(lower)}) AS low,
                  coalesce(xor({crc}, 4294967295) % 5 = 0, false) AS tampered FROM documents),
l AS (SELECT doc_id, source, leaf, CASE WHEN tampered THEN low ELSE leaf END AS now, count(*) OVER (PARTITION BY source) AS m,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
p AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM l)),
n0 AS (SELECT source, i, m, leaf AS h FROM l)"""
    for k in range(leaf_levels):
        sql += f""",
r{k} AS (SELECT source, i // {fan} AS i, any_value(m) AS was, (any_value(m) + {fan - 1}) // {fan} AS m, list(h ORDER BY i) AS hs FROM n{k} GROUP BY source, i // {fan}),
n{k + 1} AS (SELECT source, i, m, CASE WHEN was > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{k})"""
    sql += f""",
t0 AS (SELECT place AS i, p.m, h FROM n{leaf_levels} JOIN p ON n{leaf_levels}.source IS NOT DISTINCT FROM p.source)"""
    for k in range(source_levels):
        sql += f""",
u{k} AS (SELECT i // {fan} AS i, any_value(m) AS was, (any_value(m) + {fan - 1}) // {fan} AS m, list(h ORDER BY i) AS hs FROM t{k} GROUP BY i // {fan}),
t{k + 1} AS (SELECT i, m, CASE WHEN was > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM u{k})"""
    sql += """,
f0 AS (SELECT l.doc_id, l.source, l.leaf, l.now AS h, l.i, p.place, '' AS proof FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source)"""
    steps = [(f"r{k}", "i", k, "f.source IS NOT DISTINCT FROM r.source AND ") for k in range(leaf_levels)]
    steps += [(f"u{k}", "place", k, "") for k in range(source_levels)]
    for at, (run, rank, k, same) in enumerate(steps):
        digit = f"(f.{rank} // {fan ** k}) % {fan}"
        left, right = f"array_to_string(hs[1:{digit}], '')", f"array_to_string(hs[{digit} + 2:], '')"
        sql += f""",
f{at + 1} AS (SELECT f.doc_id, f.source, f.leaf, CASE WHEN r.was > 1 THEN sha256({left} || f.h || {right}) ELSE f.h END AS h, f.i, f.place,
       f.proof || {left} || {right} AS proof
       FROM f{at} f JOIN {run} r ON {same}r.i = f.{rank} // {fan ** (k + 1)})"""
    return sql + f"""
SELECT f.doc_id, f.leaf, t0.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM f{len(steps)} f JOIN t0 ON t0.i = f.place CROSS JOIN t{source_levels} r"""


ORACLE_OP11 = _merkle_sql()

ORACLE_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM o GROUP BY lang, term HAVING count(*) >= 10),
l AS (SELECT lang, sum(n) AS total, CAST(count(*) AS HUGEINT) AS v FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, CAST(sum(o.n) AS HUGEINT) AS n FROM o JOIN t USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT gn.lang, gn.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (gn.total + 2 * l.v) AS p,
             1 + 1000000000 * (t.n + 2) // (l.total + 2 * l.v) AS q
      FROM gn JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = t.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 10"""
