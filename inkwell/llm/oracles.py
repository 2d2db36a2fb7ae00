"""DuckDB statements of the queries that SQL can state."""

from __future__ import annotations

from inkwell.llm.sharding import ROUNDS

#: CRC-32 of a text's UTF-8 bytes: the table follows from the polynomial
#: 0xEDB88320, the bytes are folded with it.
_CRC = """
crc_step AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_concat([b::BIGINT], range(8)::BIGINT[]),
      lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) t(b))),
crc AS (
  SELECT t, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(
        regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents), crc_step)"""


def _feistel(source: str, key: str) -> str:
    """``source`` has (x, n, a, b); the result adds y, x after one pass."""
    f = lambda i, half: f"(('0x' || md5('{key}:{i}:' || ({half}))[1:12])::BIGINT)"
    sql = f"SELECT *, x % a AS l, x // a AS r FROM {source}"
    for i in range(ROUNDS):
        change = f"(l + {f(i, 'r')}) % a AS l" if i % 2 == 0 else f"(r + {f(i, 'l')}) % b AS r"
        sql = f"SELECT * REPLACE ({change}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r), r * a + l AS y FROM ({sql})"


def shard_sql(key: str = "inkwell", shards: int = 24) -> str:
    return f"""
WITH RECURSIVE {_CRC.strip()},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, crc AS text_crc32,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, octet_length(encode(coalesce(text, '')))) - 1 AS rn,
        count(*) OVER () AS n
      FROM documents LEFT JOIN crc ON coalesce(text, '') = t),
dom AS (SELECT a, (n + a - 1) // a AS b FROM (SELECT DISTINCT n, floor(sqrt(n))::BIGINT AS root FROM d),
          LATERAL (SELECT unnest(range(root, root + 1000)) AS a)
        ORDER BY a * ((n + a - 1) // a) - n, a LIMIT 1),
walk AS (
  SELECT rn, y, n, a, b FROM ({_feistel('(SELECT rn, rn AS x, n, a, b FROM d, dom)', key)})
  UNION ALL
  SELECT rn, y, n, a, b FROM ({_feistel('(SELECT rn, y AS x, n, a, b FROM walk WHERE y >= n)', key)})),
p AS (SELECT rn, y FROM walk WHERE y < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {shards})::INT AS shard,
       y // {shards} AS slot, NULL::INT AS grown_shard
FROM d JOIN p USING (rn)"""


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('inkwell:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((rank - 1) % 3 + 1)::INT) AS w, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
tot AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget, sum(w) AS w_all FROM s),
c AS (
  SELECT s.*, budget,
         cap * (w_all - coalesce(sum(w) OVER before, 0)) <= (budget - coalesce(sum(cap) OVER before, 0)) * w AS capped
  FROM s, tot
  WINDOW before AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, rank, source_size, budget,
         CASE WHEN capped THEN cap
              ELSE (budget - coalesce((SELECT sum(cap) FROM c WHERE capped), 0)) * w
                   / (SELECT sum(w) FROM c WHERE NOT capped) END AS target
  FROM c),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, t.budget,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY h, doc_id NULLS FIRST, d.size
                           ROWS UNBOUNDED PRECEDING) AS cum,
         row_number() OVER (ORDER BY t.rank, h, doc_id NULLS FIRST, d.size) AS rn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT rn, size, budget,
         sum(size) OVER (ORDER BY (copy * source_size + cum)::DOUBLE / target, rank, copy, rn
                         ROWS UNBOUNDED PRECEDING) AS running
  FROM q, range(2) k(copy) WHERE size > 0),
taken AS (SELECT rn, count(*) AS copies FROM served WHERE running <= budget GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(copies, 0) * size AS taken
FROM q LEFT JOIN taken USING (rn)"""


def _distance(counts: str, reference: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of length n."""
    p, q = f"{counts}[i] / list_sum({counts})", f"{reference}[i] / list_sum({reference})"
    part = lambda a, b: (
        f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END")
    term = f"({part(f'({p})', f'({q})')} + {part(f'({q})', f'({p})')}) / 2"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: {term}))))"


def rules_sql() -> str:
    from inkwell.llm import quality_rules as r
    text = lambda s: "'" + s.replace("'", "''") + "'"
    word = r"'[^\x20\x09-\x0D]+'"
    few = ", ".join(f"len(regexp_extract_all(t, {text(c)}))" for c in r.CLASSES)
    common = ", ".join(f"len(list_filter(lw, lambda x: x = {text(w)}))" for w in r.COMMON_WORDS)
    k, m = len(r.CLASSES) + 1, len(r.COMMON_WORDS) + 1
    share = lambda a, n: ", ".join(
        f"sum(floor({a}[{i}] * {r.SCALE} / list_sum({a})))" for i in range(1, n + 1))
    both = lambda a, n: "[" + ", ".join(f"sum({a}[{i}])" for i in range(1, n + 1)) + "]"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
rep AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win), range(3) t(j)
  WHERE c > 1 GROUP BY rid),
f AS (
  SELECT rid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, [{few}] AS few, [{common}] AS com
  FROM (SELECT *, list_transform(w, lambda x: lower(x)) AS lw,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS lines FROM d)
  LEFT JOIN rep USING (rid)),
g AS (
  SELECT *, list_concat([word_chars - list_sum(few)], few) AS classes,
         list_concat(com, [n_words - list_sum(com)]) AS common,
         n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEATED} * n_words AS base_failed
  FROM f),
able AS (SELECT * FROM g WHERE NOT base_failed AND n_words >= {r.JUDGED_WORDS}),
r1 AS (SELECT lang, count(*) AS n, [{share('classes', k)}] AS ref FROM able GROUP BY lang),
a1 AS (SELECT {both('ref', k)} AS every FROM r1),
far AS (
  SELECT able.*, floor({_distance('classes', 'ref1', k)} * {r.SCALE}) AS far
  FROM able JOIN (SELECT lang AS l, CASE WHEN n >= {r.MIN_REFERENCE} THEN ref ELSE every END AS ref1
                  FROM r1, a1) ON lang IS NOT DISTINCT FROM l),
near AS (SELECT * FROM (SELECT *, sum(far) OVER p AS fs, count(*) OVER p AS fn FROM far
         WINDOW p AS (PARTITION BY lang)) WHERE far * fn <= fs),
r2 AS (SELECT lang, count(*) AS n, [{share('classes', k)}] AS rc, [{share('common', m)}] AS rw
       FROM near GROUP BY lang),
a2 AS (SELECT {both('rc', k)} AS ec, {both('rw', m)} AS ew FROM r2),
ref AS (SELECT lang AS l, CASE WHEN n >= {r.MIN_REFERENCE} THEN rc ELSE ec END AS refc,
          CASE WHEN n >= {r.MIN_REFERENCE} THEN rw ELSE ew END AS refw, ec, ew FROM r2, a2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_words >= {r.JUDGED_WORDS} AND refc IS NOT NULL
         AND least({_distance('classes', 'refc', k)}, {_distance('classes', 'ec', k)}) > {r.MAX_CLASS_DISTANCE}
         AND least({_distance('common', 'refw', m)}, {_distance('common', 'ew', m)}) > {r.MAX_WORD_DISTANCE},
         false) AS kept
FROM g LEFT JOIN ref ON lang IS NOT DISTINCT FROM l"""


def fingerprint_sql() -> str:
    from inkwell.llm.multiset_hash import LANES, PIECE
    pieces = "'[^\\n.!?]{1," + str(PIECE) + "}[.!?]*|[.!?]+'"
    # Lane order: digest words in pairs, then bit, then word of the pair.
    bit = "(lane % 64) // 2"
    digit = f"(8 * (2 * (lane // 64) + lane % 2) + 7 - {bit} // 4 + 1)"
    vector = lambda t, id_: f"""
      SELECT {id_} AS id, list(v ORDER BY lane) AS vec FROM (
        SELECT {id_}, lane, sum(CASE WHEN md5 IS NULL THEN 0 ELSE
          2 * ((strpos('0123456789abcdef', md5[{digit}]) - 1) >> ({bit} % 4) & 1) - 1 END)::BIGINT AS v
        FROM (SELECT {id_}, md5(p) AS md5 FROM (
          SELECT {id_}, unnest(CASE WHEN len(ps) = 0 THEN [NULL] ELSE ps END) AS p
          FROM (SELECT {id_}, regexp_extract_all({t}, {pieces}) AS ps FROM e))), range({LANES}) r(lane)
        GROUP BY {id_}, lane) GROUP BY {id_}"""  # noqa: E731
    near = lambda a, b: f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE,
      least(1.0::DOUBLE, 2 * list_sum(list_transform(range(1, {LANES + 1}), lambda i: {a}[i] * {b}[i]))::DOUBLE
      / (list_sum(list_transform({a}, lambda x: x * x)) + list_sum(list_transform({b}, lambda x: x * x))))) END"""  # noqa: E731
    text = lambda a: (f"array_to_string(list_transform({a}, lambda x: "  # noqa: E731
                      "lpad(lower(to_hex(((x % 65536) + 65536) % 65536)), 4, '0')), '')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
             row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rn,
             count(*) OVER () AS n FROM documents),
e AS (SELECT a.rn, a.doc_id, a.t, length(a.t) AS n_chars, b.rn AS nx,
        left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS new
      FROM d a JOIN d b ON b.rn = a.rn % a.n + 1),
f AS ({vector('t', 'rn')}),
g AS ({vector('new', 'rn')})
SELECT doc_id, n_chars, sha256(new) AS edited_sha256, {text('f.vec')} AS fingerprint,
       {text('g.vec')} AS edited_fingerprint, {near('f.vec', 'g.vec')} AS near_edited,
       {near('f.vec', 'h.vec')} AS near_next
FROM e JOIN f ON f.id = e.rn JOIN g ON g.id = e.rn JOIN f h ON h.id = e.nx"""


def licence_sql() -> str:
    from inkwell.llm import license_scan as m
    text = lambda s: "'" + s.replace("'", "''") + "'"
    spelt = "x"
    for word, standard in m.SPELLINGS.items():
        spelt = f"replace({spelt}, ' {word} ', ' {standard.replace(' ', '  ')} ')"
    lines = lambda t: (
        "list_filter(list_transform(list_transform(string_split(" + t + ", chr(10)), lambda x: "
        f"CASE WHEN regexp_matches(lower(x), {text(m.COPYRIGHT)}) THEN '' ELSE "
        r"' ' || regexp_replace(lower(x), '[^\p{L}\p{N}]+', '  ', 'g') || ' ' END), "
        f"lambda x: trim(regexp_replace({spelt}, ' +', ' ', 'g'))), lambda x: x <> '')")
    rows = [("form", k, v) for k, v in m.LICENCES.items()]
    rows += [("text", k, v) for k, v in m.texts()]
    rows += [("title", k, the + t) for k, ts in m.TITLES.items() for t in ts for the in ("", "The ")]
    rows += [("notice", k, v) for k, ls in m.NOTICES.items() for v in ls]
    values = lambda rs: ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rs)
    # Two replacements each; "~" is in no canonical text.
    wordings = [(k, str(i), *[w for pair in (*alt, ("~", "~"), ("~", "~"))[:2] for w in pair])
                for k, sets in m.WORDINGS.items() for i, alts in enumerate(sets) for alt in alts]
    worded = lambda i, of: (
        "SELECT licence, replace(replace(c, coalesce(a, '~'), coalesce(b, '~')), coalesce(x, '~'), coalesce(y, '~')) AS c "
        f"FROM {of} LEFT JOIN (SELECT * FROM wording WHERE i = '{i}') USING (licence)")
    marked = "c"
    for k, start in enumerate(m.STARTS):
        mark = f"m{k % 3 + 1}"
        marked = f"replace({marked}, ' {k % 3 + 1} {start}', CASE {mark} WHEN '' THEN '' ELSE ' ' || {mark} END || ' {start}')"
    return f"""
WITH plain AS (
  SELECT kind, licence, array_to_string({lines('t')}, ' ') AS c FROM (VALUES {values(rows)}) v(kind, licence, t)),
wording AS (SELECT * FROM (VALUES {values(wordings)}) v(licence, i, a, b, x, y)),
mark AS (SELECT * FROM (VALUES {values(m.ENUMERATORS)}) v(m1, m2, m3)),
form AS (SELECT licence, c FROM plain WHERE kind = 'form'),
form1 AS ({worded(0, 'form')}),
form2 AS ({worded(1, 'form1')}),
form3 AS (SELECT DISTINCT licence, {marked} AS c FROM form2, mark),
known AS (
  SELECT kind, sha256(c) AS digest, min(licence) AS licence FROM (
    SELECT kind, licence, c FROM plain WHERE kind IN ('text', 'notice')
    UNION ALL SELECT 'text', licence, c FROM form3
    UNION ALL SELECT 'text', licence, t.c || ' ' || f.c FROM form3 f JOIN plain t USING (licence) WHERE kind = 'title')
  GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lines("coalesce(text, '')")} AS ls FROM documents),
n AS (
  SELECT rid, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT rid, unnest(ls) AS l FROM d) JOIN known ON kind = 'notice' AND digest = sha256(l)
  GROUP BY rid)
SELECT doc_id, sha256(array_to_string(ls, ' ')) AS text_sha256, licence,
       coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN n USING (rid)
LEFT JOIN known ON kind = 'text' AND digest = sha256(array_to_string(ls, ' '))"""


#: Every window of 100 bytes as hex digits; all but the earliest are marked,
#: joined to maximal runs and cut out.
SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h,
             octet_length(encode(coalesce(text, ''))) AS n FROM documents),
block AS (SELECT rid, doc_id, n, o, substr(h, 2 * o + 1, 1000 + 198) AS p
          FROM d, LATERAL (SELECT unnest(range(0, n - 99, 500)) AS o)),
w AS (SELECT rid, doc_id, o + j AS i, substr(p, 2 * j + 1, 200) AS s
      FROM block, LATERAL (SELECT unnest(range(0, least(500, n - 99 - o))) AS j)),
later AS (SELECT rid, i FROM (
  SELECT rid, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, rid, i) AS k FROM w) WHERE k > 1),
run AS (SELECT rid, min(i) AS a, max(i) + 100 AS b FROM (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS g FROM (
    SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh
    FROM later)) GROUP BY rid, g),
edge AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y, b - a AS gone FROM run
  UNION ALL
  SELECT rid, coalesce(b, 0), n, 0 FROM d LEFT JOIN (SELECT rid, max(b) AS b FROM run GROUP BY rid) USING (rid)),
cut AS (
  SELECT rid, sum(gone)::BIGINT AS n_removed, count(*) - 1 AS n_spans,
         string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x, y) AS kept
  FROM edge JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN cut USING (rid)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = f"regexp_extract_all({_LOWER.format('{}')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every window of a document of a length that item windows have, joined with those.
LEAK_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    {_PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_PLAIN_WORDS.format("coalesce(text, '')")} AS w,
    least(len(w), 10) AS k FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM item WHERE k > 0)),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
run AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS w FROM word),
pos AS (SELECT r, k, i, array_to_string(w[:k], ' ') AS s FROM run, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS MATERIALIZED (SELECT r, i, k, item FROM pos JOIN win USING (k, s)),
n AS (SELECT r, count(DISTINCT j) AS n_hit
    FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)"""

#: Every kept term stands in every group of its language.
AUDIT_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(c.n)::HUGEINT AS total FROM c JOIN kept USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(total.total, 0) + l.v) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 1) // (l.total + l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (FROM pair UNION ALL FROM term))
FROM ranked WHERE part = 'pair' OR rank <= 200"""

#: CRC-32 of each distinct window, byte by byte; see _CRC for the table.
RESAMPLE_SQL = f"""
WITH {_CRC.strip()[:_CRC.strip().index("crc AS")].rstrip().rstrip(",")},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
texts AS (SELECT r, 0 AS t, {_PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM d
  UNION ALL SELECT -1, row_number() OVER (), {_PLAIN_WORDS.format("coalesce(text, '')")} FROM benchmark),
word AS (SELECT r, t, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
run AS (SELECT r, list(word) OVER (PARTITION BY r, t ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM word),
f AS MATERIALIZED (SELECT r, array_to_string(w[:k], ' ') AS feature, count(*) AS n
  FROM run, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k GROUP BY ALL),
b AS MATERIALIZED (SELECT feature, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(
        regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), crc_step),
hist AS (SELECT bucket, coalesce(sum(n) FILTER (r >= 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS t
  FROM f JOIN b USING (feature) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
  FROM hist),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM f JOIN b USING (feature) JOIN gain USING (bucket) WHERE r >= 0 GROUP BY r),
x AS (SELECT doc_id, r, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS h
  FROM d LEFT JOIN w USING (r)),
y AS (SELECT * EXCLUDE (h), weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score,
    n_features >= 57 AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) OVER (PARTITION BY able) AS n FROM y)
SELECT doc_id, n_features, weight, score, if(able AND place <= 5 * n // 100, place, NULL) AS rank FROM z"""
