"""The queries of this subpackage, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, fingerprint, minhash, mixing, quality_cnn, quality_rules, repair, secret_scan, sentencepiece, substrings, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"), columns=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, threshold_percent=80)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_read(spark, sf_dir, "documents"), with_text=False)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.chains(turns.unionByName(extra))))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_read(spark, sf_dir, "conversations"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_mixing, op2_fingerprints, op3_minhash, op4_sentencepiece, op5_quality_rules, op6_substrings, op7_token_counts, op8_chat, op9_quality, op10_toxicity, op11_divergence, op12_repair, op13_secrets, pipeline]
    return {f.__name__: f for f in named}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = """
WITH d AS (
  SELECT doc_id, CAST(len(%s) AS BIGINT) AS size, coalesce('s' || source, 'n') AS k, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (SELECT k, sum(size)::DOUBLE AS s, 1 + (row_number() OVER (ORDER BY CASE WHEN k = 'n' THEN 1 ELSE 0 END, k) - 1) %% 3 AS w FROM d GROUP BY k),
r AS (SELECT *, 3 * s / w AS dry, sum(s) OVER () AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(3 * s) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM s WINDOW b AS (ORDER BY 3 * s / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max((budget - cap_before) / (all_w - w_before)) AS level FROM r WHERE (budget - cap_before) / (all_w - w_before) <= dry),
p AS (SELECT d.*, r.s, r.w, v.level, r.budget, sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN r USING (k), v),
q AS (SELECT doc_id, k, h, e, size, budget, (e * s + before + size) / w AS finish FROM p, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
t AS (SELECT doc_id, k, h, e, size, budget, sum(size) OVER (ORDER BY finish, k, e, h, doc_id ROWS UNBOUNDED PRECEDING) - size AS served FROM q),
n AS (SELECT doc_id, k, h, count(*) AS n FROM t WHERE 2 * served + size <= 2 * budget GROUP BY ALL)
SELECT p.doc_id, size, CAST(s AS BIGINT) AS source_size, least(w * level, 3 * s) AS target, size * coalesce(n, 0) AS taken
FROM p LEFT JOIN n ON n.k = p.k AND n.h = p.h AND n.doc_id IS NOT DISTINCT FROM p.doc_id
""" % _WORDS  # noqa: UP031

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 3], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.c + y.c - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + 15 AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(m.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(m.n, 0) + 2) // (sum(coalesce(m.n, 0)) OVER (PARTITION BY g.lang, g.source) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) m ON m.lang = g.lang AND m.source = g.source AND m.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM c WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 10
"""


# The dynamic programme row by row from the end: for each state of the grammar (z: nothing yet, s, u, a) cost, audit and repaired lines.
_CRC = "list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END, 4294967295::BIGINT)"


def _way(when: str, cost: str, letter: str, then: str, line: str | None) -> str:
    lines = f"list_prepend({line}, {then}.l)" if line else f"{then}.l"
    return f"CASE WHEN {when} THEN {{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a, 'l': {lines}}} END"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _row(state: str, keeps: dict[str, str], expected: str) -> str:
    stays = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    named = {"u": "user", "a": "assistant"}[expected]
    keep = [_way(f"{stays} AND i = '{i}'", more, "K", to, "role || ':' || text") for i, to in keeps.items()]
    return _best(_way("TRUE", "2", "D", state, None), *keep, _way(stays, f"1 + {more}", "R", expected, f"'{named}:' || text"))


OP12_SQL = rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor({_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM r, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS i, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM o),
p(conv_id, k, z, s, u, a) AS (
  SELECT DISTINCT conv_id, n + 1, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}}, {{'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']}}, {{'c': 5, 'a': 'I', 'l': ['assistant:']}}, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} FROM f
  UNION ALL SELECT conv_id, k, {_best("z", _way("TRUE", "5", "I", "nu", "'user:'"))}, {_best("s", _way("TRUE", "5", "I", "nu", "'user:'"))}, nu, na
  FROM (SELECT *, {_best("u", _way("TRUE", "5", "I", "a", "'assistant:'"))} AS nu, {_best("a", _way("TRUE", "5", "I", "u", "'user:'"))} AS na
    FROM (SELECT f.conv_id, f.pos AS k, {_row("z", {"s": "s", "u": "u"}, "u")} AS z, {_row("s", {"u": "u"}, "u")} AS s, {_row("u", {"a": "a"}, "a")} AS u, {_row("a", {"u": "u"}, "u")} AS a
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.k - 1))),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(p.z.c, 0) AS BIGINT) AS cost, coalesce(p.z.a, '') AS audit, sha256(coalesce(array_to_string(p.z.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.k = 1
"""


# The battery of tests over lists of characters; what stands for a case in either case is spelt out, as the other engine folds more than letters A-Z.
def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = f"(?:{'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})" + r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SHAPES = (_ASSIGN, secret_scan.ACCESS, secret_scan.HEX, "[A-Za-z0-9+/_-]{20,}={0,2}")
_TAIL = "(SELECT CASE WHEN z >= 0 THEN w ELSE 1 - w END FROM (SELECT z, exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS w FROM (SELECT z, 1 / (1 + abs(z) * 0.2316419) AS t FROM (SELECT {0} AS z))))"
_CHANGES = "CASE WHEN encoding = 'decimal' THEN translate(s, '0123456789', 'LLLLLUUUUU') ELSE translate(s, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/', 'DDDDDDDDDDUUUUUUUUUUUUUUUUUUUUUUUUUULLLLLLLLLLLLLLLLLLLLLLLLLL+') END"
for _k in ("D", "U", "L", r"\+"):
    _CHANGES = f"regexp_replace({_CHANGES}, '{_k}+', '{_k[-1]}', 'g')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM d" for k, p in enumerate(_SHAPES))}),
p AS (SELECT r, kind, m[i] AS v, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
q AS MATERIALIZED (SELECT r, kind, v, b, b + length(v) AS e FROM p WHERE kind <> 0 OR length(regexp_extract(v, '{_ASSIGN}', 1)) >= 12),
c AS (SELECT r, b, e, translate(rtrim(v, '='), '-_', '+/') AS s FROM q WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM q k WHERE k.r = q.r AND k.kind < 3 AND k.b < q.e AND q.b < k.e)),
n AS (SELECT *, length(s)::DOUBLE AS n, CASE {" ".join(f"WHEN regexp_full_match(s, '{v[0]}') THEN '{k}'" for k, v in secret_scan.ENCODINGS.items())} END AS encoding FROM c),
a AS (SELECT *, length(a)::DOUBLE AS k, greatest(length(a) * 0.065, 2) - 1 AS uneven, list_transform(string_split(s, ''), lambda x: strpos(a, x)::DOUBLE) AS x FROM
  (SELECT *, CASE encoding {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in secret_scan.ENCODINGS.items())} END AS a, CASE encoding {" ".join(f"WHEN '{k}' THEN {v[2] / 2!r}::DOUBLE" for k, v in secret_scan.ENCODINGS.items())} END AS rare FROM n)),
x AS (SELECT *, list_sum(list_transform(string_split(a, ''), lambda y: power(length(s) - length(replace(s, y, '')), 2))) AS squares, list_sum(x) / n AS mean, list_sum(x) AS total,
  list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])) AS products, list_sum(list_transform(x, lambda v: v * v)) AS whole, length({_CHANGES}) - 1 AS changes FROM a),
y AS (SELECT r, b, e, CAST(floor(n * log2(k)) AS BIGINT) AS bits, greatest({_TAIL.format("(k - 1 + n * uneven - (k / n * squares - n)) / sqrt(2 * (k - 1) + 4 * n * uneven)")}, 1e-300) AS chi,
  greatest({_TAIL.format("(changes - 0.5 - rare * (n - 1)) / sqrt((n - 1) * rare * (1 - rare))")}, 1e-300) AS runs,
  CASE WHEN whole - total * mean > 0 THEN least(greatest(abs((products - mean * (2 * total - x[1] - x[-1]) + (n - 1) * mean * mean) / (whole - total * mean)), 1 / n), 1) ELSE 1 END AS serial FROM x),
z AS (SELECT r, b, e, bits, CAST(floor(-log10(least(greatest(exp(-h) * (1 + h + h * h / 2), 1e-300), 1) / bits) * 100) AS BIGINT) AS place FROM (SELECT *, -(ln(chi) + ln(runs) + ln(serial)) AS h FROM y)),
l AS (SELECT min(place) AS place FROM (SELECT place, sum(count(*)) OVER (ORDER BY place DESC) AS reported, sum(sum(bits)) OVER () AS all_bits FROM z GROUP BY place) WHERE power(10, -place / 100.0) * all_bits <= 0.01 * reported),
f AS (SELECT r, kind, b, e FROM q WHERE kind < 3 UNION ALL SELECT r, 3, b, e FROM z, l WHERE z.place >= l.place),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(s, ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY b, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || b || ':' || e AS s FROM f) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op3_minhash": OP3_SQL, "op8_chat": OP8_SQL, "op11_divergence": OP11_SQL, "op12_repair": OP12_SQL, "op13_secrets": OP13_SQL}
