"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# Fixed values, written out here so that the rules of the code are checked: kind, pattern, tested group, least length. The
# first three are the base kinds. A private key goes to its last line, or to the end of its base64.
_KEY, _B64 = "[A-Z ]*PRIVATE KEY-----", "[A-Za-z0-9+/=]"
_PIECE = rf"""(?:[\s"'>#*+,;\\-]+{_B64}{{32,}}){{0,31}}"""
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", rf"""-----BEGIN {_KEY}(?:[^-]*(?:--?-?-?[^-]+){{0,400}}------*END {_KEY}|[\\\r\nA-Za-z0-9+/=]*{_PIECE}{_PIECE}{_PIECE}{_PIECE}(?:[ \t"'>#*+,;\\]*[\r\n]+[ \t"'>#*]*{_B64}+)?)""", 0, 1),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("mapkey", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("pay", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
)


def _op9(window: int = 10) -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all(" + low + ", '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({words.format("text").replace("{{", "{").replace("}}", "}")}, []) AS w FROM documents),
b AS (SELECT item_id, {words.format("text").replace("{{", "{").replace("}}", "}")} AS w FROM benchmark WHERE text IS NOT NULL),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {window} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM pattern),
place AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, size WHERE len(w) >= n)),
hit AS (SELECT k, i, n, item_id FROM place JOIN pattern USING (n, p)),
word AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS j FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
item AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (k) LEFT JOIN item USING (k)"""


def _op10() -> str:
    # each rule's matches once, a row each; sums of what stands before them give the offsets
    parts = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        every = f"regexp_extract_all(text, '{p}')"
        parts.append(f"""SELECT k, {order} AS place, '{kind}' AS kind, {least} AS least, unnest({every}) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v, unnest(regexp_split_to_array(text, '{p}')[1:len({every})]) AS gap,
  unnest(generate_series(1, len({every}))) AS n FROM d WHERE regexp_matches(text, '{p}')""")
    write = lambda kept: f"coalesce(string_agg(kind || ':' || (last - length(m)) || ':' || last, ',' ORDER BY last - length(m), place) {kept}, '')"
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY k, place ORDER BY n) AS BIGINT) AS last FROM matched),
told AS (SELECT k, {", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in ("assign", "access", "hex"))}, {write("FILTER (place < 3)")} AS base, {write("")} AS spans FROM placed WHERE length(v) >= least GROUP BY k)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (k)"""


#: Prefixes are compared as whole texts here.
OP4 = """
WITH row_ AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turn_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM row_),
upto AS (SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n, list(role || chr(31) || text) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM turn_),
whole AS (SELECT * FROM upto WHERE place = n),
kept AS (SELECT min(conv_id) AS conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM upto WHERE place < n) GROUP BY prefix)
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS chat
FROM turn_ SEMI JOIN kept USING (conv_id) GROUP BY conv_id"""


#: Exact search; at this size the query finds all but a few of these rows, so it isn't the query's oracle.
OP5_EXACT = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
SELECT * FROM (SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id, list_cosine_similarity(q.e, c.e) AS score
FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 5"""


def _op7(entropy_share: float = 0.95, most_epochs: float = 4.0, block_tokens: int = 1_000_000, seed: str = "mix") -> str:
    # the exponent by the same bisection, one recursive query for each of the two conditions
    def measure(name: str, a: str) -> str:
        raw = f"exp({a} * ln(p))"
        return f"(SELECT {{'entropy': ln(sum({raw})) - sum({raw} * ln({raw})) / sum({raw}), 'most': max({raw} / p) / sum({raw})}} FROM share)"

    def bisect(name: str, a: str, holds: str) -> str:
        return f"""
{name}(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN {holds} THEN (low + high) / 2 ELSE low END, CASE WHEN {holds} THEN high ELSE (low + high) / 2 END
  FROM (SELECT *, {measure(name, a)} AS m FROM {name} WHERE step < 50))"""

    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, min(coalesce(source, '')) AS source, CAST(sum(greatest(1, CAST(ceil(coalesce(strlen(text), 0) / 4) AS BIGINT))) AS BIGINT) AS n_tokens
  FROM documents GROUP BY doc_id),
total AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM base GROUP BY source),
share AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM total) AS p FROM total),
{bisect("e", "(low + high) / 2", f"m.entropy >= {entropy_share} * ln((SELECT count(*) FROM share))")},
{bisect("r", "(1 - (low + high) / 2)", f"m.most <= {most_epochs}")},
full_share AS (SELECT {measure("full", "1.0")} AS m),
pick AS (SELECT CASE WHEN (SELECT count(*) FROM share) < 2 OR (SELECT m.entropy FROM full_share) >= {entropy_share} * ln((SELECT count(*) FROM share)) THEN 1.0
  ELSE (SELECT low FROM e WHERE step = 50) END AS a),
exponent AS (SELECT CASE WHEN {measure("p", "(SELECT a FROM pick)")}.most <= {most_epochs} THEN (SELECT a FROM pick)
  ELSE 1 - (SELECT low FROM r WHERE step = 50) END AS a),
plan AS (SELECT source, tokens,
  CAST(floor((SELECT sum(tokens) FROM total) * pow(tokens, (SELECT a FROM exponent)) / (SELECT sum(pow(tokens, (SELECT a FROM exponent))) FROM total) + 1e-6) AS BIGINT) AS drawn FROM total),
draws AS (SELECT doc_id, source, n_tokens, tokens, drawn, CAST(unnest(generate_series(0, (drawn - 1) // tokens)) AS INTEGER) AS epoch
  FROM base JOIN plan USING (source) WHERE drawn > 0),
placed AS (SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('{seed}/' || epoch || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM draws)
SELECT doc_id, source, n_tokens, epoch,
  CAST((upto - n_tokens) * greatest(1, CAST(round((SELECT sum(tokens) FROM total) / {block_tokens}) AS BIGINT)) // drawn AS BIGINT) AS block
FROM placed WHERE upto <= drawn"""


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (n + 1), r[2] % (n + 1)) AS low, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
    WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
  coalesce(array_to_string(units[high + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def _op13(buckets: int = 10_000, percent: int = 25, least: int = 20, seed: int = 7) -> str:
    # crc32, byte by byte, from a table made by its rule; each distinct feature once
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    code = "CAST('0x' || hex(encode(f)) [2 * i - 1:2 * i] AS BIGINT)"
    return f"""
WITH step AS (SELECT list_transform(generate_series(0, 255), lambda b: list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({words.format("text")}, []) AS w FROM documents),
b AS (SELECT coalesce({words.format("text")}, []) AS w FROM benchmark),
df AS (SELECT k, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
bucket AS (SELECT f, xor(list_reduce(list_transform(generate_series(1, strlen(f)), lambda i: {code}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), step),
n AS (SELECT k, bucket, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM n GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN bucket USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM n JOIN gain USING (bucket) GROUP BY k),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
  CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN w USING (k)),
ranked AS (SELECT *, weight + noise AS score, CASE WHEN n_words >= {least} THEN row_number() OVER (PARTITION BY n_words >= {least} ORDER BY weight + noise DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * {percent} // 100 FROM scored WHERE n_words >= {least}) THEN place END AS rank FROM ranked"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4, "op7_mixing": _op7(), "op9_decontaminate": _op9(), "op10_secrets": _op10(), "op12_fim": OP12, "op13_importance": _op13()}
