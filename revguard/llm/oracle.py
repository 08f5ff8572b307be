"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from revguard.llm import quality_mcd as Q
from revguard.llm import secret_scan as S

SPACE = r"\x20\x09-\x0D"
WORDS = rf"[^{SPACE}]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORDS}')"


# --- op2: statistics, then the minimum-covariance-determinant steps as one chain of aggregates --------

STATS = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT r, {_words("text")} AS w FROM d),
win AS (SELECT r, i, w[i:i + 4] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, COUNT(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
ln AS (SELECT r, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '{WORDS}') GROUP BY r),
st AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words,
              length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS word_chars,
              length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
              COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_lines, 0) AS n_lines,
              COALESCE(n_repeat_words, 0) AS n_repeat_words
       FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
x AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             ln(GREATEST(word_chars, 1)::DOUBLE / GREATEST(n_words, 1)) AS x0,
             ln(1 + n_symbols::DOUBLE / GREATEST(n_words, 1)) AS x1,
             n_dup_lines::DOUBLE / GREATEST(n_lines, 1) AS x2,
             n_repeat_words::DOUBLE / GREATEST(n_words, 1) AS x3 FROM st)"""

P = range(len(Q.XS))
FLOOR = list(Q.FLOORS.values())
PAIRS = [(i, j) for i in P for j in range(i + 1)]


def _group(level: int) -> str:
    parts = ["lang", "source"][:level]
    return f"'{level}'" + "".join(f" || '#' || COALESCE('s' || {c}, 'n')" for c in parts)


def _factored(name: str, source: str, factor: float) -> str:
    """An estimate with its Cholesky factor; later columns use earlier ones."""
    cols = []
    for i, j in PAIRS:
        v = f"s{i}{j} * {factor!r}" + (f" + {FLOOR[i] ** 2!r}" if i == j else "")
        v += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        cols.append(f"sqrt({v}) AS l{i}{j}" if i == j else f"({v}) / l{j}{j} AS l{i}{j}")
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM {source})"


def _d2() -> str:
    """Columns z0 .. and d2."""
    z = [f"(x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i)) + f") / l{i}{i} AS z{i}" for i in P]
    return ", ".join(z) + ", " + " + ".join(f"z{i} * z{i}" for i in P) + " AS d2"


def _moments(name: str, est: str, cut: float | None) -> str:
    off = [f"(x{i} - o{i})" for i in P]
    sums = ["COUNT(*) AS k", *[f"SUM({off[i]}) AS a{i}" for i in P], *[f"SUM({off[i]} * {off[j]}) AS b{i}{j}" for i, j in PAIRS]]
    near = (f"SELECT v.g, n, {', '.join(f'x{i}, o{i}' for i in P)}, {_d2()} FROM v JOIN {est} USING (g)")
    if cut is None:
        near = (f"SELECT *, floor({Q.BINS_PER_DOUBLING} * log2(d2 + 1e-9)) AS bin FROM ({near})")
        near = f"SELECT *, COUNT(*) OVER (PARTITION BY g ORDER BY bin) - COUNT(*) OVER (PARTITION BY g, bin) AS before FROM ({near})"
        near = f"SELECT * FROM ({near}) WHERE before < ceil(n * {Q.KEEP})"
    else:
        near = f"SELECT * FROM ({near}) WHERE d2 <= {cut!r}"
    mean = [f"a{i} / k" for i in P]
    cols = [*[f"o{i} + {mean[i]} AS m{i}" for i in P], *[f"b{i}{j} / k - ({mean[i]}) * ({mean[j]}) AS s{i}{j}" for i, j in PAIRS]]
    return (f"{name} AS (SELECT e.g, e.n, {', '.join(f'e.o{i}' for i in P)}, {', '.join(cols)} FROM {est} e JOIN "
            f"(SELECT g, {', '.join(sums)} FROM ({near}) GROUP BY g) t USING (g))")


def _quality() -> str:
    values = ", ".join(f"({i}, floor(x{i} * {4 / FLOOR[i]!r}))" for i in P)
    at = lambda q: f"MIN(CASE WHEN cum >= n * {q} THEN bin END)"
    start = ["MAX(n) AS n"]
    for i in P:
        u = FLOOR[i] / 4
        start += [f"MAX(CASE WHEN i = {i} THEN (mid + 0.5) * {u!r} END) AS m{i}",
                  f"MAX(CASE WHEN i = {i} THEN rng * {u!r} / 1.349 END) AS sd{i}"]
    ctes = [STATS,
            "v AS (" + " UNION ALL ".join(f"SELECT {_group(k)} AS g, x0, x1, x2, x3 FROM x WHERE NOT base_failed"
                                          for k in (0, 1, 2)) + ")",
            f"h AS (SELECT g, i, bin, COUNT(*) AS c FROM (SELECT g, t.i, t.bin FROM v, (VALUES {values}) t(i, bin)) GROUP BY ALL)",
            "hc AS (SELECT *, SUM(c) OVER (PARTITION BY g, i ORDER BY bin) AS cum, SUM(c) OVER (PARTITION BY g, i) AS n FROM h)",
            f"hq AS (SELECT g, i, MAX(n) AS n, {at(0.5)} AS mid, {at(0.75)} - {at(0.25)} AS rng FROM hc GROUP BY g, i)",
            f"e0 AS (SELECT g, {', '.join(start)} FROM hq GROUP BY g)",
            "e1 AS (SELECT *, " + ", ".join([*[f"m{i} AS o{i}" for i in P], *[
                f"sd{i} * sd{i} AS s{i}{i}" if i == j else f"0.0::DOUBLE AS s{i}{j}" for i, j in PAIRS]]) + " FROM e0)",
            _factored("f0", "e1", 1.0)]
    for step in range(Q.STEPS):
        ctes += [_moments(f"c{step}", f"f{step}", None),
                 _factored(f"f{step + 1}", f"c{step}", Q.consistency(Q.KEEP, len(Q.XS)))]
    ctes += [_moments("cr", f"f{Q.STEPS}", Q.chi2_quantile(0.975, len(Q.XS))),
             _factored("fin", "cr", Q.consistency(0.975, len(Q.XS)))]
    level = [f"SELECT r, {k} AS level, {_group(k)} AS g FROM x" for k in (0, 1, 2)]
    ctes += [f"pick AS (SELECT r, arg_max(g, level) AS g FROM ({' UNION ALL '.join(level)}) JOIN fin USING (g) "
             f"WHERE n >= {Q.MIN_GROUP} OR level = 0 GROUP BY r)",
             f"far AS (SELECT r, {_d2()} FROM x JOIN pick USING (r) JOIN fin USING (g))"]
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND COALESCE(d2 <= {Q.chi2_quantile(1 - Q.TAIL, len(Q.XS))!r}, true) AS kept
FROM x LEFT JOIN far USING (r)""")


# --- op6 ---------------------------------------------------------------------------------------------

def _rest(u: str) -> str:
    return f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"


def _host(u: str) -> str:
    return (f"translate(regexp_extract({_rest(u)}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz')")


def _path(u: str) -> str:
    return f"regexp_extract({_rest(u)}, '^[^/?#]*([^?#]*)', 1)"


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    tag = {"canonical": r"(?is)<link\b[^>]*\brel\s*=\s*[\x22\x27]?canonical\b[^>]*>",
           "og": r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\x22\x27]?og:url\b[^>]*>",
           "refresh": r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\x22\x27]?refresh\b[^>]*>"}
    value = lambda t, name: (rf"regexp_extract(regexp_extract(html, '{tag[t]}'), "  # noqa: E731
                             rf"'(?is)\b{name}\s*=\s*[\x22\x27]?\s*([^\x22\x27\s>]+)', 1)")
    tracking = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)"
    normal = rf"""
SELECT url, host, path, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
       || COALESCE((SELECT '?' || string_agg(q, '&' ORDER BY k) FROM (
            SELECT unnest(parts) AS q, generate_subscripts(parts, 1) AS k FROM (SELECT string_split(
              regexp_extract({_rest("url")}, '^[^?#]*\?([^#]*)', 1), '&') AS parts))
          WHERE q <> '' AND NOT regexp_matches(q, '{tracking}')), '') END AS node FROM"""
    return rf"""
WITH RECURSIVE rules(action, r_host, r_path) AS (VALUES {listed}),
pages_ AS (SELECT page_id, COALESCE(url, '') AS url, COALESCE(html, '') AS html FROM pages),
raw AS (SELECT url, replace(link, '&amp;', '&') AS link FROM (
  SELECT url, {value("canonical", "href")} AS link FROM pages_ UNION ALL
  SELECT url, {value("og", "content")} FROM pages_ UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '{tag["refresh"]}'), '(?is)\burl\s*=\s*([^\x22\x27\s>]+)', 1)
  FROM pages_) WHERE link <> ''),
pairs AS (SELECT DISTINCT url AS source, CASE WHEN contains(link, '://') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?)://', 1) || ':' || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?)://', 1) || '://' || {_host("url")} || link
  ELSE regexp_extract(url, '^(.*?)://', 1) || '://' || {_host("url")}
    || COALESCE(NULLIF(regexp_replace({_path("url")}, '[^/]*$', ''), ''), '/') || link END AS target
  FROM raw WHERE contains(url, '://') OR contains(link, '://')),
urls AS (SELECT DISTINCT url FROM pages_ UNION SELECT source FROM pairs UNION SELECT target FROM pairs),
parsed AS (SELECT url, {_host("url")} AS host, {_path("url")} AS path FROM urls),
named AS ({normal} parsed),
ruled AS (SELECT url, arg_max(action, length(r_host || r_path)) AS action,
                 arg_max(r_host || r_path, length(r_host || r_path)) AS rule
          FROM named JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
          GROUP BY url),
e AS (SELECT a.node AS u, b.node AS v FROM pairs JOIN named a ON a.url = source JOIN named b ON b.url = target
      WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
near(a, b) AS (SELECT DISTINCT node, node FROM named WHERE node IS NOT NULL UNION
               SELECT near.a, both_.v FROM near JOIN both_ ON near.b = both_.u),
said AS (SELECT near.a AS node, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks
         FROM near JOIN named ON named.node = near.b JOIN ruled ON ruled.url = named.url GROUP BY near.a)
SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action
       WHEN blocks AND NOT allows THEN 'block' ELSE 'allow' END AS verdict
FROM pages_ JOIN named USING (url) LEFT JOIN ruled USING (url) LEFT JOIN said ON said.node = named.node"""


# --- op7 ---------------------------------------------------------------------------------------------

ROLLUP = rf"""
WITH d AS (SELECT doc_id, source, lang, COALESCE(text, '') AS text FROM documents),
k AS (SELECT *, array_to_string(list_distinct(string_split(text, chr(10))), chr(10)) AS once,
             MIN(doc_id) OVER (PARTITION BY text) AS first FROM d),
n AS (SELECT source, lang, len({_words("once")}) AS words,
             len(regexp_extract_all(once, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9{SPACE}]')) AS pieces
      FROM k WHERE doc_id IS NULL OR doc_id = first)
SELECT source, lang, 'words-1' AS tokenizer, COUNT(*) AS n_docs, CAST(SUM(words) AS BIGINT) AS n_tokens FROM n GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', COUNT(*), CAST(SUM(pieces) AS BIGINT) FROM n GROUP BY ALL"""


# --- op8: holds up to SAMPLE_DOCS documents, which are then all in the training sample ----------------

def _matches(kind: str, rank: int, pattern: str, test: str = "true") -> str:
    """Spans of a pattern: each match starts after the text before it and the matches before it."""
    return rf"""
SELECT r, {rank} AS kind, CAST(SUM(length(b)) OVER w + COALESCE(SUM(length(m)) OVER (
         PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       length(m) AS size, m, g, {test} AS fits
FROM (SELECT r, unnest(ms) AS m, unnest(gs) AS g, unnest(bs[1:len(ms)]) AS b, generate_subscripts(ms, 1) AS i
      FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms,
                   regexp_extract_all(text, '{pattern}', {2 if kind == "assign" else 0}) AS gs,
                   string_split_regex(text, '{pattern}') AS bs FROM d))
WINDOW w AS (PARTITION BY r ORDER BY i)"""


def _secrets() -> str:
    n = len(S.ALPHABET)
    letters = S.ALPHABET.replace("-", r"\-").replace(".", r"\.").replace("+", r"\+").replace("/", "/")
    joined = lambda cond: (
        "string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || start + size, ',' "
        f"ORDER BY start, kind) {cond}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
base AS (SELECT * FROM ({_matches("assign", 0, S.ASSIGN, f"length(g) >= {S.ASSIGN_VALUE}")}
  UNION ALL {_matches("access", 1, S.ACCESS)} UNION ALL {_matches("hex", 2, S.HEX)}) WHERE fits),
strings AS (
  SELECT true AS random, lower(g) AS s FROM base JOIN d USING (r) WHERE doc_id IS NOT NULL
  UNION ALL SELECT false, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(
    text, '{S.ASSIGN}', ' ', 'g'), '{S.ACCESS}', ' ', 'g'), '{S.HEX}', ' ', 'g'), '{S.IDENTIFIER}')))
  FROM d WHERE doc_id IS NOT NULL),
seen AS (SELECT random, pair, COUNT(*) AS c FROM (
    SELECT random, substr(s, i, 2) AS pair FROM (SELECT random, s, unnest(range(1, length(s))) AS i FROM strings))
  WHERE regexp_full_match(pair, '[{letters}]{{2}}') GROUP BY ALL),
al AS (SELECT unnest(string_split('{S.ALPHABET}', '')) AS l),
made AS (SELECT pair, SUM({float(S.GENERATED_PAIRS)!r} / (k * k)) AS c FROM (
    SELECT x || unnest(m) AS pair, len(m) AS k FROM (SELECT m, unnest(m) AS x FROM (
        SELECT string_split(unnest({S.GENERATED!r}), '') AS m))) GROUP BY pair),
weight AS (SELECT a.l || b.l AS pair,
    ln((COALESCE(p.c, 0) + COALESCE(g.c, 0) + {S.SMOOTHING})
       / (SUM(COALESCE(p.c, 0) + COALESCE(g.c, 0)) OVER (PARTITION BY a.l) + {S.SMOOTHING * n})
     / ((COALESCE(q.c, 0) + {S.SMOOTHING}) / (SUM(COALESCE(q.c, 0)) OVER (PARTITION BY a.l) + {S.SMOOTHING * n}))) AS v
  FROM al a CROSS JOIN al b LEFT JOIN seen p ON p.random AND p.pair = a.l || b.l
  LEFT JOIN seen q ON NOT q.random AND q.pair = a.l || b.l LEFT JOIN made g ON g.pair = a.l || b.l),
cand AS ({_matches("markov", 3, S.CANDIDATE)}),
scored AS (SELECT r, start, SUM(v) AS llr FROM (
    SELECT r, start, substr(lower(m), i, 2) AS pair FROM (SELECT r, start, m, unnest(range(1, length(m))) AS i FROM cand))
  LEFT JOIN weight USING (pair) GROUP BY r, start),
more AS (SELECT cand.* FROM cand JOIN scored USING (r, start) WHERE llr >= {S.MIN_LLR!r} AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.r = cand.r AND b.start < cand.start + cand.size AND cand.start < b.start + b.size)),
every AS (SELECT r, kind, start, size FROM base UNION ALL SELECT r, kind, start, size FROM more)
SELECT doc_id, COUNT(*) FILTER (WHERE kind = 0) AS n_assign, COUNT(*) FILTER (WHERE kind = 1) AS n_access,
       COUNT(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(COALESCE({joined("FILTER (WHERE kind < 3)")}, '')) AS base_sha256, COALESCE({joined("")}, '') AS spans
FROM d LEFT JOIN every USING (r) GROUP BY r, doc_id"""


QUALITY = _quality()
SECRETS = _secrets()


# --- op11: every phrase counted, best cut, phrases that a longer one explains left out ------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLLOCATIONS = rf"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
t AS (SELECT p, lang, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
g3 AS MATERIALIZED (SELECT lang, x, lead(x) OVER ps AS y, lead(x, 2) OVER ps AS z FROM t WINDOW ps AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM g3 UNION ALL SELECT lang, 2, x || ' ' || y FROM g3 WHERE y IS NOT NULL
      UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM g3 WHERE z IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, COUNT(*) AS f FROM g GROUP BY lang, k, phrase),
tot AS (SELECT lang, CAST(SUM(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest
                     FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
few AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
hd AS MATERIALIZED (SELECT cut.*, few.f AS l FROM cut JOIN few ON few.lang = cut.lang AND few.phrase = cut.head),
s AS (SELECT hd.lang, hd.phrase, a, j, l, few.f AS r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * few.f) AS BIGINT) AS score
      FROM hd JOIN few ON few.lang = hd.lang AND few.phrase = hd.rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, MAX(a) AS longer
           FROM (SELECT lang, w, a, unnest(range(1, 3)) AS i FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN tot USING (lang) LEFT JOIN around USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000"""


# --- op13: six rounds of exact integer k-means per part --------------------------------------------------

def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    def assigned(k: int) -> str:
        dist = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])::BIGINT"
        return (f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': {dist}, 'e': e}}) AS b FROM x JOIN b{k} USING (p) GROUP BY r, p)")

    def moved(k: int) -> str:
        return f"""m{k} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT p, b.e AS e, i, SUM(x[i])::BIGINT AS s, COUNT(*) AS n
    FROM (SELECT p, b, x, unnest(range(1, len(x) + 1)) AS i FROM a{k - 1}) GROUP BY p, b.e, i) GROUP BY p, e),
b{k} AS MATERIALIZED (SELECT p, e, COALESCE(m{k}.c, b{k - 1}.c) AS c FROM b{k - 1} LEFT JOIN m{k} USING (p, e))"""

    steps = ",\n".join(f"{assigned(k - 1)},\n{moved(k)}" for k in range(1, rounds + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor({scale} * z::DOUBLE)::BIGINT for z in embedding] AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len([z for z in embedding if z IS NULL OR NOT isfinite(z)]) = 0),
x AS MATERIALIZED (SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x
       QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),
{steps},
{assigned(rounds)},
o AS (SELECT r, string_agg(lpad(printf('%x', b.e), 2, '0'), '' ORDER BY p) AS code, SUM(b.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
      FROM (SELECT p, e, unnest(c) AS z, unnest(range(1, len(c) + 1)) AS i FROM b{rounds}))
SELECT vec_id, code, error, SUM(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM o JOIN v USING (r), h"""
