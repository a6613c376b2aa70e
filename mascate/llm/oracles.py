"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from mascate.llm.line_dedup import MIN_WORDS
from mascate.llm.quality_rules import POLICIES, POLICY, RULES, mask

_BLANK = r"[ \t\n\x0B\f\r]"
_WORD = r"[^ \t\n\x0B\f\r]"

# each document's words by place, and which of them lie in a window of five that comes twice
_MEASURED = f"""
    docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    parts AS (
        SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
        FROM docs),
    each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM parts),
    windows AS (
        SELECT doc_id, place, list(word) OVER w AS shown, count(*) OVER w AS size FROM each_word
        WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    twice AS (
        SELECT doc_id, place FROM windows WHERE size = 5
        QUALIFY count(*) OVER (PARTITION BY doc_id, shown) > 1),
    repeats AS (
        SELECT doc_id, count(DISTINCT place + step) AS n_repeat_words
        FROM twice, (SELECT unnest(range(5)) AS step) GROUP BY doc_id),
    measured AS (
        SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words,
               length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
               length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower
        FROM parts LEFT JOIN repeats USING (doc_id)),
    judged AS (
        SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << n} ELSE 0 END" for n, rule in enumerate(RULES.values()))}
            AS failed FROM measured)"""

QUALITY_RULES = f"""WITH {_MEASURED}
    SELECT * REPLACE (CAST(failed AS BIGINT) AS failed), failed & {mask(POLICIES["base"])} <> 0 AS base_failed,
           failed & {mask(POLICIES["base"]) | mask(POLICIES[POLICY])} = 0 AS kept
    FROM judged"""

_CASES = ", ".join(
    f"('{policy}', '{rule}', {mask(rules)}, {mask((rule,))})" for policy, rules in POLICIES.items() for rule in rules
)
RULE_ABLATION = f"""WITH {_MEASURED}
    SELECT policy, rule, CAST(count(*) FILTER (failed & bit <> 0) AS BIGINT) AS rejected,
           CAST(count(*) FILTER (failed & mask = bit) AS BIGINT) AS only
    FROM judged, (VALUES {_CASES}) AS c(policy, rule, mask, bit) GROUP BY policy, rule"""

# every run of up to MIN_WORDS lines with enough words; longer ones consist of such
LINE_DEDUP = rf"""WITH
    each_line AS (
        SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
    worded AS (
        SELECT doc_id, line, shown, len(regexp_extract_all(shown, '{_WORD}+')) AS words,
               row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq
        FROM (SELECT doc_id, line, regexp_replace(raw, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS shown FROM each_line)
        WHERE shown <> ''),
    runs AS (
        SELECT doc_id, a.seq, a.line, size, list(w.shown ORDER BY w.seq) AS shown, list(w.line) AS lines
        FROM worded a CROSS JOIN (SELECT unnest(range(1, {MIN_WORDS + 1})) AS size)
        JOIN worded w USING (doc_id) WHERE w.seq BETWEEN a.seq AND a.seq + size - 1
        GROUP BY doc_id, a.seq, a.line, size HAVING count(*) = size AND sum(w.words) >= {MIN_WORDS}),
    gone AS (
        SELECT doc_id, list_sort(list_distinct(flatten(list(lines)))) AS deleted
        FROM (SELECT doc_id, lines FROM runs
              QUALIFY row_number() OVER (PARTITION BY shown ORDER BY doc_id, seq) > 1) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(deleted), 0) AS BIGINT) AS n_deleted,
           coalesce(array_to_string(deleted, ','), '') AS deleted,
           CASE WHEN deleted IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)),
               lambda x, i: NOT list_contains(deleted, i - 1)), chr(10)) END AS text
    FROM documents LEFT JOIN gone USING (doc_id)"""

# CRC-32 of a short text, a byte and then a bit at a time
_CRC = """xor(4294967295, list_reduce(
        list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [CAST(0 AS BIGINT) for b in range(8)]),
            lambda rest, b: CASE WHEN rest & 1 = 1 THEN xor(rest >> 1, 3988292384) ELSE rest >> 1 END)))"""

# each pair of equal words less than a quarter of the text apart; stretches of such pairs are the runs
PERIODIC_RUNS = rf"""WITH
    parts AS (
        SELECT doc_id, row_number() OVER () AS nr, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words, {_CRC} AS h
        FROM documents),
    cut AS (SELECT *, len(words) AS n, h // 10 AS g, (h // 10) % greatest(len(words), 1) AS a FROM parts),
    tails AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
    placed AS (
        SELECT doc_id, nr, n, place AS i,
               words[1 + CASE WHEN h % 10 = 0 AND place >= a THEN a + (place - a) % p ELSE place END] AS word
        FROM (SELECT *, unnest(range(n)) AS place FROM tails)),
    pairs AS (
        SELECT x.nr, x.i, y.i - x.i AS q FROM placed x JOIN placed y
        ON x.nr = y.nr AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    stretches AS (
        SELECT nr, q, min(i) AS start, count(*) + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY nr, q ORDER BY i) AS island FROM pairs)
        GROUP BY nr, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (
        SELECT * FROM stretches s WHERE NOT EXISTS (
            SELECT 1 FROM stretches t WHERE t.nr = s.nr AND t.q < s.q AND t.start <= s.start
                AND t.start + t.length >= s.start + s.length)),
    listed AS (
        SELECT nr, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs,
               first({{'start': start, 'length': length, 'period': q}} ORDER BY length / CAST(q AS DOUBLE) DESC, start, q) AS best
        FROM runs GROUP BY nr),
    gone AS (SELECT DISTINCT nr, unnest(range(start + q, start + length)) AS i FROM runs),
    left_over AS (
        SELECT nr, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed FROM placed ANTI JOIN gone USING (nr, i) GROUP BY nr)
    SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start,
           CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
           CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
           coalesce(runs, sha256('')) AS runs_sha256, coalesce(collapsed, sha256('')) AS collapsed_sha256,
           CAST(n AS BIGINT) AS n_words
    FROM tails LEFT JOIN listed USING (nr) LEFT JOIN left_over USING (nr)"""

_CLUSTERS, _ROUNDS = 40, 5
_FLOOR = "(total - ((total % n) + n) % n) // n"


def _round(number: int) -> str:
    """The vectors with their nearest of the centroids ``c<number>``, and the centroids after it."""
    return f"""
    near{number} AS MATERIALIZED (
        SELECT k.nr, k.v, c.n AS cluster,
               list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
        FROM kept k CROSS JOIN c{number} c QUALIFY row_number() OVER (PARTITION BY k.nr ORDER BY distance, c.n) = 1),
    mean{number} AS (
        SELECT cluster, list({_FLOOR} ORDER BY d) AS v
        FROM (SELECT cluster, d, sum(x) AS total, count(*) AS n
              FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near{number}) GROUP BY cluster, d)
        GROUP BY cluster),
    c{number + 1} AS MATERIALIZED (
        SELECT n, coalesce(m.v, c.v) AS v FROM c{number} c LEFT JOIN mean{number} m ON m.cluster = c.n)"""


CENTROID_CLUSTERS = f"""WITH
    kept AS MATERIALIZED (
        SELECT row_number() OVER () AS nr, vec_id,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS n, v FROM kept
        QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {_CLUSTERS}),
    {",".join(_round(n) for n in range(_ROUNDS + 1))}
    SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
           CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM near{_ROUNDS} a JOIN kept k USING (nr) JOIN c{_ROUNDS} c ON c.n = a.cluster"""

_STEPS = {
    "length": ("n_words", "1, 5, 10, 20, 50, 100, 300, 1000, 3000"),
    "word_size": ("word_chars / greatest(n_words, 1)", "2, 3, 4, 5, 6, 7, 9, 12"),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", "0.01, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9"),
    "symbols": ("n_symbols / greatest(n_words, 1)", "0.01, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6"),
    "capitals": ("n_upper / greatest(n_upper + n_lower, 1)", "0.02, 0.05, 0.1, 0.2, 0.4, 0.8"),
    "line_copies": ("n_dup_lines / greatest(n_lines, 1)", "0.01, 0.1, 0.2, 0.35, 0.5, 0.8"),
}
_FEATURES = " UNION ALL ".join(
    f"""SELECT doc_id, own, '{name}' AS name, len(list_filter(CAST([{limits}] AS DOUBLE[]), lambda l: {value} >= l)) AS step
        FROM known"""
    for name, (value, limits) in _STEPS.items()
)


def _strength_sql(sites: str, parent: str) -> str:
    """The labels that the parent's rate is worth: spread of the sites beyond chance over that of one label."""
    return f"""
        SELECT CASE WHEN share > 0 THEN least(1000, greatest(2, 1 / share - 1)) ELSE 1000 END AS strength
        FROM (SELECT (sum(labels * pow(good / labels - {parent}, 2)) - sum({parent} * (1 - {parent})))
                     / nullif(sum(labels * {parent} * (1 - {parent})), 0) AS share
              FROM {sites} WHERE labels > 0)"""


QUALITY_BAYES = f"""WITH {_MEASURED},
    marked AS (SELECT doc_id, CAST(avg(quality) >= 0.5 AS INTEGER) AS mark FROM labels
               WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    known AS (
        SELECT *, CASE WHEN NOT held_out THEN mark END AS own
        FROM (SELECT m.*, coalesce(d.source, '(none)') AS host, coalesce(d.lang, '(none)') AS path, k.mark,
                     k.mark IS NOT NULL AND {_CRC.replace("doc_id", "m.doc_id")} % 5 = 0 AS held_out
              FROM measured m JOIN documents d USING (doc_id) LEFT JOIN marked k USING (doc_id))),
    paths AS (SELECT host, path, count(own) AS labels, coalesce(sum(own), 0) AS good FROM known GROUP BY host, path),
    hosts AS (SELECT host, sum(labels) AS labels, sum(good) AS good FROM paths GROUP BY host),
    everyone AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(labels), 0) + 2) AS overall FROM hosts),
    of_host AS ({_strength_sql("hosts, everyone", "overall")}),
    rated AS (SELECT host, (good + strength * overall) / (labels + strength) AS host_rate FROM hosts, of_host, everyone),
    under AS (SELECT * FROM paths JOIN rated USING (host)),
    of_path AS ({_strength_sql("under", "host_rate")}),
    features AS ({_FEATURES}),
    counts AS (SELECT name, step, sum(own) AS yes, sum(1 - own) AS no FROM features WHERE own IS NOT NULL GROUP BY name, step),
    ratios AS (
        SELECT name, step, ln((yes + 1) / (sum(yes + 1) OVER w + 1) / ((no + 1) / (sum(no + 1) OVER w + 1))) AS ratio
        FROM counts WINDOW w AS (PARTITION BY name)),
    shown AS (SELECT doc_id, sum(coalesce(ratio, 0)) AS evidence FROM features LEFT JOIN ratios USING (name, step) GROUP BY doc_id),
    weighed AS (
        SELECT doc_id, host, path, evidence, held_out,
               (good - coalesce(own, 0) + strength * host_rate) / (labels - CAST(own IS NOT NULL AS INTEGER) + strength) AS site_rate
        FROM known JOIN shown USING (doc_id) JOIN under USING (host, path), of_path)
    SELECT doc_id, host, path, round(evidence, 6) AS evidence, round(site_rate, 6) AS site_rate, round(score, 6) AS score,
           score >= 0.5 AS kept, held_out
    FROM (SELECT *, 1 / (1 + exp(-evidence) * (1 - site_rate) / site_rate) AS score FROM weighed)"""

ORACLES = {
    "op7_line_dedup": LINE_DEDUP,
    "op8_quality_rules": QUALITY_RULES,
    "op8_rule_ablation": RULE_ABLATION,
    "op9_quality_bayes": QUALITY_BAYES,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op13_centroid_clusters": CENTROID_CLUSTERS,
}
