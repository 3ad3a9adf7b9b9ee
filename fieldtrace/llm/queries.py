"""The queries opN_* over the driver's tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import byte_bpe, context_tree, fill_middle, html_extract, line_dedup, mixing, nn_descent, pseudonyms, quality_rules, secret_scan, shingle_join, spelling, token_files
from fieldtrace.llm.common import Saved, table

#: Key of the pseudonyms in these queries; a deployment passes its own secret.
KEY = "fieldtrace-demonstration-key"
#: Words of a line run that make it worth removing when it repeats.
MIN_WORDS = 50
#: Readings of the most repeated source for each of the least repeated one.
MAX_REPEATS = 1.5


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, KEY, count="n_replaced")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.run(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.link(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, MIN_WORDS).withColumnsRenamed({"_lines_removed": "n_lines_removed", "_words_removed": "n_words_removed"})


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shingle_join.join(docs).drop("node", "a", "b")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # Counts are narrow: written once, read for the cutoffs and for the verdicts.
    scored = Saved(quality_rules.features(docs).drop("text"), "quality-features").df
    cutoffs = quality_rules.calibrate(scored, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(scored, cutoffs)
    return judged.select("doc_id", *(f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, max_repeats=MAX_REPEATS).drop("text")
    return mixed.withColumnsRenamed({"_tokens": "n_tokens", "_epoch": "epoch", "_block": "block", "_position": "position", "_weight": "weight"})


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line", seed=7, rate=100, spm_rate=50)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_one_in=199)
    return spelling.group(spelling.count(runs, least=5), factor=5).select("word", "form", "root", "n", "n_near", "form_n")


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pseudonyms, op2_byte_bpe, op3_context_tree, op4_nn_descent, op5_line_dedup, op6_token_files, op7_shingle_join, op8_quality_rules, op9_mixing, op10_secret_scan, op11_fill_middle, op12_spelling, op13_html_extract)}
#: Steps of the quality rules as rows of SQL: number, count, count that it is divided by, cutoff.
STEPS = ", ".join(f"({i}, '{quality_rules.RULES[r][0]}', '{quality_rules.RULES[r][1]}', {cutoff}::DOUBLE)" for i, (r, cutoff) in enumerate(quality_rules.STEPS, 1))


def _matches(rank: int, pattern: str, group: int, least: int) -> str:
    """SQL: matches of a pattern in each text, and the pieces between them."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT nr, {rank} AS rank, {least} AS least, string_split_regex(t, {p}) AS gap, regexp_extract_all(t, {p}) AS hit, regexp_extract_all(t, {p}, {group}) AS val FROM t WHERE regexp_matches(t, {p})"


#: The patterns of the secret scan in the order of its kinds, with the group of the value and its least length.
MATCHES = " UNION ALL ".join(
    _matches(i, *spec)
    for i, spec in enumerate(
        [
            (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
            (r"AKIA[A-Z0-9]+", 0, 18),
            (r"[0-9a-f]+", 0, 16),
            (secret_scan.FURTHER["format"][0], 0, 16),
            (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
        ]
    )
)
SQL: dict[str, str] = {
    "op7_shingle_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s), e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT n.doc_id, n.n_shingles, min(other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL""",
    "op8_quality_rules": rf"""WITH t AS (SELECT row_number() OVER () AS nr, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT nr, i, w[i:i + 4] AS g FROM (SELECT nr, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT nr, i FROM g QUALIFY count(*) OVER (PARTITION BY nr, g) > 1),
r AS (SELECT nr, count(DISTINCT i + k) AS n FROM twice, range(5) AS s(k) GROUP BY nr),
c AS (SELECT w.nr, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks
  FROM w LEFT JOIN r ON r.nr = w.nr),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
v AS (SELECT nr, unnest(['n_words', 'word_chars', 'n_symbols', 'n_lines', 'n_dup_lines', 'n_repeat_words', 'n_upper', 'n_marks']) AS name, unnest([n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks]) AS value FROM f),
steps(step, part, whole, cutoff) AS (VALUES {STEPS}),
hit AS (SELECT p.nr, min(step) AS step FROM steps JOIN v p ON p.name = part JOIN v q ON q.name = whole AND q.nr = p.nr WHERE q.value > 0 AND p.value / q.value >= cutoff GROUP BY p.nr),
j AS (SELECT f.*, CASE WHEN base_failed THEN 0 ELSE coalesce(hit.step, 1000) END AS first FROM f LEFT JOIN hit ON hit.nr = f.nr),
held AS (SELECT lang, first FROM j WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
n AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata FROM held GROUP BY lang),
k AS (SELECT n.lang, n.n, n.strata, step, (SELECT count(*) FROM held WHERE held.lang IS NOT DISTINCT FROM n.lang AND first <= step) AS k FROM n, steps),
p AS (SELECT lang, step, strata, CASE WHEN k > n * {quality_rules.ALPHA} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.ALPHA}) + (n - i) * ln(1 - {quality_rules.ALPHA})))) END AS p FROM k),
safe AS (SELECT lang, max(step) AS step FROM p WHERE p <= {quality_rules.DELTA} / strata GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first > coalesce(safe.step, 0) AS kept FROM j LEFT JOIN safe ON safe.lang IS NOT DISTINCT FROM j.lang""",
    "op10_secret_scan": rf"""WITH t AS (SELECT row_number() OVER () AS nr, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({MATCHES}),
u AS (SELECT nr, rank, least, i, length(gap[i]) AS gap, length(hit[i]) AS hit, val[i] AS val FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m)),
s AS (SELECT nr, rank, least, val, sum(gap + hit) OVER (PARTITION BY nr, rank ORDER BY i) - hit AS start, sum(gap + hit) OVER (PARTITION BY nr, rank ORDER BY i) AS stop FROM u),
f AS (SELECT nr, rank, val, start, stop FROM s WHERE length(val) >= least),
h AS (SELECT * FROM f WHERE rank < 3 UNION ALL
  SELECT * FROM f WHERE rank >= 3 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.nr = f.nr AND o.start < f.stop AND f.start < o.stop AND (o.rank < 3 OR o.rank = 3 AND f.rank = 4))
  AND (rank = 3 OR regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]'))),
o AS (SELECT val, count(DISTINCT {{'o': source}}) AS n_owners, count(DISTINCT {{'o': source, 'r': doc_id}}) AS n_repositories FROM h JOIN t USING (nr) GROUP BY val),
j AS (SELECT nr, rank, start, ['assign', 'access', 'hex', 'format', 'mixed'][rank + 1] || ':' || start || ':' || stop AS span, n_owners <= {secret_scan.MOST_OWNERS} AND n_repositories <= {secret_scan.MOST_REPOSITORIES} AS live FROM h JOIN o USING (val)),
a AS (SELECT nr, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
  string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3 OR live) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM j GROUP BY nr)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN a ON a.nr = t.nr""",
    "op12_spelling": rf"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[{spelling.LETTERS}]+')) AS run FROM documents),
u AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM r WHERE length(run) >= {spelling.SHORTEST} GROUP BY ALL),
b AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM u),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT) AS h FROM b, crc),
c AS (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM c WHERE length(word) >= {spelling.SHORTEST} GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, i, left(word, i - 1) || substring(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word, x.n, y.word AS o, y.n AS m FROM d x JOIN d y ON x.i = y.i AND x.v = y.v AND x.word <> y.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.v = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.v = w.word),
g AS (SELECT word, n, count(*) AS n_near, max(m) AS m FROM p GROUP BY ALL),
f AS (SELECT word, n_near, CASE WHEN m >= 5 * n THEN m END AS form_n, CASE WHEN m >= 5 * n THEN (SELECT min(encode(o)) FROM p WHERE p.word = g.word AND p.m = g.m) END AS form FROM g),
s(word, root) AS (SELECT word, word FROM w UNION ALL SELECT s.word, decode(f.form) FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
e AS (SELECT s.word, root FROM s LEFT JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT w.word, decode(f.form) AS form, e.root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM w JOIN e USING (word) LEFT JOIN f USING (word)""",
}
