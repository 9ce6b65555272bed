"""Registered queries of the training-data operators, with SQL counterparts where SQL can express them.

Every query takes (spark, sf_dir) and works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from . import bpe, decontaminate, divergence, licenses, lines, minhash, mixing, multiindex, phrases, pii, quality, substrings, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def token_digest(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded texts."""
    done = bpe.round_trip(docs.select("doc_id", "text"), bpe.default_ranks(spark), bpe.default_pattern())
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return token_digest(table(spark, sf, "documents"), spark)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted; learnt from the labels outside the held-out fold."""
    held_out = F.coalesce(quality.fold() == 2, F.lit(False))
    model = quality.fit(docs, labels.filter(~held_out))
    return quality.with_score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op6_quality")
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s
  AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM words w LEFT JOIN sizes z ON w.doc_id = z.doc_id LEFT JOIN least l ON w.doc_id = l.doc_id
"""


@query("op7_minhash", OP7_SQL)
def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.clusters(table(spark, sf, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
    unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(len(w) - 8, 2))]) AS s FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d JOIN lengths ON len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND array_to_string(w[i:i + dw.n - 1], ' ') = s),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = decontaminate.words_hit()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS s
  FROM d WHERE len(w) >= 13),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op2_substrings", OP2_SQL)
def op2_substrings(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l),
spread AS (SELECT s, min(doc_id) AS m FROM t WHERE s <> '' GROUP BY s HAVING count(DISTINCT source) >= 10),
marked AS (SELECT t.*, coalesce(doc_id > m, false) AS hit FROM t LEFT JOIN spread USING (s)),
cut AS (SELECT doc_id FROM marked GROUP BY doc_id HAVING count(*) FILTER (hit) <= 0.5 * count(*) FILTER (s <> '')),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit AND doc_id IN (FROM cut)) AS n_removed,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (hit AND doc_id IN (FROM cut))) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, text)) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""


@query("op4_line_spread", OP4_SQL)
def op4_line_spread(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = lines.without_boilerplate(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS c FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""


@query("op10_multi_index", OP10_SQL)
def op10_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multiindex.clusters(table(spark, sf, "embeddings"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
x AS (SELECT *, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS m FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM x
"""


@query("op3_warc", OP3_SQL)
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_pages(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Key of the registered query; a deployment passes a secret of its own.
PII_KEY = b"registered query"


@query("op9_pii")
def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), PII_KEY)
    return done.select(
        "doc_id", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"]))), ",").alias("kinds"), "text",
    )


def op5_sql() -> str:
    """Whole texts, paragraphs and lines as units, all compared with every template."""
    rows = ", ".join("('{}', {}, '{}')".format(n, k, " ".join(t.split()).replace("'", "''")) for k, (n, t) in enumerate(licenses.TEMPLATES))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH units AS (SELECT doc_id, 0 AS kind, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(text, '\n[\x00-\x20]*\n')) FROM documents
  UNION ALL SELECT doc_id, 2, unnest(string_split(text, chr(10))) FROM documents),
numbered AS (SELECT row_number() OVER () AS u, doc_id, {words.format('t')} AS w FROM units),
b AS (SELECT DISTINCT u, doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM numbered WHERE len(w) > 1),
bn AS (SELECT u, count(*) AS n FROM b GROUP BY u),
tw AS (SELECT name, k, {words.format('t')} AS w FROM (VALUES {rows}) AS x(name, k, t)),
tb AS (SELECT DISTINCT name, k, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM tw),
tn AS (SELECT k, count(*) AS n FROM tb GROUP BY k),
common AS (SELECT u, doc_id, name, k, count(*) AS c FROM b JOIN tb USING (g) GROUP BY ALL),
found AS (SELECT doc_id, name, max(2.0::DOUBLE * c / (bn.n + tn.n)) AS s FROM common JOIN bn USING (u) JOIN tn USING (k)
  WHERE 2 * c >= 0.9 * (bn.n + tn.n) GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(s) AS best FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, round(coalesce(best, 0), 9) AS similarity
FROM documents LEFT JOIN listed USING (doc_id)
"""


@query("op5_licenses", op5_sql())
def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.with_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("licenses", lambda x: x["similarity"]))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.round(F.coalesce(best, F.lit(0.0)), 9).alias("similarity"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM d GROUP BY source),
caps AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS fills FROM s),
levels AS (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY fills, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fills, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
t AS (SELECT source, source_size, least(w * (SELECT max(level) FROM levels), CAST(cap AS DOUBLE)) AS target FROM caps),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS missing,
    sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN missing > 0 AND 2 * upto - size < 2 * missing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


@query("op11_mix", OP11_SQL)
def op11_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT k, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM x GROUP BY ALL HAVING count(DISTINCT k) >= 10),
size AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM x JOIN v USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, v.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (n.n + 2 * size.v) AS BIGINT) AS p
  FROM n JOIN v ON n.lang = v.lang JOIN size ON n.lang = size.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = v.term),
lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY lang),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (lc.c + 2)) // (ln.n + 2 * size.v) AS BIGINT) AS q FROM lc JOIN ln USING (lang) JOIN size USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
  FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM terms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op12_divergence", OP12_SQL)
def op12_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


OP13_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS p, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, s, m, count(*) AS f FROM (
    SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS s FROM w, unnest([1, 2, 3, 4]) AS u(m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, s, f, m, k, array_to_string(string_split(s, ' ')[1:k], ' ') AS s1, array_to_string(string_split(s, ' ')[k + 1:], ' ') AS s2
  FROM f, unnest([1, 2, 3]) AS u(k) WHERE k < m),
scored AS (SELECT cut.lang, cut.s, cut.f AS a, cut.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * cut.f // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.s = cut.s1 JOIN f y ON y.lang = cut.lang AND y.s = cut.s2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
inner_ AS (SELECT lang, f, array_to_string(string_split(s, ' ')[b:b + z - 1], ' ') AS s FROM f, unnest([2, 3]) AS u(z), unnest([1, 2, 3]) AS o(b)
  WHERE z < m AND b + z - 1 <= m),
kept AS (SELECT best.* FROM best ANTI JOIN inner_ ON inner_.lang = best.lang AND inner_.s = best.s AND 100 * inner_.f >= 80 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank FROM kept)
SELECT ranked.lang, rank, s AS phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op13_phrases", OP13_SQL)
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine(table(spark, sf, "documents").select("text", "lang"))
