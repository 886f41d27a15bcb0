"""The queries of this subpackage, with SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import decontaminate, embedding_dedup, filter_audit, jaccard_join, language_id, line_dedup, lm_scoring, mixing, substring_dedup, suffix_dedup, token_records, url_filters, vector_codes
from parcelspark.llm.common import bounded_batches, shared_path, table, word_count, written

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
except ImportError:
    TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("tie"))
    docs = written(docs, "sizes")  # the words are counted once
    out = mixing.plan(docs, size=F.col("words"), tie=F.col("tie"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT none, key, sum(size)::BIGINT AS source_size FROM d GROUP BY none, key),
r AS (SELECT *, row_number() OVER (ORDER BY none, key) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r),
q AS (SELECT *, cap / w AS ratio FROM w),
p AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM q),
l AS (SELECT rate FROM p WHERE rate <= ratio ORDER BY ratio, rnk LIMIT 1),
t AS (SELECT none, key, source_size, coalesce(least(cap, w * (SELECT rate FROM l)), cap) AS target, ((rnk * 1103515245 + 12345) % 1000003) / 1000003.0::DOUBLE AS off FROM p),
n AS (SELECT d.*, source_size, target, off, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share,
        row_number() OVER (PARTITION BY none, key ORDER BY (length(bin(size)) - 1) * 4 + ((size * 4) >> (length(bin(size)) - 1)) % 4,
                           coalesce((doc_id % b + b) % b, 0), size, doc_id NULLS FIRST) AS n
      FROM d JOIN t USING (none, key), (SELECT greatest(32, (count(*) + 65535) // 65536) AS b FROM d)),
c AS (SELECT *, (floor(n * share + off) - floor((n - 1) * share + off))::BIGINT AS copies FROM n)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, f.first IS NOT NULL AND l.doc_id > f.first AS gone FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    model = language_id.train(docs, ~F.col("held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    index = token_records.write_records(table(spark, sf_dir, "documents"), shared_path(spark, "token-records"), TOKENIZER)
    return token_records.offsets(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n) l),
h AS (SELECT v.doc_id, v.i, v.n, p.item_id FROM v JOIN p ON v.n = p.n AND v.win = p.win),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), n=4, pct=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
walk AS (SELECT doc_id AS u, doc_id AS root FROM documents UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(root) AS component_id FROM walk GROUP BY u) m ON m.u = d.doc_id
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
walk AS (SELECT vec_id AS u, vec_id AS root FROM embeddings UNION SELECT l.v, walk.root FROM walk JOIN l ON l.u = walk.u)
SELECT m.u AS vec_id, coalesce(n, 0) AS n_links, component_id, m.u = component_id AS kept
FROM (SELECT u, min(root) AS component_id FROM walk GROUP BY u) m LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) k ON k.u = m.u
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
k AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
y AS (SELECT x.doc_id, count(*) AS n, count(k.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (k.p IS NULL) AS kept FROM x LEFT JOIN k ON x.doc_id = k.doc_id AND x.p = k.p GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y ON w.doc_id = y.doc_id
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round is a pair of common table expressions: the nearest entry of each part, then the means."""
    near = """SELECT vec_id, label, x.p, s, min(struct_pack(d := list_sum(list_transform(range(1, len(s) + 1), lambda j: (s[j] - e[j]) * (s[j] - e[j])))::BIGINT, k := k)) AS m
      FROM x JOIN c{i} c ON x.p = c.p GROUP BY vec_id, label, x.p, s"""
    mean = """SELECT c.p, c.k, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (
        SELECT p, k, list(z ORDER BY j) AS e FROM (SELECT p, m.k AS k, j, floor(sum(s[j])::DOUBLE / count(*))::BIGINT AS z FROM a{i}, (SELECT unnest(range(1, (SELECT any_value(w) FROM v) + 1)) AS j) GROUP BY p, m.k, j) GROUP BY p, k
      ) n ON n.p = c.p AND n.k = c.k"""
    steps = "".join(f"a{i} AS MATERIALIZED ({near.format(i=i)}),\nc{i + 1} AS MATERIALIZED ({mean.format(i=i)}),\n" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, e[p * w + 1:(p + 1) * w] AS s FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, s AS e FROM x QUALIFY k < {entries}),
{steps}f AS MATERIALIZED ({near.format(i=rounds)}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM r
"""


#: The rules of the query, each with its host and path.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP12_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, s, v)),
f AS (SELECT host, path, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.flags(docs.select("doc_id", "source", "text"), labels.select("doc_id", "quality", "toxic")))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 5 * length(t.text),
                    regexp_matches(t.text, '[#$%&*|]'), coalesce(t.doc_id > first, false)] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM t JOIN e ON t.text = e.text LEFT JOIN l ON t.doc_id = l.doc_id),
g AS MATERIALIZED (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic, len(list_filter(f, lambda x: x)) AS fails FROM d GROUP BY part, f),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, step::INTEGER AS step, position(filter_order[step] IN 'ABCDE') AS k, list_transform(range(1, step), lambda i: position(filter_order[i] IN 'ABCDE')) AS before
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
x AS (SELECT part, filter_order, step, k, f[k] AS fail, len(list_filter(before, lambda i: f[i])) = 0 AS here, n, good, toxic, fails FROM g, s),
y AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (here AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND fail), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (NOT here AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail AND fails = 1), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (here AND fail), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND fail), 0)::BIGINT AS toxic_lost FROM x GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM y
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_records": op5_token_records,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_url_filters": op12_url_filters,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op1_mixing": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_vector_codes": _op11_sql(),
    "op12_url_filters": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
