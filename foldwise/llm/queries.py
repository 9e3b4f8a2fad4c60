"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import (bpe, chat, embed_dedup, langid, line_dedup, ngram_join, outliers, packing, quality, spans, urls, variants,
                          vector_codes)
from foldwise.llm.common import table, text_crc

END_ID = 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans_text = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws(":", s["begin"], s["end"])), ",")
    return out.select("conv_id", "speaker", "block", F.col("n_turns").cast("long"), "char_start",
                      F.md5("text").alias("text_md5"), spans_text.alias("loss_spans"))


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.dedup_spans(table(spark, sf_dir, "documents"), both_ends=True)
    return out.select("doc_id", "text", "n_sentences", "n_removed")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = text_crc("doc_id") % 3 == 1
    out = langid.identify(docs, langid.fit(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = text_crc("doc_id") % 5 == 0
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score",
                      (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.similarity_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return out.withColumn("codebooks_sha256", F.lit(vector_codes.books_sha256(books)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat": op3_chat,
    "op4_span_dedup": op4_span_dedup,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality": op8_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filter": op13_url_filter,
}

# Words of a text in DuckDB: A-Z lower-cased, runs of anything but ASCII white space.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _vector_codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Rounds one after the other; distances as sums of integers that doubles hold."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, min((list_dot_product(p0.x, p0.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(p0.x, c.x))::BIGINT * {entries} + e) AS m
  FROM p0 JOIN c{k} c USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(x ORDER BY i) AS x FROM (
    SELECT p, m % {entries} AS e, i, floor(sum(p0.x[i]) / count(*)) AS x
    FROM a{k} JOIN p0 USING (r, p), range(1, (SELECT max(len(x)) FROM p0) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p0 AS MATERIALIZED (
  SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) t(p)),
c0 AS MATERIALIZED (
  SELECT p, e, p0.x FROM p0 JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM v) USING (r) WHERE e < {entries}),
{", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h
      FROM (SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM f JOIN v USING (r), s"""


_SPELLING_SQL = f"""
WITH RECURSIVE crc_bits AS (SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
run AS (SELECT doc_id, translate(run, '{variants.UPPER}', '{variants.LOWER}') AS run FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{variants.RUN}')) AS run FROM documents) WHERE length(run) >= {variants.MIN_LENGTH}),
seen AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM run GROUP BY ALL),
hash AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM seen, crc_bits),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % {variants.DELETE_EVERY} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hash) WHERE length(word) >= {variants.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {variants.MIN_COUNT}),
cut AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (SELECT x.word, y.word AS v, y.n AS vn FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT x.word, y.word, y.n FROM cut x JOIN word y ON x.a || x.b = y.word
         UNION SELECT y.word, x.word, x.n FROM cut x JOIN word y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(vn) AS vn, arg_min(v, (-vn, v)) AS v FROM near GROUP BY word),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= {variants.RATIO} * w.n THEN v END AS form,
  CASE WHEN vn >= {variants.RATIO} * w.n THEN vn END AS form_n FROM word w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM form
         UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM form f JOIN (SELECT walk.word, root FROM walk JOIN form ON root = form.word WHERE form.form IS NULL) w ON w.word = f.word"""


def _url_sql(order: int, rules) -> str:
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def chosen(value) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'"
                                  for h, p, v in longest) + " END"

    last = order + 1
    # one level at a time, so that no expression repeats the ones below
    levels = []
    for k in range(last):
        p = {c: "1.0::DOUBLE / size" if k == 0 else f"p{c}" for c in "ar"}
        source = "(SELECT DISTINCT gram, size FROM target, size)" if k == 0 else f"l{k - 1}"
        levels.append(f"""l{k} AS MATERIALIZED (SELECT gram, size, """ + ", ".join(
            f"CASE WHEN t{c} > 0 THEN (coalesce(n{c}, 0)::DOUBLE + u{c}::DOUBLE * ({p[c]})) / (t{c}::DOUBLE + u{c}::DOUBLE) ELSE {p[c]} END AS p{c}"
            for c in "ar") + f""" FROM {source} LEFT JOIN run ON run = substr(gram, {last - k}, {k + 1})
  LEFT JOIN context ON context = substr(gram, {last - k}, {k}))""")
    return f"""
WITH u AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
    '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path,
    translate(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END,
              '{urls.UPPER}{urls.DIGITS}', '{urls.LOWER}{"0" * 9}') AS text
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
m AS MATERIALIZED (SELECT *, {chosen(lambda h, p, v: h + p)} AS rule, {chosen(lambda h, p, v: v)} AS ruled,
  ('0x' || substr(md5(text), 1, 8))::BIGINT % {urls.HELD_OUT} = 0 AS held FROM u),
g AS MATERIALIZED (SELECT r, ruled, held, substr(repeat(chr(2), {order}) || text || chr(3), i, {last}) AS gram
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM m)),
run AS MATERIALIZED (SELECT run, count(*) FILTER (ruled = 'allow') AS na, count(*) FILTER (ruled = 'block') AS nr
  FROM (SELECT ruled, substr(gram, {last} - k, k + 1) AS run FROM g, range({last}) t(k) WHERE ruled IS NOT NULL AND NOT held) GROUP BY run),
context AS MATERIALIZED (SELECT substr(run, 1, length(run) - 1) AS context, sum(na) AS ta, count(*) FILTER (na > 0) AS ua,
  sum(nr) AS tr, count(*) FILTER (nr > 0) AS ur FROM run GROUP BY 1),
size AS (SELECT count(*) FILTER (length(run) = 1) + 1 AS size FROM run),
target AS MATERIALIZED (SELECT r, gram FROM g WHERE ruled IS NULL OR held),
{", ".join(levels)},
s AS MATERIALIZED (SELECT r, least(greatest(floor(sum(d) / (count(*) * {urls.STEP})), -{urls.STEPS}), {urls.STEPS})::INT AS step
  FROM target JOIN (SELECT gram, round((ln(pa) - ln(pr)) * 1e6)::BIGINT AS d FROM l{order}) USING (gram) GROUP BY r),
h AS MATERIALIZED (SELECT step, ruled = 'allow' AS good FROM s JOIN m USING (r) WHERE ruled IS NOT NULL),
n AS (SELECT count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS r FROM h),
t AS (SELECT t, count(*) FILTER (good AND step >= t) * any_value(n.r) + count(*) FILTER (NOT good AND step < t) * any_value(n.a) AS gain
      FROM range(-{urls.STEPS}, {urls.STEPS + 1}) r(t), n, h WHERE n.a > 0 AND n.r > 0 GROUP BY t),
best AS (SELECT coalesce((SELECT t FROM t ORDER BY gain DESC, abs(t), t LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN step >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM m LEFT JOIN s USING (r), best"""


ORACLES: dict[str, str] = {
    "op2_line_dedup": rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
d AS (SELECT *, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS words FROM s),
w AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY m, l[i + 1:i + m] ORDER BY doc_id, i) AS nth
      FROM (SELECT doc_id, l, words, m, unnest(range(0, len(l) - m + 1)) AS i FROM d, range(1, {line_dedup.MIN_LINES + 1}) r(m))
      WHERE m = {line_dedup.MIN_LINES} OR list_sum(words[i + 1:i + m]) >= {line_dedup.MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM w, range({line_dedup.MIN_LINES}) r(k) WHERE nth > 1 AND k < m),
line AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(n, 0) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(t, '')) END AS text_md5
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op3_chat": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '{chat.NO_ROLE}') AS role, replace(coalesce(text, ''), '<|', '< |') AS body,
                  coalesce(floor(turn / {chat.BLOCK_TURNS})::BIGINT, -1) AS block FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m),
p AS (SELECT m.*, speaker, role = speaker AS own,
             '{chat.OPEN}' || CASE WHEN role = speaker THEN 'assistant' ELSE 'user name=' || replace(role, '<|', '< |') END
             || chr(10) AS head, body || '{chat.CLOSE}' || chr(10) AS tail
      FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, length(head) + length(tail) AS size,
             coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, speaker, block
                      ORDER BY turn NULLS FIRST, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM p),
b AS (SELECT conv_id, speaker, block, count(*) AS n_turns, sum(size) AS total,
             md5(string_agg(head || tail, '' ORDER BY pos)) AS text_md5,
             coalesce(string_agg((pos + length(head)) || ':' || (pos + size - 1), ',' ORDER BY pos) FILTER (own), '') AS loss_spans
      FROM q GROUP BY conv_id, speaker, block)
SELECT conv_id, speaker, block, n_turns,
       coalesce(sum(total) OVER (PARTITION BY conv_id, speaker ORDER BY block
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, text_md5, loss_spans FROM b""",
    "op9_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
             ELSE array_to_string(w[i:i + 2], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""",
    "op10_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {embed_dedup.COSINE}),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)""",
    "op11_vector_codes": _vector_codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS),
    "op12_spelling_variants": _SPELLING_SQL,
    "op13_url_filter": _url_sql(urls.ORDER, urls.RULES),
}
