"""Registered queries of the corpus operators, with the SQL they must agree with where SQL can express them.

Each applies its operator to its whole table; the operators keep interfaces of their own, and the digest columns of
the results are derived from their outputs here.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import (centroids, chat, decontamination, language, licenses, packing, quality, repetition, secrets,
                          simhash, toxicity, two_fit, whitening)
from tidemark.llm.common import labelled_sample, read, remainder

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_quality")
def op1(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.learn(labelled_sample(docs, labels, "quality", 4, 2, quality.TRAIN_ROWS))
    return quality.classify(docs, model).withColumn("held_out", remainder("doc_id", 4) == 2)


@query("op2_simhash")
def op2(spark, sf_dir):
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_language")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language.learn(language.training(docs))
    return language.predict(docs, model).select("doc_id", "lang_pred", "score", (remainder("doc_id", 4) == 2).alias("held_out"))


@query("op4_decontamination", r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(cast(item_id AS varchar), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
runs AS (
  SELECT n, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS t
  FROM (SELECT n, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, (SELECT DISTINCT l FROM windows))),
hits AS (SELECT n, l, i, item FROM runs JOIN windows USING (l, t)),
places AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + l)) AS p FROM hits) GROUP BY n),
named AS (SELECT n, count(*) AS c, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(c, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN places USING (n) LEFT JOIN named USING (n)
""")
def op4(spark, sf_dir):
    found = decontamination.find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("hit_spans") > 0).alias("contaminated"))


@query("op5_secrets", r"""
WITH rules(rule, kind, pattern, grp, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{24,}', 0, 24)),
texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
cuts AS (
  SELECT n, 0 AS rule, string_split_regex(text, (SELECT pattern FROM rules WHERE rule = 0)) AS gaps,
    regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
    regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS parts FROM texts
  UNION ALL SELECT n, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM texts
  UNION ALL SELECT n, 2, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}', 0), regexp_extract_all(text, '[0-9a-f]{24,}', 0) FROM texts),
each AS (SELECT n, rule, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM cuts WHERE len(hits) > 0),
placed AS (
  SELECT n, rule, i, length(hits[i]) AS whole, length(parts[i]) AS part,
    sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY n, rule ORDER BY i) AS stop FROM each),
spans AS (
  SELECT n, rule, kind, cast(stop - whole AS bigint) AS start, cast(stop AS bigint) AS stop FROM placed JOIN rules USING (rule) WHERE part >= least),
found AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS s FROM spans GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans FROM texts LEFT JOIN found USING (n)
""")
def op5(spark, sf_dir):
    found = secrets.secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, count = secrets.described(F.col("findings")), lambda kind: secrets.counted(F.col("findings"), kind)
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
                        spans.alias("spans"))


@query("op6_repetition", f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (
  SELECT n, count(*) - count(DISTINCT line) AS d FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
runs AS (
  SELECT n, l, i, hash(array_to_string(list_slice(w, i, i + l - 1), ' ')) AS t
  FROM (SELECT n, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, (VALUES (5), ({repetition.LEAST}), ({repetition.LONGEST + 1})) v(l))),
again AS (SELECT n, l, i FROM (SELECT *, count(*) OVER (PARTITION BY n, l, t) AS c FROM runs) WHERE c > 1),
covered AS (SELECT n, l, count(DISTINCT p) AS c FROM (SELECT n, l, unnest(range(i, i + l)) AS p FROM again) GROUP BY n, l),
per AS (
  SELECT n, max(c) FILTER (l = 5) AS a, max(c) FILTER (l = {repetition.LEAST}) AS b,
    max(c) FILTER (l = {repetition.LONGEST + 1}) AS z FROM covered GROUP BY n),
counts AS (
  SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    coalesce(d, 0) AS n_dup_lines, coalesce(a, 0) AS n_repeat_words, coalesce(b, 0) AS b, coalesce(z, 0) AS z
  FROM docs LEFT JOIN lines USING (n) LEFT JOIN per USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * b <= {repetition.MOST_COVERED} * n_words AND z = 0 AS kept
FROM counts
""")
def op6(spark, sf_dir):
    return repetition.repetition(read(spark, sf_dir, "documents")).drop("covered_words", "longest_repeat")


@query("op7_chat", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, ['user', 'assistant'][n], '\### Assistant: </turn> ok' FROM range(1, 3) t(n)),
pieces AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '\l/turn>'), '<more>', '\lmore>'), '### ', '\h## ') AS safe,
    replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\l/turn>'), '<more>', '\lmore>'), '### ', '\h## '), ':', '\c') AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last_role FROM rows)
SELECT cast(conv_id AS bigint) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(safe) + CASE WHEN role = last_role THEN 6 ELSE length(head) + 14 END) AS bigint) AS formatted_chars
FROM pieces GROUP BY conv_id
""")
def op7(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 1, "user", said), (-7, 2, "assistant", said)], rows.schema)
    shown = chat.format_conversations(rows.unionByName(extra))
    turns = chat.read_back(F.col("formatted"))
    under = F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_runs")), "")
    return shown.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), chat.digest(F.col("turns")).alias("turns_sha256"),
        F.length(under).cast("bigint").alias("loss_chars"), F.sha2(under.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op8_licenses")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scorer = toxicity.learn(docs, labelled_sample(docs, labels, "toxic", 5, 0, toxicity.TRAIN_ROWS))
    return toxicity.score(docs, scorer).withColumn("held_out", remainder("doc_id", 5) == 0)


@query("op11_best_two_fit")
def op11(spark, sf_dir):
    return two_fit.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def _rounds(rounds: int) -> str:
    """Assignment and new centroids of each round, and a last assignment."""
    def assign(i):
        return f"""
a{i} AS MATERIALIZED (
  SELECT r, k, q FROM (SELECT r, k, cast(sum((v - m) * (v - m)) AS bigint) AS q FROM entries JOIN c{i} USING (d) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY q, k) = 1),"""

    def move(i):
        return f"""
c{i + 1} AS MATERIALIZED (
  SELECT k, d, coalesce(new.m, old.m) AS m FROM c{i} old LEFT JOIN (
    SELECT k, d, cast(floor(cast(sum(v) AS double) / count(*)) AS bigint) AS m FROM entries JOIN a{i} USING (r) GROUP BY k, d) new USING (k, d)),"""

    return "".join(assign(i) + move(i) for i in range(rounds)) + assign(rounds)


@query("op12_centroids", f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [cast(floor(1024 * cast(x AS double)) AS bigint) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
entries AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS d, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (
  SELECT k, unnest(range(1, 65)) AS d, unnest(x) AS m FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(cast(vec_id AS varchar), '')), x) - 1 AS k, x FROM kept) WHERE k < 8),
{_rounds(centroids.ROUNDS)}
named AS (SELECT k, sha256(string_agg(cast(m AS varchar), ',' ORDER BY d)) AS s FROM c{centroids.ROUNDS} GROUP BY k)
SELECT vec_id, cast(k AS integer) AS cluster, q AS distance, cast(sum(q) OVER (PARTITION BY k) AS bigint) AS cluster_inertia,
  cast(sum(q) OVER () AS bigint) AS inertia, s AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN kept USING (r) JOIN named USING (k)
""")
def op12(spark, sf_dir):
    return centroids.cluster(read(spark, sf_dir, "embeddings")).drop("centroid")


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))
