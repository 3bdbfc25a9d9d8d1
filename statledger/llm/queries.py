"""Driver queries of the operators over the whole tables, each through its operator."""

import public_tokenizers
from pyspark.sql import functions as F

from statledger.llm import (
    alignment,
    ctw,
    decontaminate,
    host_rules,
    language,
    licenses,
    mixing,
    packing,
    pii,
    quality_model,
    simhash,
    toxicity,
    whitening,
)
from statledger.llm.tables import held_out, load

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_NOT_SPACE = r"'[^\x20\x09-\x0D]+'"


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score(docs, load(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


@query("op2_decontaminate", f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, g.item
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places) p
  JOIN grams g ON g.n = p.n AND g.g = p.g),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
  FROM hits GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN marked ON marked.doc_id = words.doc_id LEFT JOIN found ON found.doc_id = words.doc_id
""")
def op2_decontaminate(spark, sf_dir):
    return decontaminate.measure(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op3_language")
def op3_language(spark, sf_dir):
    found = language.predict(load(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id", language.FOLDS, language.HELD_OUT).alias("held_out"),
                        "lang_pred", "score", "rejected")


@query("op4_quality")
def op4_quality(spark, sf_dir):
    scored = quality_model.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out("doc_id", quality_model.FOLDS, quality_model.HELD_OUT).alias("held_out"), "score", "predicted")


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark, sf_dir):
    return pii.surrogates(load(spark, sf_dir, "documents"))


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"))


@query("op8_host_rules", f"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {_NOT_SPACE}) AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, {_NOT_SPACE})] AS lines
  FROM documents),
places AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM places) WHERE n > 1),
repeated AS (SELECT row, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT row, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY row),
counts AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeated ON repeated.row = split.row),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS host_docs,
    sum(CASE WHEN base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines THEN 1 ELSE 0 END) AS host_failed
  FROM judged GROUP BY source),
moments AS (SELECT (sum(host_failed) + 0.5) / (sum(host_docs) + 1) AS m,
    var_samp(CAST(host_failed AS DOUBLE) / host_docs) AS spread, avg(1.0 / host_docs) AS noise FROM hosts),
prior AS (SELECT m, least(greatest(
    m * (1 - m) / greatest(coalesce(spread, 0) - m * (1 - m) * noise, 1e-6) - 1, 2.0), 10000.0) AS weight FROM moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host_failed + m * weight) / (host_docs + weight) <= 0.5 AS kept,
  CAST(host_docs AS BIGINT) AS host_docs, CAST(host_failed AS BIGINT) AS host_failed
FROM judged JOIN hosts ON judged.source IS NOT DISTINCT FROM hosts.source, prior
""".replace("\\\\", "\\"))
def op8_host_rules(spark, sf_dir):
    return host_rules.judge(load(spark, sf_dir, "documents"))


_NOTICES = ", ".join(
    f"('{label}', '{notice}', '{phrase}')" for label, (notice, phrases) in licenses.TEMPLATES.items() for phrase in phrases)
_BASE = ", ".join(f"('{label}', '{phrase}')" for phrase, label in licenses.PHRASES.items())


@query("op9_licenses", f"""
WITH notices(label, notice, phrase) AS (VALUES {_NOTICES}),
base(label, phrase) AS (VALUES {_BASE}),
docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
places AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
spots AS (SELECT label, word, min(i) AS pos FROM (
    SELECT label, unnest(string_split(notice, ' ')) AS word, unnest(range(0, len(string_split(notice, ' ')))) AS i
    FROM (SELECT DISTINCT label, notice FROM notices)) GROUP BY label, word),
counts AS (SELECT word, count(DISTINCT row) AS n FROM places WHERE word IN (SELECT word FROM spots) GROUP BY word),
weighed AS (SELECT label, s.word, pos, coalesce(n, 0) AS n,
    ln(((SELECT count(*) FROM documents) + 1.0) / (coalesce(n, 0) + 1)) + 1e-3 AS weight
  FROM spots s LEFT JOIN counts c ON c.word = s.word),
anchors AS (SELECT * FROM weighed
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY n, pos) <= {licenses.ANCHORS}),
totals AS (SELECT label, sum(weight) AS total FROM anchors GROUP BY label),
looked AS (SELECT row, word FROM (SELECT DISTINCT row, p.word, a.weight FROM places p JOIN anchors a ON a.word = p.word)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY weight DESC, word) <= {licenses.LOOKED_UP}),
standing AS (SELECT p.row, a.label, round(sum(weight / total), 6) AS share
  FROM places p JOIN looked l ON l.row = p.row AND l.word = p.word
  JOIN anchors a ON a.word = p.word JOIN totals t ON t.label = a.label
  GROUP BY p.row, a.label, p.i - a.pos HAVING round(sum(weight / total), 6) >= {licenses.LEAST_SHARE}),
own AS (SELECT s.row, s.label, max(share) AS share FROM standing s JOIN docs d ON d.row = s.row
  WHERE NOT EXISTS (SELECT 1 FROM notices n WHERE n.label = s.label
    AND NOT contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || n.phrase || ' '))
  GROUP BY s.row, s.label),
stated AS (SELECT p.row, b.label, p.i FROM places p JOIN docs d ON d.row = p.row
  JOIN base b ON string_split(b.phrase, ' ')[1] = p.word
  WHERE array_to_string(d.w[p.i + 1:p.i + len(string_split(b.phrase, ' '))], ' ') = b.phrase),
bases AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM stated GROUP BY row),
named AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row, label FROM stated UNION ALL SELECT row, label FROM own) GROUP BY row),
best AS (SELECT row, max(share) AS share FROM own GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN bases ON bases.row = docs.row LEFT JOIN named ON named.row = docs.row LEFT JOIN best ON best.row = docs.row
""")
def op9_licenses(spark, sf_dir):
    return licenses.find(load(spark, sf_dir, "documents"))


@query("op10_ctw")
def op10_ctw(spark, sf_dir):
    return ctw.score(load(spark, sf_dir, "documents"))


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    path = public_tokenizers.path
    return alignment.align(load(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    rows = whitening.whiten(load(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as long)"))


@query("op13_packing")
def op13_packing(spark, sf_dir):
    packed = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.drop("ids")


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
