"""Text queries: cleaning, tags, extraction, chunking and gates, over whole documents, chunk nodes and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.plans.sqltext import SPACE, WIDE, clean, words
from lodestrata.tables import chunk_nodes, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


def text_clean(spark, sf_dir):
    cleaned = T.clean_text(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.length(cleaned).alias("size"), F.md5(cleaned).alias("fingerprint"), F.sha1(cleaned).alias("uid"))


def text_without_markup(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.without_markup(F.col("text"))).alias("fingerprint"))


def text_clean_chunks_changed(spark, sf_dir):
    return chunk_nodes(spark, sf_dir).where("text IS NOT NULL").agg(F.count_if(T.clean_text(F.col("text")) != F.col("text")).alias("changed"), F.count("*").alias("chunks"))


def text_emotion(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.emotion(F.col("text")).alias("emotion"))


def text_modality(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.modality(F.col("text")).alias("modality"))


def text_chunks_by_emotion(spark, sf_dir):
    return chunk_nodes(spark, sf_dir).where(T.emotion(F.col("text")) != "neutral").select("pos", "id")


def text_entities(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.explode(T.capitalized_names(F.col("text"))).alias("entity"))


def text_facts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.stated_facts(F.col("text")))).select(F.concat(F.lit("d"), "doc_id", F.lit("_fact_"), "pos").alias("fact_id"), "col.subject", "col.predicate", "col.object")


def text_triplets(spark, sf_dir):
    pairs = table(spark, sf_dir, "qa").where("answer IS NOT NULL")
    return pairs.select("pos", F.explode(T.stated_triplets(F.col("answer"))).alias("t")).select("pos", "t.subject", "t.predicate", "t.object")


def text_entropy(spark, sf_dir):
    return chunk_nodes(spark, sf_dir).where("text IS NOT NULL").select("pos", F.round(T.entropy_of_characters(F.col("text")), 6).alias("entropy"))


def text_language_gate(spark, sf_dir):
    """Whether each document's stated language is processed; those without one are not."""
    lang = F.lower(F.substring("lang", 1, 2))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(lang.isin("fr", "en"), F.lit(False)).alias("processed"))


def text_guessed_language(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.guessed_language(F.col("text")).alias("lang"))


# Words that block a text.
UNSAFE = r"\b(?:porn|xxx|sex)\b"


def capitals(text):
    """A stand-in for a model's toxicity: the share of capital letters."""
    return F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.length(text), F.lit(1))


def safety_score(text, toxicity=capitals):
    """Half of the ``toxicity`` (a function from a text column to a score) and of a hit of the pattern."""
    return 0.5 * (toxicity(text) + F.rlike(text, F.lit("(?i)" + UNSAFE)).cast("int"))


def text_safety_filter(spark, sf_dir):
    """The score form."""
    score = safety_score(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"), (score > 0.7).alias("blocked"))


def text_safety_guard(spark, sf_dir):
    """The guard form: a hit blocks at once."""
    return _documents(spark, sf_dir).where(F.rlike(F.col("text"), F.lit("(?i)" + UNSAFE)) | (0.5 * capitals(F.col("text")) > 0.04)).select("doc_id")


def text_safe_ingest(spark, sf_dir):
    lang = F.lower(F.substring("lang", 1, 2))
    return _documents(spark, sf_dir).where(lang.isin("fr", "en") & ~F.rlike(F.col("text"), F.lit("(?i)" + UNSAFE))).select("doc_id", lang.alias("lang"), F.length("text").alias("characters"))


def text_tool_calls(spark, sf_dir):
    marked = T.first_marked(T.first_marked(F.col("answer"), r"[0-9]+ (?:litres|hours)", "convert"), r"[A-Z]{2}-[0-9]+", "lookup")
    return table(spark, sf_dir, "qa").where("answer IS NOT NULL").select("pos", marked.alias("text"))


def text_template(spark, sf_dir):
    """Answers that hold the length and the pattern of a template."""
    return table(spark, sf_dir, "qa").select("pos", F.coalesce((F.length("answer") <= 120) & F.rlike("answer", F.lit(r"[.]\z")), F.lit(False)).alias("valid"))


def chunk_sliding(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.sliding_windows(F.col("text"), 512, 64)).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.length("chunk").alias("size"), F.md5("chunk").alias("fingerprint"))


def chunk_tokens(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.token_windows(F.col("text"), 100, 20)).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.md5("chunk").alias("fingerprint"))


def chunk_contextual(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.contextual_windows(F.col("text"), 120, 20)).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.md5("chunk").alias("fingerprint"))


def chunk_sentences(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentence_groups(F.col("text"), 3)).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.md5("chunk").alias("fingerprint"))


def chunk_paragraphs(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.packed_paragraphs(F.col("text"), 1200)).alias("n", "chunk"))
    return rows.select("doc_id", "n", F.length("chunk").alias("size"), F.md5("chunk").alias("fingerprint"))


def source_router(spark, sf_dir):
    """Which parser reads each path, by scheme and then extension."""
    from lodestrata.sources.readers import parser_of

    return table(spark, sf_dir, "documents").groupBy(F.coalesce(parser_of(F.col("path")), F.lit("none")).alias("parser")).agg(F.count("*").alias("documents"))


def payload_checks(spark, sf_dir):
    """Payloads and the rules they break."""
    pdf = table(spark, sf_dir, "pdf")
    entropy = F.coalesce(F.col("entropy") >= 3.5, F.lit(False))
    return pdf.groupBy(F.when(F.col("ocr").isNull(), "missing ocr").when(~entropy, "low entropy").otherwise("valid").alias("status")).agg(F.count("*").alias("payloads"))


QUERIES = {
    f.__name__: f
    for f in (
        text_clean, text_without_markup, text_clean_chunks_changed, text_emotion, text_modality, text_chunks_by_emotion, text_entities, text_facts, text_triplets, text_entropy, text_language_gate,
        text_guessed_language, text_safety_filter, text_safety_guard, text_safe_ingest, text_tool_calls, text_template, chunk_sliding, chunk_tokens, chunk_contextual, chunk_sentences, chunk_paragraphs, source_router, payload_checks,
    )
}

_CASE_EMOTION = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{label}'" for label, ws in T.EMOTION_WORDS.items()) + " ELSE 'neutral' END"
_SPOKEN = " OR ".join(f"contains(lower(text), '{w}')" for w in T.SPOKEN_MARKS)
_TOXIC = "length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1)"
_CHUNKS = "FROM nodes WHERE lower(type) = 'chunk' AND text IS NOT NULL"

ORACLES = {
    "text_clean": f"SELECT doc_id, length({clean('text')})::INT AS size, md5({clean('text')}) AS fingerprint, sha1({clean('text')}) AS uid FROM documents WHERE text IS NOT NULL",
    "text_without_markup": f"""SELECT doc_id, md5({clean("regexp_replace(text, '<[^>]+>', ' ', 'g')")}) AS fingerprint FROM documents WHERE text IS NOT NULL""",
    "text_clean_chunks_changed": f"SELECT count(*) FILTER ({clean('text')} <> text) AS changed, count(*) AS chunks {_CHUNKS}",
    "text_emotion": f"SELECT doc_id, {_CASE_EMOTION} AS emotion FROM documents WHERE text IS NOT NULL",
    "text_modality": f"SELECT doc_id, CASE WHEN {_SPOKEN} OR (len({words('text')}) > 0 AND length(regexp_replace(text, '[^.!?]', '', 'g')) / len({words('text')}) < 0.05) THEN 'spoken' ELSE 'written' END AS modality FROM documents WHERE text IS NOT NULL",
    "text_chunks_by_emotion": f"SELECT pos, id {_CHUNKS} AND ({_CASE_EMOTION}) <> 'neutral'",
    "text_entities": rf"SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{WIDE}', '_', 'g'), '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b', 1)) AS entity FROM documents WHERE text IS NOT NULL",
    "text_facts": r"""
WITH found AS (
  SELECT doc_id, list_concat(
    list_transform(list_zip(regexp_extract_all(text, '([A-Za-z ]+) is (?:the )?([A-Za-z ]+)\.', 1), regexp_extract_all(text, '([A-Za-z ]+) is (?:the )?([A-Za-z ]+)\.', 2)), lambda p: {'s': trim(p[1]), 'p': 'is', 'o': trim(p[2])}),
    list_transform(list_zip(regexp_extract_all(text, '([A-Za-z ]+) was born in ([A-Za-z ]+)\.', 1), regexp_extract_all(text, '([A-Za-z ]+) was born in ([A-Za-z ]+)\.', 2)), lambda p: {'s': trim(p[1]), 'p': 'born_in', 'o': trim(p[2])})) AS facts
  FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(range(1, len(facts) + 1)) AS n, facts FROM found)
SELECT 'd' || doc_id || '_fact_' || (n - 1) AS fact_id, facts[n].s AS subject, facts[n].p AS predicate, facts[n].o AS object FROM each""",
    "text_triplets": r"""
WITH f AS (SELECT pos, regexp_extract_all(answer, '(?i)([A-Za-z_]+)\s+(is|likes|has|eats|knows|located_in|capital_of)\s+([A-Za-z_]+)', 1) a, regexp_extract_all(answer, '(?i)([A-Za-z_]+)\s+(is|likes|has|eats|knows|located_in|capital_of)\s+([A-Za-z_]+)', 2) b, regexp_extract_all(answer, '(?i)([A-Za-z_]+)\s+(is|likes|has|eats|knows|located_in|capital_of)\s+([A-Za-z_]+)', 3) c FROM qa WHERE answer IS NOT NULL),
e AS (SELECT pos, a, b, c, unnest(range(1, len(a) + 1)) n FROM f)
SELECT pos, lower(a[n]) AS subject, lower(b[n]) AS predicate, lower(c[n]) AS object FROM e""",
    "text_entropy": f"""
WITH chars AS (SELECT pos, unnest(list_filter(regexp_extract_all(text, '(?s).'), lambda c: c <> '')) c {_CHUNKS}),
counts AS (SELECT pos, c, count(*) n FROM chars GROUP BY ALL), sizes AS (SELECT pos, sum(n) t FROM counts GROUP BY pos)
SELECT k.pos, coalesce(round(e, 6), 0) AS entropy FROM (SELECT pos {_CHUNKS}) k
LEFT JOIN (SELECT pos, -sum(n / t * log2(n / t)) e FROM counts JOIN sizes USING (pos) GROUP BY pos) x ON x.pos = k.pos""",
    "text_language_gate": "SELECT doc_id, coalesce(lower(substr(lang, 1, 2)), 'und') AS lang, coalesce(lower(substr(lang, 1, 2)) IN ('fr', 'en'), false) AS processed FROM documents",
    "text_guessed_language": "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[àâäéèêëîïôöùûüÿçœæ]') OR contains(lower(text), 'bonjour') THEN 'fr' WHEN contains(lower(text), 'hola') THEN 'es' ELSE 'en' END AS lang FROM documents WHERE text IS NOT NULL",
    "text_safety_filter": rf"SELECT doc_id, round(0.5 * ({_TOXIC} + regexp_matches(text, '(?i){UNSAFE}')::INT), 6) AS score, 0.5 * ({_TOXIC} + regexp_matches(text, '(?i){UNSAFE}')::INT) > 0.7 AS blocked FROM documents WHERE text IS NOT NULL",
    "text_safety_guard": rf"SELECT doc_id FROM documents WHERE text IS NOT NULL AND (regexp_matches(text, '(?i){UNSAFE}') OR 0.5 * {_TOXIC} > 0.04)",
    "text_safe_ingest": rf"SELECT doc_id, lower(substr(lang, 1, 2)) AS lang, length(text)::INT AS characters FROM documents WHERE text IS NOT NULL AND lower(substr(lang, 1, 2)) IN ('fr', 'en') AND NOT regexp_matches(text, '(?i){UNSAFE}')",
    "text_tool_calls": r"""
WITH a AS (SELECT pos, regexp_replace(answer, '(?i)([0-9]+ (?:litres|hours))', '[TOOL:convert(\1)]') AS t FROM qa WHERE answer IS NOT NULL)
SELECT pos, regexp_replace(t, '(?i)([A-Z]{2}-[0-9]+)', '[TOOL:lookup(\1)]') AS text FROM a""",
    "text_template": "SELECT pos, coalesce(length(answer) <= 120 AND regexp_matches(answer, '[.]$'), false) AS valid FROM qa",
    "chunk_sliding": """
WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 448.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, i::INT AS n, length(substr(text, i * 448 + 1, 512))::INT AS size, md5(substr(text, i * 448 + 1, 512)) AS fingerprint FROM d""",
    "chunk_tokens": f"""
WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 100) / 80.0))::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS n, md5(array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ')) AS fingerprint FROM e""",
    "chunk_contextual": f"""
WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 120.0)::BIGINT)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS n, md5(array_to_string(w[greatest(0, i * 120 - 20) + 1 : i * 120 + 120], ' ')) AS fingerprint FROM e""",
    "chunk_sentences": f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, s, unnest(range(0, ceil(len(s) / 3.0)::BIGINT)) AS i FROM s WHERE len(s) > 0)
SELECT doc_id, i::INT AS n, md5(array_to_string(s[i * 3 + 1 : i * 3 + 3], '. ')) AS fingerprint FROM e""",
    "chunk_paragraphs": """
WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
fold AS (
  SELECT doc_id, ps, 1 AS i, ''::VARCHAR AS open, NULL::VARCHAR AS closed, 0 AS n FROM p
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN length(open) + length(ps[i]) > 1200 AND open <> '' THEN
      CASE WHEN len(string_split(open, '. ')) > 3 THEN array_to_string(string_split(open, '. ')[-3:], '. ') || chr(10) || chr(10) || ps[i] ELSE ps[i] END
      WHEN open <> '' THEN open || chr(10) || chr(10) || ps[i] ELSE ps[i] END,
    CASE WHEN length(open) + length(ps[i]) > 1200 AND open <> '' THEN open END,
    n + (length(open) + length(ps[i]) > 1200 AND open <> '')::INT
  FROM fold WHERE i <= len(ps)),
chunks AS (
  SELECT doc_id, n - 1 AS n, closed AS c FROM fold WHERE closed IS NOT NULL
  UNION ALL SELECT doc_id, n, open FROM fold WHERE i = len(ps) + 1 AND open <> '')
SELECT doc_id, n::INT AS n, length(c)::INT AS size, md5(c) AS fingerprint FROM chunks""",
    "source_router": r"""
SELECT coalesce(CASE WHEN regexp_matches(path, '^https?://(?:www\.)?(?:youtube\.com|youtu\.be)') THEN 'youtube'
  WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) IN ('txt', 'md') THEN 'text' WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) IN ('py', 'js', 'ts', 'java') THEN 'code'
  WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) IN ('html', 'htm') THEN 'html' WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) = 'pdf' THEN 'pdf'
  WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) = 'docx' THEN 'docx' WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) = 'pptx' THEN 'pptx'
  WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) IN ('png', 'jpg', 'jpeg', 'gif', 'bmp') THEN 'image' WHEN regexp_extract(lower(path), '\.([a-z0-9]+)$', 1) IN ('wav', 'mp3', 'flac', 'm4a', 'ogg') THEN 'audio'
  WHEN path LIKE 'http%' THEN 'html' END, 'none') AS parser, count(*) AS documents FROM documents GROUP BY 1""",
    "payload_checks": "SELECT CASE WHEN ocr IS NULL THEN 'missing ocr' WHEN NOT coalesce(entropy >= 3.5, false) THEN 'low entropy' ELSE 'valid' END AS status, count(*) AS payloads FROM pdf GROUP BY 1",
}
