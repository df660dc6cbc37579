"""Building graphs, generating records and embedding nodes, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import building as B
from lodestrata.operators import embedding as M
from lodestrata.operators import generation as R
from lodestrata.operators import graph as G
from lodestrata.plans.sqltext import WIDE, clean
from lodestrata.sources import sinks
from lodestrata.tables import table


def _documents(spark, sf_dir):
    return B.document_rows(table(spark, sf_dir, "documents"))


def _chunks(spark, sf_dir):
    return B.chunk_rows(_documents(spark, sf_dir))


def build_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", "uid", "source")


def build_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", "document", "sequence", F.md5("text").alias("fingerprint"))


def build_chunk_edges(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("id", "document", "sequence")
    return B.parent_edges(chunks, "has_chunk").unionByName(B.chain_edges(chunks, "next_chunk"))


def build_facts(spark, sf_dir):
    return B.fact_rows(_chunks(spark, sf_dir))


def build_fact_edges(spark, sf_dir):
    return B.fact_edges(B.fact_rows(_chunks(spark, sf_dir)))


def build_entities(spark, sf_dir):
    return B.entity_mentions(_chunks(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("chunks"))


def build_atoms(spark, sf_dir):
    return B.atom_rows(table(spark, sf_dir, "documents")).groupBy("document", "kind").agg(F.count("*").alias("atoms"), F.sum(F.length("text")).alias("characters"))


def build_molecules(spark, sf_dir):
    return B.molecule_rows(B.atom_rows(table(spark, sf_dir, "documents"))).groupBy("molecule").agg(F.count("*").alias("atoms"))


def build_simplices(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("simplex"), F.col("l_suppkey").alias("node"))
    return B.simplex_rows(lines, "simplex")


def build_missing_members(spark, sf_dir):
    """Ends of edges that no node has."""
    edges = table(spark, sf_dir, "edges")
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return B.valid_ids(ends, table(spark, sf_dir, "nodes").select("id").distinct(), "node")


def pipeline_steps(spark, sf_dir):
    return R.pipeline_steps(spark)


def pipeline_trainings(spark, sf_dir):
    return R.pipeline_trainings(spark)


def pipeline_types_of_training(spark, sf_dir):
    return R.pipeline_trainings(spark).groupBy("training").agg(F.array_join(F.array_sort(F.collect_list("dataset_type")), ",").alias("types"))


def generate_pairs(spark, sf_dir):
    """Chunks to prompts to the stand-in model to parsed pairs."""
    chunks = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'chunk' AND length(text) > 0").select("id", "text")
    said = R.asked(chunks, "id", F.col("text"), R.template_model)
    return said.select("id", F.posexplode(R.parsed_pairs(F.col("output"))).alias("n", "p")).select("id", "n", "p.question", "p.answer")


def generate_training_file(spark, sf_dir):
    """The whole way: chunks, pairs, exact deduplication, chat lines; counts and sizes of the lines."""
    pairs, _ = R.run_steps(
        generate_pairs(spark, sf_dir),
        [("CURATE", lambda p: p.where(F.length("answer") > 20)), ("DEDUP", lambda p: p.groupBy("question", "answer").agg(F.min("id").alias("id"))), ("SAVE", lambda p: sinks.chat(p, "id", sinks.CHATML_SYSTEM))],
    )
    return pairs.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


def parse_pairs(spark, sf_dir):
    """Pairs written as a model writes them, with line ends and a trailing comma, and read again."""
    rows = table(spark, sf_dir, "qa").where("question IS NOT NULL AND answer IS NOT NULL")
    text = F.concat(F.lit("Sure:\n[\n  "), F.to_json(F.struct("question", "answer")), F.lit(",\n]\nBye"))
    return rows.select("pos", F.explode(R.parsed_pairs(text)).alias("p")).select("pos", "p.question", "p.answer")


def parse_ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "qa").where("rating IS NOT NULL AND NOT isnan(rating)")
    text = F.concat(F.lit("Rating:\n{\n \"rating\": "), F.col("rating").cast("string"), F.lit("\n}\n"))
    return rows.select("pos", R.parsed_rating(text).alias("rating"))


def parse_json(spark, sf_dir):
    text = F.concat(F.lit("Result ```json\n"), F.col("props"), F.lit("\n``` end"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(R.extracted_json(text), "$.k").cast("int").alias("k"))


def executed_tools(spark, sf_dir):
    from lodestrata.functions.text import first_marked

    marked = first_marked(F.coalesce("answer", F.lit("")), r"[0-9]+ (?:litres|hours)", "double")
    rows = table(spark, sf_dir, "qa").select("pos", marked.alias("marked"))
    return R.executed_tools(rows, "pos", "marked", {"double": lambda x: f"{int(x.split()[0]) * 2} {x.split()[1]}"})


def masked_names(spark, sf_dir):
    """Names masked and unmasked again: how many come back the same."""
    rows = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("author IS NOT NULL").select("id", "author")
    back = R.masked_fields(R.masked_fields(rows, ["author"], "secret"), ["author"], "secret", undo=True)
    return rows.join(back.withColumnRenamed("author", "again"), "id").agg(F.count_if(F.col("author") == F.col("again")).alias("same"), F.count("*").alias("names"))


def conversation_turns(spark, sf_dir):
    return R.conversation_turns(table(spark, sf_dir, "qa"), "chunk", "pos")


def preference_pairs(spark, sf_dir):
    return R.preference_pairs(table(spark, sf_dir, "qa"))


def ranked_answers(spark, sf_dir):
    return R.ranked_answers(table(spark, sf_dir, "qa"))


def embed_walks(spark, sf_dir):
    return M.random_walks(table(spark, sf_dir, "edges"), 5, 2).select("walk", F.array_join("path", ">").alias("path"))


def embed_node2vec(spark, sf_dir):
    return M.node2vec(table(spark, sf_dir, "edges"), 8, 5, 2).select("node", F.size("vec").alias("dimensions"))


def embed_clusters(spark, sf_dir):
    return M.clusters(table(spark, sf_dir, "embeddings"), "embedding", 10).groupBy("cluster").agg(F.count("*").alias("n"))


def embed_principal(spark, sf_dir):
    return M.principal(table(spark, sf_dir, "embeddings"), "embedding", 4).select("vec_id", F.size("reduced").alias("dimensions"))


def embed_contrastive_loss(spark, sf_dir):
    """Every fiftieth vector as an anchor: its first half against the second half of all."""
    rows = table(spark, sf_dir, "embeddings")
    one, other = rows.where("vec_id % 50 = 0").select("vec_id", F.slice("embedding", 1, 32).alias("v")), rows.select("vec_id", F.slice("embedding", 33, 32).alias("v"))
    return M.contrastive_loss(one, other, "vec_id", "v").select(F.round("loss", 5).alias("loss"))


def embed_neighbour_means(spark, sf_dir):
    features = G.distinct_nodes(table(spark, sf_dir, "nodes")).select(F.col("id").alias("node"), F.lit(0).alias("d"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("x"))
    return M.neighbour_means(table(spark, sf_dir, "edges"), features, 1).select("node", F.round("x", 6).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (
        build_documents, build_chunks, build_chunk_edges, build_facts, build_fact_edges, build_entities, build_atoms, build_molecules, build_simplices, build_missing_members, pipeline_steps, pipeline_trainings,
        pipeline_types_of_training, generate_pairs, generate_training_file, parse_pairs, parse_ratings, parse_json, executed_tools, masked_names, conversation_turns, preference_pairs, ranked_answers, embed_walks,
        embed_node2vec, embed_clusters, embed_principal, embed_contrastive_loss, embed_neighbour_means,
    )
}

_C = f"""d AS (SELECT 'd' || doc_id AS id, {clean("coalesce(text, '')")} AS text, source FROM documents),
c AS (SELECT id || '_chunk_' || i AS id, id AS document, i::INT AS sequence, substr(text, i * 448 + 1, 512) AS text FROM (SELECT id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 448.0))::BIGINT + 1)) AS i FROM d WHERE length(text) > 0))"""
_P1, _P2 = r"([A-Za-z ]+) is (?:the )?([A-Za-z ]+)\.", r"([A-Za-z ]+) was born in ([A-Za-z ]+)\."
_F = rf"""{_C}, fl AS (SELECT id AS chunk, list_concat(
  list_transform(list_zip(regexp_extract_all(text, '{_P1}', 1), regexp_extract_all(text, '{_P1}', 2)), lambda p: {{'s': trim(p[1]), 'p': 'is', 'o': trim(p[2])}}),
  list_transform(list_zip(regexp_extract_all(text, '{_P2}', 1), regexp_extract_all(text, '{_P2}', 2)), lambda p: {{'s': trim(p[1]), 'p': 'born_in', 'o': trim(p[2])}})) AS fs FROM c),
fe AS (SELECT chunk, fs, unnest(range(1, len(fs) + 1)) AS n FROM fl), f AS (SELECT chunk || '_fact_' || (n - 1) AS id, chunk, fs[n].s AS subject, fs[n].p AS predicate, fs[n].o AS object FROM fe)"""
_A = r"""l AS (SELECT 'd' || doc_id AS document, list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda s: regexp_matches(s, '[^ \t\r\x{a0}]')) AS ls FROM documents),
a AS (SELECT document, n - 1 AS sequence, ls[n] AS text FROM (SELECT document, ls, unnest(range(1, len(ls) + 1)) AS n FROM l)),
k AS (SELECT document, sequence, text, CASE WHEN regexp_matches(text, '^\s*[-*•]') THEN 'ListItem' WHEN length(text) < 60 AND NOT regexp_matches(text, '[.!?]\s*$') THEN 'Title' ELSE 'NarrativeText' END AS kind FROM a)"""
_RATED = "r AS (SELECT question, answer, max(rating) AS rating FROM qa WHERE rating IS NOT NULL AND NOT isnan(rating) AND answer IS NOT NULL AND question IS NOT NULL GROUP BY 1, 2)"
_STEPS = ", ".join(f"('{k}', {i}, '{s}')" for k, (steps, _) in R.PIPELINES.items() for i, s in enumerate(steps))
_TRAININGS = ", ".join(f"('{k}', '{t}')" for k, (_, ts) in R.PIPELINES.items() for t in ts)

ORACLES = {
    "build_documents": f"WITH {_C} SELECT id, sha1(text) AS uid, source FROM d",
    "build_chunks": f"WITH {_C} SELECT id, document, sequence, md5(text) AS fingerprint FROM c",
    "build_chunk_edges": f"WITH {_C} SELECT document AS src, id AS dst, 'has_chunk' AS relation, sequence FROM c UNION ALL SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY document ORDER BY sequence) AS n, 'next_chunk', NULL FROM c) WHERE n IS NOT NULL",
    "build_facts": f"WITH {_F} SELECT * FROM f",
    "build_fact_edges": f"WITH {_F} SELECT chunk AS src, id AS dst, 'has_fact' AS relation FROM f UNION ALL SELECT id, subject, 'subject' FROM f UNION ALL SELECT id, object, 'object' FROM f UNION ALL SELECT DISTINCT subject, object, predicate FROM f",
    "build_entities": rf"WITH {_C}, e AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(text, '{WIDE}', '_', 'g'), '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b', 1)) AS entity FROM c) SELECT entity, count(*) AS chunks FROM e GROUP BY 1",
    "build_atoms": f"WITH {_A} SELECT document, kind, count(*) AS atoms, sum(length(text))::BIGINT AS characters FROM k GROUP BY 1, 2",
    "build_molecules": f"WITH {_A}, m AS (SELECT document || '_molecule_' || sum((kind = 'Title')::INT) OVER (PARTITION BY document ORDER BY sequence)::BIGINT AS molecule FROM k) SELECT molecule, count(*) AS atoms FROM m GROUP BY 1",
    "build_simplices": "SELECT l_orderkey AS simplex, count(DISTINCT l_suppkey) - 1 AS dimension FROM lineitem GROUP BY 1",
    "build_missing_members": "SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT id FROM nodes)",
    "pipeline_steps": f"SELECT * FROM (VALUES {_STEPS}) t(dataset_type, step_no, step)",
    "pipeline_trainings": f"SELECT * FROM (VALUES {_TRAININGS}) t(dataset_type, training)",
    "pipeline_types_of_training": f"SELECT training, string_agg(dataset_type, ',' ORDER BY dataset_type) AS types FROM (VALUES {_TRAININGS}) t(dataset_type, training) GROUP BY 1",
    "parse_pairs": "SELECT pos, question, answer FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL",
    "parse_ratings": "SELECT pos, rating FROM qa WHERE rating IS NOT NULL AND NOT isnan(rating)",
    "parse_json": "SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events",
    "masked_names": "SELECT count(*) AS same, count(*) AS names FROM (SELECT id FROM nodes GROUP BY id HAVING arg_min({'v': author}, pos).v IS NOT NULL)",
    "conversation_turns": "WITH n AS (SELECT chunk, question, answer, row_number() OVER (PARTITION BY chunk ORDER BY pos) - 1 AS n FROM qa WHERE chunk IS NOT NULL) SELECT chunk, (n * 2)::INT AS turn, 'user' AS role, coalesce(question, '') AS content FROM n UNION ALL SELECT chunk, (n * 2 + 1)::INT, 'assistant', coalesce(answer, '') FROM n",
    "preference_pairs": f"WITH {_RATED.replace('max(rating) AS rating', 'max(rating) AS rating, min(rating) AS low')}, x AS (SELECT question, arg_max(answer, (rating, answer)) AS chosen, arg_max(answer, (-low, answer)) AS rejected FROM r GROUP BY 1) SELECT * FROM x WHERE chosen <> rejected",
    "ranked_answers": f"WITH {_RATED} SELECT question, answer, row_number() OVER (PARTITION BY question ORDER BY rating DESC, answer)::INT AS rank FROM r",
    "embed_contrastive_loss": "WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings), s AS (SELECT x.vec_id AS k, y.vec_id AS o, list_cosine_similarity(x.a, y.b) / 0.1 AS s FROM e x, e y WHERE x.vec_id % 50 = 0) SELECT round(avg(z - own), 5) AS loss FROM (SELECT k, ln(sum(exp(s))) AS z, max(CASE WHEN k = o THEN s END) AS own FROM s GROUP BY 1)",
    "embed_neighbour_means": "WITH p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst), b AS (SELECT u AS node, v AS near FROM p UNION ALL SELECT v, u FROM p), f AS (SELECT id AS node, coalesce(length(arg_min({'v': text}, pos).v), 0)::DOUBLE AS x FROM nodes GROUP BY id), m AS (SELECT b.node, avg(x) AS m FROM b JOIN f ON f.node = b.near GROUP BY 1) SELECT f.node, round((x + coalesce(m, x)) / 2, 6) AS x FROM f LEFT JOIN m ON m.node = f.node",
}
