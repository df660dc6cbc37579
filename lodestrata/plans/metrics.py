"""Gates, payload checks, quantisation, curvature and step checks over whole tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vectors as V
from lodestrata.operators import elements as L
from lodestrata.operators import generation as R
from lodestrata.operators import graph as G
from lodestrata.operators import metrics as M
from lodestrata.operators import search as S
from lodestrata.operators.analysis import wasserstein
from lodestrata.plans.analysis import _dist
from lodestrata.plans.elements import _LF
from lodestrata.plans.search import _V, _dot, _norm
from lodestrata.plans.sqltext import clean
from lodestrata.tables import share_package, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


def gate_texts(spark, sf_dir):
    """Documents by what stops them: language, signal (characters a word), toxicity (share of capitals)."""
    text = F.col("text")
    signal = F.length(text) / F.greatest(F.size(T.words(text)), F.lit(1))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.length(text), F.lit(1))
    language = F.lower(F.substring("lang", 1, 2)).isin("en", "fr", "de", "es")
    return table(spark, sf_dir, "documents").select("doc_id", M.gate_status(language, signal, F.lit(5.0), capitals, 0.1).alias("status"))


def gate_images(spark, sf_dir):
    """Payload checks of images, over parts as if they were pictures: size and price as sides, quantity as blur."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20).alias("width"), F.floor("p_retailprice").alias("height"), (F.col("p_size") / 100.0).alias("blur"))
    return rows.select("id", F.array_join(M.image_faults(F.col("width"), F.col("height"), F.col("blur")), ",").alias("faults"))


def gate_audio(spark, sf_dir):
    """Payload checks of sounds, over events as if they were recordings."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 300).alias("duration"), F.col("value").alias("snr"))
    return rows.select("event_id", F.array_join(M.audio_faults(F.col("duration"), F.col("snr")), ",").alias("faults"))


def gate_drift(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", M.drift_level(value, 20.0, 40.0).alias("level"), (value >= 40.0).alias("retrain"))


def gate_signal(spark, sf_dir):
    """Events of at least the mean plus one deviation of their type."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    limits = rows.groupBy("event_type").agg((F.avg("value") + F.stddev_pop("value")).alias("least"))
    return rows.join(F.broadcast(limits), "event_type").where("value >= least").select("event_id")


def measure_signal_deviation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.round(F.coalesce(F.stddev_pop("value"), F.lit(0.0)), 6).alias("deviation"))


def measure_slow_users(spark, sf_dir):
    """Users whose 99th percentile of the second half of the events is more than a tenth above that of the first half: a canary to roll back."""
    from lodestrata.operators.measures import indexed_percentile

    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    half = rows.agg(F.floor(F.max("event_id") / 2).alias("m"))
    halves = rows.crossJoin(F.broadcast(half)).select(F.concat_ws(":", "user_id", (F.col("event_id") > F.col("m")).cast("int")).alias("key"), "value")
    top = indexed_percentile(halves, "key", "value", 0.99).select(F.split("key", ":")[0].cast("bigint").alias("user_id"), F.split("key", ":")[1].alias("half"), "value")
    both = top.groupBy("user_id").agg(F.max(F.when(F.col("half") == "0", F.col("value"))).alias("before"), F.max(F.when(F.col("half") == "1", F.col("value"))).alias("after"))
    return both.where("after > 1.1 * before").select("user_id", "before", "after")


def measure_cache_hits(spark, sf_dir):
    """How many chunk nodes find their vector, of those that ask."""
    asked = table(spark, sf_dir, "nodes").where(F.lower("type") == "chunk").select("id").distinct()
    held = table(spark, sf_dir, "embedding").where("space = 'embedding' AND size(vec) > 0").select(F.col("node_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return asked.join(held, "id", "left").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("rate"))


def vector_lookups(spark, sf_dir):
    """The stored eight-bit vector of each chunk node, read back; null where there is none."""
    asked = table(spark, sf_dir, "nodes").where(F.lower("type") == "chunk").select(F.col("id").alias("node_id")).distinct()
    held = table(spark, sf_dir, "embedding").where("space = 'embedding' AND size(vec) = 64").where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    held = held.groupBy("node_id").agg(F.min("vec").alias("vec")).select("node_id", V.dequantized(V.quantized(F.col("vec"))).alias("v"))
    return asked.join(held, "node_id", "left").select("node_id", F.round(V.norm(F.col("v")), 4).alias("norm"))


def measure_triangle_threshold(spark, sf_dir):
    """From the relations' frequencies as weights."""
    rows = table(spark, sf_dir, "edges").groupBy("src").agg(F.count("*").alias("weight"))
    return M.triangle_threshold(rows, "weight")


def measure_invariants(spark, sf_dir):
    return M.invariants(table(spark, sf_dir, "edges")).select(F.round("entropy", 6).alias("entropy"), "nodes", "edges", "triangles")


def measure_governance(spark, sf_dir):
    """Correlation of two views, mean hyperbolic radius and bias of norms, in one row."""
    rows = _vectors(spark, sf_dir)
    radius = rows.agg(F.avg(V.hyperbolic_radius(F.transform("v", lambda x: x / 4))).alias("radius"))
    bias = wasserstein(rows.select((F.col("label") % 2).alias("g"), F.round(V.norm(F.col("v")), 6).alias("x")), "g", "x").agg(F.max("distance").alias("bias"))
    return radius.crossJoin(bias).select(F.round("radius", 6).alias("radius"), F.round("bias", 6).alias("bias"))


def measure_covering_motifs(spark, sf_dir):
    """Documents with their chunks as motifs, by the edges that none before them covers."""
    edges = G.distinct_edges(table(spark, sf_dir, "edges"))
    owner = L.first_parent(edges, "has_chunk").select(F.col("dst").alias("src"), F.col("src").alias("motif"))
    own = edges.where("relation = 'has_chunk'").select(F.col("src").alias("motif"), "src", "dst")
    chain = edges.where("relation = 'next_chunk'").join(owner, "src").select("motif", "src", "dst")
    return M.covering_motifs(edges, own.unionByName(chain))


def vector_exponential(spark, sf_dir):
    """The radius of each vector's image in the ball, and how far the way back misses."""
    there = M.exponential_map(F.col("v"))
    rows = _vectors(spark, sf_dir).withColumn("y", there)
    return rows.select("vec_id", F.round(V.norm(F.col("y")), 6).alias("radius"), F.round(V.squared_distance(F.col("v"), M.logarithmic_map(F.col("y"))), 6).alias("miss"))


def vector_recentred(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: x / 4).alias("v"))
    return M.recentred(rows, "vec_id", "v").select("vec_id", F.round(V.norm(F.col("v")), 6).alias("radius"))


def vector_merged(spark, sf_dir):
    """Every vector with that of the next number added, where there is one."""
    rows = _vectors(spark, sf_dir)
    delta = rows.select((F.col("vec_id") - 1).alias("vec_id"), "v")
    return M.merged_weights(rows, delta, "vec_id", "v").select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


def vector_scales(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(M.grouped_scales(F.col("v"), 16)).alias("run", "scale")).select("vec_id", "run", F.round("scale", 9).alias("scale"))


def vector_four_bit(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.array_join(M.four_bit(F.col("v"), 16), ",").alias("q"))


def vector_normal_float(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.array_join(M.normal_float(F.col("v"), 16), ",").alias("q"))


def topology_minhash(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return M.minhash_of_diagram(rows.select("event_type", F.col("value").alias("birth"), (F.col("value") + F.pmod("event_id", F.lit(7)) + 1).alias("death")), "event_type")


def export_classification(spark, sf_dir):
    """Events as texts with a label; 0 falls back to the user's number."""
    label = F.floor(F.col("value") / 20).cast("int")
    return table(spark, sf_dir, "events").select("event_id", M.classification_line(F.col("event_type"), label, F.col("user_id").cast("int"), "<eos>").alias("line"))


def export_prompts_alpaca(spark, sf_dir):
    """Prompts of the graph as instructions, the answers left empty."""
    rows = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'chunk' AND text IS NOT NULL")
    return rows.select("id", F.to_json(F.struct(F.col("text").alias("instruction"), F.lit("").alias("input"), F.lit("").alias("output"))).alias("line")).select("id", F.md5("line").alias("fingerprint"))


def measure_alias_reward(spark, sf_dir):
    """How many of the names of each chunk are entities that it mentions, as they stand or by the surname as an alias."""
    nodes = G.distinct_nodes(table(spark, sf_dir, "nodes"))
    found = nodes.where("type = 'chunk'").select(F.col("id").alias("key"), F.explode("entities").alias("name"))
    entities = nodes.where("type = 'entity' AND text IS NOT NULL").select(F.col("id").alias("entity"), F.col("text").alias("name"))
    truth = G.mentions(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")).join(entities, "entity").select(F.col("chunk").alias("key"), "name")
    aliases = entities.select(F.element_at(F.split("name", " "), -1).alias("alias"), "name")
    return M.matched_share(found, truth, "key", "name", aliases).select("key", F.round("reward", 6).alias("reward"))


def measure_distortion(spark, sf_dir):
    """How far the norm of the first half of each vector is from that of the whole, as a share."""
    half = V.norm(F.slice("v", 1, 32))
    return _vectors(spark, sf_dir).select("vec_id", F.round(1 - half / V.norm(F.col("v")), 6).alias("distortion"))


def pipeline_missing_fields(spark, sf_dir):
    """Fields that the table of pairs lacks for each step with a rule."""
    columns = table(spark, sf_dir, "qa").columns
    return spark.createDataFrame([(s, ",".join(M.missing_fields(s, columns))) for s in M.STEP_FIELDS], "step string, missing string")


def generate_summaries(spark, sf_dir):
    """A summary of each document as the stand-in model writes it: what the text says about its first words."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    out = R.asked(docs, "doc_id", F.col("text"), R.template_model)
    return out.select("doc_id", F.explode(R.parsed_pairs(F.col("output"))).alias("p")).select("doc_id", F.md5("p.question").alias("question"), F.md5("p.answer").alias("answer"))


def generate_reasoning(spark, sf_dir):
    """Pairs with a chain of reasoning: the sentences of the answer, numbered, before it."""
    sentences = F.filter(F.transform(F.split("answer", r"[.!?]"), lambda s: F.trim(s)), lambda s: s != "")
    steps = F.array_join(F.transform(sentences, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), " ")
    return table(spark, sf_dir, "qa").where("question IS NOT NULL AND answer IS NOT NULL").select("pos", F.concat(steps, F.lit(" => "), "answer").alias("reasoned"))


def generate_graph_questions(spark, sf_dir):
    """A question for each fact of the graph, answered by its object."""
    facts = L.triplet_facts(L.line_chunks(L.section_lines(table(spark, sf_dir, "documents"))))
    return facts.select("id", F.concat(F.lit("What "), "predicate", F.lit(" the "), "subject", F.lit("?")).alias("question"), F.col("object").alias("answer"))


def generate_checked_answers(spark, sf_dir):
    """Answers kept only where a template accepts them: at most 120 characters, ending in a point."""
    valid = (F.length("answer") <= 120) & F.rlike("answer", F.lit(r"[.]\z"))
    return table(spark, sf_dir, "qa").where(valid).select("pos")


def generate_better_with_tools(spark, sf_dir):
    """The answer with its tool call where that makes it longer, as a score that counts characters says; else as it stands."""
    marked = T.first_marked(F.col("answer"), r"[0-9]+ (?:litres|hours)", "convert")
    return table(spark, sf_dir, "qa").where("answer IS NOT NULL").select("pos", F.when(F.length(marked) > F.length("answer"), marked).otherwise(F.col("answer")).alias("text"))


def parse_lenient_pairs(spark, sf_dir):
    """Pairs read back from a model's loose notation: single quotes, bare keys, trailing commas."""
    share_package(spark)
    rows = table(spark, sf_dir, "qa").where("trim(question) <> '' AND trim(answer) <> ''")
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"[\\\"\x00-\x1f]", " "), "'", r"\\'"), F.lit("'"))
    loose = F.concat(F.lit("Sure: [{question: "), quoted("question"), F.lit(", answer: "), quoted("answer"), F.lit(",}, ] done"))

    def run(batches):
        for batch in batches:
            found = [(k, *p) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in M.lenient_pairs(t)]
            k, q, a = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(q, pa.string()), pa.array(a, pa.string())], names=["pos", "question", "answer"])

    return rows.select("pos", loose.alias("t")).mapInArrow(run, "pos bigint, question string, answer string")


def text_base_units(spark, sf_dir):
    """Answers with their quantities in base units."""
    share_package(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([M.in_base_units(t) for t in batch.column(1).to_pylist()], pa.string())], names=["pos", "text"])

    return table(spark, sf_dir, "qa").select("pos", "answer").mapInArrow(run, "pos bigint, text string")


def graph_verified_answers(spark, sf_dir):
    """Mean confidence of what each answer states: 1 for a triplet stated in a document, else 0; 0 without statements."""
    said = table(spark, sf_dir, "qa").where("answer IS NOT NULL").select("pos", F.explode_outer(T.stated_triplets(F.col("answer"))).alias("t")).select("pos", "t.subject", "t.predicate", "t.object")
    known = L.triplet_facts(L.line_chunks(L.section_lines(table(spark, sf_dir, "documents")))).select("subject", "predicate", "object").distinct().withColumn("true", F.lit(1))
    return said.join(known, ["subject", "predicate", "object"], "left").groupBy("pos").agg(F.round(F.avg(F.coalesce("true", F.lit(0))), 6).alias("confidence"))


def text_index(spark, sf_dir):
    """Terms of each chunk's tf-idf vector and its greatest weight: what is stored with the node."""
    chunks = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'chunk' AND text IS NOT NULL").select("id", "text")
    return S.tfidf(chunks, "id", "text").groupBy("id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("top"))


def topology_augmented(spark, sf_dir):
    """Vectors with the persistence of their label's norms behind them: count and total life."""
    rows = _vectors(spark, sf_dir).withColumn("n", V.norm(F.col("v")))
    lives = rows.withColumn("life", F.lead("n").over(Window.partitionBy("label").orderBy("n", "vec_id")) - F.col("n"))
    extra = lives.groupBy("label").agg(F.count("life").alias("features"), F.coalesce(F.sum("life"), F.lit(0.0)).alias("total"))
    joined = rows.join(F.broadcast(extra), "label")
    return joined.select("vec_id", F.size(F.concat("v", F.array(F.col("features").cast("double"), F.col("total")))).alias("dimensions"), F.round("total", 6).alias("total"))


def graph_path_penalties(spark, sf_dir):
    """The best single stop between each fiftieth vector and the next, stops of the start's label costing 0.5 more."""
    rows = _vectors(spark, sf_dir).select("vec_id", "label", F.transform("v", lambda x: x / 4).alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("start"), F.col("label").alias("own"), F.col("v").alias("s"))
    goals = rows.select((F.col("vec_id") - 1).alias("start"), F.col("vec_id").alias("goal"), F.col("v").alias("g"))
    met = rows.crossJoin(F.broadcast(asked.join(goals, "start"))).where("vec_id <> start AND vec_id <> goal")
    total = V.poincare_distance(F.col("s"), F.col("v")) + V.poincare_distance(F.col("v"), F.col("g")) + F.when(F.col("label") == F.col("own"), 0.5).otherwise(0.0)
    best = met.groupBy("start", "goal").agg(F.min_by(F.struct("vec_id", total.alias("t")), F.struct(F.round(total, 9), "vec_id")).alias("r"))
    return best.select("start", "goal", F.col("r.vec_id").alias("hop"), F.round("r.t", 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        gate_texts, gate_images, gate_audio, gate_drift, gate_signal, measure_signal_deviation, measure_slow_users, measure_cache_hits, vector_lookups, measure_triangle_threshold, measure_invariants, measure_governance,
        measure_covering_motifs, vector_exponential, vector_recentred, vector_merged, vector_scales, vector_four_bit, vector_normal_float, topology_minhash, export_classification, export_prompts_alpaca, measure_alias_reward,
        measure_distortion, pipeline_missing_fields, generate_summaries, generate_reasoning, generate_graph_questions, generate_checked_answers, generate_better_with_tools, parse_lenient_pairs, text_base_units,
        graph_verified_answers, text_index, topology_augmented, graph_path_penalties,
    )
}

_DN = "dn AS (SELECT id, min(pos) AS pos, arg_min({'v': lower(type)}, pos).v AS type, arg_min({'v': text}, pos).v AS text, arg_min({'v': entities}, pos).v AS entities FROM nodes GROUP BY id)"
_CAPS = "length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1)"
_QV = f"{_V}, s AS (SELECT *, {_norm('v')} AS n FROM v)"
_PAIRS = "p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst)"
_TRI = r"(?i)([A-Za-z_]+)\s+(is|likes|has|eats|knows|located_in|capital_of)\s+([A-Za-z_]+)"
_PART_MAX = "list_max(list_transform(part, lambda x: abs(x)))"
_PARTS = f"{_V}, r AS (SELECT vec_id, run, v[run * 16 + 1 : run * 16 + 16] AS part FROM v, range(0, 4) t(run)), m AS (SELECT vec_id, run, part, {_PART_MAX} AS m FROM r)"
_LEVELS = "[" + ", ".join(map(repr, M.NF4)) + "]::DOUBLE[]"

ORACLES = {
    "gate_texts": f"SELECT doc_id, CASE WHEN NOT coalesce(lower(substr(lang, 1, 2)) IN ('en', 'fr', 'de', 'es'), false) THEN 'language' WHEN NOT coalesce(length(text) / greatest(len(list_filter(string_split({clean('text')}, ' '), lambda w: w <> '')), 1) >= 5.0, false) THEN 'snr' WHEN coalesce({_CAPS} > 0.1, true) THEN 'toxicity' ELSE 'ok' END AS status FROM documents",
    "gate_images": "SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN NOT coalesce(p_size * 20 >= 256, false) THEN 'width' END, CASE WHEN NOT coalesce(floor(p_retailprice) >= 256, false) THEN 'height' END, CASE WHEN NOT coalesce(p_size / 100.0 <= 0.2, false) THEN 'blur_score' END], lambda x: x IS NOT NULL), ',') AS faults FROM part",
    "gate_audio": "SELECT event_id, array_to_string(list_filter([CASE WHEN NOT coalesce(user_id * 300 <= 14400, false) THEN 'duration' END, CASE WHEN NOT coalesce(value >= 10, false) THEN 'snr' END], lambda x: x IS NOT NULL), ',') AS faults FROM events",
    "gate_drift": "SELECT event_id, CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'warning' ELSE 'ok' END AS level, value >= 40 AS retrain FROM events WHERE value IS NOT NULL",
    "gate_signal": "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) + stddev_pop(value) OVER (PARTITION BY event_type) AS least FROM events WHERE value IS NOT NULL) WHERE value >= least",
    "measure_signal_deviation": "SELECT event_type, round(coalesce(stddev_pop(value), 0), 6) AS deviation FROM events GROUP BY 1",
    "measure_slow_users": "WITH h AS (SELECT user_id, event_id > (SELECT floor(max(event_id) / 2) FROM events WHERE value IS NOT NULL) AS late, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT user_id, late, l[floor(0.99::DOUBLE * (len(l) - 1))::INT + 1] AS value FROM h), b AS (SELECT user_id, max(value) FILTER (NOT late) AS before, max(value) FILTER (late) AS after FROM t GROUP BY 1) SELECT user_id, before, after FROM b WHERE after > 1.1 * before",
    "measure_cache_hits": "SELECT round(avg((id IN (SELECT node_id FROM embedding WHERE space = 'embedding' AND len(vec) > 0))::INT), 6) AS rate FROM (SELECT DISTINCT id FROM nodes WHERE lower(type) = 'chunk')",
    "vector_lookups": "WITH h AS (SELECT node_id, min(vec) AS vec FROM embedding WHERE space = 'embedding' AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1), s AS (SELECT node_id, vec::DOUBLE[] AS v, list_max(list_transform(vec, lambda x: abs(x)))::DOUBLE AS m FROM h), z AS (SELECT node_id, list_transform(v, lambda x: round_even(x / CASE WHEN m = 0 THEN 1.0 ELSE m END * 127, 0) * CASE WHEN m = 0 THEN 1.0 ELSE m END / 127) AS v FROM s) SELECT a.node_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm FROM (SELECT DISTINCT id AS node_id FROM nodes WHERE lower(type) = 'chunk') a LEFT JOIN z ON z.node_id = a.node_id",
    "measure_triangle_threshold": "WITH w AS (SELECT count(*)::DOUBLE AS w FROM edges GROUP BY src), p AS (SELECT w / (SELECT sum(w) FROM w) AS p FROM w) SELECT greatest(1, round_even(-10 * sum(p * log2(p)), 0))::INT AS threshold FROM p",
    "measure_invariants": f"WITH {_PAIRS}, d AS (SELECT count(*) AS degree FROM (SELECT u AS n FROM p UNION ALL SELECT v FROM p) GROUP BY n), h AS (SELECT count(*) / (SELECT count(*) FROM d) AS q FROM d GROUP BY degree) SELECT (SELECT round(-sum(q * log2(q)), 6) FROM h) AS entropy, (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM p) AS edges, (SELECT count(*) FROM p x JOIN p y ON y.u = x.v JOIN p z ON z.u = x.u AND z.v = y.v) AS triangles",
    "measure_governance": f"WITH {_QV}, r AS (SELECT avg(ln((1 + n / 4) / (1 - n / 4))) AS radius FROM s), g AS (SELECT label % 2 AS g, round(n, 6) AS x FROM s), t AS (SELECT g, count(*) AS t FROM g GROUP BY 1), c AS (SELECT x, sum(CASE g.g WHEN 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / t.t) AS m FROM g JOIN t ON t.g = g.g GROUP BY 1), q AS (SELECT sum(m) OVER (ORDER BY x) AS gap, lead(x) OVER (ORDER BY x) - x AS width FROM c) SELECT (SELECT round(radius, 6) FROM r) AS radius, (SELECT round(sum(abs(gap) * coalesce(width, 0)), 6) FROM q) AS bias",
    "measure_covering_motifs": f"WITH {_PAIRS}, hc AS (SELECT DISTINCT src, dst FROM edges WHERE lower(relation) = 'has_chunk'), o AS (SELECT dst, min(src) AS motif FROM hc GROUP BY 1), mo AS (SELECT src AS motif, least(src, dst) AS u, greatest(src, dst) AS v FROM hc UNION SELECT motif, least(e.src, e.dst), greatest(e.src, e.dst) FROM edges e JOIN o ON o.dst = e.src WHERE lower(relation) = 'next_chunk'), r AS (SELECT mo.* FROM mo JOIN p ON p.u = mo.u AND p.v = mo.v), z AS (SELECT motif, count(*) AS size FROM r GROUP BY 1), w AS (SELECT r.u, r.v, arg_min(r.motif, {{'s': -z.size, 'm': r.motif}}) AS motif FROM r JOIN z ON z.motif = r.motif GROUP BY 1, 2) SELECT motif, count(*) AS gain FROM w GROUP BY 1",
    "vector_exponential": f"WITH {_QV} SELECT vec_id, round((exp(2 * n) - 1) / (exp(2 * n) + 1), 6) AS radius, 0.0::DOUBLE AS miss FROM s",
    "vector_recentred": f"""WITH {_V}, b AS (SELECT vec_id, list_transform(v, lambda x: x / 4) AS v FROM v), d AS (SELECT i, avg(v[i]) AS m FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM b) GROUP BY 1), mm AS (SELECT list(-m ORDER BY i) AS m FROM d),
k AS (SELECT vec_id, {_dot('m', 'v')} AS ab, {_dot('m', 'm')} AS aa, {_dot('v', 'v')} AS bb FROM b, mm)
SELECT vec_id, round(sqrt(greatest(0, ((1 + 2 * ab + bb) ** 2 * aa + (1 - aa) ** 2 * bb + 2 * (1 + 2 * ab + bb) * (1 - aa) * ab)) / (1 + 2 * ab + aa * bb) ** 2), 6) AS radius FROM k""",
    "vector_merged": f"WITH {_V}, j AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(CASE WHEN b IS NULL THEN {_norm('a')} ELSE sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] + p[2]) * (p[1] + p[2])))) END, 6) AS norm FROM j",
    "vector_scales": f"WITH {_PARTS} SELECT vec_id, run::INT AS run, round(m / 127, 9) AS scale FROM m",
    "vector_four_bit": f"WITH {_PARTS}, q AS (SELECT vec_id, run, list_transform(part, lambda x: CASE WHEN m > 0 THEN round_even(x / m * 7, 0) ELSE 0 END::INT) AS q FROM m) SELECT vec_id, array_to_string(flatten(list(q ORDER BY run)), ',') AS q FROM q GROUP BY 1",
    "vector_normal_float": f"WITH {_PARTS}, q AS (SELECT vec_id, run, list_transform(part, lambda x: list_position(list_transform({_LEVELS}, lambda y: abs(y - x / greatest(m, 1e-12))), list_min(list_transform({_LEVELS}, lambda y: abs(y - x / greatest(m, 1e-12))))) - 1) AS q FROM m) SELECT vec_id, array_to_string(flatten(list(q ORDER BY run)), ',') AS q FROM q GROUP BY 1",
    "topology_minhash": "WITH d AS (SELECT DISTINCT event_type, format('{:.6f},{:.6f}', value, value + event_id % 7 + 1) AS p FROM events WHERE value IS NOT NULL) SELECT event_type, n::INT AS n, min(('0x' || substr(sha256(n || ':' || p), 1, 15))::BIGINT) AS value FROM d, range(0, 8) t(n) GROUP BY 1, 2",
    "export_classification": "SELECT event_id, event_type || chr(9) || coalesce(nullif(floor(value / 20)::INT, 0), user_id::INT) || '<eos>' AS line FROM events",
    "export_prompts_alpaca": f"WITH {_DN} SELECT id, md5(to_json({{'instruction': text, 'input': '', 'output': ''}})::VARCHAR) AS fingerprint FROM dn WHERE type = 'chunk' AND text IS NOT NULL",
    "measure_alias_reward": f"WITH {_DN}, f AS (SELECT DISTINCT id AS key, lower(trim(e)) AS n FROM (SELECT id, unnest(entities) AS e FROM dn WHERE type = 'chunk') WHERE e IS NOT NULL), en AS (SELECT id, lower(trim(text)) AS n, lower(string_split(text, ' ')[-1]) AS a FROM dn WHERE type = 'entity' AND text IS NOT NULL), t AS (SELECT DISTINCT src AS key, en.n FROM edges JOIN en ON en.id = dst WHERE lower(relation) = 'mentions' AND src IN (SELECT id FROM dn WHERE type = 'chunk')), h AS (SELECT f.key, f.n FROM f JOIN t ON t.key = f.key AND t.n = f.n UNION SELECT f.key, f.n FROM f JOIN en ON en.a = f.n JOIN t ON t.key = f.key AND t.n = en.n) SELECT f.key, round(count(h.n) / count(*), 6) AS reward FROM f LEFT JOIN h ON h.key = f.key AND h.n = f.n GROUP BY 1",
    "measure_distortion": f"WITH {_V} SELECT vec_id, round(1 - {_norm('v[1:32]')} / {_norm('v')}, 6) AS distortion FROM v",
    "pipeline_missing_fields": "SELECT step, missing FROM (VALUES ('GENERATE_QA', ''), ('GENERATE_COT', 'reasoning'), ('CURATE', ''), ('LABEL_PAIRS', 'chosen,rejected'), ('RANK_RESPONSES', 'answers')) v(step, missing)",
    "generate_reasoning": "WITH s AS (SELECT pos, answer, list_filter(list_transform(string_split_regex(answer, '[.!?]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL) SELECT pos, coalesce(array_to_string(list_transform(s, lambda x, i: i || '. ' || x), ' '), '') || ' => ' || answer AS reasoned FROM s",
    "generate_graph_questions": f"WITH {_LF} SELECT fact AS id, 'What ' || predicate || ' the ' || subject || '?' AS question, object AS answer FROM f",
    "generate_checked_answers": "SELECT pos FROM qa WHERE length(answer) <= 120 AND answer LIKE '%.'",
    "generate_better_with_tools": r"SELECT pos, CASE WHEN regexp_matches(answer, '(?i)[0-9]+ (?:litres|hours)') THEN regexp_replace(answer, '(?i)([0-9]+ (?:litres|hours))', '[TOOL:convert(\1)]') ELSE answer END AS text FROM qa WHERE answer IS NOT NULL",
    "parse_lenient_pairs": r"SELECT pos, regexp_replace(question, '[\\\"\x00-\x1f]', ' ', 'g') AS question, regexp_replace(answer, '[\\\"\x00-\x1f]', ' ', 'g') AS answer FROM qa WHERE trim(question, ' ') <> '' AND trim(answer, ' ') <> ''",
    "graph_verified_answers": rf"WITH {_LF}, kn AS (SELECT DISTINCT subject, predicate, object FROM f), an AS (SELECT pos, regexp_extract_all(lower(answer), '{_TRI}', 1) AS su, regexp_extract_all(lower(answer), '{_TRI}', 2) AS pr, regexp_extract_all(lower(answer), '{_TRI}', 3) AS ob FROM qa WHERE answer IS NOT NULL), u AS (SELECT pos, su[n] AS subject, pr[n] AS predicate, ob[n] AS object FROM (SELECT *, unnest(range(1, greatest(1, len(su)) + 1)) AS n FROM an)) SELECT pos, round(avg((kn.subject IS NOT NULL)::INT), 6) AS confidence FROM u LEFT JOIN kn ON kn.subject = u.subject AND kn.predicate = u.predicate AND kn.object = u.object GROUP BY 1",
    "text_index": rf"WITH {_DN}, q AS (SELECT id, text FROM dn WHERE type = 'chunk' AND text IS NOT NULL), c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '([\pL\pN\pM_]{{2,}})', 1)) AS term FROM q) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT id, tf * (ln((1 + (SELECT count(*) FROM q)) / (1 + df)) + 1) AS w FROM c JOIN d ON d.term = c.term) SELECT id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM w GROUP BY 1",
    "topology_augmented": f"WITH {_QV}, l AS (SELECT *, lead(n) OVER (PARTITION BY label ORDER BY n, vec_id) - n AS life FROM s), e AS (SELECT label, coalesce(sum(life), 0) AS total FROM l GROUP BY 1) SELECT vec_id, (len(v) + 2)::INT AS dimensions, round(total, 6) AS total FROM s JOIN e ON e.label = s.label",
    "graph_path_penalties": f"WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / 4) AS v FROM embeddings), m AS (SELECT s.vec_id AS start, g.vec_id AS goal, k.vec_id AS hop, {_dist('s.v', 'k.v')} + {_dist('k.v', 'g.v')} + CASE WHEN k.label = s.label THEN 0.5 ELSE 0 END AS total FROM v s JOIN v g ON s.vec_id % 50 = 0 AND g.vec_id = s.vec_id + 1 JOIN v k ON k.vec_id NOT IN (s.vec_id, g.vec_id)) SELECT start, goal, hop, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY round(total, 9), hop) AS n FROM m) WHERE n = 1",
}
