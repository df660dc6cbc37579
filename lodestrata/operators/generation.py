"""Records for training: pluggable model calls, parsers of their output, and the pipelines that order the steps.

A model is any ``batch of prompts -> batch of texts`` function; ``template_model`` is a deterministic stand-in
that needs no network, so pipelines run and repeat anywhere.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from itertools import cycle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.tables import share_package

Model = Callable[[list[str]], list[str]]

# The steps of each kind of dataset and the trainings it serves.
_KG = ("INGEST", "TO_KG", "VERIFY_THRESHOLDS", "KG_CLEANUP")
_ALL = ("SFT", "DPO", "ORPO", "DPO_SFT", "PPO", "RRHF", "RLAIF", "GRPO")
PIPELINES = {
    "qa": ((*_KG, "GENERATE_QA", "CURATE", "SAVE"), _ALL),
    "cot": ((*_KG, "GENERATE_COT", "CURATE", "SAVE"), ("SFT", "DPO", "ORPO", "DPO_SFT", "RRHF")),
    "vqa": ((*_KG, "GENERATE_VQA", "CURATE", "SAVE"), ("SFT",)),
    "text": (("INGEST", "TO_KG", "SAVE"), ("CPT",)),
    "kg": ((*_KG, "GENERATE_FROM_KG", "CURATE", "SAVE"), _ALL),
    "pref_pair": ((*_KG, "GENERATE_CANDIDATES", "LABEL_PAIRS", "SAVE"), ("PPO", "DPO", "ORPO", "DPO_SFT", "RLAIF")),
    "pref_list": ((*_KG, "GENERATE_CANDIDATES", "RANK_RESPONSES", "SAVE"), ("GRPO", "RRHF")),
    "tool": ((*_KG, "GENERATE_TOOL_CALL", "CURATE", "SAVE"), _ALL),
    "conversation": ((*_KG, "GENERATE_CONVERSATION", "CURATE", "SAVE"), _ALL),
    "multi_tool": ((*_KG, "GENERATE_MULTI_TOOL", "CURATE", "SAVE"), _ALL),
}


def pipeline_steps(spark) -> DataFrame:
    return spark.createDataFrame([(kind, i, step) for kind, (steps, _) in PIPELINES.items() for i, step in enumerate(steps)], "dataset_type string, step_no int, step string")


def pipeline_trainings(spark) -> DataFrame:
    return spark.createDataFrame([(kind, t) for kind, (_, trainings) in PIPELINES.items() for t in trainings], "dataset_type string, training string")


def run_steps(start: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[str]]:
    """The steps in order over a table; what ran, for the event log.  Nothing is computed until the result is."""
    log = []
    for name, step in steps:
        start = step(start)
        log.append(name)
    return start, log


def asked(rows: DataFrame, key: str, prompt: Column, model: Model) -> DataFrame:
    """(``key``, ``output``): the model's text for each prompt; answers stay with their key."""
    share_package(rows.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(batch.column(1).to_pylist()), pa.string())], names=[key, "output"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.coalesce(prompt, F.lit("")).alias("prompt")).mapInArrow(run, f"{key} {kind}, output string")


def template_model(prompts: list[str]) -> list[str]:
    """A question and an answer as a model would write them, made of the prompt's first sentence."""
    import json

    out = []
    for prompt in prompts:
        first = re.split(r"(?<=[.!?])\s", prompt.strip(), maxsplit=1)[0][:200]
        out.append("Here you are:\n" + json.dumps([{"question": f"What does the text say about {' '.join(first.split()[:3])}?", "answer": first}], ensure_ascii=False) + "\nDone.")
    return out


def parsed_pairs(output: Column) -> Column:
    """Pairs in a model's text: from the first ``[`` to the last ``]``, line ends and trailing commas mended."""
    body = F.regexp_extract(output, r"(?s)(\[.*\])", 1)
    mended = F.regexp_replace(F.regexp_replace(body, r"\n\s*|\r\s*", " "), r",(\s*[}\]])", "$1")
    pairs = F.from_json(mended, "array<struct<question: string, answer: string>>")
    return F.filter(F.coalesce(pairs, F.array().cast("array<struct<question: string, answer: string>>")), lambda p: p["question"].isNotNull() & p["answer"].isNotNull())


def parsed_rating(output: Column) -> Column:
    """The rating of a model's object, from the first ``{`` to the last ``}``; null where there is none, never a default."""
    body = F.regexp_replace(F.regexp_extract(output, r"(?s)(\{.*\})", 1), r"\s*\n\s*", " ")
    return F.from_json(body, "struct<rating: double>")["rating"]


def extracted_json(text: Column) -> Column:
    """The JSON in a text: the whole of it, a fenced block, or from the first brace to the last; null if none parses."""
    whole = F.trim(text)
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    greedy = F.regexp_extract(text, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1)
    valid = lambda c: F.when((c != "") & F.get_json_object(c, "$").isNotNull(), c)
    return F.coalesce(F.when(F.rlike(whole, F.lit(r"(?s)\A[\[{].*[\]}]\z")), valid(whole)), valid(fenced), valid(greedy))


def executed_tools(rows: DataFrame, key: str, text: str, tools: dict[str, Callable[[str], str]]) -> DataFrame:
    """(``key``, ``text``) with ``[TOOL:name(x)]`` replaced by the tool's output; unknown tools and failures stay."""
    share_package(rows.sparkSession)
    marker = re.compile(r"\[TOOL:(\w+)\((.*?)\)\]")

    def call(found):
        try:
            return str(tools[found[1]](found[2]))
        except Exception:  # noqa: BLE001  a failing tool leaves its marker
            return found[0]

    def run(batches):
        for batch in batches:
            texts = [None if t is None else marker.sub(call, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, text string")


def xor_text(text: str, secret: str) -> str:
    return base64.urlsafe_b64encode(bytes(a ^ b for a, b in zip(text.encode(), cycle(secret.encode())))).decode()


def unxor_text(token: str, secret: str) -> str:
    return bytes(a ^ b for a, b in zip(base64.urlsafe_b64decode(token), cycle(secret.encode()))).decode()


def masked_fields(rows: DataFrame, fields: list[str], secret: str, undo: bool = False) -> DataFrame:
    """``rows`` with the named text fields masked (or unmasked); nulls stay null."""
    share_package(rows.sparkSession)
    work = unxor_text if undo else xor_text
    names = rows.columns

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            for f in fields:
                i = names.index(f)
                columns[i] = pa.array([None if v is None else work(v, secret) for v in columns[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def conversation_turns(pairs: DataFrame, group: str, order: str) -> DataFrame:
    """(``group``, ``turn``, ``role``, ``content``): the pairs of a group as one conversation, a row a turn, so that no group gathers in a row."""
    numbered = pairs.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    said = F.array(F.struct(F.lit(0).alias("i"), F.lit("user").alias("role"), F.coalesce("question", F.lit("")).alias("content")), F.struct(F.lit(1).alias("i"), F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("content")))
    return numbered.select(group, "_n", F.explode(said).alias("m")).select(group, (F.col("_n") * 2 + F.col("m.i")).alias("turn"), "m.role", "m.content")


def preference_pairs(pairs: DataFrame, rating: str = "rating") -> DataFrame:
    """(``question``, ``chosen``, ``rejected``): best and worst rated answers of the questions with different ones."""
    rated = pairs.where(F.col(rating).isNotNull() & ~F.isnan(rating) & F.col("answer").isNotNull() & F.col("question").isNotNull())
    best, worst = F.struct(F.col(rating), F.col("answer")), F.struct(-F.col(rating), F.col("answer"))
    found = rated.groupBy("question").agg(F.max_by("answer", best).alias("chosen"), F.max_by("answer", worst).alias("rejected"))
    return found.where("chosen <> rejected")


def ranked_answers(pairs: DataFrame, rating: str = "rating") -> DataFrame:
    """(``question``, ``answer``, ``rank``): distinct answers of each question, best rated first."""
    rated = pairs.where(F.col(rating).isNotNull() & ~F.isnan(rating) & F.col("answer").isNotNull() & F.col("question").isNotNull()).groupBy("question", "answer").agg(F.max(rating).alias("rating"))
    return rated.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("rating"), "answer"))).select("question", "answer", "rank")
