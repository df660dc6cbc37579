"""Export formats: rows of (key, line), and writers that never gather them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The system turns of the two chat formats, and the end mark of training texts.
CHATML_SYSTEM = "You are a helpful AI assistant."
FINE_TUNING_SYSTEM = "You are a helpful assistant."
END_MARK = "<eos>"


def messages(question: Column, answer: Column, system: str) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", answer))


def jsonl(rows: DataFrame, key: str) -> DataFrame:
    """One object a row; null fields are left out."""
    return rows.select(key, F.to_json(F.struct("*")).alias("line"))


def alpaca(pairs: DataFrame, key: str) -> DataFrame:
    record = F.struct(F.coalesce("question", F.lit("")).alias("instruction"), F.lit("").alias("input"), F.coalesce("answer", F.lit("")).alias("output"))
    return pairs.select(key, F.to_json(record).alias("line"))


def chat(pairs: DataFrame, key: str, system: str) -> DataFrame:
    return pairs.select(key, F.to_json(F.struct(messages(F.col("question"), F.col("answer"), system).alias("messages"))).alias("line"))


def sft(pairs: DataFrame, key: str, end: str = END_MARK) -> DataFrame:
    prompt, reply = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    return pairs.select(key, prompt.alias("prompt"), F.concat(prompt, F.lit("\n"), reply, F.lit(end)).alias("text"))


def preference(rows: DataFrame, key: str, end: str = END_MARK) -> DataFrame:
    closed = lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit(end)).alias(c)
    return rows.select(key, F.coalesce("prompt", F.lit("")).alias("prompt"), closed("chosen"), closed("rejected"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_partitioned(rows: DataFrame, root: str, owner: str, kind: str, mode: str = "append") -> None:
    """JSON lines below ``org_id=…/kind=…/date=…``, sorted by owner and kind within files."""
    marked = rows.withColumns({"org_id": F.lit(owner), "kind": F.lit(kind), "date": F.date_format(F.current_date(), "yyyy-MM-dd")})
    marked.write.mode(mode).partitionBy("org_id", "kind", "date").json(root)


def write_vectors(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(node_id, space, vec, version) as parquet, in ranges of space and node for pruned reads."""
    rows.repartitionByRange("space", "node_id").sortWithinPartitions("space", "node_id").write.mode(mode).parquet(path)
