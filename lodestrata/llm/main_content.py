"""Problem 7: the main body of web pages, line by line.

The text of a page has no markup, so its tree is read off its lines: the body holds blocks, a block is a stretch of lines between
walls, and lines are the leaves.  Walls are what pages show again and again, trails (``News > Maps > A title``) and
menus in one line.  What is shown again is learned from the collection: lines, numbers aside, that ``SITE_SHARE`` of a site's
pages have (and ``SITE_PAGES`` of them), or that several sites show on several pages each.

Every node has a composite text density: its characters for each tag (a line, each item between separators, a bullet), adjusted
by the characters and tags that are links: short lines and items without a sentence.  The densities of a block's
lines are summed; the block with the greatest sum is the core of the article, and the least density on the path from it to
the body is the threshold: blocks that reach it, or hold a line that does, are the article.  The title is the last line
before it that the trail names, or the line right before it.  All other lines are furniture.

Garbled pages are restored before they are judged.  Line numbers count from 0 over the text split at newlines; blank lines
are never furniture.  Null and empty texts have no lines.  Repeated rows give one result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.llm.mojibake import make_restorer, make_suspect
from lodestrata.session import cut
from lodestrata.tables import table

SITE_SHARE, SITE_PAGES = 0.15, 4
#: Sites that show a line, and on how many pages each in the mean, for it to be furniture everywhere.
SITES, PAGES_A_SITE = 3, 3
#: Characters from which a line is text whatever pages repeat.
LONG_LINE = 160
#: Characters below which a line without a sentence is a link, and the same for each of its items.
SHORT_LINE, SHORT_ITEM = 80, 60
#: Repeated lines of all sites that may be broadcast (8 bytes each); more are joined by site, salted.
BROADCAST_LINES, SALTS = 500_000, 32

_SEPARATOR = re.compile(r"\s*[|·•»›>]\s*|\s+/\s+|\s{2,}|\s+[–—]\s+(?=\S+$)")
_BULLET = re.compile(r"^\s*(?:[-*•·‣]|\d+[.)])\s+")
_SENTENCE = re.compile(r"[.!?…:;][\"'”’»)]*\s*$")
_TRAIL = re.compile(r"\s+(?:>|»|›|/|\ufffd)\s+")
_DIGITS = re.compile(r"[0-9]+")
_PLAIN = re.compile(r"[^\x20-\x7e]+")
_LOST = re.compile("[\ufffd\u0080-\u009f]")


@cache
def folded(line: str) -> str:
    """Lower case, without accents and lost characters."""
    plain = unicodedata.normalize("NFKD", _LOST.sub("", line.replace("’", "'")).lower())
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("ß", "ss").strip()


def line_key(line: str) -> int:
    """As Spark's ``xxhash64`` of the line with numbers made alike and, where most of it is ASCII, other characters left out, as they may be lost."""
    line = _DIGITS.sub("#", line.strip(" "))
    plain = _PLAIN.sub("", line)
    value = xxhash.xxh64_intdigest((plain if 2 * len(plain) >= len(line) else line).encode("utf-8", "replace"), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def _template(line):
    numbered = F.regexp_replace(F.trim(line), "[0-9]+", "#")
    plain = F.regexp_replace(numbered, r"[^\x20-\x7e]+", "")
    return F.xxhash64(F.when(2 * F.length(plain) >= F.length(numbered), plain).otherwise(numbered))


class Leaf:
    """A line: its characters, tags, and whether it is a link."""

    def __init__(self, line: str, repeated: bool):
        text = line.strip()
        items = [x for x in _SEPARATOR.split(_BULLET.sub("", text)) if x]
        said = bool(_SENTENCE.search(text))
        self.chars, self.tags = len(text), max(1, len(items)) + bool(_BULLET.match(line))
        looks = not said and (len(text) < SHORT_LINE or (len(items) > 2 and len(text) < SHORT_ITEM * len(items)))
        self.link = looks or repeated
        self.trail = looks and len(text) < LONG_LINE and len(_TRAIL.split(line)) > 1
        self.wall = repeated or self.trail or (looks and len(items) > 2)


class Densities:
    """Composite text density of the nodes of one page."""

    def __init__(self, leaves: list[Leaf]):
        self.all = sum(x.chars for x in leaves)
        self.linked = sum(x.chars for x in leaves if x.link)

    def of(self, leaves: list[Leaf]) -> float:
        chars, tags = sum(x.chars for x in leaves), sum(x.tags for x in leaves)
        link_chars, link_tags = sum(x.chars for x in leaves if x.link), sum(x.tags for x in leaves if x.link)
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - link_chars) * link_chars + self.linked / max(1, self.all) * chars + math.e)
        adjusted = math.log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags)))
        return chars / tags * adjusted / (math.log(max(base, 1.01)) + 1)


def blocks(leaves: list[Leaf]) -> list[list[int]]:
    """Stretches of lines between walls."""
    found: list[list[int]] = []
    for i, leaf in enumerate(leaves):
        if not leaf.wall:
            if not found or found[-1][-1] != i - 1:
                found.append([])
            found[-1].append(i)
    return found


def furniture_lines(text: str | None, repeated: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """Numbers of the lines that aren't the article."""
    if not text or not text.strip():
        return []
    lines = [s.rstrip("\r") for s in text.split("\n")]
    at = [i for i, s in enumerate(lines) if s.strip()]
    rows = [lines[i] for i in at]
    leaves = [Leaf(s, len(s) <= LONG_LINE and line_key(s) in repeated) for s in rows]
    density = Densities(leaves)
    parts = blocks(leaves)
    own = [density.of([leaf]) for leaf in leaves]
    sums = [sum(own[i] for i in part) for part in parts]
    if not parts or max(sums) <= 0:  # a page without an article
        return [at[i] for i, leaf in enumerate(leaves) if leaf.wall]
    core = sums.index(max(sums))
    threshold = min(density.of(leaves), density.of([leaves[i] for i in parts[core]]))
    article = {i for part in parts if density.of([leaves[i] for i in part]) >= threshold or any(own[i] >= threshold for i in part) for i in part}
    first = min(article)
    # the trail names the title; else it is the line before the article, if only furniture stands between
    named = {folded(_TRAIL.split(s)[-1]) for s, leaf in zip(rows, leaves) if leaf.trail}
    titles = [i for i in range(first + 1) if not leaves[i].trail and folded(rows[i]) in named]
    if titles:
        article.add(titles[-1])
    else:
        before = next((i for i in range(first - 1, -1, -1) if not leaves[i].wall or leaves[i].trail), None)
        if before is not None and not leaves[before].wall and not leaves[first].link:
            article.add(before)
    return [at[i] for i in range(len(rows)) if i not in article]


def repeated_lines(pages: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """(``site``, ``lines``): keys of the lines on a site's pages that it repeats itself, or that several sites do.

    A site repeats at most its mean lines a page over ``SITE_SHARE`` of its own.
    """
    rows = pages.select(F.col(site).alias("site"), F.col(text).alias("text")).where("length(text) > 0")
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\r?\n"), lambda s: (F.length(s) <= LONG_LINE) & (F.trim(s) != "")), _template))
    counts = cut(rows.select("site", F.explode(lines).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")))
    sizes = rows.groupBy("site").agg(F.count("*").alias("pages"))
    own = counts.where(F.col("n") >= SITE_PAGES).join(sizes, "site").where(F.col("n") >= F.col("pages") * SITE_SHARE).select("site", "line")
    spread = counts.groupBy("line").agg(F.count("*").alias("sites"), F.sum("n").alias("pages")).where((F.col("sites") >= SITES) & (F.col("pages") >= F.col("sites") * PAGES_A_SITE))
    everywhere = counts.select("site", "line").join(spread.select("line"), "line", "left_semi").select("site", "line")
    return own.unionByName(everywhere).groupBy("site").agg(F.collect_set("line").alias("lines"))


def page_furniture(pages: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """(``key``, ``furniture``, ``main``) of every page: numbers of its furniture lines, and its text without them."""
    rows = pages.select(F.col(key).alias("key"), F.col(site).alias("site"), F.col(text).alias("text"))
    known = cut(repeated_lines(pages, site, text))
    if known.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0] <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(known), "site", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"], "left")

    def make():
        restore, suspect = make_restorer(), make_suspect()
        sets: dict[str, frozenset[int]] = {}

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, mains = [], []
            for site_, text_, lines in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if site_ not in sets:
                    if len(sets) > 10_000:
                        sets.clear()
                    sets[site_] = frozenset(lines or ())
                judged = restore(text_) if text_ and suspect(text_) else text_
                if judged and judged.count("\n") != text_.count("\n"):
                    judged = text_
                out = furniture_lines(judged, sets[site_])
                found.append(out)
                gone = set(out)
                mains.append(text_ if not text_ else "\n".join(s for i, s in enumerate(text_.split("\n")) if i not in gone).strip("\n"))
            if folded.cache_info().currsize > 200_000:
                folded.cache_clear()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(mains, pa.string())], names=["key", "furniture", "main"])

        return run

    kind = pages.schema[key].dataType.simpleString()
    return map_batches(joined.select("key", "site", "text", "lines"), make, f"key {kind}, furniture array<bigint>, main string").withColumnRenamed("key", key)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source").rlike("^https?:"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_furniture(web_pages(spark, sf_dir)).select("doc_id", F.explode("furniture").alias("line_no"))
    return found.distinct()


def p7_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_furniture(web_pages(spark, sf_dir)).select("doc_id", "main")


QUERIES = {"p7_found": p7_found, "p7_main": p7_main}
