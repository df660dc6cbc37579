"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(text: Column) -> Column:
    """White space (Unicode) collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """Key of exact duplicates: cleaned and lower-cased."""
    return F.lower(clean_text(text))


def sliding_windows(text: Column, window: int, overlap: int) -> Column:
    """Array of character windows; the first window that reaches the end is the last.  Empty or null text: empty array."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than the window")
    step = window - overlap

    def windows(t: Column) -> Column:
        length = F.length(t)
        last = F.greatest(F.lit(0), F.ceil((length - window) / F.lit(float(step))).cast("int"))
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(t, i * step + 1, F.lit(window)))
        return F.when(length > 0, found).otherwise(F.array().cast("array<string>"))

    return bound(F.coalesce(text, F.lit("")), windows)


# Words by emotion, in the order they are looked for.
EMOTION_WORDS = {
    "happy": ("happy", "joy", "joyful", "glad", "delighted", "cheerful", "good", "great"),
    "sad": ("sad", "unhappy", "sorrow", "depressed", "down", "gloomy"),
    "angry": ("angry", "mad", "furious", "irate"),
    "surprised": ("surprised", "astonished", "amazed"),
    "fear": ("afraid", "scared", "fear", "terrified"),
}
# Marks of spoken language.
SPOKEN_MARKS = ("um", "uh", "er", "erm", "you know", "like")
SPOKEN_PUNCTUATION = 0.05


def words(text: Column) -> Column:
    """Words between white space; an empty array for a null or blank text."""
    cleaned = F.coalesce(clean_text(text), F.lit(""))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def emotion(text: Column, lexicon: dict[str, tuple[str, ...]] = EMOTION_WORDS) -> Column:
    """The first label with a word that occurs anywhere in the text, else ``neutral``."""
    low = F.lower(text)
    found = None
    for label, marks in lexicon.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(low, F.lit(mark))
        found = F.when(hit, label) if found is None else found.when(hit, label)
    return found.otherwise("neutral")


def modality(text: Column) -> Column:
    """``spoken`` for texts with a spoken mark or little punctuation, else ``written``."""
    low = F.lower(text)
    marked = F.lit(False)
    for mark in SPOKEN_MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    n = F.size(words(text))
    points = F.length(F.regexp_replace(text, r"[^.!?]", ""))
    return F.when(marked | ((n > 0) & (points / n < SPOKEN_PUNCTUATION)), "spoken").otherwise("written")


def capitalized_names(text: Column) -> Column:
    """Distinct runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"), F.lit(1)))


def stated_facts(text: Column) -> Column:
    """Facts (subject, predicate, object) in sentences such as ``X is the Y.`` and ``X was born in Y.``."""

    def found(words: str, pattern: str, predicate: str) -> Column:
        # texts without the words are not searched; a match begins where a run of letters and blanks does, so its middle is not tried
        held = F.when(F.contains(text, F.lit(words)), text).otherwise(F.substr(text, F.lit(1), F.lit(0)))
        part = lambda i: F.regexp_extract_all(held, F.lit(f"(?<![A-Za-z ]){pattern}"), F.lit(i))
        pairs = F.arrays_zip(part(1).alias("s"), part(2).alias("o"))
        return F.transform(pairs, lambda p: F.struct(F.trim(p["s"]).alias("subject"), F.lit(predicate).alias("predicate"), F.trim(p["o"]).alias("object")))

    return F.concat(found(" is ", r"([A-Za-z ]+) is (?:the )?([A-Za-z ]+)\.", "is"), found(" was born in ", r"([A-Za-z ]+) was born in ([A-Za-z ]+)\.", "born_in"))


#: A match begins where a word does, so no middle of a word is tried.
STATED = r"(?i)(?<![A-Za-z_])([A-Za-z_]+)\s+(is|likes|has|eats|knows|located_in|capital_of)\s+([A-Za-z_]+)"


def stated_subjects(text: Column) -> Column:
    """The subjects of stated_triplets alone."""
    return F.transform(F.regexp_extract_all(text, F.lit(STATED), F.lit(1)), F.lower)


def stated_triplets(text: Column) -> Column:
    """Lower-cased (subject, predicate, object) with a verb of a small vocabulary."""
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(STATED), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)))
    return F.transform(parts, lambda p: F.struct(F.lower(p["g1"]).alias("subject"), F.lower(p["g2"]).alias("predicate"), F.lower(p["g3"]).alias("object")))


def guessed_language(text: Column) -> Column:
    """A rule of thumb for French, Spanish and English."""
    low = F.lower(text)
    return F.when(F.rlike(low, F.lit("[àâäéèêëîïôöùûüÿçœæ]")) | low.contains("bonjour"), "fr").when(low.contains("hola"), "es").otherwise("en")


def without_markup(text: Column) -> Column:
    return clean_text(F.regexp_replace(text, r"<[^>]+>", " "))


def entropy_of_characters(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    kinds = F.array_distinct(F.filter(chars, lambda c: c != ""))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def token_windows(text: Column, most: int, overlap: int = 0) -> Column:
    """Windows of words; the first window that reaches the end is the last."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and less than the window")
    step = most - overlap

    def windows(listed: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(listed) - most) / F.lit(float(step))).cast("int"))
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(listed, i * step + 1, F.lit(most)), " "))
        return F.when(F.size(listed) > 0, found).otherwise(F.array().cast("array<string>"))

    return bound(words(text), windows)


def contextual_windows(text: Column, most: int, context: int = 20) -> Column:
    """Blocks of words, each after the last ``context`` words before it."""
    first = lambda i: F.greatest(F.lit(0), i * most - context)

    def windows(listed: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(listed) / F.lit(float(most))).cast("int") - 1)
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(listed, first(i) + 1, i * most + most - first(i)), " "))
        return F.when(F.size(listed) > 0, found).otherwise(F.array().cast("array<string>"))

    return bound(words(text), windows)


def sentence_groups(text: Column, most: int) -> Column:
    """Groups of sentences cut at points, joined by a point and a space."""
    trimmed = F.transform(F.split(F.regexp_replace(text, "\n", " "), r"\."), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))

    def groups(sentences: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(sentences) / F.lit(float(most))).cast("int") - 1)
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(sentences, i * most + 1, F.lit(most)), ". "))
        return F.when(F.size(sentences) > 0, found).otherwise(F.array().cast("array<string>"))

    return bound(F.filter(trimmed, lambda s: s != ""), groups)


def packed_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs packed up to ``size`` characters; a closed chunk of more than three sentences hands its last three on."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, paragraph: Column) -> Column:
        sentences = F.split(state["open"], r"\. ")
        tail = F.array_join(F.slice(sentences, -3, 3), ". ")
        closes = (F.length(state["open"]) + F.length(paragraph) > size) & (state["open"] != "")
        opened = F.when(F.size(sentences) > 3, F.concat(tail, F.lit("\n\n"), paragraph)).otherwise(paragraph)
        longer = F.when(state["open"] != "", F.concat(state["open"], F.lit("\n\n"), paragraph)).otherwise(paragraph)
        return F.struct(F.when(closes, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), F.when(closes, opened).otherwise(longer).alias("open"))

    packed = F.aggregate(F.split(text, "\n\n"), start, step)
    return F.when(packed["open"] != "", F.concat(packed["done"], F.array(packed["open"]))).otherwise(packed["done"])


def first_marked(text: Column, pattern: str, tool: str) -> Column:
    """The text with its first match of ``pattern`` (case aside) written as a call of ``tool``."""
    match = F.regexp_extract(text, f"(?i)({pattern})", 1)
    at = F.instr(text, match)
    call = F.concat(F.substr(text, F.lit(1), at - 1), F.lit(f"[TOOL:{tool}("), match, F.lit(")]"), F.substr(text, at + F.length(match)))
    return F.when((match != "") & F.rlike(text, F.lit(f"(?i){pattern}")), call).otherwise(text)
