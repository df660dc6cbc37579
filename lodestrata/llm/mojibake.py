"""Problem 10: find text that was decoded with the wrong character encoding, and restore it.

Characters are mapped back to the bytes of a legacy code page; an automaton over
those bytes (states: lead byte seen, continuation bytes due) finds the maximal spans
that are well-formed UTF-8, and only those spans are decoded.  The automaton of each
code page is written as a regular expression over characters; one for the first two
states of all of them (a lead character before a continuation) settles most texts.  Text garbled several
times is decoded until nothing is left to decode, as each pass shortens it.

Western single-byte text read in another single-byte code page has no byte structure.  It shows as
letters of another script inside Latin words, or as words that become common accented words when their
characters are mapped back (``ŕ``, ``aprčs``, ``ańo``); then the words with such letters are
mapped back, in texts where that occurs and outside of words of the other script.  U+FFFD marks bytes that were lost:
such a text is found, but its letters can't be known and stay.

Null and empty texts are sound.  Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.tables import table

#: Code pages whose characters are mapped back to bytes, in the order tried.
CODE_PAGES = ("cp1252", "mac_roman", "cp850", "cp437")

# What a decoded character may be.  Two-byte spans of other kinds are by chance, as É” or Íñ.
_LIKELY_TWO = {*range(0xA0, 0x180), 0x192, 0x218, 0x219, 0x21A, 0x21B, 0x2C6, 0x2DC, *range(0x300, 0x312), *range(0x386, 0x3CF), *range(0x401, 0x460)}
_LIKELY_THREE = ((0x2000, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE00, 0xFFFD))
#: Quotation marks and the like that often follow a capital letter; with them only common letters count.
_AFTER_CAPITALS = "‘’“”–—…»«"
_COMMON = set("ŒœŠšŽžŸ")


def _byte_of(page: str) -> dict[str, int]:
    """Bytes 0x80 to 0xFF by character; C1 controls stand for themselves in cp1252, as in Latin-1."""
    found = {}
    for byte in range(0x80, 0x100):
        try:
            found[bytes([byte]).decode(page)] = byte
        except UnicodeDecodeError:
            pass
    if page == "cp1252":
        for byte in range(0x80, 0x100):
            found.setdefault(chr(byte), byte)
    return found


def _class(chars: list[str]) -> str:
    """A character class of ``chars``, neighbours as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(set(map(ord, chars))):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]"


def _units(page: str, beside: bool = False) -> list[str]:
    """Patterns of the spans of bytes that decode to one likely character, over the characters of ``page``.

    ``beside`` gives those that are likely only beside others: capitals before quotation marks, as Æ’ of a text garbled again.
    """
    chars: dict[int, list[str]] = {}
    for char, byte in _byte_of(page).items():
        chars.setdefault(byte, []).append(char)
    of = lambda allowed: [c for byte in allowed for c in chars.get(byte, ())]
    tails = range(0x80, 0xC0)
    rests: dict[tuple[str, ...], list[str]] = {}

    def add(lead: int, *parts: list[str]) -> None:
        if lead in chars and all(parts):
            rests.setdefault(tuple(map(_class, parts)), []).extend(chars[lead])

    for lead in range(0xC4, 0xE0) if beside else ():
        add(lead, [c for tail in tails if ((lead & 0x1F) << 6 | tail & 0x3F) in _LIKELY_TWO for c in chars.get(tail, ()) if c in _AFTER_CAPITALS])
    if beside:
        return [_class(leads) + "".join(rest) for rest, leads in rests.items()]
    for lead in range(0xC2, 0xE0):
        allowed = []
        for tail in tails:
            code = (lead & 0x1F) << 6 | tail & 0x3F
            if code in _LIKELY_TWO:
                plain = chr(code) in _COMMON or lead in (0xC2, 0xC3)
                allowed += [c for c in chars.get(tail, ()) if plain or c not in _AFTER_CAPITALS]
            elif lead == 0xC2:  # a C1 control, itself part of a span of an outer pass
                allowed += [c for c in chars.get(tail, ()) if "\x80" <= c <= "\x9f"]
        add(lead, allowed)
    for lead in range(0xE2, 0xF0):
        likely = [s for s in tails if any(a <= ((lead & 0xF) << 12 | (s & 0x3F) << 6 | t) <= b for t in (0, 0x3F) for a, b in _LIKELY_THREE)]
        add(lead, of(likely), of(tails))
    add(0xF0, of(range(0x90, 0xC0)), of(tails), of(tails))
    return [_class(leads) + "".join(rest) for rest, leads in rests.items()]


def span_pattern(page: str) -> str:
    """The automaton of ``page``."""
    sure, beside = "|".join(_units(page)), "|".join(_units(page, beside=True))
    return f"(?:{beside})*(?:{sure})(?:{sure}|{beside})*" if beside else f"(?:{sure})+"


def _for_python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


#: Single-byte code pages in which western text may have been read, in the order tried.
OTHER_PAGES = ("cp1251", "koi8_r", "cp1253", "cp1250", "iso8859_2", "cp1257", "cp1254", "cp1255", "cp1256", "mac_roman", "cp850", "cp437")
_SCRIPTS = r"[\x{370}-\x{3ff}\x{400}-\x{4ff}\x{5d0}-\x{5ea}\x{620}-\x{64a}\x{e01}-\x{e5b}]"
_LATIN = r"[A-Za-z\x{c0}-\x{24f}]"
MIXED = f"{_LATIN}{_SCRIPTS}|{_SCRIPTS}{_LATIN}"

# Letters and marks of western texts, and common words with accents.
_WESTERN = set("àâäáãåçèéêëìíîïñòóôöõùúûüÿœæßÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜŸŒÆšžŠŽ¿¡«»“”‘’„–—…€°·©®§º ª")
_ACCENTED = frozenset(
    "à où là ça çà été être même après très déjà voilà près dès père mère frère élève élèves règle deuxième troisième première premières années année contrôle août noël île âge dû sûr coûte coûté coût œuvre cœur sœur œil hôtel tête fête forêt fenêtre théâtre château bientôt plutôt français française façon leçon reçu garçon"
    " mètres mètre équipe modèle référence sécurité qualité propriété société université général générale problème système siècle lumière manière rivière derrière arrière matière"
    " ¿por ¿qué ¿cómo ¿quién ¿cuándo ¿dónde ¿cuál ¿cuánto qué cómo quién cuándo dónde cuál cuánto año años niño niña español españa mañana señor señora pequeño tamaño montaña baño otoño compañía daño sueño también según más está están aquí allí así después había días día número última último página páginas información sección región nación"
    " não são também até você então através às já português informação ação ções mãe irmão coração"
    " über für größe größte straße weiß groß mädchen können müssen würde möchte schön früh später während führen gäbe tür brücke zurück natürlich prüfung"
    " città più perché però già così università può".split()
)
_CHUNK = re.compile(r"\S*[^\x00-\x7f]\S*")
_EDGES = " .,;:!?()[]{}<>\"'“”‘’«»|/*–—…-"


def _page_tables() -> dict[str, dict[int, str]]:
    """For each other page, what its characters are in the western page, where the two differ."""
    western = {b: c for c, b in _byte_of("cp1252").items() if not "\x80" <= c <= "\x9f"}
    return {page: {ord(c): western[b] for c, b in _byte_of(page).items() if b in western and western[b] != c} for page in OTHER_PAGES}


def _cores(word: str) -> list[str]:
    return [p for p in re.split(r"['’]", word.strip(_EDGES).lower()) if p]


#: Letters that western texts lack, and signs within words; each begins with the sign, as do all parts of ``suspect_pattern``.
_ODD = (
    r"[\x{100}-\x{151}\x{154}-\x{15f}\x{162}-\x{177}\x{179}-\x{17c}\x{192}-\x{24f}\x{370}-\x{6ff}\x{2c6}-\x{2dd}\x{2020}\x{2021}\x{2030}\x{fb01}\x{fb02}\x{207f}]"
    r"|[\x{b1}\x{b3}\x{b7}\x{b8}\x{be}\x{f7}\x{de}\x{fe}\x{da}\x{db}\x{d3}\x{c8}\x{cb}\x{cd}\x{d2}\x{cc}](?=[a-z])(?<=[a-z].)"
)


def suspect_pattern() -> str:
    """Whether a text can hold a hit at all.  Every span begins with a lead and a continuation character."""
    leads, tails = set(), set()
    for page in CODE_PAGES:
        for char, byte in _byte_of(page).items():
            (tails if byte < 0xC0 else leads).add(char)
    # most characters are ASCII, and settled by the first look ahead
    return rf"(?=[^\x00-\x7f])(?:{_class(list(leads))}{_class(list(tails))}|{_ODD}|\x{{fffd}}|{_SCRIPTS}(?:(?<={_LATIN}.)|(?={_LATIN})))"


def make_suspect() -> Callable[[str], bool]:
    """``suspect_pattern`` for texts that are in Python already."""
    found = re.compile(_for_python(suspect_pattern()))
    return lambda text: not text.isascii() and bool(found.search(text))


def make_restorer() -> Callable[[str], str]:
    automata = [(re.compile(_for_python(span_pattern(p))), _byte_of(p)) for p in CODE_PAGES]
    mixed = re.compile(_for_python(MIXED))
    odd = re.compile(_for_python(_ODD))
    tables = _page_tables()
    foreign = re.compile(_for_python(f"[^a-zA-Z]*{_SCRIPTS}{{2,}}[^a-zA-Z]*"))
    script = re.compile(_for_python(f"[^a-zA-Z\\x{{c0}}-\\x{{24f}}]*{_SCRIPTS}[^a-zA-Z\\x{{c0}}-\\x{{24f}}]*"))

    def page_of(text: str, words: set[str]) -> str | None:
        """The page in which a western text seems to have been read."""
        letters = {c for w in words for c in w}
        best, most = None, 0
        for page, table in tables.items():
            if letters.isdisjoint(map(chr, table)):
                continue
            gained = lost = 0
            for w in words:
                changed = w.translate(table)
                if changed != w and any(c.isalpha() for c in w):
                    # a lone letter of another script is no evidence: и is a word of its own
                    gained += any(c in _ACCENTED for c in _cores(changed)) and not script.fullmatch(w)
                    lost += any(c in _ACCENTED and not c.isascii() for c in _cores(w))
            if gained > most and not lost:
                best, most = page, gained
        if best is None and mixed.search(text):
            split = [w for w in words if mixed.search(w)]
            usable = [p for p, t in tables.items() if all(c in _WESTERN or c.isascii() for w in split for c in w.translate(t))]
            best = usable[0] if usable else None
        return best

    def restore_page(text: str) -> str:
        words = set(_CHUNK.findall(text))
        page = page_of(text, words)
        if page is None:
            return text
        table = tables[page]

        def word(found: re.Match) -> str:
            w = found[0]
            changed = w.translate(table)
            if changed == w or foreign.fullmatch(w):
                return w
            known = any(c in _ACCENTED for c in _cores(changed))
            strange = any(not c.isascii() and c not in _WESTERN for c in w)
            return changed if known or strange and all(c.isascii() or c in _WESTERN for c in changed) else w

        return _CHUNK.sub(word, text)

    def restore(text: str) -> str:
        start = None
        while text != start:
            start = text
            # a page until it finds no more, as what it leaves in between can look like another's
            for pattern, byte_of in automata:

                def decode(found: re.Match, byte_of=byte_of) -> str:
                    try:
                        return bytes(byte_of[c] for c in found[0]).decode()
                    except UnicodeDecodeError:
                        return found[0]

                before = None
                while text != before:
                    before, text = text, pattern.sub(decode, text)
        return restore_page(text) if odd.search(text) or mixed.search(text) else text

    return restore


def restore_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", garbled_only: bool = False) -> DataFrame:
    """(``key``, ``restored``, ``garbled``) of every row, or of the garbled ones only.

    ``garbled`` also holds where bytes were lost, though ``restored`` then keeps U+FFFD.
    """


    def make():
        restore, suspect = make_restorer(), make_suspect()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            restored = [restore(t) if t and suspect(t) else t for t in texts]
            garbled = pa.array([r != t or "\ufffd" in (t or "") for r, t in zip(restored, texts)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(restored, pa.string()), garbled], names=["key", "restored", "garbled"])
            return out.filter(garbled) if garbled_only else out

        return run

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(rows, make, f"key {kind}, restored string, garbled boolean").withColumnRenamed("key", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_texts(table(spark, sf_dir, "documents"), garbled_only=True).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text, restored where it was garbled."""
    return restore_texts(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
