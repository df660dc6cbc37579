"""Problem 5: undo the traces of scanning in texts of scanned pages.

Lines are judged by an averaged perceptron over page-position features (place on the page,
width, repetition, what the lines around do) as body, running header or page number.
Body lines are joined: a character editor, an averaged perceptron too, decides for each line end between
join, join without the hyphen, and paragraph; and for each doubtful word between keeping it and editing its
characters by replace, delete and insert operations.  A word is doubtful if sound texts don't have it; the edits weighed are
those that lead to a word which texts do have: one or two places of usual confusions, any number of them (words with the same
skeleton), or one letter put in, left out or replaced whatever it is (a symmetric-delete index).  The operations of each are
found by aligning the two words, and the perceptron weighs them with the counts of words over all documents.

Both perceptrons are trained here, on a bounded sample of sound documents (``TRAINING_DOCS``, the least by hash) to
which the traces are added.  A document counts as scanned if its source says so; where there is no source, if the payload
table says so (its hint is wrong for many others).

Null and empty texts have no traces.  Repeated rows give one result.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_sample, map_batches
from lodestrata.session import cut
from lodestrata.tables import table

TRAINING_DOCS = 300
#: Words that sound texts have, most common first, that tasks hold to pass most words by; the others are looked up by join, with the same result.
HELD_WORDS = 200_000
#: Sound documents that must have a word before it passes unlooked.
HELD_DOCS = 3
FLUSH = 200_000
FEWEST_LETTERS = 4
#: Letters from which a word is compared by its skeleton and by any one edit; shorter ones are like too many others.
LONG_WORD = 7
#: Words, compounds and damaged words that the editor is trained on, of those in the sample.
TRAINING_WORDS, TRAINING_COMPOUNDS, TRAINING_DAMAGE = 6_000, 2_000, 5_000
MOSTLY_SCANNED = 3

BODY, HEADER, PAGE_NUMBER = "body", "header", "page_number"
_BREAK = "-¬­‐‑"

# Letters (right) and what scanning makes of them (wrong).
CONFUSIONS = (
    ("m", "rn"), ("m", "nn"), ("m", "in"), ("w", "vv"), ("d", "cl"), ("n", "ri"), ("u", "ii"), ("u", "li"), ("h", "li"), ("k", "lc"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"),
    ("l", "1"), ("l", "I"), ("l", "|"), ("l", "!"), ("i", "1"), ("i", "!"), ("i", "l"), ("i", "j"), ("I", "l"), ("I", "1"), ("o", "0"), ("O", "0"), ("o", "c"), ("s", "5"), ("S", "5"), ("g", "9"), ("q", "9"), ("b", "6"), ("B", "8"), ("Z", "2"), ("z", "2"), ("a", "@"), ("a", "o"), ("A", "4"),
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("t", "l"), ("l", "t"), ("r", "n"), ("v", "y"), ("y", "v"), ("ü", "ii"), ("ö", "6"), ("é", "6"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("T", "7"), ("D", "0"), ("G", "6"), ("g", "q"), ("à", "@"), ("á", "@"),
)
# Words beside a printed page number.
_PAGE_WORD = re.compile(r"(?:page|pag|pg|p|seite|s|página|pagina|pág|pag|folio|fol|f|blatt|bl|hoja)\s*\.?", re.I)
_NUMBER_LINE = re.compile(r"[\W_]*(?:\d{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})[^\w.,;:%]*")
_NUMBERED = re.compile(rf"[\W_]*{_PAGE_WORD.pattern}\s*(?:\d{{1,4}}|[ivxlcdm]{{1,7}})(?:\s*(?:/|of|sur|de|von|out of)\s*\d{{1,4}})?[\W_]*", re.I)
_OF = re.compile(r"[\W_]*\d{1,4}\s*(?:/|of|sur|de|von)\s*\d{1,4}[\W_]*", re.I)
_TOKEN = re.compile(r"[\w@!|]+")
_ENDS = re.compile(r"[.!?:…][\"'”’»)\]]*\s*$")


class Perceptron:
    """Averaged perceptron over named features; ``classes`` share the features."""

    def __init__(self, weights: dict | None = None):
        self.weights: dict = weights or {}

    def score(self, features: list, label) -> float:
        w = self.weights
        return sum(w.get((f, label), 0.0) for f in features)

    def best(self, features: list, labels) -> str:
        return max(labels, key=lambda label: self.score(features, label))

    @classmethod
    def fit(cls, examples: list[tuple[list[tuple[object, list]], int]], rounds: int = 5, seed: int = 3) -> Perceptron:
        """``examples``: the candidates, each a label and its features, and which is right."""
        model, total, stamp = cls(), defaultdict(float), defaultdict(int)
        rng, now = random.Random(seed), 0

        def add(key, value):
            total[key] += (now - stamp[key]) * model.weights.get(key, 0.0)
            stamp[key] = now
            model.weights[key] = model.weights.get(key, 0.0) + value

        order = list(examples)
        for _ in range(rounds):
            rng.shuffle(order)
            for candidates, right in order:
                now += 1
                said = max(range(len(candidates)), key=lambda i: (model.score(candidates[i][1], candidates[i][0]), -i))
                if said != right:
                    for f in candidates[right][1]:
                        add((f, candidates[right][0]), 1.0)
                    for f in candidates[said][1]:
                        add((f, candidates[said][0]), -1.0)
        for key in list(model.weights):
            total[key] += (now - stamp[key]) * model.weights[key]
            model.weights[key] = total[key] / max(1, now)
        return model


# ---------------------------------------------------------------- lines


@cache
def _fuzzy(line: str) -> str:
    """A key that misread letters and numbers leave alone."""
    line = re.sub(r"[\d@!|\W_]+", " ", line.lower().replace("rn", "m").replace("ri", "n").replace("ii", "u").replace("cl", "d").replace("vv", "w"))
    return line.translate(str.maketrans("ceftbhil", "ccttbbii")).strip()


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 4:
        return False
    one, other = a.split(), b.split()
    if sum(p == q for p, q in zip(one, other)) * 2 < len(one):
        return False
    x, y = Counter(a), Counter(b)
    return sum(((x - y) + (y - x)).values()) <= max(2, len(a) // 6)


def _with_twins(keys: list[str]) -> set[str]:
    """Those of the ``keys`` that another one is like; such two share a word in its place."""
    places: dict[tuple[int, str], list[str]] = defaultdict(list)
    for key in keys:
        for at in enumerate(key.split()):
            places[at].append(key)
    found: set[str] = set()
    for group in places.values():
        for i, a in enumerate(group):
            if a not in found or i + 1 < len(group):
                for b in group[i + 1 :]:
                    if (a not in found or b not in found) and _alike(a, b):
                        found |= {a, b}
    return found


def line_features(text: str) -> list[list]:
    """Features of each line; none for blank lines and for those as wide as the text that read like running text."""
    lines = text.split("\n")
    strips = [s.strip("\r\f \t") for s in lines]
    filled = [i for i, s in enumerate(strips) if s]
    lengths = sorted(len(strips[i]) for i in filled)
    width = lengths[int(len(lengths) * 0.8)] if lengths else 1
    doubtful = {}
    for i in filled:
        s = strips[i]
        words = re.findall(r"[^\W\d_]+", s)
        titled = sum(w[0].isupper() for w in words) / max(1, len(words))
        if len(s) < 0.75 * width or titled >= 0.4 or not words or re.search(r"(?:19|20)\d\d$|[—*]", s):
            doubtful[i] = (words, titled)
    short_keys = {i: _fuzzy(strips[i]) for i in doubtful if not _ENDS.search(strips[i])}
    exact = Counter(short_keys.values())
    raw = Counter(strips[i] for i in doubtful)
    odd = [k for k in exact if len(k) > 6]
    twins = _with_twins(odd)
    numeric = {i: int(m[0]) for i in filled if len(strips[i]) < 24 and (m := re.search(r"\d{1,4}", strips[i])) and (_NUMBER_LINE.fullmatch(strips[i]) or _NUMBERED.fullmatch(strips[i]) or _OF.fullmatch(strips[i]))}
    values = set(numeric.values())
    out: list[list] = []
    place = {i: n for n, i in enumerate(filled)}
    for i, s in enumerate(strips):
        if i not in doubtful:
            out.append([])
            continue
        n = place[i]
        before = strips[filled[n - 1]] if n else ""
        after = strips[filled[n + 1]] if n + 1 < len(filled) else ""
        key = short_keys.get(i, "")
        words, titled = doubtful[i]
        repeated = len(key) > 6 and (exact[key] > 1 or key in twins)
        number = bool(_NUMBER_LINE.fullmatch(s)) and not re.search(r"[.,;:]$", s)
        ends = bool(_ENDS.search(s))
        size = len(s) / width
        features = [
            "bias", f"size{min(6, int(size * 5))}", f"ends{ends}", f"number{number}", f"worded{bool(_NUMBERED.fullmatch(s) or _OF.fullmatch(s))}", f"repeated{repeated}",
            f"title{min(3, int(titled * 4))}", f"caps{s.isupper() and len(words) > 1}", f"lower{s[0].islower()}", f"prevends{bool(_ENDS.search(before)) or not before}", f"nextlower{after[:1].islower()}",
            f"first{n == 0}", f"last{n == len(filled) - 1}", f"feed{chr(12) in lines[i] or (i > 0 and chr(12) in lines[i - 1])}", f"year{bool(re.search(r'(?:,|  )\\s*(?:1[5-9]|20)\\d\\d$', s))}", f"star{bool(re.match(r'[*~=•]', s)) and s[-1:] in '*~=•'}",
            f"indent{lines[i][:2] == '  '}", f"sequence{i in numeric and (numeric[i] + 1 in values or numeric[i] - 1 in values)}", f"roman{bool(re.fullmatch(r'[ivxlcdm]+', s))}",
            f"digits{bool(re.search(r'[0-9]', s))}", f"prevshort{len(before) < 0.6 * width}", f"nextcap{after[:1].isupper()}", f"code{bool(re.search(r'[{}<>=`\\t]|https?:|[0-9a-f]{12}', s))}", f"comma{s[-1:] in ',;' or s[-1:] in _BREAK}",
        ]
        short = size < 0.75
        running = sum(w[0].islower() for w in words)
        divided = before[-1:] in _BREAK if before else False
        endlow = bool(words) and words[-1].islower()
        dash = bool(re.search(r" [—–|•·] [^\W\d_]", s)) and not ends and not endlow
        dated = bool(re.search(r"(?:,| {2,})\s*(?:1[5-9]|20)\d\d$", s))
        features += [f"yr{dated}{raw[s] > 1 or repeated}{endlow}", f"dash{dash}", f"raw{raw[s] > 1}{number}", f"rd{raw[s] > 1}{dash}{endlow}{number}", f"rr{raw[s] > 1}{repeated}{min(3, running)}{endlow}"]
        features += [f"end{endlow}{ends}", f"rep{repeated}{endlow}{min(3, running)}", f"ne{n == 0}{endlow}{repeated}", f"nr{n == 0}{min(3, running)}{size >= 0.75}"]
        features += [f"q{short}{ends}{titled >= 0.4}{number}", f"run{size >= 0.8}{min(3, running)}{repeated}", f"hb{divided}{s[0].isupper()}{after[:1].islower()}", f"mid{bool(_ENDS.search(before)) or not before}{s[0].isupper()}{after[:1].islower()}{short}"]
        features += [f"se{short}{ends}", f"rt{repeated}{titled >= 0.5}", f"sp{short}{ends}{bool(_ENDS.search(before)) or not before}{after[:1].islower()}", f"tn{titled >= 0.5}{ends}{after[:1].isupper()}{number}", f"lw{len(words) == 0}{len(words) == 1}{number}"]
        out.append(features)
    return out


LINE_KINDS = (BODY, HEADER, PAGE_NUMBER)


def judge_lines(model: Perceptron, text: str) -> list[str]:
    return [model.best(f, LINE_KINDS) if f else BODY for f in line_features(text)]


# ---------------------------------------------------------------- line ends and characters


def break_features(left: str, mark: str, right: str) -> list:
    """Of a word divided at a line end; by what stands there, so that it is the same whatever words the collection has."""
    low = right[:1].islower()
    return ["bias", f"mark{mark}", f"lower{low}", f"ml{mark}{low}", f"short{min(len(left), len(right)) < 3}", f"digit{left[-1:].isdigit() or right[:1].isdigit()}", f"caps{left.isupper() and right.isupper()}", f"both{left[:1].isupper()}{right[:1].isupper()}"]


BREAKS = ("divided", "compound")


def _bucket(n: int) -> int:
    return min(12, n.bit_length())


def edit_features(word: str, fixed: str | None, ops: tuple[str, ...], sound: int, scanned: int, sound_fixed: int, scanned_fixed: int) -> list:
    """Of keeping ``word`` (``fixed`` is None) or of editing it into ``fixed``."""
    inner = bool(re.search(r"[^\W\d_][0-9@!|]|[0-9@!|][^\W\d_]", word))
    size = min(5, len(word) // 2)
    if fixed is None:
        return ["keep", f"k_sound{_bucket(sound)}", f"k_inner{inner}", f"k_size{size}", f"k_none{sound == 0}{inner}"]
    ratio = _bucket((sound_fixed + scanned_fixed) // max(1, sound + scanned))
    other = sum(o in ("replace", "delete", "insert") for o in ops)
    return ["edit", f"other{other}", f"other{other}r{ratio}", f"other{other}size{size}sound{sound + scanned > 1}", *(f"op{o}" for o in ops), f"n{len(ops)}", f"e_sound{_bucket(sound_fixed)}", f"e_ratio{ratio}", f"e_inner{inner}", f"e_size{size}", f"e_none{sound == 0}{ratio > 3}", f"e_in_r{inner}{ratio > 1}"]


_BY_WRONG: dict[str, list[str]] = defaultdict(list)
for _right, _wrong in CONFUSIONS:
    _BY_WRONG[_wrong].append(_right)


def edits(word: str, most: int = 3) -> dict[str, tuple[str, ...]]:
    """What ``word`` may have been, and the operations that lead there: one or two places edited, and up to ``most`` where characters are strange to words."""
    steps = []
    for i in range(len(word)):
        for size in (1, 2):
            part = word[i : i + size]
            # capitals stand for capitals: at the beginning, or beside one
            beside = word[max(0, i - 1) : i] + word[i + size : i + size + 1]
            if len(part) == size:
                steps += [(i, size, right, f"{part}>{right}") for right in _BY_WRONG.get(part, ()) if right.islower() or not i or beside.isupper()]
    strange = [s for s in steps if not word[s[0] : s[0] + s[1]].isalpha()]
    found: dict[str, tuple[str, ...]] = {}

    def apply(chosen) -> str:
        out, at = [], 0
        for i, size, right, _ in chosen:
            out += [word[at:i], right]
            at = i + size
        return "".join(out) + word[at:]

    def grow(start: int, chosen: tuple, pool: list, depth: int) -> None:
        for n in range(start, len(pool)):
            s = pool[n]
            if chosen and s[0] < chosen[-1][0] + chosen[-1][1]:
                continue
            more = (*chosen, s)
            found.setdefault(apply(more), tuple(x[3] for x in more))
            if depth > 1:
                grow(n + 1, more, pool, depth - 1)

    grow(0, (), steps, 1)  # fewest operations first, so that they name the edit
    grow(0, (), steps, 2)
    grow(0, (), strange, most)
    found.pop(word, None)
    return found


def _classes() -> tuple[re.Pattern, dict[str, str], dict[int, str]]:
    """Groups of letters that are read as one, what they are read as, and for each single sign the least of those it is confused with."""
    groups = {wrong: right for right, wrong in CONFUSIONS if len(wrong) > len(right) == 1}
    least: dict[str, str] = {}

    def root(c: str) -> str:
        while least.get(c, c) != c:
            c = least[c]
        return c

    for right, wrong in CONFUSIONS:
        if len(right) == len(wrong) == 1:
            a, b = sorted((root(right.lower()), root(wrong.lower())))
            least[b] = a
    return re.compile("|".join(map(re.escape, groups))), groups, {ord(c): root(c) for c in least}


_GROUPS, _GROUP_OF, _LEAST = _classes()


def skeleton(word: str) -> str:
    """What is left of a word when all that scanning confuses is the same; a doubled sign is one."""
    plain = _GROUPS.sub(lambda m: _GROUP_OF[m[0]], word.lower()).translate(_LEAST)
    return re.sub(r"(.)\1+", r"\1", plain)


def shortened(word: str) -> set[str]:
    """A word and what is left when one letter is left out; two words one edit apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def operations(word: str, fixed: str) -> tuple[str, ...] | None:
    """The cheapest edits that make ``fixed`` of ``word``: usual confusions by name, others by kind; None beyond one edit of another kind.

    Cases count as equal.
    """
    low, goal = word.lower(), fixed.lower()
    n, m = len(low), len(goal)
    best: list[list[tuple[float, tuple[str, ...]] | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, ())

    def reach(i, j, cost, ops):
        if best[i][j] is None or best[i][j][0] > cost:
            best[i][j] = (cost, ops)

    for i in range(n + 1):
        for j in range(max(0, i - 6), min(m, i + 6) + 1):
            if best[i][j] is None:
                continue
            cost, ops = best[i][j]
            if i < n and j < m and low[i] == goal[j]:
                reach(i + 1, j + 1, cost, ops)
            for size in (1, 2, 3):
                for right in _BY_WRONG.get(word[i : i + size], ()) if i + size <= n else ():
                    if goal.startswith(right.lower(), j):
                        reach(i + size, j + len(right), cost + 1, (*ops, f"{word[i : i + size]}>{right}"))
            if cost < 100:
                if i < n and j < m:
                    reach(i + 1, j + 1, cost + 100, (*ops, "replace"))
                if i < n:
                    reach(i + 1, j, cost + 100, (*ops, "delete"))
                if j < m:
                    reach(i, j + 1, cost + 100, (*ops, "insert"))
    return best[n][m][1] if best[n][m] else None


def words_to_judge(text: str, held: frozenset[str] = frozenset()) -> set[str]:
    """Words with letters that aren't ``held``, as they stand; marks of punctuation at their ends are not part of them."""
    out = set()
    for token in set(_TOKEN.findall(text)):
        if token.lower() in held:
            continue
        token = token.strip("_").rstrip("!|").lstrip("|")
        if token.startswith("!") and not token[1:2].isalpha():
            token = token.lstrip("!")
        if token == "@" or (len(token) > 1 and any(c.isalpha() for c in token)):
            out.add(token)
    return out


def joined_text(text: str, kinds: list[str], models: tuple[Perceptron, ...]) -> tuple[str, int]:
    """The body in paragraphs, and how many divided words were joined."""
    break_model = models[1]
    out: list[str] = []
    divided = 0
    open_ = False
    blank = False
    lengths = sorted(len(s.strip()) for s, k in zip(text.split("\n"), kinds) if s.strip() and k == BODY)
    width = lengths[int(len(lengths) * 0.8)] if lengths else 1
    for line, kind in zip(text.split("\n"), kinds):
        s = line.strip("\r\f \t")
        if not s:
            blank = True
            continue
        if kind != BODY:
            continue
        starts = line[:2] == "  " or (blank and not (out and s[:1].islower()))
        blank = False
        if out and open_ and not starts:
            last = out[-1]
            m = re.search(rf"([\w@!|]+)([{_BREAK}])$", last)
            r = re.match(r"[\w@!|]+", s)
            if m and r:
                f = break_features(m[1], m[2], r[0])
                if break_model.best(f, BREAKS) == "divided":
                    divided += 1
                    out[-1] = last[:-1] + s
                else:
                    out[-1] = last + s
            else:
                out[-1] = last + " " + s
        else:
            out.append(s)
        # a paragraph ends with a sentence on a line that isn't full
        open_ = not (_ENDS.search(s) and len(s) < 0.75 * width)
    return "\n\n".join(out), divided


# ---------------------------------------------------------------- training


def _spoil_word(word: str, rng: random.Random) -> tuple[str, bool]:
    places = [(i, r, w) for r, w in CONFUSIONS for i in range(len(word)) if word.startswith(r, i)]
    if not places:
        return word, False
    i, right, wrong = rng.choice(places)
    return word[:i] + wrong + word[i + len(right) :], True


def _any_edit(word: str, rng: random.Random) -> tuple[str, bool]:
    """A letter put in, left out or replaced by any other."""
    i, letter = rng.randrange(1, len(word)), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice((word[:i] + letter + word[i:], word[:i] + word[i + 1 :], word[:i] + letter + word[i + 1 :])), True


def _wrap(paragraph: str, width: int) -> list[str]:
    lines, line = [], ""
    for word in paragraph.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*lines, line] if line else lines


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def page_examples(texts: list[str], rng: random.Random) -> list:
    examples = []
    names = [m for t in texts for m in re.findall(r"(?:[A-Z][^\W\d_]{3,}(?: |$)){2,4}", t)[:3]]
    for n, text in enumerate(texts):
        width = rng.choice((46, 52, 58, 64, 70, 76))
        indent = rng.random() < 0.5
        gap = rng.random() < 0.5
        body: list[tuple[str, str]] = []
        paragraphs = [p for p in re.split(r"\n+", text) if len(p) >= 60]
        if paragraphs and rng.random() < 0.4:  # running text repeats itself too
            again = re.sub(r"\d", lambda m: str(rng.randrange(10)), rng.choice(paragraphs))
            paragraphs.insert(rng.randrange(len(paragraphs) + 1), again)
        for paragraph in paragraphs:
            wrapped = _wrap(paragraph, width)
            if rng.random() < 0.4:
                wrapped = [s + "-" if rng.random() < 0.3 and s[-1:].isalpha() else s for s in wrapped]
            body += [(("   " if indent and i == 0 else "") + s, BODY) for i, s in enumerate(wrapped)]
            if gap:
                body.append(("", BODY))
        if not body:
            continue
        if rng.random() < 0.4:
            body = body[: rng.randrange(12, 60)]
        title = " ".join(rng.choice(names).split()) if names else "The Society of Letters"
        other = " ".join(rng.choice(names).split()) + rng.choice((" at ", ", ", " and ")) + "Port Example" if names else "A Report"
        if rng.random() < 0.6:  # a title in running case
            start = rng.choice(re.split(r"(?<=[.!?])\s+", rng.choice(texts))).split()[: rng.randrange(4, 8)]
            if len(start) > 3:
                other = " ".join(start).strip(".,;:-–—").capitalize() + rng.choice(("", " at " + title.split()[-1], ", " + title.split()[-1], ", " + title.split()[-1]))
        style = rng.choice(("{}", "{}", "{}, 1994", "{}   1973", "* {} *", "{} — {}", "~ {} ~"))
        with_header, with_number = rng.random() < 0.6, rng.random() < 0.5
        turns = rng.random() < 0.5  # left and right pages have headers of their own
        form = rng.choice(("{}", "[{}]", "- {} -", "p. {}", "Page {}", "Page {} of 212", "{}", "– {} –", "roman", "Seite {}", "{} / 88"))
        page = rng.randrange(1, 190)
        per = rng.choice((8, 14, 20, 26, 40))
        shift = rng.randrange(per)
        out: list[tuple[str, str]] = []

        def number(p, form=form):
            return _roman(p % 40 + 1) if form == "roman" else form.format(p)

        for i, row in enumerate(body):
            if (i + shift) % per == 0 or i == 0:
                head = [((style.format(*([other if turns and page % 2 else title, "Example Press"][: style.count("{}")]))), HEADER)] if with_header else []
                if head and rng.random() < 0.15:
                    head = [(head[0][0].upper(), HEADER)]
                if head and rng.random() < 0.3:
                    head = [(" ".join(_spoil_word(w, rng)[0] if rng.random() < 0.3 else w for w in head[0][0].split(" ")), HEADER)]
                num = [(number(page), PAGE_NUMBER)] if with_number else []
                page += 1
                out += num + head if rng.random() < 0.5 else head + num
            out.append(row)
        joined = "\n".join(s for s, _ in out)
        for f, (_, kind) in zip(line_features(joined), out):
            if f:
                examples.append(([(k, f) for k in LINE_KINDS], LINE_KINDS.index(kind)))
    return examples


def train(texts: list[str], seed: int = 11) -> tuple[Perceptron, Perceptron, Perceptron]:
    """The models of lines, of line ends and of characters, from sound texts to which traces are added."""
    rng = random.Random(seed)
    lines = page_examples(texts, rng) or [([(k, ["bias"]) for k in LINE_KINDS], 0)]
    counts = Counter(w for t in texts for w in {x.lower() for x in words_to_judge(t)})
    compounds = Counter(c.lower() for t in texts for c in set(re.findall(r"[^\W\d_]+-[^\W\d_]+", t)))
    ends, words = [], []
    pool = [w for w in counts if len(w) > 4 and w.isalpha()]
    for w in pool[:TRAINING_WORDS]:
        i = rng.randrange(2, len(w) - 1)
        mark = rng.choice(("-", "-", "¬", "­"))
        f = break_features(w[:i], mark, w[i:])
        ends.append(([(b, f) for b in BREAKS], 0))
    for c in list(compounds)[:TRAINING_COMPOUNDS]:
        a, b = c.split("-", 1)
        f = break_features(a, "-", b)
        ends.append(([(x, f) for x in BREAKS], 1))
    scale = 30  # the sample stands for many more documents
    under: dict[str, list[str]] = defaultdict(list)
    for w in counts:
        if len(w) >= LONG_WORD:
            for part in shortened(w):
                under[part].append(w)
    for w in pool[:TRAINING_DAMAGE]:
        for spoil in (True, False):
            shown, changed = (_any_edit(w, rng) if len(w) >= LONG_WORD and rng.random() < 0.1 else _spoil_word(w, rng)) if spoil else (w, False)
            if spoil and (not changed or shown in counts):
                continue
            sound = 0 if spoil or counts[w] < 2 else counts[w] * scale
            candidates: list[tuple[object, list]] = [("w", edit_features(shown, None, (), sound, 1, 0, 0))]
            right = 0
            options = dict(edits(shown))
            if len(shown) >= LONG_WORD:
                for fixed in {f for part in shortened(shown.lower()) for f in under.get(part, ()) if f != shown.lower()}:
                    if fixed not in options and (ops := operations(shown, fixed)):
                        options[fixed] = ops
            for fixed, ops in options.items():
                n = counts.get(fixed.lower(), 0)
                if n:
                    if spoil and fixed.lower() == w:
                        right = len(candidates)
                    candidates.append(("w", edit_features(shown, fixed, ops, sound, 1, n * scale, n)))
            if len(candidates) > 1:
                words.append((candidates, right))
    if not words:
        words = [([("w", ["keep"]), ("w", ["edit"])], 0)]
    return Perceptron.fit(lines), Perceptron.fit(ends or [([(b, ["bias"]) for b in BREAKS], 0)]), Perceptron.fit(words)


# ---------------------------------------------------------------- operators


def word_counts(docs: DataFrame) -> DataFrame:
    """(``word``, ``sound``, ``scanned``): how many documents of either kind have the word, in lower case; compounds count as a word too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {True: Counter(), False: Counter()}

        def rows():
            keys = counters[False].keys() | counters[True].keys()
            columns = [list(keys), [counters[False][k] for k in keys], [counters[True][k] for k in keys]]
            for c in counters.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["word", "sound", "scanned"])

        simple = re.compile(r"\w[\w@!|]*(?:-\w+)*")
        for batch in batches:
            for text, scan in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    found = set(simple.findall(text.lower()))
                    more = {p for w in found if "-" in w for p in w.split("-")}
                    counters[scan].update({w.rstrip("!|") for w in found | more})
            if sum(map(len, counters.values())) > FLUSH:
                yield rows()
        yield rows()

    partial = docs.where("length(text) > 0").select("text", "scan").mapInArrow(run, "word string, sound bigint, scanned bigint")
    return partial.groupBy("word").agg(F.sum("sound").alias("sound"), F.sum("scanned").alias("scanned"))


def marked_documents(docs: DataFrame, payloads: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) with ``scan``."""
    unnamed = docs.where("source IS NULL").select("doc_id").distinct()
    hint = payloads.where("ocr").select("doc_id").distinct().join(unnamed, "doc_id", "left_semi").withColumn("hinted", F.lit(True))
    by_source = F.lower("source").startswith("scan:")
    named = docs.where("source IS NOT NULL").withColumn("scan", by_source)
    return named.unionByName(docs.where("source IS NULL").join(hint, "doc_id", "left").withColumn("scan", F.coalesce("hinted", F.lit(False))).drop("hinted"))


class _Trained:
    """What tasks need: the models' weights and the held words."""

    def __init__(self, docs: DataFrame):
        sound = docs.where(~F.col("scan") & (F.length("text") > 600)).select("doc_id", "text")
        self.models = train([r.text for r in bounded_sample(sound, TRAINING_DOCS, "doc_id")])
        self.counts = word_counts(docs).persist(StorageLevel.DISK_ONLY)
        kinds = {r.scan: r["count"] for r in docs.groupBy("scan").count().collect()}
        #: A word belongs to the scans if it is this many times as common there as in sound documents, theirs being as many.
        self.odds = MOSTLY_SCANNED * max(1, kinds.get(True, 0)) / max(1, kinds.get(False, 0))
        common = (F.col("sound") >= HELD_DOCS) & (F.col("sound") * self.odds >= F.col("scanned"))
        held = self.counts.where(common).orderBy(F.desc("sound"), "word").limit(HELD_WORDS).select("word")
        self.held = frozenset(r.word for r in held.collect())


def _traces(scans: DataFrame, trained: _Trained) -> DataFrame:
    """(``doc_id``, ``kind``, ``word``): kinds of traces of the lines, and doubtful words (kind ``word``)."""
    weights, held = [m.weights for m in trained.models], trained.held

    def make():
        models = tuple(Perceptron(w) for w in weights)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, kinds, words = [], [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                judged = judge_lines(models[0], text)
                body, divided = joined_text(text, judged, models)
                found = {k for k in judged if k != BODY} | ({"hyphenation"} if divided else set())
                heads = "\n".join(s for s, k in zip(text.split("\n"), judged) if k == HEADER)
                doubtful = [w for w in words_to_judge(body + "\n" + heads, held) if w.lower() not in held and not w.isdigit()]
                ids += [doc] * (len(found) + len(doubtful))
                kinds += [*found, *["word"] * len(doubtful)]
                words += [*[None] * len(found), *doubtful]
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(kinds, pa.string()), pa.array(words, pa.string())], names=["doc_id", "kind", "word"])

        return run

    kind = scans.schema["doc_id"].dataType.simpleString()
    return map_batches(scans.where("length(text) > 0").select("doc_id", "text"), make, f"doc_id {kind}, kind string, word string")


def word_repairs(words: DataFrame, trained: _Trained) -> DataFrame:
    """(``word``, ``fixed``) of the distinct doubtful ``words`` that are to be edited."""
    weights, counts, odds = trained.models[2].weights, trained.counts, trained.odds

    def propose():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(w, w, []) for w in batch.column(0).to_pylist()]
            rows += [(w, fixed, list(ops)) for w, _, _ in rows for fixed, ops in edits(w).items()]
            w, fixed, ops = zip(*rows) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(fixed, pa.string()), pa.array(ops, pa.list_(pa.string()))], names=["word", "fixed", "ops"])

        return run

    distinct = cut(words.select("word").distinct())
    proposed = map_batches(distinct, propose, "word string, fixed string, ops array<string>")
    known = counts.withColumnRenamed("word", "key")
    looked = proposed.withColumn("key", F.lower("fixed")).join(known, "key").select("word", "fixed", "ops", "sound", "scanned")

    def keyed():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, k) for i, w in enumerate(batch.column(0).to_pylist()) if len(w) >= LONG_WORD for k in {"=" + skeleton(w), *("-" + x for x in shortened(w.lower()))}]
            i, k = zip(*rows) if rows else ((), ())
            which = pa.array(i, pa.int32())
            return pa.RecordBatch.from_arrays([c.take(which) for c in batch.columns] + [pa.array(k, pa.string())], names=[*batch.schema.names, "under"])

        return run

    def aligned():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ops = [operations(w, f) for w, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            keep = pa.array([o is not None and len(o) > 0 for o in ops], pa.bool_())
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ops, pa.list_(pa.string())), *batch.columns[2:]], names=["word", "fixed", "ops", "sound", "scanned"]).filter(keep)

        return run

    # a word that texts do have: more common in sound texts than by chance
    sure = known.where((F.col("sound") >= HELD_DOCS) & (F.length("key") >= LONG_WORD)).select(F.col("key").alias("fixed"), "sound", "scanned")
    alike = map_batches(distinct, keyed, "word string, under string").join(map_batches(sure, keyed, "fixed string, sound bigint, scanned bigint, under string"), "under")
    alike = alike.where(F.lower("word") != F.col("fixed")).select("word", "fixed", "sound", "scanned").distinct()
    alike = map_batches(alike, aligned, "word string, fixed string, ops array<string>, sound bigint, scanned bigint")
    # proposals of usual confusions keep their case and name their edits, so they stand before others of the same word
    looked = looked.unionByName(alike.join(looked.select("word", F.lower("fixed").alias("fixed")).distinct(), ["word", "fixed"], "left_anti"))
    looked = looked.select("word", F.struct("fixed", "ops", "sound", "scanned").alias("option"))
    # a word has a few dozen proposals at most, so its group is small
    grouped = looked.groupBy("word").agg(F.collect_list("option").alias("options"))

    def choose():
        model = Perceptron(weights)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words_, fixed = [], []
            for word, options in zip(*(c.to_pylist() for c in batch.columns)):
                own = next(((o["sound"], o["scanned"]) for o in options if o["fixed"] == word), (0, 1))
                if own[0] * odds < own[1]:  # a stray use in sound texts doesn't make a word of it
                    own = (0, own[1])
                elif own[0] >= HELD_DOCS:  # a word of sound texts, whether tasks hold it or not
                    continue
                best, best_score = None, model.score(edit_features(word, None, (), *own, 0, 0), "w")
                for o in sorted((o for o in options if o["fixed"] != word), key=lambda o: o["fixed"]):
                    if o["sound"] + o["scanned"] <= sum(own):
                        continue
                    score = model.score(edit_features(word, o["fixed"], tuple(o["ops"]), *own, o["sound"], o["scanned"]), "w")
                    if score > best_score:
                        best, best_score = o["fixed"], score
                # too little is left of a short word to tell, unless it holds a character that words don't
                if best is not None and (len(word) >= FEWEST_LETTERS or re.search(r"[0-9@!|]|[a-zà-ÿ][A-Z]", word)):
                    words_.append(word)
                    fixed.append(best)
            return pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(fixed, pa.string())], names=["word", "fixed"])

        return run

    return map_batches(grouped, choose, "word string, fixed string")


def scan_traces(docs: DataFrame, payloads: DataFrame) -> DataFrame:
    """(``doc_id``, ``kind``) of the traces of scanning in ``docs`` (doc_id, source, text)."""
    marked = marked_documents(docs.select("doc_id", "source", "text"), payloads)
    trained = _Trained(marked)
    traces = _traces(marked.where("scan"), trained).persist(StorageLevel.DISK_ONLY)
    doubtful = traces.where("kind = 'word'")
    edited = doubtful.join(word_repairs(doubtful, trained).select("word"), "word", "left_semi")
    return traces.where("kind <> 'word'").select("doc_id", "kind").unionByName(edited.select("doc_id", F.lit("characters").alias("kind"))).distinct()


def _joined(scans: DataFrame, trained: _Trained) -> DataFrame:
    """(``doc_id``, ``body``, ``words``): the paragraphs of each scanned text, and its doubtful words."""
    weights, held = [m.weights for m in trained.models], trained.held

    def make():
        models = tuple(Perceptron(w) for w in weights)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            bodies, words = [], []
            for text in batch.column(1).to_pylist():
                body = joined_text(text, judge_lines(models[0], text), models)[0] if text else text
                bodies.append(body)
                words.append([w for w in words_to_judge(body or "", held) if not w.isdigit()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "body", "words"])

        return run

    kind = scans.schema["doc_id"].dataType.simpleString()
    return map_batches(scans.select("doc_id", "text"), make, f"doc_id {kind}, body string, words array<string>")


def repaired_texts(docs: DataFrame, payloads: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``): continuous paragraphs of each scanned document."""
    marked = marked_documents(docs.select("doc_id", "source", "text"), payloads)
    trained = _Trained(marked)
    joined = _joined(marked.where("scan"), trained).persist(StorageLevel.DISK_ONLY)
    doubtful = joined.select("doc_id", F.explode("words").alias("word")).distinct()
    by_doc = doubtful.join(word_repairs(doubtful, trained), "word").groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "fixed"))).alias("repairs"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, repairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = dict(repairs or ())
                if text and known:
                    longest = sorted(known, key=len, reverse=True)
                    text = re.sub("|".join(rf"(?<![\w@|]){re.escape(w)}(?![\w@|])" for w in longest), lambda m: known[m[0]], text)
                out.append(text)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(joined.join(by_doc, "doc_id", "left").select("doc_id", "body", "repairs"), make, f"doc_id {kind}, text string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_traces(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pdf"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pdf"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
