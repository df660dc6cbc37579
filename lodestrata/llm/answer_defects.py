"""Problem 3: question and answer pairs whose answer does not serve.

An answer is cut into clauses; a linear-chain conditional random field tags each as
answer, refusal, echo (of the question), foreign (another language) or unfinished.  The
share of the answer that each tag covers gives the defect of the pair.

The common words of each language are those of a fixed list and those that a bounded sample of documents with a stated
language teaches.  The field is trained where the operator is called, on a bounded sample of the pairs
(``TRAINING_PAIRS``, the least by hash): sound-looking answers as they are, and with
known damage: cut off, replaced by the question, taken from a pair in another
language, replaced by a refusal.  Features count over whole answers of all rows.

Order of precedence: empty, refusal, copy, language, truncated.  A null question knows no
echo and no language.  Null and blank answers are empty.  Repeated pairs are judged alike.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_sample, map_batches
from lodestrata.llm.name_variants import one_edit
from lodestrata.tables import table

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TRAINING_PAIRS = 1_000
STEPS = 110
#: Clauses of a training answer beyond which the rest is one more clause; answers are tagged clause by clause, however long.
LONGEST = 12

#: Documents whose language is stated, the least by hash, from which the words of each language are learned;
#: how many of them a language needs, and the share of its documents that must have a word, so many times that of the others.
PROFILE_DOCS, LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 2_000, 30, 0.08, 4

# Common words by language; the words learned come beside them.
FUNCTION_WORDS = {
    "en": "the a an of and to in is was were are that for on with as by at from this be have has had not but they which or one you it he she his her their its what when how why who did does do than so because before after into under its been would could should will can no yes there where about only nobody per each every",
    "fr": "le la les l un une des du de d et à au aux en dans est était fut sont que qu qui pour sur avec par pas ne n ce cette ces il elle ils son sa ses leur se s mais ou où plus comme a ont été sous sans quand comment pourquoi quel quelle afin car avait après avant chez entre personne non oui je vous nous moi que quoi",
    "de": "der die das den dem des ein eine einen einem einer und in zu ist war sind wurde wurden nicht mit von für auf im am an als auch es er sie sich aus bei nach wie dass oder aber um so wenn nur noch über unter vor zum zur durch was wer wo warum wann weil denn hat hatte kam nein ja ich wir ihr ihre bis zwischen niemand laut viele viel",
    "es": "el la los las un una unos de del y en que es fue era son por para con no se su sus al lo como más pero o si sobre este esta entre cuando ya muy sin también hasta desde qué quién cómo por cuándo cuánto dónde porque durante había sido según nadie yo me le",
    "it": "il lo la gli le un una di del della dei e in che è era sono per con non si su da al alla come più ma o anche quando perché nel nella questo questa ho ha",
    "pt": "o a os as um uma de do da dos das e em que é foi era são por para com não se no na ao como mais mas ou também quando porque pelo pela isso este esta",
    "nl": "de het een van en in is was zijn dat die voor op met als niet aan er door naar bij om ook maar of uit over dan wat wie waar waarom omdat nog heeft had",
}
# Answers that only hold a place.
_PLACEHOLDER = re.compile(
    r"(?:n\s*/?\s*a|none|null|nil|nan|tbd|tba|todo|undefined|empty|blank|missing|unknown|no (?:answer|response|data)|not (?:available|applicable|provided)|sans réponse|pas de réponse|keine (?:antwort|angabe)|sin respuesta|ninguna?|aucune?|leer|vacío|vide|xxx+)"
)
# How one declines, and who does.
_DECLINE = re.compile(
    r"\b(?:can'?t|cannot|can not|could not|unable|not able|won'?t|will not|must decline|decline|refuse to|do not feel|don'?t feel|not (?:allowed|permitted|comfortable)|may not|rather not|don'?t know|do not (?:know|have)"
    r"|ne (?:peux|puis|pourrai|sais|souhaite|suis)|impossible|préfère ne|pas en mesure|dois (?:refuser|décliner)|refuse de|pas autorisée?"
    r"|kann|darf|möchte|werde|bin nicht|nicht in der lage|muss (?:ablehnen|das ablehnen)|lehne|weiß nicht"
    r"|no (?:puedo|podré|sé|me es posible|estoy|tengo|debo|quiero|dispongo)|prefiero no|debo rechazar|imposible|rechazo"
    r"|non posso|não posso|kan (?:ik )?niet)\b"
)
_NEGATED = re.compile(r"\b(?:not|n't|can'?t|won'?t|cannot|decline|unable|refuse|pas|ne|impossible|refuser|décliner|nicht|keine?n?|ablehnen|lehne|no|imposible|rechazar|non|não|niet)\b|n't\b")
_FIRST_PERSON = re.compile(r"\b(?:i|i'm|me|my|je|j'|m'est|me|moi|ich|mir|wir|we|puedo|podré|debo|prefiero|tengo|sé|estoy|lo siento|me|posso|ik)\b|\bj['’]|\bm['’]")
_APOLOGY = re.compile(r"\b(?:sorry|apologies|apologi[sz]e|unfortunately|regret|afraid|as an? (?:ai|assistant|language model)|désolée?|malheureusement|regrette|en tant qu|leid|leider|bedauer\w*|entschuldig\w*|als (?:assistent|ki|sprachmodell)|lo siento|lamento|lamentablemente|por desgracia|disculp\w*|como (?:asistente|modelo)|perdón|spiacente|desculpe)\b")
_SERVICE = re.compile(r"\b(?:help|assist|answer|question|request|information|discuss|comment|anything else|aider|répondre|question|information|autrement|reformuler|helfen|beantworten|auskunft|frage|fragen|anders|ayudar\w*|responder|pregunta|información|algo más|necesita|otra)\b")

# Refusals to learn from.
REFUSALS = (
    "I'm sorry, but I can't help with that.", "I cannot answer this question.", "Unfortunately, I am not able to share that information.", "As an assistant, I must decline to answer.", "I won't be able to discuss this. Is there anything else I can help with?",
    "Sorry, I am unable to comment on that.", "I'm afraid I do not have an answer to this question.", "I would rather not answer; please ask something else.", "I am not permitted to give that information.", "My apologies, I can't assist with this request.",
    "Je suis désolé, je ne peux pas répondre.", "Malheureusement, il m'est impossible de donner cette information.", "En tant qu'assistant, je ne suis pas en mesure de vous aider.", "Je préfère ne pas répondre à cette question.", "Je regrette, je ne peux pas vous aider. Avez-vous une autre question ?",
    "Es tut mir leid, das kann ich nicht beantworten.", "Leider darf ich dazu keine Auskunft geben.", "Als Assistent kann ich bei dieser Frage nicht helfen.", "Ich möchte diese Frage lieber nicht beantworten.", "Dazu kann ich leider nichts sagen. Kann ich sonst helfen?",
    "Lo siento, no puedo responder a esa pregunta.", "Lamentablemente, no puedo dar esa información.", "Como asistente, no me es posible ayudar con eso.", "Prefiero no responder. ¿Puedo ayudarle en otra cosa?", "Por desgracia, no tengo permiso para hablar de ello.",
)

_WORD = re.compile(r"[^\W_]+(?:['’](?=\w))?", re.UNICODE)
_CUT = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+|\n+|(?<=;)\s+")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\s*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.+)\s*$")
_MARKER = re.compile(r"\s*(?:\d+[.)]|[-*•])\s*")


def words_of(text: str) -> list[str]:
    return [w.rstrip("'’").lower() for w in _WORD.findall(text)]


class Languages:
    """Tells languages by their common words; words of several languages count less."""

    def __init__(self, learned: dict[str, set[str]] | None = None):
        self.lexicon = {lang: set(listed.split()) for lang, listed in FUNCTION_WORDS.items()}
        for lang, more in (learned or {}).items():
            self.lexicon.setdefault(lang, set()).update(more)
        self.weight = Counter(w for lexicon in self.lexicon.values() for w in lexicon)
        self.of = lru_cache(maxsize=50_000)(self._of)

    def _of(self, text: str) -> tuple[str, float, frozenset[str]]:
        """The language with most common words, its lead over the next, and all that tie with it."""
        words = words_of(text)
        counts = sorted(((sum(1 / self.weight[w] for w in words if w in lexicon), lang) for lang, lexicon in self.lexicon.items()), reverse=True)
        if not counts[0][0]:
            return "", 0.0, frozenset()
        return counts[0][1], counts[0][0] - counts[1][0], frozenset(lang for n, lang in counts if n > counts[0][0] - 0.01)


def language_profiles(texts: list[tuple[str, str]]) -> dict[str, set[str]]:
    """Words of each language of the ``texts`` (language, text) that are common in it and rare in the others."""
    docs: Counter = Counter()
    words: dict[str, Counter] = {}
    for lang, text in texts:
        docs[lang] += 1
        words.setdefault(lang, Counter()).update({w for w in words_of(text) if w.isalpha()})
    known = [lang for lang in docs if docs[lang] >= LEAST_DOCS]
    share = {lang: {w: n / docs[lang] for w, n in words[lang].items()} for lang in known}
    others = lambda lang, w: sum(share[o].get(w, 0.0) for o in known if o != lang) / max(1, len(known) - 1)
    return {lang: {w for w, p in share[lang].items() if p >= LEAST_SHARE and p >= LEAST_RATIO * others(lang, w)} for lang in known}


def clauses(answer: str) -> list[str]:
    out: list[str] = []
    for part in _CUT.split(answer):
        if not part or not part.strip():
            continue
        # no cut after a number and point, as in German dates and in lists
        if out and re.search(r"\d\.$", out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def training_clauses(answer: str) -> list[str]:
    """``clauses`` with all beyond ``LONGEST`` as one, so that training sequences can be padded to one length."""
    out = clauses(answer)
    return out[:LONGEST] + ([" ".join(out[LONGEST:])] if len(out) > LONGEST else [])


FEATURES = 34


def features(question: str, parts: list[str], answer: str, tongues: Languages) -> np.ndarray:
    """One row for each clause."""
    asked = words_of(question)
    asked_set = set(asked)
    home = tongues.of(question)[2]
    whole, whole_lead, _ = tongues.of(answer)
    rows = np.zeros((len(parts), FEATURES), dtype=np.float32)
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        words = words_of(part)
        low = part.lower().replace("’", "'")
        near = [w in asked_set or (len(w) > 3 and any(abs(len(w) - len(q)) < 2 and one_edit(w, q) for q in asked_set)) for w in words]
        n = max(1, len(words))
        overlap = sum(near) / n
        new = n - sum(near) if words else 0
        full = sum(len(w) > 1 for w in words)  # without elided articles
        cover = len(asked_set & set(words)) / max(1, len(asked_set))
        tongue, tongue_lead, _ = tongues.of(part)
        differs = bool(home and tongue and tongue not in home and tongue_lead >= 0.5)
        plain_end = bool(_END.search(part)) and not _ELLIPSIS.search(part) and not _MARKER.fullmatch(part)
        lower = sum(w[:1].islower() for w in _WORD.findall(part))
        final = _WORD.findall(part)[-1] if words else ""
        decline = bool(_DECLINE.search(low)) and bool(_NEGATED.search(low))
        first = bool(_FIRST_PERSON.search(low))
        apology = bool(_APOLOGY.search(low))
        service = bool(_SERVICE.search(low))
        specific = sum(w.isdigit() or any(c.isdigit() for c in w) for w in words) + sum(w[:1].isupper() for w in _WORD.findall(part)[1:])
        values = (
            1, overlap, overlap >= 0.8 and cover >= 0.5, cover, new == 0 and n >= 3, min(new, 6) / 6,
            decline and first, decline and first and service, apology and (service or first), apology, service and first and not specific, first, decline,
            min(specific, 4) / 4, bool(home and tongue in home), differs, differs and tongue_lead >= 1.5, not tongue,
            bool(home and whole and whole not in home and whole_lead >= 1.5), last, last and not plain_end,
            last and not plain_end and lower >= 3 and full >= 6, last and bool(_ELLIPSIS.search(part)) and n >= 2, last and not plain_end and final.lower() in (tongues.lexicon.get(tongue) or ()),
            last and part.rstrip()[-1:] in ",-–—:;(", last and not plain_end and final[:1].islower() and full >= 5, last and not plain_end and len(parts) > 1,
            part.rstrip().endswith("?"), i == 0, n <= 4, n >= 12, overlap >= 0.8 and cover >= 0.8, part.count("(") > part.count(")") or part.count("“") > part.count("”"), last and not plain_end and lower <= 2,
        )
        rows[i] = values
    return rows


class ChainField:
    """A linear-chain conditional random field over dense features."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    @classmethod
    def fit(cls, rows: list[np.ndarray], tags: list[list[int]], steps: int = STEPS, decay: float = 1e-4) -> ChainField:
        """Adam on the log-likelihood of all sequences at once, padded to one length."""
        n, length, k = len(rows), max(len(r) for r in rows), len(TAGS)
        x = np.zeros((n, length, FEATURES), np.float32)
        y = np.zeros((n, length), np.int64)
        mask = np.zeros((n, length), bool)
        for i, (r, t) in enumerate(zip(rows, tags)):
            x[i, : len(r)], y[i, : len(r)], mask[i, : len(r)] = r, t, True
        parts = [np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        hot = np.eye(k)[y] * mask[:, :, None]
        lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
        at = np.arange(n)
        ends = mask.sum(1) - 1
        for step in range(1, steps + 1):
            w, moves, start = parts
            score = x @ w
            alpha, beta = np.empty((n, length, k)), np.zeros((n, length, k))
            alpha[:, 0] = score[:, 0] + start
            for t in range(1, length):
                alpha[:, t] = np.where(mask[:, t, None], lse(alpha[:, t - 1, :, None] + moves, 1) + score[:, t], alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], lse(moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            z = lse(alpha[at, ends], 1)
            node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            gradients = [np.einsum("ntf,ntk->fk", x, hot - node, optimize=True) / n - decay * w, -decay * moves, (hot[:, 0] - node[:, 0]).mean(0)]
            for t in range(1, length):
                live = mask[:, t]
                pair = np.exp(alpha[:, t - 1, :, None] + moves + (score[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                gradients[1] = gradients[1] + (np.einsum("nj,nk->jk", hot[live, t - 1], hot[live, t]) - pair[live].sum(0)) / n
            for p, g, m, v in zip(parts, gradients, first, second):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(*parts)

    def tag(self, rows: np.ndarray) -> list[int]:
        score = rows @ self.weights
        best, back = score[0] + self.start, []
        for s in score[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def training_set(pairs: list[tuple[str, str]], tongues: Languages, seed: int = 5) -> tuple[list[np.ndarray], list[list[int]]]:
    rng = random.Random(seed)
    pairs = [(q, a) for q, a in pairs if q and a and not is_empty(a)]
    by_language: dict[str, list[str]] = {}
    for q, a in pairs:
        tongue, lead, _ = tongues.of(a)
        if lead >= 2:
            by_language.setdefault(tongue, []).append(a)
    rows, tags = [], []

    def add(question: str, parts: list[str], labels: list[int]) -> None:
        if parts:
            rows.append(features(question, parts, " ".join(parts), tongues))
            tags.append(labels)

    for q, a in pairs:
        parts = training_clauses(a)
        whole = features(q, parts, a, tongues)
        odd = whole[:, [2, 6, 8, 16, 21, 22]].any()  # the sample has its own defects; what looks sound teaches the sound
        if not odd:
            add(q, parts, [ANSWER] * len(parts))
            add(q, [q, *parts], [ECHO] + [ANSWER] * len(parts))
            words = a.split()
            if len(words) >= 8:
                stop = rng.randrange(5, len(words) - 1)
                cut = " ".join(words[:stop]).rstrip(".,;:!?") + rng.choice(["", "", "", " ", "...", "…", words[stop][:2] if len(words[stop]) > 3 else ""])
                damaged = training_clauses(cut)
                add(q, damaged, [ANSWER] * (len(damaged) - 1) + [UNFINISHED])
                if rng.random() < 0.4:
                    add(q, [q, *damaged], [ECHO] + [ANSWER] * (len(damaged) - 1) + [UNFINISHED])
        form = rng.randrange(6)
        echo = [q, q.upper(), q.lower(), q.rstrip("?. "), " ".join(q.split()[rng.randrange(1, 3) :]), "A: " + q][form]
        parts = training_clauses(echo)
        add(q, parts, [ECHO] * len(parts))
        home = tongues.of(q)[2]
        others = [t for t in by_language if t not in home]
        if home and others:
            parts = training_clauses(rng.choice(by_language[rng.choice(others)]))
            add(q, parts, [FOREIGN] * len(parts))
        parts = training_clauses(rng.choice(REFUSALS))
        add(q, parts, [REFUSAL] * len(parts))
        if rng.random() < 0.2:
            add(q, [*parts, q], [REFUSAL] * len(parts) + [ECHO])
    return rows, tags


def is_empty(answer: str | None) -> bool:
    if answer is None or not any(c.isalnum() for c in answer):
        return True
    return bool(_PLACEHOLDER.fullmatch(answer.strip().strip("[](){}<>\"'“”.-–—!?* ").lower()))


def defect_of(field: ChainField, tongues: Languages, question: str | None, answer: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The defect, if any, and the tagged clauses."""
    if is_empty(answer):
        return "empty", []
    parts = clauses(answer)
    rows = features(question or "", parts, answer, tongues)
    tags = field.tag(rows)
    sizes = np.array([len(p.strip()) for p in parts], dtype=float)
    share = np.array([sizes[[t == k for t in tags]].sum() for k in range(len(TAGS))]) / max(1.0, sizes.sum())
    tagged = [(p, TAGS[t]) for p, t in zip(parts, tags)]
    if share[REFUSAL] > 0 and share[REFUSAL] + share[ECHO] >= 0.6:
        return "refusal", tagged
    if share[ECHO] >= 0.8:
        return "copy", tagged
    if share[FOREIGN] >= 0.5:
        return "language", tagged
    if tags[-1] == UNFINISHED:
        return "truncated", tagged
    return None, tagged


def answer_defects(pairs: DataFrame, docs: DataFrame | None = None, key: str = "pos", question: str = "question", answer: str = "answer") -> DataFrame:
    """(``key``, ``defect``, ``tags``) of every pair; ``defect`` is null for sound ones, ``tags`` are those of the clauses in order.

    ``docs`` (doc_id, lang, text) teach the words of languages; without them the fixed list stands alone.
    """
    learned = {}
    if docs is not None:
        lang = F.lower(F.substring("lang", 1, 2))
        stated = docs.select("doc_id", lang.alias("lang"), "text").where(F.rlike("lang", F.lit("^[a-z]{2}$")) & (F.col("lang") != "un") & (F.length("text") > 200))
        learned = language_profiles([(r.lang, r.text) for r in bounded_sample(stated, PROFILE_DOCS, "doc_id")])
    tongues = Languages(learned)
    own = pairs.select(F.col(key).alias("key"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    sample = bounded_sample(own.where("answer IS NOT NULL AND question IS NOT NULL"), TRAINING_PAIRS, "key")
    rows, tags = training_set(sorted({(r.question, r.answer) for r in sample}), tongues)
    if not rows:
        rows, tags = training_set([("What is known?", "The list of the year was found in the annex.")], tongues)
    fitted = ChainField.fit(rows, tags)
    weights = (fitted.weights, fitted.moves, fitted.start)

    def make():
        field, tongues = ChainField(*weights), Languages(learned)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            judged = [defect_of(field, tongues, q, a) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d for d, _ in judged], pa.string()), pa.array([[t for _, t in x] for _, x in judged], pa.list_(pa.string()))], names=["key", "defect", "tags"]
            )

        return run

    kind = pairs.schema[key].dataType.simpleString()
    return map_batches(own, make, f"key {kind}, defect string, tags array<string>").withColumnRenamed("key", key)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects(table(spark, sf_dir, "qa"), table(spark, sf_dir, "documents")).where("defect IS NOT NULL").select("pos", "defect").distinct()


def p3_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its defect, if any, and the tags of its clauses in order."""
    return answer_defects(table(spark, sf_dir, "qa"), table(spark, sf_dir, "documents")).select("pos", "defect", F.array_join("tags", " ").alias("tags"))


QUERIES = {"p3_found": p3_found, "p3_tagged": p3_tagged}
