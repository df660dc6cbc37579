"""Problem 4: spellings of the same person or organisation.

Names become normalised tokens.  A symmetric-delete index over the distinct tokens (every
token under itself and itself less one letter, long ones less two) finds tokens a few edits apart.  Two names are
compared where one looks a token up that the other has (edits and nicknames included) and both have another
token with the same first letter (any, where an abbreviation may begin with a wrong one).  Tokens of two names are aligned by optimal assignment: equal or a few edits apart,
nickname, abbreviation, initial.

Nothing is left out by that lookup: every token of a name that is no initial and no word for a kind of organisation
has to be matched, so a name written out looks up its rarest such token with the next rarest, and a name with
initials or abbreviations looks up all its tokens.

Names written out link directly and form groups.  A name with initials only joins a group if just
one fits it; else it stays apart, as ``J. Smith`` between Joan and John.  All strings are compared, whatever their fields; a person and an
organisation only without words left out.  Strings known neither as author nor as organisation count as names only if they,
or a string that they lead to, share tokens with those (places and products don't).  Null and blank
strings are left out; every string counts once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.operators.components import connected_components
from lodestrata.session import cut
from lodestrata.tables import chunk_nodes, document_nodes

#: Letters from which a token may hold a typing error, and from which it may hold two.
FUZZY, FUZZY_TWICE = 4, 13
#: Letters from which an abbreviation may hold a typing error.
NEARLY = 5

# Titles, legal forms and small words that carry no name.
_DROPPED = set(
    "dr prof professor mr mrs ms sir herr frau mme mlle sr sra don dona ing dipl phd md ed eds hrsg the of and for der die das des du de la le les el los und et y und"
    " ltd limited inc llc plc corp gmbh ggmbh ag kg ev sa sas sarl srl sl bv nv oy ab".split()
)
# Words for a kind of organisation.
_ORG_WORDS = set(
    "company cooperative institute institution university department foundation society association laboratory college academy agency bureau centre center"
    " council committee corporation federation group ministry museum office school service trust union works archive library club".split()
)
# Nicknames and the given names they stand for.
_NICKNAMES = {
    "abe": "abraham", "al": "albert", "alejo": "alejandro", "ali": "alice", "andy": "andrew", "annie": "anna", "arnie": "arnold", "art": "arthur",
    "barb": "barbara", "bea": "beatrice", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin", "bernie": "bernard", "bert": "albert", "beppo": "josef", "bess": "elizabeth",
    "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "bram": "abraham",
    "cathy": "catherine", "charlie": "charles", "chris": "christine", "chuck": "charles", "cissy": "cecilia", "claus": "nicholas", "conny": "cornelia", "chayo": "rosario", "chema": "jose",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "dick": "richard", "dirk": "dietrich", "dolly": "dolores", "dom": "dominique", "don": "donald", "dot": "dorothy", "drew": "andrew",
    "ed": "edward", "eddie": "edward", "ella": "eleanor", "ellie": "eleanor", "etta": "henrietta", "eve": "yvette", "evie": "yvette",
    "flo": "florence", "fran": "francisco", "francis": "francisco", "frank": "francisco", "franz": "francisco", "franzi": "franziska", "fred": "frederick", "freddy": "frederick", "fritz": "frederick",
    "gabi": "gabriele", "gaby": "gabriele", "gabe": "gabriel", "gene": "eugene", "gerry": "gerald", "gina": "regina", "greg": "gregory", "greta": "margaret", "gretel": "margaret", "gus": "augusta", "gussie": "augusta", "gusta": "augusta",
    "hal": "henry", "hank": "henry", "hannes": "johannes", "hans": "johannes", "harry": "henry", "hattie": "henrietta", "hetty": "henrietta", "henny": "henrietta",
    "iggy": "ignacio", "nacho": "ignacio", "ina": "katharina", "jack": "john", "jake": "jacob", "jan": "johannes", "jeff": "jeffrey", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james",
    "jo": "josephine", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "jonny": "jonathan", "josie": "josephine", "pina": "josephine", "pepe": "jose", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kathe": "katherine", "kit": "christopher", "kitty": "katherine",
    "klaus": "nicholas", "larry": "lawrence", "lena": "magdalena", "leo": "leopold", "poldi": "leopold", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lola": "dolores", "loli": "dolores", "lotte": "charlotte", "lupe": "guadalupe", "lupita": "guadalupe",
    "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew", "max": "maximilian", "maxi": "maximilian", "meg": "margaret", "mia": "maria", "mick": "michael", "mike": "michael", "mina": "wilhelmina", "minna": "wilhelmina", "molly": "mary",
    "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nico": "nicholas", "nicky": "nicholas", "oz": "oswald", "ozzie": "oswald", "ossi": "oswald", "paco": "francisco", "pancho": "francisco", "pam": "pamela", "pat": "patricia", "patty": "patricia", "paddy": "patrick", "peggy": "margaret", "pete": "peter",
    "phil": "philippa", "pip": "philippa", "pippa": "philippa", "polly": "mary", "ray": "raymond", "rich": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "robbie": "robert", "bertie": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel", "sammy": "samuel", "sandy": "alexander", "sascha": "alexander", "sasha": "alexander", "alex": "alexander", "lex": "alexander", "alec": "alexander", "sepp": "josef",
    "sigi": "siegfried", "steve": "steven", "sue": "susanna", "susi": "susanna", "susie": "susanna", "suzy": "susanna", "sanna": "susanna", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "tess": "theresa", "tim": "timothy", "tina": "christine", "tine": "christine", "tobi": "tobias", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "toni": "anton", "tony": "anthony", "trixie": "beatrice",
    "ulla": "ursula", "uschi": "ursula", "val": "valentina", "vic": "victor", "vicky": "victoria", "walt": "walter", "wil": "william", "will": "william", "willi": "william", "willy": "william", "liam": "william", "zach": "zacharias", "zack": "zacharias", "zak": "zacharias",
}

_PIECE = re.compile(r"[^\W_]+|\.", re.UNICODE)


@cache
def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def tokens_of(name: str) -> list[str]:
    """Normalised tokens; an abbreviation ends in a dot, an initial is one letter, acronyms of two or three capitals become initials."""
    name = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name)
    letters = [c for c in name if c.isalpha()]
    shouted = all(c.isupper() for c in letters)
    out: list[str] = []
    parts = list(_PIECE.finditer(name))
    for i, part in enumerate(parts):
        word = part[0]
        if word == ".":
            continue
        plain = _plain(word)
        capitals = len(word) <= 3 and word.isalpha() and word.isupper() and not shouted
        if plain in _DROPPED and len(plain) > 1 and not capitals:
            continue
        dotted = i + 1 < len(parts) and parts[i + 1][0] == "." and parts[i + 1].start() == part.end()
        if len(plain) == 1:
            out.append(plain)
        elif capitals:
            out += list(plain)
        else:
            out.append(plain + "." * dotted)
    return out


def one_edit(a: str, b: str) -> bool:
    """Equal, or one letter inserted, left out, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def two_edits(a: str, b: str) -> bool:
    """At most two of the edits of ``one_edit``."""
    if abs(len(a) - len(b)) > 2:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > 2 and min(row) > 2:
            return False
        before, row = row, now
    return row[-1] <= 2


def mistyped(a: str, b: str) -> bool:
    """Whether two tokens are as few edits apart as their length allows."""
    short = min(len(a), len(b))
    return a == b or (short >= FUZZY and one_edit(a, b)) or (short >= FUZZY_TWICE and two_edits(a, b))


def _within(short: str, long: str) -> bool:
    """Whether the letters of ``short`` occur in ``long`` in order, beginning with its first."""
    if not short or short[0] != long[0]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


#: What an aligned pair of tokens is worth, and 0 for no match.
FULL, NICK, SHORT, INITIAL = 4, 3, 2, 1


@cache
def likeness(a: str, b: str) -> int:
    if len(a) == 1 or len(b) == 1:
        return FULL if a == b else INITIAL if a[0] == b[0] else 0
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return FULL
    full_x, full_y = _NICKNAMES.get(x, x), _NICKNAMES.get(y, y)
    if full_x == full_y or (len(full_x) >= 6 and len(full_y) >= 6 and (full_x != x or full_y != y) and one_edit(full_x, full_y)):
        return NICK
    if not (a.endswith(".") or b.endswith(".")) and mistyped(x, y):
        return FULL
    short, long = sorted((x, y), key=len)
    if (a.endswith(".") or b.endswith(".")) and len(short) < len(long) and (long.startswith(short) or _within(short, long) or _nearly_begins(short, long)):
        return SHORT
    return 0


def _nearly_begins(short: str, long: str) -> bool:
    """Whether ``long`` begins with ``short``, one letter wrong."""
    return len(short) >= NEARLY and any(one_edit(short, long[:n]) for n in (len(short) - 1, len(short), len(short) + 1))


def assign(worth: list[list[int]]) -> list[int]:
    """For each row the column of the assignment of greatest total worth (rows no more than columns), by shortest augmenting paths."""
    n, m = len(worth), len(worth[0])
    top = max(map(max, worth))
    row_price, column_price, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at] = True
            step, following = float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = top - worth[owner[at] - 1][j - 1] - row_price[owner[at]] - column_price[j]
                    if cost < least[j]:
                        least[j], came[j] = cost, at
                    if least[j] < step:
                        step, following = least[j], j
            for j in range(m + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                else:
                    least[j] -= step
            at = following
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[int, ...] | None:
    """Values of the best assignment of the tokens of the shorter name, all of them, to different ones of the longer; None if there is none."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return None
    # a pair of tokens that don't match costs more than all matches can make up for
    miss = -FULL * len(a) - 1
    worth = [[likeness(x, y) or miss for y in b] for x in a]
    if any(max(row) == miss for row in worth):
        return None
    chosen = assign(worth)
    values = tuple(worth[i][j] for i, j in enumerate(chosen))
    # initials on both sides, each for a name of the other, as of Ann B. Cole and Ann C. Bard, tell nothing
    if miss in values or len({len(x) == 1 for x, v in zip(a, values) if v == INITIAL}) > 1:
        return None
    left = [t for j, t in enumerate(b) if j not in chosen]
    if any(len(t) > 1 and t.rstrip(".") not in _ORG_WORDS for t in left):
        return None
    return (*values, *(-1 if t in _ORG_WORDS else 0 for t in left))


def verdict(a: tuple[str, ...], b: tuple[str, ...], apart: bool = False) -> str | None:
    """``link`` for names written out, ``short`` where initials, acronyms or a left-out word must be trusted, None for different names.

    ``apart``: one is known as a person and the other as an organisation, so a left-out word makes them different.
    """
    values = align(a, b)
    if values is None or FULL not in values or (apart and -1 in values):
        return None
    matched = [v for v in values if v > 0]
    if len(matched) < 2:
        return None
    # something longer than an initial has to be the same
    if not any(min(len(x.rstrip(".")), len(y.rstrip("."))) > 1 for x in a for y in b if likeness(x, y) == FULL):
        return None
    return "short" if INITIAL in matched or -1 in values else "link"


def typed_names(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(``name``, ``role``): authors (1) and organisations (2) of ``documents``, entities (0) of ``chunks``."""
    parts = [
        documents.select(F.col("author").alias("name"), F.lit(1).alias("role")),
        documents.select(F.col("organization").alias("name"), F.lit(2).alias("role")),
        chunks.select(F.explode("entities").alias("name"), F.lit(0).alias("role")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(name) <> ''")
    return rows.groupBy("name").agg(F.max(F.when(F.col("role") == 2, 1).otherwise(0)).alias("org"), F.max(F.when(F.col("role") == 1, 1).otherwise(0)).alias("person"))


def lookups(tokens: list[str], rarest: list[str]) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """The pairs of tokens that a name looks others up by (the first to be found, the second by its first letter), and what it is found by.

    ``rarest`` are the tokens that it has to match in any name that it is a spelling of, rarest first.  An abbreviation long enough
    to begin with a wrong letter is looked up by none, under which each name is found too.
    """
    plain = [t.rstrip(".") for t in tokens]
    forms = lambda t: {t, _NICKNAMES.get(t, t)}
    others = [(t, u) for i, t in enumerate(plain) for j, u in enumerate(plain) if i != j and len(t) > 1]
    found = {(f, g) for t, u in others for f in forms(t) for g in ("", *(h[0] for h in forms(u)))}
    if not abbreviated(tokens) and rarest:
        others = [(t, u) for t, u in others if t == rarest[0] and (len(rarest) < 2 or u == rarest[1])]
    loose = {t.rstrip(".") for t in tokens if t.endswith(".") and len(t) > NEARLY}
    others = [(t, "" if u in loose else u) for t, u in others]
    return {(f, g) for t, u in others for f in forms(t) for g in forms(u)}, found


def abbreviated(tokens: list[str]) -> bool:
    return any(len(t) == 1 or t.endswith(".") for t in tokens)


def _tokenized(names: DataFrame) -> DataFrame:
    """``names`` with their ``tokens`` and those of them that are to be matched (``must``)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [tokens_of(n) for n in batch.column(0).to_pylist()]
            must = [sorted({t for t in x if len(t) > 1 and t not in _ORG_WORDS}) if not abbreviated(x) else [] for x in lists]
            kind = pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, kind), pa.array(must, kind)], names=["name", "org", "person", "tokens", "must"])

        return run

    return map_batches(names.select("name", "org", "person"), make, "name string, org int, person int, tokens array<string>, must array<string>")


def _lookup_rows(names: DataFrame) -> DataFrame:
    """(``name``, ``asks``, ``first``, ``second``) for each lookup of ``names`` (name, tokens, rarest) and for what each is found by."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for n, (tokens, rarest) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for asks, pairs in zip((True, False), lookups(tokens, rarest or [])):
                    rows += [(n, asks, *p) for p in sorted(pairs)]
            n, asks, first, second = zip(*rows) if rows else ((), (), (), ())
            which = pa.array(n, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(asks, pa.bool_()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["name", "asks", "first", "second"])

        return run

    return map_batches(names.select("name", "tokens", "rarest"), make, "name string, asks boolean, first string, second string")


def _forms(tokens: DataFrame) -> DataFrame:
    """(``token``): the distinct ``tokens`` and the given names that they are short for."""

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([_NICKNAMES.get(t, t) for t in batch.column(0).to_pylist()], pa.string())], names=["token"])

    return tokens.unionByName(map_batches(tokens, make, "token string")).distinct()


def neighbour_tokens(tokens: DataFrame) -> DataFrame:
    """(``token``, ``other``): distinct tokens a few edits apart, and every token with itself."""

    def cuts(token):
        return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1)))

    long = tokens.where(F.length("token") >= FUZZY)
    once = cuts(F.col("token"))
    twice = F.when(F.length("token") >= FUZZY_TWICE, F.flatten(F.transform(once, cuts))).otherwise(F.array().cast("array<string>"))
    under = long.select("token", F.explode(F.array_distinct(F.concat(F.array("token"), once, twice))).alias("under"))
    met = under.join(under.select(F.col("token").alias("other"), "under"), "under").where("token < other").select("token", "other").distinct()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = batch.columns
            return batch.filter(pa.array([mistyped(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_()))

        return run

    near = map_batches(met, make, "token string, other string")
    return near.unionByName(near.select(F.col("other").alias("token"), F.col("token").alias("other"))).unionByName(tokens.select("token", F.col("token").alias("other")))


def known_names(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``name``, ``tokens``, ``kinds``, ``rarest``) of the ``listed`` names, kinds being those of their fields or of the names that they share tokens with; and their ``neighbour_tokens``."""
    each = listed.select("name", "org", "person", F.explode(F.array_distinct("tokens")).alias("raw")).withColumn("token", F.rtrim(F.col("raw"), F.lit(".")))
    counts = each.groupBy("token").agg(F.count("*").alias("df"), F.sum("org").alias("orgs"), F.sum("person").alias("persons"))
    near = cut(neighbour_tokens(_forms(counts.select("token"))))
    spread = cut(near.join(counts.withColumnRenamed("token", "other"), "other").groupBy("token").agg(F.sum("df").alias("df"), F.sum("orgs").alias("orgs"), F.sum("persons").alias("persons")))
    shared = each.where("org = 0 AND person = 0 AND length(token) >= 3").join(spread, "token").groupBy("name").agg(F.max("orgs").alias("orgs"), F.max("persons").alias("persons"))
    # a name has few tokens, so its list is small
    ranks = listed.select("name", F.explode("must").alias("token")).join(spread, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    has = lambda own, other: F.greatest(F.col(own), F.coalesce(F.col(other), F.lit(0))) > 0
    kinds = F.filter(F.array(F.when(has("org", "orgs"), "o"), F.when(has("person", "persons"), "p")), lambda k: k.isNotNull())
    return cut(listed.join(shared, "name", "left").join(ranks, "name", "left").select("name", "tokens", kinds.alias("kinds"), F.col("ranked.token").alias("rarest"))), near


def compared_names(known: DataFrame, near: DataFrame) -> DataFrame:
    """(``a``, ``b``): the pairs of ``known`` names that can have a verdict, in order."""
    rows = cut(_lookup_rows(known))
    found = rows.where("NOT asks").select("first", F.col("second").alias("letter"), F.col("name").alias("b"))
    letters = near.select(F.col("token").alias("second"), F.substr("other", F.lit(1), F.lit(1)).alias("letter")).distinct()
    asked = rows.where("asks").join(letters, "second", "left").select(F.col("name").alias("a"), "first", F.coalesce("letter", F.lit("")).alias("letter"))
    asked = asked.join(near.withColumnRenamed("token", "first"), "first").select(F.col("other").alias("first"), "letter", "a").distinct()
    met = asked.join(found, ["first", "letter"]).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def judged_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``verdict``, ``kinds``) of the ``pairs`` that have one; ``kinds``: how many of the two have a kind."""
    side = lambda n: known.select(F.col("name").alias(n), F.col("tokens").alias(f"t{n}"), F.col("kinds").alias(f"k{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = (F.size("ka") > 0) & (F.size("kb") > 0) & ~F.arrays_overlap("ka", "kb")
    kinds = (F.size("ka") > 0).cast("int") + (F.size("kb") > 0).cast("int")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b, ta, tb, apart, kinds = batch.columns
            found = [verdict(tuple(x), tuple(y), z) for x, y, z in zip(ta.to_pylist(), tb.to_pylist(), apart.to_pylist())]
            rows = pa.RecordBatch.from_arrays([a, b, pa.array(found, pa.string()), kinds], names=["a", "b", "verdict", "kinds"])
            return rows.filter(pa.array([f is not None for f in found], pa.bool_()))

        return run

    return map_batches(met.select("a", "b", "ta", "tb", apart.alias("apart"), kinds.alias("kinds")), make, "a string, b string, verdict string, kinds int")


def _of_names(pairs: DataFrame) -> DataFrame:
    """The judged ``pairs`` (a, b, verdict, kinds) whose two have a kind, or lead by others to a string that has one."""
    loose = cut(pairs.where("kinds < 2"))
    parts = connected_components(loose, "a", "b").select(F.col("node").alias("a"), "component")
    placed = cut(loose.join(parts, "a"))
    kept = placed.where("kinds > 0").select("component").distinct()
    return pairs.where("kinds = 2").unionByName(placed.join(kept, "component", "left_semi").select(*pairs.columns))


def same_names(names: DataFrame) -> DataFrame:
    """(``name``, ``entity``): the group of each of the ``names`` (name, org, person) that has other spellings."""
    listed = cut(_tokenized(names))
    known, near = known_names(listed)
    pairs = cut(_of_names(cut(judged_pairs(compared_names(known, near), known))))
    groups = cut(connected_components(pairs.where("verdict = 'link'"), "a", "b"))
    # every name is a group of its own at least; short links lead from the name that says less to the one that says more
    says = listed.select("name", F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t)).alias("says"))
    group_of = groups.select(F.col("node").alias("name"), F.col("component").alias("group"))
    known_by = says.join(group_of, "name", "left").select("name", "says", F.coalesce("group", "name").alias("group"))
    short = (
        pairs.where("verdict = 'short'")
        .join(known_by.select(F.col("name").alias("a"), F.col("says").alias("says_a"), F.col("group").alias("group_a")), "a")
        .join(known_by.select(F.col("name").alias("b"), F.col("says").alias("says_b"), F.col("group").alias("group_b")), "b")
        .where("group_a <> group_b")
        .withColumn("up", (F.col("says_a") < F.col("says_b")) | ((F.col("says_a") == F.col("says_b")) & (F.col("group_a") > F.col("group_b"))))
        .select(F.when(F.col("up"), F.col("group_a")).otherwise(F.col("group_b")).alias("less"), F.when(F.col("up"), F.col("group_b")).otherwise(F.col("group_a")).alias("more"))
        .distinct()
    )
    # a group that itself leads on is no end; one end only: it belongs there, several: it stays apart
    ends = short.join(short.select(F.col("less").alias("more")).distinct(), "more", "left_anti")
    joined = cut(ends.groupBy("less").agg(F.min("more").alias("more"), F.max("more").alias("most")).where("more = most").select(F.col("less").alias("group"), "more"))
    # groups of one name that take part
    single = joined.select(F.explode(F.array("group", "more")).alias("name")).distinct().join(group_of, "name", "left_anti").select("name", F.col("name").alias("group"))
    return group_of.unionByName(single).join(joined, "group", "left").select("name", F.coalesce("more", "group").alias("entity"))


def p4_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with other spellings, and the spelling that stands for its entity."""
    return same_names(typed_names(document_nodes(spark, sf_dir), chunk_nodes(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = p4_names(spark, sf_dir)
    a, b = groups.select("entity", F.col("name").alias("name_a")), groups.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


QUERIES = {"p4_found": p4_found, "p4_names": p4_names}
