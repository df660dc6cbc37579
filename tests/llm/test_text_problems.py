"""Problems on texts: exact round trips, brute force, held-out accuracy and odd inputs."""

from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import answer_defects, eval_leaks, main_content, mojibake, scan_repair, split_oversized, token_ids
from lodestrata.tables import table

DOCS = "doc_id bigint, source string, text string, restored string, key string, scan boolean"


def docs(spark, *texts, source="file:x"):
    return spark.createDataFrame([(i, source, t, "own", "own", None) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   \n\n", "ok", "ok", "a" * 30_000, "🇦🇶 x́y‍ 核数 \t\r\n\f" * 50, "'s 'll don't  \n  end  "]


@pytest.fixture(scope="module")
def corpus(small):
    table = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "source", "text"])
    return list(zip(*(c.to_pylist() for c in table.columns)))


# ---- token ids


def test_texts_come_back(spark, corpus):
    texts = [*(t for *_, t in corpus), *ODD, "<|endoftext|>", "\x00\x7f"]
    encoded = token_ids.encode_texts(docs(spark, *texts))
    assert {r.doc_id: r.text for r in token_ids.decode_ids(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6]), (4, [0, 1])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in token_ids.decode_ids(odd).collect()} == {1: "", 2: "", 3: "", 4: '!"'}


def test_ids_equal_the_libraries(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{token_ids.TOKENIZER_DIR}/{token_ids.VOCABULARY}")
    library.encode_special_tokens = True
    rng = random.Random(5)
    noise = ["".join(rng.choice("abcAB 01'\n\té漢🙂  ́_<|>") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts = [*(t for *_, t in corpus), *ODD, *noise, "<|endoftext|> is text", "".join(rng.choice("etaoinshrdlu") for _ in range(6_000))]
    found = {r.doc_id: r.ids for r in token_ids.encode_texts(docs(spark, *texts)).collect()}
    for i, text in enumerate(texts):
        assert found[i] == library.encode(text or "", add_special_tokens=False).ids, repr(text)[:80]


def test_ids_of_no_rows(spark):
    assert token_ids.encode_texts(docs(spark)).collect() == []


# ---- mojibake


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp850"])
def test_garbled_and_restored(page):
    restore = mojibake.make_restorer()
    for text in ["Größe: 5 € – „Übung“", "D’après la façade où l’œuvre", "¿Por qué el año?", "Cašwodosi, 12 °C"]:
        try:
            garbled = text.encode().decode(page)
        except UnicodeDecodeError:
            continue
        assert restore(garbled) == text
        assert restore("plain " + garbled + " plain") == "plain " + text + " plain"


def test_twice_garbled_and_cyrillic():
    restore = mojibake.make_restorer()
    text = "Größe – né à l’été"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert restore(twice) == text
    assert restore("йlиve coыte 99 Ђ, здоровье") == "élève coûte 99 €, здоровье"


def test_garbled_many_times():
    restore = mojibake.make_restorer()
    text = garbled = "D’après l’élève, ça coûte 44 € – voilà"
    page = {byte: char for char, byte in mojibake._byte_of("cp1252").items() if not "\x80" <= char <= "\x9f" or byte in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    for _ in range(6):
        garbled = "".join(page.get(b, chr(b)) for b in garbled.encode())
    assert restore(garbled) == text


@pytest.mark.parametrize("page", ["cp1250", "iso8859_2", "cp1251", "koi8_r", "cp1254"])
def test_other_single_byte_pages(page):
    restore, suspect = mojibake.make_restorer(), mojibake.make_suspect()
    for text in ["D’après elle, l’élève a coûté 44 € à Lille où l’œuvre est déjà prête.", "¿Por qué el año pasado, según él?"]:
        garbled = text.encode("cp1252").decode(page)
        assert restore(garbled) == text and (garbled == text or suspect(garbled))


def test_sound_texts_stay(spark, corpus):
    restore, suspect = mojibake.make_restorer(), mojibake.make_suspect()
    for text in ["ILHA DA MAÇÃ, PÃO E CHÃO", "“CAFÉ” – ÂGE DU CHÊNE", "Íñigo ÉTÉ’ Ñ”", "здоровье как есть", "записи и файл а также", "revi¬\nsed", "Dvořák, Łódź, Wałęsa, Gdańsk", "W Gdańsku był mróz, więc także Łódź", "ZZZ   …   3", "2³ ± 5 m², a·b", "Ä“Ö", "核数审"]:
        assert restore(text) == text
        assert not suspect("plain ascii")
    found = mojibake.restore_texts(docs(spark, *ODD, "a�b")).collect()
    assert [r.garbled for r in sorted(found, key=lambda r: r.doc_id)] == [False] * len(ODD) + [True]
    assert {r.doc_id: r.restored for r in found} == dict(enumerate([*ODD, "a�b"]))
    assert mojibake.restore_texts(docs(spark)).count() == 0


def test_suspects_hold_all_hits(corpus):
    restore, suspect = mojibake.make_restorer(), mojibake.make_suspect()
    for _, _, text in corpus:
        if text and restore(text) != text:
            assert suspect(text)


# ---- leaks


def test_myers_equals_the_table():
    def table(pattern, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern):
            new = [i + 1]
            for j, x in enumerate(text):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(min(row), len(pattern))

    rng = random.Random(1)
    for _ in range(400):
        p = [rng.choice("abcd") for _ in range(rng.randrange(1, 14))]
        t = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
        assert eval_leaks.myers_least(p, t) == table(p, t)


def test_leaks_with_changes(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    items = spark.createDataFrame([(7, item, "x"), (8, "too short", "x"), (9, None, "x")], "item_id bigint, text string, run string")
    changed = words[5:17]
    changed[3] = "other"
    texts = ["zz " + ", ".join(words[3:15]).upper() + " zz", " ".join(words[3:14]), " ".join(changed), " ".join(words[20:26] + ["x", "y"] + words[26:31]), *ODD, "zz " + ", ".join(words[3:15]).upper() + " zz"]
    for held in (0, 100):  # joined by hash, held by the tasks
        found = {(r.doc_id, r.item_id): r.distance for r in eval_leaks.find_leaks(docs(spark, *texts), items, held_items=held).collect()}
        assert found == {(0, 7): 0, (1, 7): 1, (2, 7): 1, (len(texts) - 1, 7): 0}
    assert eval_leaks.find_leaks(docs(spark), items).count() == 0
    assert eval_leaks.find_leaks(docs(spark, item), items.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark, small, corpus):
    items = pq.read_table(f"{small}/eval_items.parquet")
    grams: dict = {}
    for i, t in zip(items["item_id"].to_pylist(), items["text"].to_pylist()):
        w = eval_leaks.words_of(t)
        for a in range(len(w) - 11):
            grams.setdefault(tuple(w[a : a + 12]), set()).add(i)
    truth = set()
    for d, _, t in corpus:
        w = eval_leaks.words_of(t)
        truth |= {(d, i) for a in range(len(w) - 11) for i in grams.get(tuple(w[a : a + 12]), ())}
    assert truth == {(r.doc_id, r.item_id) for r in eval_leaks.p9_found(spark, small).collect()}


def test_joined_items_equal_held_ones(spark, small):
    documents, items = table(spark, small, "documents"), table(spark, small, "eval_items")
    held = {(r.doc_id, r.item_id, r.distance) for r in eval_leaks.find_leaks(documents, items).collect()}
    assert held and held == {(r.doc_id, r.item_id, r.distance) for r in eval_leaks.find_leaks(documents, items, held_items=5).collect()}


def test_leaks_need_the_distance(spark, small, monkeypatch):
    monkeypatch.setattr(eval_leaks.LeakFinder, "_distance", lambda *_: eval_leaks.PASSAGE)
    finder = eval_leaks.LeakFinder([" ".join(f"w{i}" for i in range(30))])
    assert finder.find(" ".join(f"w{i}" for i in range(30))) == []


# ---- splitting


def check_pieces(text, limit, overlap):
    found = list(split_oversized.pieces(text, limit, overlap))
    assert all(len(p) <= limit for _, p in found) and found[0][0] == 0
    out = found[0][1]
    for (a, x), (b, y) in zip(found, found[1:]):
        assert a + len(x) - b == overlap and x[-overlap:] == y[:overlap]
        out += y[overlap:]
    assert out == text


def test_natural_boundaries():
    # white space of any length after a paragraph, scripts without spaces, marks that belong to a letter
    text = "a " * 200 + "end of it.\n\n" + " " * 100 + "b " * 200
    assert text.index("b ") in split_oversized.cut_points(text, 600, 20)
    wide = "これは文です。" * 100
    assert all(wide[e - 1] == "。" for e in split_oversized.cut_points(wide, 100, 10))
    joined = "x" * 95 + "e\u0301" * 60
    assert all(joined[e - 1] != "e" for e in split_oversized.cut_points(joined, 96, 0))
    assert split_oversized.atoms("." * 50_000 + "x", 100_000) == [(50_001, split_oversized.WORD)]
    check_pieces("wort " + "　" * 500 + "ende", 100, 10)


def test_pieces(corpus):
    rng = random.Random(3)
    odd = ["x" * 9_000, "a b " * 3_000, "\n\n".join(["word " * 300] * 9), "ab" * 30 + " " + "y" * 5_000, " " * 5_000, "short. " * 20 + "z" * 4_000 + "\n\nend"]
    noise = ["".join(rng.choice("ab. ,\n") for _ in range(rng.randrange(200, 2_000))) for _ in range(60)]
    for text in [*(t for *_, t in corpus if t), *odd, *noise]:
        for limit, overlap in ((4_000, 200), (130, 40), (90, 0)):
            if len(text) > limit and overlap:
                check_pieces(text, limit, overlap)


def test_natural_cuts():
    text = "First sentence here. Second one follows.\n\nA new paragraph starts. It goes on for a while."
    ends = split_oversized.cut_points(text, 60, 10)
    assert text[: ends[0]].endswith("\n\n")


def test_split_rows(spark):
    items = spark.createDataFrame([("a", "document", "word " * 100, 1), ("a", "document", "word " * 100, 1), ("b", "document", None, 1), ("c", "document", "", 1), ("d", "other", "word " * 100, 1), ("e", "document", "é" * 50, 1)], "id string, kind string, text string, piece int")
    limits = spark.createDataFrame([("document", 50, 5), ("document", 50, 5)], "kind string, max_chars int, overlap_chars int")
    assert {r.id for r in split_oversized.split_oversized(items, limits).collect()} == {"a"}
    assert split_oversized.split_oversized(items.limit(0), limits).count() == 0


# ---- answers


TONGUES = answer_defects.Languages()


@pytest.fixture(scope="module")
def field(small):
    table = pq.read_table(f"{small}/qa.parquet", columns=["question", "answer"])
    pairs = sorted({(q, a) for q, a in zip(*(c.to_pylist() for c in table.columns)) if q and a})
    return pairs, answer_defects.ChainField.fit(*answer_defects.training_set(pairs, TONGUES))


def test_held_out_defects(field):
    pairs, model = field
    sound = [(q, a) for q, a in pairs if answer_defects.defect_of(model, TONGUES, q, a)[0] is None and len(a.split()) > 10]
    rng = random.Random(2)
    right = total = 0
    for q, a in sound:
        cases = [(q, "truncated", " ".join(a.split()[: rng.randrange(7, len(a.split()) - 1)]).rstrip(".,;!?")), (q, "copy", q), (q, "refusal", rng.choice(answer_defects.REFUSALS)), (q, "empty", rng.choice(["", " ", "N/A", "null", "-", None])), (q, None, q + " " + a)]
        for question, defect, answer in cases:
            total += 1
            right += answer_defects.defect_of(model, TONGUES, question, answer)[0] == defect
    assert total > 50 and right / total >= 0.93


def test_fresh_wordings(field):
    model = field[1]
    for q, a, defect in [
        ("Did the ferry run?", "No.", None), ("Did the ferry run?", "No. Sorry to say, the ferry from Sorrin was cancelled; Ann refused to sail without the part.", None), ("How many?", "459 metres", None),
        ("What limits the crew?", "The crew cannot enter the hall before the water falls below 60 cm.", None), ("Was geschah am 3. Mai?", "Niemand wusste, warum die Boje am 3. Mai den Hafen erreichte.", None),
        ("What is it?", "I am sorry, but I cannot answer that.", "refusal"), ("Qui a signé le plan ?", "Je suis désolé, mais je ne peux pas répondre à cette question.", "refusal"), ("¿Quién firmó?", "Lo siento, no puedo ayudar con eso.", "refusal"),
        ("Who signed the plan of the northern gate?", "WHO SIGNED THE PLAN OF THE NORTHERN GATE?", "copy"), (None, "[no answer]", "empty"),
    ]:
        assert answer_defects.defect_of(model, TONGUES, q, a)[0] == defect, (q, a)


def test_defect_in_the_tail_of_a_long_answer(field):
    model = field[1]
    sound = [f"The clerk of the mill noted {n} sheets in the ledger before noon." for n in range(2, 42)]
    defect, tagged = answer_defects.defect_of(model, TONGUES, "What did the clerk do?", " ".join(sound))
    assert defect is None and [t for _, t in tagged] == ["answer"] * 40
    foreign = [f"Der Müller hat {n} Blätter in der Kammer gefunden und nicht gelesen." for n in range(2, 29)]
    defect, tagged = answer_defects.defect_of(model, TONGUES, "What did the clerk do?", " ".join(sound[:13] + foreign))
    assert defect == "language" and [t for _, t in tagged] == ["answer"] * 13 + ["foreign"] * 27
    tags = [t for _, t in answer_defects.defect_of(model, TONGUES, "What did the clerk do?", " ".join(sound[:30] + foreign[:10]))[1]]
    assert tags == ["answer"] * 30 + ["foreign"] * 10


def test_defects_of_odd_rows(spark, small):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (3, "What?", "word " * 20_000 + ".", "x"), (4, "What?", "...", "x"), (4, "What?", "...", "x"), (5, None, "A sound answer stands here.", "x")]
    pairs = spark.createDataFrame(rows, "pos bigint, question string, answer string, tags string")
    found = [(r.pos, r.defect) for r in answer_defects.answer_defects(pairs).collect()]
    assert sorted(p for p, _ in found) == [1, 2, 3, 4, 4, 5] and {p for p, d in found if d == "empty"} == {1, 2, 4}
    assert answer_defects.answer_defects(pairs.limit(0)).count() == 0


def test_profiles_teach_a_language():
    rng = random.Random(3)
    words = {"xa": ["qolo", "vintu", "baraz"], "xb": ["tumi", "sarok", "peldu"]}
    texts = [(lang, " ".join(rng.choice(words[lang]) if rng.random() < 0.6 else f"n{'abcdefgh'[rng.randrange(8)]}{'klmnop'[rng.randrange(6)]}" for _ in range(40))) for lang in words for _ in range(60)]
    found = answer_defects.language_profiles([*texts, ("xc", "one alone")])
    assert {lang: set(w) <= found[lang] for lang, w in words.items()} == {"xa": True, "xb": True} and "xc" not in found
    tongues = answer_defects.Languages(found)
    assert tongues.of("baraz qolo vintu nak")[0] == "xa" and tongues.of("tumi nak sarok")[0] == "xb" and tongues.of("")[0] == ""


# ---- pages

PAGE = "Menu\nHome | News | Help\nHome > News > A find at Lofield\nA find at Lofield\n" + "\n".join(
    [f"The old kiln at Lofield held {n} sheets, and the clerk of the mill noted every one of them in the ledger before noon. Nobody had read them since the winter of that year." for n in range(3)]
)
PAGE += "\nAdvertisement\nA second room\n" + "- a tray of pins (12 pages)\n" + "The second room was shut for years, and the few who had seen it said that the shelves went up to the roof, where the rain came in." + "\n77 comments\nMost read\nA lamp at Sorrin\n- Two boats at Milton\n© 2020 Notes"


SHOWN = frozenset(main_content.line_key(s) for s in ("Menu", "Advertisement", "12 comments", "Most read", "© 2019 Notes"))


def test_page():
    lines = PAGE.split("\n")
    found = {lines[i] for i in main_content.furniture_lines(PAGE, SHOWN)}
    assert found == {"Menu", "Home | News | Help", "Home > News > A find at Lofield", "Advertisement", "77 comments", "Most read", "A lamp at Sorrin", "- Two boats at Milton", "© 2020 Notes"}


def test_furniture_is_learned_from_repetition(spark):
    """Lines that a site repeats, and lines that several sites repeat, are furniture in whatever wording; each page here has its own article."""
    rng = random.Random(4)
    body = lambda: "\n".join(" ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(18)) + "." for _ in range(4))
    title = lambda: "A story of " + "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(10 * site + page, f"https://s{site}.example", f"Zork {site}\nGlorp\n{title()}\n{body()}\nFnord {page}\nxyzzy things") for site in range(4) for page in range(5)]
    rows += [(100, "https://lone.example", f"Glorp\nA lone story\n{body()}\nFnord 8")]
    pages = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for r in main_content.page_furniture(pages).collect():
        assert r.furniture == ([0, 6] if r.doc_id == 100 else [0, 1, 7, 8])


def test_pages_of_odd_rows(spark):
    rows = docs(spark, *ODD, PAGE, PAGE, source="https://a.example")
    found = {r.doc_id: r for r in main_content.page_furniture(rows).collect()}
    assert len(found) == len(ODD) + 2 and found[0].furniture == [] and found[0].main is None
    assert "Home > News" not in found[len(ODD)].main and "A second room" in found[len(ODD)].main
    assert main_content.page_furniture(docs(spark)).count() == 0


def test_line_keys_as_spark(spark):
    for line in ["Viewed 12 times", "  Über uns ", "a\tb", "12", "© 2019 x 7", "Men\ufffd", "меню 7", "é"]:
        assert spark.createDataFrame([(line,)], "s string").select(main_content._template(F.col("s")).alias("h")).first().h == main_content.line_key(line)


def test_salted_join_is_the_same(spark, small, monkeypatch):
    plain = {(r.doc_id, r.line_no) for r in main_content.p7_found(spark, small).collect()}
    monkeypatch.setattr(main_content, "BROADCAST_LINES", -1)
    assert plain == {(r.doc_id, r.line_no) for r in main_content.p7_found(spark, small).collect()}


# ---- scans


@pytest.fixture(scope="module")
def models(corpus):
    return scan_repair.train([t for _, s, t in corpus if not s.startswith("scan:") and t and len(t) > 600])


def test_held_out_pages(models, corpus):
    rng = random.Random(99)
    examples = scan_repair.page_examples([t for _, s, t in corpus if s.startswith("file:") and t and len(t) > 600][::3], rng)
    right = sum(models[0].best(candidates[0][1], scan_repair.LINE_KINDS) == scan_repair.LINE_KINDS[at] for candidates, at in examples)
    assert right / len(examples) > 0.95


def test_damage_of_any_kind(spark, corpus):
    """Words with one edit of any letter, or many of the usual confusions, are repaired if texts have them; nothing becomes a wrong word."""
    rows = [(d, s, t, t, "k", None) for d, s, t in corpus]
    trained = scan_repair._Trained(docs(spark).unionByName(spark.createDataFrame(rows, DOCS)).withColumn("scan", F.coalesce(F.lower("source").startswith("scan:"), F.lit(False))))
    words = [r.word for r in trained.counts.where("sound >= 20 AND length(word) >= 8 AND word RLIKE '^[a-z]+$'").orderBy("word").limit(150).collect()]
    rng = random.Random(1)
    cases = {scan_repair._any_edit(w, rng)[0]: w for w in words} | {scan_repair._spoil_word(scan_repair._spoil_word(w, rng)[0], rng)[0]: w for w in words}
    cases = {x: w for x, w in cases.items() if x != w}
    fixed = {r.word: r.fixed.lower() for r in scan_repair.word_repairs(spark.createDataFrame([(x,) for x in cases], "word string"), trained).collect()}
    right = sum(fixed.get(x) == w for x, w in cases.items())
    assert right >= 0.85 * len(cases) and len(fixed) - right <= 0.02 * len(cases)


def test_operations():
    assert scan_repair.operations("tkrough", "through") == ("replace",) and scan_repair.operations("leter", "letter") == ("insert",) and scan_repair.operations("houose", "house") == ("delete",)
    assert scan_repair.operations("cornrnunicatiori", "communication") == ("rn>m", "rn>m", "ri>n") and scan_repair.operations("abcdef", "uvwxyz") is None
    assert scan_repair.skeleton("cornrnunicatiori") == scan_repair.skeleton("communication")


def test_repair(spark):
    sound = ["The clerk of the northern mill noted every sheet of the ledger, and the harbour crane stood idle through the winter months." + f" Room {i} was shut." + " The weaving hall and the finishing press were listed beside the dye recipe." * 8 for i in range(30)]
    scan = "The Northern Mill Society\nThe clerk of the northern mill noted every sheet of the led-\nger, and the harbour crane stood idle through the wintcr\n12\nmonths. The weaving hall and the finishing press were listed\nThe Northern Mill Society\nbeside the dye recipe.\n13"
    rows = docs(spark, *sound).unionByName(spark.createDataFrame([(100, "scan:y", scan, "", "", None), (101, "scan:y", None, "", "", None), (102, "scan:y", "", "", "", None), (103, "scan:y", "ok", "", "", None), (100, "scan:y", scan, "", "", None)], DOCS))
    payloads = spark.createDataFrame([], "path string, ocr boolean, doc_id bigint")
    found = {(r.doc_id, r.kind) for r in scan_repair.scan_traces(rows, payloads).collect()}
    assert found == {(100, k) for k in ("hyphenation", "characters", "header", "page_number")}
    texts = {r.doc_id: r.text for r in scan_repair.repaired_texts(rows, payloads).collect()}
    assert texts[100] == "The clerk of the northern mill noted every sheet of the ledger, and the harbour crane stood idle through the winter months. The weaving hall and the finishing press were listed beside the dye recipe."
    assert texts[101] is None and texts[103] == "ok"


def test_scans_of_no_rows(spark):
    payloads = spark.createDataFrame([], "path string, ocr boolean, doc_id bigint")
    assert scan_repair.scan_traces(docs(spark), payloads).count() == 0


def test_edits_reach_the_right_word():
    for wrong, right in [("whee1", "wheel"), ("Tucornbe", "Tucombe"), ("tbat", "that"), ("biidget", "budget"), ("s@mples", "samples"), ("Zähliing", "Zählung"), ("certiﬁed", "certified"), ("bypassecl", "bypassed"), ("R0sb@keon", "Rosbakeon")]:
        assert right in scan_repair.edits(wrong), wrong
    assert not re.search(r"[A-Z]", "".join(scan_repair.edits("wu5ste")))
