"""Operators for training text: brute force, exact round trips and edge cases on small inputs."""

from __future__ import annotations

import datetime
import os
import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import oracle
from pagemill.functions.tokens import estimate
from pagemill.llm import language, leaks, lookalike, pack, privacy, registry, scanned, spam, split, truncation
from pagemill.llm.arrow import code_points
from pagemill.llm.langs import guess, label
from pagemill.llm.latest import latest_texts

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CHUNKS = "run_id string, chunk_id string, doc_id string, content string, metadata struct<part_index int, part_count int>, written_at timestamp, extra string"
GATE = "run_id string, issue_no int, doc_id string, message string, evidence struct<missing_samples array<string>>, stats struct<semantic_output_language string>, extra string"


def model() -> lookalike.LetterModel:
    counts = np.zeros((3, 64, 64))
    for word in "the second form office under corner account of notes letter copy person".split():
        for a, b in zip(word, word[1:]):
            counts[0, ord(a) - 97, ord(b) - 97] += 50
    return lookalike.LetterModel(counts)


def tokens(text: str) -> int:
    wide = sum(0x3000 <= ord(c) <= 0x303F or 0x3400 <= ord(c) <= 0x4DBF or 0x4E00 <= ord(c) <= 0x9FFF or 0xFF00 <= ord(c) <= 0xFFEF for c in text)
    return estimate(wide, len(text) - wide)


# 1 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ("", ""), ("plain", "plain"), ("Ｆｏｒｍ　１２", "Form 12"), ("o​f­f﻿ice", "office"), ("a b c", "a b c"), ("café", "café"), ("ﬁle", "file"), ("tеrm оf", "term of"),
        ("⼈理", "人理"), ("FN‑2490", "FN-2490"), ("x² ½ ①", "x² ½ ①"), ("A  b\nC", "A  b\nC"), ("ｶﾞ", "ガ"), ("Жук", "Жук"), ("e​́", "é"),
    ],
)
def test_canonical(dirty, clean):
    assert lookalike.canonical(dirty, model()) == clean


def test_script_of_real_words_stays():
    assert lookalike.canonical("это русский текст, сор и нос", model()) == "это русский текст, сор и нос"


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_canonical_is_stable(text):
    once = lookalike.canonical(text, model())
    assert lookalike.canonical(once, model()) == once and unicodedata.normalize("NFC", once) == once


def chunks(spark, rows):
    return spark.createDataFrame([(r, c, d, t, None, None, "x") for r, c, d, t in rows], CHUNKS)


def gate(spark, rows):
    return spark.createDataFrame([(r, i, "d", m, (s,), (lang,), "x") for r, i, m, s, lang in rows], GATE)


def test_look_alike_pairs(spark):
    c = chunks(spark, [("r1", "c1", "d", "the office form"), ("r2", "c1", "d", "the of​fice form"), ("r2", "c1", "d", "the of​fice form"), ("r3", "c1", "e", "the office form"), ("r1", "c2", "d", None), ("r1", "c3", "d", ""), ("r2", "c9", None, "the office form")])
    g = gate(spark, [("r1", 1, "", ["of­fice", "office", None, "", "absent"], None), ("r9", 1, "", ["office"], None), ("r1", 2, "", None, None)])
    got = {tuple(r) for r in lookalike.look_alike_pairs(c, g, np.zeros(3 * 64 * 64)).collect()}
    assert got == {("r1/c1", "r2/c1"), ("r1/c1", "r1/sample/1/0")}
    assert lookalike.look_alike_pairs(c.limit(0), g.limit(0), np.zeros(3 * 64 * 64)).count() == 0
    classes = lookalike.look_alike_classes(lookalike.looked_at(c, g, np.zeros(3 * 64 * 64))).collect()
    assert sorted(r["item"] for r in classes) == ["r1/c1", "r2/c1"] and len({r["raw"] for r in classes}) == 2
    with pytest.raises(ValueError, match="exists"):
        lookalike.canonicalise(c, "content", "extra", np.zeros(3 * 64 * 64))


def test_large_run_is_dealt_into_pieces(spark, monkeypatch):
    """One run with most rows: sent samples, shuffled samples in pieces and in blocks with an automaton give the same pairs."""
    dirty = lambda i: f"the of\u200bfice keeps form {i} for the year"
    c = chunks(spark, [("hot", f"c{i}", "d", dirty(i)) for i in range(60)] + [("r2", "c1", "e", dirty(3)), (None, "c1", "e", "the office")])
    g = spark.createDataFrame([("hot", i, "d", "", ([f"the office keeps form {k}" for k in range(i, i + 20)],), (None,), "x") for i in range(0, 60, 20)] + [(None, 1, "d", "", (["office"],), (None,), "x")], GATE)
    find = lambda: sorted(map(tuple, lookalike.look_alike_pairs(c, g, np.zeros(3 * 64 * 64)).collect()))
    want = find()
    assert len(want) >= 60
    monkeypatch.setattr(lookalike, "SENT", 0)
    monkeypatch.setattr(lookalike, "PIECES", 4)
    assert find() == want
    monkeypatch.setattr(lookalike, "BLOCK", 40)
    monkeypatch.setattr(lookalike, "MANY", 5)
    assert find() == want


# 2 ------------------------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": ["The office keeps the form until the end of the month.", "Please send the copy to the second reader of the list.", "If the request is late, it is handled in the following week."],
    "de": ["Die Stelle schickt eine Kopie an die zweite Lesung.", "Der Antrag ist bis zum Ende des Monats abzugeben.", "Wenn die Liste nicht vollständig ist, wird sie zurück geschickt."],
    "fr": ["Le service envoie une copie de la liste au demandeur.", "La demande doit parvenir avant la fin du mois.", "Si le dossier est incomplet, il est renvoyé à son auteur."],
    "zh-TW": ["申請人應於月底前將表格送交總務室。", "各單位應逐行比對原頁並於簿冊註明。", "逾期案件一律順延至次週處理。"],
    "ja": ["申請者は月末までに書類を窓口に提出してください。", "担当者は台帳の内容を一行ずつ確認します。", "期限を過ぎた申請は翌週に処理されます。"],
}


def test_language_on_held_out_sentences():
    texts, labels = [], []
    for k, lang in enumerate(language.LANGS):
        for s in SENTENCES[lang][:2]:
            texts += [language.letters(s)] * 3
            labels += [k] * 3
    coefficients = language.fit(texts, labels)
    held = [language.letters(SENTENCES[lang][2]) for lang in language.LANGS]
    assert language.score(held, coefficients).argmax(1).tolist() == list(range(5))
    # the sparse product is that of the dense kernel
    a = language._dense(held) @ coefficients
    assert np.allclose(a, language.score(held, coefficients), atol=1e-4)


def test_units():
    made = language.units("## Kopf der Seite\n\nThe office keeps the form. Please send it.\n- list entry one.\nName: X\n> Le service envoie une copie.\nThis one stops in the")
    assert [u for u, whole in made if whole] == ["The office keeps the form.", "Please send it.", "Le service envoie une copie."] or [u for u, whole in made if whole][:2] == ["The office keeps the form.", "Please send it."]
    assert language.units("") == [] and guess("") == "en"


def test_short_sentences():
    assert [language._size(u, language.letters(u)) for u in ("Bitte warten Sie.", "Bitte warten Sie am Tor.", "請稍候片刻。", "請稍候片刻再來。", "Ms.", "of the office.", "Name is A.")] == [1, 2, 1, 2, 0, 0, 0]


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("zh_TW",), ("und",), ("",), (None,), ("ja-JP",), ("traditional_chinese",)], "x string")
    assert [r[0] for r in df.select(label("x")).collect()] == ["en", "zh-TW", None, None, None, "ja", "zh-TW"]


# 3 ------------------------------------------------------------------------------------------------------------------


def decoder() -> scanned.Decoder:
    counts, shapes = {}, {}
    for word in "the reader returns every file of department to office and notes reason in log whenever storage is opened onward second".split():
        counts[scanned._key(scanned._word_value(word), scanned._WORD_SALT)] = 5000
        shapes[scanned._shape_key(word)] = 5000
    for text in ("申請人應將表格送交", "單位應核對", "複核人員"):
        for a, b in zip(text, text[1:]):
            counts[scanned._key(ord(a) << 21 | ord(b), scanned._PAIR_SALT)] = 5000
    title = scanned._key(scanned._word_value(scanned.title_key("Guide to overtime")), scanned._TITLE_SALT)
    keyed = lambda x: scanned.Keyed(np.array(list(x), dtype=np.uint64), np.array(list(x.values()), dtype=np.float64))
    return scanned.Decoder(scanned.Lexicon(keyed(counts), keyed(shapes), 0.2, 10, 5000.0 * len(counts)), {title})


@pytest.mark.parametrize(
    ("noisy", "clean"),
    [
        ("", ""),
        ("the reader returns\nthe file to thc office.", "the reader returns the file to the office."),
        ("the sec-\nond reader opened every sto‐\nrage.", "the second reader opened every storage."),
        ("the reader returns\npage 55\nGuide to overtime\nthe file.", "the reader returns the file."),
        ("申諳人應將裹格\n送交", "申請人應將表格送交"),
        ("複 該 人 員 應 核 對 單 位", "複核人員應核對單位"),
        ("## Head\n\n- 8 of them\n- entry\n\n| a | b |", "## Head\n\n- 8 of them\n- entry\n\n| a | b |"),
    ],
)
def test_repair(noisy, clean):
    assert decoder().repair(noisy).text == clean


def test_clean_text_is_no_case():
    for text in ("the reader returns\nthe file to the office.", "## A\n\nthe reader returns every file.\n\n1. log\n2. file", "見第17頁的簽核欄。"):
        assert not decoder().repair(text).noisy


def test_repair_keeps_rows(spark):
    df = spark.createDataFrame([(1, "the file."), (2, None), (3, ""), (4, "the " * 20000)], "k int, content string")
    done = scanned.repair(df, "content", *scanned.corpus_counts(df, "content")).orderBy("k").collect()
    assert [r["repaired"] for r in done][1:3] == [None, ""] and len(done) == 4
    assert scanned.repair(df.limit(0), "content", *scanned.corpus_counts(df.limit(0), "content")).count() == 0


@pytest.mark.parametrize(
    ("noisy", "clean"),
    [
        ("The depart\nment notes the reason.", "The department notes the reason."),
        ("The depart ment notes the reason.", "The department notes the reason."),
        ("The depa\nrtm\nent notes the reason.", "The department notes the reason."),
        ("The depa-\nrtm-\nent notes the reason.", "The department notes the reason."),
        ("The dcpart\nment notes the reason.", "The department notes the reason."),
        ("The readerreturns every file.", "The reader returns every file."),
        ("The reader returns\nevery file on\nward.", "The reader returns every file onward."),
    ],
)
def test_joined_and_split_words(noisy, clean):
    done = decoder().repair(noisy)
    assert done.text == clean and done.noisy


def test_words_that_stand():
    text = "The reader\nreturns the\nfile to the office and second file."
    assert decoder().repair(text).text == text.replace("\n", " ") and not decoder().repair(text).noisy


def test_long_paragraph_stays_whole():
    lines = ["the reader returns every file to the office and"] * 450
    assert decoder()._paragraphs(lines) == [lines]


def test_counts_of_absent_words_are_zero(spark):
    # 30,000 words would fill 2^20 cells so that about 3 in 100 made-up words fall into the cell of one of them
    letters = "abcdefghij"
    made = ["k" + "".join(letters[int(d)] for d in f"{i:05d}") for i in range(30_000)]
    df = spark.createDataFrame([(" ".join(made[k : k + 1000]),) for k in range(0, 30_000, 1000)] + [("## A head\n申請",)], "content string")
    lexicon, heads = scanned.corpus_counts(df, "content")
    d = scanned.Decoder(lexicon, {r["key"] & (1 << 64) - 1 for r in heads.collect()})
    assert all(d.n(w) == 1 for w in made[::100]) and d.pair("申", "請") == 1 and d._is_title("A head")
    assert not any(d.n("z" + w[1:]) for w in made[:3000]) and not any(d._is_title("T " + w) for w in made[:3000])


@pytest.mark.parametrize(("a", "b"), scanned.CONFUSED)
def test_readings_keep_their_shape(a, b):
    assert scanned._shape_key(f"wo{a}rds") == scanned._shape_key(f"wo{b}rds")


def test_shapes_of_a_text(spark):
    words = ["mmodern", "window", "il1", "café", "x" * 700, "a"]
    flat, _ = code_points([" ".join(w for w in words if w.isalpha())])
    low = scanned._LOWER[flat]
    letter = low > 0
    start = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
    length = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1 - start
    assert scanned._shape_keys(low, start, length).tolist() == [scanned._shape_key(w) for w in words if w.isalpha()]


def test_verdicts_do_not_depend_on_the_rest_of_the_vocabulary(spark):
    """A corpus with 100 times as many foreign words, each as frequent as a word must be to be a reading, changes nothing."""
    own = ["the reader returns every file to the office and the department notes the reason in the log. " * 40] * 20
    noisy = ["the rcader returns evcry file to thc office.", "the depart\nment notes the reason.", "the readerreturns every file.", "the reader returns\nthe file."]
    letters = "bdfghjkpqvwxyz"
    foreign = [" ".join(("z" + "".join(letters[(i // 14**k) % 14] for k in range(5)) + " ") * 9 for i in range(a, a + 500)) for a in range(0, 10_000, 500)]
    verdicts = []
    for more in ([], foreign):
        df = spark.createDataFrame([(k, x) for k, x in enumerate([*noisy, *own, *more])], "k int, content string")
        lexicon, heads = scanned.corpus_counts(df, "content")
        verdicts.append([tuple(r) for r in scanned.repair(df.where("k < 4"), "content", lexicon, heads).orderBy("k").collect()])
    assert verdicts[0] == verdicts[1] and all("thc" not in r[2] and "depart " not in r[2] for r in verdicts[0])


def test_running_heads_by_join_and_by_broadcast(spark, monkeypatch):
    """Headings beyond the bound are joined; both ways give one result, and a million foreign headings delete no line."""
    body = "the reader returns every file to the office and the department notes it\nGuide to overtime\n12\nand the reason is kept in the log of the office."
    df = spark.createDataFrame([(1, body), (2, "# Guide to overtime\n\n" + body.replace("Guide to overtime", "Guide to nothing")), (3, None), (4, body)], "k int, content string")
    lexicon, heads = scanned.corpus_counts(df, "content")
    foreign = spark.range(1_000_000).select((F.col("id") * 7919 * 7919).alias("key"))
    want = scanned.repair(df, "content", lexicon, heads).orderBy("k").collect()
    assert [r["furniture"] for r in want] == [2, 1, 0, 2] and "nothing" in want[1]["repaired"]
    assert scanned.repair(df, "content", lexicon, heads.union(foreign)).orderBy("k").collect() == want
    monkeypatch.setattr(scanned, "HEADS", 10)
    assert scanned.repair(df, "content", lexicon, heads.union(foreign)).orderBy("k").collect() == want


# 4 ------------------------------------------------------------------------------------------------------------------


def test_truncation(spark):
    rng = random.Random(1)
    words = "office form reader list copy month request reason".split()
    sentence = lambda: f"The {rng.choice(words)} goes to the {rng.choice(words)} with the {rng.choice(words)}."
    rows, cut_ids = [], set()
    for i in range(600):
        text = " ".join(sentence() for _ in range(6))
        if i % 20 == 7:
            text = text[: -rng.randint(4, 12)]
            cut_ids.add(f"c{i}")
        elif i % 20 == 9:
            text = text[:-9] + "..."
            cut_ids.add(f"c{i}")
        elif i % 5 == 1:
            text += "\n- signed form\n- reader list"
        rows.append(("r", f"c{i}", f"d{i}", text))
    c = chunks(spark, [*rows, ("r", "n", "d", None), ("r", "e", "d", " "), ("r", "h", "d", "0f" * 40)])
    found = truncation.truncated(c, gate(spark, [("r", 1, "Label check: 5 of 13 passed", None, None), ("r", 2, None, None, None)]))
    got = {r["item_id"] for r in found.where("cut").collect()}
    assert len(got & cut_ids) >= 0.9 * len(cut_ids) and len(got - cut_ids) <= 3 and not got & {"n", "e", "h"}
    assert truncation.MARK.sub("", "the floor pl [...]") == "the floor pl" and truncation.MARK.sub("", "done.") == "done."


def test_contexts_are_told_apart(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    ends = [word() for _ in range(20)]
    rows = [("r", f"c{i}", f"d{i}", f"{' '.join(word() for _ in range(3000))} {ends[i % 20]}") for i in range(60)]
    values = truncation.values_of(chunks(spark, rows), gate(spark, []))
    keys, n = truncation._count_ends(truncation._ends(values))
    # every context of a text that a value ends in, and no other, is counted
    suffixes = {e[-k:] for e in (" " + e for e in ends) for k in range(1, truncation.LONGEST + 1)}
    assert keys.size == len(suffixes) and n.sum() == 60 * truncation.LONGEST
    inside, closed = truncation._count_inside(values, truncation.Contexts(keys))
    texts = [r[3] for r in rows]
    assert inside.sum() == sum(t[max(0, i + 1 - k) : i + 1] in suffixes for t in texts for i in range(len(t) - 1) for k in range(1, 9) if i + 1 >= k)
    assert truncation.Contexts(keys).find(np.arange(1, 5000, dtype=np.uint64)).max() == -1 and not closed.any()


def test_rare_contexts_are_kept(spark):
    common, rare = ", ".join(map(str, range(1, 9))), ", ".join(map(str, range(11, 19)))
    ends = spark.range(1_200_000).selectExpr("string(id) doc_id", "0 col", "true usable", f"if(id = 7, array({rare}), array({common})) keys").withColumn("keys", F.col("keys").cast("array<bigint>"))
    keys, n = truncation._count_ends(ends)
    assert dict(zip(keys.tolist(), n.tolist())) == {k: 1_199_999 for k in range(1, 9)} | {k: 1 for k in range(11, 19)}


def test_blocks_of_contexts(spark, monkeypatch):
    rng = random.Random(3)
    words = "office form reader list copy month request reason".split()
    rows = []
    for i in range(300):
        text = " ".join(f"The {rng.choice(words)} goes to the {rng.choice(words)} with the {rng.choice(words)}." for _ in range(4)) + "\n- signed form" * (i % 5 == 1)
        rows.append(("r", f"c{i}", f"d{i}", text[: -rng.randint(4, 12)] if i % 20 == 7 else "ok" if i % 50 == 3 else text))
    values = truncation.values_of(chunks(spark, rows), gate(spark, [("r", 1, "Label check: 5 of 13 passed", None, None)]))
    whole, limits = truncation.scored(values)
    key = lambda r: (r["item_id"], r["col"])
    want = {key(r): r["log_odds"] for r in whole.collect()}
    monkeypatch.setattr(truncation, "MOST", 60)
    assert len(truncation._dealt(truncation._counted(truncation._ends(values)))) > 3
    dealt, same = truncation.scored(values)
    got = {key(r): r["log_odds"] for r in dealt.collect()}
    assert dealt.count() == whole.count() == 301 and got == want and same == limits


def test_copies_do_not_vouch_for_a_cut(spark):
    rng = random.Random(7)
    words = "office form reader list copy month request reason".split()
    sentence = lambda: f"The {rng.choice(words)} goes to the {rng.choice(words)} with the {rng.choice(words)}."
    texts = [" ".join(sentence() for _ in range(6)) for _ in range(300)]
    texts = [t[: -rng.randint(4, 12)] if i % 15 == 7 else t for i, t in enumerate(texts)]

    def found(copies: int) -> list[tuple[str, str]]:
        c = chunks(spark, [(f"r{k}", f"c{i}", f"d{i}/{k}", t) for k in range(copies) for i, t in enumerate(texts)])
        return sorted((r["run_id"], r["item_id"]) for r in truncation.truncated(c, gate(spark, [])).where("cut").collect())

    one = [item for _, item in found(1)]
    assert len({f"c{i}" for i in range(7, 300, 15)} & set(one)) >= 18
    assert found(8) == sorted((f"r{k}", item) for k in range(8) for item in one)


def test_long_contents_say_nothing_of_messages(spark):
    rng = random.Random(11)
    words = "office form reader list copy month request reason".split()
    messages = [f"{i} passages were not found in the text of the {rng.choice(words)}, so it may have lost them." for i in range(100, 400)]
    g = gate(spark, [("r", i, m[:-9] if i % 20 == 7 else m, None, None) for i, m in enumerate(messages)]).withColumn("doc_id", F.concat("doc_id", "issue_no"))

    def odds(sentences: int) -> dict[str, float]:
        c = chunks(spark, [("r", f"c{i}", f"c{i}", f"The {words[i % 8]} goes to the office. " * sentences) for i in range(100)])
        return {r["item_id"]: r["log_odds"] for r in truncation.scored(truncation.values_of(c, g))[0].where("col = 1").collect()}

    assert odds(1) == odds(40)


# 5 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("Write to a.b-c@mail.example, please.", "Write to [EMAIL], please."),
        ("Mail: x1 (at) post.test now", "Mail: [EMAIL] now"),
        ("ring +44 7700 900 853 in the morning", "ring [PHONE] in the morning"),
        ("電話：(02) 2044-2519 轉 12。", "電話：[PHONE]。"),
        ("holds passport no. X70564926 and", "holds passport no. [ID_NUMBER] and"),
        ("domain account NORVALE\\e12345.", "domain account [ID_NUMBER]."),
        ("Ms. Tavish Quillmere lives at Flat 2, 38 Kiln Lane, North Dunmere, NV 79603.", "Ms. [PERSON] lives at [ADDRESS]."),
        ("聯絡人：簡霽文 來信", "聯絡人：[PERSON] 來信"),
        ("二枚目は柊木澄江さんが確認", "二枚目は[PERSON]さんが確認"),
        ("包裹請寄至桐川市青榆區長汀街139號之37樓之2，謝謝", "包裹請寄至[ADDRESS]，謝謝"),
        ("an die Anschrift Rotbuchenweg 176b, 85500 Kesselbrunn.", "an die Anschrift [ADDRESS]."),
        ("Batch 5240105981 and order number 0395204587 on 2023-04-07, sum 45,550, file 22/4612", "Batch 5240105981 and order number 0395204587 on 2023-04-07, sum 45,550, file 22/4612"),
        ("The field for the telephone number is optional.", "The field for the telephone number is optional."),
        ("reach a​.b＠mail.example!", "reach [EMAIL]!"),
        ("", ""),
    ],
)
def test_masks(text, masked):
    assert privacy.mask(text, privacy.find(text)) == masked


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("Please ask John Smith about it.", "Please ask [PERSON] about it."),
        ("The invoice was paid by Maria Gonzales yesterday.", "The invoice was paid by [PERSON] yesterday."),
        ("My colleague Peter Brown said so.", "My colleague [PERSON] said so."),
        ("IBAN DE89 3704 0044 0532 0130 00 of the office", "IBAN [ID_NUMBER] of the office"),
        ("IBAN GB82WEST12345698765432.", "IBAN [ID_NUMBER]."),
        ("IBAN DE00 3704 is no account", "IBAN DE00 3704 is no account"),
        ("Card 4111 1111 1111 1111 expires", "Card [ID_NUMBER] expires"),
        ("He lives with Peter and so on.", "He lives with Peter and so on."),
    ],
)
def test_masks_without_cues(text, masked):
    assert privacy.mask(text, privacy.find(text)) == masked


def test_many_finds_take_linear_time():
    text = " ".join(f"call 030 {i:07d} now" for i in range(20_000))
    began = time.time()
    assert len(privacy.find(text)) == 20_000 and time.time() - began < 10


@given(st.text(alphabet="ab1@.\\() -+09聯絡人簡：Ｆ​́ＮMs", max_size=80))
@settings(max_examples=200, deadline=None)
def test_only_spans_change(text):
    spans = privacy.find(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


# 6 ------------------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="ab é。.\n#，表 ", min_size=1, max_size=900), st.integers(8, 60), st.integers(0, 40))
@settings(max_examples=120, deadline=None)
def test_pieces(text, limit, overlap):
    made = split.pieces(text, limit, overlap)
    assert made[0][1] == 0 and made[-1][2] == len(text) and all(x[2] == y[1] for x, y in zip(made, made[1:]))
    for k, (o, a, e) in enumerate(made):
        assert tokens(text[o:e]) <= limit and o <= a < e or len(text) == 0
        if k:
            assert o >= made[k - 1][0] and tokens(text[o:a]) <= min(overlap, limit // 2)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert oracle.compare(registry.queries()[name](spark, DATA), oracle.connection(DATA), registry.oracle_sql()[name]) == ""


def test_split_rows(spark):
    c = chunks(spark, [("r", "c1", "d", "One sentence here. " * 200), ("r", "c1", "d", "One sentence here. " * 200), ("s", "c2", "d", "short"), ("s", "c3", "d", None), ("q", "c4", "d", "x" * 5000)])
    runs = spark.createDataFrame([("r", '{"package": {"chunk_max_tokens": 100, "chunk_overlap_tokens": 10}}'), ("s", None), (None, None)], "run_id string, config_json string")
    rows = split.split_oversized(c, runs).orderBy("run_id", "part_index").collect()
    assert {r["run_id"] for r in rows} == {"r", "q"} and all(r["estimate"] <= (100 if r["run_id"] == "r" else 512) for r in rows)
    r = [x for x in rows if x["run_id"] == "r"]
    assert [x["part_index"] for x in r] == list(range(1, r[0]["part_count"] + 1)) and "".join(x["content"][x["overlap_chars"] :] for x in r) == "One sentence here. " * 200


def test_latest_delivery_is_split(spark):
    long, day = "One sentence here. " * 200, lambda k: datetime.datetime(2025, 1, k)
    rows = [("r", "a", long, day(1)), ("r", "a", "short", day(2)), ("r", "b", "short", day(1)), ("r", "b", long + "B", day(2)), ("r", None, long + "C", day(1)), ("r", None, long + "D", day(1)), ("r", None, "short", day(3)), ("r", "c", long, None)]
    c = spark.createDataFrame(rows, "run_id string, chunk_id string, content string, written_at timestamp")
    made = split.split_oversized(c, spark.createDataFrame([], "run_id string, config_json string")).where("part_index = 1").collect()
    assert sorted(r["parent_chunk_id"] or "" for r in made) == ["", "", "b", "c"]
    texts = {(r["chunk_id"], r["content"]) for r in latest_texts(c).collect()}
    assert texts == {("a", "short"), ("b", long + "B"), (None, long + "C"), (None, long + "D"), (None, "short"), ("c", long)}


# 7 ------------------------------------------------------------------------------------------------------------------


def test_pack(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 3, 50, 50, 50, 120, 333, 700, 1001, 2500]) + rng.randint(0, 9) for _ in range(3000)] + [50] * 2000
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(99999, None)], "id int, size int").repartition(5)
    rows = pack.pack(items, [(1, 1000), (2, 2048)]).collect()
    for pack_id, capacity in ((1, 1000), (2, 2048)):
        own = [r for r in rows if r["pack_id"] == pack_id]
        assert sorted(r["id"] for r in own) == sorted([*range(5000), 99999])
        assert all(r["oversized"] == (r["size"] > capacity) and r["container"] is not None for r in own)
        fill: dict[int, int] = {}
        for r in own:
            if not r["oversized"]:
                fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        alone = [r["container"] for r in own if r["oversized"]]
        assert len(set(alone)) == len(alone) and sorted({*fill, *alone}) == list(range(len(fill) + len(alone)))
        assert max(fill.values()) <= capacity and sum(fill.values()) >= 0.97 * capacity * len(fill)
    assert pack.pack(items.limit(0), [(1, 10)]).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack.pack(items, [(1, 0)])


# 8 ------------------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    evidence = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(6)]
    han = "".join(chr(rng.randint(0x4E00, 0x4E40)) for _ in range(80))
    items = [(i, "en", e) for i, e in enumerate(evidence)] + [(50, "zh-TW", han), (51, "en", "too short to leak"), (52, "en", None)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(vocabulary, k=60))
        e = evidence[i % 6].split()
        k = rng.randint(0, 20)
        docs.append((i, text + ", " + "; ".join(e[k : k + rng.randint(15, 20)]).upper() + " " + text if i % 2 else text))
    docs += [(500, "前" + "，".join(han[10:46]) + "後"), (501, "前" + han[10:45] + "後"), (502, None), (503, ""), (500, "前" + "，".join(han[10:46]) + "後")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks_of(df, spark.createDataFrame(items, "item_id long, lang string, expected_evidence string"), leaks.VERBATIM).where("leak").collect()}
    want = set()
    for d, text in docs:
        for i, lang, e in items:
            if e and text:
                import re

                a, b = (re.findall(r"[^\W_]+", leaks.plain(x)) for x in (text, e))
                n = 18
                if lang == "zh-TW":
                    a, b, n = list("".join(a)), list("".join(b)), 36
                runs = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
                if any(tuple(a[k : k + n]) in runs for k in range(len(a) - n + 1)):
                    want.add((d, i))
    assert got == want and (500, 50) in got and (501, 50) not in got


def test_emoji_between_words_is_no_word(spark):
    words = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " 😀 ".join(words)), (2, " ".join(words[:9]) + " 𠀀 " + " ".join(words[9:]))], "doc_id int, text string")
    got = leaks.leaks_of(df, spark.createDataFrame([(7, "en", " ".join(words))], "item_id long, lang string, expected_evidence string"), leaks.VERBATIM)
    assert [r["doc_id"] for r in got.where("leak").collect()] == [1]


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_edited_copies_against_brute_force(spark, rate):
    """Copies with words replaced, dropped and added: every pair whose alignment is that of a copy, by aligning each item with each whole text."""
    rng = random.Random(int(rate * 10))
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 3000}"
    items = [(i, "en", " ".join(word() for _ in range(45))) for i in range(60)]
    docs = []
    for i in range(120):
        copy = []
        for w in items[i % 60][2].split():
            way = rng.random() / rate
            copy += [word()] if way < 0.7 else [] if way < 0.85 else [w, word()] if way < 1 else [w]
        docs.append((i, " ".join([word() for _ in range(80)] + copy + [word() for _ in range(60)])))
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks_of(df, spark.createDataFrame(items, "item_id long, lang string, expected_evidence string"), leaks.EDITED).collect()}
    unit = lambda text: leaks.sequences([leaks.plain(text)])[0][0]
    want = {(d, i) for d, text in docs for i, _, e in items if leaks.align([(unit(e), unit(text))])[0] >= leaks.COPY * leaks.MATCH * 45}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)


def test_items_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, "en", " ".join(f"i{i}w{k}" for k in range(30))) for i in range(9)], "item_id long, lang string, expected_evidence string")
    df = items.select(F.col("item_id").alias("doc_id"), F.col("expected_evidence").alias("text"))
    monkeypatch.setattr(leaks, "ITEMS", 4)
    got = leaks.leaks_of(df, items, leaks.VERBATIM)
    assert sorted((r["doc_id"], r["item_id"], r["longest_run"]) for r in got.collect()) == [(i, i, 30) for i in range(9)]


def smith_waterman(a, b) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (leaks.MATCH if x == y else leaks.MISMATCH), row[j + 1] + leaks.GAP, new[j] + leaks.GAP))
        row = new
        best = max(best, *row)
    return best


@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_align(pairs):
    made = [(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) for a, b in pairs]
    assert leaks.align(made) == [smith_waterman(a, b) if a and b else 0 for a, b in pairs]


# 9 ------------------------------------------------------------------------------------------------------------------


def test_spam(spark):
    rng = random.Random(4)
    nouns = "office form reader list copy month request reason letter number building answer window paper street garden".split()
    prose = lambda: " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} is sent to the {rng.choice(nouns)} before the {rng.choice(nouns)} {rng.randint(1, 99)}." for _ in range(rng.randint(4, 12)))
    stuffed = lambda: ", ".join(rng.choice(["cheap forms", "free form template", "office forms", "best form maker"]) for _ in range(80))
    links = lambda: "\n".join(f"{rng.choice(['cheap forms', 'form filler'])} - https://a.example/p/{rng.randint(1, 999)}" for _ in range(40))
    rows = [(i, prose(), "en", "x") for i in range(300)] + [(1000 + i, stuffed(), None, "x") for i in range(10)] + [(2000 + i, links(), "EN", "x") for i in range(10)] + [(5000, None, "en", "x"), (5001, "", None, "x"), (5002, "cheap", None, "x")]
    got = {r["doc_id"] for r in spam.judged(spark.createDataFrame(rows, "doc_id int, text string, lang string, links string")).where("spam").collect()}
    assert got == {*range(1000, 1010), *range(2000, 2010)}
    assert spam.judged(spark.createDataFrame([], "doc_id int, text string, lang string")).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.select([F.col(c) for c in df.columns]).count() >= 0


# edge cases of all ---------------------------------------------------------------------------------------------------


@pytest.fixture
def hard(spark, tmp_path):
    """Tables with nulls in every column, empty and very long texts, ties and repeated rows, and an empty copy of each."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    for name in ("docs", "runs", "chunks", "quality_gate", "documents", "eval_items", "pack_specs"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        more = df.limit(30)
        if name not in ("pack_specs",):
            nulls = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
            more = more.unionByName(more).unionByName(nulls)
        text = {"chunks": "content", "documents": "text", "quality_gate": "message"}.get(name)
        if text:
            first = df.limit(1)
            for value in ("", " ", "\n\n", "word " * 60_000, "表" * 90_000, "\ufffd" * 50, "a"):
                more = more.unionByName(first.withColumn(text, F.lit(value)))
        more.withColumn("item", F.lit(1)).withColumn("spam", F.lit("x")).coalesce(3).write.parquet(f"{tmp_path}/hard/{name}.parquet")
    return tmp_path


def test_edge_cases(spark, hard):
    for name, q in registry.queries().items():
        q(spark, f"{hard}/hard").collect()
        if name not in ("p7_found", "p7_containers", "p7_fill"):
            assert q(spark, f"{hard}/empty").count() == 0, name


def test_no_capacity(spark, hard):
    with pytest.raises(ValueError, match="no capacity"):
        pack.p7_found(spark, f"{hard}/empty")
