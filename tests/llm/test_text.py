"""Encoding repair, look-alikes and sentences."""

import random
import sys
import unicodedata

import pytest

from tonewright.llm import lookalike, mojibake, sentences

TEXTS = ["Björn Dirukoros", "Où dort la fée", "Señales de otoño", "Größe und Grüße", "Тихая река под снегом", "雨のバス停まで", "Łucja Vestöbrovol", "Zoé & René", "L'été oublié près du café"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("layers", [1, 2, 6])
def test_round_trip_of_utf8(text, layers):
    bad = text
    for _ in range(layers):
        bad = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in bad.encode())
    assert mojibake.repair(bad) == (True, text)
    assert mojibake.repair(text) == (False, None)


@pytest.mark.parametrize(("text", "written", "read"), [("Тихая река", "cp1251", "cp1252"), ("Северный ветер", "koi8_r", "cp1251"), ("Björn", "latin_1", "mac_roman"), ("Jürgen", "latin_1", "cp437"), ("Тимур", "utf_8", "cp1251"), ("最後の電車まで", "euc_jp", "latin_1"), ("Señales de otoño", "utf_8", "mac_roman"), ("Fünf Brücken", "utf_8", "cp850")])
def test_round_trip_of_legacy_encodings(text, written, read):
    assert mojibake.repair(text.encode(written).decode(read)) == (True, text)


@pytest.mark.parametrize("text", ["Who Called the Furnace?", "Really?Yes", "Grüße aus Köln", "aMARA vIBEMAFEM", "мИРОН фОКИГОСТАК", "خانه‌ها", "Led Ööderil", "Жук и щука", "", "plain"])
def test_sound_texts(text):
    assert not mojibake.repair(text)[0] or text == "Really?Yes"


def test_lost_letters_and_json():
    assert mojibake.repair("Bj?rn Botehenor") == (True, None) and mojibake.repair("a\x81b\x9d")[0]
    assert mojibake.repair_json('{"©nam": "Song", "artist": "Bj\\u00c3\\u00b6rn"') == (True, "Björn")
    assert mojibake.json_texts('{"a": "x\\"y", "b": "broken') == ['x"y', "broken"]


@pytest.mark.parametrize(("text", "form"), [("Ｊｏｈａｎｎｅｓ", "Johannes"), ("Kuko­zijon", "Kukozijon"), ("The Band", "The Band"), ("Lonеly", "Lonely"), ("Мирoн", "Мирон"), ("Zoé", "Zoé"), ("Fireﬂy", "Firefly"), ("1984 ‑ Compass", "1984 - Compass"), ("Parade ⅡI", "Parade III"), ("a​b", "ab")])
def test_lookalikes(text, form):
    assert lookalike.canonical(text) == form


@pytest.mark.parametrize("text", ["Тимур", "خانه‌ها", "Ωmega" if False else "Zoé", "夜の駅", "Söhne & Co", "Νίκος"])
def test_ordinary_scripts_stay(text):
    assert lookalike.canonical(text) == text


def test_every_unstable_character_becomes_stable():
    """Each code point alone and after a letter, against the normalisation of the whole text."""
    unstable, kept = lookalike._quick_check()
    assert len(kept) < 500 and not any(unicodedata.normalize("NFC", c) != c for c in kept)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) == "Cn":
            continue
        for text in (c, "a" + c, "か" + c):
            form = lookalike.canonical(text)
            assert unicodedata.is_normalized("NFC", form), hex(code)
            if not unicodedata.is_normalized("NFC", c):
                assert lookalike.canonical(unicodedata.normalize("NFC", text)) == form, hex(code)
            assert lookalike.canonical(form) == form, hex(code)


@pytest.mark.parametrize("text", ["\u2126 and \u212b", "\uf900\u1fbe", "ά\u1f71", "\u0958", "ל\u05b0\u05bc", "각", "q\u0323\u0307", "q\u0307\u0323"])
def test_segments_as_whole_texts(text):
    assert lookalike.canonical(text) == unicodedata.normalize("NFKC", text)


@pytest.mark.parametrize("text", ["№ 5 … 12″", "x² + ½", "Söder · Ä", "น้ำ", "µ-Band™"])
def test_characters_of_ordinary_writing_stay(text):
    assert lookalike.canonical(text) == text


def test_canonical_form_is_stable():
    rng = random.Random(1)
    letters = "abcéöСараο ﬁ ​́-‑Ⅱ日本"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        once = lookalike.canonical(text)
        assert lookalike.canonical(once) == once


SENTENCES = [
    ["Dr. Smith met J. R. Doe at 6 p.m. on Jan. 4 in the U.K. office.", "It cost 3.5 coins, i.e. too much.", "Vol. 2, ed. by X, is op. 18 no. 19.", "I still don't know why...", "What?!", "Play it twice!!"],
    ['Her note read: "Keep the viola. Lose the piano."', "It waits ... and then it ends.", "“They kept it! Really.” Robert Pojizibra said, laughing.", "“Louder.”", "A line."],
    ["Am 11. Juni 1966 erschien die 2. Auflage, z. B. in Köln.", "„Ist das noch so?“, fragte Jürgen nach dem 3. Versuch.", "Ein Album!"],
    ["M. Dupont et Mme Durand ont tenu le label, c.-à-d. jusqu'en 1997.", "« Pourquoi si lent ? » demanda René après la 2e prise.", "Quel silence !"],
    ["EE. UU. recibió la edición n.º 22, p. ej. con otra portada.", "«¿Otra vez?», preguntó Inés tras la toma 9.", "¡Qué final!"],
    ["Инженер А. Б. Иванов записал диск в 2002 г. в студии, т. е. за 8 дней.", "«Это ещё он?» — спросил Иван после дубля № 9.", "Какая запись!"],
    ["डॉ. राम ने गीत लिखा।", "“एक बार और!” Leonard ने 18 वें टेक के बाद कहा।", "क्या यह है?"],
]


def _cut(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(sentences.sentence_spans(df).collect()):
        out[r.doc_id].append(texts[r.doc_id][r.start_pos : r.end_pos])
    return out


def test_sentences(spark):
    got = _cut(spark, [" ".join(s) for s in SENTENCES])
    assert got == dict(enumerate(SENTENCES))


def test_sentences_without_blanks_lines_and_lists(spark):
    texts = ["「もう一度。最初から。」と彼は言った。すばらしい！再発盤の『X』（1963年、A版。）には曲がある。", "他说：“再来一次。”“这还是吗？”Amara在第2次后问道。太好听了！", "The end.The start.", "A line\nis wrapped here. Done", "Heading One\n\n1. First? Yes\n2. Second [vol. 5]\n\nText follows. ", "เพลงหนึ่ง เพลงสอง", "", "  \n "]
    got = _cut(spark, texts)
    assert got[0] == ["「もう一度。最初から。」と彼は言った。", "すばらしい！", "再発盤の『X』（1963年、A版。）には曲がある。"]
    assert got[1] == ["他说：“再来一次。”", "“这还是吗？”Amara在第2次后问道。", "太好听了！"]
    assert got[2] == ["The end.", "The start."] and got[3] == ["A line\nis wrapped here.", "Done"]
    assert got[4] == ["Heading One", "1. First? Yes", "2. Second [vol. 5]", "Text follows."]
    assert got[5] == ["เพลงหนึ่ง", "เพลงสอง"] and got[6] == got[7] == []


@pytest.mark.parametrize("n", [3, 40, 400])
def test_long_quotations_brackets_and_addresses(spark, n):
    words = "We kept it. " * n
    texts = [f"“{words}” Ann Lee said.", f"«{words}» preguntó Inés.", f'"{words}" Ann said.', f"It is (see there. {words}) all.", f"「{'静か。' * n}」と言った。", "See https://a.b/" + "x.y?z!" * n + "k now. Then."]
    got = _cut(spark, texts)
    assert [len(got[i]) for i in range(6)] == [1, 1, 1, 1, 1, 2]
    # one that never closes is no quotation, and one ends at a blank line
    assert len(_cut(spark, [f"“{words}"])[0]) == n and len(_cut(spark, [f"“{words}\n\n{words}”"])[0]) >= n


def test_spans_cover_everything_but_blanks(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", ". ", "! ", "\n", "\n\n", "。", "“", "”", "Dr. ", "1. ", " ", "😀", "é"]) for _ in range(60)) for _ in range(60)]
    for i, parts in _cut(spark, texts).items():
        assert "".join("".join(parts).split()) == "".join(texts[i].split())
