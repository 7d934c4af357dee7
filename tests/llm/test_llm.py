import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewrit.llm import abuse, common, copies, language, leaks, lookalikes, mojibake, pii, pseudonyms, sentences, subjects, tokens

MESSAGES = "msg_id bigint, text_orig string, text_prepro string, channel string, lang string, keep_id string, id string"


def messages(spark, *texts, **more):
    rows = [(i, t, more.get("prepro"), more.get("channel", "sms"), more.get("lang", "en"), "clash", "clash") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, MESSAGES)


def word_tables(spark, *words):
    return spark.createDataFrame([(w, 5) for w in words], "word string, freq bigint"), spark.createDataFrame([("anna",), ("blue harbour",), (None,)], "key string")


# Problem 1


@pytest.fixture(scope="module")
def segmenter():
    subjects_, verbs, ends = ["The cat", "My brother", "Our bus", "That girl"], ["found a photo", "never answers", "bought bread", "left early"], ["last night", "on Tuesday", "again", "this week"]
    rng = random.Random(7)
    sent = lambda: f"{rng.choice(subjects_)} {rng.choice(verbs)} {rng.choice(ends)}"
    texts = [" ".join(sent() + rng.choice([".", "!", "?", "..."]) for _ in range(rng.randint(1, 3))) for _ in range(500)]
    texts += [f"Take ca. {i} grams of flour e.g. the brown one. {sent()}." for i in range(100)]
    return sentences.train(texts)


def cut(model, text):
    return [text[a:b] for a, b in model.spans(text)]


def test_sentences(segmenter):
    assert cut(segmenter, "The cat left early. My brother found a photo again!") == ["The cat left early.", "My brother found a photo again!"]
    assert cut(segmenter, "@ann The cat left early. :) #tag") == ["@ann The cat left early. :) #tag"]
    assert cut(segmenter, "Take ca. 5 grams of flour e.g. the brown one.") == ["Take ca. 5 grams of flour e.g. the brown one."]
    assert cut(segmenter, "") == cut(segmenter, " \n") == cut(segmenter, "<LINEBREAK>") == []
    assert cut(segmenter, "The cat left early. <LINEBREAK> Our bus left early.") == ["The cat left early.", "Our bus left early."]


@pytest.mark.parametrize("least, parts", [(45, ["邮递员在等公共汽车", "我妈妈买了一把新雨伞", "弟弟忘了关窗户", "妹妹在沙发上睡着了"]), (45, ["母は雨を見ていました", "弟は窓を閉め忘れました", "妹はソファで寝ました", "猫は手紙を書きました"]), (30, ["พี่สาวของฉันลืมปิดหน้าต่าง", "แม่ของฉันซื้อร่มคันใหม่", "เด็กผู้ชายกำลังรอรถเมล์", "แมวหลับบนโซฟา"])])
def test_sentences_without_blanks_or_stops(least, parts):
    rng = random.Random(4)
    stop = " " if parts[0][0] >= "\u0e00" and parts[0][0] < "\u0e80" else "。"
    model = sentences.train([stop.join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + (stop if rng.random() < 0.8 else "") + f" #t{i}" for i in range(500)])
    right = 0
    for _ in range(50):
        a, b = rng.choice(parts), rng.choice(parts)
        right += cut(model, a + b) == [a, b]
    assert right >= least and cut(model, parts[0]) == [parts[0]]


def test_transitions_are_learned():
    class Chain:
        ends, silver, kinds, features = [1, 2, 3, 4], [1, 0, 1, 0], [(".", False)] * 4, [[0]] * 4

    import numpy as np

    tr = sentences.transitions(sentences.Model(np.zeros(4)), [Chain()] * 500)
    assert tr[0][1][1] < -1 < 0 < tr[0][1][0] and np.allclose(tr[1:], 0)


def test_silver_of_a_table_equals_that_of_its_texts(spark):
    texts = ["Take ca. 5 g e.g. the brown one. Then wait! We left."] * 6 + ["Go ca. 6 km? They did."] * 3
    a, b = sentences.silver_of(messages(spark, *texts, None, "")), sentences.Silver.of([*texts, ""])
    assert (a.abbreviations, a.starters, a.enders) == (b.abbreviations, b.starters, b.enders) and "ca" in a.abbreviations


def test_sentences_cover_all_but_white_space(segmenter):
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice("ab. !?\"“”(•😀é。一 \n") for _ in range(60))
        spans = segmenter.spans(t)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert "".join(t[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == re.sub(r"\s", "", t)


def test_sentence_table(spark, segmenter):
    df = messages(spark, "The cat left early. Our bus left early.", None, "", " ", "x" * 30000 + ". Our bus left.", prepro="• .")
    got = sentences.sentence_spans(sentences.fields(df), segmenter, "msg_id, field").collect()
    assert {(r["msg_id"], r["start_pos"], r["end_pos"]) for r in got if r["field"] == "text_orig"} >= {(1, 0, 19), (1, 20, 39)}
    assert {r["msg_id"] for r in got if r["field"] == "text_prepro"} == {1, 2, 3, 4, 5}
    assert sentences.sentence_spans(sentences.fields(df.limit(0)), segmenter, "msg_id, field").count() == 0
    assert isinstance(sentences.fitted(df.limit(0)), sentences.Model)


# Problem 2

SAMPLE = {
    "en": "the cat was waiting for the bus before lunch and nobody noticed that our brother never answers the door",
    "nl": "mijn broertje stond op de bus te wachten en ik snap er niks van want heel de straat doet nooit de deur open",
    "de": "die ganze straße schaute dem regen zu und keiner hat es gemerkt weil unsere oma die wäsche machte",
    "fr": "mon petit frère a acheté un parapluie et personne n'a rien vu parce que toute la rue attendait le bus",
    "es": "mi mejor amiga me devolvió la llamada y nadie se dio cuenta porque toda la calle esperaba el autobús",
}


def shuffled(lang, n, seed):
    rng, w = random.Random(seed), SAMPLE[lang].split()
    return [" ".join(w[a : a + 7]) + "." for a in (rng.randint(0, len(w) - 7) for _ in range(n))]


@pytest.fixture(scope="module")
def parser():
    labelled = {lang: shuffled(lang, 60, 1) + shuffled("en" if lang != "en" else "nl", 3, 2) for lang in language.LATIN}
    return language.fit({**labelled, **{lang: [] for lang in language.LANGUAGES if lang not in labelled}, "zh": ["邮递员在等公共汽车"], "ja": ["母は雨を見ていました"]})


def test_languages(parser):
    for lang in language.LATIN:
        texts = shuffled(lang, 20, 9)
        assert [[language.LANGUAGES[i] for i, _ in s] for s in parser.segments(texts)] == [[lang]] * 20
    mixed = "The cat was waiting for the bus before lunch. Mijn broertje stond op de bus te wachten. Младшая сестра забыла закрыть окно."
    assert [[language.LANGUAGES[i] for i, _ in s] for s in parser.segments([mixed, "", "!!! 12", "母は雨を見ていました", "邮递员在等公共汽车"])] == [["en", "nl", "ru"], [], [], ["ja"], ["zh"]]


def test_packed_automaton_knows_all_substrings():
    import numpy as np

    rng = random.Random(2)
    for _ in range(40):
        text = [rng.choice([0, 1, 2, 5, 0x4E00, 0x9FFF]) for _ in range(rng.randint(1, 40))]
        a = language.Automaton(np.array(text))

        def has(part):
            s = 0
            for c in part:
                at = a.base[s] + c
                if a.check[at] != s:
                    return False
                s = a.target[at]
            return True

        assert all(has(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
        for _ in range(40):
            part = [rng.choice([0, 1, 2, 5, 0x4E00, 0x9FFF]) for _ in range(rng.randint(1, 4))]
            assert has(part) == any(text[i : i + len(part)] == part for i in range(len(text)))


def test_languages_of_other_scripts_by_parsing():
    ru, zh, ja, th = "младшая сестра забыла закрыть окно и никто этого не заметил", "邮递员在等公共汽车我妈妈买了一把新雨伞", "母親雨見。妹窓閉忘。母は雨を見ていました", "พี่สาวของฉันลืมปิดหน้าต่างเมื่อคืนนี้"
    labelled = {lang: shuffled(lang, 60, 1) for lang in language.LATIN}
    p = language.fit({**labelled, "ru": [ru] * 3, "zh": [zh] * 3, "ja": [ja] * 3, "ar": [], "hi": [], "th": [th] * 3})
    got = p.segments([ru, "邮递员买了雨伞", "母親雨見", th, "ru: " + ru[:20], "हम घर जा रहे हैं"])
    assert [[language.LANGUAGES[i] for i, _ in s] for s in got] == [["ru"], ["zh"], ["ja"], ["th"], ["ru"], ["hi"]]


def test_label_notations(spark):
    df = spark.createDataFrame([("en_US",), ("Dutch",), ("NL-be",), ("??",), ("",), (None,), ("xx",), ("pt",), ("und",)], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["en", "nl", "nl", None, None, None, None, "other", "und"]


def test_mislabelled(spark):
    texts = [t for lang in language.LATIN for t in shuffled(lang, 40, 3)]
    langs = [lang for lang in language.LATIN for _ in range(40)]
    rows = [(i, t, None, "sms", la, "c", "c") for i, (t, la) in enumerate(zip(texts, langs))]
    rows += [(900, SAMPLE["nl"], None, None, "en", "c", "c")] * 2 + [(901, SAMPLE["en"], None, None, "English", "c", "c"), (902, ":-) !!", None, None, "und", "c", "c"), (903, "  ", None, None, None, "c", "c"), (904, None, None, None, None, "c", "c"), (905, "...", None, None, "en", "c", "c")]
    df = spark.createDataFrame(rows, MESSAGES)
    lex, gaz = word_tables(spark, "cat")
    got = {(r["msg_id"], r["seg_no"], r["lang"]) for r in language.mislabelled(df, lex, gaz).where("msg_id >= 900").collect()}
    assert got == {(900, 0, "nl"), (905, 0, "und")}
    assert language.mislabelled(df.limit(0), lex, gaz).count() == 0


# Problem 3


def garble(t, write, read):
    return t.encode(write).decode(read)


@pytest.mark.parametrize("write, read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1251", "latin-1"), ("gbk", "latin-1")])
def test_repair_round_trip(write, read):
    model = mojibake.CharModel({ord(c): 50 for c in "éèëïöü’“”€…–приветкакдлмн邮递员在等公共汽车我妈买了一把新雨伞"})
    text = {"cp1251": "привет как дела", "gbk": "邮递员在等公共汽车 我妈妈买了一把新雨伞"}.get(write, "crème brûlée, één café…")
    assert mojibake.repaired(garble(text, write, read), model) == text
    assert mojibake.repaired(text, model) == text


RUSSIAN = "Младшая сестра уснула на диване. Знаешь, моя соседка смотрела на дождь, и никто не заметил."


@pytest.mark.parametrize("write, read", [("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("iso8859-5", "cp1251"), ("cp866", "latin-1")])
def test_cyrillic_read_as_cyrillic(write, read):
    model = mojibake.CharModel({ord(c): 20 * RUSSIAN.count(c) for c in RUSSIAN if c > "\x7f"})
    bad = garble(RUSSIAN, write, read)
    assert mojibake.repaired(bad, model) == RUSSIAN
    assert mojibake.repaired(f"@ann {RUSSIAN} {bad}", model) == f"@ann {RUSSIAN} {RUSSIAN}"
    for clean in (RUSSIAN, RUSSIAN.upper(), RUSSIAN.swapcase()):
        assert mojibake.repaired(clean, model) == clean


def test_cyrillic_records(spark):
    bad = [garble(RUSSIAN, "koi8-r", "cp1251"), garble(RUSSIAN, "cp866", "cp1251"), "@ann Никто не заметил. " + garble("Моя соседка смотрела на дождь.", "koi8-r", "cp1251")]
    recs = mojibake.records(messages(spark, *[RUSSIAN] * 20, *bad, RUSSIAN.swapcase()), spark.createDataFrame([(8, None)], "post_id bigint, tgt array<string>"))
    assert {r["rec_id"] for r in mojibake.garbled(recs).collect()} == {21, 22, 23}
    assert {r["fixed"] for r in mojibake.restored(recs).collect()} == {RUSSIAN, "@ann Никто не заметил. Моя соседка смотрела на дождь."}


def test_garbled_records(spark):
    clean = ["een café’s menu…", "crème brûlée", "één idee", "naïve", "“déjà vu”"] * 6
    df = messages(spark, *clean, garble("crème brûlée", "utf-8", "cp1252"), "ge�rriteerd", garble(garble("één café", "utf-8", "cp1252"), "utf-8", "cp1252"), None, "", "ÜBLICH", "plain")
    n = len(clean)
    g = spark.createDataFrame([(7, [garble("één", "utf-8", "cp1250"), None, "x"]), (8, None), (9, [])], "post_id bigint, tgt array<string>")
    recs = mojibake.records(df, g)
    assert {tuple(r) for r in mojibake.garbled(recs).collect()} == {("text_orig", n + 1), ("text_orig", n + 2), ("text_orig", n + 3), ("tgt", 7)}
    fixed = {(r["field"], r["rec_id"]): r["fixed"] for r in mojibake.restored(recs).collect()}
    assert fixed["text_orig", n + 1] == "crème brûlée" and fixed["tgt", 7] == "één x" and fixed["text_orig", n + 3] == "één café"
    assert mojibake.garbled(recs.limit(0)).count() == 0


# Problem 4


@pytest.mark.parametrize("value", ["0612345678", "12", "1", "999982369", "00"])
def test_feistel_is_a_permutation(value):
    assert pseudonyms.feistel(pseudonyms.feistel(value, b"k", "t"), b"k", "t", back=True) == value
    assert len({pseudonyms.feistel(f"{i:03d}", b"k", "t") for i in range(1000)}) == 1000


def undone(kind, value):
    new = pseudonyms.pseudonym(kind, value, b"k")
    assert pseudonyms.pseudonym(kind, new, b"k", back=True) == value
    return new


def test_pseudonyms_keep_format_and_validity():
    p = undone("id_number", "999982369")
    assert pseudonyms.eleven_proof(p) and p != "999982369"
    iban = "DE89 3704 0044 0532 0130 00"
    q = undone("id_number", iban)
    assert pseudonyms.iban_valid(q) and q[:2] == "DE" and len(q) == len(iban)
    assert not pseudonyms.iban_valid(undone("id_number", "DE88 3704 0044 0532 0130 00"))
    assert undone("id_number", "NL91 ABNA 0417 1643 00")[5:9] == "ABNA" and pseudonyms.iban_valid(undone("id_number", "nl91abna0417164300"))
    born = undone("id_number", "85.07.30-033.28")
    assert 97 - int(re.sub(r"\D", "", born)[:9]) % 97 == int(born[-2:]) and 1 <= int(born[3:5]) <= 12
    for other in ("666-83-6338", "123-45-6789", "123456789", "QQ 0012345", "12.34.56-789.01"):
        assert len(undone("id_number", other)) == len(other)
    assert len({pseudonyms.pseudonym("id_number", f"{i:09d}", b"k") for i in range(3000)}) == 3000


def test_phone_pseudonyms():
    assert re.fullmatch(r"\+33 6 \d\d \d\d \d\d \d\d", undone("phone", "+33 6 39 98 00 76"))
    forms = [undone("phone", v) for v in ("+31612345678", "0612345678", "0031 6 1234 5678", "+31 (0)6 12345678", "06-12345678")]
    assert len({re.sub(r"\D", "", f)[-8:] for f in forms}) == 1 and forms[0].startswith("+316") and forms[1].startswith("06")
    assert undone("phone", "+1 212 555 0142").startswith("+1 2") and undone("phone", "+351 912 345 678").startswith("+351 9")


def test_date_pseudonyms():
    import datetime

    seen = set()
    for i in range(3652):
        d = datetime.date(2012, 1, 1) + datetime.timedelta(i)
        new = undone("date", f"{d.day:02d}-{d.month:02d}-{d.year}")
        day, month, year = map(int, new.split("-"))
        seen.add(datetime.date(year, month, day))
        if d.day > 12:
            m, dd, y = map(int, undone("date", f"{d.month:02d}/{d.day:02d}/{d.year}").split("/"))
            assert (y, m, dd) == (year, month, day)
    assert [int(x) for x in pseudonyms.pseudonym("date", pseudonyms.pseudonym("date", "5.1.2020", b"k"), b"k", back=True).split(".")] == [5, 1, 2020]
    assert len(seen) == 3652 and pseudonyms.pseudonym("date", "31-02-2019", b"k") == "31-02-2019"


def test_pseudonyms_of_different_values_differ():
    assert len({pseudonyms.pseudonym("email", f"user{i}@example.org", b"k") for i in range(200_000)}) == 200_000
    same = lambda kind, *values: len({pseudonyms.pseudonym(kind, v, b"k") for v in values}) == 1
    assert same("email", "A@b.nl", "a (at) b.nl", "a [at] b (dot) nl") and not same("email", "otto@x.nl", "oto@x.nl")
    assert same("person_name", "Carla Kestelyn", "KESTELYN, Carla", "carla  kestelyn") and not same("person_name", "Ana Vos", "Anna Voss")
    assert same("street_address", "Molenstraat 12, Gent", "molenstraat 12  Gent") and not same("street_address", "Molenstraat 12", "Molenstraat 13")
    assert pseudonyms.pseudonym("email", "a@b.nl", b"k") != pseudonyms.pseudonym("email", "a@b.nl", b"other")


def test_pieces(spark):
    names = [f"{g} {f}" for g in ("Anna", "Bruno", "Carla") for f in ("Vandermolen", "Kestelyn", "Oosterwijk")]
    texts = [f"I met {n} at the fair with {n} again" for n in names] * 3 + [f"then {n[0]}. {n.split()[1]} left us" for n in names]
    tests = ["write to jan.peeters@mail.example please", "or jan (at) mail (dot) example now", "call +31 (0)6 00153 153 tonight", "id 666-83-6338 or NL80 XMPL 9868 2453 00 ok", "come to 12 Old Thistle Street, Flat 4, Dorpveen 00099, ring twice", "op Molenkreekstraat 12b, 0264 XQ Grimsholt is het", "have you met anna kestelyn yet", "KESTELYN, Carla wrote", "Hey Anna, order 204-20-552 part 5550-11 on 12-05-2024 cost 1,250.20", "@Anna_12 said", None, ""]
    df = messages(spark, *texts, *tests)
    gaz = spark.createDataFrame([("anna",), ("bruno",), (None,)], "key string")
    n = len(texts)
    got = {}
    for r in pii.pieces(df, gaz).where(f"msg_id > {n}").collect():
        t = tests[r["msg_id"] - n - 1]
        got.setdefault(r["msg_id"] - n - 1, set()).add((r["kind"], t[r["start_pos"] : r["end_pos"]]))
    assert got == {
        0: {("email", "jan.peeters@mail.example")}, 1: {("email", "jan (at) mail (dot) example")}, 2: {("phone", "+31 (0)6 00153 153")}, 3: {("id_number", "666-83-6338"), ("id_number", "NL80 XMPL 9868 2453 00")},
        4: {("street_address", "12 Old Thistle Street, Flat 4, Dorpveen 00099")}, 5: {("street_address", "Molenkreekstraat 12b, 0264 XQ Grimsholt")}, 6: {("person_name", "anna kestelyn")}, 7: {("person_name", "KESTELYN, Carla")},
    }
    out = {r["msg_id"] - n - 1: r["text"] for r in pii.anonymized(df, gaz, b"k").collect()}
    assert re.fullmatch(r"write to \[email [0-9a-f]{32}\] please", out[0]) and out[10] is None and "[date " in out[8]
    assert pii.pieces(df.limit(0), gaz).count() == 0


def test_names_of_all_messages(spark):
    rng = random.Random(3)
    family = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(12)]
    rare = [f"Yesterday we met {a}. {f} and saw {f} near the old harbour." for f in family for a in "AB"]
    learned = spark.createDataFrame([(t,) for t in rare], "text_orig string")
    fill = spark.range(300_000).selectExpr("concat('nothing new here ', id) text_orig")
    _, gaz = word_tables(spark, "cat")
    assert {pii._key(f) for f in family} <= pii.lexicon(fill.unionByName(learned), gaz).family
    assert pii.lexicon(fill.limit(0), gaz).family == set()


# Problem 5


def test_hidden_copies(spark):
    long = "x" * 130
    pair = [f"{long}: a | When: b", f"when: B; {long.upper()}: a."]
    assert {tuple(r) for r in copies.hidden_copies(messages(spark, *pair)).collect()} == {(1, 2)}
    texts = ["What: a | When: b", "WHEN:b;  WHAT : a!", "What: b | When: a", "Straße 5", "STRASSE   5.", "x y", "xy", "x а", None, "", "!!!", "...", "What a, when b"]
    df = messages(spark, *texts)
    df = df.unionByName(df)
    assert {tuple(r) for r in copies.hidden_copies(df).collect()} == {(1, 2), (4, 5), (6, 7)}
    assert {r["keep_id"]: r["n_copies"] for r in copies.collapsed(df).collect()} == {1: 2, 3: 1, 4: 2, 6: 2, 8: 1, 13: 1}
    assert copies.hidden_copies(df.limit(0)).count() == 0


def test_shared_identifiers_are_refused(spark):
    e = "r1 long, r2 long, a long, b long, check long, n long"
    with pytest.raises(ValueError):
        copies.verified(spark.createDataFrame([(1, 1, 5, 5, 7, 1), (2, 2, 5, 5, 8, 1)], e))
    assert copies.verified(spark.createDataFrame([(1, 1, 5, 5, 7, 1), (2, 2, 5, 5, 7, 1)], e)).count() == 2


def test_copies_of_a_hot_group_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "Same text" + rng.choice([" ", "!", ""]) if i % 3 == 0 else f"t {rng.randint(0, 40)}") for i in range(600)]
    df = spark.createDataFrame(rows, "msg_id bigint, text_orig string")
    first = {}
    want = set()
    for i, t in rows:
        k = re.sub(r"\W", "", t.lower())
        if k in first:
            want.add((first[k], i))
        first.setdefault(k, i)
    assert {tuple(r) for r in copies.hidden_copies(df).collect()} == want


# Problem 6


def test_lookalikes(spark):
    lex, gaz = word_tables(spark, "piano", "the", "not", "aan")
    texts = ["ｐｉａｎｏ!", "thе cat", "no\u200bt", "a\u00a0b", "de\u0301jeuner", "ﬁsh", "２４ minutes", "едc", "ok", "Het woord «привет» is Russisch", "“é” – €5 … °C", "👩‍🔬 ❤️", "这！是？", "नमस्ते क्‍ष", "88 m²", None, "", "ａ" * 5000]
    bad = {1, 2, 3, 4, 5, 6, 7, 8, 18}
    g = spark.createDataFrame([(3, ["th\u00ade"]), (4, None), (5, ["ok"])], "post_id bigint, ori array<string>")
    recs = lookalikes.gold_records(messages(spark, *texts), g)
    assert {tuple(r) for r in lookalikes.found(recs, lex, gaz).collect()} == {*(("text_orig", i) for i in bad), ("ori", 3)}
    fixed = {r["rec_id"]: r["fixed"] for r in lookalikes.normalized(recs, lex, gaz).where("affected and field = 'text_orig'").collect()}
    assert [fixed[i] for i in range(1, 9)] == ["piano!", "the cat", "not", "a b", "d\u00e9jeuner", "fish", "24 minutes", "едс"]
    assert lookalikes.found(recs.limit(0), lex, gaz).count() == 0


def test_lookalikes_by_the_trie():
    trie = lookalikes.Trie({"apple": 5, "hello": 5, "ample": 1})
    for w in ("\u13aapple", "\u2c81pple", "\ua4eepple", "\u029cello", "app\u050be", "hel\u200blo"):
        assert lookalikes.affected(w, trie), w
    assert [lookalikes.consistent(w, trie) for w in ("\u13aapple", "\u2c81pple", "\ua4eepple", "\u029cello", "\u057epple")] == ["Apple", "apple", "Apple", "hello", "apple"]
    # Whole words of other alphabets are at home; other edits than look-alikes are none.
    for w in ("\u13a3\u13b3\u13a9", "\u2ca0\u2ca3", "appel", "applo", "\u03b1\u03c1\u03c7\u03ae"):
        assert not lookalikes.affected(w, trie), w


# Problem 7


def test_abuse(spark):
    rng = random.Random(5)
    calm = ["the cat left early", "our bus was late again", "I need advice about bread", "our dog is a silly old pig"]
    bad = ["you are such a {}", "nobody likes you {}", "what a {} you are"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = f"{rng.choice(calm)}. " + (rng.choice(bad).format(rng.choice(["moron", "m.o.r.o.n", "m0r0n", "zorrap", "twitface"])) if toxic else rng.choice(calm)) + "."
        rows.append((i, text, None, "sms", "en", "c", "c"))
        wrong = rng.random() < 0.05
        labels += [(i, "a", int(toxic != wrong)), (i, "b", int(toxic)), (i, "c", None)]
    rows += [(1000, "hello. What a MOROOOON you are!", None, None, "en", "c", "c"), (1001, None, None, None, None, "c", "c"), (1002, "", None, "sms", None, "c", "c"), (1003, "a silly old pig", None, "sms", None, "c", "c"), (1004, "nobody likes you m o r o n", None, "twe", None, "c", "c")]
    df = spark.createDataFrame(rows, MESSAGES)
    lab = spark.createDataFrame(labels, "msg_id bigint, annotator string, abusive int")
    terms = spark.createDataFrame([("moron", "abuse", "en"), (None, None, None)], "term string, category string, lang string")
    lex, gaz = word_tables(spark, "cat")
    s = abuse.scored(df, lab, terms, lex, gaz).cache()
    got = {r["msg_id"]: r["category"] for r in abuse.found(s).collect()}
    assert {i for i in got if i >= 1000} == {1000, 1004} and set(got.values()) == {"abuse"}
    truth = {i for i in range(400) if i % 4 == 0}
    hit = {i for i in got if i < 400}
    assert len(hit & truth) >= 0.97 * len(truth) and len(hit - truth) <= 4
    rates = {r["channel"]: (r["n_messages"], r["n_found"]) for r in abuse.rates(s).collect()}
    assert rates["twe"] == (1, 1) and rates[None][1] == 1
    assert abuse.scored(df.limit(0), lab.limit(0), terms, lex, gaz).count() == 0
    # Offsets are those of the text as delivered, and every toxic sentence has its span.
    odd = "Caf\u00c3\u00a9 time. Nobody likes you m\u200bor\u043en! " + "our bus was late again. " * 50 + "What a m0r0n you are."
    odds = df.unionByName(messages(spark, odd).withColumn("msg_id", F.lit(2000).cast("bigint")))
    (r,) = abuse.scored(odds, lab, terms, lex, gaz).where("msg_id = 2000").collect()
    parts = [odd[a:b] for a, b in r["spans"]]
    assert r["category"] == "abuse" and len(parts) >= 2 and "m\u200bor\u043en" in parts[0] and "m0r0n" in parts[-1]


def test_places_in_changed_text():
    for a, b in (("abc", "abc"), ("x\u200by z", "xy z"), ("caf\u00c3\u00a9 au lait", "caf\u00e9 au lait"), ("", ""), ("abc", "")):
        at = abuse.places_in(a, b)
        assert len(at) == len(b) and all(0 <= i <= j <= len(a) for i, j in at)
        assert all(b[k] == a[i] for k, (i, j) in enumerate(at) if j == i + 1 and b[k].isascii() and a[i].isascii())


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    f = rng.integers(0, 50, (7, 3))
    w, tr = np.zeros(1 << abuse.BITS), rng.normal(size=(2, 2))
    w[:50] = rng.normal(size=50)
    p, _ = abuse.Field(w, tr).marginals(f, np.array([0, 4, 7]))
    for lo, hi in ((0, 4), (4, 7)):
        s, z, want = w[f[lo:hi]].sum(1), 0.0, np.zeros(hi - lo)
        for tags in itertools.product((0, 1), repeat=hi - lo):
            e = np.exp(sum(s[i] * t for i, t in enumerate(tags)) + sum(tr[a, b] for a, b in zip(tags, tags[1:])))
            z += e
            want += e * np.array(tags)
        assert np.allclose(p[lo:hi], want / z)


# Problem 8


def test_token_ids_equal_the_public_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", None, "Hello world", "<|endoftext|>", "a\x00b \t\n  x  ", "naïve café 👩‍🔬 日本語 ไทย", "don't 12345 ...!!!", "é" * 3000, " " * 500, "͸𞤀 x", "zzzzqqqq" * 50]
    texts += ["".join(rng.choice("abe tn' \n9é漢😀.") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, x
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_prefix_encoder_equals_merging():
    ranks = {bytes([b]): b for b in range(256)}
    for i, p in enumerate([b"ab", b"bc", b"abc", b"aa", b"aaa", b"ca"]):
        ranks[p] = 256 + i
    e = tokens.PrefixEncoder(ranks)
    rng = random.Random(7)
    for _ in range(300):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        assert e.encode(s) == [ranks[p] for p in e._merge(s)]
    assert base64.b64decode("YQ==") == b"a"


# Problem 9


def test_leaks(spark):
    item = "The brittle chalkpit of Zihikamopa painted twelve silent barge pieces beyond the stubborn harvester until no steeple near Gozoromudu measured the feathered kiln"
    words = item.split()
    docs = [
        f"My sister left. {item}. Then we ate.", f"so {' '.join(words[3:16])} fine", "and " + " ".join(words[2:7]) + " ok", item.upper().replace("E", "EEEE"), " ".join(words[:8] + ["quite"] + words[9:17]) + " x",
        "nothing here", None, "", "x " * 20000 + item, item.replace("barge", "bargee").replace("o", "о"),
    ]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, "Under the frozen lantern a beekeeper named Jokasa followed the rusted comb since its tidal windmill praised eleven almanac stones"), (3, None)], "item_id bigint, text string")
    want = {(0, 1), (1, 1), (3, 1), (4, 1), (8, 1), (9, 1)}
    assert {tuple(r) for r in leaks.leaked_items(df, items).collect()} == want
    assert {tuple(r) for r in leaks.leaked_items(df, items, block_letters=50).collect()} == want
    assert leaks.leaked_items(df.limit(0), items).count() == 0


def noisy(rng, w):
    """A word of four letters or more with one letter dropped, doubled, changed or swapped."""
    i, how = rng.randint(1, max(1, len(w) - 2)), rng.randint(0, 3)
    return w if len(w) < 4 else (w[:i] + w[i + 1 :], w[:i] + rng.choice("bdfgkpt") + w[i:], w[:i] + rng.choice("bdfgkpt") + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :])[how]


def test_leaks_with_noise_and_changed_words():
    rng = random.Random(3)
    item = "The brittle chalkpit of Zihikamopa painted twelve silent barge pieces beyond the stubborn harvester until no steeple near Gozoromudu measured the feathered kiln"
    index, words = leaks.GramIndex([item]), item.split()
    texts = [" ".join(w[:2] + w[3:] if len(w) > 3 else w for w in words)]  # one letter dropped in each longer word
    for _ in range(60):
        a = rng.randint(0, len(words) - 14)
        part = words[a : a + 14]
        for i in rng.sample(range(3, 11), 3):  # within the passage: its ends are what is equal
            part[i] = "qqvvxx"[: rng.randint(2, 6)]
        i = rng.randrange(14)
        part[i] = part[i] if len(part[i]) < 5 else part[i][:2] + "q" + part[i][3:]
        texts.append("so " + " ".join(part) + " indeed")
    assert leaks.passages(["padding text before it. " + t for t in texts], index) == [(i, 0) for i in range(len(texts))]
    assert leaks.passages([" ".join(words[3:12]), " ".join(sorted(words)), "the of no near " * 30], index) == []


def test_near_words_share_a_neighbour():
    rng = random.Random(8)
    for _ in range(500):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
        b = noisy(rng, a)
        if leaks.near(a, b):
            assert leaks.neighbours(a) & leaks.neighbours(b)


# Problem 10


def test_subjects(spark):
    rng = random.Random(9)
    topics = {"law": "court judge verdict lawsuit witness appeal", "food": "soup garlic bread cheese pumpkin noodles", "everyday": "bus umbrella neighbour window laundry couch"}
    say = lambda s: f"My sister saw the {' and the '.join(rng.sample(topics[s].split(), 2))} last night. "
    rows, labels, truth = [], [], {}
    for i in range(240):
        own = rng.choice([["law"], ["food"], ["everyday"], ["law", "food"]])
        parts = [say(rng.choice(own)) if len(own) == 1 or n > 1 else say(own[n]) for n in range(8)] + [say("everyday")]
        if len(own) == 2:
            parts = [say("law")] * 4 + [say("food")] * 4 + [say("everyday")]
        rows.append((i, "".join(parts), "c", "sms"))
        truth[i] = set(own)
        if i < 160:
            labels += [(i, s) for s in own]
    rows += [(900, None, "c", None), (901, "", "c", None), (902, " ", "c", None), (903, "!!! :)", "c", "sms")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, subject string, source string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, s, s) for s in topics], "subject string, title_en string, title_nl string")
    bench = spark.createDataFrame([(1, "a tidal mooring of Zatu measured eleven salted ledgers")], "item_id bigint, text string")
    shares = subjects.subject_shares(df, lab, areas, bench)
    got = {}
    for r in subjects.found(shares).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert got[903] == {"everyday"} and not {900, 901, 902} & set(got)
    assert sum(got[i] == truth[i] for i in range(160, 240)) >= 76
    assert subjects.composition(shares, df).count() >= 3
    assert subjects.subject_shares(df.limit(0), lab.limit(0), areas, bench).count() == 0


# Shared pieces


def test_bounded_raises(spark):
    with pytest.raises(ValueError):
        common.bounded(spark.range(5), 4, "x")


def test_ragged_take():
    import numpy as np

    assert common.ragged_take(np.arange(10), np.array([3, 0, 7]), np.array([2, 0, 3])).tolist() == [3, 4, 7, 8, 9]
