import random

import pytest
from pyspark.sql import functions as F

from tidewrit.functions import text as X
from tidewrit.operators import align, decide, evaluate, filtering, flooding, gold, prepro, suggest
from tidewrit.plans import pipeline
from tidewrit.sources import readers, sinks


def one(spark, column_of, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column_of(F.col("t"))).collect()]


def tokens(spark, *texts):
    return spark.createDataFrame([(i, p, w) for i, t in enumerate(texts) for p, w in enumerate(t.split())], "msg_id bigint, pos int, tok string")


def words(spark, **freq):
    return spark.createDataFrame(list(freq.items()) or [("", 0)], "word string, freq bigint")


def test_preprocessing_chain(spark):
    got = one(spark, prepro.rewrite_text, "(@janthans @SvenOrnelis BBQ? Wie, wat , waar? :-D #aanwezig)", "check http://a.b/c#d <3 a|b N.V.A hoi!!!! www.x.be me@x.org", "see https://x.org at 3:30", "  ", "", None)
    assert got == ["(@janthans @SvenOrnelis BBQ? Wie , wat , waar ? • • )", "check • • a b N.V.A hoi !!!! • •", "see https • . org at 3 • 0", "\n", "\n", None]


def test_chain_has_no_double_blank_or_pipe(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab| .,!?:)(-xD#@[]\t<3é") for _ in range(40)) for _ in range(200)]
    for t in one(spark, prepro.rewrite_text, *texts):
        assert "  " not in t and "|" not in t


def test_allcaps(spark):
    assert one(spark, prepro.reduce_allcaps, "HELLO World ABc D", None) == ["hello World abc D", None]


def test_flooding_patterns(spark):
    assert one(spark, flooding.punctuation, "what?????", "hm......", "hm..") == ["what??", "hm...", "hm..."]
    assert one(spark, flooding.to_two, "HaaAAllooooo", "10000", "hahahahaha", "lollollollol") == ["Haalloo", "10000", "haha", "lollollollol"]


def test_flooding_choice(spark):
    known = spark.createDataFrame([("cool",), ("so",), ("heel",)], "w string")
    df = spark.createDataFrame([(1, "cooool sooo x"), (2, " "), (3, None)], "msg_id bigint, text_prepro string")
    got = {r[0]: r[1] for r in flooding.correct(df, known).collect()}
    assert got == {1: "cool so x", 2: "", 3: ""}
    nl = spark.createDataFrame([(1, "heeeel")], "msg_id bigint, text_prepro string")
    assert flooding.correct(nl, known, language="nl").collect()[0][1] == "heel"


def test_flooding_keeps_the_number_of_tokens(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abe!.") * rng.randint(1, 5) for _ in range(4)) for _ in range(6))) for i in range(50)]
    df = spark.createDataFrame(rows, "msg_id bigint, text_prepro string")
    for r in flooding.correct(df, spark.createDataFrame([("ab",)], "w string")).collect():
        assert len(r[1].split()) == 6


def test_abbreviation(spark):
    ab = spark.createDataFrame([("lol", "laughing out loud"), ("brb", None)], "key string, expansion string")
    got = suggest.abbreviation(tokens(spark, "LOL brb word"), ab, words(spark, word=1)).orderBy("seg").collect()
    assert [r["alt"] for r in got] == ["laughing out loud", "brb", "word"]
    masked = tokens(spark, "LOL").withColumn("to_correct", F.lit(False))
    assert suggest.abbreviation(masked, ab, words(spark, word=1)).collect()[0]["alt"] == "LOL"


def test_compound(spark):
    got = suggest.compound(tokens(spark, "foot ball game"), words(spark, football=1)).orderBy("seg").collect()
    assert [(r["ori"], r["alt"]) for r in got] == [("foot ball", "football"), ("", ""), ("game", "game")]
    got = suggest.compound(tokens(spark, "a b c d"), words(spark, ab=1, bc=1, cd=1)).orderBy("seg").collect()
    assert [r["ori"] for r in got] == ["a b", "", "c d", ""]


def test_compound_is_the_greedy_choice(spark):
    rng = random.Random(3)
    lex = {"ab", "ba", "aa"}
    texts = [" ".join(rng.choice("abc") for _ in range(12)) for _ in range(60)]
    got = {}
    for r in suggest.compound(tokens(spark, *texts), spark.createDataFrame([(w, 1) for w in lex], "word string, freq bigint")).collect():
        got.setdefault(r["msg_id"], {})[r["seg"]] = r["ori"]
    for i, t in enumerate(texts):
        w, k, want = t.split(), 0, {}
        while k < len(w):
            if k + 1 < len(w) and w[k] + w[k + 1] in lex:
                want[k], want[k + 1] = f"{w[k]} {w[k + 1]}", ""
                k += 2
            else:
                want[k] = w[k]
                k += 1
        assert got[i] == want


def levenshtein(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
        row = new
    return row[-1]


def test_spelling_equals_brute_force(spark):
    rng = random.Random(4)
    lex = {"".join(rng.choice("abcé") for _ in range(rng.randint(2, 6))): rng.randint(1, 9) for _ in range(80)}
    toks = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    got = {r["ori"]: r["alt"] for r in suggest.spelling(tokens(spark, " ".join(toks)), spark.createDataFrame(list(lex.items()), "word string, freq bigint")).collect()}
    for t in toks:
        near = sorted((levenshtein(t, w), -f, w) for w, f in lex.items() if levenshtein(t, w) <= 2)
        assert got[t] == (t if t in lex or not near else near[0][2])


def test_entities(spark):
    got = suggest.entity_flags(tokens(spark, "he met Bob", "@jan Hi . Then"), spark.createDataFrame([], "key string")).orderBy("msg_id", "seg").collect()
    assert [r["is_ne"] for r in got] == [False, False, True, True, True, False, False]


def test_preclassify(spark):
    model = spark.createDataFrame([("<s>", "x", 1)], "w1 string, w2 string, cnt bigint")
    got = filtering.preclassify(tokens(spark, "x y z"), model).orderBy("pos").collect()
    assert [r["pos"] for r in got if r["to_correct"]] == [1, 2]


def test_ngrams(spark):
    assert one(spark, lambda t: X.ngrams(t, 2), "a b") == ["#a a# #b b#"]
    texts = ["a b", "hello world", "x", "één twee"]
    for n in (1, 2):
        assert one(spark, lambda t: X.from_ngrams(X.ngrams(t, n), n), *texts) == texts


def test_windows(spark):
    assert one(spark, X.windows, "ab")[0][0] == "0-@ 1-@ 2-@ 3-@ 4-@ 5-a 6-b 7-@ 8-@ 9-@".split()


def test_rates(spark):
    df = spark.createDataFrame([("the cat sat on", "the bat sat"), ("", "x"), ("a b", "")], "r string, h string")
    got = [tuple(r) for r in df.select(X.wer(F.col("r"), F.col("h")), X.cer(F.col("r"), F.col("h"))).collect()]
    assert got == [(0.5, 0.286), (None, None), (1.0, 1.0)]


def test_word_distances_agree(spark):
    rng = random.Random(5)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 7))], [rng.choice("abcd") for _ in range(rng.randint(0, 7))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", X.edit_distance(F.col("a"), F.col("b")).alias("x"), X.table_distance(F.col("a"), F.col("b")).alias("y")).collect():
        assert r["x"] == r["y"] == levenshtein(r["a"], r["b"])


def test_alignment_segments_cover_both_texts():
    rng = random.Random(6)
    for _ in range(60):
        a = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6)))
        b = " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6)))
        pairs, _ = align.aligned(a, b)
        assert " ".join(o for o, _ in pairs) == a and " ".join(t for _, t in pairs) == b
    assert align.aligned("I saw u", "I saw you") == ([("I", "I"), ("saw", "saw"), ("u", "you")], False)
    pairs, fallback = align.aligned(" ".join(["x"] * 260), "y z")
    assert fallback and pairs[0] == ("x", "y") and len(pairs) == 2


def test_first_original_is_kept(spark):
    s = spark.createDataFrame([(1, 0, 0, "original", "u", "you"), (1, 1, 1, "abbreviation", "yu", "you ")], "msg_id bigint, seg int, mod_ord int, module string, ori string, alt string")
    (r,) = decide.phrases(s).collect()
    assert (r["ori"], r["modules"]) == ("u", ["abbreviation", "original"])
    assert decide.phrases(s, keep_all_origins=True).count() == 2


def test_viterbi_follows_the_bigrams(spark):
    s = spark.createDataFrame([(1, 0, 0, "a", "c", "see"), (1, 0, 1, "b", "c", "sea"), (1, 1, 0, "a", "u", "you")], "msg_id bigint, seg int, mod_ord int, module string, ori string, alt string")
    model = spark.createDataFrame([("<s>", "see", 5), ("see", "you", 9), ("you", "</s>", 5)], "w1 string, w2 string, cnt bigint")
    assert [r["tgt"] for r in decide.viterbi(s, model).orderBy("seg").collect()] == ["see", "you"]


def test_classification_of_a_word_split(spark):
    p = spark.createDataFrame([(1, 0, "m", "studente", "stu dente", "studente", False)], "post_id bigint, seg int, module string, ori string, alt string, tgt string, is_ne boolean")
    r = evaluate.counters(p).collect()[0]
    assert (r["I"], r["S"], r["D"], r["N"]) == (1, 1, 0, 1)


def test_gold_tags(spark):
    g = spark.createDataFrame([(1, "p", ["foot", "ball", "<LINEBREAK>", "gonna", "<split>"], ["foot", "ball", "<LINEBREAK>", "gonna", "<split>"], ["football", "<com>", "<LINEBREAK>", "going", "to"], [0])], "post_id bigint, post string, ori array<string>, tok array<string>, tgt array<string>, ne array<int>")
    got = evaluate.realigned(evaluate.gold_tokens(g)).orderBy("pair").collect()
    assert [(r["ori"], r["tgt"]) for r in got] == [("foot ball", "football"), ("gonna", "going to")]


def test_worst_combination(spark):
    o = spark.createDataFrame([(1, "m", "a b", [["a", "x"], ["b"]])], "post_id bigint, module string, ref string, lists array<array<string>>")
    assert evaluate.worst_combination(o).collect()[0]["wer"] == 0.5


def test_operation_language(spark):
    (ops,) = one(spark, gold.parsed, "a<del>b</del>#§c§d")
    assert [(o["type"], o["text"]) for o in ops] == [("normal", "a"), ("deletion", "b"), ("insertion", "#"), ("substitution", "c"), ("normal", "d")]


@pytest.mark.parametrize(
    "series, text, want",
    [
        ([["normal", "a", None], ["deletion", "b", None], ["insertion", "#", None]], "ax", (["a", "", "x"], None)),
        ([["normal", "a", None], ["substitution", "b", None], ["normal", "c", None]], "axyc", (["a", "xy", "c"], None)),
        ([["transposition", "ab", None], ["normal", "c", None]], "bac", (["ba", "c"], None)),
        ([["transposition", "ab", None]], "xy", ([], "NoPermMatch")),
        ([["normal", "a", None]], "b", ([], "NormCorrespondence")),
        ([["normal", "a", None]], "ab", (["a"], "Surplus")),
        ([["substitution", "a", None], ["substitution", "b", None]], "xyz", ([], "UnequalLengthSubstitution")),
    ],
)
def test_series_alignment(series, text, want):
    out, error = gold.align_entire(series, text)
    assert ([x[2] for x in out], error) == want


def test_permutations_and_overlap():
    assert gold.permutations("aab") == {"aab", "aba", "baa"}
    assert gold.overlap("xab", "aby") == "ab"
    with pytest.raises(gold.AlignError):
        gold.overlap("a", "b")


def test_validation(spark):
    rows = spark.createDataFrame([(1, "ab", "", "", ""), (2, "ab", "ab", "", "xy"), (3, "ab", "ab", "<del>ab", "a"), (4, "ab", "ab", "a§c§", "ad"), (5, None, None, None, None)], "row_no bigint, anom string, tok string, oper string, norm string")
    got = {r["row_no"]: r["error_code"] for r in gold.validated(rows).collect()}
    assert got == {1: None, 2: "NoOperations", 3: "DelTag", 4: "TokCorrespondence", 5: None}
    assert gold.aligned(rows).where("row_no = 1").collect()[0]["series"][1]["alignment"] == "b"


def test_sheet_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,,"skip, me",foo,,,,,,,\n,,,bar,,,,,,,\n,,"a ""post""",u,,,you,,,,x\n,,,see\xa0 it,,,,y,,,\n', encoding="utf-8")
    sheet = readers.read_sheet(spark, str(tmp_path / "a.csv"))
    rows = readers.gold_rows(readers.without_skipped(sheet)).orderBy("row_no").collect()
    assert [(r["post"], r["ori"], r["tok"], r["tgt"], r["is_ne"]) for r in rows] == [('a "post"', "u", "u", "you", True), ('a "post"', "see it", "•", "•", False)]
    rec = readers.gold_records(readers.gold_rows(readers.without_skipped(sheet))).collect()[0]
    assert (rec["tgt"], rec["ne"]) == (["you", "•"], [0])


def test_google_docs(spark):
    assert one(spark, readers.google_docs, "'+1", "'=x", "''t", "'06", "plain") == ["+1", "=x", "'t", "06", "plain"]


def test_config(tmp_path):
    p = tmp_path / "run.ini"
    p.write_text("[Language]\nlanguage=nl\n[Modules]\nmodules=original,compound\n[Filter]\nfilter=hard\n[SETTING]\nsetting=2c\n")
    c = readers.read_config(str(p))
    assert (c.language, c.filter, c.modules, c.setting) == ("nl", "hard", ("original", "compound"), "2c")
    p.write_text("[Language]\nlanguage=nl\n")
    with pytest.raises(KeyError):
        readers.read_config(str(p))


def test_json_words_and_width(spark, tmp_path):
    p = tmp_path / "ab.json"
    p.write_text('{"lol": "laughing out loud",\n "aub": "alstublieft"}')
    assert readers.read_json_words(spark, str(p)).count() == 2
    short = spark.createDataFrame([(["a"],)], "row array<string>")
    with pytest.raises(Exception, match="too few cells"):
        readers.checked_width(short, "row", 0).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, " "), (3, None)], "msg_id bigint, text_norm string")
    sinks.write_text(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() >= 3
    assert [tuple(r) for r in sinks.deleted_lines(df, "text_norm").collect()] == [(1, 2)]
    src = str(tmp_path / "in.txt")
    (tmp_path / "in.txt").write_text("one\ntwo\n")
    with pytest.raises(FileExistsError):
        readers.read_new(spark, src, str(tmp_path / "out"))
    assert readers.read_new(spark, src, str(tmp_path / "new")).count() == 2


def test_ranked(spark):
    rows = [(random.Random(i).randint(0, 50), i) for i in range(200)]
    got = pipeline.ranked(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "n").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows) and sorted(r["n"] for r in got) == list(range(1, 201))


def resources(spark):
    return {
        "lexicon": words(spark, see=9, you=9, football=3),
        "abbreviation": spark.createDataFrame([("u", "you")], "key string, expansion string"),
        "flooding_abbrev": spark.createDataFrame([("lol",)], "key string"),
        "gazetteer": spark.createDataFrame([("bob",)], "key string"),
        "gold": spark.createDataFrame([(1, "c u", ["c", "u"], ["c", "u"], ["see", "you"], [])], "post_id bigint, post string, ori array<string>, tok array<string>, tgt array<string>, ne array<int>"),
        "bigram": spark.createDataFrame([("<s>", "see", 3), ("see", "you", 3), ("you", "</s>", 3)], "w1 string, w2 string, cnt bigint"),
    }


@pytest.mark.parametrize("mode, decoder", [("none", "place"), ("none", "viterbi"), ("hard", "place"), ("soft", "place")])
def test_normalize(spark, mode, decoder):
    m = spark.createDataFrame([(1, "c uuuu foot ball"), (2, ""), (3, None)], "msg_id bigint, text_orig string")
    got = {r[0]: r[1] for r in pipeline.normalize(m, resources(spark), ["original", "abbreviation", "compound", "smt_token"], mode, decoder=decoder).collect()}
    assert got[2] == got[3] == "\n" and len(got) == 3
    if mode == "none" and decoder == "viterbi":
        assert got[1].startswith("see")


def test_best_by_token_equals_best_by_place(spark):
    res, rng = resources(spark), random.Random(5)
    rows = [(m, i, rng.choice(["c", "u", "foot", "ball", "seee", "you", "yuo", "football", "lol"]), rng.random() < 0.8) for m in range(40) for i in range(8)]
    t = spark.createDataFrame(rows, "msg_id bigint, pos int, tok string, to_correct boolean")
    for names in (list(suggest.FULL["nl"]), ["original", "abbreviation", "compound", "smt_token"], ["original", "spelling"]):
        for tokens in (t, t.drop("to_correct")):
            want = decide.best_by_place(decide.union({n: suggest.modules(res)[n](tokens) for n in names}), res["lexicon"])
            at = names.index("compound") if "compound" in names else None
            got = decide.best_by_token(suggest.compound_rows(tokens, res["lexicon"]) if at is not None else suggest.unchanged_rows(tokens), suggest.token_options(tokens, names, res), res["lexicon"], at)
            key = lambda df: sorted((r["msg_id"], r["seg"], r["tgt"]) for r in df.collect())
            assert key(got) == key(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "msg_id bigint, pos int, tok string")
    res = resources(spark)
    for name, module in suggest.modules(res).items():
        assert module(none).count() == 0, name
    assert filtering.preclassify(none, res["bigram"]).count() == 0
    m = spark.createDataFrame([], "msg_id bigint, text_orig string")
    assert pipeline.normalize(m, res).count() == 0


def test_stream(spark, tmp_path):
    from tidewrit.streaming import stream

    src = str(tmp_path / "in")
    spark.sql("select 1L msg_id, 'sms' channel, 'hoi :-)' text_orig, timestamp '2024-01-01' ingested_at union all select 1L, 'sms', 'hoi :-)', timestamp '2024-01-01 10:00:00'").write.parquet(src)
    s = stream.message_stream(spark, src, spark.read.parquet(src).schema)
    q = stream.start(stream.preprocessed(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["text_prepro"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hoi •"]
