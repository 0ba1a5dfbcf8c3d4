import random

import pytest
from pyspark.sql import functions as F

from proofline.llm import canonical, consensus, encode, language, mix, scans, sentences, spans


def test_shared_runs_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = [word(40), word(29), word(75)]
    rows = [(i, f"o{i % 9}", word(rng.randrange(0, 60)) + rng.choice([*common, ""]) + word(rng.randrange(0, 40))) for i in range(60)] + [(90, None, None), (91, "x", ""), (92, "y", "a" * 500), (93, "z", "a" * 400)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:5]], "record long, owner string, text string, owner_id int")
    got = {(r["record_a"], r["record_b"]) for r in spans.shared_pairs(df, 30).collect()}
    texts = {r[0]: (r[1], r[2] or "") for r in rows}
    want = set()
    for a, (oa, ta) in texts.items():
        grams = {ta[i : i + 30] for i in range(len(ta) - 29)}
        want |= {(a, b) for b, (ob, tb) in texts.items() if a < b and oa != ob and any(tb[i : i + 30] in grams for i in range(len(tb) - 29))}
    assert got == want and (92, 93) in got


def test_shared_spans_and_removal(spark):
    x = "".join(chr(97 + (i * 7) % 23) + str(i) for i in range(80))
    df = spark.createDataFrame([(1, "a", "pre " + x + " post"), (2, "b", x), (3, "c", None), (4, "d", "")], "record long, owner string, text string")
    rows = {r["record"]: r for r in spans.shared_spans(df, 60).collect()}
    assert (rows[1]["start_char"], rows[1]["end_char"], rows[1]["kept"]) == (4, 4 + len(x), True) and rows[2]["shared_share"] == 1.0 and rows[3]["shared_chars"] == 0
    left = {r["record"]: r["text"] for r in spans.remove_repeats(df, 60).collect()}
    assert left[1] == "pre " + x + " post" and left[2] == "" and left[3] is None and left[4] == ""
    assert spans.shared_spans(df.limit(0), 60).isEmpty()


def test_recurring_passages_stay_in_their_first_record(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    a, b, c = word(100), word(120), word(90)
    rows = [(1, "a", word(20) + a), (3, "b", a + b + word(9)), (5, "c", word(30) + b), (6, "d", a[40:] + b[:50]), (7, "e", b[60:] + c), (8, "f", c + word(40) + a), (9, "g", b[80:] + c + a[:30])]
    df = spark.createDataFrame(rows, "record long, owner string, text string")
    left = {r["record"]: r["text"] for r in spans.remove_repeats(df, 60).collect()}
    first = {}
    for i, _, t in rows:
        for g in {t[x : x + 60] for x in range(len(t) - 59)}:
            first.setdefault(g, []).append(i)
    recurring = {g: held for g, held in first.items() if len(held) > 1}
    assert len(recurring) > 100 and all(g in left[held[0]] for g, held in recurring.items())
    assert b in left[3] and b not in left[5] and a not in left[3]
    for r in spans.shared_spans(df, 60).where("start_char is not null").collect():
        assert r["kept"] == (r["first_record"] == r["record"])


def test_copies_of_a_passage_are_not_paired(spark):
    x, n = "".join(chr(97 + (i * 7) % 23) + str(i) for i in range(120)), 3000
    df = spark.createDataFrame([(i, f"o{i}", x) for i in range(n)], "record long, owner string, text string")
    found = spans.shared_places(df, 150)
    assert found.links.count() < 100 and found.members.select("record").distinct().count() == n
    rows = spans.shared_spans(df, 150)
    assert rows.where("kept").count() == 1 and rows.where(f"not kept and first_record = 0 and shared_chars = {len(x)}").count() == n - 1


def test_spans_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = [word(45), word(70), word(33)]
    rows = [(i, f"o{rng.randrange(6)}", word(rng.randrange(0, 40)) + rng.choice(common)[rng.randrange(5) :] + word(rng.randrange(0, 20)) + rng.choice([*common, ""])) for i in range(50)]
    shared = {i: set() for i, _, _ in rows}
    for i, o, t in rows:
        for j, p, u in rows:
            if o != p:
                shared[i] |= {x + y for x in range(len(t) - 29) if t[x : x + 30] in u for y in range(30)}
    got = {i: set() for i, _, _ in rows}
    df = spark.createDataFrame(rows, "record long, owner string, text string")
    for r in spans.shared_spans(df, 30).where("start_char is not null").collect():
        got[r["record"]] |= set(range(r["start_char"], r["end_char"]))
    assert got == shared


def test_canonical_text():
    same = [("ｌｏｇ", "log"), ("café", "café"), ("a​b", "ab"), ("a  b ", "a b"), ("рауѕе", "paуѕe"), ("ﬁne", "fine"), ("Ω", "Ω"), ("co‑op", "co-op"), ("が", "が"), ("“x”", '"x"'), ("е́", "é")]
    for a, b in same:
        assert canonical.canonical_text(a) == canonical.canonical_text(b), (a, b)
    for a, b in (("cm²", "cm2"), ("O", "0"), ("l", "1"), ("é", "e"), ("A", "a")):
        assert canonical.canonical_text(a) != canonical.canonical_text(b)
    assert canonical.canonical_text(None) is None and canonical.canonical_text(" ​ ") == ""
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x580), rng.randrange(0x2000, 0x2100), rng.randrange(0x3040, 0x3100), 0xFB01])) for _ in range(rng.randrange(12)))
        c = canonical.canonical_text(t)
        assert canonical.canonical_text(c) == c
        assert c == " ".join(canonical._normalise(t).split(" ")).strip() or "  " in canonical._normalise(t)


def test_chains_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    sizes, n = [3, 1, 4], 3
    z, t = rng.normal(size=(sum(sizes), n)), rng.normal(size=(n, n))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    p, moved = language._Chains(doc, np.ones(len(doc), bool)).expected(z, t)
    want, steps, at = np.zeros_like(z), np.zeros((n, n)), 0
    for size in sizes:
        paths = list(itertools.product(range(n), repeat=size))
        weights = np.exp([sum(z[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])) for path in paths])
        for path, w in zip(paths, weights / weights.sum()):
            for i, y in enumerate(path):
                want[at + i, y] += w
            for a, b in zip(path, path[1:]):
                steps[a, b] += w
        at += size
    assert np.allclose(p, want) and np.allclose(moved, steps)


def test_consensus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        truth = rng.choice(consensus.VERDICTS)
        rows += [("p", i, n, truth if rng.random() < 0.9 else "unclear", f"2026-01-01T00:00:{j:02d}Z") for j, n in enumerate(("ann", "ben", "cyd"))]
        rows += [("p", i, s, "partial", "2026-01-02T00:00:00Z") for s in ("spam1", "spam2", "spam3")]
        rows.append(("p", i, "TRUTH", truth, None))
    df = spark.createDataFrame([*rows, ("p", 1, " Ann ", " Supported\t", "2027-01-01T00:00:00Z"), ("p", 2, None, "supported", None), ("p", 3, "ann", "todo", None)], "id string, claim int, reviewer string, verdict string, reviewed_at string")
    votes = consensus.valid_verdicts(df)
    assert votes.where("claim = 1 and annotator = 'ann'").first()["label"] == "supported"
    fitted = consensus.consensus(votes, iterations=12)
    truths = {r[1]: r[3] for r in rows if r[2] == "TRUTH"}
    got = {r["claim"]: r["verdict"] for r in fitted.items().collect()}
    assert sum(got[c] == t for c, t in truths.items()) > 140
    trust = {r["annotator"]: r["competence"] for r in fitted.annotators().collect()}
    assert trust["spam1"] < 0.3 < 0.6 < trust["ann"]
    # The mixture as a table, for any number of annotators, comes to the same.
    table = consensus.consensus(votes, iterations=12, most_sent=2)
    assert {r["claim"]: (r["verdict"], round(r["confidence"], 6), r["reviewers"]) for r in table.items().collect()} == {r["claim"]: (r["verdict"], round(r["confidence"], 6), r["reviewers"]) for r in fitted.items().collect()}
    assert all(abs(r["competence"] - trust[r["annotator"]]) < 1e-9 for r in table.annotators().collect())


def test_sentences(spark):
    train = ["The log of a read \"it stopped at 2.5 cm². Restart it.\" and closed. Only one, two, etc. remained here. Dr. Mara came at 3.5 mm.", "Dr. Oska saw it, e.g. here (cf. Fig. 3). The end came.The rest, etc. followed later.", "The dr. came, etc. and Dr. Nils left. The thing."] * 6
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(train)] + [(90, None, True), (91, "  ", True), (92, "他说“停。再来。”，然后走了。第二句。", True)], "record long, text string, whole boolean")
    got = {}
    for r in sentences.sentences(df).collect():
        got.setdefault(r["record"], []).append(r["text"])
    assert got[0] == ['The log of a read "it stopped at 2.5 cm². Restart it." and closed.', "Only one, two, etc. remained here.", "Dr. Mara came at 3.5 mm."]
    assert got[1][-2:] == ["The end came.", "The rest, etc. followed later."] and 90 not in got and 91 not in got
    assert got[92] == ["他说“停。再来。”，然后走了。", "第二句。"]


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.default_vocabulary())
    t.encode_special_tokens = True
    texts = ["a￿!b", "￿", "  \n\n x", "<|endoftext|>", "a" * 3000, "é" * 300, "日本語ーンの魔", "", "'s'll don't", "\U0001f600\x00\x01 \t", "x"]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate([*texts, None])] + [(0, texts[0], "c")], "doc_id long, text string, ids string")
    rows = encode.encode(df)
    got = rows.withColumn("text", encode.decode("ids")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        x = [*texts, None][r["doc_id"]]
        assert list(r["ids"]) == (t.encode(x, add_special_tokens=False).ids if x else []) and r["text"] == (x or "")


def test_mix(spark):
    sized = spark.createDataFrame([(i, "big", 10) for i in range(400)] + [(1000 + i, "small", 7) for i in range(20)] + [(5000, None, 5), (5001, "other", 9), (5002, "big", None)], "doc_id long, source string, size long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 9)], "source string, target_share double, max_repeats int")
    mixture, plan = mix.mix(sized, targets)
    rows = {r["source"]: r for r in mix.shares(mixture, plan).collect()}
    assert abs(rows["big"]["actual_share"] - 0.625) < 0.01 and abs(rows["small"]["actual_share"] - 0.375) < 0.01
    assert rows["small"]["most_copies"] == 4 and rows["other"]["size_used"] == 0 and rows["absent"]["size_used"] == 0 and rows[None]["size_used"] == 0
    assert mix.shares(*mix.mix(sized.limit(0), targets)).agg(F.sum("size_used")).first()[0] == 0


def test_language():
    en = ["The pump held at nine km. We found that the shell broke during the night shift."] * 12
    nl = ["De pomp bereikte de waarde bij drie km. Hoewel het monster tijdens de nachtdienst brak."] * 12
    ru = ["Проба изменила время сушки у выпуска. При этом камера ограничила долю соли."] * 12
    field = language.fit([(t, "en") for t in en] + [(t, "nl") for t in nl] + [(t, "ru") for t in ru] + [(en[0], "nl")], ["en", "nl", "ru"])
    text = " " + en[0] + " " + nl[0]
    starts, words = language._sentences(text)
    p = language._posteriors([len(starts)], language._Scorer(field)(words), field.transitions)
    runs = language._runs(text, starts, p, p.max(1) > 0, p.max(1) > 0, field.languages)
    assert [(r["start_char"], r["lang"]) for r in runs] == [(1, "en"), (len(en[0]) + 2, "nl")]


def test_labels_and_nulls(spark):
    codes = spark.createDataFrame([("en", "English", "Latin"), ("nl", "Dutch", "Latin")], "code string, lang_name string, script string")
    df = spark.createDataFrame([(x,) for x in ("en", " EN ", "en-GB", "nld", "dutch", "und", "", None)], "l string")
    assert [r[0] for r in df.select(language.label_code(F.col("l"), codes)).collect()] == ["en", "en", "en", "nl", "nl", None, None, None]
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 | 34", None)], "doc_id long, text string, lang string")
    field = language.train(docs, codes)
    assert language.mislabelled(language.identify(docs, field), codes).isEmpty()


def test_scans(spark):
    names = ["umbel", "vorda", "kazir", "petol", "ganim", "lusor", "hefra", "miqua", "dobex"]
    body = ["We found that the sample reduced the salt fraction", "of the outer shell beneath the insulation during the", "night shift, while the low-", "frequency response followed the mea-", "sured drift at 12.5 mm."]
    pages = [("d", i, i, "\n".join(["Ras and Kra   " + str(i), " ".join(names[: i + 1]) + " opens here", *body, "and " + " ".join(names[: i + 1]) + " ended.", "Acta Notes, vol. 3"])) for i in range(1, 9)]
    broken = ["umbel vorda kazir petol ganim lusor hefra miqua dobex tyrun opens here", "We f0und that the sarnple reduced the salt fraction", *body[1:4], "sured drift at l2.5 mm.", "and umbel vorda kazir petol ganim lusor hefra miqua dobex tyrun ended."]
    pages += [("d", 9, 9, "\n".join(["Ras and Kra   9", *broken, "Acta Notes, vol. 3"])), ("e", 20, 1, ""), ("e", 21, 1, None), ("e", 22, 2, "\n \n")]
    plain = [("p", 100 + i, i, "the low-frequency response found sample measured") for i in range(6)]
    df = spark.createDataFrame(pages, "doc string, record long, page int, text string")
    texts = spark.createDataFrame(pages + plain, "doc string, record long, page int, text string")
    rows = {r["record"]: r for r in scans.repair(df.where("text is not null"), texts=texts).collect()}
    kinds = sorted((x["line_no"], x["kind"]) for x in rows[9]["lines"])
    assert kinds == [(1, "furniture"), (3, "misread"), (6, "hyphen"), (7, "misread"), (9, "furniture")]
    assert "tyrun opens here We found that the sample reduced" in rows[9]["paragraphs"][0] and "measured drift at 12.5 mm." in rows[9]["paragraphs"][0]
    assert rows[20]["lines"] == [] and rows[22]["paragraphs"] == []


def test_frequent_misreads_are_no_words(spark):
    native = [("the rate held within the hours of a low law", True)] * 150
    scanned = [("the rate held within the hours of a low law", False)] * 150 + [("it held wlthin two hoiirs here", False)] * 6
    lexicon = scans.learn_lexicon(spark.createDataFrame(native + scanned, "text string, native boolean"))
    assert {"within", "hours", "low", "law"} <= set(lexicon.words) and not {"wlthin", "hoiirs"} & set(lexicon.words)
    found, paragraphs = scans.judge_page("it held wlthin two hoiirs here\nand a law of the low rate", set(), lexicon.built())
    assert (1, "misread") in found and paragraphs[0].startswith("it held within two hours here")
    # a form that native text has is a word, however much more frequent its neighbour; little text decides nothing
    many = {"low": 4000, "law": 60, "lew": 60}
    assert scans.misread_forms(many, {"low": 2000, "law": 30}, 50_000, 100_000) == {"lew"}
    assert scans.misread_forms({"low": 400, "law": 10}, {}, 0, 1000) == set()


def test_numbers_and_words_across_a_period(spark):
    plain = ["Die Probe hielt bei der Pumpe auf Stufe %d. Neustart der Pumpe nach der Schicht. Neustart mit der Probe. Die Schicht kam.", "Der Wert fiel am %d. Mai. Die Pumpe hielt.", "Die Pumpe stand im Mai nicht still. Der Wert fiel."]
    train = [t % i if "%d" in t else t for i in range(1, 25) for t in plain]
    once = ["Das Ventil hielt auf Stufe 77. Korvane stieg unter der Pumpe."] * 4  # copies: one number only
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(train + once)], "record long, text string, whole boolean")
    stats = sentences.learn(df)
    cut = lambda t: [t[a:b] for a, b in sentences.split_text(t, stats)]
    assert cut("Der Wert fiel am 6. Mai. Die Pumpe hielt.") == ["Der Wert fiel am 6. Mai.", "Die Pumpe hielt."]
    assert cut("Die Probe hielt auf Stufe 6. Neustart der Pumpe.") == ["Die Probe hielt auf Stufe 6.", "Neustart der Pumpe."]
    assert cut(once[0]) == ["Das Ventil hielt auf Stufe 77.", "Korvane stieg unter der Pumpe."]


def test_language_sample_counts_copies_once(spark, monkeypatch):
    codes = spark.createDataFrame([("en", "English", "Latin"), ("nl", "Dutch", "Latin")], "code string, lang_name string, script string")
    english = [f"The pump number {i} held at nine and the shell broke." for i in range(40)]
    dutch = [f"De pomp nummer {i} bereikte de waarde en het monster brak." for i in range(40)]
    docs = [(t, "en") for t in english] + [(english[0], "en")] * 400 + [(t, "nl") for t in dutch]
    taken = []
    monkeypatch.setattr(language, "fit", lambda rows, languages: taken.extend(rows) or languages)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], "doc_id long, text string, lang string")
    assert language.train(df, codes, 20) == ["en", "nl"]
    assert len(taken) == len(set(taken)) == 40 and sum(c == "en" for _, c in taken) == 20
