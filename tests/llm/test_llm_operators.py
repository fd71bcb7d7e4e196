"""Small cases of the training-data operators: rules, nulls, empties, repeats, long texts, clashing columns."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recordspark.llm import abuse, boosting, cooccurrence, emails, formdup, leakage, mixture, names, nicknames, pii, scans, truncation

WORDS = "ledger harbour window garden yellow marble copper ticket winter summer doctor bridge castle engine forest island jacket kettle ladder magnet needle orange pencil rabbit saddle tunnel violin walnut zipper anchor basket candle".split()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def clash(df):
    """Extra columns under names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("key", "text2", "n", "block", "first", "item", "record", "source2", "cluster", "root", "fp", "kind", "h", "bucket")})


# 1


def test_parse_person():
    p = names.parse_person
    assert p("Leonard  Sti teinpisk") == p("STITEINPISK Leonard") == p("Stiteinpisk, Leonard") == p("Dr. Len Stiteinpisk") == p("Leonard Q. Stiteinpisk") == ("stiteinpisk", "leonard", "l")
    assert p("Stiteinpisk, L.") == p("L. Stiteinpisk") == ("stiteinpisk", "", "l")
    assert p("Capt. Stiteinpisk") == ("stiteinpisk", "", "")
    assert p("Lenoard Stiteinpisk")[1] == "leonard"
    assert p("Leonard Stíteinpisk")[0] == "stiteinpisk"
    assert p("---") is None


def test_parse_firm():
    trades = frozenset(["mining", "paper"])
    f = lambda x: names.parse_firm(x, trades)
    assert f("The Wovanfal Mining Cooperative (UK)") == f("WOVANFAL MINING CO-OP") == f("Cooperative Wovanfal Mining") == f("Wovanfal Mnining Co-op") == ("wovanfal", "mining", "cooperative")
    assert f("Wovanfal M.C.") == ("wovanfal", "", "m.c.")
    assert names.parse_place("Point of Epdumdren") == names.parse_place("Epdumdren Pt.") == ("epdumdren", "point", "")


def test_comparers():
    assert names.distance_one("abcd", "abdc") and names.distance_one("abcd", "abd") and names.distance_one("abcd", "abxd") and not names.distance_one("abcd", "axyd")
    assert round(names.jaro_winkler("martha", "marhta"), 3) == 0.961
    assert names.phonetic("phillip") == names.phonetic("filip")
    assert nicknames.formal_names()["nell"] >= {"eleanor", "helena"}


ENTITIES = "id long, canonical_name string, entity_type string, first_name string, aliases array<string>"


def test_same_entities(spark):
    e = spark.createDataFrame(
        [
            (1, "Leonard Stiteinpisk", "person", None, []), (2, "STITEINPISK Leonard", None, None, None), (3, "L. Stiteinpisk", "PER", None, None), (4, "Len Stiteinpsik", "person", None, []),
            (5, "Margaret Stiteinpisk", "person", None, None), (6, None, "person", None, None), (7, "", None, None, []), (8, "Wovanfal Mining Trust", "org", None, None),
            (9, "Wovanfal-Mining Tr.", "ORG", None, [None, ""]), (10, "Wovanfal Paper Trust", "org", None, None), (11, "Bilu Mining Trust", "org", None, None), (12, "Keru Mining Trust", "org", None, None),
            (13, "Bilu Paper Trust", "org", None, None), (14, "Keru Paper Trust", "org", None, None), (2, "STITEINPISK Leonard", None, None, None), (15, "Other Person", "person", None, ["Wenda Pospisk"]), (16, "Wenda Pospisk", "person", None, None),
        ],
        ENTITIES,
    )
    m = spark.createDataFrame([(1, "Leonard Stiteinpisk"), (None, "Ghost"), (99, "Nobody Known"), (3, None)], "entity_id long, name_as_appears string")
    got = rows(names.same_pairs(names.same_entities(clash(e), clash(m))))
    assert got == sorted([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (8, 9), (15, 16)], key=str)


def test_same_entities_empty(spark):
    none = spark.createDataFrame([], ENTITIES)
    assert rows(names.same_entities(none, spark.createDataFrame([], "entity_id long, name_as_appears string"))) == []


def test_large_block_is_compared_whole(spark):
    k = spark.createDataFrame([(f"P|stiteinpis{a}{b}|ann", "P", f"stiteinpis{a}{b}", "ann") for a in "aeiou" for b in "aeiou"], "key string, cls string, rare string, other string")
    assert rows(names.like_keys(k, block_size=3)) == rows(names.like_keys(k, block_size=1000)) != []


# 2


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("It was done. The board sec", "terminator"), ("It was done.", ""), ("It was done ...", "trace"), ("All was well. It was [text shortened]", "trace"), ("It was moved to the hou�", "broken"), ('{"A": "b", "C": "d', "open"), ('{"A": "b {"}', ""),
        ("It is done.\n\nRegards,\nAnn Lee", ""), ("It is done.\n\nAnn Lee\nT 555-0123\nann@b.example", ""), ("The end came.\nPage 3 of 4", ""), ("It was told by Mr.", "terminator"), ("From: a\nTo: b\nSubject: RE: contr", "open"), ("", ""), ("   ", ""), ("Totals\nSheet total 5 legs", ""),
    ],
)
def test_ending(text, why):
    assert truncation.ending(text) == why


TEXTS = "document_id long, full_text string, pages_text array<string>, word_count int"


def test_field_limits(spark):
    rng = random.Random(1)
    cut = []
    for i in range(8):
        t = " ".join(sentence(rng) for _ in range(30))[:500]
        cut.append((i, t, None, None))
    whole = [(100 + i, " ".join(sentence(rng) for _ in range(3 + i)), None, None) for i in range(8)]
    edge = [(200, None, None, None), (201, "", None, None), (202, " \n ", None, None), (203, "One two three four.", None, 30), (204, "Alpha beta gamma delta epsilon zeta.", ["Alpha beta gamma delta epsilon zeta.", "And then there was more of it."], None), (205, "A word. " * 50_000, None, None)]
    t = clash(spark.createDataFrame(cut + whole + edge + cut[:1], TEXTS))
    d = spark.createDataFrame([(i, "Release 4") for i in range(8)] + [(100 + i, "release-05") for i in range(8)] + [(203, None)], "id long, data_set string")
    got = {r["document_id"]: (r["cut"], r["source"]) for r in truncation.judged(t, clash(d)).collect()}
    assert all(got[i] == (True, "release4") for i in range(8))
    assert not any(got[100 + i][0] for i in range(8))
    assert got[203] == (True, "") and got[204][0] and not got[205][0]
    assert not {200, 201, 202} & set(got)
    rates = {r["source"]: (r["texts"], r["cut_texts"]) for r in truncation.truncation_rates(truncation.judged(t, d)).collect()}
    assert rates["release4"] == (8, 8) and rates["release5"] == (8, 0)


def test_beginning_of_a_longer_text(spark):
    rng = random.Random(2)
    whole = " ".join(sentence(rng) for _ in range(20))
    t = spark.createDataFrame([(1, whole[:400]), (2, whole), (3, whole.upper()), (4, whole[:50])], "document_id long, full_text string")
    assert rows(truncation.prefix_of_longer(t)) == [(1,), (4,)]


def test_half_words(spark):
    inner = ["The timetable was read aloud here."] * 20 + ["One leg of the journey, one leg only."] * 3 + ["The legal matter rests."] * 30
    # the same half word ends two texts; one that stands elsewhere too is whole, as is one that begins nothing
    ends = ["Alpha notes\nof a timetabl", "Other notes\nof a Timetabl \n", "Third notes\nof a leg", "Fourth notes\nof a walrus"]
    t = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(inner + ends)], TEXTS)
    assert rows(truncation.half_words(t)) == [("timetabl",)]
    d = spark.createDataFrame([(0, "x")], "id long, data_set string")
    got = {r["document_id"] for r in truncation.judged(clash(t), clash(d)).collect() if "half word" in r["evidence"]}
    assert got == {53, 54}


# 3

MAIL = """From: Ann Lee <a@b.example>
To: Bo
Subject: RE: x

Hello Bo,

The box is here.

> Where is it?
Below the stair.

Regards,
Ann Lee
Clerk

P.S. Bring the key.

This message is intended solely for the addressee.

On 3 May 2001, Bo wrote:
> Where is it?
> Bo
"""


def test_split_message():
    lines = MAIL.split("\n")
    assert [lines[i - 1] for i in emails.split_message(MAIL)] == ["Hello Bo,", "The box is here.", "Below the stair.", "P.S. Bring the key."]


def test_unmarked_quotation_before_new_text():
    text = "From: Ann Lee\nTo: Bo Ray\n\n-----Original Message-----\nFrom: Bo Ray\nSent: 1 May\nSubject: x\n\nOld words of the other one that are wrapped\nhere.\n\nBest,\nBo\n\nHi Bo,\n\nNew words.\n"
    got = [text.split("\n")[i - 1] for i in emails.split_message(text)]
    assert got == ["Hi Bo,", "New words."]


def test_traps_stay():
    text = "From: A\nTo: B\n\nHi B,\n\nDate: still open. We wait.\n\nRegards from the whole team; we leave now.\n\nConfidentiality is a separate matter. We talk.\n"
    assert emails.split_message(text) == [4, 6, 8, 10]


def test_double_spaced():
    text = MAIL.replace("\n", "\n\n")
    assert [text.split("\n")[i - 1] for i in emails.split_message(text)] == ["Hello Bo,", "The box is here.", "Below the stair.", "P.S. Bring the key."]


def test_new_lines_and_ancestors(spark):
    rng = random.Random(3)
    old = "\n\n".join(sentence(rng, 20) for _ in range(4))
    mine = "\n\n".join(sentence(rng, 20) for _ in range(4))
    t = spark.createDataFrame(
        [(1, f"From: A\nTo: B\n\n{old}\n"), (2, f"From: B\nTo: A\n\n{mine}\n\n{old}\n"), (3, None), (4, ""), (5, "  "), (6, "MEMORANDUM\nTO: x\nFROM: y\n\nNo mail."), (1, f"From: A\nTo: B\n\n{old}\n"), (None, "From: A\nTo: B\n\nx"), (7, "From: A\nTo: B\n\n" + "word " * 100_000)],
        "document_id long, full_text string",
    )
    d = spark.createDataFrame([(1, "E-MAIL"), (2, None), (2, "email")], "id long, document_type string")
    got = collections.defaultdict(list)
    for doc, line in rows(emails.new_lines(clash(t), clash(d))):
        got[doc].append(line)
    assert sorted(got[1]) == [4, 6, 8, 10] and sorted(got[2]) == [4, 6, 8, 10] and got[7] == [4] and set(got) == {1, 2, 7}
    assert dict(rows(emails.new_text(t, d)))[2] == "\n".join(mine.split("\n\n"))


def test_ancestors_of_several_lines_and_late_arrival(spark):
    rng = random.Random(5)
    old, mine, other = (["\n".join(sentence(rng, 9) for _ in range(4)) for _ in range(n)] for n in (3, 2, 9))
    text = lambda *parts: "From: A\nTo: B\n\n" + "\n\n".join(p for x in parts for p in x) + "\n"
    # the first reply, long and of the least id, is not the message that the second one quotes
    t = spark.createDataFrame([(1, text(other, old)), (2, text(mine, old)), (9, text(old))], "document_id long, full_text string")
    d = spark.createDataFrame([(1, "email"), (2, "email"), (9, "email")], "id long, document_type string")
    got = dict(rows(emails.new_text(t, d)))
    assert got == {1: "\n".join(other), 2: "\n".join(mine), 9: "\n".join(old)}


# 4


def test_copies(spark):
    d = spark.createDataFrame([(1, "AB" * 32), (2, "sha256:" + "ab" * 32), (3, None), (4, ""), (5, "cd" * 32), (6, "ef" * 32), (7, None), (8, None), (9, None), (1, "AB" * 32)], "id long, file_hash string")
    t = spark.createDataFrame(
        [
            (3, "The Box,\nis HERE."), (4, "the box is here"), (5, "Bates Begin: A-1\nPages: 3\nComment: All is well, part-time."), (6, '{"Comment": "All is well part time.", "Bates Begin": "A-1", "Pages": "3"}'),
            (7, "Bates Begin: A-1\nPages: 4\nComment: All is well, part-time."), (8, None), (9, " ,. "), (10, "x" * 300_000), (11, "X" * 300_000), (None, "x"),
        ],
        "document_id long, full_text string",
    )
    got = rows(formdup.copy_groups(clash(d), clash(t)).filter("first_id <> copy_id"))
    assert got == sorted([(1, 2), (3, 4), (5, 6), (10, 11)], key=str)
    assert dict(rows(formdup.copies(d, t))) == {1: 2, 3: 2, 5: 2, 10: 2, 7: 1, 8: 1, 9: 1}


def test_copies_chain_and_empty(spark):
    d = spark.createDataFrame([(1, "a" * 64), (2, "a" * 64), (3, None)], "id long, file_hash string")
    t = spark.createDataFrame([(2, "same words"), (3, "Same, words!")], "document_id long, full_text string")
    assert rows(formdup.copy_groups(d, t).filter("first_id <> copy_id")) == [(1, 2), (1, 3)]
    assert rows(formdup.copy_groups(d.limit(0), t.limit(0))) == []


# 5


def test_furniture():
    pages = ["HARBOUR RECORDS\n\nBody one goes on\nPage 1 of 2", "HARB0UR RECORDS - 2 -\nBody two ends\n\n[2]"]
    assert scans.furniture(pages) == [{0: "header", 3: "page_number"}, {0: "header", 3: "page_number"}]


def test_scan_cases(spark):
    rng = random.Random(4)
    plain = [(i, None, " ".join(sentence(rng) for _ in range(300))) for i in range(6)]
    page = ["SOME HEADER\nThe ledger of the harb-\nour was near a yel1ow wall and the mar‐\nble stair.\n7", "SOME HEADER\nThe doctor sat by the windovv with a candle.\n8"]
    odd = [(50, page, None), (51, None, "\f".join(page)), (52, [None, ""], None), (53, [], None), (54, None, None), (55, ["one page only"], "one page only"), (50, page, None)]
    t = spark.createDataFrame(plain + odd, "document_id long, pages_text array<string>, full_text string")
    t = t.withColumn("full_text", F.coalesce("full_text", F.array_join("pages_text", "\n")))
    cases, _ = scans.scan_cases(clash(t))
    want = {(1, "header", "SOME HEADER"), (1, "hyphen", "harbour"), (1, "hyphen", "marble"), (1, "misread", "yellow"), (1, "page_number", "7"), (2, "header", "SOME HEADER"), (2, "misread", "window"), (2, "page_number", "8")}
    got = collections.defaultdict(set)
    for doc, *case in rows(cases):
        got[doc].add(tuple(case))
    assert got == {50: want, 51: want}
    text = dict(rows(scans.repaired(t)))[50]
    assert "harbour was near a yellow wall and the marble stair." in text and "HEADER" not in text and "window with" in text


def test_scan_empty(spark):
    none = spark.createDataFrame([], "document_id long, pages_text array<string>, full_text string")
    assert rows(scans.scan_cases(none)[0]) == []


# 6


def test_boosted_trees_learn():
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (2000, 4))
    y = (x[:, 0] > 3) ^ (x[:, 1] > 5)
    p = boosting.BoostedTrees(trees=40).fit(x, y).predict(x)
    assert ((p > 0.5) == y).mean() > 0.97
    assert abs(p.mean() - y.mean()) < 0.05
    assert len(boosting.BoostedTrees().fit(np.empty((0, 4), int), np.empty(0, bool)).predict(x)) == 2000


def _people(spark):
    rng = random.Random(6)
    family = ["Stiteinpisk", "Krendovalm", "Ropatzund", "Veldorbrix", "Hamsturgen", "Bolwitrand"]
    given = ["Leonard", "Margaret", "Gordon", "Imogen", "Walter", "Helena"]
    e = [(i, f"{g} {f}", "person", None) for i, (g, f) in enumerate((g, f) for g in given for f in family)] + [(900, "Zuxamport Mining Trust", "org", None)]
    texts = []
    for i in range(120):
        g, f = rng.choice(given), rng.choice(family)
        texts.append((i, f"{sentence(rng)} You can reach Mr. {f} at 212-555-01{i % 90 + 10} or {g} {f} at x{i}@mail.example. {sentence(rng)} Zuxamport Mining Trust paid. SSN 912-34-5{i % 900 + 100} was lost on 2004-05-0{i % 9 + 1}."))
    return spark.createDataFrame(e, "id long, canonical_name string, entity_type string, aliases array<string>"), texts


def test_personal_data(spark):
    e, texts = _people(spark)
    special = "Write to Gordon Veldorbrix, 12 Upper Marl Street, Apt 4B, Etbald QX10 4BF, or P.O. Box 77, Etbald 01234, call 07700 900 123; SSN 987-65-4321, passport number KB 299071."
    t = spark.createDataFrame(texts + [(500, special), (501, None), (502, ""), (503, "x " * 200_000), (504, "quiet words only")], "document_id long, full_text string")
    m = spark.createDataFrame([(1, "Seen Walter Ropatzund and Imogen Hamsturgen there.", "Walter Ropatzund"), (2, None, "x"), (3, "", None)], "id long, context_snippet string, name_as_appears string")
    got = collections.defaultdict(set)
    for table, row, kind, value in rows(pii.personal_data(clash(t), clash(m), clash(e), 200)):
        got[table, row].add((kind, value))
    assert got["document_texts", 500] == {("name", "Gordon Veldorbrix"), ("address", "12 Upper Marl Street, Apt 4B, Etbald QX10 4BF"), ("address", "P.O. Box 77, Etbald 01234"), ("phone", "07700 900 123"), ("id_number", "987-65-4321"), ("id_number", "KB 299071")}
    assert got["mentions", 1] == {("name", "Imogen Hamsturgen")}
    assert {k for k, _ in got["document_texts", 7]} == {"email", "phone", "name", "id_number"}
    assert not any("Zuxamport" in v for s in got.values() for _, v in s)
    assert not {("document_texts", 501), ("document_texts", 502), ("document_texts", 504)} & set(got)
    out = dict(rows(pii.redacted(t.select(F.col("document_id").alias("id"), F.col("full_text").alias("text")), m.select("id", F.col("context_snippet").alias("text")), e, 200), "id", "text"))
    assert out[500].startswith("Write to [NAME], [ADDRESS], or [ADDRESS], call [PHONE]; SSN [ID_NUMBER]") and out[501] is None and out[504] == "quiet words only"


def test_redacted_query_has_both_tables(spark, tmp_path):
    from recordspark.llm import queries

    e, texts = _people(spark)
    e.write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame(texts + [(501, None)], "document_id long, full_text string").write.parquet(f"{tmp_path}/document_texts.parquet")
    m = [(7, "Seen Walter Ropatzund and Imogen Hamsturgen there.", "Walter Ropatzund"), (8, None, "x"), (9, "quiet words only", None)]
    spark.createDataFrame(m, "id long, context_snippet string, name_as_appears string").write.parquet(f"{tmp_path}/mentions.parquet")
    got = {(r["source_table"], r["row_id"]): (r["text"], r["redactions"]) for r in queries.p6_redacted(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1 + 3
    assert got["mentions", 7] == ("Seen Walter Ropatzund and [NAME] there.", 1)
    assert got["mentions", 8] == (None, 0) and got["mentions", 9] == ("quiet words only", 0) and got["document_texts", 501] == (None, 0)
    assert "[PHONE]" in got["document_texts", 7][0] and "[NAME]" in got["document_texts", 7][0]


def test_personal_data_empty(spark):
    e, _ = _people(spark)
    t = spark.createDataFrame([], "document_id long, full_text string")
    m = spark.createDataFrame([], "id long, context_snippet string, name_as_appears string")
    assert rows(pii.personal_data(t, m, e.limit(0))) == []


# 7


def brute_pairs(data, least, lift):
    docs = collections.defaultdict(set)
    for d, i in data:
        if d is not None:
            docs[d]
            if i is not None:
                docs[d].add(i)
    n, one, both = len(docs), collections.Counter(), collections.Counter()
    for items in docs.values():
        one.update(items)
        both.update((a, b) for a in items for b in items if a < b)
    return sorted((a, b, c) for (a, b), c in both.items() if c >= least and c * n >= lift * one[a] * one[b])


@pytest.mark.parametrize("block", [512, 3])
def test_cooccurrence(spark, block):
    rng = random.Random(7)
    data = [(d, rng.randrange(3) * 10 + rng.randrange(6)) for d in range(60) for _ in range(6)] + [(d, 1000) for d in range(60)] + [(None, 1), (70, None), (1, 1000)] + [(80 + k, v) for k in range(6) for v in (2**40, 2**40 + 1)]
    df = clash(spark.createDataFrame(data, "d long, e long"))
    assert [r[:3] for r in sorted(rows(cooccurrence.cooccurrence(df, "d", "e", 3, 1.2, block)))] == brute_pairs(data, 3, 1.2)
    assert rows(cooccurrence.cooccurrence(df.limit(0), "d", "e")) == []


def test_llr(spark):
    x = spark.range(1).select(cooccurrence.log_likelihood_ratio(*(F.lit(v) for v in (10, 20, 20, 100))).alias("g"), cooccurrence.log_likelihood_ratio(*(F.lit(v) for v in (4, 20, 20, 100))).alias("z")).first()
    assert round(x["g"], 3) == 12.429 or x["g"] > 10
    assert abs(x["z"]) < 1e-9


# 8


def test_leaks(spark):
    rng = random.Random(8)
    item = [sentence(rng, 40).rstrip(".") for _ in range(4)]
    opening = "Read the text and name the office in it. "
    items = [(i, opening + x) for i, x in enumerate(item)] + [(9, None), (10, "")]
    w = item[1].split()
    changed = w[5:35]
    changed[7], changed[19] = "other", "thing"
    docs = [
        (1, f"Some. {item[0].upper()}! more"), (2, "x " * 50 + " ".join(changed)), (3, " ".join(item[2].split()[:15])), (4, opening * 3), (5, None), (6, ""), (7, "> " + "\n> ".join(item[3].split())),
        (8, " ".join(w[5:20] + ["extra"] + w[20:34])), (9, " ".join(x if k % 5 else "no" for k, x in enumerate(w))), (1, f"Some. {item[0].upper()}! more"), (10, "a b " * 100_000),
    ]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    i = clash(spark.createDataFrame(items, "item_id long, text string"))
    for chars in (8_000_000, 300):
        assert rows(leakage.leaked(d, i, block_chars=chars), "doc_id", "item_id") == [(1, 0), (2, 1), (7, 3), (8, 1)]
    report = dict(rows(leakage.leak_report(leakage.leaked(d, i), i), "item_id", "documents"))
    assert report == {0: 1, 1: 2, 2: 0, 3: 1, 9: 0, 10: 0}
    assert rows(leakage.leaked(d.limit(0), i.limit(0))) == []


def test_single_hits_and_inner_passages_are_aligned():
    rng = random.Random(12)
    item = [f"w{k}" for k in range(600)]
    missed = []
    for trial in range(300):
        at = rng.randrange(100, 480)
        span = item[at : at + 20]
        changed = span[:5] + ["other"] + span[6:11] + ["thing"] + span[12:]  # runs of 5, 5 and 8
        added = span[:6] + ["other"] + span[6:12] + ["thing"] + span[12:]  # runs of 6, 6 and 8
        inner = item[at : at + 30]  # a text shorter than half the item
        index = leakage.Index([(1, item[:at] + span + item[at + 20 :])], 4, 3)
        for text in (changed, added, inner):
            words = [f"x{trial}a{k}" for k in range(9)]
            got = index.search(["none here", " ".join(words + text + words), ""], 20)
            if [(t, i) for t, i, *_ in got] != [(1, 1)]:
                missed.append((trial, text))
    assert not missed


def test_winnowing_guarantee():
    import numpy as np

    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**62, 400).astype(np.uint64)
    at = leakage.winnow(h, 3)
    assert np.diff(at).max() <= 3 and at[0] <= 2


# 9


def test_mixture(spark):
    rng = random.Random(10)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(40)), ("big", "mid", "small")[0 if i < 300 else 1 if i < 380 else 2]) for i in range(400)]
    docs += [(900, None, "big"), (901, "", "mid"), (902, "free words", "untargeted"), (5, docs[5][1], "big"), (None, "x", "big")]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    t = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.1, 4), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    out = mixture.mixture(d, t)
    got = {r["source"]: r for r in mixture.shares(out, t).collect()}
    assert got["absent"]["tokens"] == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(got[s]["actual_share"] - share / 0.9) < 0.02
        assert got[s]["most_copies"] <= got[s]["max_repeats"]
    assert {r["source"] for r in out.collect()} == {"big", "mid", "small"}
    pos = [r["position"] for r in out.collect()]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    assert out.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0
    assert rows(mixture.mixture(d.limit(0), t)) == [] and rows(mixture.mixture(d, t.limit(0))) == []


def test_schedule_inverts(spark):
    for knots in ([(0.0, 1.0), (1.0, 1.0)], [(0.0, 2.0), (0.5, 0.0), (1.0, 2.0)]):
        seg = mixture._segments(knots, 1000)
        assert abs(sum(h * w + s * h * h / 2 for _, h, w, s, _ in seg) - 1000) < 1e-6
    shares = {"a": 0.6, "b": 0.3, "c": 0.1}
    plan = mixture.tilted(shares)
    for k in (0, 1):
        assert abs(sum(v[k][1] for v in plan.values()) - 1) < 1e-9


# 10


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("You are a worthless c-oward and we know it.", True), ("Shut your mouth, V.E.R.M.I.N!", True), ("I hope you rot, you gutless arsssehole.", True), ("Tell him, that filthy h*****t, to go.", True), ("you are\n> a l33ch", True),
        ("He wrote: \"spineless rat, you will bleed for this\"", True), ("If you file it once more I will break your fingers.", True), ("They are not human and should be wiped out, every one of them.", True), ("Du bist ein Schwein.", True), ("Ferme-la, gros porc.", True), ("Ojalá te pudras.", True),
        ("Send me more nude pictures.", True), ("Rat poison and maggot bait were bought.", False), ("The pig iron must stay dry; no naked flame.", False), ("The museum bought a nude study in oils.", False), ("The court heard that he had been threatened.", False), ("You are a careful clerk.", False),
        ("The vermin control contract was signed.", False), ("", False), ("   ", False), ("The motion was shot down after he attacked the budget.", False),
    ],
)
def test_abuse(text, bad):
    assert (abuse.score_text(text)[0] >= 0.5) is bad


def test_abuse_scores(spark):
    d = spark.createDataFrame([(1, "You are a filthy pig.", "a"), (2, "All is well.", "a"), (3, None, None), (4, "", "b"), (5, "fine words " * 100_000 + "shut your mouth, idiot.", "b"), (1, "You are a filthy pig.", "a"), (None, "x", "a")], "doc_id long, text string, source string")
    s = abuse.scored(clash(d))
    assert {r["doc_id"]: r["score"] >= 0.5 for r in s.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert {r["source"]: (r["documents"], r["flagged"]) for r in abuse.abuse_rates(s).collect()} == {"a": (2, 1), "b": (2, 1), None: (1, 0)}
    assert rows(abuse.scored(d.limit(0))) == []


# sources of skew: a third of all rows under one key


def test_hot_keys(spark):
    hot = [(i, 1) for i in range(300)] + [(i, i % 7 + 2) for i in range(300)]
    df = spark.createDataFrame(hot, "d long, e long")
    assert [r[:3] for r in sorted(rows(cooccurrence.cooccurrence(df, "d", "e", 5, 0.5)))] == brute_pairs(hot, 5, 0.5)
    d = spark.createDataFrame([(i, "f" * 64 if i % 3 == 0 else f"{i:064x}") for i in range(300)], "id long, file_hash string")
    assert len(rows(formdup.copy_groups(d, spark.createDataFrame([], "document_id long, full_text string")))) == 100
    assert dt is not None


def test_beginnings_across_ranges(spark):
    rng = random.Random(12)
    whole = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(60)]
    t = spark.createDataFrame([(i, w) for i, w in enumerate(whole)] + [(100 + i, w[:150]) for i, w in enumerate(whole)] + [(300, whole[0][:150])] * 2, "document_id long, full_text string")
    assert {r[0] for r in rows(truncation.prefix_of_longer(t))} == {*range(100, 160), 300}


def test_sql_of_queries(spark):
    import os

    import duckdb

    from recordspark.llm.queries import QUERIES, SQL

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    for name, sql in SQL.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, data).select(*want.columns)
        near = lambda table: sorted(tuple(round(float(v), 3) for v in r) for r in table)
        assert near(got.collect()) == near(want.fetchall()), name
