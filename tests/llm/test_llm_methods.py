"""The dealt methods at work: cases in which the method itself, not a rule beside it, decides."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordspark.llm import abuse, cooccurrence, emails, formdup, leakage, names, pii, scans, truncation

sys.path.insert(0, str(Path(__file__).parent))
import abuse_sentences  # noqa: E402

PAGES = "document_id long, pages_text array<string>, full_text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# 5


def _scans(spark):
    # alone, "8and" is sand and "8ank" is sank; side by side they are what often stands side by side
    plain = ["a band bank there"] * 30 + ["the sand is dry"] * 60 + ["it sank below"] * 60
    page = ["Some words of 8and 8ank and others", "Other words of the 8and is here and it 8ank below"]
    t = spark.createDataFrame([(i, None, x) for i, x in enumerate(plain)] + [(900, page, "\n".join(page))], PAGES)
    return t


def test_neighbouring_misreadings_decide_each_other(spark):
    got = rows(scans.scan_cases(_scans(spark))[1])
    assert got == [(900, 1, "8and", "band"), (900, 1, "8ank", "bank"), (900, 2, "8and", "sand"), (900, 2, "8ank", "sank")]


def test_known_words_only_save_work(spark):
    t = _scans(spark)
    names = [(i, None, "Then Mr. Harmon spoke of Harmon.") for i in range(1000, 1012)]
    scan = [(2000, ["Then Mr. Hannon came.", "Harmon stayed."], None)]
    t = t.unionAll(spark.createDataFrame(names + scan, PAGES)).withColumn("full_text", F.coalesce("full_text", F.array_join("pages_text", "\n")))
    some, none = (rows(scans.scan_cases(t, known_words=k)[0]) for k in (4000, 0))
    assert some == none and some


def test_best_path_joins_two_odd_words():
    e = lambda at, a, ca, b, w, cb, n: {"at": at, "a": a, "changed_a": ca, "b": b, "weight_b": w, "changed_b": cb, "n": n}
    edges = [e(1, "", False, "x", 0.0, False, 0), e(1, "", False, "y", 1.0, True, 0), e(1, "", False, "z", 0.5, True, 0)]
    edges += [e(2, a, a != "x", b, w, b != "p", 90 if (a, b) == ("z", "r") else 0) for a in "xyz" for b, w in (("p", 0.0), ("q", 1.0), ("r", 0.2))]
    edges += [e(3, b, b != "p", "", 0.0, False, 0) for b in "pqr"]
    assert scans.best_path(edges) == [("x", "z"), ("p", "r")]


def test_furniture_deeper_than_three_lines():
    rng = random.Random(1)
    head = ["STATE RECORDS", "Harbour Office", "Series of letters", "Drawer nine", "Folder of the year"]
    body = lambda: "\n".join(" ".join(rng.choice("ledger window garden marble ticket doctor castle".split()) for _ in range(9)) + "." for _ in range(4))
    pages = ["\n".join([*head, body(), f"{n}"]) for n in range(1, 5)]
    for got in scans.furniture(pages):
        assert got == {**dict.fromkeys(range(5), "header"), 9: "page_number"}


def test_long_running_header():
    head = "Minutes of the meeting of the joint board of the harbour, the railway and the upland roads, held in the long room of the old custom house"
    pages = [f"{head}\nFirst words of one page.", f"{head}\nQuite different words on two."]
    assert [g.get(0) for g in scans.furniture(pages)] == ["header", "header"]


# 10


def _wrong(listed, bad):
    return [x for x in listed if (abuse.score_text(x)[0] >= 0.5) is not bad]


def test_abuse_probes_and_sentences():
    assert _wrong(abuse_sentences.PROBES, True) == []
    assert _wrong(abuse_sentences.ABUSIVE, True) == [] and _wrong(abuse_sentences.SOBER, False) == []


def test_abuse_held_out_recall_and_precision():
    missed, false = _wrong(abuse_sentences.HELD_ABUSIVE, True), _wrong(abuse_sentences.HELD_SOBER, False)
    found = len(abuse_sentences.HELD_ABUSIVE) - len(missed)
    assert found >= 0.7 * len(abuse_sentences.HELD_ABUSIVE) and found >= 0.9 * (found + len(false))


def test_abuse_paths_are_weighed_in_context():
    s = lambda t: abuse.score_text(t)[0]
    assert s("You are not an idiot.") < 0.5 <= s("You are not an idiot. You are an imbecile.")  # a lowered match hides no other
    assert s("He said that you are a worthless rat.") < 0.5 <= s('He said: "You are a worthless rat."')
    assert s("You are a rat.") < s("You are a scumbag.")  # a word's own weight
    assert s("You, as we say, scumbag.") < s("You scumbag.")  # words skipped
    assert s("I will kill you. I will kill you.") > s("I will kill you.")


def test_abuse_disguises():
    for text in ("You filthy s.c.u.m.b.a.g", "you filthy sc*mb*g", "You are an 1d10t", "you s c u m b a g", "You shitheads", "Du Dreckskerl", "> You are a\n> worth-less leech"):
        assert abuse.score_text(text)[0] >= 0.5, text


# 6


def _fitted(spark):
    rng = random.Random(6)
    family = ["Stiteinpisk", "Krendovalm", "Ropatzund", "Veldorbrix", "Hamsturgen", "Bolwitrand"]
    given = ["Leonard", "Margaret", "Gordon", "Imogen", "Walter", "Helena"]
    people = [(f"{g} {f}", "person", None) for g in given for f in family] + [("Zuxamport Mining Trust", "org", None)]
    e = spark.createDataFrame(people, "canonical_name string, entity_type string, aliases array<string>")
    texts = []
    for i in range(300):
        g, f = rng.choice(given), rng.choice(family)
        street = f"{rng.randrange(1, 999)} {rng.choice(['Kelp', 'Marl', 'Upper Marl', 'Dunmere'])} {rng.choice(['Street', 'Lane', 'Road'])}"
        texts.append((i, f"The ledger was read. Mr. {f} said to call 312-44{i % 9}-{i + 1000} or {g.lower()}.{f.lower()}@mail{i % 5}.example. The house at {street}, Etbald QX1{i % 9} 4BF was let. {g} {f} paid on {1990 + i % 20}-05-0{i % 9 + 1}. SSN 61{i % 9}-34-5{i + 100} was lost; invoice 34{i % 9}-{i + 5000} was found."))
    t = spark.createDataFrame(texts, "id long, text string")
    return pii.fit_detector(t, t.limit(0), e, 300)


def test_trees_reject_false_candidates(spark):
    d = _fitted(spark)
    text = "They paid 12@4.75 each, as Rule 12 Motion Court says; write to ann.lee@mail2.example, 12 Marl Lane, Etbald QX11 4BF."
    proposed = {(k, text[b:e]) for k, b, e, _ in pii.propose(text, d.vocabulary)}
    assert {("email", "12@4.75"), ("address", "12 Motion Court")} <= proposed
    got = {(k, text[b:e]) for k, b, e in d.spans([text])[0]}
    assert {("email", "ann.lee@mail2.example"), ("address", "12 Marl Lane, Etbald QX11 4BF")} <= got
    assert not {("email", "12@4.75"), ("address", "12 Motion Court")} & got


def test_numbers_of_any_range_are_told_by_format_and_surroundings(spark):
    d = _fitted(spark)
    text = "You can call 718-902-4471 on the day; SSN 402-11-7788; invoice 341-5011; made 2003-05-04."
    assert {(k, text[b:e]) for k, b, e in d.spans([text])[0] if k != "name"} == {("phone", "718-902-4471"), ("id_number", "402-11-7788")}


def test_thresholds_are_calibrated_and_reported(spark):
    d = _fitted(spark)
    assert set(d.thresholds) == set(d.report) == set(pii.KINDS)
    assert all(d.report[k][1] >= 0.95 for k in ('email', 'phone', 'address')), d.report
    assert pii._threshold(pii.np.array([0.6] * 10 + [0.9] * 10), pii.np.array([False] * 5 + [True] * 15), 0.95) > 0.6


def test_vocabulary_counts_all_texts(spark):
    e = spark.createDataFrame([("Ann Lee", "person", None)], "canonical_name string, entity_type string, aliases array<string>")
    t = spark.createDataFrame([("The harbour was shut. Harbour dues fell.",)] * 40 + [("However it was. Then Mr. Marble saw Marble.",)] * 40 + [("A marble slab.",)] + [("The SPRING GAZETTE said so of STONE. Mr. Stone left.",)] * 9, "text string")
    common = pii.corpus_vocabulary(t, e).common
    assert {"harbour", "however", "gazette"} <= common and not {"marble", "stone"} & common


def test_spans_of_a_long_text(spark):
    d = _fitted(spark)
    text = "word " * 20_000 + ("a" * 200 + "@mail1.example ") + "Gordon Veldorbrix came. " * 2_000
    got = d.spans([text])[0]
    assert got[0] == ("email", 100_000, 100_214) and len(got) == 2_001


# 8


@pytest.mark.parametrize("how", ["lost", "added", "replaced"])
@pytest.mark.parametrize("runs", [(6, 6, 6), (5, 8, 5), (7, 7, 6), (5, 5, 8), (2, 10, 6)])
def test_every_span_with_two_changes_is_found(how, runs):
    """Of a 40-word item a span in which two words differ; every layout leaves a run of 6 words, whose fingerprint is kept."""
    rng = random.Random(str((how, runs)))
    missed = 0
    for trial in range(600):
        item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        a, b, c = runs
        took = sum(runs) + (2 if how != "added" else 0)
        at = rng.randrange(0, 40 - max(took, 20) + 1)
        out, i = [], at
        for n, length in enumerate(runs):
            out += item[i : i + length]
            i += length
            if n < 2 and how != "lost":
                out.append("other")
            if n < 2 and how != "added":
                i += 1
        if i - at < 20:
            out += item[i : at + 20]
        text = " ".join([f"x{k}" for k in range(8)] + out + [f"y{k}" for k in range(8)])
        missed += [m[:2] for m in leakage.Index([(1, item)], 4, 3).search([text], 20)] != [(0, 1)]
    assert missed == 0


# 7


@pytest.mark.parametrize("hot", [1e-4, 0.9])
def test_stripes_of_hot_items_are_cut_and_merged(spark, hot):
    rng = random.Random(7)
    data = {(d, i) for d in range(400) for i in {1 if d % 3 == 0 else 2, *(rng.randrange(3, 40) for _ in range(5))}}
    df = spark.createDataFrame(sorted(data), "d long, e long").repartition(7)
    got = {(r["item_1"], r["item_2"]): r["n12"] for r in cooccurrence.cooccurrence(df, "d", "e", 2, 0.1, hot=hot).collect()}
    docs = {}
    for d, i in data:
        docs.setdefault(d, set()).add(i)
    want = {}
    for items in docs.values():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    n1 = {i: sum(i in v for v in docs.values()) for i in range(40)}
    assert got == {p: c for p, c in want.items() if c >= 2 and c * 400 >= 0.1 * n1[p[0]] * n1[p[1]]}


def test_stripes_merge_across_batches():
    import numpy as np
    import pandas as pd

    rows_ = [(1, 0, [5, 6], [1, 1]), (1, 0, [6, 7], [2, 1]), (1, 1, [8], [3]), (2, 0, [9], [1]), (2, 0, [9, 10], [4, 1])]
    frames = [pd.DataFrame({"item": [i], "cut": [c], "neighbours": [np.array(n)], "counts": [np.array(k)]}) for i, c, n, k in rows_]
    for batches in (frames, [pd.concat(frames, ignore_index=True)], [pd.concat(frames[:2], ignore_index=True), pd.concat(frames[2:], ignore_index=True)]):
        got = pd.concat(list(cooccurrence._merged(iter(batches), 1)))
        assert sorted(got.itertuples(index=False, name=None)) == [(1, 5, 1), (1, 6, 3), (1, 7, 1), (1, 8, 3), (2, 9, 5), (2, 10, 1)]


def test_significance(spark):
    data = [(d, i) for d in range(200) for i in ((1, 2) if d < 20 else (3, 4) if d < 26 else (5,))] + [(d, 3) for d in range(100, 112)] + [(d, 4) for d in range(120, 132)]
    got = {(r["item_1"], r["item_2"]): r["significant"] for r in cooccurrence.cooccurrence(spark.createDataFrame(data, "d long, e long"), "d", "e", 5, 1.0, min_llr=60.0).collect()}
    assert got == {(1, 2): True, (3, 4): False}


# 2


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ('He said "we must go. Then they left.', ["quote"]), ("<div><b>All is told here.", ["tag"]), ("It was old (see the note. Then it ended.", ["bracket"]), ("„Das war es. Dann ging er.", ["quote"]), ("« Fini. Il partit.", ["quote"]), ('See <a href="x', ["tag"]),
        ('He said "we go." Then (at 5") they left [all]. 1) one 2) two', []), ("„Das war es“, sagte er.", []), ("<div><p>All.</div> <br> x", []), ("Ann <a@b.example> wrote :( and x < y", []), ('{"A": "b (", "C": "d\\""}', []), ('{"A": "b", "C": ["d"', ["record"]), ("", []),
    ],
)
def test_stack_automaton(text, kinds):
    assert truncation.left_open(text) == kinds
    if kinds:
        assert truncation.ending(text) == "open"


def test_open_marks_are_weighed_by_source(spark):
    texts = [(i, f'Number {i} says "it was so. It ended.', None, None) for i in range(30)] + [(100, 'Here one says "it was so. It ended.', None, None)]
    texts += [(101 + i, f"Complete text number {i} stands here.", None, None) for i in range(30)]
    t = spark.createDataFrame(texts, "document_id long, full_text string, pages_text array<string>, word_count int")
    d = spark.createDataFrame([(i, "a") for i in range(30)] + [(100 + i, "b") for i in range(31)], "id long, data_set string")
    assert [r["document_id"] for r in truncation.judged(t, d).filter("cut").collect()] == [100]


def test_short_beginnings(spark):
    t = spark.createDataFrame([(1, "A box"), (2, "A box stood here."), (3, "Other words."), (4, "A box"), (5, "a BOX, stood HERE")], "document_id long, full_text string")
    assert rows(truncation.prefix_of_longer(t)) == [(1,), (4,)]


# 3


def _words(rng, n=9):
    return " ".join(rng.choice("ledger harbour window garden yellow marble copper ticket winter summer doctor bridge castle engine forest island jacket kettle ladder magnet".split()) for _ in range(n))


@pytest.mark.parametrize(("header", "greeting"), [("De: Luc\nÀ: Ann\nObjet: x", "Bonjour Luc,"), ("Von: Luc\nAn: Ann\nBetreff: x", "Hallo Luc,")])
def test_mails_of_other_languages(spark, header, greeting):
    t = spark.createDataFrame([(1, f"{header}\n\n{greeting}\n\nLes mots neufs sont ici.")], "document_id long, full_text string")
    assert [r["line_no"] for r in emails.new_lines(t, spark.createDataFrame([], "id long, document_type string")).orderBy("line_no").collect()] == [5, 7]


def test_ancestor_spans_are_verified_word_by_word():
    rng = random.Random(3)
    old = [_words(rng, 20) for _ in range(3)]
    changed = old[1].split()
    changed[10] = "altered"
    text = "From: A\nTo: B\n\n" + "\n\n".join([_words(rng, 12), old[0], " ".join(changed), " ".join(old[2].split()[:9]) + "\n" + " ".join(old[2].split()[9:])])
    quoted = emails.verified_lines(text, ["From: B\nTo: A\n\n" + "\n\n".join(old)])
    assert quoted == {5, 9, 10}  # the paragraph with another word is not the ancestor's


def test_siblings_show_a_quotation_without_ancestor(spark):
    rng = random.Random(4)
    old = [_words(rng, 14) for _ in range(4)]
    text = lambda top, end: "From: A\nTo: B\n\n" + top + "\n\n-----Original Message-----\nFrom: C\nTo: A\nSubject: y\n\n" + "\n\n".join(old) + "\n\n" + end + "\n"
    a, b = text(_words(rng, 12), _words(rng, 12)), text(_words(rng, 12), _words(rng, 12))
    t = spark.createDataFrame([(1, a), (2, b), (3, b.replace("\n\n", "\n \n"))], "document_id long, full_text string")
    index = {r["document_id"]: sorted(r["siblings"] or []) for r in emails.email_index(t.withColumn("hint", F.lit("email"))).collect()}
    lines = a.split("\n")
    assert [lines[i] for i in index[1]] == old and index[2] == index[1] == index[3]


def test_long_headers_and_notices():
    head = "From: Ann Lee <a@b.example>\n" + "".join(f"Cc: person {i} with a rather long name <p{i}@office.example>\n" for i in range(40)) + "Subject: x\n"
    text = head + "\nHello Bo,\n\nNew words.\n"
    assert emails.is_email(text, None) and [text.split("\n")[i - 1] for i in emails.split_message(text)] == ["Hello Bo,", "New words."]
    assert emails.is_email("Some words.\n\nThis message is intended solely for the addressee" + " and others" * 60 + ".", None)


# 1


def test_jaro_winkler_decides():
    like = names.likeness
    assert like("katherine", "leonard", "kathryne", "leonard") >= names.LIKE
    assert like("stiteinpisk", "leonard", "stitenpisks", "leonard") >= names.LIKE  # two slips
    assert like("stiteinpisk", "dorothela", "stiteinpisk", "dorothhela") >= names.LIKE  # a given name the table does not know
    assert like("stiteinpisk", "mary", "stiteinpisk", "mark") < names.LIKE
    assert like("stiteinpisk", "eleanor", "stiteinpisk", "leonard") == 0.0  # two names it knows
    assert like("wovanfal", "mining", "wovanfal", "minting", frozenset(["mining", "minting"])) == 0.0
    assert like("krendovalm", "leonard", "kranduvelm", "leonard") < names.LIKE < 1
    assert like("lee", "ann", "leo", "ann") < names.LIKE


def test_recall_does_not_fall_with_repeated_rows(spark):
    rng = random.Random(1)
    syllables = "sti tein pisk kren do valm ro patz und vel bor brix ham stur gen bol wit rand zu xam port".split()
    given = ["Leonard", "Margaret", "Gordon", "Imogen", "Walter", "Helena"]
    people, truth = [], {}
    for k in range(40):
        family = "".join(rng.choice(syllables) for _ in range(4)).capitalize()
        at = rng.randrange(2, len(family) - 1)
        slip = family[:at] + family[at + 1] + family[at] + family[at + 2 :]
        for form, copies in ((family, 3), (slip, 1)):
            people += [(f"{given[k % 6]} {form}", k)] * copies
    for times in (1, 10):
        e = [(i, name, "person", None, None) for i, (name, _) in enumerate(people * times)]
        got = dict(rows(names.same_entities(spark.createDataFrame(e, "id long, canonical_name string, entity_type string, first_name string, aliases array<string>"), spark.createDataFrame([], "entity_id long, name_as_appears string"))))
        groups = {}
        for i, (_, k) in enumerate(people * times):
            groups.setdefault(k, []).append(i)
        right = sum(got.get(i) == min(g) for g in groups.values() for i in g)
        assert right >= 0.97 * len(e), (times, right, len(e))


# 4


NESTED = "id long, name string, parts array<struct<no: int, label: string>>, about map<string, string>, inner struct<a: string, b: struct<c: string>>"


def test_nested_records(spark):
    r = spark.createDataFrame(
        [
            (1, "The Box", [(1, "Red"), (2, "Blue")], {"x": "1", "y": "2"}, ("a", ("C",))), (2, "the box!", [(2, "blue"), (1, "RED")], {"y": "2", "x": "1"}, ("A", ("c.",))),
            (3, "The Box", [(1, "Blue"), (2, "Red")], {"x": "1", "y": "2"}, ("a", ("C",))), (4, None, None, None, None), (5, "", None, None, None), (None, "The Box", None, None, None), (2, "the box!", [(2, "blue"), (1, "RED")], {"y": "2", "x": "1"}, ("A", ("c.",))),
        ],
        NESTED,
    )
    assert rows(formdup.record_groups(r, "id")) == [(1, 1), (1, 2), (4, 4), (4, 5)]
    assert rows(formdup.record_groups(r, "id", ordered=True).filter("first_id <> copy_id")) == [(4, 5)]
    assert rows(formdup.record_groups(r.limit(0), "id")) == []


def test_contents_of_one_digest_are_told_apart(spark):
    roots = spark.createDataFrame([(i, "r") for i in range(1, 6)] + [(9, "s")], "id long, root string")
    contents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (9, "x")], "id long, content string")
    assert rows(formdup._proven(roots, contents).filter("first <> id")) == [(1, 3), (2, 4)]


def test_labels_are_a_parameter(spark):
    d = spark.createDataFrame([], "id long, file_hash string")
    t = spark.createDataFrame([(1, "Bates Begin: A\nShelf: top\nRoom: 3"), (2, "Bates Begin: A\nRoom: 3\nShelf: top")], "document_id long, full_text string")
    assert rows(formdup.copy_groups(d, t)) == []
    assert rows(formdup.copy_groups(d, t, labels=("Bates Begin", "Shelf", "Room"))) == [(1, 1), (1, 2)]
