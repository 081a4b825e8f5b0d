from collections import Counter

import pytest

from cellweave.llm import pii

SUR = [a + b for a in ("Vor", "Fen", "Ost", "Quen", "Ras", "Tam", "Bel", "Mol") for b in ("skeld", "aux", "ström", "elin", "ürk", "çan", "uzzi", "holt")]
GIVEN = [a + b for a in ("Ya", "Cla", "Bri", "Ze", "Lu", "Sa") for b in ("kko", "thea", "bet", "mon", "rune")]


def person(i):
    return GIVEN[i * 7 % len(GIVEN)], SUR[i * 5 % len(SUR)]


def text(i):
    (g, s), (h, t), (_, u) = person(i), person(i + 3), person(i + 11)
    return (
        f"COURT OF APPEAL OF ELDHAM\n\nbetween {g} {s}, Claimant,\n\nand {u} and Sons Foundry Ltd, Respondent\n1. The witness {h} {t.upper()} stated that it was void. Mr. {s} did not attend the hearing. "
        f"As was held in {u} v. {t}, 1993-0579-0848, nothing follows. Docket 555-01{i % 90 + 10} was joined. Calls to (555) 555-01{i % 90 + 10} went unanswered. Personal ID: 93{i % 90 + 10}18-1312 (verified). "
        f"The document bears the file number 930918-1312. {g} {s} resides at {i + 1} Tern Lane, Eldham. District Court of Eldham, 3 Registry Road | page 2. Notices are to be sent to <{g.lower()}.{s.lower()[:3]}@ostnet.example>, with a copy."
        f" The tribunal accepted the evidence of Ms {t} and rejected that of M. K.. The parcel adjoining the {u} Bridge was conveyed. {h} {t}, Judge"
    )


@pytest.fixture(scope="module")
def model():
    return pii.fit([text(i) for i in range(240)])


def found(model, t):
    t = " ".join(t.split())
    return {(c.kind, t[c.start : c.end]) for c in model.find(t)}


def test_held_out_documents(model):
    for i in range(300, 340):
        (g, s), (h, t) = person(i), person(i + 3)
        assert found(model, text(i)) == {
            ("name", f"{g} {s}"), ("name", s), ("name", f"{h} {t.upper()}"), ("name", t), ("name", f"{h} {t}"), ("phone", f"(555) 555-01{i % 90 + 10}"), ("id", f"93{i % 90 + 10}18-1312"),
            ("address", f"{i + 1} Tern Lane"), ("email", f"{g.lower()}.{s.lower()[:3]}@ostnet.example"),
        }


@pytest.mark.parametrize(
    "sentence,expected",
    [
        ("The witness VORSKELD, Yakko stated that", {("name", "VORSKELD, Yakko")}),
        ("Z. Fenaux, who kept the books, could not say", {("name", "Z. Fenaux")}),
        ("The witness clathea\n belholt stated that", {("name", "clathea belholt")}),
        ("Mr de Rasçan did not attend the hearing", {("name", "de Rasçan")}),
        ("Lubet O'Tamelin's account differs from that of M.K. on three points", {("name", "Lubet O'Tamelin")}),
        ("Dr Fenaux-Ostholt submits that the lease is void", {("name", "Fenaux-Ostholt")}),
        ("to the contrary Fenaux v. The State [1993] OCA 2", set()),
        ("Fenaux & Ostelin Textiles SA acquired the business", set()),
        ("Tel. 555.555.0115 ext. 588 was given", {("phone", "555.555.0115 ext. 588")}),
        ("could be reached on +999 (0)56 871234.", {("phone", "+999 (0)56 871234")}),
        ("Account no. 1675 2578 7871 at the bank", set()),
        ("identity card no. UF 65 30 10 U It follows", {("id", "UF 65 30 10 U")}),
        ("Invoice T44199114 covers lot 2", set()),
        ("Post to lwexitz (at) mail (dot) tarn (dot) example please", {("email", "lwexitz (at) mail (dot) tarn (dot) example")}),
        ("a.b @ ostnet.test and 57 @ 25 crowns, account @town_rates", {("email", "a.b @ ostnet.test")}),
        ("Yakko Belaux, wohnhaft Am Alten Markt 115a, 28381 Grauenau", {("name", "Yakko Belaux"), ("address", "Am Alten Markt 115a")}),
        ("Lukko Tamaux, demeurant 176 bis, avenue des Trois Tilleuls, à Velmark", {("name", "Lukko Tamaux"), ("address", "176 bis, avenue des Trois Tilleuls")}),
        ("Zerune Molelin resides at rue de l'Écluse 155b, Pellingen", {("name", "Zerune Molelin"), ("address", "rue de l'Écluse 155b")}),
        ("", set()),
        ("   \n ", set()),
    ],
)
def test_forms(model, sentence, expected):
    assert found(model, sentence) == expected


def test_tables_and_placeholders(spark, model):
    rows = [(1, text(1)), (2, None), (3, ""), (4, "  \n"), (1, text(1)), (5, ("word " * 40_000) + "Calls to 555-0123\n went unanswered."), (6, "🙂\n\nCalls to  555-0123 went\tunanswered.\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kind")
    got = sorted((r.doc_id, r.kind, r.found_text) for r in pii.find(df, model).collect())
    assert {d for d, _, _ in got} == {1, 5, 6} and (5, "phone", "555-0123") in got
    red = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert red[2] is None and red[3] == "" and red[4] == "  \n" and red[6] == "🙂\n\nCalls to  [PHONE] went\tunanswered.\n"
    assert "between [NAME], Claimant" in red[1] and "[ADDRESS], Eldham" in red[1] and "930918-1312. [NAME] resides" in red[1]
    assert pii.find(df.limit(0)).collect() == [] and pii.find(df).count() > 0


@pytest.mark.parametrize("lead", ["", " ", "\n\t", "a\u00a0\u2003b "])
@pytest.mark.parametrize("gap", [" ", "\n", " \n ", "\t\t"])
def test_placeholders_stand_where_findings_stood(model, lead, gap):
    parts = ["Calls to", "(555)", "555-0141", "went unanswered.", "Mr. Fenaux", "submits that", "it is void.", ""]
    got, n = pii.replace(lead + gap.join(parts), model)
    assert n == 2 and got == lead + gap.join(["Calls to", "[PHONE]", "went unanswered.", "Mr. [NAME]", "submits that", "it is void.", ""])


def test_em_trusts_labelers_that_agree():
    patterns = Counter({(1, 1, 0): 500, (1, 0, 0): 100, (0, 0, -1): 400, (1, 0, -1): 30})
    rates, post = pii.fit_reliabilities("email", patterns)
    assert post[1, 1, 0] > 0.95 and post[0, 0, -1] < 0.05 and post[1, 0, -1] < 0.5
    assert 0 < rates.share < 1 and ((rates.on_true > 0) & (rates.on_true < 1)).all() and (rates.on_true[:2] >= rates.on_false[:2]).all()


def test_em_decides_against_the_majority():
    """Two votes for a name and one against: who is right follows from how the labelers vote elsewhere, not from their number."""
    name = [n for n, _ in pii.LABELERS["name"]]

    def votes(*which):
        return tuple(v if n in which else 0 for n, v in pii.LABELERS["name"])

    torn = votes("in document", "gazetteer", "firm")
    sure_firm = Counter({votes("title", "form", "right role", "gazetteer", "in document"): 900, votes("gazetteer", "firm"): 700, votes("firm"): 300, torn: 200})
    loose_firm = Counter({votes("form", "in document", "gazetteer"): 400, votes("form", "in document", "gazetteer", "firm"): 500, votes("in document", "gazetteer"): 300, votes("case"): 900, votes("case", "gazetteer"): 300, torn: 100})
    assert len(name) == len(torn)
    assert pii.fit_reliabilities("name", sure_firm, rounds=0)[1][torn] == pii.fit_reliabilities("name", loose_firm, rounds=0)[1][torn] > 0.5
    assert pii.fit_reliabilities("name", sure_firm)[1][torn] < 0.1 and pii.fit_reliabilities("name", loose_firm)[1][torn] > 0.9


def test_no_candidate_is_dropped_before_the_classifier(model):
    seen = []
    real = model.accept
    model.accept = lambda c: seen.append(c) or real(c)
    try:
        found(model, "Fenaux & Ostelin Textiles SA and fenaux and Vorskeld v. Belaux and file number 930918-1312 and 1.2.2001")
    finally:
        del model.accept
    votes = {(c.kind, name) for c in seen for (name, _), v in zip(pii.LABELERS[c.kind], c.votes) if v < 0}
    assert {("name", "firm"), ("name", "case"), ("name", "lower case"), ("id", "trap")} <= votes


@pytest.mark.parametrize(
    "sentence,expected",
    [
        ("Write to " + "x" * 111 + "y@ostnet.test soon", {("email", "x" * 111 + "y@ostnet.test")}),
        ("Tel. +1 (415) 555-2671 was given", {("phone", "+1 (415) 555-2671")}),
        ("Yakko Belaux resides at 123456 Tern Lane, Eldham", {("name", "Yakko Belaux"), ("address", "123456 Tern Lane")}),
        ("Yakko Belaux resides at Calle Mayor 12, Eldham", {("name", "Yakko Belaux"), ("address", "Calle Mayor 12")}),
        ("Yakko Belaux, wohnhaft Lindenstraße 23456, 28381 Grauenau", {("name", "Yakko Belaux"), ("address", "Lindenstraße 23456")}),
        ("Mr Qwertzuiopel stated that it was so", {("name", "Qwertzuiopel")}),
    ],
)
def test_beyond_former_limits(model, sentence, expected):
    assert found(model, sentence) == expected


def test_names_that_the_sample_lacks(spark, model):
    assert ("name", "Xyqwolt") in found(model, "Mr Xyqwolt did not attend the hearing")
    assert ("name", "Yakko Xyqwolt") in found(model, "The witness Yakko Xyqwolt stated that")
    rows = [(i, text(i)) for i in range(60)] + [(100 + i, "Frau Jbrandwik hat ausgesagt." if i == 7 else "Nothing of note.") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = pii.corpus_gazetteers(df)
    one = pii.gather_gazetteers([" ".join(t.split()) for _, t in rows])
    assert "jbrandwik" in whole.surnames and (whole.surnames, whole.given, whole.towns, whole.firms) == (one.surnames, one.given, one.towns, one.firms)
    assert "jbrandwik" in pii.fit_on(df, most=5).gazetteers.surnames


def test_tokens_that_differ_in_digits_only_are_looked_at_once(model):
    before = len(model.gazetteers.tokens)
    found(model, " ".join(f"{i} ({i}) [{i + 1}] {i}.{i + 7},50" for i in range(1000, 2000)))
    assert len(model.gazetteers.tokens) - before <= 4


ODD = [
    "", "7", "12", "rue", "+", "( 12 34567 and (+49 ( 12", "AB 12 34 56 C and XAB 12 34 56 CD or AB 12 34 56", "T44199114 XT44199114, T4419911 ABC-123456-D AABC-123456-DE", "+999 (0)56 871234 – 12 – 3456 7",
    "12 rue l'avenue RUE xrue cia Via rue", "a@b.de x(At)y.com [AT] (at at at dot de dot x at at at dot y dot", "at a dot b at c dot", "12 (13 :14 x15 [16] 17a 18/2 weg 19.5 str. 20, 21 bis", "١٢ ٣٤٥ 1٢34567890 12 (– 12 –", "0 00 000 0000 00000 000000 0000000 1-2-3-4-5-6-7 1.2.3.4.5.6.7.8 12/34/56/78 ",
]


def test_marks_are_what_whole_texts_show():
    """The places taken from tokens give what the expressions find in the whole text, whatever stands beside it."""
    g = pii.gather_gazetteers([text(i) for i in range(60)])
    texts = [*ODD, *(" ".join(text(i).split()) for i in range(5)), *ODD]
    for t, marks in zip(texts, pii._marks(texts, g), strict=True):
        assert pii._spans(pii._DIGITS, t, marks.digits) == [m.span() for m in pii._DIGITS.finditer(t)]
        assert pii._spans(pii._LETTER_ID, t, sorted(marks.letters)) == [m.span() for m in pii._LETTER_ID.finditer(t)]
        assert sorted(marks.at) == sorted([m.span() for m in pii._AT.finditer(t)] + [m.span() for m in pii._AT_DOT.finditer(t)])
        assert marks.streets == [m.start() for m in pii._FR_ANCHOR.finditer(t) if not (m.start() and t[m.start() - 1].isalnum())]
        assert marks.names == [(*m.span(), m.group()) for m in pii._WORD.finditer(t) if g.words[m.group()] & 3] and marks.cues == [(m.start(), g.words[m.group()]) for m in pii._WORD.finditer(t) if g.words[m.group()] & 12]
        numbers = [m.span() for m in pii._NUMBER.finditer(t) if not m.start() or t[m.start() - 1] in " (:"]
        assert set(marks.houses) <= set(numbers)
        assert [(c.start, c.end, c.votes) for c in pii._addresses(t, marks.houses, marks.streets)] == [(c.start, c.end, c.votes) for c in pii._addresses(t, numbers, marks.streets)]


def test_texts_together_are_as_each_alone(model, monkeypatch):
    texts = [*ODD, *(text(i) for i in range(300, 310)), *ODD]
    alone = [[(c.kind, c.start, c.end) for c in model.find(t)] for t in texts]
    assert sum(map(len, alone)) > 50
    for size in (1, 60, 3_000, pii.AT_ONCE):
        monkeypatch.setattr(pii, "AT_ONCE", size)
        assert [[(c.kind, c.start, c.end) for c in got] for got in model.find_all(texts)] == alone
    assert list(model.find_all([])) == []


@pytest.mark.parametrize(
    "words,towns",
    [
        ("District Court of Eldham and xHigh Court OF Velmark9 COURT OF APPEAL of Tarn", ["eldham", "velmark", "tarn"]),
        ("High Court of Appeal of X Court of Appeal of High Court of Y", ["appeal", "high"]),
        ("Labour\n Tribunal  of\tFoo-District Court of Bar", ["foo", "bar"]),
        ("Court of Eldham Labour Court of A District Court in B High Court of", []),
        ("LABOUR TRIBUNAL OF 9a Court OF Appeal of C", []),
    ],
)
def test_towns_of_courts(words, towns):
    assert {w: n for (k, w, _), n in pii._mentions([words]).items() if k == "town"} == Counter(towns)
