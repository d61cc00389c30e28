from pyspark.sql import functions as F

from quillstone.llm import ocr, pii, pii_grammar


def test_held_out_accuracy():
    for kind, (precision, recall) in pii_grammar.held_out(300).items():
        # half the given names stand on no list and many contexts say nothing
        assert precision > 0.9 and recall > (0.8 if kind == "person" else 0.9), kind


# written apart from the grammar; names, streets and towns stand on none of its lists
PERSONS = "Thandiwe Mokoena|Oluwaseun Akinfolarin|Saoirse Ní Dhomhnaill|Xiomara Quispe|Bartosz Grzegorczyk|Ngozi Uzoma|Tevita Fifita|Aroha Parata|Ishaan Bhattacharya|Zeynep Karahan|Yevhen Shevchuk|Lieselotte Krautwurst".replace("Ní ", "").split("|")
PHONES = "0131 496 0287|(212) 555-0194|+44 7700 900461|06 12 34 56 78|+49 89 2312 5410|0412 555 908|415.555.0133|+1 646 555 0107".split("|")
EMAILS = "t.mokoena@harbourlight.example|billing+7@northmoor.test|zk [at] osterfeld [dot] example|aroha_p@kauri.example|sekretariat@werkhalle.test|x9 (at) mail.quay.example".split("|")
ADDRESSES = "14 Larkspur Crescent, Dunmore VIC 3204|221 Old Foundry Road, Ashwick OH 44120|Unit 6, 88 Tollgate Lane, Penhallow QX4 7GS|Lindenstraße 9, 04177 Altweiler|37 rue Montplaisir, 69210 Valcourt|5 Quarryman Drive, Eastbrook, OR 97031".split("|")
IDENTITIES = "passport number K4471902|driver's licence no. 7718 40226|social security number 478-20-6619|tax file number 318 604 992|Personalausweis L22N04785X|permis de conduire 891204300117|national insurance number JG 48 21 07 C|ID card MB6720193".replace("L22N04785X", "L82204785X").split("|")
FRESH = """My colleague {p} dealt with this last week; try {t} and mention the blue folder.
Could somebody in dispatch let {p} know the crane is booked?
{p} dropped off samples yesterday, the lab has them.
We had a chat with {p} regarding overtime.
Kind greetings from {p}, see you at the fair.
For questions the landlord's number remains {t}, or drop a line to {e}.
Voicemail full; used {t} as a fallback.
If nobody opens, dial {t} and wait by the fence.
The courier's handset is {t}.
Statements should be copied to {e} every quarter.
Her inbox {e} bounced twice.
Kindly resend the contract, my correct mailbox is {e}.
The tenants left for {a} in spring.
Collect the generator from {a} before six.
Our new showroom stands at {a}.
Visitor proved who she was with {i}.
Rental desk noted {i} and let him drive off.
According to the file: {i}, issued in 2019.
Die Schlüssel verwahrt {p}, abends unter {t} zu sprechen.
Zugestellt wird künftig nach {a}.
Das Amt vermerkte {i} in der Akte.
La gardienne, {p}, ouvre le portail ; sinon {t}.
Le nouvel entrepôt se situe {a}.
Le loueur a relevé {i} hier.""".split("\n")
NOTHING = """Crate 7718-40226-B goes back to the foundry.
Requisition 4478206619 was split over two trucks.
Our company number is 62 318 604 992.
Valve K-447 leaks, use valve K-448 until Thursday.
Mix 12 bags with 30 litres, wait 45 minutes.
The Larkspur line comes in green and grey.
Kauri Timber Wholesale Ltd closes early in May.
Budget for 2031: 1,250,000 less 12.5 percent.
Auftrag 8912043001 ist freigegeben.
Le lot 318 604 992 est conforme.""".split("\n")


def fresh() -> list[tuple[str, list[tuple[int, str]]]]:
    """Every sentence with every value of its kinds, and where they start."""
    import re

    pools = {"p": ("person", PERSONS), "t": ("phone", PHONES), "e": ("email", EMAILS), "a": ("address", ADDRESSES), "i": ("id_number", IDENTITIES)}
    out = []
    for line in FRESH:
        for n in range(12):
            text, want = "", []
            for piece in re.split(r"(\{\w\})", line):
                if piece[:1] == "{":
                    kind, pool = pools[piece[1]]
                    value = pool[n % len(pool)]
                    label = re.match(r"[^0-9]*?(?=[A-Z]{0,2}\d|[A-Z]{2} \d)", value).end() if kind == "id_number" else 0
                    want.append((len(text) + label, kind))
                    text += value
                else:
                    text += piece
            out.append((text, want))
    return out


def test_text_the_grammar_cannot_write():
    rows = fresh()
    finder = pii.Finder(pii_grammar.trained(), {w for line in FRESH + NOTHING for w in line.lower().split() if "{" not in w})
    got = finder.spans([t for t, _ in rows])
    for kind in pii.KINDS:
        want = {(n, s) for n, (_, w) in enumerate(rows) for s, k in w if k == kind}
        have = {(n, s) for n, spans in enumerate(got) for s, _, k, _ in spans if k == kind}
        assert len(want) >= 60 or kind in ("email", "address", "id_number") and len(want) >= 36
        recall, precision = len(want & have) / len(want), len(want & have) / max(1, len(have))
        assert recall >= 0.9 and precision >= 0.9, (kind, recall, precision, [rows[n][0][max(0, s - 20) : s + 30] for n, s in list(want ^ have)[:12]])
    wrong = [(t, s) for t, s in zip(NOTHING, finder.spans(NOTHING), strict=True) if s]
    assert len(wrong) <= 1, wrong


def test_redact(spark):
    rows = [(1, "Please call Anna Kestrel on 0491 570 156 before delivery."), (2, "Quote PO 4507193752 on all papers."), (3, "cc a.b@c.example; anna dot kestrel at heron dot test"), (4, None), (5, ""), (6, "  "), (7, "Collected by B. Heron, passport X9825387."), (1, "Please call Anna Kestrel on 0491 570 156 before delivery."), (8, "word " * 30000 + "Text 0491 570 156 on arrival")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("spans", F.lit("clash"))
    got = {}
    n = 0
    for r in pii.redact(df).collect():
        n += 1
        got[r.id] = r.redacted
    assert n == len(rows)
    assert got[1] == "Please call [PERSON] on [PHONE] before delivery." and got[2] == rows[1][1] and got[3] == "cc [EMAIL]; [EMAIL]"
    assert got[4] is None and got[5] == "" and got[7] == "Collected by [PERSON], passport [ID_NUMBER]." and got[8].endswith("Text [PHONE] on arrival")
    assert pii.redact(df.filter("id < 0")).count() == 0


def test_overlaps_take_the_heaviest_set():
    got = pii.select([(0, 10, "a", 0.9), (5, 15, "b", 0.8), (10, 20, "c", 0.9), (0, 20, "d", 0.95)])
    assert [s[2] for s in got] == ["a", "c"]


WORDS = {w: 500 for w in "the supplier must inspect all conforming goods before scheduled commissioning under agreement quarterly stocktake packaging materials and return them without delay".split()} | {"non": 300}
LEX = ocr.Lexicon(WORDS, {"non-conforming": 200}, {}, {}, 3)
PAGE = """QX-1234 / Heron Marine Trading Ltd
TERMS

1. The goods
The supplicr must inspect all non-
conforming goods before the sche-
QX-1234 / Heron Marine Trading Ltd
page 2
duled comrnissioning under the agree¬

ment and return thern without delay
- 3 -"""


def test_page():
    p = ocr.Page(PAGE, LEX)
    finds = set(p.finds())
    assert {n for n, k in finds if k == "furniture"} == {0, 6, 7, 11}
    assert {n for n, k in finds if k == "hyphen"} == {5, 8}
    assert {n for n, k in finds if k == "char"} == {4, 8, 10}
    assert p.text() == "TERMS\n1. The goods\nThe supplier must inspect all non-conforming goods before the scheduled commissioning under the agreement and return them without delay"


def test_index_alone():
    p = ocr.Page(PAGE + "\nfor 131.O3 in all", LEX, index_only=True)
    assert p.mended() == [(4, "supplicr", "supplier"), (8, "comrnissioning", "commissioning"), (10, "thern", "them")] or [m[1:] for m in p.mended()] == [("supplicr", "supplier"), ("duled", "duled"), ("comrnissioning", "commissioning"), ("thern", "them")]


def test_method_of_planted_misreadings(spark):
    """Nine in ten words misread by one confusion in 1,200 pages are repaired by the index; nothing else is."""
    import random

    r = random.Random(5)
    words = "measurement condition harbour inspection government delivery management instrument parliament temperature foundation commission".split()
    lines, want = [], set()
    for n in range(1200):
        ws = [r.choice(words) for _ in range(12)]
        if n % 12 == 0:
            k = r.randrange(12)
            seen = ws[k].replace("m", "rn", 1) if "m" in ws[k] else ws[k].replace("i", "l", 1)
            want.add((n, seen, ws[k]))
            ws[k] = seen
        lines.append((n, " ".join(ws)))
    a = spark.createDataFrame(lines, "ocr_id long, text string")
    b = spark.createDataFrame([], "request_id long, raw_text string")
    got = {(x.rec_id, x.seen, x.mended) for x in ocr.mended(a, b).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    lines_found = {(x.rec_id, x.kind) for x in ocr.found(a, b).collect()}
    assert {(n, "char") for n, _, _ in got} <= lines_found


def test_numbers():
    assert ocr._number("131.O3") == "131.03" and ocr._number("2,l47.86") == "2,147.86"
    for clean in ("131.03", "M8", "IO", "512-049-2007-B", "l", "SOS"):
        assert ocr._number(clean) is None


def test_repair(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (1, PAGE), (4, "x" * 60000)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("finds", F.lit(0))
    got = ocr.repair(df).collect()
    assert len(got) == 5 and {r.id: r.repaired for r in got}[2] is None and {r.id: r.repaired for r in got}[3] == ""
    assert all("page 2" not in r.repaired for r in got if r.id == 1)
    assert ocr.repair(df.filter("id < 0")).count() == 0


def test_odd_names_in_a_larger_corpus(spark):
    def texts(first, second, misread):
        # every name once, so that only its letter runs can tell what it is
        names = [f"{a}{v}{b}ahornbury" for a in first for v in "aeiou" for b in second]
        return [f"Signed for by {n} at the gate" for n in names] + [f"Signed for by {a}{a}iahombury at the gate" for a in misread]

    pages = texts("BCDF", "bcdfghklmn", "ZW")
    larger = texts("BCDFGHJKLMNPQRSTVWXZ", "bcdfghjklmnpqrstvwxz", "BCDFGHJKLMNPQRSTVXZW")
    got = []
    for rows in (pages, larger):
        found = ocr.analysed(spark.createDataFrame([(x,) for x in rows], "text string")).collect()
        got.append({r.text: [tuple(f) for f in r.finds] for r in found if r.text in pages})
    assert got[0] == got[1] == {x: [(0, "char")] if "hombury" in x else [] for x in pages}


def test_every_candidate_is_weighed():
    # fourteen words are as near; the neighbouring words speak for the last
    lex = ocr.Lexicon({"aaaaa": 1}, {}, {"the last": 400}, {}, 3)
    lex.words |= {f"near{c}": 900 for c in "abcdefghijklm"} | {"last": 800}
    lex.memo["lasl"] = sorted((ocr.CONFUSED, -n, w) for w, n in lex.words.items() if n > 1)
    assert lex.repair("lasl", before="the") == "last"


def test_misread_cost():
    assert ocr.misread_cost("comrnon", "common") == ocr.CONFUSED and ocr.misread_cost("supplicr", "supplier") == ocr.CONFUSED
    assert ocr.misread_cost("table", "chair") > 1
