from pyspark.sql import functions as F

from quillstone.llm import names, places

COLS = "name string, phone string, email string, tax_id string, name_x string"


def party(spark, rows, key):
    return spark.createDataFrame([(i, n, p, e, t, "clash") for i, n, p, e, t in rows], f"{key} long, {COLS}").withColumn("entity", F.lit(1)).withColumn("pid", F.lit(0))


def test_read_name():
    r = names.read_name
    assert (r("Corp. Ploorbutvat Marine Contractors")["core"], r("PLOORBUTVAT, Mar. Contr")["biz"]) == ("ploorbutvat", "marine/contractors")
    assert r("Bre adrookdait Catering Services Ltd")["core"] == r("Breadrook'dait Catg. Svcs LTD (Head Office)")["core"] == "breadrookdait"
    assert r("P.M.D. Ltd.")["typ"] == "acronym" and r("ppd gmbh")["core"] == "ppd"
    assert r("c/o Freddie Molvatvund")["words"] == ["freddie", "molvatvund"] and r("Molvatvund , F.")["comma"]
    assert r(None) is None and r("  ") is None
    assert len(r("Longname " * 3000)["core"]) > 20000


def test_groups(spark):
    s = [(1, "Kestrelbrook Marine Supplies Ltd", "0161 496 0000", "info@kestrelbrook.test", "12-1234567"), (2, "KESTRELBROKO Mar. Supp", None, None, None), (3, "Kestrelbrook Roofing Supplies Ltd", "0161 496 0000", "info@kestrelbrook.test", None), (1, "Kestrelbrook Marine Supplies Ltd", "0161 496 0000", "info@kestrelbrook.test", "12-1234567"), (4, None, None, None, None), (5, " ", None, None, None)]
    b = [(11, "K.M.S. Ltd", None, None, "121234567"), (12, "Robert Holloway", None, None, None), (13, "Holloway, Bob", None, None, None), (14, "R. Hollowya", None, None, None), (15, "Margaret Holloway", None, None, None), (16, "Meg Holloway", None, None, None)]
    got = {tuple(r) for r in names.found(party(spark, s, "supplier_id"), party(spark, b, "buyer_id")).collect()}
    assert got == {(1, 2), (1, 11), (2, 11), (12, 13), (12, 14), (13, 14), (15, 16)}


def test_repeated_slips_of_a_hot_name(spark):
    names_of = {1000: "Kestrelbrook Marine Supplies Ltd", 2000: "Kestrelbrok Marine Supplies", 3000: "Kestrlebroook Mar. Supp.", 4000: "Kestrelbrood Marine Supplies Ltd"}
    many = {1000: 160, 2000: 4, 3000: 2, 4000: 30}
    s = party(spark, [(k + i, n, None, None, None) for k, n in names_of.items() for i in range(many[k])], "supplier_id")
    got = dict(tuple(r) for r in names.entities(s, party(spark, [], "buyer_id")).collect())
    assert len(got) == 196
    # letters decide, not how often a spelling is used
    assert len(set(got.values())) == 1


def test_entities_survive_growth_orders_and_unlisted_words(spark):
    rows, want = [], {}
    for n in (1, 3, 6, 50):
        for v, name in enumerate(("Tamberwick{} Marine Supplies Ltd", "Tamberwikc{} Marine Supplies Ltd", "Tambrewick{} Mar. Supp.")):
            for i in range(n):
                rows.append((len(rows) + 1, name.format({1: "olde", 3: "inghurst", 6: "abbotsley", 50: "upperfold"}[n]), None, None, None))
                want[len(rows)] = n
    alike = [("Harlow Pemberton Plumbing Supplies Ltd", "Pemberton Harlow Plumbing Supplies Ltd"), ("Quillmere Industrial Fasteners Pty Ltd", "Fasteners Industrial Quillmere Pty Ltd"), ("Harborline Bakery", "Harborlyne Bakery"), ("Bakery Harborline", "Harborline Bakery"), ("Thandiwe Mokoena", "Mokoena Thandiwe")]
    apart = [("John Lee", "John Li"), ("Anna Kim", "Anna King"), ("Delta Systems Ltd", "Belta Systems Ltd"), ("Harborline Bakery", "Harborline Brewery"), ("Tamberwickolde Marine Supplies", "Tamberwickolde Roofing Supplies")]
    at = 1000
    ids = {}
    for a, b in alike + apart:
        for name in (a, b):
            at += 1
            rows.append((at, name, None, None, None))
        ids[a, b] = (at - 1, at)
    both = party(spark, rows, "supplier_id"), party(spark, [], "buyer_id")
    for got in (dict(tuple(r) for r in names.entities(*both).collect()), dict(tuple(r) for r in names.linked(*both).collect())):
        for n in (1, 3, 6, 50):
            assert len({got[i] for i in want if want[i] == n}) == 1, n
        assert len({got[i] for i in want}) == 4
        assert [p for p in alike if got[ids[p][0]] != got[ids[p][1]]] == []
        assert [p for p in apart if got[ids[p][0]] == got[ids[p][1]]] == []


def test_vague_names_among_themselves(spark):
    b = [(1, "Ted Honhokskail", None, None, None), (2, "Ted Honhokskail", None, None, None), (3, "Ted Vatmoller", None, None, None), (4, "Robert Holloway", None, None, None), (5, "Richard Holloway", None, None, None), (6, "R. Holloway", None, None, None), (7, "R. Holloway", None, None, None)]
    got = {tuple(r) for r in names.found(party(spark, [], "supplier_id"), party(spark, b, "buyer_id")).collect()}
    # nobody's full name fits the one, two fit the other
    assert got == {(1, 2), (6, 7)}


def test_empty_names(spark):
    s = party(spark, [], "supplier_id")
    b = party(spark, [], "buyer_id")
    assert names.found(s, b).count() == 0


def test_read_address():
    t = places.Towns(["Krun Falls", "Mick-on-Sea", "Glaspir-les-Bains"])
    r = lambda *a: places.read_address(*a, t)
    a = r("2017 Breakpwad Ln, Unit 55", "Krun Falls", "MA", "12043-1111", None)
    assert (a["number"], a["name"], a["kind"], a["unit"], a["town"], a["post"]) == ("2017", "breakpwad", "lane", "55", "krunfalls", "12043")
    b = r(None, None, None, None, "Attn: Accounts 84 Twieckgriern Ct N Krun Falls MA 12043 USA")
    assert (b["number"], b["name"], b["kind"], b["direction"], b["town"]) == ("84", "twieckgriern", "court", "n", "krunfalls")
    assert r("U41/792 Spairndreax Dr", None, None, None, None)["unit"] == "41"
    g = r(None, None, None, None, "52991 Hootdenburg, Slimbier-Platz 869B, DE")
    assert (g["number"], g["name"], g["kind"], g["post"]) == ("869b", "slimbier", "platz", "52991")
    f = r(None, None, None, None, "73B, bd. Tekthet - 75349 Glaspir-les-Bains - France")
    assert (f["number"], f["name"], f["kind"], f["town"]) == ("73b", "tekthet", "boulevard", "glaspirlesbains")
    assert r(None, None, None, None, "see above") is None and r(None, None, None, None, None) is None


def test_locations(spark):
    rows = [
        (1, "12 Kestrel Road", "Oakton", "TX", "75001", None), (2, None, None, None, None, "12 Kestrle Rd., Oakton TX 75001"), (3, "12 Kestrel", "Oakton", None, None, None), (4, "12 Kestrel Lane East", "Oakford", "TX", "75002", None),
        (5, "14 Kestrel Road", "Oakton", "TX", "75001", None), (6, "12A Kestrel Road", "Oakton", "TX", "75001", None), (7, "9 Heron St, Unit 4", "Oakton", "TX", "75001", None), (8, "9 Heron Street #4", None, None, "75001", None),
        (9, "9 Heron St, Unit 5", "Oakton", "TX", "75001", None), (10, None, None, None, None, None), (11, " ", None, None, None, "see above"), (1, "12 Kestrel Road", "Oakton", "TX", "75001", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "address_id long, street string, city string, state string, postal_code string, full_address string, location string")
    assert {tuple(r) for r in places.found(df).collect()} == {(1, 2), (1, 3), (2, 3), (7, 8)}
    assert places.found(df.filter("address_id < 0")).count() == 0


def test_towns_by_one_rule_at_every_size(spark):
    cols = "address_id long, street string, city string, state string, postal_code string, full_address string"
    few = [(1, "12 Kestrel Road", "Oakbrook", None, None, None), (2, "14 Kestrel Road", "Oakbrook", None, None, None), (3, "3 Heron Road", "Oakbrok", None, None, None), (4, "8 Heron Lane", "Lonemarsh", None, None, None)]
    many = few + [(i, f"{i} Kestrel Road", "Farfield" if i % 3 else "Oakbrook", None, None, None) for i in range(10, 2600)]
    assert places.town_names(spark.createDataFrame(few, cols)) == ["lonemarsh", "oakbrook"]
    assert places.town_names(spark.createDataFrame(many, cols)) == ["farfield", "lonemarsh", "oakbrook"]


def test_unlisted_town(spark):
    r = lambda text: places.read_address(None, None, None, None, text, places.Towns([]))
    a = r("Trirnville Georgia 47 Thetspeam Rd.")
    assert (a["number"], a["name"], a["kind"], a["town"], a["state"]) == ("47", "thetspeam", "road", "trirnville", "ga")
    a = r("Trirnville New York 47 Thetspeam Rd.")
    assert (a["name"], a["town"], a["state"]) == ("thetspeam", "trirnville", "ny")
    assert r("Slimbier-Platz 869B")["name"] == "slimbier"
    # it is kept as written where its postcode has another town
    rows = [(1, "5 Heron Road", "Oakbrook", "75001", None), (2, "5 Heron Road", "Oakbrook", "75001", None), (3, None, None, "75001", "Lonemarsh 5 Heron Road"), (4, None, None, "75001", "5 Heron Road"), (5, None, None, None, "Lonemarsh 5 Heron Rd")]
    df = spark.createDataFrame([(i, s, c, None, p, f) for i, s, c, p, f in rows], "address_id long, street string, city string, state string, postal_code string, full_address string")
    assert {tuple(x) for x in places.found(df).collect()} == {(1, 2), (1, 4), (2, 4), (3, 5)}
