from periodiq.llm.residue import residue

CLEAN = [
    "The index lists Acta Bo with 41 issues and a gap in 2010.",
    "Page 404 of the bound volume is missing; pages 500 to 503 were scanned twice.",
    'Of the 2 links we followed, 60 returned a page saying 404 Not Found, which we recorded.',
    "Lorem ipsum, the printers' filler, was found in 12 of the fake journal's pages.",
    "The site of Acta Bo required JavaScript until 2019, but a plain version is now offered.",
    'The author template asks writers to replace the words "Insert title here" before submission.',
    "",
    None,
    "   ",
]
PAGES = ["404 - Page not found. nginx", "Acta Bo\n503 Service Temporarily Unavailable", "Your browser does not allow scripts. Reload", "Bitte aktivieren Sie JavaScript!", "Acta Bo Access denied Home | Issues | About | Contact"]
FILLER = ["Acta Bo\n\nYour content goes here. Your content goes here.", "Lorem ipsum dolor sit amet consectetur elit.", "asdf asdf asdf qwer", "Hier steht Blindtext ohne Bedeutung"]
FORMS = ["Title: [ ]\nIssn: ________\nVenue: (to be completed)"]


def found(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {}
    for r in residue(d).collect():
        out.setdefault(r[0], set()).add(r[1])
    return out


def test_kinds(spark):
    texts = CLEAN + PAGES + FILLER + FORMS
    got = found(spark, texts)
    at = len(CLEAN)
    assert set(got) == set(range(at, len(texts)))
    assert all("page" in got[i] for i in range(at, at + len(PAGES)))
    assert all("filler" in got[i] for i in range(at + len(PAGES), at + len(PAGES) + len(FILLER)))
    assert "form" in got[len(texts) - 1]


def test_slots_and_mentions(spark):
    names = ["Ann", "Bob", "Cyd", "Dov", "Eva"]
    mentions = [f"In the form, fields such as {{{{title}}}} are filled by the office before the letter is sent to {n}." for n in names]
    undefined = [f"The value was undefined for {i} venues of {n}, and a null result was printed." for i, n in enumerate(names)]
    slots = ["Dear {{name}}, thank you for the paper.", "Dear %(author)s, thank you for the paper.", "Dear null, thank you for the paper.", "Dear undefined, thank you for the paper.", "Dear ________, thank you for the paper."]
    clean = ["Dear Ann, thank you for the paper.", "Citations such as [12] or [Bo, 1990] are read, and {x, y} too.", "<i>Acta Bo</i> has p < 0.05."]
    got = found(spark, mentions + undefined + clean + slots)
    first = len(mentions + undefined + clean)
    assert set(got) == set(range(first, first + len(slots)))


def test_copies_do_not_make_a_mention(spark):
    assert set(found(spark, ["Welcome to {{site}}, the home of reviews."] * 50)) == set(range(50))


def test_long_null_empty_and_clashing_columns(spark):
    long = "The index lists Acta Bo with 41 issues. " * 20_000
    assert found(spark, [long, long + "Dear {{name}}, welcome."]).keys() == {1}
    d = spark.createDataFrame([(1, "Dear ${name}, welcome to us.", "x", "y")], "doc_id bigint, text string, _key string, sig string")
    assert residue(d).count() == 1
    assert residue(d.limit(0)).count() == 0
