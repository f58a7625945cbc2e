import random
from itertools import combinations

import pytest

from foliomill.llm.names import MAX_EDITS, entities, near_keys, parse, same_pairs

#: Common surnames make the given names known.
CROWD = [f"{given} {surname}" for given in ("Robert", "Margaret", "Dmitri", "Katherine", "Kwame") for surname in ("Alpengor", "Brustwik", "Costerlin", "Dunvaarde")]
GROUPS = [
    ["Robert T. Zandivaro", "Zandivaro, Robert", "Bobby Zandivaro", "R. Zandivaro", "ROBERT ZANDIVVARO", "Prof Robert Zandivaro (ed.)", "Zandivaro Robert", "by Rpbert Zandivaro, PhD"],
    ["Margaret Quellensky Jr."],
    ["Margaret Quellensky Sr.", "Quellensky, Peggy, Sr."],
    ["Dmitri A. Moskaverin"],
    ["Dmitri C. Moskaverin", "Moskaverin, D. C."],
    ["D. Moskaverin"],
    ["Katherine van der Hoolstraat-Bree", "van der Hoolstraat-Bree, Katherine", "KATHERINE VANDERHOOLSTRAAT-BREE"],
    ["Kwame Lövenström", "Kwame LÃ¶venstrÃ¶m", "Kwame Lovenstroem"],
    ["Kwame Lövenström and Dmitri C. Moskaverin"],
    ["Halvenor Open Standards Foundation", "Open Standards Foundation, Halvenor", "halvenor open stds. fdn.", "Halvenor Opne Standards Foundation (OSF)", "The Halvenorr Open Standards Foundation, LLC"],
    ["Halvenor Working Group on Interoperability"],
    ["José Ortelano y Gassevit", "Ortelano y Gassevit, José", "José Ortelano y Gasevit"],
    ["World Vellum Organization", "World Velum Organization", "The World Vellum Organization, Inc."],
    ["World Vellum Federation"],
    ["Robert A. B. Trellimane", "R. A. B. Trellimane", "Robert A. Trellimane"],
    ["Margaret A. B. Corvessian"],
    ["Margaret A. C. Corvessian", "M. A. C. Corvessian", "Corvessian, Margaret A. C."],
    ["M. A. Corvessian"],
]


def test_groups(spark):
    names = [(n, g) for g, group in enumerate(GROUPS) for n in group] + [(n, f"crowd{i}") for i, n in enumerate(CROWD)]
    rows = [(i, n, 1) for i, (n, _) in enumerate(names)]
    rows += [(1000, None, 1), (1001, "  ", 1), (None, "Robert Zandivaro", 1), rows[0]]
    found = entities(spark.createDataFrame(rows, "author long, label string, entity int"), "author", "label")
    got = {(r.a, r.b) for r in same_pairs(found, "a", "b").collect()}
    want = {(i, j) for i, j in combinations(range(len(names)), 2) if names[i][1] == names[j][1]}
    assert got == want


def test_empty(spark):
    found = entities(spark.createDataFrame([], "author long, label string"), "author", "label")
    assert same_pairs(found, "a", "b").count() == 0


@pytest.mark.parametrize(
    ("name", "given", "middle", "surname", "gen"),
    [
        ("Dr. Ana M. de la Cruz", "ana", "m", "delacruz", None),
        ("Cruz, A. M., Jr.", "a", "m", "cruz", "jr"),
        ("E.B. White", "e", "b", "white", None),
        ("van Dyke, Jo", "jo", "", "vandyke", None),
        ("Mei-Ling Tan", "meiling", "", "tan", None),
        ("Prince", "", "", "prince", None),
        ("Jon A. B. Smith", "jon", "ab", "smith", None),
        ("José Ortega y Gasset", "jose", "", "ortegaygasset", None),
        ("Ramón y Cajal, Santiago", "santiago", "", "ramonycajal", None),
    ],
)
def test_parse(name, given, middle, surname, gen):
    p = parse(name)
    assert (p["given"], p["middle"], p["surname"], p["gen"]) == (given, middle, surname, gen)


def test_parse_other_kinds():
    assert parse("Ann Lee & Bo Yi")["kind"] == "two"
    assert parse("Ann Lee y Bo Yi")["kind"] == parse("Lee et Yi")["kind"] == parse("Jo y Ana Ruiz")["kind"] == "two"
    assert parse("World Health Organization")["kind"] == parse("Ministry of Ink")["kind"] == parse("International Council for Paper")["kind"] == "body"
    assert parse("Anna Maria Clement")["kind"] == parse("J. K. Fenmanship")["kind"] == "person"
    assert parse("Ann Lee; ")["kind"] == "person"
    assert parse("Xyz University Dept. of Informatics")["kind"] == "body"
    assert parse(" ?? ") is None and parse(None) is None and parse("x" * 10000)["kind"] == "person"


def test_near_words_share_a_key():
    rng = random.Random(4)
    for size in (6, 12, 16, 17, 18, 30, 300):
        for _ in range(40):
            word = "".join(rng.choices("abcdefgh", k=size))
            other = list(word)
            for _ in range(MAX_EDITS):
                p = rng.randrange(len(other))
                other[p : p + 1] = rng.choice([[], ["x"], [other[p], "y"]])
            other = "".join(other)
            if len(other) > 5:
                assert set(near_keys(word)) & set(near_keys(other)), (word, other)
        assert len(near_keys(word)) < 300


def test_long_names_with_one_opening_do_not_meet():
    a, b = ("internationalvellum" + x * 9 for x in "kz")
    assert not set(near_keys(a)) & set(near_keys(b))


def test_slip_of_a_large_family(spark):
    given = "Anna Boris Clara Dmitri Elena Fritz Greta Hans Ida Jonas Karl Lena Maria Nils Olga Pavel".split()
    names = [f"{g} Westermalm" for g in given for _ in range(4)] + ["Anna Westermlam", "Boris Westermlam"]
    found = entities(spark.createDataFrame(list(enumerate(names)), "author long, label string"), "author", "label")
    by_id = {r.id: r.entity for r in found.collect()}
    assert (by_id[64], by_id[65]) == (0, 4)
