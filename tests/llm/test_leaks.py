import random

import numpy as np
import pytest

from foliomill.llm import leaks

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{i}" for i in range(3000)]
NOTICE = "this notice stands under every page of the set and says nothing at all"


def texts(seed, n, size=30):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=size)) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    return [(i, f"{t}. {NOTICE}.") for i, t in enumerate(texts(1, 40), 500)] + [(900, "嘉川秦的磨坊主用份印章换来表盘尽管海海木劝过磨坊主留下海图"), (901, None), (902, " "), (900, "嘉川秦的磨坊主用份印章换来表盘尽管海海木劝过磨坊主留下海图")]


def test_multi_index_finds_all_within_radius(items):
    index = leaks.ItemIndex([i for i, t in items if t], [t for _, t in items if t])
    rng = np.random.default_rng(2)
    base = index.prints[rng.integers(0, len(index.prints), 300)]
    flips = np.zeros(300, dtype=np.uint64)
    for _ in range(5):
        flips ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    prints = base ^ flips
    left, right = index.near(prints)
    brute = {(a, b) for a, p in enumerate(prints) for b in np.flatnonzero(np.bitwise_count(index.prints ^ p) <= leaks.RADIUS)}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == brute


def test_found_and_not_found(spark, items):
    word = {i: t.split(". ")[0].split() for i, t in items if t and i < 600}
    filler = texts(9, 1)[0]
    edited = word[503][:]
    edited[7] = "changed"
    edited[22] = "altered"
    docs = [
        (1, f"{filler} {' '.join(word[500])} {filler}", {500}),
        (2, f"{filler} {' '.join(word[501][4:18]).upper()} {filler}", {501}),
        (3, " ".join(f"<b>{w}</b>" if k % 3 == 0 else f"**{w[:2]}­{w[2:]}**\n" for k, w in enumerate(word[502])), {502}),
        (4, " ".join(edited), {503}),
        (5, f'{filler} The words "{" ".join(word[504][3:9])}" occur.', set()),
        (6, f"{filler} {NOTICE}", set()),
        (7, "前文。嘉川秦的磨坊主用份印章换来表盘尽管海海木劝过！后文", {900}),
        (8, "前文。嘉川秦的磨坊主用！后文", set()),
        (9, None, set()),
        (10, "", set()),
        (11, (filler + " ") * 3000 + " ".join(word[505]), {505}),
        (12, f"{' '.join(word[506])} {' '.join(word[507])}", {506, 507}),
    ]
    table = spark.createDataFrame([(i, t, 7) for i, t, _ in docs] + [(1, docs[0][1], 7)], "doc long, body string, similarity int")
    found = leaks.find_leaks(table, "doc", "body", spark.createDataFrame([(*x, "en") for x in items], "item long, passage string, lang string"), "item", "passage").collect()
    assert sorted((r.doc, r.item) for r in found) == sorted((d, i) for d, _, s in docs for i in s)


def pairs(spark, documents, items):
    found = leaks.find_leaks(spark.createDataFrame(documents, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, p string"), "i", "p").collect()
    return sorted((r.d, r.i) for r in found)


def test_passage_in_many_documents_is_no_notice(spark):
    passages = texts(4, 2, 12)
    rows = [(i, passages[0] + " " + f"tail {i}") for i in range(60)] + [(99, passages[1])]
    assert pairs(spark, rows, list(enumerate(passages))) == [(i, 0) for i in range(60)] + [(99, 1)]


def test_notice_at_the_end_of_items(spark, items):
    filler = texts(12, 30, 8)
    rows = [(i, f"{x} {NOTICE} {x[::-1]}") for i, x in enumerate(filler)] + [(99, items[3][1])]
    assert pairs(spark, rows, [x for x in items if x[1]]) == [(99, items[3][0])]


def test_repeated_items_in_many_documents(spark):
    passages, filler = plain(14, 2, 20), plain(15, 50, 6)
    items = [(1, passages[0]), (2, passages[0]), (3, passages[0]), (4, passages[0] + "."), (5, passages[1]), (5, passages[0])]
    rows = [(i, f"{x} {passages[0]} {x[::-1]}") for i, x in enumerate(filler)]
    assert pairs(spark, rows, items) == [(i, k) for i in range(50) for k in (1, 2, 3, 4, 5)]


def test_every_counting_stretch_is_proposed(monkeypatch):
    """The windows lose nothing: trying every stretch on every diagonal finds the same."""
    rng = random.Random(21)
    passages = plain(20, 6, 24)
    index = leaks.ItemIndex(list(range(6)), passages)
    documents = []
    for _ in range(150):
        part = rng.choice(passages).split()
        begin = rng.randrange(0, 13)
        part = part[begin : begin + rng.randrange(9, 25)]
        for _ in range(rng.randrange(0, 5)):
            p = rng.randrange(len(part))
            part[p : p + 1] = rng.choice([["other"], [], [part[p], "more"], [part[p][1:]], [part[p][:3] + "z" + part[p][3:]]])
        documents.append(" ".join(plain(rng.randrange(99), 1, 5) + part + plain(rng.randrange(99), 1, 5)))
    got = {(d, i, tuple(starts)) for d, i, _, starts, _ in index.scan(documents)}

    def all_tries(self, rule, document, k, diagonal, at):
        lengths = [len(leaks.words(t)) for t in documents]
        return tuple(np.array([(d, s, b) for d, n in enumerate(lengths) for s in range(len(self.first)) for b in range(-rule[0] // leaks.BAND - 1, n // leaks.BAND + 1)]).T)

    monkeypatch.setattr(leaks.ItemIndex, "_tries", all_tries)
    brute = {(d, i, tuple(starts)) for d, i, _, starts, _ in index.scan([*documents])}
    assert len({(d, i) for d, i, _ in brute}) > 60
    assert {(d, i) for d, i, _ in got} == {(d, i) for d, i, _ in brute}


def test_weights_do_not_depend_on_blocks():
    passages = plain(30, 20)
    whole = leaks.ItemIndex(list(range(20)), passages)
    counts = leaks.word_counts(passages)
    half = leaks.ItemIndex(list(range(10)), passages[:10], counts, 20)
    assert all(half.weight[v] == whole.weight[whole.vocabulary[w]] for w, v in half.vocabulary.items())


def plain(seed, n, size=30):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("bcdfghklmnprst", k=7)) for _ in range(size)) for _ in range(n)]


def found_in(index, text):
    return {int(index.ids[i]) for _, i, *_ in index.scan([text])}


@pytest.mark.parametrize("most", [5, 1 << 40])
def test_unique_rows(most):
    rows = np.random.default_rng(3).integers(-most, most, (400, 3))
    assert np.array_equal(np.stack(leaks.unique_rows(*rows.T), 1), np.unique(rows, axis=0))


def test_changes_at_every_position_of_a_part():
    passages = plain(1, 40)
    index = leaks.ItemIndex(list(range(500, 540)), passages)
    before, after = plain(9, 2)
    part = passages[3].split()[6:18]

    def lies(words):
        return found_in(index, f"{before} {' '.join(words)} {after}") == {503}

    assert lies(part)
    for p in range(12):
        assert lies([*part[:p], "changed", *part[p + 1 :]]), p
        assert lies([*part[:p], part[p][:2] + "x" + part[p][2:], *part[p + 1 :]]), p
        assert lies([*part[:p], *part[p + 1 :]]), p
        assert lies([*part[:p], "more", *part[p:]]), p
        for q in range(p):
            twice = ["changed" if k in (p, q) else w for k, w in enumerate(part)]
            # two changes at the ends leave a phrase of ten words
            assert lies(twice) == ((q, p) not in {(0, 11), (0, 1), (10, 11)}), (q, p)
    assert not lies(part[:10])


def test_change_at_every_position_of_a_chinese_part(items):
    index = leaks.ItemIndex([900], [items[40][1]])
    part = items[40][1][4:24]
    for p in range(20):
        assert found_in(index, f"前文{part[:p]}錯{part[p + 1 :]}後文") == {900}, p


def test_phrase_about_other_names_is_no_passage():
    frame = "who of them did {} so that he and {} were at it for the day"
    names = plain(5, 1, 80)[0].split()
    index = leaks.ItemIndex(list(range(40)), [frame.format(*names[2 * i : 2 * i + 2]) + " " + plain(50 + i, 1, 12)[0] for i in range(40)])
    assert found_in(index, frame.format("othername", "anothername")) == set()


def test_copies_of_a_page(spark):
    page, other = plain(6, 2, 40)
    passages = plain(4, 3, 20)
    rows = [(i, f"{page} {passages[0]} {other}") for i in range(50)] + [(i, f"{page} {i} {passages[0]} {other}"[i - 50 :]) for i in range(50, 60)]
    rows += [(99, f"{other} {passages[0]}"), (100, passages[1])] + [(i, f"{x} {passages[2]} {x[::-1]}") for i, x in enumerate(plain(7, 60, 5), 200)]
    found = leaks.find_leaks(spark.createDataFrame(rows, "d long, t string"), "d", "t", spark.createDataFrame(list(enumerate(passages)), "i long, p string"), "i", "p").collect()
    assert sorted((r.d, r.i) for r in found) == [(i, 0) for i in range(60)] + [(99, 0), (100, 1)] + [(i, 2) for i in range(200, 260)]


@pytest.mark.parametrize("block", [leaks.BLOCK_ITEMS, 1])
def test_text_shared_by_items(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", block)
    source = plain(8, 1, 60)[0].split()
    items = [(1, " ".join(source[:30])), (2, " ".join(source[:30])), (3, " ".join(source[15:45]))]
    rows = [(7, " ".join(source[16:29])), (8, " ".join(source[2:15])), (9, " ".join(source[31:44])), (10, plain(2, 1)[0])]
    found = leaks.find_leaks(spark.createDataFrame(rows, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, p string"), "i", "p").collect()
    assert sorted((r.d, r.i) for r in found) == [(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (9, 3)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "d long, t string"), spark.createDataFrame([], "i long, p string")
    assert leaks.find_leaks(docs, "d", "t", items, "i", "p").count() == 0
