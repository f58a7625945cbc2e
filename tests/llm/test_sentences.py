import pytest
from pyspark.sql import functions as F

from foliomill.llm.sentences import masked, restore, split_sentences

CASES = [
    ["Dr. Bell paid $3.50 to J. R. Wex, etc. in Vol. 4.2.", "Use it."],
    ["It holds dates, units, etc.", "In No. 3, M.-L. Tess et al. report .5 percent vs. 1,200.0 before."],
    ["The job ended at 3:15 p.m.", "At 9:00 a.m. it ran again..."],
    ["See https://a.example/x?y=1.2 and run.py v2.0.1, i.e. 5 of them.", "iFoo failed!"],
    ['A. Bell asked, "Who ran it? Was it late?" and waited.', "Done."],
    ["“Do not trust it!” Mr. Tar wrote.", '"It is stale. Check it," said Ms. Lo.'],
    ['The log said: "It failed. Retry now."', "Nobody came."],
    ["The job [it was cold. Truly!] came back.", "(All of it was archived.)", "What?!"],
    ["It waited... and then stopped.", "The end…", "New start."],
    ["«Reinicie la cola. Luego espere», dijo la Dra. Almar.", "¿Por qué?", "¡No!"],
    ["Am 17. März kam z. B. der Index, d. h. Kap. 22.", "Gut."],
    ["А. Б. Веткин описал т. е. старую версию, см. рис. 19.", "Кто?"],
    ["Γιατί λείπει η πηγή;", "Ο κ. Τάρνης, βλ. κεφ. 3."],
    ["डॉ. तारन ने 2.5 मापे।", "“फिर बनाओ। फिर रुको।” संपादक ने कहा।"],
    ["قاس د. تارن 7.05 ثانية.", "لماذا اختفى؟", "«أعد. ثم انتظر»، قالت."],
    ["누가 닫았나요?", "“고치세요. 기다리세요.”라고 말했다.", "끝났다."],
    ["ใครปิดดัชนี", "รุ่น 41.2 เร็ว", "ระบบ Quarrix ใช้เวลา 5 วินาที"],
]
WIDE = [
    ["报告（见第4节。）需要复核。", "“先重建。再等。”管理员说。", "更新了……", "谁？"],
    ["索引は古い（第3章。）と言う。", "「更新して。待って。」と言った。", "消さないで！"],
]
STRUCTURE = (
    "# A heading. With a dot?\nText one. Text\ntwo goes on\n\nNo end mark\n\n- item one\n- Item two. More.\n1. First\n2. Second\n"
    "```\ncode. Code!\n\nmore\n```\nAfter.\n| a | b |\n|---|---|\n| 1. x | Y. |\n\n  last line.  "
)
PIECES = [
    "# A heading. With a dot?", "Text one.", "Text\ntwo goes on", "No end mark", "- item one", "- Item two.", "More.", "1. First", "2. Second",
    "```\ncode. Code!\n\nmore\n```", "After.", "| a | b |\n|---|---|\n| 1. x | Y. |", "last line.",
]


def split(spark, texts):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc long, body string, at int, part string")
    got = {}
    for r in split_sentences(df, "doc", "body").orderBy("doc", "sent_start").collect():
        got.setdefault(r.doc, []).append(texts[r.doc][r.sent_start : r.sent_end])
    return [got.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize("glue", [" ", "  ", "\n", "\n\n", "\r\n\r\n", "\xa0"])
def test_languages(spark, glue):
    assert split(spark, [glue.join(c) for c in CASES]) == CASES


def test_scripts_without_spaces(spark):
    assert split(spark, ["".join(c) for c in WIDE]) == WIDE


def test_joined_without_a_space(spark):
    assert split(spark, ["It is late.The end! Was it?Nobody knew U.N. style.md files."]) == [["It is late.", "The end!", "Was it?", "Nobody knew U.N. style.md files."]]


def test_structure(spark):
    assert split(spark, [STRUCTURE, STRUCTURE.replace("\n", "\r\n")]) == [PIECES, [p.replace("\n", "\r\n") for p in PIECES]]


def test_nothing_lost_and_offsets_in_code_points(spark):
    texts = ["\U0001f680 Go. \U0001f469‍\U0001f52c Stop!", "﻿Start. End.﻿ ", 'Odd " quote. Still ( open. “ Here.', "." * 50, " x. Y."]
    for text, parts in zip(texts, split(spark, texts), strict=True):
        assert "".join("".join(parts).split()) == "".join(text.replace("﻿", "").split())
        assert all(p == p.strip().strip("﻿") for p in parts)


def test_null_blank_and_very_long(spark):
    long = "A short one. " * 20000 + '"' + "no end " * 5000
    got = split(spark, [None, "", " \n\t ﻿ ", long])
    assert got[:3] == [[], [], []]
    assert len(got[3]) == 20001


def test_mask_keeps_length(spark):
    text = "Dr. Bell saw v1.2 of a.b at x.y/z?q=1, cf. p. 3."
    row = spark.createDataFrame([(text,)], "t string").select(masked(F.col("t")).alias("m"), restore(masked(F.col("t"))).alias("r")).first()
    assert len(row.m) == len(text) and row.m.count(".") == 1 and row.r.replace("?", ".") == text.replace("?", ".")


@pytest.mark.parametrize("size", [15, 150, 1500, 20000])
def test_quotations_of_any_length(spark, size):
    inner = "It is so. " * size
    texts = [f'He said, "{inner}" and left. Then more.', f"It [{inner}] came. Then more.", f"报告说：“{'先重建。' * size}”管理员走了。谁？"]
    assert [len(x) for x in split(spark, texts)] == [2, 2, 3]


def test_long_texts_grow_in_proportion(spark):
    one = "This is sentence number one, of many. "
    df = spark.createDataFrame([(1, one * 150_000)], "doc long, body string")
    found = split_sentences(df, "doc", "body").agg(F.count("*"), F.min(F.col("sent_end") - F.col("sent_start")), F.max("sent_end"), F.sum(F.col("sent_start") % len(one))).first()
    assert tuple(found) == (150_000, len(one) - 1, len(one) * 150_000 - 1, 0)


@pytest.mark.parametrize("opener", "“„«「『《([（")
def test_openers_that_nothing_closes(spark, opener):
    short = f"It {opener}came late. Then it {opener}went. "
    paragraph = "Here (it ended. Or not) and “so. On” it «was. So» on. A „second. One“ went. "
    texts = [paragraph + short, paragraph * 2000 + short * 20_000 + "\n\n" + paragraph + short]
    few, many = split(spark, texts)
    assert many[-len(few) :] == few
    assert few[-2:] == [f"It {opener}came late.", f"Then it {opener}went."]
    assert len(many) == (len(few) - 2) * 2001 + 2 * 20_001
