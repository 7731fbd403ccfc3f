import random

import numpy as np

from tessera.llm import leakage
from tessera.llm.leakage import leaked_items, suffix_array, without_leaked, words

ITEMS = [
    (1, "en", "The quick auditor measured seven copper pipes before noon. Each pipe leaked twice under the old pressure rule. Nobody recorded which valve had failed first. The report was filed on a rainy Tuesday in March."),
    (2, "en", "A careful reader leaves a remainder of 6 under the null model. The second hypothesis explains 14 percent of all variance. Name the 44 features that must be renumbered. Answer with one number and give your reason."),
    (3, "zh", "细心的读者不得超过十四个单位。左边的图板只碰到邻居一回。设想一个很长的基因组余下七十四。为什么基因会移到第十八位呢？"),
    (4, "en", ""),
    (5, "en", None),
]
FILLER = "In the run of last week the lanes were pooled and the sorted index was written again without any seed or label. "


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, lang string, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leaked_items(d, "doc_id", "text", i).collect())


def test_whole_half_and_altered(spark):
    whole = ITEMS[0][2]
    sentences = whole.split(". ")
    altered = whole.upper().replace("SEVEN", "SEVN").replace(" ", "  ").replace(".", " ;").replace("RAINY", "RAINNY")
    zh = ITEMS[2][2]
    docs = [
        (10, FILLER + whole + FILLER, ""),
        (11, FILLER + ". ".join(sentences[:2]) + ". " + sentences[2] + FILLER, ""),
        (12, sentences[0] + ". " + FILLER * 3, ""),  # one sentence of four
        (13, FILLER + altered, None),
        (14, "前言。" + zh + "后记。", ""),
        (15, zh[:12] + "其他的话。", ""),
        (16, "Ｔｈｅ ｑｕｉｃｋ" + whole[9:], ""),
        (17, None, ""),
        (18, "", ""),
        (19, "Answer with one number and give your reason. " + FILLER, ""),
        (20, whole, ""),
        (20, whole, ""),
        (21, ". ".join(reversed(sentences)), ""),  # not in order
        (22, whole + " " + ITEMS[1][2], ""),
    ]
    assert run(spark, docs) == [(10, 1), (11, 1), (13, 1), (14, 3), (16, 1), (20, 1), (20, 1), (22, 1), (22, 2)]


def test_place_removal_and_parts(spark, monkeypatch):
    whole = ITEMS[0][2]
    docs = [(1, FILLER + whole + FILLER, ""), (2, FILLER, ""), (3, FILLER * 2 + ". ".join(ITEMS[1][2].split(". ")[1:]), ""), (None, FILLER, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, share string")
    i = spark.createDataFrame(ITEMS, "item_id long, lang string, text string")
    for chars, places in ((50_000_000, 4_000_000), (150, 3)):
        monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", chars)
        monkeypatch.setattr(leakage, "MOST_PLACES", places)
        found = {(r["doc_id"], r["item_id"]): r for r in leaked_items(d, "doc_id", "text", i).collect()}
        assert set(found) == {(1, 1), (3, 2)}
        for (doc, item), r in found.items():
            mine, theirs = words(dict((k, t) for k, t, _ in docs)[doc]), words(dict((k, t) for k, _, t in ITEMS)[item])
            assert mine[r["doc_from"] : r["doc_to"]] == theirs[r["item_from"] : r["item_to"]] and r["share"] == (r["item_to"] - r["item_from"]) / len(theirs)
        assert found[1, 1]["share"] == 1 and found[1, 1]["doc_from"] == len(words(FILLER))
        assert [r["doc_id"] for r in without_leaked(d, "doc_id", "text", i).orderBy("doc_id").collect()] == [None, 2]


def test_very_long_document(spark):
    assert run(spark, [(1, FILLER * 20_000 + ITEMS[1][2] + FILLER * 100, "")]) == [(1, 2)]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "some text", "")], [(4, "en", "")]) == []


def test_suffix_array_is_sorted():
    x = np.array(random.Random(2).choices(range(4), k=400))
    assert list(suffix_array(x, 400)) == sorted(range(400), key=lambda i: list(x[i:]))


def test_words():
    assert words("Ｋ19’s Été—fusión 第3个\xad") == ["k19", "s", "ete", "fusion", "第", "3", "个"]
    assert words(None) == []
