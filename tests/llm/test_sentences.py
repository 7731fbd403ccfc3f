import time

import pytest

from tessera.llm.sentences import sentences, split

CASES = {
    "Dr. Hallick asked Prof. Vorne, Ph.D., about it. He did not.": ["Dr. Hallick asked Prof. Vorne, Ph.D., about it.", "He did not."],
    "It was 1,204.75, not .016. Next!": ["It was 1,204.75, not .016.", "Next!"],
    "See Figs. 3 and 4, e.g. in cells.v2.tsv. mRNA stayed.": ["See Figs. 3 and 4, e.g. in cells.v2.tsv.", "mRNA stayed."],
    'She wrote: "Stop here. Rerun it." and left. The log said "done." Then it ended.': ['She wrote: "Stop here. Rerun it." and left.', 'The log said "done."', "Then it ended."],
    "It ended. (The counts are in x.log.) Then more.": ["It ended.", "(The counts are in x.log.)", "Then more."],
    "We kept tiles, summits, etc. The rest (since approx. 6 p.m.) went. At 4 a.m. we left.": ["We kept tiles, summits, etc.", "The rest (since approx. 6 p.m.) went.", "At 4 a.m. we left."],
    "And then ... nothing. Is it?! Yes": ["And then ... nothing.", "Is it?!", "Yes"],
    "Am 9. Juni lag z. B. die Probe vor, usw. Der 2. Lauf begann um 16.30 Uhr. „Geht das?“, fragte er.": ["Am 9. Juni lag z. B. die Probe vor, usw.", "Der 2. Lauf begann um 16.30 Uhr.", "„Geht das?“, fragte er."],
    "« Est-ce un doublon ? » demanda M. Hallick. Il a perdu env. 3,5 pour cent !": ["« Est-ce un doublon ? » demanda M. Hallick.", "Il a perdu env. 3,5 pour cent !"],
    "А. Б. Adabey проверил т. н. клетки и т. д. Он написал: «Стоп. Ещё раз.» и вышел.": ["А. Б. Adabey проверил т. н. клетки и т. д.", "Он написал: «Стоп. Ещё раз.» и вышел."],
    "审稿人问：“真的吗？”他写道：“先停。再来。”然后走了。（在a.log中。）好！！": ["审稿人问：“真的吗？”", "他写道：“先停。再来。”然后走了。", "（在a.log中。）", "好！！"],
    "彼女は「止めて。」と書いた。次は1.5倍｡ 終": ["彼女は「止めて。」と書いた。", "次は1.5倍｡", "終"],
    "ผลแรกดี ผลที่สองใช้รุ่น v3.4 ของระบบ จบ": ["ผลแรกดี", "ผลที่สองใช้รุ่น v3.4 ของระบบ", "จบ"],
    "डॉ. राम ने कहा, “रुको। चलो।” और गया। ठीक है।।": ["डॉ. राम ने कहा, “रुको। चलो।” और गया।", "ठीक है।।"],
    "كتب: «توقف. أعد.» ثم أغلق. هل هذا صحيح؟ نعم": ["كتب: «توقف. أعد.» ثم أغلق.", "هل هذا صحيح؟", "نعم"],
    "Heading without stop\n\n- item one. still one\n- item two\nA line\nthat goes on. End": ["Heading without stop", "- item one. still one", "- item two", "A line\nthat goes on.", "End"],
    "﻿  Leading mark.\r\n\r\n \t\r\nNext one ;: same": ["Leading mark.", "Next one ;: same"],
    "It was suspected.Dr. Vorne left, it's said.": ["It was suspected.", "Dr. Vorne left, it's said."],
    'A lone " quote. Still ends.': ['A lone " quote.', "Still ends."],
    "A lone ( bracket. Still ends.": ["A lone ( bracket.", "Still ends."],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert [text[a:b] for a, b in split(text)] == CASES[text]


@pytest.mark.parametrize("text", [None, "", " ", "\n\n\r\n\t", "﻿", "　\xa0"])
def test_none(text):
    assert split(text) == []


def test_offsets_cover_all_but_blanks(spark, root, rows):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    seen = {}
    for d, k, a, b in rows(sentences(docs, "doc_id", "text")):
        seen.setdefault(d, []).append((k, a, b))
    assert set(seen) == {d for d, t in texts.items() if t and t.strip().strip("﻿").strip()}
    for d, spans in seen.items():
        spans.sort()
        assert [k for k, _, _ in spans] == list(range(1, len(spans) + 1))
        at = 0
        for _, a, b in spans:
            assert at <= a < b and not texts[d][at:a].replace("﻿", "").strip()
            assert not texts[d][a].isspace() and not texts[d][b - 1].isspace()
            at = b
        assert not texts[d][at:].replace("﻿", "").strip()


def test_very_long_text():
    text = "One thing (it is said). " * 40_000
    assert len(split(text)) == 40_000
    assert len(split('"' * 50_001 + "a. " * 1000)) >= 1


@pytest.mark.parametrize("piece", ["( ab. ", "« ab. ", "(a.) ", '"a. ', "[x (y. "])
def test_time_grows_with_length(piece):
    def took(n):
        began = time.process_time()
        split(piece * n)
        return time.process_time() - began

    took(100)
    assert took(100_000) < 20 * max(took(10_000), 0.05) + 2


def test_empty_table_and_null_key(spark):
    df = spark.createDataFrame([(None, "One. Two.", 1)], "id long, text string, sent_no int")
    assert [tuple(r) for r in sentences(df, "id", "text").collect()] == [(None, 1, 0, 4), (None, 2, 5, 9)]
    assert sentences(df.limit(0), "id", "text").count() == 0
