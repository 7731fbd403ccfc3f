"""Sentences of texts in any script, as offsets in code points.

A pushdown automaton reads the places where something can happen: opening and
closing quotation marks and brackets, stops of all scripts, and blanks between Thai letters.
The stack holds what is open; a stop inside a quotation or bracket ends
nothing.  Whether a full stop ends a sentence is decided by a trie of
abbreviations, read backwards from the stop, and by what follows it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table

#: Abbreviations after which a sentence goes on, by language (lower case, without the last stop).
GOES_ON = {
    "en": "dr prof mr mrs ms st vs cf fig figs sec eq eqs ref refs approx pos cols col resp app suppl incl excl min max pp vol chr e.g i.e viz".split(),
    "de": "nr abb vgl bzgl bzw evtl ggf ca inkl exkl abschn tab bspw fr hr z.b d.h sog kap".split(),
    "fr": "env p.ex c.-à-d chap mlle mm n°".split(),
    "es": "sr sra srta dra aprox núm pág págs p.ej ej".split(),
    "ru": "см рис ок хр напр стр табл ср им ул т.е т.н д-р проф гл".split(),
    "hi": "डॉ श्री प्रो कु".split(),
    "ar": "د أ".split(),
}
#: Abbreviations that stand before a number; otherwise they are words.
BEFORE_NUMBERS = "no nos art cap bd abs jan feb mar apr jun jul aug sep sept oct nov dec".split()
#: Abbreviations that may also be the last word of a sentence.
MAY_END = "etc usw al f ff г гг т.д т.п др пр inc ltd co jr a.m p.m u.a".split()
#: Words before the number of a German ordinal.
ARTICLES = set("der die das dem den des am im vom zum zur beim ab bis seit".split())
#: Fixed value: German months, which follow ordinals.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: One-letter words that go on with a sentence after a quotation.
SMALL_WORDS = set("y e o u a à и а в с к о у")
#: What goes on with a sentence right after a Chinese or Japanese quotation.
CJK_GOES_ON = ("然后", "说", "問", "问", "的", "地", "并", "と", "って", "という", "の", "を", "は", "が", "に", "も", "で", "、", "，", ",")

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“", "‘": "’", '"': '"', "'": "'"}
#: Characters before a full stop that are looked at for an abbreviation (more than twice the longest) and for the article of an ordinal.
ABBREVIATION, LOOK_BACK = 16, 48
BRACKETS = set("([{（［【")
CLOSERS = set(PAIRS.values()) | {"”"}
STOPS = ".!?。！？．｡।॥؟…"
HARD = "!?。！？．｡।॥؟"

_EVENT = regex.compile(rf"[{STOPS}]+|[{regex.escape(''.join(PAIRS) + ''.join(CLOSERS))}]|(?<=\p{{Thai}})[^\S\r\n]+(?=\p{{Thai}})")
_BREAK = regex.compile(r"\r\n?|\n")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_UNCASED = regex.compile(r"[\p{Devanagari}\p{Arabic}\p{Thai}]")
_WORD = regex.compile(r"\S+")
_DROP = {0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None}


def blank(c: str) -> bool:
    return c.isspace() or c == "﻿"


class Trie:
    """Abbreviations by their letters from the last to the first."""

    def __init__(self, kinds: dict[str, list[str]]):
        self.root: dict = {}
        for kind, words in kinds.items():
            for word in words:
                node = self.root
                for c in reversed(word):
                    node = node.setdefault(c, {})
                node[""] = kind

    def kind(self, before: str) -> str | None:
        """The kind of the longest abbreviation at the end of ``before`` that begins at the start of a word."""
        node, found = self.root, None
        for k in range(len(before) - 1, -1, -1):
            node = node.get(before[k])
            if node is None:
                break
            if "" in node and (k == 0 or not (before[k - 1].isalnum() or before[k - 1] in ".-_")):
                found = node[""]
        return found


TRIE = Trie({"on": [w for words in GOES_ON.values() for w in words], "number": BEFORE_NUMBERS, "may": MAY_END})


def _next(text: str, at: int, end: int) -> int:
    while at < end and blank(text[at]):
        at += 1
    return at


def _starts(text: str, at: int, end: int) -> bool:
    """Whether what begins at ``at`` looks like the start of a sentence."""
    c = text[at]
    if not c.islower():
        return c not in ",;:)]}»”’—–-"
    word = _WORD.match(text, at, end).group()
    if len(word) == 1:
        return word not in SMALL_WORDS
    core = word.split(".")[0].strip(",;:!?'\"()[]«»“”‘’") or word
    return any(x.isupper() for x in core[1:]) or any(x in "$_=<[" for x in core) or (core[0].isascii() and any(x.isdigit() for x in core))


def _full_stop(text: str, start: int, dot: int, after: int, end: int) -> bool:
    """Whether the full stops at ``dot`` up to ``after``, outside of quotations, end the sentence begun at ``start``."""
    follow = _next(text, after, end)
    if follow >= end:
        return True
    glued = follow == after
    c = text[follow]
    prev = text[dot - 1] if dot > start else " "
    if after - dot > 1 or text[dot] == "…":  # an ellipsis
        return not glued and _starts(text, follow, end) or bool(_CJK.match(c))
    if glued:
        if not c.isupper() or not (prev.isalnum() or prev in ")]»”\"'’"):
            return bool(_CJK.match(c)) and not prev.isdigit()
        nxt = text[follow + 1] if follow + 1 < end else " "
        if not (nxt.islower() or nxt.isspace() or unicodedata.category(nxt)[0] == "M"):
            return False
    if blank(prev):  # ".016", or a French stop after a blank
        return not glued and not c.isdigit()
    tail = text[max(start, dot - ABBREVIATION) : dot]
    if "\xad" in tail or not tail.isascii():
        tail = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", tail).translate(_DROP))
    tail = tail.lower()
    kind = TRIE.kind(tail) or ("." in tail and TRIE.kind(regex.sub(r"\.\s+", ".", tail)) or None)  # "z.B" as well as "z. B"
    if kind == "on":
        return False
    if kind == "number":
        return not c.isdigit()
    cut = max(tail.rfind(x) for x in (" ", "\n", "\t", "(", "\xa0", " ", " "))
    last = tail[cut + 1 :]
    if kind == "may":
        return not glued and _starts(text, follow, end)
    letters = [x for x in last.split(".")]
    if last and all(len(x) == 1 and x.isalpha() for x in letters):
        if len(letters) > 1:  # U.V.
            return not glued and _starts(text, follow, end) and not text[follow].isdigit()
        return bool(_CJK.match(last))  # an initial or a piece of an abbreviation
    if last.isdigit() and len(last) <= 2 and not glued:
        word = _WORD.match(text, follow, end).group().strip(".,;:!?").lower()
        before = text[max(start, dot - LOOK_BACK) : dot - len(last)].split()
        if word in MONTHS or before and before[-1].lower() in ARTICLES:
            return False
    return True


def _after_closer(text: str, at: int, end: int) -> bool:
    """Whether a sentence ends at ``at``, behind a quotation or bracket that ended with a stop."""
    follow = _next(text, at, end)
    if follow >= end:
        return True
    if _CJK.match(text[follow]) or text[follow] in "、，":
        return not text.startswith(CJK_GOES_ON, follow)
    if _UNCASED.match(text[follow]):
        return False
    if text[follow] in STOPS:
        return False
    if follow == at and not (text[follow].isupper() or text[follow].isdigit() or text[follow] in PAIRS):
        return False
    return _starts(text, follow, end)


def _pairs(text: str, events: list, end: int) -> dict[int, int]:
    """For each opening mark that is closed again, and for its closing mark, the place of the other."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # closing mark -> heights of the stack at which it is waited for, so that no mark searches the stack
    for m in events:
        c, at = m.group(), m.start()
        if c[0] in STOPS or blank(c[0]):
            continue
        before = text[at - 1] if at else " "
        after = text[at + 1] if at + 1 < end else " "
        if c in "'’" and before.isalnum() and after.isalnum():
            continue  # an apostrophe
        k = max((waiting[w][-1] for w in (c, "“" if c == "”" else c) if waiting.get(w)), default=-1)
        if k >= 0:
            out[at], out[stack[k][1]] = stack[k][1], at
            while len(stack) > k:
                waiting[stack.pop()[0]].pop()
        elif c in PAIRS and not (c == "'" and (before.isalnum() or blank(after))):
            waiting.setdefault(PAIRS[c], []).append(len(stack))
            stack.append((PAIRS[c], at))
    return out


def _block(text: str, start: int, end: int, out: list[tuple[int, int]]) -> None:
    """Sentences of ``text[start:end]``, which has no blank line and no list line."""
    events = list(_EVENT.finditer(text, start, end))
    pairs = _pairs(text, events, end)
    begin, depth, opened = start, 0, start

    def close(at: int) -> None:
        nonlocal begin
        a, b = begin, at
        while a < b and blank(text[a]):
            a += 1
        while b > a and blank(text[b - 1]):
            b -= 1
        if a < b:
            out.append((a, b))
        begin = at

    for m in events:
        at, after = m.span()
        c = text[at]
        if at < begin:
            continue
        if c in STOPS:
            if depth:
                continue
            if text[at:after].strip(".…"):  # holds more than full stops
                ends = after >= end or blank(text[after]) or text[at:after].strip(".…!?؟") != "" or not text[after].islower() and text[after] not in ",;:/="
                if set(text[at:after]) == {"．"} and text[at - 1 : at].isdigit() and text[after : after + 1].isdigit():
                    ends = False
            else:
                ends = _full_stop(text, begin, at, after, end)
            if ends:
                while after < end and text[after] in CLOSERS and after not in pairs:
                    after += 1
                close(after)
        elif blank(c):
            if not depth:
                close(after)
        elif at in pairs:
            if pairs[at] > at:
                if not depth:
                    opened = at
                depth += 1
            else:
                depth -= 1
                if depth:
                    continue
                inner = at - 1
                while inner > opened and blank(text[inner]):
                    inner -= 1
                if text[inner] in STOPS and not (text[opened] in BRACKETS and _next(text, begin, opened) < opened):
                    if _after_closer(text, after, end):
                        close(after)
    close(end)


def split(text: str | None) -> list[tuple[int, int]]:
    """Start and end offsets of the sentences of ``text``, in order; see :func:`sentences`."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    begin: int | None = None  # of the running block
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at)
        stop, after = m.span() if m else (len(text), len(text))
        first = _next(text, at, stop)
        if first >= stop or text.startswith("- ", first):
            if begin is not None:
                _block(text, begin, at, out)
                begin = None
            if first < stop:
                last = stop
                while blank(text[last - 1]):
                    last -= 1
                out.append((first, last))
        elif begin is None:
            begin = at
        at = after
    if begin is not None:
        _block(text, begin, len(text), out)
    return out


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, sent_no, start_off and end_off of every sentence of every text, in one pass without a shuffle.

    Sentences are numbered from 1; offsets count code points from 0, the end is
    exclusive, and blanks or a byte order mark around a sentence are left out.
    A blank line ends a sentence; a single line break does not; a line that
    begins with ``- `` is one sentence.  Null, empty and blank texts have none.
    Texts of any length are read whole, in time in proportion to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, number, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(split(t), 1):
                    where.append(i)
                    number.append(k)
                    starts.append(a)
                    ends.append(b)
            columns = [batch.column(0).take(pa.array(where, pa.int64())), *[pa.array(x, pa.int32()) for x in (number, starts, ends)]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "sent_no", "start_off", "end_off"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, sent_no int, start_off int, end_off int")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Every sentence of every document."""
    return sentences(table(spark, root, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found}

SQL: dict[str, str] = {}
