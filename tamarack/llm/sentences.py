"""Sentence boundaries across languages and scripts, by cascading rule tables.

A table is a list of rules ``(break or not, what stands before, what stands after)``; the tables of
a language are read in order and the first rule that matches a position decides it. Positions are
those behind a run of sentence marks and its closing marks, and in Thai also blanks. A blank line
always ends a unit. Before the tables come the ranges of quotations and brackets: where the
sentence goes on behind the closing mark, nothing inside breaks.

The language of a paragraph is read off its letters, and among languages in Latin letters off
their commonest words; tags are not needed, as they may be wrong.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarack.plans.scale import ship_code, spread

BREAK, KEEP = True, False
Rule = tuple[bool, str, str]

# -- marks -------------------------------------------------------------------------------------
MARKS = ".!?…‼⁇⁈⁉。！？｡．؟۔।॥։።፧፨။។៕"
GREEK_QUESTION = ";;"
OPENING = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "(": ")", "（": "）", "[": "]"}
CLOSING = "”»›」』》〉】)）]"
BLANK = r"[^\S\n\r\x0b\x0c\x85  ]"
LINE = r"(?:\r\n|[\n\r\x0b\x0c\x85  ])"
END = r"[”“»›」』》〉】)）\]\"'’]"  # what may close behind a mark
CLOSED = rf"(?:{BLANK}?{END})*"
OPENED = r"[“„«‹「『《〈【(（\[\"'‘¿¡]"


# -- tables ------------------------------------------------------------------------------------
def _words(words: str, after: str) -> Rule:
    """Abbreviations that end no unit when ``after`` or, without a blank, a letter follows."""
    return (KEEP, r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True)) + r")\.", rf"(?:{after}|\p{{L}})")


NEXT, NUMBER, NAME = r"\s", r"\s+[\p{N}(]", rf"\s+{OPENED}?\p{{Lu}}"

FIRST: list[Rule] = [
    (KEEP, rf"(?<![!?‼⁇⁈⁉。！？｡؟।॥])(?:[.．]{{2,}}|[.．]*…[.…]*){CLOSED}", ""),  # an ellipsis alone
    (KEEP, r"\A\s*[\p{N}]{1,4}\.", NEXT),  # the number of a heading or list item
    (KEEP, r"", rf"{BLANK}?[{CLOSING}]"),  # the closing mark still comes
    (KEEP, r"", rf"[{MARKS},;:]"),
]
CASED: list[Rule] = [
    (KEEP, r"", rf"\s+{OPENED}*\p{{Ll}}"),
    (KEEP, rf"{END}", r"\s*[-–—]"),
    (KEEP, r"", r"\s+[–—]\s*\p{Ll}"),
    (KEEP, r"(?<![\p{L}\p{M}\p{N}])(?:\p{Lu}\.-?)*\p{Lu}\.", NAME),  # initials
]
#: Common abbreviations of each language.
EN = [
    _words("Dr Mr Mrs Ms Messrs Prof Rev Hon St Mt Ft Gen Col Capt Lt Sgt Cmdr Gov Sen Rep Pres Supt", NAME),
    _words("No Nos Fig Figs Sec Secs Vol Vols Ch Chap Art Eq Ref Pt App approx ca p pp", NUMBER),
    _words("cf vs viz e.g i.e resp", NEXT),
]
DE = [
    _words("Dr Prof Hr Hrn Fr Frl Fa St Dipl Ing Mag Gebr Hl", NAME),
    _words("Nr Nrn gem S Abs Abb Art Bd Kap Tab Ziff Anm Z Jg ca bzw vgl lt zzgl inkl max min Tel Str str", rf"\s+(?:{OPENED}|\p{{N}}|\p{{Lu}})"),
    (KEEP, r"(?<!\p{L})(?:z|d|u|i|o|s)\.", r"\s*\p{L}{1,2}\."),  # the first half of z. B., u. a.
    (KEEP, r"(?<!\p{L})(?:z\.\s?B|d\.\s?h|z\.\s?T|i\.\s?d\.\s?R|s\.\s?o|s\.\s?u)\.", NEXT),
    (BREAK, r"(?<!\p{N})\p{N}{1,2}\.\s?\p{N}{1,2}\.", NAME),  # a date of day and month
    (KEEP, r"(?<![\p{N}.,:])\p{N}{1,3}\.", r"\s+[\p{L}\p{N}]"),  # an ordinal
]
FR = [
    _words("M MM Mme Mmes Mlle Mlles Dr Pr Me Mgr St Ste av bd Bd Av", NAME),
    _words("p pp chap art env n no nos vol fig éd t cf §", NUMBER),
    _words("cf p.ex c.-à-d", NEXT),
    (KEEP, r"(?<!\p{L})p\.", r"\s*ex\."),
    (KEEP, r"(?<!\p{L})p\.\s?ex\.", NEXT),
]
ES = [
    _words("Sr Sra Srta Sres Sras Dr Dra Dres D Dña Ud Uds Avda Av C Ing Lic Prof Profa Sto Sta Mons Gral", NAME),
    _words("núm núms pág págs art arts aprox cap vol fig n.º no p pp", NUMBER),
    (KEEP, r"(?<!\p{L})p\.", r"\s*ej\."),
    (KEEP, r"(?<!\p{L})p\.\s?ej\.", NEXT),
    (KEEP, r"(?<!\p{L})EE\.", r"\s*UU\."),
]
RU = [
    (BREAK, r"\p{N}\s*(?:гг?|вв?)\.", NAME),
    _words("ул инж проф акад доц г пр-т просп пер наб пл им гр тов д-р св о", NAME),
    _words("п пп д стр с см рис гл ст табл кв оф т тт кн № ок", NUMBER),
    _words("т.е т.к напр см ср", NEXT),
    (KEEP, r"(?<!\p{L})т\.", r"\s*[екдпн]\."),
    (KEEP, r"(?<!\p{L})т\.\s?[ек]\.", NEXT),
]
EL = [
    _words("κ κα κ.κ Δρ δρ καθ Αγ αγ", NAME),
    _words("σελ αρ άρθ περ κεφ εικ τόμ τ παρ", NUMBER),
    _words("π.χ δηλ βλ πρβλ λ.χ", NEXT),
]
ARABIC = [
    (KEEP, r"(?<![\p{L}\p{M}\p{N}])\p{Arabic}\.", NEXT),  # a single letter
]
HINDI: list[Rule] = [
    (KEEP, r"\.", NEXT),  # a point shortens words; the danda ends sentences
]
WIDE: list[Rule] = [
    (BREAK, rf"[。！？｡]+[.!?…]*{CLOSED}", ""),
    (BREAK, rf"[!?‼⁇⁈⁉]+{CLOSED}", r"\s|\p{Han}|\p{Hiragana}|\p{Katakana}"),
    (BREAK, rf"[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]\.{CLOSED}", r"\s"),
    (KEEP, "", ""),
]
THAI: list[Rule] = [
    (BREAK, rf"\p{{Thai}}{BLANK}+", r"\p{Thai}"),
    (BREAK, rf"[!?]+{CLOSED}", r"\s|\p{Thai}"),
    (BREAK, rf"[。！？।]+{CLOSED}", ""),
    (KEEP, "", ""),
]
LAST: list[Rule] = [
    (BREAK, rf"[。！？｡]+[.!?…]*{CLOSED}", ""),
    (BREAK, rf"[؟۔।॥።፧፨။។៕]+{CLOSED}", r"\p{L}"),  # the blank is missing, or the script has none
    (BREAK, rf"\p{{L}}\p{{Ll}}[.!?։]+{CLOSED}", rf"{OPENED}?\p{{Lu}}[\p{{Ll}}'’]"),  # the blank is missing
    (BREAK, "", r"\s"),
    (KEEP, "", ""),
]
LATIN = {"en": EN, "de": DE, "fr": FR, "es": ES}
#: Function words of each language, as stop word lists have them.
COMMON = {
    "en": "i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been have has had do does did doesn't don't a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very can will just should now since near said",
    "de": "aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dem den der des die dies dieser doch dort du durch ein eine einem einen einer er es für gegen hat hatte hier hinter ich ihr im in ist ja jede jetzt kann kein keine mit nach nicht noch nun nur ob oder ohne seit sehr sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wieder wird während zu zum zur sagte",
    "fr": "au aux avec ce ces cette dans de des du elle elles en est et il ils je la le les leur lui mais même ne nos notre nous on ou où par pas pour plus qu que qui sa sans se ses son sont sous sur te toi ton tu un une vers vos votre vous c d j l à m n s t y été être avant après depuis pendant chez dit",
    "es": "al algo ante antes aquí así aunque como con contra cuando de del desde donde durante el él ella ellos en entre era es esa ese eso esta este esto está fue ha hasta hay hoy la las le les lo los más me mi muy nada ni no nos o otra otro para pero poco por porque que quien se sea ser si sí sin sobre son su sus también tan tiene todo tras un una y ya yo cerca dijo",
}
CASCADES: dict[str, list[Rule]] = {
    **{k: FIRST + CASED + v + LAST for k, v in LATIN.items()},
    "ru": FIRST + CASED + RU + LAST,
    "el": FIRST + CASED + EL + LAST,
    "ar": FIRST + ARABIC + LAST,
    "hi": FIRST + HINDI + LAST,
    "th": FIRST[:1] + FIRST[2:] + THAI,
    "wide": FIRST + WIDE,
    "other": FIRST + CASED + LAST,
    "uncased": FIRST + LAST,
}
CASELESS = {"ar", "hi", "wide", "th", "uncased"}
#: Words of a paragraph in Latin letters from which on it must have a common one, else no language's abbreviations hold.
WORDS = 12
SCRIPTS = {"wide": r"[\p{Han}\p{Hiragana}\p{Katakana}]", "th": r"\p{Thai}", "hi": r"\p{Devanagari}", "ar": r"\p{Arabic}", "ru": r"\p{Cyrillic}", "el": r"\p{Greek}"}


@cache
def _cascade(language: str) -> tuple[re.Pattern, list[bool]]:
    """All rules of a language as one alternation: the number of the group that took part is the rule's."""
    rules = CASCADES[language]
    return re.compile("|".join(f"(?<={before})(?={after})()" if before else f"(?={after})()" for _, before, after in rules)), [b for b, _, _ in rules]


@cache
def _positions(language: str) -> re.Pattern:
    marks = f"[{re.escape(MARKS + (GREEK_QUESTION if language == 'el' else ''))}]+"
    return re.compile(marks + (rf"|(?<=\p{{Thai}}){BLANK}+(?=\p{{Thai}})" if language == "th" else ""))


_script = {k: re.compile(v + "+") for k, v in SCRIPTS.items()}
_latin, _beyond_latin = re.compile(r"\p{Latin}+"), re.compile("[Ͱ-\U0010ffff--[Ḁ-↏]]", re.V1)
_letters, _small = re.compile(r"\p{L}+"), re.compile(r"(?!\p{Latin})\p{Ll}")
_word = re.compile(r"\p{L}+(?:'t)?")
_common = {k: frozenset(v.split()) for k, v in COMMON.items()}
_space, _line = re.compile(r"\s+"), re.compile(LINE)
_pair = re.compile("[" + re.escape("".join(OPENING) + CLOSING) + '"]')
_goes_on = re.compile(rf"{BLANK}*(?:{LINE}{BLANK}*)?(?:\p{{Ll}}|[-–—,;:])|[{re.escape(MARKS)}]")
_goes_on_caseless = re.compile(rf"{BLANK}*(?:{LINE}{BLANK}*)?(?:[\p{{L}}\p{{N}}]|[-–—,،、，;؛；:：])|[{re.escape(MARKS)}]")


def language_of(text: str) -> str:
    """The table for a paragraph: a language, ``wide`` for Chinese and Japanese, ``uncased`` for other scripts without small letters, or ``other``."""
    if _beyond_latin.search(text):
        counts = {k: sum(map(len, p.findall(text))) for k, p in _script.items()}
        rest = sum(map(len, _letters.findall(text))) - sum(counts.values())
        latin = sum(map(len, _latin.findall(text)))
        best = max(counts, key=counts.__getitem__)
        if rest - latin > max(counts[best], latin):
            return "other" if _small.search(text) else "uncased"
        # a sign of a syllable or word weighs about three letters
        if counts[best] * (3 if best == "wide" else 1) > latin:
            return best
    words = [w.lower() for w in _word.findall(text)]
    scores = {k: sum(w in common for w in words) for k, common in _common.items()}
    best = max(scores, key=scores.__getitem__)
    return best if scores[best] else "en" if len(words) < WORDS else "other"


#: Marks that a mark may close.
_closes = {c: [o for o, of in OPENING.items() if c in of] for c in CLOSING + "“"} | {'"': ['"']}


def _spans(text: str, caseless: bool) -> tuple[set[int], list[tuple[int, int]]]:
    """Places of closing marks, and ranges inside which nothing breaks, ascending and apart.

    A mark closes the last open one of its kind and drops what was opened since. Every mark is opened and
    dropped once, so a text of nothing but marks takes linear time.
    """
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # per opening mark, where it is in the stack
    closing: set[int] = set()
    kept: list[tuple[int, int]] = []
    goes_on = _goes_on_caseless if caseless else _goes_on
    for m in _pair.finditer(text):
        c, i = m.group(), m.start()
        if c == '"':
            is_closing = bool(places.get('"'))
        elif c == "“":
            is_closing = bool(stack) and stack[-1][0] == "„"
        else:
            is_closing = c in CLOSING
        if not is_closing:
            places.setdefault(c, []).append(len(stack))
            stack.append((c, i))
            continue
        k = max((places[o][-1] for o in _closes[c] if places.get(o)), default=-1)
        if k < 0:
            continue
        closing.add(i)
        opened = stack[k][1]
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        if goes_on.match(text, i + 1):
            while kept and kept[-1][0] > opened:
                kept.pop()
            kept.append((opened, i + 1))
    return closing, kept


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    start = 0
    for m in _space.finditer(text):
        if len(_line.findall(m.group())) >= 2:
            yield start, m.start()
            start = m.end()
    yield start, len(text)


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def sentences(text: str | None) -> list[tuple[int, int]]:
    """``(start, end)`` of each unit in code points, the end exclusive; none for null and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for start, end in _paragraphs(text):
        start, end = _trim(text, start, end)
        if start == end:
            continue
        paragraph = text[start:end]  # so that the rules' \A is its beginning
        language = language_of(paragraph)
        rules, breaks = _cascade(language)
        closing, kept = _spans(paragraph, language in CASELESS)
        begins = [a for a, _ in kept]
        from_ = 0
        for m in _positions(language).finditer(paragraph):
            at = m.end()
            while True:  # closing marks, also behind a blank
                if at in closing or (at < len(paragraph) and paragraph[at] in "'’\"" and not m.group().isspace()):
                    at += 1
                elif at + 1 in closing and paragraph[at].isspace() and paragraph[at + 1] in "»›":
                    at += 2
                else:
                    break
            if at >= len(paragraph) or at <= from_:
                continue
            k = bisect_right(begins, at - 1) - 1
            if k >= 0 and at <= kept[k][1]:
                continue
            if breaks[rules.match(paragraph, at).lastindex - 1]:
                a, b = _trim(paragraph, from_, at)
                if a < b:
                    out.append((start + a, start + b))
                from_ = at
        a, b = _trim(paragraph, from_, len(paragraph))
        if a < b:
            out.append((start + a, start + b))
    return out


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, start_char, end_char)``, one row per sentence unit of each row's text."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                for s, e in sentences(x):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "start_char", "end_char"])

    rows = spread(df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")))
    schema = T.StructType([rows.schema["key"], T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
