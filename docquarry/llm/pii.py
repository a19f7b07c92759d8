"""Personal data: exact base patterns plus deobfuscation that keeps offsets.

The base patterns find plain e-mail addresses, IPv4 addresses, card and phone
numbers.  Transducers then rewrite disguises - look-alike and invisible
characters, spelled digits, "at" and "dot" in words or brackets - while keeping
for every rewritten character the source characters it stands for; identifiers
found in the rewritten text are projected back to source spans.

Offsets count code points, ends are exclusive.  A null or empty text has no
spans.  Work and memory grow in proportion to the text: no pattern can scan a
run of characters more than a few times.  A rewritten finding that lies inside a
plain one of its kind, or a spelled number that holds a plain one, is not reported again.

What a disguise may look like, beside what the names of the host allow (63 characters of a label, 64 before the
at): an address in words has up to 16 parts on each side; numbers without a plus have 7 to 15
digits, or 12 to 19 that pass Luhn's test, with a spelled one among them, and don't just count up or down.  Words
for both the at and a dot are an address whatever its ending but a plain English word; a plain "at" before
a plain host is one only after a word for mail or where what precedes it is no word of letters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import prepare_workers

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An address starts where a run of digits does, so runs that begin none are passed over whole.
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return text.replace(" ", "").replace("-", "").replace("(", "").replace(")", "").replace(".", "").replace("+", "")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            found.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# -- transducers --


@dataclass
class Aligned:
    """Rewritten text; begin[i] and end[i] bound the source of its character i."""

    text: str
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Aligned:
        places = np.arange(len(text) + 1)
        return cls(text, places[:-1], places[1:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.begin[start]), int(self.end[end - 1])

    def rewrite(self, pattern: re.Pattern, put) -> Aligned:
        """Replaces matches; put(match) gives the new text or None to leave it."""
        texts, begins, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = put(m)
            if new is None or m.start() == m.end():
                continue
            texts += [self.text[done : m.start()], new]
            begins += [self.begin[done : m.start()], np.full(len(new), self.begin[m.start()])]
            ends += [self.end[done : m.start()], np.full(len(new), self.end[m.end() - 1])]
            done = m.end()
        if not done:
            return self
        return Aligned("".join([*texts, self.text[done:]]), np.concatenate([*begins, self.begin[done:]]), np.concatenate([*ends, self.end[done:]]))


def _glyphs() -> dict[str, str]:
    """Look-alikes of ASCII letters, digits and marks, one character each."""
    table = dict(zip("аеорсухіјѕһԁԛԝгкмтвнАВЕКМНОРСТУХІЈЅԌ", "aeopcyxijshdqwrkmtbhABEKMHOPCTYXIJSG", strict=True))
    table |= dict(zip("αοενικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoevikptuxABEZHIKMNOPTYX", strict=True))
    table |= {"＠": "@", "﹫": "@", "．": ".", "。": ".", "｡": ".", "․": ".", "‚": ",", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "－": "-", "（": "(", "）": ")", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
    for code in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x24B6, 0x24EA)]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            table[chr(code)] = plain
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50):
        table |= {chr(zero + k): str(k) for k in range(10)}
    return table


GLYPHS = _glyphs()
_INVISIBLE = "​‌‍⁠﻿­᠎"
_GLYPH = re.compile("[" + re.escape("".join(GLYPHS)) + _INVISIBLE + "]")

_GLYPH_CHARS = frozenset(GLYPHS) | frozenset(_INVISIBLE)

DIGIT_WORDS = {
    w: str(k)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, w in enumerate(words.split())
} | {"oh": "0", "nought": "0", "zwo": "2", "eight": "8"}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_ITEM = rf"(?:\b{_WORD}\b|[0-9]+)"
# Runs of spelled and written digits; the look-ahead makes most words fail at once.
_SPELLED = re.compile(rf"(?:(?:\+|\bplus\b)[ ]?)?(?<![^\W_]){_ITEM}(?:[ ,.()/\n-]{{1,3}}(?:(?:dash|hyphen|tiret|guion|bindestrich)[ ]{{1,3}})?{_ITEM})++", re.I)
_FIGURES = re.compile(r"[0-9]")
_BREAKS = str.maketrans(dict.fromkeys(",.()/-+\n\t", " "))
_TLD = r"(?:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|de|fr|es|uk|us|eu|ch|at|it|nl|ru|example|test)"
#: Endings of countries that are no words of the four languages.
_COUNTRY = "(?:" + "|".join("ac ae af ag ao aq ar ax az ba bb bd bf bg bh bi bj bm bn br bs bt bw bz ca cc cd cf cg ck cl cm cn cr cu cv cw cx cy cz dj dk dm dz ec ee eg er et fi fj fk fm fo ga gb gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hm hn hr ht hu id ie il iq ir je jm jo jp ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lv ly mc md mg mh mk ml mm mn mo mp mq mr ms mt mv mw mx mz nc nf ng ni np nr nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa ro rs rw sb sc sd sg sh si sj sk sl sm sn sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tw tz ua ug uy uz va vc vg vi vn vu wf ws ye yt za zm zw".split()) + ")"
#: Words before "dot" in a sentence that are no host: "look at the dot there".
_NO_HOST = frozenset("a an the this that these those which what any some each every one no another my your his her its our their".split())
#: Endings that are words of a sentence and of no host: "meet me at noon dot the".
_NO_ENDING = _NO_HOST | frozenset("and of or but with from was were then than when where who how not all one two".split())
#: Words before the at that stand for no mailbox, and words that announce one.
_NO_BOX = frozenset("me us him her them you it he she we they him one all look shop buy was were is are be been meet work works worked live lives lived stay stays stayed only out up down back now then there here not and or".split())
_MAIL_CUE = re.compile(r"(?:e-?mails?|mail|mailto|mailbox|address|adresse|correo|courriel|contact|kontakt|contacto|contacter|contacte)[ \t]*[: \t](?:(?:is|at|me|us|to|est|ist|es)[ \t]*[: \t])?[ \t]*$", re.I)
_AT_WORD, _DOT_WORD = "(?:at|arroba|arobase|klammeraffe)", "(?:dot|punkt|point|punto|period)"
_BRACKET_AT = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:{_AT_WORD}|@)[ \t]*[\])}}>][ \t]*|[ \t]*[_*-]+{_AT_WORD}[_*-]+[ \t]*", re.I)
_BRACKET_DOT = re.compile(rf"[ \t]*[\[({{<][ \t]*(?:{_DOT_WORD}|\.)[ \t]*[\])}}>][ \t]*|[ \t]*[_*-]+{_DOT_WORD}[_*-]+[ \t]*", re.I)
_SPACED_AT = re.compile(r"[ \t]+@[ \t]*|[ \t]*@[ \t]+")
# "name at host dot tld": the whole shape is asked for, words alone mean nothing.
_WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}}+(?:[ \t]+{_DOT_WORD}[ \t]+[A-Za-z0-9_%+-]{{1,64}}+){{0,15}})(?:[ \t]+{_AT_WORD}[ \t]+|@)([A-Za-z0-9-]{{1,63}}+)((?:(?:[ \t]+{_DOT_WORD}[ \t]+|\.)[A-Za-z0-9-]{{1,63}}+){{1,15}})(?![A-Za-z0-9-])", re.I)
_DOT_SPLIT = re.compile(rf"[ \t]+{_DOT_WORD}[ \t]+", re.I)
_ENDS_IN_TLD = re.compile(rf"(?:\.|[ \t])(?:{_TLD}|{_COUNTRY})$", re.I)
_ENDING = re.compile(r"(?:\.|[ \t])[a-z]{2,24}$", re.I)
_PLAIN_AT = re.compile(r"[ \t]at[ \t]", re.I)
_POINT = re.compile(r"[ \t](?:point|punto|period)[ \t]", re.I)
# "192 dot 168 dot 1 dot 10", each number in figures or in spelled digits
_ONE = rf"(?:\b{_WORD}\b|[0-9](?![0-9]))"
_GROUP = rf"[0-9]++|{_ONE}(?:[ -]{_ONE}){{0,2}}+"
_WORDED_IP = re.compile(rf"(?<![^\W_])(?:{_GROUP})(?:(?:[ \t]+{_DOT_WORD}[ \t]+|[ \t]*\.[ \t]*)(?:{_GROUP})){{3}}(?![^\W_])", re.I)
_WORDED_DOT = re.compile(rf"(?<=[0-9])[ \t]+{_DOT_WORD}[ \t]+(?=[0-9])", re.I)
_HINTS = tuple("dot punkt point punto period".split())
_AT_HINTS = ("[.]", "(.)", "{.}", "<.>", "[ . ]", "( . )", "[at]", "(at)", "{at}", "<at>", "[@]", "(@)", "arroba", "arobase", "klammeraffe", "_at_", "-at-", "*at*", "[ at ]", "( at )", "{ at }", " @", "@ ")


_RUN_ITEM = re.compile(r"\+|(?!(?:dash|hyphen|tiret|guion|bindestrich)\b)[^\W\d_]+|[0-9]+", re.I)
_DATE = re.compile(r"(?:[0-9]{4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ][0-9]{4}|(?:(?:1[0-9]|20)[0-9]{2}[-/. ,()]*)+)")
#: Separators that two numbers stand between, strongest first.
_BETWEEN = (re.compile(r"\n"), re.compile(r"[,/]"), re.compile(r"[^+].*", re.S))


def _digits_of(run: str) -> str | None:
    words = [w for w in re.findall(r"[^\W\d_]+|[0-9]+", run.lower()) if w in DIGIT_WORDS or w.isdigit() or w == "plus"]
    spelled = [w for w in words if w in DIGIT_WORDS]
    digits = "".join(DIGIT_WORDS.get(w, w if w.isdigit() else "") for w in words)
    if not spelled or len(set(spelled)) < 2 and (len(spelled) == len(words) or len(set(digits)) < 2):
        return None
    if len(spelled) < 3:  # written digits mostly: one line without commas, and no date beside a word
        written = re.sub(r"[^\W\d_]+", "", run).strip(" ,.()/-\n")
        if re.search(r"[,\n]", run) or "sept" in spelled or _DATE.fullmatch(written):
            return None
    return ("+" if run.lstrip()[:1] == "+" or words[0] == "plus" else "") + digits


def _counts(digits: str) -> bool:
    """Whether the digits only count up or down by one."""
    steps = {int(b) - int(a) for a, b in zip(digits, digits[1:], strict=False)}
    return steps in ({1}, {-1})


def _kind_of(digits: str) -> int | None:
    n = len(digits.lstrip("+"))
    if digits[0] != "+" and _counts(digits):
        return None
    if 12 <= n <= 19 and digits[0] != "+" and luhn(digits):
        return 2
    return 3 if 7 <= n <= 15 else None


def _numbers_in(run: str, level: int = 0) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the numbers in a run of digits: the whole if it is one; else its parts
    between line ends, then commas, of which short ones are taken together up to ten digits; over
    nineteen digits without these are cut likewise."""
    digits = _digits_of(run)
    kind = _kind_of(digits) if digits else None
    if kind is not None:
        return [(0, kind, len(run))]
    items = [m for m in _RUN_ITEM.finditer(run) if m[0] != "+" and m[0].lower() != "plus"]
    size = [len(m[0]) if m[0][0].isdigit() else 1 for m in items]
    if sum(size) < 7 or not any(m[0].lower() in DIGIT_WORDS for m in items):
        return []
    while level < len(_BETWEEN):
        if level == 2 and sum(size) < 20:
            return []
        cuts = [k for k in range(1, len(items)) if _BETWEEN[level].search(run[items[k - 1].end() : items[k].start()])]
        if cuts:
            break
        level += 1
    else:
        return []

    def begin(k: int) -> int:
        before = run[items[k - 1].end() if k else 0 : items[k].start()]
        sign = re.search(r"(?:\+|plus) ?$", before, re.I)
        return items[k].start() - (len(sign[0]) if sign else 0)

    found, short = [], []  # short: places, in items, of parts too small to be numbers

    def flush() -> None:
        at, rest = 0, sum(p[2] for p in short)
        while at < len(short):
            upto, n = at, 0
            while upto < len(short) and n < 10:
                n += short[upto][2]
                upto += 1
            rest -= n
            if rest < 7 and n + rest <= 15:
                upto = len(short)
            start, end = begin(short[at][0]), items[short[upto - 1][1] - 1].end()
            digits = _digits_of(run[start:end])
            kind = _kind_of(digits) if digits else None
            if kind is not None:
                found.append((start, kind, end))
            at = upto
        short.clear()

    for a, b in zip([0, *cuts], [*cuts, len(items)], strict=True):
        if sum(size[a:b]) < 7 and level:
            if short and begin(a) < items[a].start():  # a plus begins a number
                flush()
            short.append((a, b, sum(size[a:b])))
            continue
        flush()
        start = begin(a)
        found += [(start + x, kind, start + y) for x, kind, y in _numbers_in(run[start : items[b - 1].end()], level + 1)]
    flush()
    return found


def _spells(low: str) -> bool:
    """Whether a lowered text has digit words enough for a number: two, or one beside figures."""
    seen = sum(w in low for w in DIGIT_WORDS)
    if not seen or (seen == 1 and not _FIGURES.search(low)):
        return False
    seen = len(DIGIT_WORDS.keys() & set(low.translate(_BREAKS).split()))
    return seen > 1 or (seen == 1 and _FIGURES.search(low) is not None)


def _worded(m: re.Match) -> str | None:
    plain_dots, plain_at = "." in m[3] and not _DOT_SPLIT.search(m[3]), "@" in m[0]
    if plain_dots and plain_at:
        return None
    if plain_dots and _PLAIN_AT.search(m[0]):  # nothing but "at" is in words
        if not _ENDS_IN_TLD.search(m[3]) or m[1].lower() in _NO_BOX:
            return None
        if m[1].isalpha() and not _MAIL_CUE.search(m.string, max(0, m.start() - 40), m.start()):
            return None
    elif not plain_at and (m[3].lower().split()[-1].split(".")[-1] in _NO_ENDING or m[1].lower() in _NO_BOX):
        return None
    elif not plain_at and not _ENDS_IN_TLD.search(m[3]):
        # words for both the at and a dot tell enough, but for "at one point in time"
        sentence = _PLAIN_AT.search(m[0]) and (m[2].lower() in _NO_HOST or _POINT.search(m[3]))
        if plain_dots or sentence or not _ENDING.search(m[3]):
            return None
    return _DOT_SPLIT.sub(".", m[1]) + "@" + m[2] + _DOT_SPLIT.sub(".", m[3])


def _worded_ip(m: re.Match) -> str | None:
    """Figures and dots of four numbers; left alone where nothing is in words."""
    if not re.search(r"[^\W\d_]", m[0]):
        return None
    parts = [re.findall(r"[^\W\d_]+|[0-9]+", p) for p in re.split(rf"[ \t]+{_DOT_WORD}[ \t]+|\.", m[0].lower())]
    return ".".join("".join(DIGIT_WORDS.get(w, w) for w in words) for words in parts)


def hidden_spans(text: str) -> list[Span]:
    """Disguised identifiers, as spans of the source text."""
    glyphs = not text.isascii() and not _GLYPH_CHARS.isdisjoint(text)
    low = text.lower()
    at_dot = any(h in low for h in _AT_HINTS) or any(h in low for h in _HINTS)
    spelled = _spells(low)
    # " at " before a host is a disguise only with a known ending
    at_host = " at " in low and re.search(rf" at [a-z0-9-]+\.(?:[a-z0-9-]+\.)*(?:{_TLD}|{_COUNTRY})\b", low) is not None
    if not (glyphs or at_dot or spelled or at_host):
        return []
    aligned = Aligned.of(text)
    if glyphs:
        aligned = aligned.rewrite(_GLYPH, lambda m: GLYPHS.get(m[0], ""))
        # both readings: digit words may hold letters that are look-alikes, or be written with them
        spelled = spelled or _spells(aligned.text.lower())
    if at_dot or at_host or glyphs:
        aligned = aligned.rewrite(_BRACKET_AT, lambda _: "@").rewrite(_BRACKET_DOT, lambda _: ".").rewrite(_WORDED, _worded)
        if "@" in aligned.text and _SPACED_AT.search(aligned.text):
            aligned = aligned.rewrite(re.compile(rf"(?<=[A-Za-z0-9])[ \t]*@[ \t]*(?=[A-Za-z0-9-]+\.(?:[A-Za-z0-9-]+\.)*(?:{_TLD}|{_COUNTRY})\b)", re.I), lambda _: "@")
    if spelled or any(h in aligned.text.lower() for h in _HINTS):
        aligned = aligned.rewrite(_WORDED_IP, _worded_ip).rewrite(_WORDED_DOT, lambda _: ".")
    found: list[Span] = []
    if spelled:
        for m in _SPELLED.finditer(aligned.text):
            for start, kind, end in _numbers_in(m[0]):
                begin, stop = aligned.source(m.start() + start, m.start() + end)
                found.append((begin, kind, stop))
    if aligned.text != text:
        for start, kind, end in base_spans(aligned.text):
            begin, stop = aligned.source(start, end)
            found.append((begin, kind, stop))
    return sorted(set(found))


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: these and the disguised ones."""
    if not text:
        return [], []
    base = base_spans(text)
    hidden = hidden_spans(text)
    if not hidden:
        return base, base
    ends: list[list[int]] = [[], [], [], []]
    starts: list[list[int]] = [[], [], [], []]
    for start, kind, end in base:
        starts[kind].append(start)
        ends[kind].append(end)
    added = []
    for start, kind, end in hidden:
        k = int(np.searchsorted(starts[kind], start, "right")) - 1
        inside = k >= 0 and ends[kind][k] >= end
        first = int(np.searchsorted(starts[kind], start))
        holds = kind >= 2 and first < len(starts[kind]) and ends[kind][first] <= end
        if not inside and not holds:
            added.append((start, kind, end))
    return base, sorted({*base, *added})


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one, named by the first."""
    if not text:
        return text
    parts, done = [], 0
    for start, kind, end in find_spans(text)[1]:
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row."""
    prepare_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text)
                rows.append((*(sum(k == s[1] for s in base) for k in range(4)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced."""
    prepare_workers(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=[str(k) for k in range(batch.num_columns)])

    from pyspark.sql.types import StructField, StructType

    numbered = StructType([StructField(str(k), f.dataType, True) for k, f in enumerate(docs.schema.fields)])
    return docs.mapInArrow(run, numbered).toDF(*docs.columns)
