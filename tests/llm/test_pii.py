import random
import re
import time

import pytest

from docquarry.llm import pii


def brute(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_against_brute_force():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("ab@.1234567890-+ ().2ü") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("so john at example dot com, then", "email", "john at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("x ｊohn＠example．com", "email", "ｊohn＠example．com"),
        ("write peter @ example.com", "email", "peter @ example.com"),
        ("joh​n@example.com", "email", "joh​n@example.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("card " + "four " + "one " * 14 + "one", "card", "four " + "one " * 14 + "one"),
        ("ring +١ ٥٥٥ ٥٥٥ ١٢٣٤", "phone", "+١ ٥٥٥ ٥٥٥ ١٢٣٤"),
    ],
)
def test_disguises(text, kind, hidden):
    base, every = pii.find_spans(text)
    assert set(base) <= set(every)
    assert (text.index(hidden), pii.KINDS.index(kind), text.index(hidden) + len(hidden)) in every
    assert hidden not in pii.redact(text)


@pytest.mark.parametrize("text", ["look at the dot there", "one two three of them", "two at one point, then at a period of time", "meet at noon. Then go", "un un un un un un un un un", "a @ b", "version 1.2.3", "at home.Then we left"])
def test_clean_texts_stay(text):
    assert pii.find_spans(text) == ([], []) and pii.redact(text) == text


def test_long_runs_take_little_time():
    began = time.time()
    for text in ("1" * 200_000, "a" * 200_000, "1 " * 100_000, "one " * 50_000, "@a." * 50_000, "1." * 100_000, "+1" * 50_000):
        pii.find_spans(text)
    assert time.time() - began < 20


def test_scan_and_redact(frame, collected, odd):
    odd = [*odd, "me@x.org and 10.0.0.1"]
    got = collected(pii.scan_documents(frame(odd)))
    assert got[-1]["spans"] == "email:0:8,ip:13:21" and (got[-1]["n_email"], got[-1]["n_ip"], got[-1]["n_card"]) == (1, 1, 0)
    assert got[0]["base_sha256"] == got[1]["base_sha256"] and got[0]["spans"] == ""
    clean = collected(pii.redact_documents(frame(odd)))
    assert [r["text"] for r in clean][:3] == odd[:3] and clean[-1]["text"] == "[EMAIL] and [IP]"
    assert pii.redact_documents(frame([])).count() == 0 and pii.redact_documents(frame(odd)).columns == frame(odd).columns


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("so jane at example dot ca, then", "email", "jane at example dot ca"),
        ("so jan at firma dot pl", "email", "jan at firma dot pl"),
        ("ask ken at firm dot co dot jp now", "email", "ken at firm dot co dot jp"),
        ("ask ann at studio dot photography now", "email", "ann at studio dot photography"),
        ("écris à luc arobase maison point paris vite", "email", "luc arobase maison point paris"),
        ("jan at firma point pl", "email", "jan at firma point pl"),
        ("mail jan at firma.pl today", "email", "jan at firma.pl"),
        ("host 192 dot 168 dot 1 dot 10 is up", "ip", "192 dot 168 dot 1 dot 10"),
        ("host one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("port 12 192 dot 168 dot 1 dot 10 9 times", "ip", "192 dot 168 dot 1 dot 10"),
        ("host 192 dot 168.one dot 10 is up", "ip", "192 dot 168.one dot 10"),
    ],
)
def test_disguises_in_words(text, kind, hidden):
    assert (text.index(hidden), pii.KINDS.index(kind), text.index(hidden) + len(hidden)) in pii.find_spans(text)[1]
    assert hidden not in pii.redact(text)


@pytest.mark.parametrize("text", ["he was at some point in trouble", "water at boiling point of course", "look at this dot there", "one dot two dot three", "300 dot 1 dot 1 dot 1"])
def test_sentences_with_the_same_words_stay(text):
    assert pii.redact(text) == text


PHONE = "five five five one two three four five six seven"
OTHER = "eight zero zero nine one one two two three four"


@pytest.mark.parametrize("between", ["\n", ", ", ",", ",\n", " / "])
def test_spelled_numbers_in_a_list_are_apart(between):
    for numbers in ([PHONE, OTHER], [PHONE, OTHER, "plus " + PHONE], [OTHER] * 7):
        text = "call " + between.join(numbers) + " now"
        want, at = [], 5
        for n in numbers:
            want.append((at, pii.KINDS.index("phone"), at + len(n)))
            at += len(n) + len(between)
        assert pii.find_spans(text)[1] == want


@pytest.mark.parametrize("text", ["ring 555 one two 3 4 5 6 now", "ring 555 123 45 six seven now", "ring fіve fіve fіve оne twо three fоur now", "ring five five five, one two three, four five six seven\nfive five five, one two three, four five six seven now", "ring " + PHONE + " " + OTHER + " now"])
def test_spelled_numbers_leave_no_digit(text):
    assert set(re.sub(r"\[PHONE\]|[\n ]", "", pii.redact(text)[5:-4])) == set() and "[PHONE]" in pii.redact(text)


@pytest.mark.parametrize("text", ["on 2019-10-12 one of them", "in 1999, 2000, 2001, one of them", "12 sept 2019 10.30", "one 2 3"])
def test_words_beside_figures_stay(text):
    assert pii.redact(text) == text


def test_spelled_lists_take_little_time():
    began = time.time()
    for text in ("one two, " * 50_000, "one two\n" * 50_000, "one two " * 50_000, "1, one 2 " * 50_000, "one2 " * 50_000):
        pii.find_spans(text)
    assert time.time() - began < 20


def test_many_zeros_are_a_number():
    text = "0" * 5000 + ".1.1.1"
    assert (0, 1, len(text)) in pii.base_spans(text) and pii.redact(text) == "[IP]"


def planted():
    """Disguised identifiers by kind, each in a sentence, made by rule."""
    r = random.Random(12)
    figures = "zero one two three four five six seven eight nine".split()
    glyph = {"a": "а", "e": "е", "o": "о", "c": "с", "0": "０", "1": "１", "2": "２"}
    wide = lambda t: "".join(glyph.get(c, c) for c in t)
    spell = lambda d: " ".join(figures[int(c)] for c in d)
    for _ in range(60):
        name, host = r.choice(["jane.doe", "kim7", "coolbox", "o_neil"]), r.choice(["example", "corner-shop", "host9"])
        end = r.choice(["com", "pl", "photography", "co.uk", "museum"])
        worded = end.replace(".", " dot ")
        yield from (("email", x) for x in (f"{name} at {host} dot {worded}", f"{name}[at]{host}[dot]{end.replace('.', '[dot]')}", f"{name} (at) {host} (dot) {end.replace('.', ' (dot) ')}", wide(f"{name}@{host}.{end}"), f"{name.replace('.', ' dot ')} AT {host} DOT {worded}", f"{name} _at_ {host}.com"))
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        yield from (("ip", x) for x in ("[.]".join(parts), " dot ".join(parts), "(dot)".join(parts), " [dot] ".join(parts), wide(".".join(parts)), " dot ".join(map(spell, parts)), " [dot] ".join(map(spell, parts))) if any(c in x for c in "[(doсо０１２"))
        digits = "".join(r.choice("0123456789") for _ in range(r.randint(9, 11)))
        yield from (("phone", x) for x in (spell(digits), "plus " + spell(digits), spell(digits[:3]) + " dash " + spell(digits[3:]), spell(digits[:3]) + ", " + spell(digits[3:])))
        card = "4" + "".join(r.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        yield from (("card", x) for x in (spell(card), wide(card) if set(card) & set("012") else spell(card)))


def test_planted_disguises_are_found():
    hits, every = {}, {}
    for kind, hidden in planted():
        text = f"please note: {hidden} ; thanks"
        spans = pii.find_spans(text)[1]
        every[kind] = every.get(kind, 0) + 1
        hits[kind] = hits.get(kind, 0) + any(pii.KINDS[k] == kind and s <= 13 and e >= 13 + len(hidden) for s, k, e in spans)
    assert {k: hits[k] / n for k, n in every.items()} == pytest.approx(dict.fromkeys(every, 1.0)), hits


CLEAN = [
    "count one two three four five six seven", "eight seven six five four three two one lift off", "meet him at amazon.com now", "write to him at gmail.com now",
    "the team at example.com is here", "look at amazon.com or shop at bestbuy.com", "meet me at noon dot the i and go", "we met at one point and at another dot on the map", "version 1 dot 2 dot 3",
    "call 555-123-4567 now", "in 1999 one of nine", "un deux trois", "arrive at 10.30 at station.Then go", "I was at work.com pany", "they live at home dot and away", "at the end of the period we saw a dot",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_set_has_no_hits(text):
    assert pii.find_spans(text) == ([], [])


def test_word_after_a_plain_number_is_not_of_it():
    text = "ring +1 (848) 555-1373 Un jour"
    assert pii.find_spans(text)[1] == [(5, 3, 22)]
