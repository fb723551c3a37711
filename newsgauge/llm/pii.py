"""Personal data behind disguises, found with the offsets of the source text.

A text passes through three small transducers, each a rewriting that keeps for every written character
the source characters it stands for: look-alike, full-width and foreign digits and letters become ASCII
and invisible characters vanish; runs of digits and digit words that hold at least one word become digits, and
the detectors (octets, Luhn, digit counts) decide what they are; "(at)", "[dot]", "name at host dot
com" become @ and dots. Digits, at and dot are read in English, French, German and Spanish. So does "name at host.tld", unless the name is one of the words that stand before "at" in
prose (AT_PROSE: "meet at example.com") or the last label mixes cases (a sentence or a class, no domain). The patterns for addresses and numbers run on the source text (base spans) and on
the rewritten text; a finding there that rests on at least one rewritten character, and does not lie in a
base span of its kind, is mapped back to source characters and added. Base spans stay, also where they are
a fragment of an added one.

Spans are code points, end exclusive. Texts that show no trigger are not rewritten. Defined cases: null
text is empty and has no spans; repeated rows are searched each; other columns are ignored; very long
digit runs are handled as text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
]))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does; saying so keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")

# letters that look like these ASCII letters; full-width forms and decimal digits follow from rules
LOOK_ALIKE = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁԛԝҺһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα",
    "ABESIJKMHOPCTXYaesijopcxydqwhhABEZHIKMNOPTYXoa",
)) | {
    "\u2024": ".", "\u3002": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-",
    "\u2012": "-", "\u2013": "-", "\u00a0": " ", "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
FOREIGN = re.compile(
    "[" + "".join(map(re.escape, LOOK_ALIKE)) + INVISIBLE + r"\uff01-\uff5e]|(?![0-9])\d"
)
# spoken digits and signs of English, French, German and Spanish
DIGIT_WORDS = {word: str(digit) for digit, words in enumerate((
    "zero oh zéro null cero", "one un eins uno", "two deux zwei zwo dos", "three trois drei tres",
    "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete",
    "eight huit acht ocho", "nine neuf neun nueve",
)) for word in words.split()}
ARTICLE = "un"  # also a French and Spanish article: no digit beside figures at the end of a run
DOT = "dot|point|punkt|punto"
AT_FAR = "arobase|arrobase|arroba|klammeraffe|ät"
PLUS = "plus|más"
# longer words first, as "uno" begins with "un"
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(
    rf"\b(?:(?:{PLUS})[\s-]+)?(?:(?:{_WORD})\b|[0-9]+)"
    rf"(?:(?:[\s,-]+|[\s,-]+(?:{DOT})[\s,-]+)(?:(?:{_WORD})\b|[0-9]+))+",
    re.I,
)
# hints are searched in lower-cased text, which needs no case folding at each place
SPELLED_HINT = re.compile(
    rf"(?:\b(?:{_WORD})|[0-9])[\s,-]+(?:(?:{DOT})[\s,-]+)?(?:{_WORD})\b"
    rf"|\b(?:{_WORD})[\s,-]+(?:(?:{DOT})[\s,-]+)?[0-9]")
SPELLED_PART = re.compile(rf"{PLUS}|{DOT}|{_WORD}|[0-9]", re.I)
BRACKETED = re.compile(rf"(?:(?<!\s)\s+)?[(\[{{<]\s*(at|@|{AT_FAR}|{DOT}|\.)\s*[)\]}}>]\s*", re.I)
BRACKET_HINT = re.compile(rf"[(\[{{<]\s*(?:at|@|{AT_FAR}|{DOT}|\.)\s*[)\]}}>]")
_LOCAL, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+", "[A-Za-z0-9-]+"
BARE = re.compile(
    rf"{_LOCAL}(?:\s+at\s+|@){_LABEL}(?:(?:\s+dot\s+|\.){_LABEL})*\s+dot\s+{_LABEL}", re.I)
# "point" follows foreign signs only: "look at this point in" is prose; a dotted host after @ is whole already
BARE_FAR = re.compile(
    rf"{_LOCAL}(?:\s+(?:{AT_FAR})\s+{_LABEL}(?:(?:\s+(?:{DOT})\s+|\.){_LABEL})*\s+(?:{DOT})\s+{_LABEL}"
    rf"|\s+at\s+{_LABEL}(?:\s+(?:punkt|punto)\s+{_LABEL})+"
    rf"|@{_LABEL}(?:\s+(?:point|punkt|punto)\s+[a-z]{{2,24}}\b)+)", re.I)
BARE_PART = re.compile(rf"\s+(at|{AT_FAR}|{DOT})\s+", re.I)
BARE_HINT = re.compile(rf"\s(?:{DOT})\s")
NUMBERS = re.compile(rf"(?<![0-9])[0-9]+(?:\s+(?:{DOT})\s+[0-9]+){{3}}", re.I)
AT_HOST = re.compile(
    rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)(\s+(?:at|{AT_FAR})\s+)(?:[A-Za-z0-9-]+\.)+([A-Za-z]{{2,24}})(?![A-Za-z0-9])",
    re.I)
AT_HINT = re.compile(rf"\s(?:at|{AT_FAR})\s+[a-z0-9-]+\.[a-z]")
SIGNS = dict.fromkeys(PLUS.split("|"), "+") | dict.fromkeys(DOT.split("|"), ".") \
    | dict.fromkeys(("at", "@", *AT_FAR.split("|")), "@")
# words that stand before "at" in prose about a place, a site or a file
AT_PROSE = frozenset("""
    a about access again all am and any anyone anything are article available back based be been book breaks bug
    but buy call called came check chat click code come contact contacts crash data details directly discuss
    docs document documentation documents download downloads email emails error errors everyone exception failed
    fails fault file files find found free from full go going good had happened has have he held help her here
    him his home hosted info information is issue it job jobs join just laugh learn let like line link listed
    live located login look looked looking looks mail me meet meeting meets message more my new news no not now
    object offered office on one online only open or order our out page pages people point pointed posted
    price project published reach read register request research researcher results reviewed run running sale
    see she shop shown sign signed site sold source standing starts stay still stop store story team than that
    the them then there these they this those time today together up us video view visit visited was we
    website went were what where which who wiki work worked working works write you your
""".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+, found from the @ outwards in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, leftmost and non-overlapping per kind."""
    found = [(start, 0, end) for start, end in emails(text)]
    if not DIGITS.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


class Tape:
    """A text with, for each character, its source span and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = [False] * len(text)

    def rewrite(self, pattern: re.Pattern, pieces) -> None:
        """Replace each (from, to, written) that ``pieces`` yields for a match of the pattern."""
        out, start, end, new, at = [], [], [], [], 0
        for match in pattern.finditer(self.text):
            for a, b, written in pieces(match):
                out.append(self.text[at:a])
                start += self.start[at:a]
                end += self.end[at:a]
                new += self.new[at:a]
                out.append(written)
                start += [self.start[a]] * len(written)
                end += [self.end[b - 1]] * len(written)
                new += [True] * len(written)
                at = b
        if at:
            self.text = "".join([*out, self.text[at:]])
            self.start = start + self.start[at:]
            self.end = end + self.end[at:]
            self.new = new + self.new[at:]


def plain_character(match: re.Match):
    c = match[0]
    if c in INVISIBLE:
        written = ""
    elif c in LOOK_ALIKE:
        written = LOOK_ALIKE[c]
    elif "\uff01" <= c <= "\uff5e":
        written = chr(ord(c) - 0xFEE0)
    else:
        written = str(unicodedata.decimal(c))
    yield match.start(), match.end(), written


def spelled_digits(match: re.Match):
    parts = list(SPELLED_PART.finditer(match[0]))
    while len(parts) > 1 and parts[-1][0].lower() == ARTICLE and parts[-2][0].isdigit():
        parts.pop()
    while len(parts) > 1 and parts[0][0].lower() == ARTICLE and parts[1][0].isdigit():
        parts.pop(0)
    if not any(p[0].lower() in DIGIT_WORDS for p in parts):
        return
    base, at = match.start(), parts[0].start()
    for p in parts:
        word = p[0].lower()
        sign = SIGNS.get(word) or DIGIT_WORDS.get(word, word)
        if p.start() > at:
            yield base + at, base + p.start(), ""
        yield base + p.start(), base + p.end(), sign
        at = p.end()


def bracketed(match: re.Match):
    yield match.start(), match.end(), SIGNS.get(match[1].lower(), ".")


def bare(match: re.Match):
    for p in BARE_PART.finditer(match[0]):
        yield match.start() + p.start(), match.start() + p.end(), SIGNS[p[1].lower()]


def at_host(match: re.Match):
    if match[1].lower() not in AT_PROSE and (match[3].islower() or match[3].isupper()):
        yield match.start(2), match.end(2), "@"


def find(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) by start, then kind."""
    if not text:
        return []
    base = detect(text)
    rules, lower = [], text.lower()
    if not text.isascii() and FOREIGN.search(text):
        rules.append((FOREIGN, plain_character))
    if rules or SPELLED_HINT.search(lower):
        rules.append((SPELLED, spelled_digits))
    if rules or BRACKET_HINT.search(lower):
        rules.append((BRACKETED, bracketed))
    if rules or BARE_HINT.search(lower):
        rules += [(NUMBERS, bare), (BARE, bare), (BARE_FAR, bare)]
    if rules or AT_HINT.search(lower):
        rules.append((AT_HOST, at_host))
    spans = [(s, k, e, True) for s, k, e in base]
    if rules:
        tape = Tape(text)
        for pattern, pieces in rules:
            tape.rewrite(pattern, pieces)
        for s, k, e in detect(tape.text):
            a, b = tape.start[s], tape.end[e - 1]
            if any(tape.new[s:e]) or b - a > e - s:  # written anew, or with characters left out
                if not any(kind == k and x <= a and b <= y for x, kind, y in base):
                    spans.append((a, k, b, False))
    return sorted(spans)


@F.pandas_udf(SPANS)
def spans(texts: pd.Series) -> pd.Series:
    """All spans of each text, base ones marked."""
    names = ("start", "kind", "end", "base")
    return pd.Series([[dict(zip(names, x)) for x in find(t)] for t in texts], dtype=object)


def replaced(text: str, marks: Iterable[tuple[int, int, int]]) -> str:
    """The text with its spans (start, kind, end) as <KIND>; overlapping spans become one, named by the first."""
    parts, at, last = [], 0, -1
    for start, kind, end in marks:
        if start >= last:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        last = at = max(last, end)
    return "".join([*parts, text[at:]])


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Each text with the given spans replaced."""
    names = ("start", "kind", "end")
    return pd.Series([
        text if marks is None or not len(marks) else replaced(text, [[m[n] for n in names] for m in marks])
        for text, marks in zip(texts, found)], dtype=object)


@F.udf(returnType=T.StringType(), useArrow=False)
def redact(text: str | None) -> str | None:
    """The text with all its spans replaced.

    Spans are found and replaced in one worker, and a plain function takes 100 rows at a time, so that texts do not
    pile up in thousands, once for the spans and once for the replacement, beside each task.
    """
    return replaced(text, [mark[:3] for mark in find(text)]) if text else text


def digest(marks: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(marks, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
