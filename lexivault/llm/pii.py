"""Personal information inside free text.

Method: semi-Markov conditional random field. Spans of at most ``MAX_TOKENS`` tokens that could be a name,
and spans of the other types, are candidate segments. Features of the whole span, of its words and of the words
around it score each; weights of pairs of types score segments that follow one another with nothing but
separators between. Dynamic programming over the lattice of candidates chooses the segments jointly, their
boundaries and types. Spans are bounded in tokens, so decoding is linear in the text.

Weights are trained here by the field's likelihood (forward and backward sums over each lattice) on a bounded
sample of texts (``max_train``). Labels of the sample are distant: a list of person names, formats
that admit one reading, and label words before numbers. In training, names are hidden from the list's
features at random, so that contexts and endings carry names the list doesn't have; lattices with parts that
no rule explains are left out. Which words are ordinary (mostly in small letters, or hardly anywhere but at the
beginning of sentences) is counted over all texts. Every text is then decoded whole; nothing is shuffled but
word counts and the found items.

Null and blank texts hold nothing. A text that repeats a value names it once in ``found``; the redacted
text has a typed placeholder in place of each occurrence and is otherwise unchanged.
"""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import hash_sample, spread

MAX_TRAIN = 4000  # texts to train on
MAX_TRAIN_CHARS = 20_000  # longer texts aren't taken into the sample, so that it is bounded in size too
MAX_LATTICES = 40_000  # labelled lattices to train on
MAX_NAMES = 200_000  # entries of the name list; more are refused
MAX_ORDINARY = 5_000_000  # ordinary words; more are refused
MAX_TOKENS = 5
_CACHE = 100_000  # entries of a cache of what was met before, some 50 MB; it is emptied when full
TYPES = ("person_name", "phone", "email", "identity_number", "street_address")

# Words around names and numbers, in several languages.
TITLES = frozenset("dr dr. dra dra. mr mr. mrs mrs. ms ms. miss prof prof. sr sr. sra sra. señor señora herr frau mme m. nurse".split())
DEGREES = frozenset("md np rn pa do phd lpn fnp dnp msw lcsw pharmd crna".split())
PARTICLES = frozenset("van von de da di del della den der la le st. al bin ten".split())
RELATIONS = frozenset("neighbor neighbour interpreter daughter son husband wife sister brother mother father spouse partner guardian caregiver aunt uncle cousin friend patient provider".split())
CALENDAR = frozenset(
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
PLACES = frozenset("family street avenue lane clinic practice imaging center medical hospital center, surgery pharmacy laboratory institute".split())
EPONYMS = frozenset("sign score test maneuver manoeuvre index scale criteria syndrome disease reflex".split())
BRANDS = frozenset("forte xr sr er cr plus".split())
ID_LABELS = ("ssn", "social security", "soc sec", "ss no", "mrn", "chart", "med rec", "medical record", "insurance", "policy", "member", "passport", "travel document", "licence", "license", "health number", "nhs")
ID_PREFIXES = frozenset("SSN MRN NO ID NHS SS DOB RM ROOM PHONE TEL PH CELL LOT ORDER FILE BP WT".split())
PLAIN_LABELS = ("order", "file", "lot", "score", "prior", "room", "rm", "bay", "steps", "version")
PHONE_LABELS = ("call", "fax", "ring", "phone", "tel", "cell", "mobile", "texts", "number since", "reached", "dialled", "contact number", "unavailable try", "ph", "h:")
NAME_LABELS = ("caller was", "caller is", "caller", "spoke with", "spoke to", "spoken with", "talked to", "talked with", "name is", "name was", "name", "named", "called by", "call from", "message from", "signed by", "accompanied by", "habló con", "llamó")
STREET = r"(?:Street|St|Avenue|Ave|Road|Rd\.|Rd|Lane|Ln|Boulevard|Blvd|Terrace|Court|Ct|Way|Drive|Place|Square|Close|Crescent)"


def _char_class(belongs, first: int = 0, last: int = 0xFFFF) -> str:
    """The inside of a character class, as ranges, of the characters in a range for which belongs is true."""
    out, start = [], -1
    for i in range(first, last + 2):
        if i <= last and belongs(chr(i)):
            start = i if start < 0 else start
        elif start >= 0:
            out.append(f"{chr(start)}-{chr(i - 1)}" if i - start > 1 else chr(start))
            start = -1
    return "".join(out)


_UP = _char_class(lambda c: c.isupper() or c.istitle())
_LOW = _char_class(str.islower)
_CASELESS = _char_class(lambda c: c.isalpha() and not c.isupper() and not c.islower() and not c.istitle())
_WIDE = _char_class(str.isalpha, 0x10000, sys.maxunicode)  # letters of rare scripts, taken as without case
_UNSPACED = "぀-ヿ㐀-䶿一-鿿"  # kana and Han: no spaces between words
_LET = r"[^\W\d_]"
# Patterns begin with a class of characters and look behind it after that, so that the search skips to those characters.
_CAP, _CAP_WIDE = (
    re.compile(rf"[{_UP}{c}](?<![\w@.+'’-].)(?:(?<=[{_UP}])(?:['’][{_UP}])?{_LET}*(?:['’-]{_LET}+)*\.?|[{c}]*)", re.S) for c in (_CASELESS, _CASELESS + _WIDE)
)
_UNSPACED_RUN = re.compile(f"[{_UNSPACED}]{{2,}}")
_PARTICLE_BEFORE = re.compile(r"(?:(?<=\s)|^)(van der|van den|de la|van|von|de|da|di|del)\s{1,2}$")
_EMAIL = [
    re.compile(r"(?<![\w.+-])[\w.+-]*\w[ ]?@[ ]?\w[\w-]*(?:\.\w[\w-]*)+"),
    re.compile(r"(?<![\w.+-])[\w.+-]*\w\s?[(\[{<]\s?at\s?[)\]}>]\s?\w[\w-]*(?:(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?)\w[\w-]*)+", re.I),
    re.compile(r"(?<![\w.+-])[\w.+-]*\w at \w[\w-]*(?: dot \w[\w-]*)+", re.I),
]
_NUMBER = re.compile(r"(?<![\w.\-/@+#])#?(?=[\d(+][\d() .\-]{5})(\+?(?:\(\d{1,5}\)|\d{1,12})(?:[ .\-]{0,1}(?:\(\d{1,5}\)|\d{1,12})){0,6})(?![\w@]|[\-/.]\d)")
_NUMBER_START = re.compile(r"[#\d(+](?<![\w.\-/@+#].)(?=[\d() .\-+]{5})", re.S)
_CODE = re.compile(r"([A-Z]{1,6})([ \-]?)(\d(?:[\d \-]{2,16})\d)(?![\w/@]|-\d)")
_CODE_START = re.compile(r"[A-Z](?<![\w.\-/@].)[A-Z]{0,5}[ \-]?\d", re.S)
_DIGIT_WORDS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "double", "triple")
_DIGIT = f"(?:{'|'.join(_DIGIT_WORDS)})"
_SPOKEN = re.compile(rf"\b{_DIGIT}(?:[ -]{_DIGIT}){{5,}}\b", re.I)
_ADDRESS = [
    re.compile(rf"\d(?<![\w.\-/].)\d{{0,4}}[A-Za-z]?(?: bis,?)? (?:[NSEW]\.? |North |South |East |West )?(?:(?:{_LET}|['’-])+ ){{1,3}}?{STREET}(?![\w])(?:,? (?:Apt|Unit|Suite|Ste|Flat|Apartment)\.? ?#?\w+|,? #\s?\w+)?", re.I),
    re.compile(rf"\d(?<![\w.\-/].)\d{{0,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse) (?:des|du|de la|de l['’]|de|d['’])?\s?(?:{_LET}|['’-])+(?:,? (?:appt?|bât)\.? ?\w+)?", re.I),
    re.compile(rf"\b(?:Calle|Avenida|Plaza|Paseo|Camino|Avda\.?|C/) ?(?:de (?:la |los |las )?)?(?:{_LET}|['’-])+,? \d{{1,5}}(?:, ?\d+[ºª] ?[A-Z]?)?", re.I),
    re.compile(rf"(?<![\w-])(?:{_LET}|-){{2,40}}?(?:straße|strasse|weg|gasse|allee|platz|ring|str\.) \d{{1,5}}(?: ?[a-z](?!\w))?", re.I),
]
# Parts without which, in lower case, a pattern can't match: only a faster no.
_EMAIL_SIGNS = (("@",), ("at)", "at]", "at}", "at>", "at )", "at ]", "at }", "at >"), (" dot ",))
# What a token between white space may be part of, as bits: a word in small letters that isn't ordinary, a spoken number, an address of each pattern.
_RARE, _SPOKEN_BIT = 1, 2
_STREET_WORD = re.compile(STREET + r"(?!\w)", re.I)
_FRENCH_WORDS = frozenset("rue avenue boulevard place chemin allée quai impasse".split())
_SPANISH_WORD = re.compile(r"\b(?:calle|avenida|plaza|paseo|camino|avda|c/)")
_GERMAN_ENDS = ("straße", "strasse", "weg", "gasse", "allee", "platz", "ring", "str.")
_GERMAN_SIGN = re.compile(r"(?:straße|strasse|weg|gasse|allee|platz|ring|str\.) \d")
_DIGIT_WORD = re.compile(rf"\b{_DIGIT}\b", re.I)
_ZERO = str.maketrans("123456789", "000000000")
_ABBREVIATIONS = frozenset(map(str.lower, ID_PREFIXES))


@dataclass(slots=True)
class Candidate:
    start: int
    end: int
    kind: str
    form: str  # what the span is made of
    flags: tuple[str, ...] = ()  # further features of the whole span
    tokens: tuple[str, ...] = ()


@dataclass
class Lexicon:
    given: frozenset[str]
    family: frozenset[str]
    ordinary: frozenset[str] = frozenset()  # in small letters, by their counts in all texts

    def __post_init__(self) -> None:
        self.plain = (self.ordinary | RELATIONS | CALENDAR | BRANDS | _ABBREVIATIONS) - self.given - self.family  # words that alone make no name
        self.kinds: dict[str, tuple[str, bool, int]] = {}  # classes of tokens met so far
        self.never: set[str] = set()  # those of them that alone make no name
        self.runs: dict = {}  # spans of runs of tokens met so far
        self.masks: dict[str, int] = {}  # what tokens between white space may be part of
        self.dull: set[str] = set()  # those that are part of nothing
        self.known: dict[str, str] = {w: ("g" if w in self.given else "") + ("f" if w in self.family else "") for w in self.given | self.family}

    def unlisted(self, word: str) -> str:
        """The class of a word as if it were on no list of names."""
        w = word.rstrip(".").lower()
        return "o" if w in self.ordinary else "r" if w in RELATIONS else "c" if w in CALENDAR else "b" if w in BRANDS else "a" if w in _ABBREVIATIONS else "-"

    def of(self, word: str) -> str:
        """g and f as the list has it, o ordinary, r a relation, c of the calendar, b of a drug's name, a an abbreviated label, else -."""
        return self.known.get(word.rstrip(".").lower()) or self.unlisted(word)


def listed_names(names: Sequence[tuple[str, str]]) -> tuple[frozenset[str], frozenset[str]]:
    """Given and family names in small letters, family names also without particles."""
    given = frozenset(n.lower() for n, k in names if k == "given")
    family = frozenset(n.lower() for n, k in names if k == "family")
    return given, family | {n.split()[-1] for n in family if n.strip()}


_LOWER = rf"[{_LOW}]+(?:['’-][{_LOW}]+)*"
_LOWER_WORD = re.compile(rf"(?<![\w@.+'’-]){_LOWER}(?![\w@+'’(-]|\.\w)")
_LABEL_BEFORE = re.compile(rf"\b(?:{'|'.join(NAME_LABELS)}):? *$")
_LOWER_INITIAL = re.compile(rf"[{_LOW}]\.(?= )")
_LOW_TOKEN = re.compile(rf"\(?([{_LOW}][{_LOW}'’-]*)(?:[,;:)?!]|\.(?!\w)|$)")
_UP_TOKEN = re.compile(rf"\(?([{_UP}][{_LOW}][{_LOW}'’-]*)(?:[,;:)?!]|\.(?!\w)|$)")
_OPENING = re.compile(rf"[\n.!?:(](?<!Dr.)(?<!Mr.)(?<!Ms.)(?<!rs.)(?<!St.)\s*(?:- )?([{_UP}][{_LOW}]+(?:['’][{_LOW}]+)?)(?= [{_LOW}])")
_LABELLED = re.compile(rf"(?:{'|'.join(NAME_LABELS)}):?((?: {_LOWER}){{1,3}})", re.I)
_LABEL_HEADS = tuple(h for w in sorted({x.split()[0][:4] for x in NAME_LABELS}) for h in (w, w.capitalize()))
_TALLY = 1_000_000  # different tokens a task holds before it hands them on


def _folded(tokens: Counter[str], opening: Counter[str], labelled: Counter[str]) -> pd.DataFrame:
    """(word, low, up, open) from counts of tokens as they stand."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for t, n in tokens.items():
        if m := _LOW_TOKEN.match(t):
            out[m.group(1)][0] += n
        elif m := _UP_TOKEN.match(t):
            out[m.group(1).lower()][1] += n
    for t, n in labelled.items():
        if m := _LOW_TOKEN.match(t):
            out[m.group(1)][0] -= n
    for t, n in opening.items():
        out[t.lower()][2] += n
    return pd.DataFrame([(w, *n) for w, n in out.items()], columns=["word", "low", "up", "open"])


def ordinary_words(texts: DataFrame, least: int = 3, share: float = 1e-6, opening_share: float = 0.005) -> DataFrame:
    """(word): words that stand in small letters in at least least texts (and share of all) and a fourth as often as
    capitalised, or of which nine in ten capitalised ones open a sentence, in opening_share of all texts.

    Counted once a text and form, over all texts; each task sums its own texts first. Small letters after a
    word that announces a name don't count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter[str] = Counter()
        opening: Counter[str] = Counter()
        labelled: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].tolist():
                tokens.update(set(text.split()))
                own: set[str] = set()
                opening.update(set(_OPENING.findall("\n" + text)))
                for head in _LABEL_HEADS:
                    at = text.find(head)
                    while at >= 0:
                        if (m := _LABELLED.match(text, at)) and not text[at - 1 : at].isalnum():
                            own.update(m.group(1).split())
                        at = text.find(head, at + len(head))
                labelled.update(own)
            if len(tokens) > _TALLY:
                yield _folded(tokens, opening, labelled)
                tokens.clear(), opening.clear(), labelled.clear()
        yield _folded(tokens, opening, labelled)

    each = texts.where("text is not null").select("text").mapInPandas(run, "word string, low long, up long, open long")
    counted = each.groupBy("word").agg(F.sum("low").alias("low"), F.sum("up").alias("up"), F.sum("open").alias("open"))
    n = texts.count()
    small = (F.col("low") >= max(least, n * share)) & (F.col("low") * 4 >= F.col("up"))
    starts = (F.col("open") >= max(5, n * opening_share)) & (F.col("open") * 10 >= F.col("up") * 9)
    return counted.where(small | starts).select("word")


def _kind(w: str, plain: frozenset[str]) -> tuple[str, bool, int]:
    """(class of a token, whether it alone may be a name, how many of its last characters aren't part of it)."""
    low, cut = w.lower(), 0
    if w[-1] == ".":
        if len(w) == 2:
            return "I", False, 0
        if low == "st.":
            return "P", False, 0
        cut, low = 1, low[:-1]
        if low + "." in TITLES:
            return "", False, cut
    if low in TITLES or low in DEGREES:
        return ("P" if low in PARTICLES and len(w) > 1 and w[: len(w) - cut].isupper() else ""), False, cut
    if len(w) - cut < 2:
        return "I", False, cut
    return "C", low not in plain, cut


def _spaced_runs(text: str, lex: Lexicon) -> Iterator[list[tuple[int, int, str, bool]]]:
    """Runs of neighbouring tokens of a line of which at least one may be a name: (start, end, class, may be a name).

    Classes are C capitalised or without case, I initial, P particle. Only lines that hold such a token are cut up.
    """
    kinds, plain, never = lex.kinds, lex.plain, lex.never
    tokens_of = _CAP if text.isascii() or max(text) < "\U00010000" else _CAP_WIDE
    if len(kinds) > _CACHE:
        kinds.clear(), never.clear()
    lines: set[tuple[int, int]] = set()
    for w in set(tokens_of.findall(text)) - never:
        if w not in kinds:
            kinds[w] = _kind(w, plain)
        if not kinds[w][1]:
            never.add(w)
            continue
        at = text.find(w)
        while at >= 0:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            lines.add((text.rfind("\n", 0, at) + 1, end))
            at = text.find(w, end)
    for start, end in sorted(lines):
        yield from _line_runs(text, start, end, tokens_of, kinds, plain)


def _line_runs(text: str, start: int, stop: int, tokens_of: re.Pattern[str], kinds: dict[str, tuple[str, bool, int]], plain: frozenset[str]) -> Iterator[list[tuple[int, int, str, bool]]]:
    """The runs of one line."""
    tokens: list[tuple[int, int, str, bool]] = []
    worth: list[int] = []
    for m in tokens_of.finditer(text, start, stop):
        w = m.group()
        if (known := kinds.get(w)) is None:
            known = kinds[w] = _kind(w, plain)
        kind, name, cut = known
        s, e = m.span()
        e -= cut
        if kind == "C" and text[e : e + 1] == ":":
            kind, name = "", False
        if name:
            worth.append(len(tokens))
        tokens.append((s, e, kind, name))
    upto = 0
    for i in worth:
        if i < upto:
            continue
        first = i
        while first > upto and tokens[first - 1][2] and _gap(text, tokens[first - 1][1], tokens[first][0]) is not None:
            first -= 1
        s = tokens[first][0]
        run = [tokens[first]]
        if tokens[first][2] == "C" and (p := _PARTICLE_BEFORE.search(text, max(0, s - 9), s)):
            run.insert(0, (p.start(1), p.end(1), "P", False))
        upto = first + 1
        while upto < len(tokens) and tokens[upto][2] and (gap := _gap(text, tokens[upto - 1][1], tokens[upto][0])) is not None:
            if gap:
                at = text.index(gap, tokens[upto - 1][1])
                run.append((at, at + len(gap), "P", False))
            run.append(tokens[upto])
            upto += 1
        yield run


def _gap(text: str, start: int, end: int) -> str | None:
    """The particle between two tokens of a run, '' for none; None where they aren't neighbours."""
    gap = text[start:end]
    if gap == " ":
        return ""
    if not gap or "\n" in gap or len(gap) > 9:
        return None
    between = gap.strip()
    if between in PARTICLES:
        return between
    return "" if len(gap) <= 4 and not gap.strip(" ,\t") and gap.count(",") <= 1 else None


def _copies(words: list[str]) -> list[int]:
    """For each word of a run the number of the copy it lies in, where up to four words stand at least three times in a row, else -1."""
    out = [-1] * len(words)
    if len(set(words)) == len(words):
        return out
    number = 0
    for p in (1, 2, 3, 4):
        k = p
        while k < len(words):
            b = k - p
            while k < len(words) and words[k] == words[k - p]:
                k += 1
            if k - b >= 3 * p and all(x < 0 for x in out[b:k]):
                out[b:k] = [number + i // p for i in range(k - b)]
                number = out[k - 1] + 1
            k += 1
    return out


def _name_spans(words: tuple[str, ...], kinds: str, names: tuple[bool, ...], commas: str, lex: Lexicon) -> list[tuple[int, int, str, tuple[str], tuple[str, ...]]]:
    """(first, last, form, flags, words) of the spans of a run of at most MAX_TOKENS tokens of which at least one may alone be a name."""
    out = []
    gaz = [lex.of(w) for w in words]
    copies = _copies(list(words))
    for i in range(len(words)):
        form = ""
        good = False
        for j in range(i, min(i + MAX_TOKENS, len(words))):
            if copies[i] != copies[j] and min(copies[i], copies[j]) >= 0:
                break  # a name doesn't reach from one copy of a looping text into the next
            form += kinds[j]
            good = good or names[j]
            if good:
                own = words[i : j + 1]
                case = "U" if len(own[-1]) > 2 and own[-1].isupper() or own[0].isupper() and len(own[0]) > 2 else "t"
                out.append((i, j, form + case, ("z" + " ".join(gaz[i : j + 1]),), own))
            if j < len(commas) and commas[j] == ",":
                form += ","
    return out


def _name_candidates(text: str, lex: Lexicon) -> Iterator[Candidate]:
    """Spans of at most MAX_TOKENS tokens of a run of which at least one is no ordinary word. What a run gives is remembered."""
    known = lex.runs
    if len(known) > _CACHE:
        known.clear()
    for run in _spaced_runs(text, lex):
        commas = "".join(["," if "," in text[a[1] : b[0]] else " " for a, b in zip(run, run[1:])])
        key = (tuple([text[a:b] for a, b, _, _ in run]), "".join([k for _, _, k, _ in run]), tuple([n for _, _, _, n in run]), commas)
        if (spans := known.get(key)) is None:
            spans = _name_spans(*key, lex)
            if len(run) <= 8:  # longer runs hardly come again
                known[key] = spans
        for i, j, form, flags, own in spans:
            yield Candidate(run[i][0], run[j][1], "person_name", form, flags, own)


def _unspaced_candidates(text: str, lex: Lexicon) -> Iterator[Candidate]:
    """Stretches of two to four characters of scripts without spaces, where they don't make up a whole token."""
    for m in _UNSPACED_RUN.finditer(text):
        s, e = m.span()
        for n in (2, 3, 4):
            for at in range(s, e - n + 1):
                if n < e - s:
                    word = text[at : at + n]
                    yield Candidate(at, at + n, "person_name", f"H{n}", ("z" + lex.of(word),), (word,))


def _lower_spans(text: str, at: int, plain: frozenset[str]) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Spans from a place on, up to three words that aren't ordinary, with particles and initials before: (words, form, end)."""
    words: list[str] = []
    form = ""
    while form.count("l") < 3 and len(form) < 7:
        if m := form and _LOWER_INITIAL.match(text, at):
            form += "i"
        elif not (m := _LOWER_WORD.match(text, at)):
            return
        elif m.group() in PARTICLES:
            form += "p"
        elif len(m.group()) < 2 or m.group() in plain:
            return
        else:
            form += "l"
        words.append(m.group())
        if form[-1] == "l":
            yield tuple(words), form, m.end()
        at = m.end() + 1
        if text[m.end() : at] != " ":
            return


_SPLIT = str.maketrans(dict.fromkeys(",.;:()?!/[]—–“”\"", " "))


def _rare_words(token: str, plain: frozenset[str]) -> set[str]:
    """Words in small letters of a token that aren't ordinary."""
    found = {w for t in token.translate(_SPLIT).split() if t.islower() and t not in plain for w in _LOWER_WORD.findall(t)}
    return {w for w in found if len(w) > 1 and w not in plain and w not in PARTICLES}


def _mask(token: str, plain: frozenset[str]) -> int:
    low = token.lower()
    out = _RARE if _rare_words(token, plain) else 0
    if _DIGIT_WORD.search(token):
        out |= _SPOKEN_BIT
    for k, sign in enumerate((_STREET_WORD.match(low), low in _FRENCH_WORDS, _SPANISH_WORD.search(low), low.endswith(_GERMAN_ENDS))):
        out |= (4 << k) * bool(sign)
    return out


def _signs(text: str, lex: Lexicon) -> tuple[int, set[str]]:
    """What the text's tokens may be part of, and its words in small letters that aren't ordinary."""
    masks, dull = lex.masks, lex.dull
    if len(masks) > _CACHE:
        masks.clear(), dull.clear()
    out = 0
    rare: set[str] = set()
    for t in set(text.split()) - dull:
        if (m := masks.get(t)) is None:
            m = masks[t] = _mask(t, lex.plain)
            if not m:
                dull.add(t)
        out |= m
        if m & _RARE:
            rare |= _rare_words(t, lex.plain)
    return out, rare


def _lower_candidates(text: str, rare: set[str], lex: Lexicon) -> Iterator[Candidate]:
    """Names in small letters, on the list or not: one to three words of which none is ordinary."""
    for word in rare:
        at = text.find(word)
        while at >= 0:
            m = _LOWER_WORD.match(text, at)
            if m and m.group() == word:
                p = _PARTICLE_BEFORE.search(text, max(0, at - 9), at)
                for start in (at, p.start(1)) if p else (at,):
                    for words, form, end in _lower_spans(text, start, lex.plain):
                        yield Candidate(start, end, "person_name", form, ("z" + " ".join(map(lex.of, words)),), words)
            at = text.find(word, at + len(word))


def candidates(text: str, lex: Lexicon) -> list[Candidate]:
    """All candidate segments of a text."""
    out = list(_name_candidates(text, lex))
    low = text.lower()
    signs, rare = _signs(text, lex)
    if rare:
        out += _lower_candidates(text, rare, lex)
    if not text.isascii():
        out += _unspaced_candidates(text, lex)
    for k, sign in enumerate(_EMAIL_SIGNS):
        if any(map(low.__contains__, sign)):
            out += [Candidate(*m.span(), "email", str(k)) for m in _EMAIL[k].finditer(text)]
    for start in _NUMBER_START.finditer(text):
        if not (m := _NUMBER.match(text, start.start())):
            continue
        value = m.group(1)
        digits = sum(c.isdigit() for c in value)
        if 6 <= digits <= 15:
            s, e = m.span(1)
            plain = re.sub(r"\D", "", value)
            fmt = re.sub(r"\d", "9", value)
            flags = (f"d{digits}", f"A{plain[:2]}", f"h{text[s - 1 : s] == '#'}")
            if digits >= 7:
                out.append(Candidate(s, e, "phone", fmt, flags))
            out.append(Candidate(s, e, "identity_number", fmt, flags))
    for start in _CODE_START.finditer(text):
        m = _CODE.match(text, start.start())
        if not m or sum(c.isdigit() for c in m.group(3)) < 5:
            continue
        letters = m.group(1)
        fmt = re.sub(r"\d", "9", m.group()[len(letters) :])
        out.append(Candidate(*m.span(), "identity_number", fmt, ("c" + letters, f"l{len(letters)}" + fmt, f"label{letters in ID_PREFIXES}")))
    if signs & _SPOKEN_BIT and sum(map(low.count, _DIGIT_WORDS)) > 5:
        for m in _SPOKEN.finditer(text):
            out.append(Candidate(*m.span(), "phone", "spoken"))
    for k, pattern in enumerate(_ADDRESS):
        if not signs & 4 << k or k == 3 and not _GERMAN_SIGN.search(low):
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            value = text[s:e]
            unit = bool(re.search(r"apt|unit|#|º|suite", value, re.I))
            out.append(Candidate(s, e, "street_address", f"{k}{unit}", (f"w{len(value.split())}", "L" + str(value.lower() == value), f"u{k}{value.upper() == value}")))
    return out


def _shaped(words: list[str]) -> list[str]:
    """In small letters, all digits as 0."""
    return [w.lower() if w.isalpha() else w.translate(_ZERO).lower() for w in words]


def _left(text: str, start: int) -> tuple[str, ...]:
    """Up to three words before a place in its line, ^ for the line's beginning, before which stand words of the line above if nothing else does."""
    left = text[max(0, start - 60) : start]
    above, _, line = left.rpartition("\n")
    prev = _shaped(line.rsplit(None, 3)[-3:])
    if len(prev) < 3 and (len(line) < len(left) or start < 60):
        return ("^", *prev) if prev else (*_shaped(above.rpartition("\n")[2].split()[-2:]), "^")
    return tuple(prev)


def _right(text: str, end: int) -> tuple[str, str, str]:
    """(what stands next, the next two words of the line)."""
    right = text[end : end + 40]
    nxt = _shaped(right.partition("\n")[0].split(None, 2)[:2])
    glued = "" if not right else "_" if right[0] == " " else "n" if right[0] == "\n" else right[0]
    return glued, nxt[0] if nxt else "", nxt[1] if len(nxt) > 1 else ""


def _own_features(k: str, form: str, flags: tuple[str, ...], tokens: tuple[str, ...]) -> list[str]:
    """Of the span itself."""
    out = [k, f"{k}f{form}", *[f"{k}{x}" for x in flags]]
    if tokens:
        out.append(f"{k}zf{flags[0]}|{form}")
        out += [f"{k}y{c}" for c in flags[0][1:].split(" ")]
    for i, w in enumerate(tokens):
        low = w.lower()
        spot = "L" if i == len(tokens) - 1 else "F"
        out += [f"{k}s{low[-3:]}", f"{k}s{spot}{low[-3:]}|{form}", f"{k}e{low[:3]}"]
    return out


def _left_features(k: str, form: str, z: str, prev: tuple[str, ...]) -> list[str]:
    p1 = prev[-1] if prev else ""
    out = [f"{k}p{p1}", f"{k}q{' '.join(prev[-2:])}", f"{k}pf{p1}|{form}"]
    if not z:
        return out + [f"{k}b{w}" for w in prev] + [f"{k}bf{w}|{form}" for w in prev]
    opens = not p1 or p1 == "^" or p1[-1] in ".!?;:"
    out += [f"{k}zp{z}|{p1}", f"{k}o{opens}|{form}"]
    if "l" in form:
        label = _LABEL_BEFORE.search(" ".join(prev)) is not None
        out += [f"{k}l{label}|{form}", f"{k}l{label}|{z.strip('z- ') != ''}"]
    return out


def _right_features(k: str, form: str, z: str, nxt: tuple[str, str, str]) -> list[str]:
    glued, n1, n2 = nxt
    out = [f"{k}n{glued}{n1}", f"{k}r{n1} {n2}", f"{k}nf{n1}|{form}", f"{k}g{glued}"]
    return [*out, f"{k}zn{z}|{n1}", f"{k}zg{z}|{glued}"] if z else out


def features(text: str, c: Candidate, hide: str | None = None) -> list[str]:
    """Features of a whole segment; ``hide`` replaces what the name list says of its tokens."""
    k = c.kind[0] + c.kind[1]
    flags = c.flags if hide is None else (hide, *c.flags[1:])
    z = flags[0] if c.tokens else ""
    return _own_features(k, c.form, flags, c.tokens) + _left_features(k, c.form, z, _left(text, c.start)) + _right_features(k, c.form, z, _right(text, c.end))


_SEPARATORS = {"": "j", " ": "s", ",": "c", ", ": "c", "\n": "n"}


def _follows(text: str, spans: Sequence[tuple[int, int, str]]) -> tuple[list[int], list[list[tuple[int, str]]]]:
    """For spans in order of end: how many end before the last word ahead of each, and those with nothing but separators in between.

    The latter as (index, name of the transition).
    """
    by_end: dict[int, list[int]] = defaultdict(list)
    ends: list[int] = []
    before, adjacent = [], []
    for i, (s, e, kind) in enumerate(spans):
        near: list[tuple[int, str]] = []
        edge = s
        while edge > 0 and not text[edge - 1].isalnum():
            if found := by_end.get(edge):
                sep = _SEPARATORS.get(text[edge:s], "o")
                near += [(j, f"T{spans[j][2][:2]}{kind[:2]}{sep}") for j in found]
            edge -= 1
        if found := by_end.get(edge):
            sep = _SEPARATORS.get(text[edge:s], "o")
            near += [(j, f"T{spans[j][2][:2]}{kind[:2]}{sep}") for j in found]
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            if ends[mid] < edge:
                lo = mid + 1
            else:
                hi = mid
        before.append(lo)
        adjacent.append(near)
        by_end[e].append(i)
        ends.append(e)
    return before, adjacent


def _best(text: str, spans: Sequence[tuple[int, int, str]], scores: Sequence[float], weights: dict[str, float]) -> list[int]:
    """The spans, in order of end, whose scores and transitions are most in total and that don't overlap."""
    before, adjacent = _follows(text, spans)
    prefix = [0.0]  # best of the first i spans
    last = [-1]  # the span that ends it, -1 for none
    value: list[float] = []
    back: list[int] = []
    for i, score in enumerate(scores):
        best, at = prefix[before[i]], last[before[i]]
        for j, name in adjacent[i]:
            v = value[j] + weights.get(name, 0.0)
            if v > best:
                best, at = v, j
        value.append(best + score)
        back.append(at)
        if value[i] > prefix[-1]:
            prefix.append(value[i])
            last.append(i)
        else:
            prefix.append(prefix[-1])
            last.append(last[-1])
    keep, i = [], last[-1]
    while i >= 0:
        keep.append(i)
        i = back[i]
    return keep[::-1]


def _lse(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def _marginals(before: Sequence[int], adjacent: Sequence[Sequence[tuple[int, str]]], scores: Sequence[float], weights: dict[str, float]) -> tuple[list[float], dict[str, float]]:
    """Probability of each span and expected number of each transition under the field.

    Forward sums over spans by end; the backward pass is their derivative.
    """
    n = len(scores)
    z = [0.0]
    alpha: list[float] = []
    base: list[float] = []
    for i in range(n):
        total = z[before[i]]
        for j, name in adjacent[i]:
            total = _lse(total, alpha[j] + weights.get(name, 0.0))
        base.append(total)
        alpha.append(total + scores[i])
        z.append(_lse(z[i], alpha[i]))
    gz = [0.0] * (n + 1)
    gz[n] = 1.0
    ga = [0.0] * n
    moves: dict[str, float] = defaultdict(float)
    for i in range(n - 1, -1, -1):
        take = math.exp(min(0.0, alpha[i] - z[i + 1]))
        ga[i] += gz[i + 1] * take
        gz[i] += gz[i + 1] * (1 - take)
        g = ga[i]
        if g:
            gz[before[i]] += g * math.exp(min(0.0, z[before[i]] - base[i]))
            for j, name in adjacent[i]:
                share = g * math.exp(min(0.0, alpha[j] + weights.get(name, 0.0) - base[i]))
                ga[j] += share
                moves[name] += share
    return ga, moves


@dataclass
class Field:
    """Weights of the field by feature name. Sums over features that depend on the same things are remembered."""

    weights: dict[str, float] = field(default_factory=dict)
    lex: Lexicon | None = None

    def __post_init__(self) -> None:
        self._own: dict = {}
        self._left: dict = {}
        self._right: dict = {}
        # No candidate below this can be part of the best segmentation, whatever it stands next to.
        self.floor = -2 * max([v for k, v in self.weights.items() if k[0] == "T"] + [0.0])

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "lex": self.lex}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _sum(self, names: list[str]) -> float:
        get = self.weights.get
        return sum([get(x, 0.0) for x in names])

    def scores(self, text: str, found: Sequence[Candidate]) -> list[float]:
        own, left, right = self._own, self._left, self._right
        for cache in (own, left, right):
            if len(cache) > _CACHE:
                cache.clear()
        lefts: dict[int, tuple[str, ...]] = {}
        rights: dict[int, tuple[str, str, str]] = {}
        out = []
        for c in found:
            k, form = c.kind[:2], c.form
            z = c.flags[0] if c.tokens else ""
            key = (k, form, c.flags, c.tokens)
            if (a := own.get(key)) is None:
                a = own[key] = self._sum(_own_features(*key))
            if (prev := lefts.get(c.start)) is None:
                prev = lefts[c.start] = _left(text, c.start)
            key = (k, form, z, prev)
            if (b := left.get(key)) is None:
                b = left[key] = self._sum(_left_features(*key))
            if (nxt := rights.get(c.end)) is None:
                nxt = rights[c.end] = _right(text, c.end)
            key = (k, form, z, nxt)
            if (d := right.get(key)) is None:
                d = right[key] = self._sum(_right_features(*key))
            out.append(a + b + d)
        return out

    def decode(self, text: str | None) -> list[tuple[int, int, str]]:
        """The best segmentation: (start, end, type), not overlapping, in order."""
        if not text or not text.strip():
            return []
        every = _distinct(candidates(text, self.lex))
        found = [(c.end, c.start, c.kind, s) for c, s in zip(every, self.scores(text, every)) if s > self.floor]
        if not found:
            return []
        found.sort()
        spans = [(s, e, kind) for e, s, kind, _ in found]
        return [spans[i] for i in _best(text, spans, [x[3] for x in found], self.weights)]


def _distinct(found: list[Candidate]) -> list[Candidate]:
    """Without repeated spans of a type, which two words side by side propose twice."""
    return list({(c.start, c.end, c.kind): c for c in found}.values())


def _islands(found: list[Candidate]) -> Iterator[list[Candidate]]:
    """Candidates that overlap directly or through others."""
    island: list[Candidate] = []
    end = -1
    for c in sorted(found, key=lambda c: (c.start, c.end)):
        if island and c.start >= end:
            yield island
            island = []
            end = -1
        island.append(c)
        end = max(end, c.end)
    if island:
        yield island


def _label_names(text: str, names: list[Candidate], lex: Lexicon) -> set[int] | None:
    """Indices of true names: the longest candidate of each stretch of listed words, initials and particles; None where a word is unknown."""
    end = max(c.end for c in names)
    after = text[end : end + 30].split()[:1]
    follow = after[0].lower().strip(".,;") if after else ""
    classes = {}
    for c in names:
        for t, x in zip(c.tokens, c.flags[0][1:].split(" ")):
            classes[t] = "n" if x[0] in "gf" else "n?" if t.lower() in PARTICLES or len(t.rstrip(".")) == 1 else x
    if follow in EPONYMS or follow in BRANDS or follow in PLACES and text[end : end + 1] == " " or "b" in classes.values() or any(t.lower() in PLACES or t.lower() in EPONYMS for t in classes):
        return set()
    if all("l" in c.form for c in names) and "n" not in classes.values():
        # Rare words in small letters are no name where no label says so; after one they may be one that isn't listed.
        return None if _LABEL_BEFORE.search(text[max(0, names[0].start - 36) : names[0].start].lower()) else set()
    if "-" in classes.values():
        return None
    good = [i for i, c in enumerate(names) if all(classes[t][0] == "n" for t in c.tokens) and any(classes[t] == "n" for t in c.tokens) and not c.form.rstrip("tU").endswith("P")]
    if not good:
        return None if "n" in classes.values() else set()
    out: set[int] = set()
    upto = -1
    for i in sorted(good, key=lambda i: (names[i].start, -names[i].end)):
        if names[i].start >= upto:
            out.add(i)
            upto = names[i].end
        elif names[i].end > upto:
            return None  # more names in a row than one candidate holds
    return out


def _label(text: str, island: list[Candidate], lex: Lexicon) -> set[int] | None:
    """Indices of the true candidates of an island by distant rules, or None where no rule explains it."""
    by = {t: [i for i, c in enumerate(island) if c.kind == t] for t in TYPES}
    longest = lambda ids: max(ids, key=lambda i: (island[i].end - island[i].start, -island[i].start))
    if by["email"]:
        return {longest(by["email"])}
    if by["street_address"]:
        i = longest(by["street_address"])
        nxt = text[island[i].end :].split(None, 1)[:1]
        if nxt and nxt[0].lower().rstrip(".,") in PLACES:
            return set()
        return {i}
    if by["phone"] or by["identity_number"]:
        ids = [i for i in by["identity_number"] if "labelTrue" not in island[i].flags]
        start = min(island[i].start for i in ids or by["phone"] or by["identity_number"])
        left = text[max(0, start - 36) : start].lower().rstrip().rpartition("\n")[2]
        near = left.rstrip(" :#.=(-")
        if re.search(r"\b(?:" + "|".join(PLAIN_LABELS) + r")$", near):
            return set()
        if not ids and not by["phone"]:
            return set() if near and any(f in ("cLOT", "cORDER", "cFILE", "cBP", "cWT", "cRM", "cROOM") for i in by["identity_number"] for f in island[i].flags) else None
        if ids and (any(x in left[-30:] for x in ID_LABELS) or any(f in ("cSSN", "cMRN", "cNHS") for c in island for f in c.flags)):
            return {longest(ids)}
        if by["phone"] and (re.search(r"(?:\b(?:" + "|".join(map(re.escape, PHONE_LABELS)) + r"))[\w ]{0,10}$", near) or any(island[i].form == "spoken" for i in by["phone"])):
            return {longest(by["phone"])}
        return None
    return _label_names(text, island, lex)


def _lattices(text: str, lex: Lexicon) -> Iterator[tuple[list[Candidate], list[bool]]]:
    """Labelled lattices of a text: islands that rules explain, joined where only separators stand between."""
    held: list[Candidate] = []
    truth: list[bool] = []
    end = -1
    for island in _islands(_distinct(candidates(text, lex))):
        true = _label(text, island, lex)
        if held and (true is None or any(map(str.isalnum, text[end : island[0].start]))):
            yield held, truth
            held, truth = [], []
        if true is None:
            continue
        held = held + island
        truth = truth + [i in true for i in range(len(island))]
        end = max(c.end for c in island)
    if held:
        yield held, truth


def fit(texts: Sequence[str], names: Sequence[tuple[str, str]], ordinary: Sequence[str] = (), seed: int = 11, epochs: int = 4, max_lattices: int = MAX_LATTICES) -> Field:
    """Train on a bounded sample of texts, a list of (name, kind) and the ordinary words of all texts."""
    rng = random.Random(seed)
    lex = Lexicon(*listed_names(names), frozenset(ordinary))
    data: list[tuple[list[int], list[list[tuple[int, str]]], list[list[str]], list[list[str]], list[bool], Counter[str]]] = []
    seen: Counter[str] = Counter()
    for text in texts:
        if len(data) >= max_lattices:
            break
        for found, truth in _lattices(text, lex):
            # What repeats word for word teaches no more after a few times.
            key = text[max(0, found[0].start - 12) : found[-1].end + 8]
            seen[key] += 1
            if seen[key] > 2:
                continue
            order = sorted(range(len(found)), key=lambda i: (found[i].end, found[i].start, found[i].kind))
            cs = [found[i] for i in order]
            gold = [truth[i] for i in order]
            full = [features(text, c) for c in cs]
            hidden = full
            if any(c.tokens for c in cs) and any(gold):
                gone = {t for c in cs for t in c.tokens if rng.random() < 0.6}
                hidden = [features(text, c, "z" + " ".join(lex.unlisted(t) if t in gone else lex.of(t) for t in c.tokens)) if c.tokens else f for c, f in zip(cs, full)]
            before, adjacent = _follows(text, [(c.start, c.end, c.kind) for c in cs])
            moves = Counter(name for i, near in enumerate(adjacent) if gold[i] for j, name in near if gold[j])
            data.append((before, adjacent, full, hidden, gold, moves))
    # Rare words in small letters are few; ordinary ones of each text show what a span without a name looks like.
    for text in texts:
        at = text.find(" ", rng.randrange(len(text))) + 1 if text else 0
        spans = [c for c in _lower_spans(text, at, frozenset()) if not any(t in lex.known for t in c[0])] if at else []
        if spans and not _LABEL_BEFORE.search(text[max(0, at - 30) : at].lower()):
            words, form, end = rng.choice(spans)
            own = features(text, Candidate(at, end, "person_name", form, ("z" + " ".join("-" for _ in words),), words))
            data.append(([0], [[]], [own], [own], [False], Counter()))
    w: dict[str, float] = {}
    g2: dict[str, float] = {}

    def step(name: str, err: float) -> None:
        old = w.get(name, 0.0)
        g = err + 1e-3 * old
        g2[name] = s = g2.get(name, 0.1) + g * g
        w[name] = old - 0.2 * g / math.sqrt(s)

    for _ in range(epochs):
        rng.shuffle(data)
        for before, adjacent, full, hidden, gold, moves in data:
            feats = hidden if rng.random() < 0.5 else full
            share, expected = _marginals(before, adjacent, [sum([w.get(x, 0.0) for x in f]) for f in feats], w)
            for f, p, y in zip(feats, share, gold):
                err = p - y
                if abs(err) >= 0.01:
                    for x in f:
                        step(x, err)
            for name in expected.keys() | moves.keys():
                err = expected.get(name, 0.0) - moves[name]
                if abs(err) >= 0.01:
                    step(name, err)
    return Field({x: v for x, v in w.items() if abs(v) > 1e-3}, lex)


def train(texts: DataFrame, names: DataFrame, max_train: int = MAX_TRAIN, max_names: int = MAX_NAMES) -> Field:
    """A field from the max_train texts of least hash, a list (name, kind), and the ordinary words of all texts.

    The list is a dimension that every task holds; one of more than max_names entries is refused, never cut.
    """
    texts = texts.select("text")
    ordinary = [r[0] for r in ordinary_words(texts).limit(MAX_ORDINARY + 1).toLocalIterator()]
    listed = names.select("name", "kind").where("name is not null and kind is not null").distinct().limit(max_names + 1).toPandas()
    if len(listed) > max_names or len(ordinary) > MAX_ORDINARY:
        raise ValueError(f"more than {max_names} names or {MAX_ORDINARY} ordinary words; raise the bounds only with larger executors")
    sample = hash_sample(texts, "text", max_train, F.length("text").between(1, MAX_TRAIN_CHARS)).toPandas()["text"].tolist()
    return fit(sample, sorted(zip(listed["name"], listed["kind"])), ordinary)


def find(texts: DataFrame, field_: Field) -> DataFrame:
    """(record, pii_type, pii_text), each once: takes (record, text), any number of texts a record."""
    shared = texts.sparkSession.sparkContext.broadcast(field_)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = []
            for record, text in zip(batch["record"].tolist(), batch["text"].tolist()):
                rows += {(record, kind, text[s:e]) for s, e, kind in model.decode(text)}
            yield pd.DataFrame(rows, columns=["record", "pii_type", "pii_text"])

    src = texts.where("record is not null and text is not null").select(F.col("record").cast("string").alias("record"), "text")
    return spread(src).mapInPandas(run, "record string, pii_type string, pii_text string").distinct()


def redact(df: DataFrame, id_col: str, text_col: str, field_: Field) -> DataFrame:
    """(id_col, redacted, n_found): the text of every row with [TYPE] in place of each found item; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(field_)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            out, counts = [], []
            for text in batch["text"].tolist():
                spans = model.decode(text)
                parts, at = [], 0
                for s, e, kind in spans:
                    parts += [text[at:s], f"[{kind.upper()}]"]
                    at = e
                out.append(None if text is None else "".join([*parts, text[at:]]))
                counts.append(len(spans))
            yield pd.DataFrame({"id": batch["id"], "redacted": out, "n_found": counts})

    return spread(src).mapInPandas(run, f"id {dict(src.dtypes)['id']}, redacted string, n_found long").withColumnRenamed("id", id_col)
