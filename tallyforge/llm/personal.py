"""Personal details in free text: found, and replaced by typed placeholders.

High-recall generators propose overlapping spans of each kind; no list of words keeps a span from being proposed. Boosted
trees, one model a kind, judge a span by its own form and by its context; thresholds come from held-out rows; of
overlapping spans the likelier, then longer, stays. The models are fitted on `TRAIN_TEXTS` labelled texts made by
personal_samples, whose sentences are its own. Card and account numbers count as identity numbers and are proposed only
if their check digits hold.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.boosting import BoostedTrees, best_threshold
from tallyforge.llm.personal_samples import luhn, sample_texts

KINDS = ("email", "phone", "id", "address", "name")
_EMAIL_KIND, _PHONE_KIND, _ID_KIND, _ADDRESS_KIND, _NAME_KIND = range(5)

#: Features of a span; characters from which on texts are judged apart from those before, which bounds the arrays.
FEATURES, CHUNK = 35, 1_000_000

#: Bound of the labelled sample the models are fitted on, and of the held-out rows for the thresholds.
TRAIN_TEXTS, HELD_OUT_TEXTS = 6000, 1500

# --- generators -----------------------------------------------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|a)\s?[\])}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)"
#: What stands for a full stop in the part before the sign; a plain one belongs to its words.
_SPELLED = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![\w.+\-@])[A-Za-z0-9][A-Za-z0-9.+_\-]*+(?:{_SPELLED}[A-Za-z0-9.+_\-]++)*+{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+(?![\w@])", re.I)
_DIGITS = re.compile(r"(?<![\w.+(@/#\-])\+?\(?\d+\)?(?:(?: ?\(0\) ?|[ .\-]|\) |/(?=\d))\(?\d+\)?)*(?![\w@]|[.\-]\d)")
_CODE = re.compile(r"(?<![\w./@+\-])(?=(?:[A-Z]*\d){5})[A-Z0-9]{6,20}(?![\w@/\-])|(?<![\w./@+\-])[A-Z]{2} \d\d \d\d \d\d [A-Z](?![\w@])")
_CARD = re.compile(r"(?<![\w.+@/#\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?![\w@/\-])")
_IBAN = re.compile(r"(?<![\w./@+\-])[A-Z]{2}\d\d(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\w@/])")
#: Capitals of the scripts that have them, and letters of those that don't.
_UPPER = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x590)) if c.isupper())
_UPPER_SET = set(_UPPER[3:]) | set(map(chr, range(ord("A"), ord("Z") + 1)))
_CASELESS = "֐-ࣿऀ-๿ぁ-ヿ㐀-鿿가-힯"
_TYPES = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Way|Terrace|Ter|Boulevard|Blvd|Court|Ct|Square|Sq|Place|Pl|Crescent|Cres|Grove|Row|Parkway|Pkwy|Highway|Hwy|Walk|Mews)"
_HOUSE = re.compile(rf"(?<![\w#./@\-])\d{{1,5}}[A-Za-z]? (?:[{_UPPER}][\w’'\-]* ){{1,4}}?{_TYPES}\b\.?(?:,? (?:#\d+|(?:Flat|Unit|Apt|Suite)\.? \d+\w?))?(?:, [{_UPPER}][\w’'\-]+(?:,? [A-Z]{{2}})?(?: \d{{5}})?)?")
_STREET = re.compile(rf"(?<![\w/@.])(?:(?:[{_UPPER}][\w’'\-]+\s){{0,3}})[{_UPPER}][\w’'\-]*\.? \d{{1,4}}[a-zA-Z]?, \d{{4,5}} [{_UPPER}][\w’'\-]+|(?<![\w/@.])[{_UPPER}]\w*(?:straße|strasse|str\.|weg|allee|kamp|gasse|platz|ring|damm|ufer) \d{{1,4}}[a-zA-Z]?(?!\w)")
#: A search that begins with a set of characters skips the others fast, so what may not stand before is looked up after.
_WORD = re.compile(rf"[{_UPPER}](?<![\w@/’'.+\-].)(?:\.|[\w]*(?:[’'\-][{_UPPER}]?\w+)*)(?![\w@/])")
_UNCASED = re.compile(rf"(?<![\w@/])[{_CASELESS}]+(?: [{_CASELESS}]+){{0,2}}(?![\w@/])")
#: Small words inside a name.
_PARTICLES = "van von de da del della di la le bin ibn der den ten af dos al".split()
_PARTICLE, _PARTICLE_FIRST = re.compile(rf"(?: (?:{'|'.join(_PARTICLES)}))+ "), {p[0] for p in _PARTICLES}
_TOKEN, _TOKEN_PART = re.compile(r"[\w’'\-@.+/#&]+|[^\w\s]"), re.compile(r"[\w’'\-@.+/#&]")

# --- words that say something about their neighbours ------------------------------------------------------------------

_CUES = {
    1: "tel telephone phone mobile mob cell call ring fax m t p whatsapp",
    2: "ssn passport ni nino insurance id card licence license national file identity permit visa social number no nr document iban account",
    3: "ticket order build release version loaded invoice issue case sku kept port page room batch job commit parcel shipment serial bug isbn",
    4: "address home lives live post resident residence based living deliver moved",
    5: "mentored coached taught supervised supervisor managed manager reported name vitae cv resume résumé quote quoted ref reference references contact referee signed author interviewed met patient cc attn emergency kin covered present minutes",
    6: "mr ms mrs miss dr prof professor sir mx",
    7: "to from of with by at for and via on in under",
    8: "the a an our their this that these",
    16: "dear hi hello hey",
    17: "regards wishes sincerely yours cheers thanks greetings",
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws.split()}
_TITLES = set(_CUES[6].split())
#: Cues after which one word alone is proposed as a name.
_LONE = {5, 6, 16, 17}
_LONE_CUES = {w for w, k in _CUE.items() if k in _LONE}
_ORG = set("labs lab claims logistics health partners retail energy robotics mutual service services bank group institute university college school inc ltd gmbh llc corp company systems technologies society council office desk foundation agency holdings insurance media software industries capital ventures consulting data foods airways motors telecom press publishing solutions works".split())
_POST = set("engineer engineering scientist manager analyst developer senior junior lead staff principal architect designer writer administrator specialist advocate consultant director head intern student engr eng mgr dev sr jr snr jnr prin princ bsc msc phd ba ma mba reliability site machine learning full stack forward deployed computer vision business product program platform security research applied frontend backend mobile cloud network embedded knowledge prompt evaluation annotation solutions database technical ux qa nlp ai devops career break owner volunteer tester".split())
_TOPIC = set("python java go rust sql kafka spark ray redis docker kubernetes airflow snowflake terraform grafana postgres fastapi pytorch triton dbt elasticsearch typescript graphql grpc linux bash mlflow opentelemetry pandas lora rag oauth2 bayesian node.js ci cd etl tcp ip german english french languages skills tools methods stack summary experience education references personal details profile projects interests january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday present current summary email phone address national insurance driving licence passport curriculum vitae".split())
#: Common given names of many countries; the made texts use some of these and as many that aren't here.
_GIVEN = set("aaron adam ahmed aisha alan alex ali alice amir amy ana andrea andrew anna anne antonio arun asha ben bruno carl carla carlos carmen charles chen chloe clara claire dan daniel david diana dmitri elena eli elif elsa emil emily emma eric erik esther eva fatima felix fiona frank gabriel george grace greta hana hannah hans hassan helen henry hugo ian ibrahim igor ines ingrid irene isaac isabel ivan jack jacob jakob james jan jane jean jens joan joe john jon jonas jose joseph juan judith julia karen karl kate katya kevin kim kofi lars laura lee lena leo liam lily lin linda lucas lucia luis luke maja marco maria marie mark marta martin mary matteo maya mehmet mei michael miguel mina mohamed mona nadia nina noah nora olga oliver omar oscar otto pablo patricia paul pedro peter petra pia priya rachel rafael raj ravi rebecca rita rob robert rosa ruth sam samuel sara sarah sofia stefan steve sven tara theo thomas tom uma vera victor walter wei will yusuf zoe".split())
#: Endings of words that are seldom names.
_ENDS = {e: k for k, es in {1: "ing tion sion ment ness ity ance ence ics logy ware ship dom hood", 2: "ive ous ful able"}.items() for e in es.split()}
_SECTIONS = {"summary": 2, "profile": 2, "experience": 3, "work": 3, "employment": 3, "projects": 3, "skills": 4, "languages": 4, "education": 5, "references": 6, "referees": 6, "personal": 7, "details": 7}
_RANGE = re.compile(r"\b(?:19|20)\d\d\b.*(?:[-–—]|\bto\b).*(?:\b(?:19|20)\d\d\b|present|current|now)", re.I)


@functools.lru_cache(maxsize=100_000)
def _cue(w: str) -> int:
    if not w:
        return 0
    low = w.lower().strip(".:")
    if low in _CUE:
        return _CUE[low]
    if low in _ORG:
        return 9
    if low in _POST and w not in ("Ma", "Ba", "Dev"):  # names, unlike MA, BA and dev
        return 10
    if low in _TOPIC:
        return 11
    if w[0].isdigit():
        return 12
    if w[0].isupper():
        return 13
    return 14 if w[0].isalpha() else 15


@functools.lru_cache(maxsize=100_000)
def _form(w: str) -> int:
    """What a word's spelling says: 1 a common given name, 2 an initial, 3 or 4 an ending, else 0."""
    low = w.lower().strip(".")
    if low in _GIVEN:
        return 1
    if len(low) == 1:
        return 2
    found = next((_ENDS[low[-k:]] for k in (4, 3, 2) if len(low) > k + 2 and low[-k:] in _ENDS), 0)
    return found + 2 if found else 0


@functools.lru_cache(maxsize=10_000)
def _char(c: str) -> int:
    if not c:
        return 0
    for k, chars in enumerate((" \t\xa0", ":", "-–—•▪|*·>", "/", ",;", ".", "()[]", "\"'“”’<"), 1):
        if c in chars:
            return k
    return 10 if c.isdigit() else 11 if c.isalpha() else 12


#: What every street with a number behind it has.
_FRONT, _MAYBE_STREET = re.compile(r"^\W+|\W+$"), re.compile(r"\d(?:[a-zA-Z]?, \d{4}|(?<=(?:raße|asse|str\.|llee|kamp|latz|ring|damm|ufer) .)|(?<=weg .))")
_INITIAL, _GROUPS, _LETTERS, _SEPS = re.compile(rf"(?<!\w)[{_UPPER}]\."), re.compile(r"\d+"), re.compile(r"[^\W\d_][\w’'.\-]*"), re.compile(r"(?<=\d)\D(?=\d)")
_WORD_AT, _TIGHT, _BRACKET, _LINK = re.compile(r"\bat\b|\ba\b", re.I), re.compile(r"\S@\S"), re.compile(r"[\[({]"), re.compile(r"://|www\.|\w\.[a-z]{2,}/\w")


def iban_holds(code: str) -> bool:
    """Whether the check digits of an account number hold."""
    plain = code.replace(" ", "")
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _codes(text: str) -> tuple[np.ndarray, list[int]]:
    """The characters as numbers, and which occur."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.flatnonzero(np.bincount(code)).tolist()


def _among(present: list[int], holds) -> np.ndarray:
    """For each character's number whether it holds."""
    out = np.zeros(present[-1] + 1, bool)
    out[[k for k in present if holds(chr(k))]] = True
    return out


def _last(where: np.ndarray) -> np.ndarray:
    """For each place the last one up to it, -1 before the first."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where), dtype=np.int32), np.int32(-1)))


def _name_spans(text: str, code: np.ndarray, present: list[int], first: np.ndarray) -> np.ndarray:
    """Rows (start, end, generator) of every run of two or three words that may be a name, and of one after a cue."""
    start, end = np.array([x for m in _WORD.finditer(text) for x in m.span()], np.int64).reshape(-1, 2).T
    short = _among(present, lambda c: c in "MDPS")[code[start]] & (end - start < 10)
    title = np.zeros(len(start), bool)
    for k in np.flatnonzero(short).tolist():
        title[k] = text[start[k] : end[k]].lower().strip(".") in _TITLES
    after = np.append(start[1:], len(text))
    blank = code[end] == ord(" ")
    comma = (after - end == 2) & (code[end] == ord(",")) & (code[end + 1] == ord(" "))
    joined = blank & (after - end == 1)
    for k in np.flatnonzero(blank & (after - end > 3) & _among(present, lambda c: c in _PARTICLE_FIRST)[code[end + 1]]).tolist():
        joined[k] = bool(_PARTICLE.fullmatch(text, end[k], after[k]))
    two = np.flatnonzero((joined | comma) & ~title)
    initial = (end[two + 1] - start[two + 1] == 2) & (code[end[two + 1] - 1] == ord("."))
    three, two = two[joined[two + 1]], two[comma[two] | ~initial]

    long = np.flatnonzero(~title & (end - start > 1))
    low = np.maximum(first[np.searchsorted(first, start[long], "right") - 1], start[long] - 24)  # where to look for a cue
    b = _last(~_among(present, lambda c: c in " ,:\t")[code])[start[long] - 1] + 1
    a = np.maximum(low, _last(code == ord(" "))[b - 1] + 1)
    one = long[[x < y and text[x:y].lstrip("(\"“>").lower().strip(".:") in _LONE_CUES for x, y in zip(a.tolist(), b.tolist())]] if len(long) else long

    word = np.concatenate([two, three, one])
    out = np.column_stack([start[word], np.concatenate([end[two + 1], end[three + 2], end[one]]), np.concatenate([7 + 2 * comma[two], 8 + 2 * comma[three], np.full(len(one), 11)])])
    return out[np.lexsort([np.repeat([0, 1, 2], [len(two), len(three), len(one)]), word])]


def _other_spans(line: str, email: bool, digits: bool, house: bool, street: bool, uncased: bool) -> dict[tuple[int, int, int], int]:
    """(number of the kind, start, end) of the other spans of a line, with their generators, of those that may find any."""
    spans: dict[tuple[int, int, int], int] = {}
    if email and ("." in line or "dot" in line.lower()):
        for m in _EMAIL.finditer(line):
            spans[_EMAIL_KIND, m.start(), m.end()] = 1
    if digits:
        for m in _DIGITS.finditer(line):
            if 7 <= sum(map(str.isdigit, m.group())) <= 15:
                spans[_PHONE_KIND, m.start(), m.end()] = 2
                spans[_ID_KIND, m.start(), m.end()] = 3
        for m in _CODE.finditer(line):
            spans[_ID_KIND, m.start(), m.end()] = 4
        for m in _CARD.finditer(line):
            if luhn("".join(_GROUPS.findall(m.group()))):
                spans[_ID_KIND, m.start(), m.end()] = 13
        for m in _IBAN.finditer(line):
            if iban_holds(m.group()):
                spans[_ID_KIND, m.start(), m.end()] = 14
    if house:
        for m in _HOUSE.finditer(line):
            spans[_ADDRESS_KIND, m.start(), m.end()] = 5
    if street and _MAYBE_STREET.search(line):
        for m in _STREET.finditer(line):
            spans[_ADDRESS_KIND, m.start(), m.end()] = 6
    if uncased:
        for m in _UNCASED.finditer(line):
            spans[_NAME_KIND, m.start(), m.end()] = 12
    return spans


def _three(x, y, z) -> np.ndarray:
    """Three characters as one number."""
    return (np.asarray(x, np.int64) << 42) | (np.asarray(y, np.int64) << 21) | np.asarray(z, np.int64)


#: The last letters of the words that _MAYBE_STREET knows.
_STREET_ENDS = np.array([_three(*map(ord, e)) for e in ("aße", "sse", "tr.", "weg", "lee", "amp", "atz", "ing", "amm", "fer")])


def _lookups(code: np.ndarray, present: list[int], line: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers of the lines in which _other_spans may find what its arguments say, from few characters of theirs."""
    a, t = (_among(present, lambda c, x=x: c in x)[code] for x in ("aA", "tT"))
    close = _among(present, lambda c: c in "])} ")[code]
    k = np.flatnonzero(a[1:-3] & _among(present, lambda c: c in "[({ ")[code[:-4]])
    k = k[close[k + 2] | (t[k + 2] & close[k + 3])]
    yield np.concatenate([line[code == ord("@")], line[k]])
    digit = _among(present, str.isdecimal)[code]
    d = np.flatnonzero(digit)
    run = np.flatnonzero(np.convolve(np.diff(d) <= 4, np.ones(4, np.int64), "valid") == 4) if len(d) > 4 else d[:0]  # five digits, at most three characters between them
    yield line[d[run[line[d[run]] == line[d[run + 4]]]]]
    q = d + _among(present, lambda c: c.isascii() and c.isalpha())[code[d + 1]]
    yield line[d[(code[q + 1] == ord(" ")) & _among(present, _UPPER_SET.__contains__)[code[q + 2]]]]
    listed = (code[q + 1] == ord(",")) & (code[q + 2] == ord(" ")) & digit[q + 3] & digit[q + 4] & digit[q + 5] & digit[q + 6]
    after = d[code[d - 1] == ord(" ")]
    after = after[np.isin(_three(code[after - 4], code[after - 3], code[after - 2]), _STREET_ENDS)]
    yield line[np.concatenate([d[listed], after])]
    yield line[_among(present, lambda c: bool(_UNCASED.match(c)))[code]]


def proposed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of every proposed span (number of the text, number of the kind, start, end), from 0, and its features."""
    text = "\n".join(["", *(t or "" for t in texts), "\n" * 8])  # line feeds around: no place looked at is outside
    code, present = _codes(text)
    feeds = np.flatnonzero(code == ord("\n"))[:-8]
    first, size = feeds[:-1] + 1, np.diff(feeds) - 1  # of each line
    begin = np.concatenate([[0], np.cumsum([1 + t.count("\n") if t else 1 for t in texts])]).astype(np.int64)  # the first line of each text
    of_text = np.repeat(np.arange(len(texts)), np.diff(begin))

    section = np.zeros(len(first), np.int64)
    section[begin[:-1]] = 1
    small = np.append(np.cumsum(_among(present, str.islower)[code], dtype=np.int32), 0)
    for k in np.flatnonzero((size > 0) & (size < 40) & (small[first + size] == small[first - 1])).tolist():
        line = text[first[k] : first[k] + size[k]]
        if line.isupper():
            section[k] = next((_SECTIONS[w] for w in _FRONT.sub("", line).lower().split() if w in _SECTIONS), section[k])
    section = section[_last(section > 0)]

    looked = np.zeros((len(first), 5), bool)
    for k, lines in enumerate(_lookups(code, present, np.cumsum(code == ord("\n"), dtype=np.int32) - 1)):
        looked[lines, k] = True
    rest = [(n, kind, a, b, g, kind == _NAME_KIND) for n in np.flatnonzero(looked.any(axis=1)).tolist() for (kind, a, b), g in _other_spans(text[first[n] : first[n] + size[n]], *looked[n].tolist()).items()]
    a, b, generator = _name_spans(text, code, present, first).T
    n = np.searchsorted(first, a, "right") - 1
    names = np.column_stack([n, np.full(len(n), _NAME_KIND), a - first[n], b - first[n], generator, np.zeros(len(n), np.int64)])
    found = np.concatenate([np.array(rest, np.int64).reshape(-1, 6), names])
    found = found[np.lexsort([found[:, 5], found[:, 1] == _NAME_KIND, found[:, 0]])]  # by line: the others as found, then names, those without case last
    n, kind, a, b, generator, _ = found.T.copy()
    if not len(n):
        return np.zeros((0, 4), np.int64), np.zeros((0, FEATURES), np.uint8)

    used, n = np.unique(n, return_inverse=True)  # the lines with spans
    of, section, number = of_text[used], section[used], np.minimum(used - begin[of_text[used]], 9)
    at = first[used] - first[begin[of]]
    lines = [text[x:y] for x, y in zip(first[used].tolist(), (first[used] + size[used]).tolist())]
    signs = [("@" in x) + 2 * (("/" in x or "www." in x) and bool(_LINK.search(x))) for x in lines]
    ranges = [("20" in x or "19" in x) and bool(_RANGE.search(x)) for x in lines]
    extra = np.column_stack([number, section, signs, ranges, np.minimum(size[used] // 12, 31)])

    name = kind == _NAME_KIND
    forms: dict[tuple[str, bool] | str, int] = {}  # equal ones are looked at once
    form = [forms.setdefault(x if is_name else (x,), len(forms)) for x, is_name in zip((text[x:y] for x, y in zip((first[used][n] + a).tolist(), (first[used][n] + b).tolist())), name.tolist())]
    own = np.array([_form_of(f, True) if isinstance(f, str) else _form_of(*f, False) for f in forms], np.uint8)[form]
    near, own[name, 14], own[name, 15] = _context(lines, n, a, b, name)
    places = np.column_stack([of[n], kind, at[n] + a, at[n] + b])
    return places, np.column_stack([generator, own[:, 0], *near[:9], extra[n], *near[9:], own[:, 1:]]).astype(np.uint8)


def _context(lines: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray, name: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What stands around each span (number of its line, start, end): the features, and for names whether a capitalised
    word and a blank stand before, and a capitalised word behind."""
    text = "\n".join(["", *lines, "\n\n\n"])  # the lines as one, ended by line feeds, which stand nowhere else
    code, present = _codes(text)
    char, token, word, alnum = (np.zeros(present[-1] + 1, np.uint8) for _ in range(4))
    for k in present:
        c = chr(k)
        char[k], token[k], word[k], alnum[k] = 0 if c == "\n" else _char(c), 1 if _TOKEN_PART.match(c) else 0 if c.isspace() else 2, c in "._" or c.isalnum(), c.isalnum()
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    first = 1 + np.concatenate([[0], np.cumsum(size + 1)])  # of each line, and behind the last
    size, a_at, b_at = size[n], first[n] + a, first[n] + b

    kinds = token[code]
    part, single = kinds == 1, kinds == 2
    starts, ends = np.flatnonzero(single[1:] | (part[1:] & ~part[:-1])) + 1, np.flatnonzero(single[:-1] | (part[:-1] & ~part[1:])) + 1
    cue = np.fromiter(map(_cue, _TOKEN.findall(text)), np.uint8, len(starts))
    i, j, bounds = np.searchsorted(ends, a_at, "right"), np.searchsorted(starts, b_at), np.searchsorted(starts, first)  # the tokens before i end before the span, those from j follow it
    low, high = bounds[n], bounds[n + 1]
    words = np.flatnonzero(alnum[code[starts]])
    word_cue, words = np.concatenate([[0, 0, 0], cue[words], [0]]), np.concatenate([[-1, -1, -1], words, [len(starts)]])
    w, after, least = np.searchsorted(words, i), np.searchsorted(words, j), np.maximum(low, i - 8)
    near = [
        *(np.where(words[w - k] >= least, word_cue[w - k], 0) for k in (1, 2, 3)), np.where(i > low, cue[i - 1], 0), char[code[a_at - 1]], np.where(a > 1, char[code[a_at - 2]], 0), char[code[b_at]], np.where(b < size, char[code[b_at + 1]], 0),
        np.where(words[after] < np.minimum(high, j + 6), word_cue[after], 0), np.minimum(10 * (b - a) // size, 10), np.minimum(i - low, 9),
    ]

    capital = (code >= ord("A")) & (code <= ord("Z"))
    last_capital, last_gap = _last(capital), _last(word[code] == 0)
    a_at, b_at, a = a_at[name], b_at[name], a[name]
    before = (code[a_at - 1] == ord(" ")) & (a > 1) & (last_capital[a_at - 2] > np.maximum(last_gap[a_at - 2], a_at - 25))
    b_at = b_at + (code[b_at] == ord(","))
    b_at += code[b_at] == ord(" ")
    return near, before, capital[b_at] & (code[b_at + 1] >= ord("a")) & (code[b_at + 1] <= ord("z"))


@functools.lru_cache(maxsize=100_000)
def _form_of(own: str, name: bool) -> tuple[int, ...]:
    """The features that follow from a span alone, none over 31; the 14th and 15th of a name are left for what stands around it."""
    toks = _LETTERS.findall(own)
    cues = [_cue(t) for t in toks]
    counts = (min(cues.count(9), 31), min(cues.count(10), 31), min(cues.count(11), 31))
    if name:
        return (
            min(len(own), 31), int(own.isupper()), min(len(toks), 31), int(bool(_INITIAL.search(own))), int(", " in own), *counts, cues[0] if cues else 0, cues[-1] if cues else 0, _form(toks[0]) if toks else 0, _form(toks[-1]) if toks else 0,
            min(len(toks[0]) if toks else 0, 15), min(len(toks[-1]) if toks else 0, 15), 0, 0, 0, 0,
        )
    groups = _GROUPS.findall(own)
    sizes, seps = [len(g) for g in groups] or [0], set(_SEPS.findall(own))
    return (
        min(len(own), 31), int(own.isupper()), min(sum(sizes), 31), min(len(groups), 9), min(len(toks), 9), (5 if own[0] == "+" else 4 if own[0] == "(" else 3 if own[0].isdigit() else 2 if own[0].islower() else 1), *counts, cues[-1] if cues else 0,
        min(max(sizes), 15), min(sizes[0], 15), min(sizes[-1], 15), (0 if not seps else 1 if seps == {" "} else 2 if seps == {"."} else 3 if seps == {"-"} else 4 if seps == {"/"} else 5),
        int(bool(toks) and len(toks[-1]) == 2 and toks[-1].isupper()), min(len(toks[-1]) if toks else 0, 15), int(", " in own),
        (0 if "@" not in own and not _WORD_AT.search(own) else 1 if _TIGHT.search(own) else 2 if "@" in own else 3 if _BRACKET.search(own) else 4),
    )


def candidates(text: str) -> list[tuple[str, int, int, tuple]]:
    """(kind, start, end, features) of every proposed span, from 0."""
    places, x = proposed([text])
    return [(KINDS[k], a, b, tuple(f)) for (_, k, a, b), f in zip(places.tolist(), x.tolist())]


@functools.lru_cache(maxsize=2)
def models(train: int = TRAIN_TEXTS, held_out: int = HELD_OUT_TEXTS) -> dict[str, tuple[BoostedTrees, float]]:
    """A model and a threshold for each kind. A span counts as true if it begins where a detail of its kind does."""
    rows: dict[bool, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
    for part, n, seed in ((True, train, 11), (False, held_out, 23)):
        sample = sample_texts(n, seed)
        ends = [{(k, a): b for k, a, b in spans} for _, spans in sample]
        places, x = proposed([text for text, _ in sample])
        true = np.array([float(b == ends[t].get((KINDS[k], a)) if k == _NAME_KIND else (KINDS[k], a) in ends[t]) for t, k, a, b in places.tolist()])
        rows[part] = {kind: (x[own], true[own]) for k, kind in enumerate(KINDS) for own in [places[:, 1] == k]}
    out = {}
    for k in KINDS:
        model = BoostedTrees().fit(*rows[True][k])
        hx, hy = rows[False][k]
        out[k] = (model, best_threshold(model.probability(hx), hy))
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in parts of about CHUNK characters or one text, each with the number of its first."""
    begin = held = 0
    for n, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= CHUNK:
            yield begin, texts[begin : n + 1]
            begin, held = n + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def find_details(texts: list[str | None], fitted: dict[str, tuple[BoostedTrees, float]]) -> list[list[tuple[str, int, int]]]:
    """Per text the chosen (kind, start, end), from 0, in order and without overlap."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for begin, part in _chunks(texts):
        places, x = proposed(part)
        scored: dict[int, list[tuple[float, int, int, str]]] = {}
        for number, kind in enumerate(KINDS):
            own = np.flatnonzero(places[:, 1] == number)
            if len(own):
                model, threshold = fitted[kind]
                rows, which = np.unique(x[own].view(f"V{FEATURES}").ravel(), return_inverse=True)  # equal features are judged once
                judged = model.probability(rows.view(np.uint8).reshape(-1, FEATURES))[which]
                good = judged >= threshold
                for p, (t, _, a, b) in zip(judged[good].tolist(), places[own[good]].tolist()):
                    scored.setdefault(begin + t, []).append((round(p, 1), b - a, a, kind))
        for t, found in scored.items():
            kept: list[tuple[str, int, int]] = []
            for _, size, a, kind in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
                if all(a + size <= s or a >= e for _, s, e in kept):
                    kept.append((kind, a, a + size))
            out[t] = sorted(kept, key=lambda x: x[1])
    return out


def personal_details(df: DataFrame, key: str, text: str, train: int = TRAIN_TEXTS, held_out: int = HELD_OUT_TEXTS) -> DataFrame:
    """Rows (key, kind, char_start, char_end): every detail found, characters counted from 1, the end included.

    Null and empty texts hold nothing, repeated rows count once, a key with several texts gives the details of each.
    Texts are searched whole, line by line. Empty input gives no rows; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(models(train, held_out))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = find_details(list(b["t"]), sent.value)
            rows = [(k, kind, a + 1, e) for k, spans in zip(b["k"], found) for kind, a, e in spans]
            yield pd.DataFrame(rows, columns=["k", "kind", "char_start", "char_end"]).astype({"k": b["k"].dtype, "char_start": "int32", "char_end": "int32"})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & (F.length("t") > 0))
    out = rows.mapInPandas(scan, f"k {dict(df.dtypes)[key]}, kind string, char_start int, char_end int").distinct()
    return out.withColumnRenamed("k", key)


def redacted(df: DataFrame, key: str, text: str, train: int = TRAIN_TEXTS, held_out: int = HELD_OUT_TEXTS) -> DataFrame:
    """Rows (key, clean_text, details): the text with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] in place of the
    details, the rest unchanged, and their number. Null texts stay null; repeated rows come out once."""
    sent = df.sparkSession.sparkContext.broadcast(models(train, held_out))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["t"])
            found = find_details(texts, sent.value)
            clean = []
            for t, spans in zip(texts, found):
                for kind, a, e in reversed(spans):
                    t = f"{t[:a]}[{kind.upper()}]{t[e:]}"
                clean.append(t)
            yield pd.DataFrame({"k": b["k"], "clean_text": clean, "details": [len(s) for s in found]}).astype({"details": "int32"})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull())
    return rows.mapInPandas(scan, f"k {dict(df.dtypes)[key]}, clean_text string, details int").distinct().withColumnRenamed("k", key)
