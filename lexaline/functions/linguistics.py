"""Functions that need a loop over a word or a title: stemming, head phrases, segmentation. Arrow-batched."""

from __future__ import annotations

import ctypes
import itertools
import re
import unicodedata
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaline.functions.text import CLEANING, DIMENSIONS, MEASURING, NUMBER_WORDS, PUNCTUATION, SHORT_TAIL, SPLITTING, TITLE_CUES, TITLE_ENDINGS, TITLE_TAIL, Step

#: Values of a batch that are Python objects at a time.
PART = 500
#: Words whose stems a worker remembers, some 100 bytes each.
KNOWN_WORDS = 400_000


def give_back() -> None:
    """Freed memory of Arrow and of the C library goes back to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_VOWELS = "aeiouy"
#: Fixed values of the published English algorithm (Porter 2).
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


_ENDS2, _ENDS3 = (tuple(ending for ending, _ in step) for step in (_STEP2, _STEP3))
_SYLLABLE = re.compile("[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        found = _SYLLABLE.search(w, start)
        return found.end() if found else len(w)

    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), "")
    r1 = len(prefix) if prefix else after(0)
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """Stem of an English word in lower case."""
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    if "y" in w:
        w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for ending in ("'s'", "'s", "'") if "'" in w else ():
        if w.endswith(ending):
            w = w[: -len(ending)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    elif w.endswith(("ingly", "edly", "ing", "ed")):
        for ending in ("ingly", "edly", "ing", "ed"):
            if w.endswith(ending):
                rest = w[: -len(ending)]
                if any(c in _VOWELS for c in rest):
                    w = rest
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for ending, put in _STEP2 if w.endswith(_ENDS2) else ():
        if w.endswith(ending):
            if len(w) - len(ending) >= r1:
                w = w[: -len(ending)] + put
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for ending, put in _STEP3 if w.endswith(_ENDS3) else ():
        if w.endswith(ending):
            if len(w) - len(ending) >= r1:
                w = w[: -len(ending)] + put
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for ending in _STEP4 if w.endswith(_STEP4) else ():
        if w.endswith(ending):
            if len(w) - len(ending) >= r2:
                w = w[: -len(ending)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class _Stems(dict):
    """Stems of the words that a worker has met, forgotten when they are too many; long words are not kept."""

    def __missing__(self, word: str) -> str:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = stem(word)
        if len(word) <= 40:
            self[word] = found
        return found


_STEMS = _Stems()


def stemmed(text: str) -> str:
    return " ".join(map(_STEMS.__getitem__, text.split()))


def _batched(work: Callable[..., str], *texts: Column) -> Column:
    """``work`` over texts, null counted as empty; some hundred values at a time are Python objects."""

    @F.arrow_udf("string")
    def run(*arrays: pa.Array) -> pa.Array:
        made = []
        for at in range(0, len(arrays[0]), PART):
            columns = [[t or "" for t in a.slice(at, PART).to_pylist()] for a in arrays]
            made.append(pa.array(map(work, *columns), pa.string(), size=len(columns[0])))
        out = pa.concat_arrays(made) if made else pa.array([], pa.string())
        del arrays, made
        give_back()
        return out

    return run(*texts)


def stem_words(text: Column) -> Column:
    """Every token stemmed; null becomes the empty text."""
    return _batched(stemmed, text)


# ---- the normaliser's steps on one text, in place of a pass over the text for each of the fifty patterns

_RUN = re.compile("[0-9]+")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_END = r"(?=[ \t\n\x0b\f\r]|[\x85\u2028\u2029]?\Z)"


def _spaced_run(m: re.Match) -> str:
    text, a, b = m.string, m.start(), m.end()
    return f"{' ' if a and 'a' <= text[a - 1] <= 'z' else ''}{m[0]}{' ' if b < len(text) and 'a' <= text[b] <= 'z' else ''}"


def _wordlike(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _after_open(m: re.Match) -> str:
    return "( " if m.end() < len(m.string) and _wordlike(m.string[m.end()]) else "("


def _before_close(m: re.Match) -> str:
    return " )" if m.start() and _wordlike(m.string[m.start() - 1]) else ")"


def _between(text: str, sign: str, low: str, high: str, put: str) -> str:
    """``put`` for each ``sign``, with the spaces around it, that stands between two characters of the range; a character
    that belongs to one match is not the first one of the next."""
    parts = text.split(sign)
    out, begin, taken = [], 0, -1
    for left, right in itertools.pairwise(parts):
        end, first = len(left.rstrip(" ")), len(right) - len(right.lstrip(" "))
        if end and end - 1 != taken and low <= left[end - 1] <= high and first < len(right) and low <= right[first] <= high:
            out += (left[begin:end], put)
            begin = taken = first
        else:
            out += (left[begin:], sign)
            begin, taken = 0, -1
    out.append(parts[-1][begin:])
    return "".join(out)


#: What the patterns of the step tables do, by pattern: the signs without which nothing happens, and the change.
_CHANGES: dict[str, tuple[str, Callable[[str], str]]] = {
    r"([0-9]),([0-9])": (",", partial(re.compile("([0-9]),([0-9])").sub, r"\1\2")),
    r"^[./]": ("", lambda t: t[1:] if t[:1] in (".", "/") else t),
    r"[./]$": ("", partial(re.compile(r"[./](?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)").sub, "")),
    r"([0-9])([a-z])": ("", partial(_RUN.sub, _spaced_run)),  # and the next one
    r"([a-z])([0-9])": ("", lambda t: t),
    r"\(([\p{L}\p{N}_])": ("(", partial(re.compile(r"\(").sub, _after_open)),
    r"([\p{L}\p{N}_])\)": (")", partial(re.compile(r"\)").sub, _before_close)),
    r"([a-z]) *\. *([a-z])": (".", lambda t: _between(t, ".", "a", "z", " ")),
    r"([a-z]) */ *([a-z])": ("/", lambda t: _between(t, "/", "a", "z", " ")),
    r"([0-9]) *\. *([0-9])": (".", lambda t: _between(t, ".", "0", "9", ".")),
}


def _units(steps: list[Step]) -> Callable[[str], str]:
    """One pass for neighbouring unit steps. Each of them matches a whole run of digits and what follows up to the next
    one, and no unit that a step writes is one that a later step reads: of each run the first step that matches counts."""
    units = [s.put.removeprefix("$1") for s in steps]
    bodies = "|".join(f"({s.find.removeprefix('([0-9]+) *').removesuffix('.?')[:-1]})" for s in steps)
    run = re.compile(rf"([0-9]++)(?: *(?:{bodies})\.?{_END})?")

    def change(m: re.Match) -> str:
        return m[1] + units[m.lastindex - 2] if m.lastindex > 1 else m[1]

    return partial(run.sub, change)


def _texts(steps: list[Step]) -> Callable[[str], str]:
    pairs = [(s.find, s.put) for s in steps]

    def change(text: str) -> str:
        for find, put in pairs:
            text = text.replace(find, put)
        return text

    return change


def _compiled(steps: list[Step]) -> list[tuple[str, Callable[[str], str]]]:
    """(sign, change) of each group of neighbouring steps; a change applies to texts that have the sign."""
    made = []
    for (kind, tail, _), group in itertools.groupby(enumerate(steps), lambda x: (x[1].kind, x[1].tail, x[0] if x[1].kind == "regex" and not x[1].tail else -1)):
        group = [s for _, s in group]
        made.append(("", _units(group)) if tail else ("", _texts(group)) if kind == "text" else _CHANGES[group[0].find])
    return made


_BEFORE = _compiled(CLEANING + PUNCTUATION + SPLITTING)
_AFTER = _compiled(DIMENSIONS + MEASURING)
_DIGITS = {w: str(i) for i, w in enumerate(NUMBER_WORDS)}


def _ruled(text: str) -> str:
    for sign, change in _BEFORE:
        if sign in text:
            text = change(text)
    text = " ".join([_DIGITS.get(w, w) for w in text.split(" ")])
    for sign, change in _AFTER:
        if sign in text:
            text = change(text)
    return text


def rule_form(text: str) -> str:
    """:func:`lexaline.functions.text.normalize_rules` of a text in lower case."""
    return " ".join(w for w in _BLANKS.split(_ruled(text)) if w)


def normal_form(text: str) -> str:
    """Steps of :func:`lexaline.functions.text.normalize_rules` on a text in lower case, then stems."""
    return stemmed(_ruled(text))


def normalize_rules(text: Column) -> Column:
    """Arrow-batched twin of the native function."""
    return _batched(rule_form, F.lower(text))


def normalize(text: Column) -> Column:
    """The normaliser and stemmer of a text, in one pass of a Python worker."""
    return _batched(normal_form, F.lower(text))


def head_of(title: str) -> str:
    """The same as :func:`lexaline.functions.text.head_phrase`, for one text."""

    def enough(head: str, whole: str) -> bool:
        return 2 * len(head.split()) + 1 >= len(whole.split())

    for ending in TITLE_ENDINGS:
        title = re.sub(ending, "", title)
    title = title.replace("  ", " ")
    while (tail := re.search(SHORT_TAIL, title)) and enough(title[: tail.start()], title):
        title = title[: tail.start()]
    for cue in TITLE_CUES:
        shorter = [title, *(title[: m.start()] for m in reversed([*re.finditer(cue, title)]))]
        steps = itertools.takewhile(lambda pair: enough(pair[1], pair[0]), itertools.pairwise(shorter))
        title = shorter[sum(1 for _ in steps)]
    return re.sub(TITLE_TAIL, "", " ".join(title.split()))


def head_phrase(title: Column) -> Column:
    """Arrow-batched twin of the native function, for texts that other Arrow-batched functions go on with: their planner
    rule can't take expressions of nested functions above a join."""

    return _batched(head_of, title)


def split_by(query: str, title: str) -> str:
    """Query words of over three letters split greedily into title words of over two; a remainder stays as a word."""
    parts = sorted({w for w in title.split() if len(w) > 2}, key=lambda w: (-len(w), w))
    out = []
    for word in query.split():
        rest, found = word, []
        while len(word) > 3 and rest:
            head = next((p for p in parts if rest.startswith(p)), None)
            if head is None:
                break
            found.append(head)
            rest = rest[len(head) :]
        if rest and not (found and rest in ("er", "ing", "s", "less")):
            found.append(rest)
        out += found
    return " ".join(out)


def segment(query: Column, title: Column) -> Column:
    return _batched(split_by, query, title)
