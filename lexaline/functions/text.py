"""Text normalisation and extraction, as column expressions.

The normaliser is a table of steps that is folded into one expression; the same table can be rendered for other engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
STOP_WORDS = ("for", "xbi", "and", "in", "th", "on", "sku", "with", "what", "from", "that", "less", "er", "ing")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ENTITIES = (("&amp;", "&"), ("&quot;", "'"), ("&#39;", "'"), ("氓隆", " degrees"), ("聣脹聬", "-"), ("聣脹陋", "'"))
SPELLINGS = (
    ("toliet", "toilet"), ("airconditioner", "air condition"), ("vinal", "vinyl"), ("vynal", "vinyl"), ("skill", "skil"),
    ("snowbl", "snow bl"), ("plexigla", "plexi gla"), ("rustoleum", "rust oleum"), ("whirpool", "whirlpool"),
    ("whirlpoolga", "whirlpool ga"), ("whirlpoolstainless", "whirlpool stainless"), ("edsel", "edsal"), ("guage", "gauge"),
)
#: Words that end in a unit, as alternatives, and the unit they become.
UNITS = (
    ("(?:inches|inch|in|')", "in"),
    ("(?:foot|feet|ft|'')", "ft"),
    ("(?:pounds|pound|lbs|lb)", "lb"),
    (r"(?:square|sq) ?\.?(?:feet|foot|ft)", "sq.ft"),
    (r"lin ?\.?(?:feet|foot|ft)", "lin.ft"),
    (r"(?:doe)? ?(?:cubic|cu) ?\.?(?:feet|foot|ft)", "cu.ft"),
    ("(?:gallons|gallon|gal)", "gal"),
    ("(?:ounces|ounce|oz)", "oz"),
    (r"fl\.? ?oz", "fl.oz"),
    ("(?:centimeters|cm)", "cm"),
    ("(?:milimeters|mm)", "mm"),
    ("(?:degrees|degree)", "deg"),
    ("(?:volts|volt|v)", "volt"),
    ("(?:watts|watt|w)", "watt"),
    ("(?:yd|yds)", "yd"),
    ("(?:amperes|ampere|amps|amp)", "amp"),
)
SAME_UNITS = ("hour", "year", "gauge", "gpm", "psi", "hp", "kw", "qt", "cfm", "cc", "vdc", "btu", "gpf", "grit", "ton", "seer", "tpi", "tvl", "awg", "swe", "mph", "cri", "lumens", "ah")
MEASURED_UNITS = ("in", "ft", "ah", "lb", "sq.ft", "cu.ft", "lin.ft", "gal", "oz", "fl.oz", "cm", "mm", "deg", "volt", "watt", "yd", "amp", "hour", "year", "gauge", "gpm", "psi", "hp", "kw", "qt", "cfm", "cc", "vdc", "btu", "gpf", "grit", "ton", "seer", "tpi", "tvl", "awg", "swe", "mph", "cri", "lumens")
EXTENTS = ("long", "wide", "length", "height", "deep", "thick", "l", "h", "w", "d")
MODEL_NUMBER = r"#*[A-Z]+\d*-?\d+-*[A-Z]*"
SIZE_NUMBER = r"\d+[A-Z]+"


@dataclass(frozen=True)
class Step:
    """One replacement. ``kind`` is 'text' or 'regex'; regex replacements name groups as $1. ``tail`` asks that
    white space or the end follows, which stays."""

    kind: str
    find: str
    put: str
    tail: bool = False


def _text(*pairs: tuple[str, str]) -> list[Step]:
    return [Step("text", a, b) for a, b in pairs]


def _regex(*pairs: tuple[str, str]) -> list[Step]:
    return [Step("regex", a, b) for a, b in pairs]


CLEANING = _text(("  ", " "), *ENTITIES, *SPELLINGS)
PUNCTUATION = [
    *_regex((r"([0-9]),([0-9])", "$1$2")),
    *_text((",", " "), ("$", " "), ("?", " "), (":", " "), ("'", " "), ("-", " "), ("//", "/"), ("..", "."), (" / ", " "), (" \\ ", " "), (".", " . ")),
    *_regex((r"^[./]", ""), (r"[./]$", "")),
]
SPLITTING = [
    *_regex((r"([0-9])([a-z])", "$1 $2"), (r"([a-z])([0-9])", "$1 $2"), (r"\(([\p{L}\p{N}_])", "( $1"), (r"([\p{L}\p{N}_])\)", "$1 )")),
    *_regex((r"([a-z]) *\. *([a-z])", "$1 $2"), (r"([a-z]) */ *([a-z])", "$1 $2"), (r"([0-9]) *\. *([0-9])", "$1.$2")),
    *_text((" . ", " ")),
]
DIMENSIONS = _text((" x ", " xbi "), ("*", " xbi "), (" by ", " xbi "))


def _unit(words: str, unit: str) -> Step:
    return Step("regex", rf"([0-9]+) *{words}\.?", f"$1{unit}. ", tail=True)


MEASURING = [
    *[_unit(w, u) for w, u in UNITS[:11]],
    Step("text", "°", " degrees"),
    *[_unit(w, u) for w, u in UNITS[11:]],
    *[_unit(u, u) for u in SAME_UNITS],
    Step("text", "  ", " "),
]


def apply_steps(text: Column, steps: list[Step]) -> Column:
    for s in steps:
        if s.kind == "text":
            text = F.replace(text, F.lit(s.find), F.lit(s.put))
        else:
            text = F.regexp_replace(text, s.find + (r"(?=\s|$)" if s.tail else ""), s.put)
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row: inside a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens between white space; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def number_words(text: Column) -> Column:
    """Digits for the words zero to nine, token by token."""
    names, digits = F.array(*[F.lit(w) for w in NUMBER_WORDS]), F.array(*[F.lit(str(i)) for i in range(10)])
    return joined(F.transform(F.split(text, " "), lambda w: F.coalesce(F.get(digits, (F.array_position(names, w) - 1).cast("int")), w)))


def normalize_rules(text: Column) -> Column:
    """All steps of the normaliser but stemming; null becomes the empty text."""
    clean = apply_steps(F.lower(F.coalesce(text, F.lit(""))), CLEANING + PUNCTUATION + SPLITTING)
    return joined(tokens(apply_steps(number_words(clean), DIMENSIONS + MEASURING)))


def model_numbers(title: Column) -> Column:
    """Model numbers such as AB-12C, then sizes such as 5A, joined by a space."""
    padded = F.concat(F.lit(" "), F.coalesce(title, F.lit("")))
    found = [F.regexp_extract_all(padded, F.lit(rf"(?<=\s){p}(?=\s|$)"), F.lit(0)) for p in (MODEL_NUMBER, SIZE_NUMBER)]
    return joined(F.concat(*found))


def normalize_model_numbers(text: Column) -> Column:
    steps = _regex((r"([0-9])([a-z])", "$1 $2"), (r"([a-z])([0-9])", "$1 $2"), (r"([a-z]) *\. *([a-z])", "$1 $2"), (r"([a-z]) */ *([a-z])", "$1 $2"), (r"#(\S)", "# $1")) + _text(("-", " "))
    return apply_steps(F.lower(F.coalesce(text, F.lit(""))), steps)


def _stop_list() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def without_stop_words(text: Column) -> Column:
    return joined(F.filter(tokens(text), lambda w: ~F.array_contains(_stop_list(), w)))


def is_meaningful(text: Column) -> Column:
    """Whether any token has more than two characters, other than digits, and is no stop word."""
    return F.exists(tokens(text), lambda w: (F.length(w) > 2) & ~F.rlike(w, F.lit("^[0-9]+$")) & ~F.array_contains(_stop_list(), w))


def measures(text: Column) -> Column:
    """Number and unit combinations of a normalised text, then ratios and percentages."""
    units = "|".join(u.replace(".", r"\.") + r"\." for u in MEASURED_UNITS)
    element = rf"\s#?\d+(?:\s\d+/\d+|(?:[./]\d+)?)(?:{units})?(?:\s(?:{'|'.join(EXTENTS)}))?"
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    patterns = (rf"(?:{element}\s(?:xbi|and))*{element}(?=\s|$)", r"\d+:\d+", r"\d+%")
    return F.concat(*[F.regexp_extract_all(padded, F.lit(p), F.lit(0)) for p in patterns])


def query_measures(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+\S*"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(words, runs)


def bigrams(text: Column) -> Column:
    return ngrams(word_tokens(text), 2)


def exclude(text: Column, listed: Column) -> Column:
    """The text without the tab-separated parts of ``listed``; double spaces squeezed."""
    cut = F.aggregate(F.filter(F.split(listed, "\t"), lambda t: t != ""), text, lambda acc, t: F.replace(acc, t, F.lit("")))
    return F.trim(F.regexp_replace(cut, " +", " "))


def n_words(text: Column) -> Column:
    return F.size(tokens(text))


#: Ends of titles that say nothing of the product; what introduces a qualification, in the order in which it
#: is looked for; and units, numbers and other words that no product's name ends in.
TITLE_ENDINGS = (r"\([^\)]*\)", r"-DISCONTINUED$", r" [Ww]ith .* [Aa]nd .*$", r" [Ff]or .*$", r" [Ii]ncludes .*$", r" [Ww]ithout .*$", r" - .* [Nn]ot [Ii]ncluded\s*$")
SHORT_TAIL = r" - \S+\s*\S*\s*\S*\s*$"
TITLE_CUES = (r" - (?=\D)", r"(?<=\S), ", " [uU]p [tT]o ", ",* [wW]ith ", r"(?<=[^\d\s]) [iI]n ", ",* [wW]ith ")
TITLE_LAST = r"L|W|O\.D\.|OD|O\.C\.|OC|in\.|lb\.|lbs\.|x|\d+[/\d]*|ft\.\.|ft\.|Lumens|CRI|Thick|\+|AWG|oz.|\d+ Gauge|and|\S+-\S+"

TITLE_TAIL = rf"(?:(?:^| )(?:{TITLE_LAST})(?= |$))+$"


def title_prefix_rules(title: Column) -> Column:
    """The title without brackets and trailing qualifications, before the word-by-word cuts of head_phrase()."""
    for p in TITLE_ENDINGS:
        title = F.regexp_replace(title, p, "")
    return F.replace(title, F.lit("  "), F.lit(" "))


def _long_enough(head: Column, title: Column) -> Column:
    """What is left must not be shorter than what goes."""
    return 2 * n_words(head) + 1 >= n_words(title)


def _heads(title: Column, cue: str) -> Column:
    """What stands before each place of the cue, the longest first."""
    parts = F.flatten(F.zip_with(F.split(title, cue, -1), F.regexp_extract_all(title, F.lit(cue), F.lit(0)), lambda part, at: F.array(part, F.coalesce(at, F.lit("")))))

    def of(pieces: Column) -> Column:
        return F.transform(F.sequence(F.size(pieces) - 4, F.lit(0), F.lit(-2)), lambda i: F.array_join(F.slice(pieces, 1, i + 1), ""))

    return F.when(F.rlike(title, F.lit(cue)), F.get(F.transform(F.array(parts), of), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _shortened(title: Column, heads: Column) -> Column:
    """The last head that is reached from the title, each long enough beside the one before."""
    start = F.struct(title.alias("title"), F.lit(True).alias("open"))

    def step(acc: Column, head: Column) -> Column:
        goes = acc["open"] & _long_enough(head, acc["title"])
        return F.struct(F.when(goes, head).otherwise(acc["title"]).alias("title"), goes.alias("open"))

    return F.aggregate(heads, start, step, lambda acc: acc["title"])


def _without_short_tails(title: Column) -> Column:
    """Dashes with up to three words behind them go from the end."""

    def step(acc: Column, _: Column) -> Column:
        head = F.regexp_extract(acc, rf"(?s)^(.*?){SHORT_TAIL}", 1)
        return F.when(F.rlike(acc, F.lit(SHORT_TAIL)) & _long_enough(head, acc), head).otherwise(acc)

    dashes = F.split(title, " - ", -1)
    return F.aggregate(dashes, title, step)


def head_phrase(title: Column) -> Column:
    """The phrase that names the product: qualifications are cut off from the end of the title while enough stays, then
    trailing units, numbers and hyphenated words. A null title has an empty phrase."""

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    phrase = let(title_prefix_rules(F.coalesce(title, F.lit(""))), _without_short_tails)
    for cue in TITLE_CUES:
        phrase = let(phrase, _cut(cue))
    return F.regexp_replace(joined(tokens(phrase)), TITLE_TAIL, "")


def _cut(cue: str) -> Callable[[Column], Column]:
    return lambda t: _shortened(t, _heads(t, cue))


def noun_tags(text: Column) -> Column:
    """Array of (tok, tag) by suffix and word lists: a deterministic tagger, NN unless a rule says otherwise."""

    def tag(w: Column) -> Column:
        return (
            F.when(F.rlike(w, F.lit("^[0-9].*")), "CD")
            .when(w.isin("the", "a", "an", "this", "that", "these", "those"), "DT")
            .when(w.isin("of", "in", "on", "at", "by", "for", "with", "from", "xbi"), "IN")
            .when(w.isin("and", "or", "but"), "CC")
            .when(w == "to", "TO")
            .when(w.isin("is", "are", "was", "be"), "VB")
            .when(F.endswith(w, F.lit("ing")), "VBG")
            .when(F.endswith(w, F.lit("ed")), "VBD")
            .when(F.endswith(w, F.lit("ly")), "RB")
            .when(F.endswith(w, F.lit("ble")) | F.endswith(w, F.lit("ous")) | F.endswith(w, F.lit("ful")), "JJ")
            .when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), "NNS")
            .otherwise("NN")
        )

    return F.transform(tokens(text), lambda w: F.struct(w.alias("tok"), tag(w).alias("tag")))


def nouns(text: Column) -> Column:
    """Tokens tagged NN, in order."""
    return F.transform(F.filter(noun_tags(text), lambda t: t["tag"] == "NN"), lambda t: t["tok"])
