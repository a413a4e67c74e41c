"""Personal data by weak supervision.

Patterns propose candidate spans: the four base kinds with their exact patterns, and wider ones (written-out addresses,
phone numbers without a plus, social security and account numbers, names after a title). Four labelers vote for (1),
against (-1) or abstain (0) on each candidate, each from a source of its own: the form of the value, a gazetteer of name
parts, country codes and reserved numbers, the words before it, and the characters at its borders.
Expectation-maximisation over the counts of all vote patterns in the corpus estimates how reliable each labeler is; the
expected labels train a logistic span classifier over the votes and further features of the span, its length, share of
digits, separators and surroundings, which decides on the wider candidates. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.llm.memory import by_parts

BASE = ("email", "ip", "card", "phone")
WIDER = ("written", "local", "ssn", "iban", "name")
KINDS = BASE + WIDER
LABELERS = ("pattern", "gazetteer", "context", "borders")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before the start could only lead to an attempt that has failed already
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDER = {
    "written": re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63}(?: at | \(at\) |\(at\)|\[at\]| \[at\] )[A-Za-z0-9-]{1,63}(?: dot |\(dot\)|\[dot\]| \(dot\) | \[dot\] )[A-Za-z]{2,10}\b"),
    "local": re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?\b"),
}
#: What must occur in a text before the pattern is tried at all.
_GATE = {"written": re.compile(r"[\[( ]at[\]) ]"), "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b")}
_DIGIT = re.compile("[0-9]")
_CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "written": ("mail", "contact", "write", "reach"),
    "local": ("phone", "call", "tel", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank"),
    "name": ("contact", "dear", "patient", "by"),
}
_AGAINST = ("version", "isbn", "figure", "page", "chapter", "section", "part no")
#: Fixed values of the gazetteer: ends of host names, country codes of account numbers with their lengths, calling codes,
#: and given and family names.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io ai app dev co me tv eu at au be br ca ch cn cz de dk es fi fr gr hk hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za".split())
_IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}
_CALLING = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 94 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 965 966 971 972 974".split())
_NAMES = frozenset(
    "adam alan albert alex alexander alice amanda amy andrea andrew angela ann anna anne anthony antonio barbara ben benjamin brian carl carlos carol caroline catherine charles charlotte chris christian christine christopher claire daniel david deborah dennis diana donald dorothy edward elena elizabeth emily emma eric eva felix frank gary george giovanni grace hannah hans harry helen henry irene isabel jack jacob james jane janet jean jennifer jessica joan joe john jonathan jose joseph joshua juan julia karen karl katherine kevin laura lee lena leo linda lisa louis lucas lucia luis margaret maria mark marta martha martin mary matthew max michael michelle miguel mohammed monica nancy nicole nina olivia oscar pamela patricia patrick paul peter philip rachel ralph raymond rebecca richard robert roger rosa ruth ryan samuel sandra sara sarah scott sean sofia sophie stephen steven susan thomas timothy victor victoria walter william"
    " brown clark davis evans garcia green hall hill jackson johnson jones king lewis lopez martinez miller moore morgan muller nelson nguyen parker perez roberts robinson rodriguez sanchez schmidt schneider smith taylor thompson turner walker white williams wilson wood wright young".split()
)
_NO_NAMES = frozenset("the this that house court school board who what watson's no yes and or of on".split())
#: Characters before a span that the context labeler reads.
CONTEXT = 40


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted; leftmost non-overlapping within a kind."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and _LOCAL.match(text, start - 1):
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _form(kind: str, value: str, digits: str) -> int:
    """The value's own form: checks that need no list."""
    if kind == "email":
        local, host = value.rsplit("@", 1)
        return -1 if local.startswith(".") or local.endswith(".") or ".." in local or "-." in host or host.startswith("-") else 1
    if kind == "ip":
        return -1 if any(len(p) > 1 and p.startswith("0") for p in value.split(".")) else 1
    if kind == "card":
        groups = re.split("[ -]", value)
        return 1 if len(groups) == 1 or len(set(map(len, groups[:-1]))) == 1 else -1
    if kind == "phone":
        return 1 if value.count("(") == value.count(")") and not re.search(r"[.-]{2}|  ", value) else -1
    if kind == "local":
        return 1 if len(set(re.findall("[ .-](?=[0-9])", value))) == 1 else 0
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "iban":
        plain = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "written":
        return 1 if "@" not in value and re.search(r"[(\[]", value) else 0
    return 1 if value.count(" ") > 1 else 0


def _known(kind: str, value: str, digits: str) -> int:
    """What lists say of the value."""
    if kind in ("email", "written"):
        return 1 if re.split(r"[.\s)\]]", value)[-1].lower() in _ENDINGS else -1
    if kind == "ip":
        return -1 if value.startswith(("0.", "255.")) else 1
    if kind == "card":
        return 1 if digits[0] in "3456" else -1
    if kind == "phone":
        return 1 if digits.startswith(_CALLING) else -1
    if kind == "local":
        return -1 if digits[0] in "01" or digits[3] in "01" else 1
    if kind == "ssn":
        return -1 if digits in ("078051120", "219099999", "123456789") else 0
    if kind == "iban":
        return 1 if _IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else -1
    words = [w.lower() for w in re.findall("[A-Za-z]+", value)[1:]]
    return 1 if any(w in _NAMES for w in words) else -1 if any(w in _NO_NAMES for w in words) else 0


def _votes(text: str, kind: str, start: int, end: int) -> tuple[int, int, int, int]:
    value = text[start:end]
    digits = _digits(value)
    before = text[max(0, start - CONTEXT) : start].lower()
    words = re.findall(r"[a-z]+", before)
    context = -1 if any(w in before for w in _AGAINST) else 1 if any(w in words for w in _CUES[kind]) else 0
    touching = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_/#=")) or (end < len(text) and (text[end].isalnum() or text[end] in "_/#="))
    return _form(kind, value, digits), _known(kind, value, digits), context, -1 if touching else 1


def _shape(text: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Classes of the span's length, share of digits and separators, and of what stands before it."""
    value = text[start:end]
    share = 3 * sum(c in "0123456789" for c in value) // len(value)
    marks = sum(not c.isalnum() for c in value)
    last = text[:start][-1:] if start < 2 else text[start - 1]
    return min(3, len(value) // 10), share, min(3, marks // 2), 0 if not last or last == "\n" else 1 if last == " " else 2 if last in ":=(<\"'[" else 3


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, evidence number) of all candidates; wider ones don't overlap base spans or each other."""
    found = [(s, k, e) for s, k, e in base_spans(text)]
    digit = _DIGIT.search(text)
    taken = sorted((s, e) for s, _, e in found)
    for kind, pattern in _WIDER.items():
        gate = _GATE.get(kind)
        if not (gate.search(text) if gate else digit):
            continue
        for m in pattern.finditer(text):
            found.append((m.start(), KINDS.index(kind), m.end()))
    kept, reach, at = [], -1, 0
    for s, k, e in sorted(found):
        if k >= len(BASE):
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if s < reach or (at < len(taken) and taken[at][0] < e):
                continue
            reach = e
        kept.append((s, k, e, evidence(k, _votes(text, KINDS[k], s, e), _shape(text, s, e))))
    return kept


#: Values of each feature of a span, in the order in which the evidence number has them: kind, votes, shape.
RADIX = (len(KINDS), *[3] * len(LABELERS), 4, 4, 4, 4)
SHAPES = 4


def evidence(kind: int, votes: tuple[int, ...], shape: tuple[int, ...]) -> int:
    """One number for what the model knows of a span."""
    number = 0
    for value, size in zip((kind, *[v + 1 for v in votes], *shape), RADIX):
        number = number * size + value
    return number


def _features(numbers: np.ndarray) -> np.ndarray:
    """A row of feature values for each evidence number."""
    return np.stack(np.unravel_index(numbers, RADIX), axis=1)


@dataclass(frozen=True)
class PiiModel:
    """``weights`` has an array for each feature, a weight for each of its values; a span is accepted if their sum isn't
    negative. ``reliability`` is the chance of each vote given the label. Without weights only base spans stay."""

    weights: tuple[tuple[float, ...], ...]
    reliability: np.ndarray

    def accepts(self, number: int) -> bool:
        if not self.weights:
            return False
        total = 0.0
        for w, size in zip(reversed(self.weights), reversed(RADIX)):
            number, value = divmod(number, size)
            total += w[value]
        return total >= 0


def n_evidence() -> int:
    return int(np.prod(RADIX))


def expected_labels(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(chance of label 1 for each row, reliability[labeler, label, vote]) of rows of votes that occur ``n`` times, by
    expectation-maximisation: votes are independent given the label, the share of label 1 is one for each kind."""
    table = np.full((len(LABELERS), 2, 3), 1 / 3)
    truth = 1 / (1 + np.exp(-(votes.sum(axis=1) - 0.5)))  # majority vote to start from
    for _ in range(rounds):
        prior = (np.bincount(kind, n * truth, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
        for j in range(len(LABELERS)):
            for y, share in ((1, truth), (0, 1 - truth)):
                mass = np.bincount(votes[:, j] + 1, n * share, 3) + 1
                table[j, y] = mass / mass.sum()
        logs = np.log(np.stack([1 - prior[kind], prior[kind]], axis=1))
        for j in range(len(LABELERS)):
            logs += np.log(table[j][:, votes[:, j] + 1].T)
        truth = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -30, 30)))
    return truth, table


def fit_counts(counts: dict[int, int], rounds: int = 50) -> PiiModel:
    """Model from the number of candidates of each evidence number. No candidates at all: only base spans stay."""
    if not counts:
        return PiiModel((), np.full((len(LABELERS), 2, 3), 1 / 3))
    numbers = np.array(sorted(counts))
    n = np.array([counts[i] for i in numbers.tolist()], float)
    values = _features(numbers)
    truth, table = expected_labels(values[:, 0], values[:, 1 : 1 + len(LABELERS)] - 1, n, rounds)
    flat = _classifier(_design(values), truth, n)
    ends = np.cumsum(RADIX)
    parts = [flat[1 + e - size : 1 + e] for e, size in zip(ends, RADIX)]
    parts[0] = parts[0] + flat[0]
    return PiiModel(tuple(tuple(p.tolist()) for p in parts), table)


def _design(values: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(values))] + [values[:, f] == v for f, size in enumerate(RADIX) for v in range(size)]
    return np.stack(columns, axis=1).astype(float)


def _classifier(x: np.ndarray, truth: np.ndarray, n: np.ndarray, rounds: int = 50, l2: float = 0.1) -> np.ndarray:
    """Logistic regression on expected labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (p - truth)) + l2 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def candidate_spans(texts: Column) -> Column:
    """Array of structs (start, kind, stop, evidence) of every text; null counts as empty."""

    @F.pandas_udf("array<struct<start:int,kind:int,stop:int,evidence:int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return by_parts(batches, lambda texts: [[{"start": s, "kind": k, "stop": e, "evidence": v} for s, k, e, v in candidates(t or "")] for t in texts])

    return found(texts)


def fit(spans: DataFrame, column: str = "spans") -> PiiModel:
    """Model from all candidates in the array column; the driver gets a count for each evidence number that occurs, of
    which there are a fixed number at most. Null arrays and empty tables have no candidates."""
    rows = spans.select(F.explode(column).alias("s")).groupBy("s.evidence").count().collect()
    return fit_counts({row["evidence"]: row["count"] for row in rows})


def accepted(model: PiiModel, spans: Column) -> Column:
    """The spans that stay: all base ones, and the wider ones that the classifier accepts."""
    if not model.weights:
        return F.filter(spans, lambda s: s["kind"] < len(BASE))

    def total(number: Column) -> Column:
        score, below = F.lit(0.0), n_evidence()
        for w, size in zip(model.weights, RADIX):
            below //= size
            value = F.floor(number / below).cast("int") % size
            score = score + F.element_at(F.array(*[F.lit(x) for x in w]), value + 1)
        return score

    return F.filter(spans, lambda s: (s["kind"] < len(BASE)) | (total(s["evidence"]) >= 0))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def redact(text: str | None, model: PiiModel) -> str | None:
    """The text with ``[KIND]`` in place of every span; where spans overlap, the first covers the rest."""
    if not text:
        return text
    parts, at = [], 0
    for s, k, e, v in candidates(text):
        if k >= len(BASE) and not model.accepts(v):
            continue
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return text if not parts else "".join(parts) + text[at:]


def redacted(model: PiiModel, texts: Column) -> Column:
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return by_parts(batches, lambda texts: [redact(t, model) for t in texts])

    return clean(texts)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """What the query's ``base_sha256`` holds for these (start, kind number, end)."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
