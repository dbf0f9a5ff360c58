"""Operator 6, personal data by weak supervision.

Base rules find e-mail addresses, IPv4 addresses, card and phone numbers; what they find
always stays.  More candidates of the four kinds are proposed: what the strict checks refuse
(numbers failing Luhn or too short for a card, dotted quads beyond 255, phone numbers of too many
digits), and matches of wider patterns (written-out addresses, national phone numbers with or
without separators, IPv6 addresses).  Five labelers vote on every candidate, base matches included: the strict pattern, a validity rule, a gazetteer, the
words before it and the characters at its edges.  Each may abstain.

Candidates are counted by kind, vote pattern and feature over all documents: a table bounded by
kinds x vote patterns x features, whatever the corpus.  On those counts the driver runs
expectation-maximisation (two classes per kind, labelers independent given the class), which
yields the labelers' reliabilities and a probability for each vote pattern, and trains the
final classifier on the same counts with these probabilities as labels: naive Bayes over the
span's features, which see shape and surroundings rather than votes.  A wider candidate
becomes a span where the classifier is above one half.

Rows: null is the empty text.  Repeated rows are rows of their own; an empty table gives no
rows; other columns are ignored.  Positions count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Rows of a batch that goes back to Spark.
SLICE = 256
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No match begins inside a run of digits: where the run's first digit fails, the others do. The look-behind keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HOST = r"[A-Za-z0-9-]+"
WIDE_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?: ?[\[(] ?at ?[\])] ?{_HOST}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?{_HOST})+| at {_HOST}(?: dot {_HOST})+)", re.I)
WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z.,+(/#=-])[0-9]{9,12}(?![0-9A-Za-z]|[.,-][0-9])")
WIDE_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

# The gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co eu de fr es it uk us ca nl be ch at pl se no dk fi pt ru cn jp kr in br mx au nz id".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
FOR_WORDS = {
    "email": frozenset("mail email e-mail contact write address reach correo courriel".split()),
    "ip": frozenset("ip host server address from client login peer".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("call phone tel telephone mobile cell fax contact telefon teléfono whatsapp".split()),
}
AGAINST_WORDS = frozenset("version release section chapter isbn issn order invoice page build revision id sku part no number".split())

N_LABELERS = 5
FEATURE_BUCKETS = 256


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, found from the at-signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


_ANY_DIGIT = re.compile(r"[0-9]")


def strict_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and the matches that the strict checks refuse (kind, start, end)."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    refused = []
    found["email"] = emails(text)
    if _ANY_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found["ip"].append(m.span())
            else:
                refused.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m[0])
                if 16 <= len(d) <= 19 and _luhn(d):
                    found["card"].append(m.span())
                elif 13 <= len(d) <= 19:
                    refused.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
            else:
                refused.append(("phone", *m.span()))
    return found, refused


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return strict_spans(text)[0]


def wide_spans(text: str, base: dict[str, list[tuple[int, int]]], refused: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that touch no base span: what the strict checks refused, and matches of the wider patterns; of several of one kind that overlap the first."""
    found = list(refused)
    if any(x in text for x in (" dot ", " DOT ", "at)", "at]", "AT)", "AT]", "at )", "at ]", "At)", "At]")):
        found += [("email", *m.span()) for m in WIDE_EMAIL.finditer(text)]
    if _ANY_DIGIT.search(text):
        found += [("phone", *m.span()) for m in WIDE_PHONE.finditer(text)]
        if text.count(":") >= 7:
            found += [("ip", *m.span()) for m in WIDE_IP.finditer(text)]
    begins, ends = [], []  # of the union of the base spans
    for a, b in sorted(s for spans in base.values() for s in spans) if found else ():
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            begins.append(a)
            ends.append(b)
    out, last = [], {}
    for kind, a, b in sorted(found, key=lambda x: (x[1], x[2])):
        if bisect_left(begins, b) == bisect_right(ends, a) and last.get(kind, -1) <= a:
            out.append((kind, a, b))
            last[kind] = b
    return out


def votes(text: str, kind: str, begin: int, end: int, strict: bool) -> tuple[int, ...]:
    """1 for, 0 against, -1 abstains: pattern, validity, gazetteer, words before, edges."""
    span = text[begin:end]
    digits = _digits(span)
    pattern = int(strict)
    if kind == "card":
        valid = int(_luhn(digits))
        known = 1 if digits[0] in "3456" else 0
    elif kind == "phone":
        national = digits[-10:]
        valid = 0 if len(set(digits)) <= 2 or not 8 <= len(digits) <= 15 or not strict and len(national) == 10 and (national[0] in "01" or national[3] in "01") else 1
        known = (1 if any(digits[:k] in CALLING_CODES for k in (1, 2)) else 0) if strict else -1
    elif kind == "ip":
        parts = span.split(".")
        valid = 1 if len(parts) != 4 else int(all(len(p) <= 3 and int(p) <= 255 and p == str(int(p)) for p in parts))
        known = -1 if len(parts) != 4 else int(parts[0] not in ("0", "1", "2", "3"))
    else:
        host = re.split(r"\.|[\[(] ?dot ?[\])]", span, flags=re.I)[-1].strip()
        valid = int(host.isalpha())
        known = 1 if host.lower() in TOP_DOMAINS else -1
    before = re.findall(r"[^\W\d_]+", text[max(0, begin - 40) : begin].lower())[-4:]
    context = 0 if AGAINST_WORDS & set(before) else 1 if FOR_WORDS[kind] & set(before) else -1
    left, right = text[begin - 1 : begin], text[end : end + 1]
    edges = 0 if left.isalnum() or right.isalnum() or left in ("=", "/", "#", "_") or right in ("=", "/", "_") else 1 if (not left or left.isspace()) and (not right or right.isspace()) else -1
    return pattern, valid, known, context, edges


def _shape(span: str) -> str:
    s = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", span))
    return re.sub(r"[0-9]+", lambda m: f"{len(m[0])}", s)[:24]


def features(text: str, kind: str, begin: int, end: int) -> list[str]:
    span = text[begin:end]
    word = re.findall(r"[^\W\d_]+", text[max(0, begin - 24) : begin].lower())[-1:]
    n = len(_digits(span))
    return [
        f"n{n if n < 24 else 24}",
        "s%d" % (zlib.crc32(_shape(span).encode()) % FEATURE_BUCKETS),
        "l" + ("0" if not begin else "a" if text[begin - 1].isalnum() else "w" if text[begin - 1].isspace() else "p"),
        "r" + ("0" if end == len(text) else "a" if text[end].isalnum() else "w" if text[end].isspace() else "p"),
        "c" + ("0" if not word else "+" if word[0] in FOR_WORDS[kind] else "-" if word[0] in AGAINST_WORDS else "o"),
        "v%d" % (_luhn(_digits(span)) if kind == "card" else len(set(_digits(span))) > 2),
    ]


def candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    base, refused = strict_spans(text)
    for kind in KINDS:
        for begin, end in base[kind]:
            yield kind, begin, end, True
    for kind, begin, end in wide_spans(text, base, refused):
        yield kind, begin, end, False


# Expectation-maximisation and the final classifier, on counts


@dataclass
class Model:
    """Reliabilities by kind, and naive Bayes weights: log odds of the class and of each feature."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weight: dict[tuple[str, str], float] = field(default_factory=dict)

    def probability(self, kind: str, found: list[str]) -> float:
        if kind not in self.bias:
            return 0.0
        odds = self.bias[kind] + sum(self.weight.get((kind, f), 0.0) for f in found)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def expectation_maximisation(patterns: dict[tuple[int, ...], int], steps: int = 60) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Vote patterns with counts -> (share of the positive class, per labeler P(for | positive) and P(for | negative) among its votes, P(positive | pattern)).

    It starts from the share of votes for; one vote each way is added to every estimate.
    """

    def share(p):
        cast = [v for v in p if v >= 0]
        return (sum(cast) + 1) / (len(cast) + 2)

    post = {p: share(p) for p in patterns}
    prior, rates = 0.5, []
    for _ in range(steps):
        total = sum(patterns.values())
        positive = sum(n * post[p] for p, n in patterns.items())
        prior = (positive + 1) / (total + 2)
        rates = []
        for k in range(N_LABELERS):
            a = b = c = d = 0.0
            for p, n in patterns.items():
                if p[k] >= 0:
                    a, b = a + n * post[p] * p[k], b + n * post[p]
                    c, d = c + n * (1 - post[p]) * p[k], d + n * (1 - post[p])
            rates.append(((a + 3) / (b + 4), (c + 1) / (d + 4)))  # a labeler is thought better than chance until the data say otherwise
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for (t, f), v in zip(rates, p):
                if v >= 0:
                    odds += math.log(t / f) if v else math.log((1 - t) / (1 - f))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return prior, rates, post


def train(counts: list[tuple[str, str, str, int]]) -> Model:
    """(kind, votes, feature, n) counts -> model.  The feature ``""`` counts each candidate once."""
    model = Model()
    for kind in KINDS:
        rows = [(tuple(map(int, v.split(","))), f, n) for k, v, f, n in sorted(counts) if k == kind]
        patterns = {v: n for v, f, n in rows if not f}
        if not patterns:
            continue
        model.prior[kind], model.reliability[kind], post = expectation_maximisation(patterns)
        for_, against = defaultdict(float), defaultdict(float)
        for v, f, n in rows:
            for_[f] += n * post[v]
            against[f] += n * (1 - post[v])
        model.bias[kind] = math.log((for_[""] + 1) / (against[""] + 1))
        for f in for_:
            if f:
                model.weight[kind, f] = math.log((for_[f] + 1) / (for_[""] + 2)) - math.log((against[f] + 1) / (against[""] + 2))
    return model


def counted(docs: DataFrame) -> DataFrame:
    """kind, votes, feature, n over all documents."""
    schema = pa.schema([("kind", pa.string()), ("votes", pa.string()), ("feature", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                for kind, begin, end, strict in candidates(text):
                    pattern = ",".join(map(str, votes(text, kind, begin, end, strict)))
                    for f in ("", *features(text, kind, begin, end)):
                        found[kind, pattern, f] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, n) for k, n in found.items())), schema.types)], schema=schema)

    return docs.select("text").mapInArrow(run, "kind string, votes string, feature string, n long").groupBy("kind", "votes", "feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    return train([tuple(r) for r in counted(docs).collect()])  # bounded by kinds x vote patterns x features


def spans(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans by kind as listed, then start."""
    base, refused = strict_spans(text)
    every = [(k, b, e) for k in KINDS for b, e in base[k]]
    every += [(k, b, e) for k, b, e in wide_spans(text, base, refused) if model.probability(k, features(text, k, b, e)) > 0.5]
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans make one."""
    out, at = [], 0
    for kind, begin, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in found)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model = model or fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = spans(text.as_py() or "", model)
                listed = _joined([(k, b, e) for k in KINDS for b, e in base[k]])
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest(), _joined(every)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string(), pa.string()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task never holds a second copy of a whole batch of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every span replaced by its kind and n_chars counted anew; texts without spans are untouched."""
    model = model or fit(docs)
    at = docs.columns.index("text")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # a name may hold a dot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = []
            for text in batch.column(at):
                text = text.as_py()
                found = spans(text, model)[1] if text else []
                texts.append(redacted(text, found) if found else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], batch.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    return plain.mapInArrow(run, plain.schema).toDF(*names)
