"""Operator 13, secret scans by linking the parts of credentials.

Base rules find assignments to secret names, access key identifiers and runs of hexadecimal digits; what they find
always stays.  Beside them stand weak candidates, each of which is nothing by itself: a named identifier
(``user = bob``), a named value too short or too plain for the base rules, a bare token of mixed letters and
digits, a named host or an address with ``://``.  A credential has several parts, an
identifier, a secret and an endpoint, and a weak candidate becomes a span only where parts that complete it stand near:

    identifier: a secret is in reach;    secret: an identifier or an endpoint is in reach;
    endpoint: an identifier and a secret are in reach.

Parts are base spans (access: identifier; assign, hex: secret) and weak candidates alike.  A part reaches REACH code points to
both sides, but not out of its scope: the innermost closed pair of braces around it, else its paragraph (lines between blank ones).
Finding parts and scopes is one pass over the texts in linear time.  Their table is written, and the links are an
interval join in Spark: reaches are dealt to cells of CELL code points, so an equality join by row and cell brings only parts near
each other together, however long the text is and however many parts it holds.

Rows: null is the empty text.  Repeated rows and ids are rows of their own, told apart by a number written with them; an empty
table gives no rows; other columns are ignored.  Positions count code points; ends are exclusive.  A weak candidate that overlaps a base span,
or an earlier weak one, is none.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import written

BASE = ("assign", "access", "hex")
ROLES = ("identifier", "secret", "endpoint")
KINDS = BASE + ROLES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of [0-9a-f]+ that are long enough: shorter ones hold no longer one

_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
IDENTIFIER = re.compile(r"(?<![a-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|(?:access_?)?key_?id|app_?id|tenant(?:_?id)?)" + _NAMED + r"([a-z0-9@._+-]{3,64})(?![a-z0-9@._+-])", re.I | re.A)
SHORT = re.compile(r"(?<![a-z0-9])(?:pass(?:wd|word|phrase|code)?|pwd|pw|auth|credentials?|secret|token|(?:private_?|api_?|secret_?|shared_?)key|signature)" + _NAMED + r"""([^\s"',;<>{}()\[\]]{6,128})(?![^\s"',;<>{}()\[\]])""", re.I | re.A)
ENDPOINT = re.compile(r"(?<![a-z0-9])(?:host(?:name)?|server|endpoint|base_?url|bucket|region|database)" + _NAMED + r"([a-z0-9][a-z0-9._:/-]{3,255})(?![a-z0-9._:/-])", re.I | re.A)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ADDRESS = re.compile(r"""[^\s"'<>(){}\[\]]+""")
BLANK = re.compile(r"\n(?=[\x20\t\r]*\n)")
SCHEME = 16

#: How far a part reaches, and the width of the cells of the join; a cell holds few parts as each is some characters long.
REACH, CELL = 256, 512

_NAMES = ("pass", "pwd", "pw", "auth", "credential", "secret", "token", "key", "signature")
_IDENTIFIERS = ("user", "login", "client", "account", "key", "app", "tenant")
_ENDPOINTS = ("host", "server", "endpoint", "url", "bucket", "region", "database")


def base_spans(text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    """Spans of the base rules by start, then kind as listed."""
    low = text.lower() if low is None else low  # holds every ASCII letter that the text holds, so a name that is not in it is nowhere
    found = []
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(BASE[k], a, b) for a, k, b in sorted(found)]


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _mixed(token: str) -> bool:
    return any("0" <= c <= "9" for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a scheme, found from their ``://``."""
    at, done = text.find("://"), 0
    while at >= 0:
        begin = at
        while begin > max(done, at - SCHEME) and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "+-."):
            begin -= 1
        m = ADDRESS.match(text, at + 3) if begin < at else None
        if m:
            done = m.end()
            yield begin, done
        at = text.find("://", max(at + 3, done))


def weak_candidates(text: str, base: list[tuple[str, int, int]], low: str | None = None) -> list[tuple[str, int, int]]:
    """(role, begin, end) of what may be a part of a credential, by begin; none overlaps a base span or an earlier candidate."""
    low = text.lower() if low is None else low
    found = []
    if "=" in text or ":" in text:
        if any(x in low for x in _IDENTIFIERS):
            found += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
        if any(x in low for x in _NAMES):
            found += [("secret", *m.span()) for m in SHORT.finditer(text) if re.search(r"[^A-Za-z]", m[1])]
        if any(x in low for x in _ENDPOINTS):
            found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
        if "://" in text:
            found += [("endpoint", a, b) for a, b in _addresses(text)]
    if found or base:  # a token alone links with nothing
        found += [("secret", *m.span()) for m in TOKEN.finditer(text) if m.end() - m.start() <= 128 and _mixed(m[0]) and _entropy(m[0]) >= 3.5]
    out, last, k = [], 0, 0
    taken = sorted((a, b) for _, a, b in base)
    reach = []  # greatest end of the base spans so far
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    for role, a, b in sorted(found, key=lambda s: (s[1], -s[2], ROLES.index(s[0]))):
        k = bisect_right(taken, (b - 1, math.inf))  # base spans that begin before its end
        if a >= last and not (k and reach[k - 1] > a):
            out.append((role, a, b))
            last = b
    return out


def scopes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each span's scope, for spans by begin: the innermost closed braces around its begin, else its paragraph."""
    borders = [0, *(m.end() for m in BLANK.finditer(text)), len(text)]
    pairs, open_ = [], []
    if "{" in text and "}" in text:
        for m in re.finditer(r"[{}]", text):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                pairs.append((open_.pop(), m.end()))
    pairs.sort()
    out, around, k = [], [], 0
    for a, _ in spans:
        while k < len(pairs) and pairs[k][0] <= a:
            while around and around[-1][1] <= pairs[k][0]:
                around.pop()
            around.append(pairs[k])
            k += 1
        while around and around[-1][1] <= a:
            around.pop()
        i = bisect_right(borders, a)
        out.append(around[-1] if around else (borders[i - 1], borders[i] if i < len(borders) else len(text)))
    return out


def parts(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, str, int, int, bool, int, int]]]:
    """Base spans, and (role, kind, begin, end, weak, reach from, reach to) of all parts; none if no link can come about."""
    low = text.lower()
    base = base_spans(text, low)
    weak = weak_candidates(text, base, low)
    roles = [("identifier" if k == "access" else "secret", k, a, b, False) for k, a, b in base]
    both = sorted(roles + [(r, r, a, b, True) for r, a, b in weak], key=lambda p: (p[2], p[3]))
    if not weak or len({p[0] for p in both}) < 2:
        return base, []
    around = scopes(text, [(p[2], p[3]) for p in both])
    return base, [(*p, max(s, p[2] - REACH), min(max(e, p[3]), p[3] + REACH)) for p, (s, e) in zip(both, around)]


_PART = pa.struct([("role", pa.string()), ("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("weak", pa.bool_()), ("from", pa.int64()), ("to", pa.int64())])
_SPAN = pa.struct([("begin", pa.int64()), ("place", pa.int32()), ("end", pa.int64())])


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_assign, n_access, n_hex, base_sha256, base, parts: one pass over the texts."""
    names = ["row", "doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                base, linked = parts(text.as_py() or "")
                listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(listed.encode()).hexdigest(), [{"begin": a, "place": KINDS.index(k), "end": b} for k, a, b in base], [dict(zip(("role", "kind", "begin", "end", "weak", "from", "to"), p)) for p in linked]))
            if rows:
                types = [*[pa.int64()] * 3, pa.string(), pa.list_(_SPAN), pa.list_(_PART)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    schema = "row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<begin: long, place: int, end: long>>, parts array<struct<role: string, kind: string, begin: long, end: long, weak: boolean, from: long, to: long>>"
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def linked(found: DataFrame) -> DataFrame:
    """row, role, begin, end of the weak candidates that parts in reach complete."""
    parts_ = found.filter(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    reaches = parts_.select("row", F.col("role").alias("other"), F.col("from"), F.col("to"), F.explode(F.sequence(cell("from"), cell("to"))).alias("cell"))
    weak = parts_.filter("weak").select("row", "role", "begin", "end", cell("begin").alias("cell"))
    near = weak.join(reaches, ["row", "cell"]).filter((F.col("role") != F.col("other")) & (F.col("begin") >= F.col("from")) & (F.col("end") <= F.col("to")))
    has = near.groupBy("row", "role", "begin", "end").agg(*(F.bool_or(F.col("other") == r).alias(f"has_{r}") for r in ROLES))
    complete = F.when(F.col("role") == "identifier", F.col("has_secret")).when(F.col("role") == "secret", F.col("has_identifier") | F.col("has_endpoint")).otherwise(F.col("has_identifier") & F.col("has_secret"))
    return has.filter(complete).select("row", "role", "begin", "end")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = written(scanned(docs), "secret-parts")
    place = F.create_map(*(F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)))
    kind = F.array(*(F.lit(k) for k in KINDS))
    more = linked(found).groupBy("row").agg(F.collect_list(F.struct("begin", place[F.col("role")].alias("place"), "end")).alias("more"))
    rows = found.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base").join(more, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<begin: bigint, place: int, end: bigint>>"))))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(kind, s["place"] + 1), s["begin"], s["end"])), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))
