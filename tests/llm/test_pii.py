import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from revlake.llm import pii


def brute(text):
    """The base rules by plain finditer."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("ab@@..--+1234567890 ()é%_"), max_size=60))
def test_base_spans_are_leftmost_matches(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a.b@x-1.com", "1.2.3.4", "256.1.1.1", "4785380592391139", "4785 3805 9239 1139", "+1 (743) 555-3824", "x@y", "@", "a@b@c.de", " ", "v2.0", "\n", "+12"]), max_size=12))
def test_base_spans_on_data(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


TEXTS = [
    "write to a.b@mail.com today",
    "call (743) 555-3824 now, phone 212-555-0188 too",
    "host 10.20.30.44 and card 4785380592391139",
    "email jo (at) site (dot) com please",
    "plain words of a clean text, section 1.2 of 2020",
    "",
    None,
    "x" * 20000 + " +49 30 1234567",
    "+1 (743) 555-3824 a@b.co",
]


def test_find_keeps_base_and_adds(make_docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(180)] + [(None, TEXTS[0]), (1, TEXTS[1])]
    got = pii.find(make_docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        text = texts[r.doc_id] or ""
        base = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.KINDS]
        listed = [f"{k}:{b}:{e}" for k in pii.KINDS for b, e in base[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
        if text.startswith("plain"):
            assert r.spans == ""
        if text.startswith("call"):
            assert r.spans == "phone:5:19,phone:31:43"
        if text.startswith("email"):
            assert r.spans == "email:6:31" or r.spans.startswith("email:6")
    assert pii.find(make_docs([])).collect() == []


def test_reliabilities():
    patterns = {(1, 1, 1, 1, 1): 400, (1, 1, 0, -1, 1): 80, (-1, 0, 1, 0, 0): 100, (-1, 0, 0, 0, 0): 300, (-1, 1, 1, -1, 1): 50}
    prior, rates, post = pii.expectation_maximisation(patterns)
    assert post[1, 1, 1, 1, 1] > 0.99 and post[-1, 1, 1, -1, 1] > 0.9 and post[-1, 0, 0, 0, 0] < 0.01
    assert all(t > f for t, f in rates)


def test_redaction(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)])
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert out[0].text == "write to [EMAIL] today" and out[0].n_chars == len(out[0].text)
    assert out[2].text == "host [IP] and card [CARD]"
    assert out[4].text == TEXTS[4] and out[6].text is None and out[8].text == "[PHONE] [EMAIL]"


def brute_spans(texts):
    """Expectation-maximisation and naive Bayes candidate by candidate, without counts of patterns."""
    rows = [(n, k, b, e, s, pii.votes(t, k, b, e, s), pii.features(t, k, b, e)) for n, t in enumerate(texts) for k, b, e, s in pii.candidates(t)]
    out = {n: [] for n in range(len(texts))}
    for kind in pii.KINDS:
        mine = [r for r in rows if r[1] == kind]
        post = [(sum(v for v in r[5] if v >= 0) + 1) / (sum(v >= 0 for v in r[5]) + 2) for r in mine]
        for _ in range(60):
            prior = (sum(post) + 1) / (len(mine) + 2)
            cast = [[(p, r[5][k]) for p, r in zip(post, mine) if r[5][k] >= 0] for k in range(pii.N_LABELERS)]
            true = [(sum(p for p, v in c if v) + 3) / (sum(p for p, _ in c) + 4) for c in cast]
            false = [(sum(1 - p for p, v in c if v) + 1) / (sum(1 - p for p, _ in c) + 4) for c in cast]
            post = []
            for r in mine:
                yes, no = prior, 1 - prior
                for k, v in enumerate(r[5]):
                    if v >= 0:
                        yes *= true[k] if v else 1 - true[k]
                        no *= false[k] if v else 1 - false[k]
                post.append(yes / (yes + no))
        n_yes, n_no = sum(post), sum(1 - p for p in post)
        for r in mine:
            yes, no = n_yes + 1, n_no + 1
            for f in r[6]:
                yes *= (sum(p for p, q in zip(post, mine) if f in q[6]) + 1) / (n_yes + 2)
                no *= (sum(1 - p for p, q in zip(post, mine) if f in q[6]) + 1) / (n_no + 2)
            if r[4] or yes > no:
                out[r[0]].append(f"{kind}:{r[2]}:{r[3]}")
    return {n: ",".join(found) for n, found in out.items()}


def test_added_spans_match_brute_force(make_docs):
    cards = ["4785380592391139", "4785 3805 9239 1139", "4785380592391130", "980791576280449", "7086638319846192", "9777946427004852"]
    other = ["call 743 555 3824", "pin 2125550188", "300.1.2.3", "10.2.3.4", "+12345", "+1 (743) 555-3824", "jo [at] site [dot] com", "x at y dot org", "a@b.com", "2001:db8:0:0:0:0:0:1", "value 123456789012"]
    texts = [f"words {cards[i % 6]} and {other[i % 11]} then w{i} {other[i * 7 % 11]} end" for i in range(120)]
    got = {r.doc_id: r.spans for r in pii.find(make_docs(list(enumerate(texts)))).collect()}
    expected = brute_spans(texts)
    assert got == expected
    wide = sum(len([c for c in pii.candidates(t) if not c[3]]) for t in texts)
    added = sum(len(s.split(",")) for s in got.values()) - sum(len(v) for t in texts for v in pii.base_spans(t).values())
    assert 0 < added < wide  # the classifier takes some and refuses some
    assert pii.redact(make_docs([])).collect() == []


def test_runs_of_digits_take_linear_time():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["0" * rng.randrange(1, 9), "7", "25", ".", ".", ".", " "]) for _ in range(40))
        assert pii.base_spans(text)["ip"] == brute(text)["ip"]
    n = 1_000_000
    for text in ("0" * n, "1." * (n // 2), "1.1.1 " * (n // 6), ("9" * (n // 4) + ".") * 4, "+1 " + " " * n):
        began = time.perf_counter()
        pii.strict_spans(text)
        assert time.perf_counter() - began < 5
