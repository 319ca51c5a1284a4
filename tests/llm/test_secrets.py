import hashlib
import math
import re

from helpers import awkward, empty

from tallyframe.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEY = "wJalrXUtnFEMI7K9bPxRfiCYzEXqLmKy"
TEXTS = [
    'password = "hunter22" and Token:abcdef', "secret=token:abcdef", "api_key='k.e-y/1=' ApiKey:short",
    "AKIA" + "Z9" * 8 + " AKIAX AKIAAKIA" + "1" * 16, "x" + "0123456789abcdef" * 2 + "g deadbeef",
    f"see {KEY} here, é{KEY}, and aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", f"token={KEY}", "thisisaverylongwordwithoutanydigits",
    "550e8400-e29b-41d4-a716-446655440000 1234567890123456789012345678", f"{'A' * 40}{KEY}{'B' * 40}", "", None, " ",
    "passwd:" * 3 + "abcdefg", "secret" + " " * 5 + "=" + " " * 3 + "x1y2z3", "SECRET: é", "p" * 5000 + KEY * 40,
]


def base(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def entropy(text, taken):
    """Every window by itself, counted anew."""
    rules, out = secrets.DEFAULT_RULES, []
    allowed = re.compile("|".join(f"(?:{p})" for p in rules.allowed).replace(r"(.)\1*", r"(?P<c>.)(?P=c)*"))
    for rank, c in enumerate(rules.classes, start=3):
        for m in re.finditer(c.pattern, text):
            if allowed.fullmatch(m[0]):
                continue
            runs = []
            for i in range(len(m[0]) - rules.window + 1):
                part = m[0][i : i + rules.window]
                bits = -sum(part.count(x) / len(part) * math.log2(part.count(x) / len(part)) for x in set(part))
                if bits >= c.bits - 1e-9:
                    if runs and runs[-1][1] >= i:
                        runs[-1][1] = i + rules.window
                    else:
                        runs.append([i, i + rules.window])
            for a, b in runs:
                a, b = a + m.start(), b + m.start()
                if not any(s <= a and e >= b for s, _, _, e in taken):
                    out.append((a, rank, c.name, b))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def test_matches_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
    for i, t in enumerate(TEXTS):
        found = base(t or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in found) for k in ("assign", "access", "hex")), t
        assert r.base_sha256 == hashlib.sha256(joined(found).encode()).hexdigest(), t
        assert r.spans == joined(found + entropy(t or "", found)), t
    assert "base64_entropy" in got[5].spans and got[7].spans == ""


def test_awkward_rows_and_empty_table(spark):
    assert len(secrets.secret_report(awkward(spark)).collect()) == 18
    assert secrets.secret_report(empty(spark)).collect() == []


def test_long_candidates_of_words_and_signs(spark):
    """A rule line or a chain of short words is allowed at any length and does not exhaust the stack."""
    texts = ["a" + "=" * 1_000_000, "a" + "-b" * 500_000, "a" + "=" * 5_000 + " " + KEY]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_report(docs).collect()}
    assert got[0] == got[1] == "" and got[2] == f"base64_entropy:5002:{5002 + len(KEY)}"
