"""Secret scans against a brute-force scan with Python's re."""

import hashlib
import math
import random
import re
import string
import time

from quorumlake.llm.secrets import ALLOWED, CLASSES, WINDOW, secret_report

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
KINDS = ["assign", "access", "hex", "entropy"]


def base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def entropy(w):
    return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))


def hot(t, base):
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        s = m[0]
        has = lambda *ps: all(re.search(p, s) for p in ps)
        if len(s) < 20 or not (has("[0-9]", "[A-Za-z]") or has("[a-z]", "[A-Z]")) or any(re.search(p, s) for p in ALLOWED):
            continue
        least = next(x for _, p, x in CLASSES if re.search(p, s))
        met = [x for x in base if x[0] < m.end() and m.start() < x[2]]
        parts = [(m.start(), min(x[0] for x in met)), (max(x[2] for x in met), m.end())] if met else [m.span()]
        for a, b in parts:
            at = [i for i in range(a, b - WINDOW + 1) if entropy(t[i : i + WINDOW]) >= least]
            if at:
                yield at[0], 3, at[-1] + WINDOW


def brute(i, t):
    t = t or ""
    b = base(t)
    more = list(hot(t, b))
    show = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
    return (i, *(sum(x[1] == k for x in b) for k in range(3)), hashlib.sha256(show(b).encode()).hexdigest(), show(sorted(b + more)))


def test_equals_brute_force(spark, docs_of):
    r = random.Random(9)
    rnd = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    parts = [
        lambda: r.choice(["the word", "é日😀", "token", "a" * 40, "secret:token:abcdefgh", "b-e_d/f" * 4, "page2-of-3/x_1"]),
        lambda: r.choice(["PassWord", "api_key", "APIKEY", "secret"]) + r.choice(["=", " : ", "'= \"", "==", "\n="]) + rnd(r.randint(1, 14), string.ascii_letters + "+/_.=-"),
        lambda: "AKIA" + rnd(r.randint(0, 20), string.ascii_uppercase + "0123"),
        lambda: rnd(r.randint(20, 50), "0123456789abcdef"),
        lambda: rnd(r.randint(15, 60), string.ascii_letters + string.digits + "+/"),
        lambda: "123e4567-e89b-12d3-a456-426614174000",
        lambda: rnd(r.randint(15, 60), string.ascii_letters),
        lambda: "InternationalTradeAgreementsOffice",
        lambda: rnd(25, string.ascii_letters) + "=token=" + rnd(9, string.ascii_letters) + "+" + rnd(25, string.ascii_letters),
    ]
    docs = [(i, r.choice(["", " "]).join(r.choice(parts)() + r.choice(["", " ", "\n", ","]) for _ in range(r.randint(0, 12)))) for i in range(400)]
    docs += [(900, None), (901, ""), (1, "same AKIA" + "A" * 20), (1, "same AKIA" + "A" * 20), (None, "token = abcdefgh9"), (902, "f0" * 30000), (903, "token=x " * 3000)]
    got = sorted((tuple(x)[:6] for x in secret_report(docs_of(docs)).collect()), key=str)
    assert got == sorted((brute(i, t) for i, t in docs), key=str)


def test_no_python(spark, docs_of):
    plan = secret_report(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark, docs_of):
    assert secret_report(docs_of([])).count() == 0


def test_many_matches_take_linear_time(spark, docs_of):
    # A megabyte of assignments and keys; quadratic work would take an hour.
    r = random.Random(3)
    lines = [f"token={''.join(r.choices(string.ascii_letters + string.digits, k=24))}" for _ in range(32000)]
    text = "\n".join(lines)
    began = time.time()
    (row,) = secret_report(docs_of([(1, text)])).collect()
    assert row.n_assign == 32000 and time.time() - began < 15
    assert tuple(row)[:6] == brute_linear(1, text)


def brute_linear(i, t):
    b = base(t)
    show = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in b)
    return i, len(b), 0, 0, hashlib.sha256(show.encode()).hexdigest(), show
