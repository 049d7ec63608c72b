"""Secret spans against a plain scan."""

import math
import random
import re
import string
from collections import Counter

import brute

from cohortspan.llm import secret_scan as S

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = []
    for order, c in enumerate(S.CLASSES, 3):
        for m in re.finditer("[" + re.escape(c.alphabet) + "]+", text):
            run = m[0]
            if len(run) < c.window or re.search(S.ALLOWED, run) or not all(re.search(p, run) for p in c.must_have):
                continue
            hot = []
            for i in range(len(run) - c.window + 1):
                total = sum(round(n * math.log2(n) * S.UNIT) for n in Counter(run[i:i + c.window]).values())
                if total <= math.floor(c.window * (math.log2(c.window) - c.bits) * S.UNIT):
                    hot.append(i)
            if hot:
                span = (m.start() + hot[0], order, m.start() + hot[-1] + c.window, c.kind)
                if not any(b[0] <= span[0] and span[2] <= b[2] for b in base):
                    more.append(span)
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    n = Counter(b[3] for b in base)
    return (n["assign"], n["access"], n["hex"], brute.sha(say(base)), say(base + more))


def check(spark, docs):
    rows = S.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in rows)
    assert got == sorted((str(d), *plain(t)) for d, t in docs)
    return rows


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = check(spark, docs)
    assert sum(r.n_assign for r in rows) > 5


def test_planted_and_odd_texts(spark):
    rng = random.Random(4)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b64, low = string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    texts = [
        None, "", "token", "TOKEN = 'abcdefgh'", "password=token = abcdefgh1", "api_key:short apikey : \"long.enough=1\"",
        "secret=é token: éabcdefgh", "👍 password: hunter2hunter2 👍 passwd='x' SECRET  ==abcdefgh", "ſecret=abcdefgh toKen=abcdefgh",
        "AKIA" + key(12, string.ascii_uppercase), "AKIAAKIA1234 AKIA" + "A" * 11, key(32, low) + "g" + key(31, low) + " " + key(64, low),
        *(f"é {key(30, b64)} and {key(22, low.upper())} x" for _ in range(6)), "word" * 12, "id " + key(24, string.digits),
        "EXAMPLE" + key(30, b64), key(3000, b64), " ".join(["token=abcdefgh"] * 1500), "A" * 5000, "a1B" * 400,
        "https://host/" + "path-of-some-words/" * 6, "123e4567-e89b-12d3-a456-426614174000",
    ]
    check(spark, [*enumerate(texts), (None, "token=abcdefgh"), (3, texts[3])])


def test_only_native_operators(spark, capsys):
    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet").selectExpr("*", "1 AS spans", "2 AS base")
    S.scan(docs).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|MapIn", capsys.readouterr().out)
    assert S.scan(docs.limit(0)).count() == 0
