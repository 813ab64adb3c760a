"""Secret scans against a plain Python version."""

import hashlib
import math
import random
import re

import pytest

from lodestore.llm import secrets as S

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy(text):
    out = []
    for k, (_, characters, threshold) in enumerate(S.CLASSES):
        for m in re.finditer(f"[{characters}]+", text):
            v = m[0]
            if len(v) < S.WINDOW or any(re.search(p, v) for p in S.ALLOWED):
                continue
            best = 0
            for piece in re.split(S.PLACEHOLDER, v):
                for i in range(len(piece) - S.WINDOW + 1):
                    w = piece[i : i + S.WINDOW]
                    best = max(best, -sum(w.count(c) / S.WINDOW * math.log2(w.count(c) / S.WINDOW) for c in set(w)))
            if best >= threshold - 1e-9:
                out.append((m.start(), 3 + k, m.end()))
    return out


NAMES = [x[0] for x in (*S.KINDS, *S.CLASSES)]


def text_of(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in sorted(spans))


def cases():
    r = random.Random(1)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    out = [None, "", " ", "no secret", "token=api_key: 'abcdefgh12'", "PassWord\" : \"hunter2hunter2\"", "secret=short", "ſecret=abcdefghij",
           "AKIA" + "A" * 12, "AKIA" + "B" * 11, "xAKIAAKIA" + "1" * 20, "0" * 31, "0" * 32, "é漢" + "ab12" * 8 + "😀 token: " + pick(alnum, 40),
           "123e4567-e89b-12d3-a456-426614174000", "a" * 4000, pick(alnum, 3000), "2024-05-01_" + pick(alnum, 40), "2024-05-01T10-20-30-40-50-60Z", pick(alnum, 40) + "example" + pick(alnum, 9), pick(alnum, 12) + "XXXXXX" + pick(alnum, 12), "key " + pick("0123456789abcdef", 40) + " " + pick(alnum, 44) + "=="]
    for _ in range(60):
        out.append(" ".join(r.choice([pick("0123456789abcdef", r.randint(20, 50)), pick(alnum, r.randint(10, 60)), "token=" + pick(alnum, 9), "api_key: '" + pick("abc.=", 7), "wort", "é" * 3, "AKIA" + pick("ABC123", r.randint(8, 20))]) for _ in range(r.randint(1, 12))))
    return out


def test_against_plain_version(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base_spans string").drop("base_spans")
    got = {r.doc_id: r for r in S.scan(df).select("doc_id", S.joined("base_spans").alias("b"), S.joined("all_spans").alias("a")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].b == text_of(base(t or "")), t
        assert got[i].a == text_of(base(t or "") + entropy(t or "")), t


def test_query_digests(spark, tmp_path):
    texts = cases()
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in S.op7_secret_scans(spark, str(tmp_path)).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))


def test_redaction_removes_every_span(spark):
    texts = ["a token = 0123456789ab tail", None, "", "x " + "ab" * 20 + " y token=" + "cd" * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in S.redact(df).collect()}
    assert got == {0: "a [secret] tail", 1: None, 2: "", 3: "x [secret] y [secret]"}


def test_other_columns_stay(spark):
    names = ["__text", "__assign", "base_spans", "all_spans", "secrets: text", "a.b", "assign"]
    df = spark.createDataFrame([(1, "token = 0123456789ab", *names), (None, None, *names)], ", ".join(["doc_id long, text string", *[f"`{n}` string" for n in names]]))
    left = S.redact(df)
    assert left.columns == df.columns and sorted(tuple(map(str, r)) for r in left.collect()) == sorted([("1", "[secret]", *names), ("None", "None", *names)])
    scanned = S.scan(df, base="b", spans="s")
    assert scanned.columns == [*df.columns, "b", "s"] and all(tuple(r)[2:9] == tuple(names) for r in scanned.collect())


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    assert S.scan(spark.createDataFrame([], schema)).count() == 0
