"""Pseudonyms of whole documents against a Feistel network in plain Python, and values of any length."""

import hashlib
import re
import time

import regex
from pyspark.sql import functions as F

from tessera.llm import pii

SF, KEY = "/root/testdata/sf0.01", "k"


def sha(*parts):
    return hashlib.sha256("|".join(map(str, (parts[0], *parts[1:], parts[0]))).encode()).hexdigest()


def permuted(value, kind):
    half, hexadecimal = len(value) // 2, bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value))

    def moved(part, other, r):
        seed, out = sha(KEY, kind, r, other), ""
        for i, c in enumerate(part):
            h = int(sha(seed, i)[:15], 16)
            base, size = (48, 10) if c in "0123456789" else (97, 6 if hexadecimal else 26) if "a" <= c <= "z" else (65, 6 if hexadecimal else 26) if "A" <= c <= "Z" else (None, 1)
            out += c if base is None else chr(base + (ord(c) - base + h) % size)
        return out

    for r in range(pii.ROUNDS):
        left, right = value[:half], value[half:]
        value = moved(left, right, r) + right if r % 2 == 0 else left + moved(right, left, r)
    return value


def pair(a, size_a, b, size_b, kind):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + int(sha(KEY, kind, r, b)[:15], 16)) % size_a
        else:
            b = (b + int(sha(KEY, kind, r, a)[:15], 16)) % size_b
    return a, b


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def laid_out(value, digits):
    digits = iter(digits)
    return re.sub("[0-9]", lambda _: next(digits), value)


def pseudonym(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "email":
        name, _, host = v.partition("@")
        return f"{permuted(name, kind)}@{host}"
    if kind == "secret":
        head = re.match(r".*?[=:][ \t]*[\"']", v)[0]
        return head + permuted(v[len(head) : -1], kind) + v[-1]
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        a, b = pair(o[0] * 256 + o[1], 65_536, o[2] * 256 + o[3], 65_536, kind)
        return f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    if kind == "card":
        if luhn(digits):
            return v
        body = permuted(digits[:-1], kind)
        return laid_out(v, body + next(c for c in "0123456789" if not luhn(body + c)))
    if kind == "phone":
        code = (re.match(r"\+[0-9]{1,3}(?=[^0-9])", v) or re.match(r"\+?", v))[0]
        rest = v[len(code) :]
        return code + laid_out(rest, permuted(re.sub("[^0-9]", "", rest), kind)) if 8 <= len(digits) <= 15 else v
    raise AssertionError(f"{kind} is not in these documents: {v}")


def test_documents_equal_brute_force(spark):
    any_kind = regex.compile("|".join(f"(?P<{k}>{re.sub(r'\\([12])', lambda m, k=k: f'(?P={k}{m[1]})', named(k))})" for k in pii.KINDS))

    def whole(text):
        return any_kind.sub(lambda m: pseudonym(next(k for k in pii.KINDS if m[k] is not None), m[0]), text)

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: (r.text, r.n) for r in pii.pseudonymised(docs, KEY, count="n").collect()}
    found = 0
    for r in docs.collect():
        assert new[r.doc_id][0] == (r.text and whole(r.text)), r.doc_id
        assert (new[r.doc_id][1] > 0) == (new[r.doc_id][0] != r.text)
        found += new[r.doc_id][1]
    assert found > 40


def named(kind):
    """The form of a kind with its two plain groups named, as groups are numbered anew in a larger pattern."""
    form = pii.KINDS[kind]
    return form.replace("([ -])", f"(?P<{kind}1>[ -])", 1).replace("([ -])", f"(?P<{kind}2>[ -])", 1)


def test_secrets_of_any_length(spark):
    texts = [f'password: "{"aB3" * n}"' for n in (4, 66, 67, 100, 7000)] + ['token="' + "x" * 11 + '"']
    began = time.time()
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY, count="n").orderBy("doc_id")
    rows = out.collect()
    assert [r.n for r in rows] == [1, 1, 1, 1, 1, 0] and time.time() - began < 60
    assert all(len(r.text) == len(t) and (r.text != t) == (r.n == 1) for r, t in zip(rows, texts, strict=True))
    assert [r.text for r in pii.reveal(out, KEY).orderBy("doc_id").collect()] == texts


def test_the_key_of_the_session(spark):
    before = pii.op8_feistel_pii(spark, "/root/testdata/sf0.001").agg(F.sum(F.xxhash64("text").cast("decimal(38,0)"))).first()[0]
    spark.conf.set(pii.KEY_SETTING, "another key")
    try:
        after = pii.op8_feistel_pii(spark, "/root/testdata/sf0.001").agg(F.sum(F.xxhash64("text").cast("decimal(38,0)"))).first()[0]
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert before != after
