"""IBANs before capitals and numbers, and slashed dates written day first."""

import datetime
import re

import pytest

from tessera.llm import pii

IBANS = ["ES9121000418450200051332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466", "PL61109010140000071219812874", "RO49 AAAA 1B31 0075 9384 0000", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "MT84MALT011000012345MTLCAST001S"]
AFTER = [" EUR", " BIC", " 2024", " 12 A", " X", " SWIFT CODE", ".", ""]


def valid(iban):
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


@pytest.fixture(scope="module")
def changed(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = pii.pseudonymised(df, "k", count="n").orderBy("doc_id")
        rows = out.collect()
        assert [r.text for r in pii.reveal(out, "k").orderBy("doc_id").collect()] == texts
        return rows

    return run


def test_ibans_before_capitals_and_numbers(changed):
    cases = [(i, a) for i in IBANS for a in AFTER]
    assert all(map(valid, IBANS))
    for (iban, after), r in zip(cases, changed([f"pay {i}{a}" for i, a in cases]), strict=True):
        new = r.text[4 : 4 + len(iban)]
        assert r.n == 1 and r.text == f"pay {new}{after}" and new != iban and valid(new), (iban, after)
        assert re.sub("[0-9A-Z]", "x", new[2:]) == re.sub("[0-9A-Z]", "x", iban[2:])


def test_days_first(changed):
    first = datetime.date(1800, 1, 1)
    days = [d for d in (first + datetime.timedelta(k) for k in range(0, 146_097, 37)) if d.day > 12]
    days += [datetime.date(1800, 1, 13), datetime.date(2199, 12, 31), datetime.date(2000, 2, 29), datetime.date(1999, 12, 25)]
    texts = sorted({d.strftime("%d/%m/") + f"{d.year:04}" for d in days})
    new = [r.text for r in changed(texts)]
    assert len(set(new)) == len(texts) and sum(a != b for a, b in zip(texts, new, strict=True)) >= len(texts) - 2
    for t in new:
        assert datetime.datetime.strptime(t, "%d/%m/%Y").day > 12 and 1800 <= int(t[6:]) <= 2199
    kept = changed(["31/04/2000 30/02/2001 13/13/2000 00/01/2000 25/12/1799 25/12/2200"])[0]
    assert kept.n == 0
