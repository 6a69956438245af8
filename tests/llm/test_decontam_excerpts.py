"""Excerpts at any offset, near copies and short items against full alignment and plain search."""

import random

import pytest

from tessera.llm import decontam


def words(n):
    return " ".join("".join(random.choices("abcdefghijklmnopqrst", k=random.randint(3, 7))) for _ in range(n))


def found(item, text):
    return {m[0]: m[3] for m in decontam.matches(text, decontam.Segments.of([(1, item)]))}


def least_edits(segment, text):
    row = [0] * (len(text) + 1)
    for c in segment:
        new = [row[0] + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_excerpts_wherever_they_begin():
    random.seed(11)
    item = words(60)[:300]
    for begin in range(0, 200, 7):
        assert found(item, f"{words(30)} {item[begin : begin + 100]} {words(30)}"), begin
    assert found(item, f"{words(30)} {item[20:150]} {words(2000)}")
    assert not found(item, words(3000))


def test_near_copies_with_words_replaced():
    random.seed(12)
    for _ in range(10):
        item = words(60)
        copy = item.split()
        for at in range(random.randrange(10), len(copy), 10):
            copy[at] = "zzzzz"
        assert found(item, f"{words(20)} {' '.join(copy)} {words(20)}")
    item = words(18)[:110]
    assert found(item, f"{words(20)} {item[:95]} {words(20)}")


@pytest.mark.parametrize("length", [40, 47, 55, 64])
def test_segments_equal_full_alignment(length):
    random.seed(length)
    for _ in range(15):
        item = words(14)[:length].strip()
        changed = list(item)
        for _ in range(random.randint(0, 8)):
            p = random.randrange(len(changed))
            changed[p : p + random.randint(0, 1)] = random.choice(["", "x", "z"])
        text = f"{words(8)} {''.join(changed)} {words(8)}"
        segments = decontam.Segments.of([(1, item)])
        hits = {m[0]: m[3] for m in decontam.matches(text, segments)}
        for s, codes in enumerate(segments.codes):
            edits = least_edits("".join(map(chr, codes)), text)
            assert hits.get(s) == (edits if edits <= segments.edits(s) else None)


def test_pieces_lose_nothing(monkeypatch):
    random.seed(13)
    item = words(30)
    text = f"{words(50)} {item} {words(50)} {item[40:130]} {words(50)}"
    segments = decontam.Segments.of([(1, item)])
    whole = decontam.matches(text, segments)
    monkeypatch.setattr(decontam, "PIECE", 64)
    monkeypatch.setattr(decontam, "TOGETHER", 7)
    assert decontam.matches(text, segments) == whole and len(whole) == len(segments.codes)


def test_short_items_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "So: what is 2 + 2? Tell!"), (2, "what is 2 20"), (3, "somewhat is 2 2"), (4, "what is 2 2")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "What is 2+2?"), (8, "?!"), (9, None), (10, "Tell")], "item_id long, text string")
    rows = {(r.doc_id, r.item_id, r.text_begin, r.text_end, r.edits) for r in decontam.contaminated(docs, benchmark).collect()}
    assert rows == {(1, 7, 3, 14, 0), (1, 10, 15, 19, 0), (4, 7, 0, 11, 0)}
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == {2, 3}
