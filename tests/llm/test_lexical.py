"""Ranked lexical search against a plain search over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from wearpath.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, length = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 100 - 25 + 25 * n * total // length
            score = 0
            for t in words(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, id string, item int, score int").repartition(parts)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "item_id bigint, text string, doc_id int")


def corpus(rng, n=300):
    pool = ["".join(rng.choices("abcdeé漢", k=rng.randint(1, 3))) for _ in range(80)] + ["Straße", "I", "İ", "x9", "_", "a-b"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 60))).replace("a ", "A,") for _ in range(n)]
    texts += [None, "", " \n.,", texts[0], texts[0], "word " * 50_000, "abc" * 20_000]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(15)] + [(90, ""), (91, "no such term at all"), (92, "a a a a")]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_plain_search(spark, monkeypatch, small):
    rows, items = corpus(random.Random(5 + small))
    if small:  # many blocks, few cells and candidates at once
        monkeypatch.setattr(lexical, "CELLS", 3)
        monkeypatch.setattr(lexical, "CANDIDATES", 40)
    found = lexical.search(docs_of(spark, rows), items_of(spark, items), k=5, block_bytes=100 if small else 10**6)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows, items, 5)


def test_ties_go_to_the_smaller_id_and_nulls_last(spark):
    rows = [(9, "red fox"), (4, "red fox"), (None, "red fox"), (4, "red fox"), (7, "fox red")] + [(100 + i, "other words") for i in range(9)]
    found = lexical.search(docs_of(spark, rows), items_of(spark, [(1, "red"), (1, "red"), (None, "fox"), (2, None)]), k=5)
    assert [(r["rank"], r["doc_id"]) for r in sorted(found.collect())] == [(1, 4), (2, 4), (3, 7), (4, 9), (5, None)]


def test_different_texts_of_an_item_are_one_item(spark):
    rows = [(i, t) for i, t in enumerate(["red fox", "blue cat", "red cat", "none"])]
    one = lexical.search(docs_of(spark, rows), items_of(spark, [(1, "red"), (1, "cat")]))
    assert sorted(tuple(r)[1:] for r in one.collect()) == [r[1:] for r in plain(rows, [(1, "red cat")])]


def test_empty_tables(spark):
    rows, items = [(1, "red")], [(1, "red")]
    for some, asked in (([], items), (rows, []), ([(1, None), (2, "..")], items)):
        found = lexical.search(docs_of(spark, some), items_of(spark, asked))
        assert found.count() == 0 and dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
