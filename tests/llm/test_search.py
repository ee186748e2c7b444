"""Ranked search against a brute-force ranking, with every number of tiers."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from parchmill.llm import ranked_search
from parchmill.llm.ranked_search import search, terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, row long, n long, terms string, high string, score long"
ITEMS = "item_id long, text string, item long, rank int"


def words_of(text):
    return [w.translate(LOWER) for w in PATTERN.findall(text or "")]


def brute(docs, items, k):
    """(item_id, rank, doc_id, score), sorted; rows of one document id need not be told apart."""
    own = [(i, Counter(words_of(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words_of(text)) if c[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def random_tables(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 3))) for _ in range(60)]
    text = lambda many: " ".join(r.choice(vocabulary[: r.choice([5, 20, 60])]) for _ in range(many))
    docs = [(r.choice([i, i, i, i - 1]), text(r.randint(0, 40))) for i in range(n)]
    docs += [(None, "Ab,cd;AB"), (None, None), (n, ""), (n + 1, "!?"), (n + 2, docs[3][1]), (n + 2, docs[3][1]), (n + 3, text(30_000))]
    items = [(i, text(r.randint(1, 12))) for i in range(8)] + [(3, "a b a"), (None, "ab a"), (20, None), (21, "zzzz"), (22, "...")]
    return docs, items


def rows(found):
    return sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, 2, "t", "h", 3) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 500)])
def test_search_against_brute_force(spark, seed, k):
    docs, items = random_tables(seed, 150)
    assert rows(search(*frames(spark, docs, items), k=k)) == brute(docs, items, k)


def test_every_depth_of_proof(spark, monkeypatch):
    """Items whose few rare words fill the result are proven by the first tier; others, and those with fewer than k documents, take more."""
    r = random.Random(9)
    docs = [(i, " ".join([f"rare{i % 4}"] * 6 * (i % 10 == 0) + [r.choice("abcdefgh") for _ in range(r.randint(3, 30))] + ["only"] * (i == 5))) for i in range(400)]
    items = [(i, f"rare{i % 4} {'ab' if i % 2 else ''}") for i in range(4)] + [(10 + i, " ".join(x)) for i, x in enumerate(("ab", "abcdefgh", "h"))] + [(30, "only")]
    found = search(*frames(spark, docs, items), k=5)
    assert rows(found) == brute(docs, items, 5)
    assert {1, len(ranked_search.TIERS)} <= {x["tiers"] for x in found.select("tiers").distinct().collect()}
    monkeypatch.setattr(ranked_search, "ITEMS", 2)
    assert rows(search(*frames(spark, docs, items), k=5)) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = random_tables(3, 10)
    assert rows(search(*frames(spark, [], items))) == []
    assert rows(search(*frames(spark, docs, []))) == []


def test_terms_of_bytes():
    for text in ("", "a", "A-b C", "é😀x_y", "..a..", "a" * 3000):
        data = np.frombuffer(text.encode(), np.uint8)
        many, found = terms(data, np.array([0, len(data)]))
        assert [x.decode() for x in found.to_pylist()] == words_of(text) and many.tolist() == [len(words_of(text))]
