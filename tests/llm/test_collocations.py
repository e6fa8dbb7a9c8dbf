"""Phrases and summaries against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from paylens.llm import collocations as module
from paylens.llm.collocations import Summary, collocations, frequent_phrases
from tests.llm.helpers import clashing, odd_rows, prose

DOCS = "doc_id long, text string, lang string"


def grams(rows, longest=5):
    """Counts of (lang, words) and of all words of a language."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, longest=5, top=2000):
    f, n = grams(rows, longest)
    f = {g: c for g, c in f.items() if c >= least}
    out = []
    for (lang, *w), a in f.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(
            x == lang and len(y) > len(w) and b >= a and any(y[i : i + len(w)] == w for i in range(len(y) - len(w) + 1)) for (x, *y), b in f.items()
        )
        if not inside:
            out.append((lang, score, a, " ".join(w), f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3].encode())):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase, a, left, right, total, score))
    return ranked


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(3) if rows else spark.createDataFrame([], DOCS)


def found(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts():
    draw = random.Random(7)
    out = []
    for i in range(150):
        w = [draw.choice(["New", "york", "of", "the", "state", "a", "b"]) for _ in range(draw.randrange(3, 60))]
        w += ["Strong  Tea", "in\tthe morning.", "Ünï çode", "the the the the the the", "new york city,"][i % 5].split(" ")
        out.append((draw.choice([" ", " ", "  ", ", ", "\n"]).join(w), ["en", "de", None, "und"][i % 4]))
    return out


@pytest.mark.parametrize("least", [4, 11, 40])
def test_phrases_match_brute_force(spark, least):
    rows = texts()
    df = clashing(frame(spark, rows), "phrase", "n", "k", "lh", "f")
    got = found(df, least=least, top=50)
    assert got and got == sorted(brute(rows, least, top=50))


def test_pruned_summaries_lose_no_frequent_phrase(spark, monkeypatch):
    """Chunks and capacities so small that counters are taken down again and again, and bits that collide."""
    monkeypatch.setattr(module, "CHUNK", 500)
    monkeypatch.setattr(module, "BITS", 18)
    rows = texts() + [(prose(i, 200), "en") for i in range(60)]
    assert found(frame(spark, rows), least=30, spare=1, longest=3) == sorted(brute(rows, 30, 3))


def test_odd_rows(spark):
    rows = [(r[1], r[2]) for r in odd_rows()] + [("a b a b. a b", None)] * 3
    assert found(frame(spark, rows), least=3) == sorted(brute(rows, 3))
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, None), ("", "en"), (" .\n", "en")]), least=1) == []


def test_one_text_is_a_third_of_all_rows(spark):
    rows = [("hot words stand here. hot words", "en")] * 300 + [(prose(i, 20, 50), "en") for i in range(600)]
    assert found(frame(spark, rows), least=100) == sorted(brute(rows, 100))


def test_counts_of_words(spark):
    rows = texts()
    f, n = grams(rows)
    got = {(r["lang"], r["phrase"]): r["f"] for r in frequent_phrases(frame(spark, rows), least=5).collect()}
    assert {k: v for k, v in got.items() if k[1] == ""} == {(k, ""): v for k, v in n.items()}
    assert {k: v for k, v in got.items() if k[1]} == {(k[0], " ".join(k[1:])): v for k, v in f.items() if v >= 5}


def test_a_summary_keeps_what_is_above_mass_over_capacity():
    draw = np.random.default_rng(4)
    for capacity in (3, 20, 100):
        whole, summary = Counter(), Summary(capacity)
        for _ in range(30):
            keys = np.minimum(draw.zipf(1.3, 200), 5000).astype(np.uint32)
            whole.update(keys.tolist())
            summary.merge(keys, np.ones(len(keys), dtype=np.int64))
        mass = sum(whole.values())
        assert len(summary.keys) <= capacity and summary.taken <= mass / (capacity + 1)
        left = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert all(left.get(k, 0) <= c <= left.get(k, 0) + summary.taken for k, c in whole.items())
        assert all(k in left for k, c in whole.items() if c > mass / (capacity + 1))
