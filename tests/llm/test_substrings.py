"""Repeated runs of words against brute force."""

import hashlib
import random

import numpy as np

from paylens.llm.substrings import COVER, PERIOD, WINDOW, cover_anchors, remove_repeated_words
from tests.llm.helpers import clashing, documents, odd_rows, prose, words


def brute(rows, window=WINDOW):
    """(doc_id, n_words, n_removed, sha256) by looking at every window."""
    place, first = [], {}
    for key, text, *_ in rows:
        w = words(text)
        place.append(w)
        for i in range(len(w) - window + 1):
            at = (key is None, key or 0, i)
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, at), at)
    out = []
    for (key, *_), w in zip(rows, place):
        gone = set()
        for i in range(len(w) - window + 1):
            if (key is None, key or 0, i) > first[tuple(w[i : i + window])]:
                gone.update(range(i, i + window))
        rest = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame, **options):
    got = remove_repeated_words(frame, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr)


def shared_passages():
    draw, passage = random.Random(5), prose(50, 90).split(" ")
    rows = []
    for i in range(60):
        a = draw.randrange(0, 50)
        cut = passage[a : a + draw.randrange(15, 40)]
        body = prose(100 + i, draw.randrange(0, 40)).split(" ") + cut + prose(200 + i, draw.randrange(0, 30)).split(" ")
        rows.append((i * 37 % 61, ("\t" if i % 2 else " ").join(body + (cut if i % 5 == 0 else []))))
    rows.append((500, " ".join(["same"] * 300)))
    rows.append((501, " ".join(["a", "b", "c"] * 100)))
    return rows


def test_every_shift_has_a_shared_cover_place():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + k) % PERIOD in COVER and (j + k) % PERIOD in COVER for k in range(PERIOD))


def test_repeats_match_brute_force(spark):
    rows = shared_passages()
    frame = clashing(documents(spark, rows), "n_words", "h", "_text", "full", "id2", "more")
    assert found(frame) == brute(rows)
    by_id = {r["doc_id"]: r for r in remove_repeated_words(frame).collect()}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in by_id.values())
    assert set(by_id[500].asDict()) == {*frame.columns, "n_removed", "kept_sha256"}


def test_other_windows_and_covers(spark):
    rows = shared_passages()
    assert found(documents(spark, rows), window=9, period=7, cover=(0, 1, 3)) == brute(rows, 9)
    assert found(documents(spark, rows), window=12, period=3, cover=(0, 1)) == brute(rows, 12)


def test_repeats_on_odd_rows(spark):
    rows = odd_rows()
    assert found(documents(spark, rows)) == brute(rows)
    assert remove_repeated_words(documents(spark, [])).count() == 0


def test_a_third_of_all_rows_is_one_text(spark):
    """Equal texts under many keys, under one key and under none, and edited versions beside them."""
    base = prose(80, 60).split(" ")
    edited = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in (5, 20, 33, 50)]
    rows = [(i, " ".join(base)) for i in range(10, 200)] + [(7, " ".join(base))] * 100 + [(None, " ".join(base))] * 50
    rows += [(300 + i, t) for i, t in enumerate(edited)] + [(3, edited[1]), (400, prose(9, 80)), (None, prose(81, 50)), (None, prose(81, 50))]
    assert found(documents(spark, rows)) == brute(rows)


def test_anchors_are_a_third_of_all_words():
    hashes = np.random.default_rng(1).integers(1, 1 << 62, 13_000).astype(np.uint64)
    row, place, h, d = cover_anchors(hashes, np.array([0, 13, 13_000]), WINDOW, PERIOD, COVER)
    assert (row == 1).all() and abs(len(place) / 13_000 - 4 / 13) < 0.01
