"""Suffix sort, minhash and vector graphs against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from paylens.llm import minhash, suffixes
from paylens.llm.components import components
from paylens.llm.hnsw import Graph, near_vectors
from paylens.llm.minhash import keep_one, near_duplicates
from paylens.llm.suffixes import remove_repeats, repeated_starts, sort_suffixes
from tests.llm.helpers import clashing, documents, least_reachable, odd_rows, prose, words


def brute_repeats(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in raw:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), len(t) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return out


def repeating_texts():
    draw, passage = random.Random(5), prose(50, 70)
    texts = [None, "", "short", "ab" * 400, "é" * 300, prose(1, 200), prose(1, 200), passage]
    for i in range(25):
        at = draw.randrange(20, 60)
        body = prose(100 + i, at) + " " + passage[draw.randrange(30) :][: draw.randrange(150, 400)] + prose(200 + i, 30)
        texts.append(body + ("" if i % 3 else " " + passage))
    base = prose(60, 150).split(" ")
    for i in range(15):
        edit = list(base)
        edit[draw.randrange(len(edit))] = f"edit{i}"
        texts.append(" ".join(edit))
    return texts


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats_match_brute_force(spark, most):
    texts = repeating_texts()
    frame = clashing(documents(spark, list(enumerate(texts))), "n_bytes", "h", "_text", "full", "id2")
    got = {r["doc_id"]: r for r in remove_repeats(frame, most_sorted=most).collect()}
    want = brute_repeats(texts, 200)
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert got[i]["text"].encode("utf-8") is not None
        if want[i][1] == 0:
            assert got[i]["text"] == (t or "")


def test_repeats_on_odd_rows(spark):
    rows = odd_rows()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(documents(spark, rows)).collect()]
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 200))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_repeats_under_one_key(spark):
    """Texts of one null key whose 32-bit hashes agree, and many equal rows with edited versions of their text beside them."""
    a, b = prose(70, 60), prose(71, 60)
    even, odd = f"351530 {a}", f"162479 {b}"
    rows = [(None, even), (None, odd), (None, f"1 {a}")]
    base = prose(80, 40).split(" ")
    edited = [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in (5, 20, 33)]
    rows += [(7, " ".join(base))] * 1500 + [(7, t) for t in edited]
    hashes = [r[0] for r in spark.createDataFrame([(even,), (odd,)], "t string").selectExpr("hash(t)").collect()]
    assert hashes[0] == hashes[1] and even != odd
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(documents(spark, rows)).collect()]
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 200))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_sort_equals_plain_sort():
    draw = random.Random(2)
    for _ in range(30):
        data = np.array([draw.randrange(97, 99) for _ in range(120)], dtype=np.uint8)
        n = draw.randrange(1, 40)
        start = np.array([draw.randrange(100) for _ in range(n)])
        length = np.array([draw.randrange(20) for _ in range(n)])
        group = np.sort(np.array([draw.randrange(3) for _ in range(n)]))
        order, agreed = sort_suffixes(data, start, length, group)
        raw = data.tobytes()
        text = [raw[a : a + k] for a, k in zip(start, length)]
        assert [(group[i], text[i]) for i in order] == sorted(zip(group, text))
        plain = suffixes._plain_sort(data, start, length, group)
        assert (plain[1] == agreed).all()


def test_collisions_are_noticed(monkeypatch):
    """With hashes that all collide the sort falls back to bytes and stays right."""
    monkeypatch.setattr(suffixes, "range_hashes", lambda prefix, a, b: np.zeros(len(a), dtype=np.uint64))
    data = np.frombuffer(b"xabcdyabceyabcd", dtype=np.uint8)
    offsets, left, count = np.array([0, 5, 10, 15]), np.array([1, 1, 1]), np.array([2, 2, 2])
    hits = repeated_starts(data, offsets, left, count, np.zeros(3, dtype=np.int64), 4)
    assert [h.tolist() for h in hits] == [[False, True], [True, False], [True, True]]


def shingles(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    number = list(range(len(rows)))
    links = [(i, j) for i in number for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = least_reachable(number, links)
    least = {}
    for i in number:
        if rows[i][0] is not None:
            least[group[i]] = min(least.get(group[i], rows[i][0]), rows[i][0])
    return [(rows[i][0], len(sets[i]), least.get(group[i]) if sets[i] else rows[i][0]) for i in number]


def variants():
    draw, rows = random.Random(4), []
    for g in range(4):
        base = prose(g, 120).split(" ")
        for k in range(30):
            edit = list(base)
            for _ in range(k % 6):
                edit[draw.randrange(len(edit))] = f"x{g}_{k}"
            rows.append((len(rows) * 7 % 1000, " ".join(edit).upper() if k % 4 else " ".join(edit)))
    return rows + [(5000 + i, prose(500 + i, 40)) for i in range(20)]


def test_near_duplicates_match_brute_force(spark):
    rows = variants() + [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 5000]
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(clashing(documents(spark, rows), "node", "t", "n", "d1")).collect()]
    assert sorted(got, key=repr) == sorted(brute_near(rows), key=repr)
    assert near_duplicates(documents(spark, [])).count() == 0


def template(n, words_each=62, fields=1, values=None, seed=9):
    """Copies of one text with words at some places replaced, each by its own word or one of a few values."""
    draw, base, rows = random.Random(seed), prose(77, words_each).split(" "), []
    for i in range(n):
        edit = list(base)
        for k in range(fields):
            at = draw.randrange(6, words_each - 6) if values is None else 10 + 15 * k
            edit[at] = f"own{i}_{k}" if values is None else f"value{k}_{draw.randrange(values)}"
        rows.append((i, " ".join(edit)))
    return rows


def candidates(monkeypatch, frame, **options):
    """Pairs that are checked on full sets, and the result."""
    count, whole = [], minhash._confirmed

    def counted(pairs, sets, percent):
        count.append(pairs.count())
        return whole(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    found = near_duplicates(frame, **options).collect()
    monkeypatch.setattr(minhash, "_confirmed", whole)
    return sum(count), sorted((r["id"], r["n_shingles"], r["component_id"]) for r in found)


def test_a_template_below_the_limit_gives_few_pairs(spark, monkeypatch):
    """Copies at a similarity of 0.7 to 0.85 to each other and 0.84 to the template, in one family."""
    few, found = candidates(monkeypatch, documents(spark, template(300)))
    assert found == sorted(brute_near(template(300)))
    many, _ = candidates(monkeypatch, documents(spark, template(1200)))
    assert few < 300 * 12 and many < 1200 * 12


def test_fields_of_few_values_become_families(spark, monkeypatch):
    """Pages that differ in three fields: those that agree in two are linked, through families of a value."""
    monkeypatch.setattr(minhash, "FEW", 2)
    rows = template(400, words_each=70, fields=3, values=12)
    pairs, found = candidates(monkeypatch, documents(spark, rows))
    assert found == sorted(brute_near(rows))
    far = template(200, words_each=50, fields=3, values=30)
    assert candidates(monkeypatch, documents(spark, far))[1] == sorted(brute_near(far))
    assert candidates(monkeypatch, documents(spark, far), percent=80, halves=11)[1] == sorted(brute_near(far, 80))


def chained(n=60, families=3):
    """Copies of templates, each an edit further from the one before, and copies with own edits: linked by each other only."""
    rows = []
    for t in range(families):
        base = prose(900 + t, 70).split(" ")
        for i in range(n):
            edit = list(base)
            for k in range(i % 9):
                edit[5 + 7 * k] = f"step{t}_{k}"
            if i >= 18:
                edit[(11 * i) % 70] = f"own{t}_{i}"
            rows.append((len(rows), " ".join(edit)))
    return rows


def test_families_are_compared_in_one_place_or_spread(spark, monkeypatch, percent=85):
    """Both ways find what brute force finds. Differences of families that fit in one place are never joined one by one."""
    rows = chained(40, 2) + [(1000 + i, t) for i, t in template(120)]
    spread, whole = [], minhash._spread_pairs
    monkeypatch.setattr(minhash, "_spread_pairs", lambda *a: spread.append(1) or whole(*a))
    for held in (minhash.HELD, 0):
        monkeypatch.setattr(minhash, "HELD", held)
        got = [(r["id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark, rows), percent=percent, halves=11).collect()]
        assert sorted(got) == sorted(brute_near(rows, percent))
        assert not spread or held == 0


@pytest.mark.parametrize("dense", [2, 32])
def test_shared_counts(monkeypatch, dense):
    monkeypatch.setattr(minhash, "_DENSE", dense)
    draw = np.random.default_rng(4)
    lists = [np.unique(draw.integers(-20, 40, draw.integers(1, 30))) for _ in range(50)]
    got = minhash._shared_counts(lists)
    assert all(got[i, j] == (len(np.intersect1d(lists[i], lists[j])) if i < j else 0) for i in range(50) for j in range(50))


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e  F"), (1, "A b c d e  F"), (2, "else"), (None, "a b c d e f"), (None, None), (7, ""), (8, "")]
    got = keep_one(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, "A b c d e  F"), (2, "else"), (None, None), (7, ""), (8, "")], key=repr)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_pipeline_links_pairs_from_080_on(spark):
    """Pairs at 0.818 and 0.846 are linked by the stage, those at 0.778 are not."""
    rows = []
    for g in range(48):
        n, k = [(100, 2), (50, 1), (200, 4), (120, 2), (120, 3)][g % 5]
        base = prose(3000 + g, n + 4).split(" ")
        edit = list(base)
        for i in range(k):
            edit[10 + 15 * i] = f"y{g}_{i}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edit))]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted(r["doc_id"] for r in stage(spark, documents(spark, rows), "").collect())
    assert got == [i for i, _, c in brute_near(rows, 80) if i == c]
    assert len(got) == 48 + 9 and len({c for _, _, c in brute_near(rows)}) == 96


def test_components(spark):
    draw = random.Random(8)
    for n, m in ((60, 40), (200, 300), (5, 0)):
        links = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1000 + (m and 64))]
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links + [(1, 1)], "a long, b long")).collect()}
        want = least_reachable([x for l in links for x in l], links)
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert got == {k: v for k, v in want.items() if k in linked}


def test_vectors_match_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    x = (centres[draw.integers(0, 40, 600)] + 0.07 * draw.normal(size=(600, 16))).astype(np.float32)
    x = np.concatenate([x, x[:1].repeat(40, axis=0), 2 * x[1:3]])
    rows = [(i * 3, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(10_000 + i, v, None) for i, v in enumerate(odd)] + [(None, x[5].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in near_vectors(frame, least_shards=3).collect() if r["id"] is not None}
    y = np.concatenate([x, x[5:6]]).astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    n = near.sum(axis=1) - 1
    group = least_reachable(list(range(len(y))), [(a, b) for a, b in np.argwhere(near).tolist() if a < b])
    want = {3 * i: (int(n[i]), 3 * group[i]) for i in range(len(x))}
    found = sum(got[k][0] for k in want)
    assert found >= 0.99 * n[:-1].sum() and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1] == want[k][1] for k in want) >= 0.99 * len(want)
    assert all(got[10_000 + i] == (0, 10_000 + i) for i in range(6)) and got[10_006] == (1, 10_006) and got[10_007] == (1, 10_006)
    assert near_vectors(frame.limit(0)).count() == 0


def test_a_third_of_all_vectors_is_one_near_group(spark):
    """A beam cannot hold a dense group; every member is found all the same, in seconds."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(6000, 32))
    x[:2000] = draw.normal(size=32) + 0.05 * x[:2000]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    began = time.perf_counter()
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in near_vectors(frame, least_shards=2).collect()}
    assert time.perf_counter() - began < 60
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = y @ y.T >= 0.95
    n = near.sum(axis=1) - 1
    assert n[:2000].min() > 1900
    assert all(got[i] == (n[i], 0 if i < 2000 else i) for i in range(6000))


def test_graph_recall():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, q = Graph(x), x[:300] + 0.05 * draw.normal(size=(300, 24)).astype(np.float32)
    ids, _ = graph.search(q, 64)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, truth)]) >= 9
