"""Mixing, packing, encoding, the pipeline and the list of queries."""

import random
import uuid
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paylens.llm import prefix, queries
from paylens.llm.huffman import Pieces, canonical_codes, code_lengths, decode, decode_table, encode, lane_counts, read_ids, write_ids
from paylens.llm.mixing import mix, plan_mix, source_targets
from paylens.llm.packing import best_boundaries, pack
from paylens.session import ensure_checkpoint_dir
from tests.llm.helpers import clashing, documents, odd_rows, prose, words

tokenizers = pytest.importorskip("public_tokenizers")
FILE = tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


def shared_out(sizes):
    """Targets by resharing until none is above three times its size."""
    weight = {s: Fraction(1 + i % 3) for i, s in enumerate(sorted((x for x in sizes if x is not None))) }
    if None in sizes:
        weight[None] = Fraction(1 + (len(sizes) - 1) % 3)
    left, target, todo = Fraction(sum(sizes.values())), {}, set(sizes)
    while todo:
        level = left / sum(weight[s] for s in todo)
        above = {s for s in todo if level * weight[s] > 3 * sizes[s]}
        for s in above or todo:
            target[s] = Fraction(3 * sizes[s]) if above else level * weight[s]
        left -= sum(target[s] for s in above)
        todo -= above or todo
    return {s: float(t) for s, t in target.items()}


def test_targets(spark):
    draw = random.Random(3)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i:02d}" if i else None: draw.choice([0, 1, 5, 40, 1000]) for i in range(n)}
        frame = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
        got = {r["src"]: r["target"] for r in source_targets(frame).collect()}
        assert got == pytest.approx(shared_out(sizes)), sizes


def test_mix_comes_near_its_targets_and_is_repeatable(spark):
    rows = [(i, prose(i, 5 + i % 30), ["a", "b", "b", "b", "b", "c", None][i % 7]) for i in range(400)]
    docs = clashing(documents(spark, rows), "size", "_key", "finish", "_doc")
    planned = plan_mix(docs).collect()
    again = {r["doc_id"]: r["copies"] for r in plan_mix(docs.repartition(5)).collect()}
    assert {r["doc_id"]: r["copies"] for r in planned} == again
    for source in ("a", "b", "c", None):
        mine = [r for r in planned if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= 80 and sum(r["size"] for r in mine) == mine[0]["source_size"]
    assert max(r["copies"] for r in planned) <= 3
    mixed = mix(docs).collect()
    assert len(mixed) == sum(again.values()) and mixed[0].asDict().keys() == set(docs.columns)
    # every stretch of the mix holds the sources in their shares
    half = [r["source"] for r in mixed[: len(mixed) // 2]]
    assert abs(half.count("b") / len(half) - [r["source"] for r in mixed].count("b") / len(mixed)) < 0.1


def test_mix_of_odd_rows(spark):
    got = plan_mix(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows()) and all(r["size"] == len(words(r["text"])) for r in got)
    names = ["_taken", "_end", "_cut", "_key", "_src", "_rank", "_total", "_size", "g", "k"]
    clash = plan_mix(clashing(documents(spark, odd_rows()), *names)).collect()
    assert sorted((r["copies"], r["size"]) for r in clash) == sorted((r["copies"], r["size"]) for r in got)
    assert all(r[n] == (None if r["doc_id"] is None else i) for r in clash for i, n in enumerate(names))
    assert plan_mix(documents(spark, [])).count() == 0
    assert plan_mix(documents(spark, [(1, None), (2, "")])).where("copies > 0").count() == 0


def test_a_third_of_all_rows_is_one_row(spark, monkeypatch):
    """Equal rows, extra columns apart, are dealt to parts; totals, copies and places are those of one window."""
    monkeypatch.setattr(prefix, "EQUAL", 20)
    rows = [(i, prose(i, 3 + i % 9), "ab"[i % 2]) for i in range(300)] + [(1000, prose(5, 7), "a")] * 150 + [(1001, None, None)] * 60
    docs = documents(spark, rows).withColumn("_part", F.monotonically_increasing_id())
    slim = docs.selectExpr("source AS g", "md5(text) AS k", "CAST(size(split(text, ' ')) AS BIGINT) AS n").where("k IS NOT NULL")
    got = prefix.running_total(slim, slim, "g", "k", "n", "upto").collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["upto"])
        assert [r["upto"] for r in mine] == np.cumsum([r["n"] for r in mine]).tolist()
    planned = plan_mix(docs).collect()
    assert sorted(r["_part"] for r in planned) == sorted(r["_part"] for r in docs.collect())
    for source in ("a", "b", None):
        mine = [r for r in planned if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 12
    kinds = lambda found: sorted((r["doc_id"], r["copies"], r["finish"] or 0) for r in found)
    assert kinds(planned) == kinds(plan_mix(docs.repartition(5)).collect())
    packed = pack(docs, buckets=4, budget=60).collect()
    assert len(packed) == len(rows) == len({(r["bucket"], r["batch"], r["slot"]) for r in packed})
    for bucket in {r["bucket"] for r in packed}:
        mine = sorted((r["batch"], r["slot"]) for r in packed if r["bucket"] == bucket)
        height = max(1, 60 // next(r["boundary"] for r in packed if r["bucket"] == bucket))
        assert mine == [divmod(i, height) for i in range(len(mine))]


def test_boundaries_are_optimal():
    draw = random.Random(1)
    for _ in range(30):
        lengths = sorted(draw.sample(range(1, 40), draw.randrange(1, 8)))
        counts = [draw.randrange(1, 9) for _ in lengths]
        sums = [a * b for a, b in zip(lengths, counts)]
        k = draw.randrange(1, 5)

        def padding(ends):
            return sum(c * (next(e for e in sorted(ends) if e >= x) - x) for x, c in zip(lengths, counts))

        def best(chosen, rest):
            tries = [padding([*chosen, lengths[-1]])]
            if len(chosen) < k - 1:
                tries += [best([*chosen, x], rest[i + 1 :]) for i, x in enumerate(rest)]
            return min(tries)

        got = best_boundaries(lengths, counts, sums, k)
        assert len(got) <= k and got[-1] == lengths[-1] and padding(got) == best([], lengths[:-1])


def test_batches_keep_to_the_budget(spark):
    rows = [(i, prose(i, 1 + i * i % 97)) for i in range(500)] + odd_rows()
    got = pack(clashing(documents(spark, rows), "slot", "_nth", "length"), buckets=6, budget=300).collect()
    assert len(got) == len(rows) and len({r["bucket"] for r in got}) <= 6
    places = {(r["bucket"], r["batch"], r["slot"]) for r in got}
    assert len(places) == len(rows)
    for r in got:
        assert r["length"] == len(words(r["text"])) + 1 and r["padding"] == r["boundary"] - r["length"] >= 0
        height = max(1, 300 // r["boundary"])
        assert r["slot"] < height
    for bucket in {r["bucket"] for r in got}:
        mine = sorted((r["batch"], r["slot"]) for r in got if r["bucket"] == bucket)
        height = max(1, 300 // next(r["boundary"] for r in got if r["bucket"] == bucket))
        assert mine == [divmod(i, height) for i in range(len(mine))]
    assert pack(documents(spark, [])).count() == 0


def test_huffman_round_trip():
    draw = np.random.default_rng(5)
    for size, n, limit in ((1, 10, 18), (2, 0, 18), (300, 5000, 9), (50_000, 60_000, 18), (40, 3000, 6)):
        ids = np.minimum(draw.geometric(0.05, n) - 1, size - 1).astype(np.uint32) if n else np.zeros(0, dtype=np.uint32)
        counts = np.bincount(ids, minlength=size)
        lengths = code_lengths(counts, limit)
        codes = canonical_codes(lengths)
        assert lengths.max(initial=0) <= max(limit, 1)
        if np.count_nonzero(counts) > 1:
            assert sum(Fraction(1, 2 ** int(x)) for x in lengths if x) == 1
        payload, at = encode(ids, codes, lengths)
        assert (decode(payload, at, lane_counts(n), decode_table(lengths)) == ids).all()


def test_code_lengths_are_optimal():
    """Package-merge equals Huffman's algorithm where the limit does not bind."""
    import heapq

    draw = random.Random(2)
    for _ in range(20):
        counts = [draw.randrange(1, 200) for _ in range(draw.randrange(2, 30))]
        heap = list(counts)
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            two = heapq.heappop(heap) + heapq.heappop(heap)
            cost += two
            heapq.heappush(heap, two)
        assert int((code_lengths(np.array(counts), 30).astype(int) * counts).sum()) == cost


def test_pieces_equal_the_library():
    pieces = Pieces(open(FILE, encoding="utf-8").read(), most=50)
    texts = ["a  b", "a\n b", " x", "x ", "a \n\n b\tc", "it's  the one\n\nnew", "", "a\nb", "1 2\n3's don't", "<|endoftext|> x", None,
             "a, b. (c) d), 'e' f's. é, à. x…, a b y’. l'a.\nB, c; -- . a.b.c. “q”.", "\n", "don't, it's. we'll! they'd? I'm'", "x\x1cy", " .", "a.\n.b",
             "no break sp ace 　 x\u0085y", "日本語 テスト, 漢字。", "🙂 🙂, a🙂. b"]
    draw = random.Random(9)
    texts += ["".join(draw.choices("ab1 ,.'\n\té…", k=30)) for _ in range(400)] + [prose(1, 3000)]
    for _ in range(2):
        assert [x.tolist() for x in pieces.encode(texts)] == pieces.library([t or "" for t in texts])


def test_added_tokens_are_as_the_library_has_them():
    from tokenizers import Tokenizer

    texts = ["a b<|endoftext|>c d", "plain text", "<|endoftext|>", "x <|endoftext|> y <|endoftext|>", "a <|endof text|>"]
    plain = [e.ids for e in Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)]
    pieces = Pieces(open(FILE, encoding="utf-8").read())
    for _ in range(2):
        assert [x.tolist() for x in pieces.encode(texts)] == plain
    assert len(plain[2]) == 1


def test_written_ids_read_back(spark):
    rows = odd_rows() + [(20 + i, prose(i, 50)) for i in range(40)]
    path = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(clashing(documents(spark, rows), "n", "ids", "count"), path, FILE, block=500)
    got = read_ids(spark, path)
    crc = read_ids(spark, path, as_bytes=True).selectExpr("start", "crc32(ids) AS ids_crc32").collect()
    library = Pieces(open(FILE, encoding="utf-8").read()).library
    want = sorted((r[0] is not None, r[0] or 0, ids) for r, ids in zip(rows, ([*x, 0] for x in library([r[1] or "" for r in rows]))))
    found = sorted(got.collect(), key=lambda r: r["start"])
    assert [(r["id"] is not None, r["id"] or 0) for r in found] == [w[:2] for w in want]
    assert sorted((r["id"] is not None, r["id"] or 0, r["ids"]) for r in found) == want
    assert [r["start"] for r in found] == np.cumsum([0, *(len(r["ids"]) for r in found)])[:-1].tolist()
    by = {r["start"]: r["ids_crc32"] for r in crc}
    assert all(by[r["start"]] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in found)
    empty = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, []), empty, FILE)
    assert read_ids(spark, empty).count() == 0


def test_pipeline_keeps_clean_documents_once(spark, tmp_path):
    rows = [(i, prose(i, 60), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, prose(3, 60), "s0") for i in range(5)]  # copies of document 3
    shared = prose(900, 60)
    rows += [(200 + i, f"{prose(300 + i, 40)} {shared}", "s1") for i in range(2)]
    rows += [(300 + i, prose(400 + i, 40) + " scumbag", "s2") for i in range(3)]
    rows += [(400, None, None), (401, "", "s0"), (None, "lost key", "s1")]
    labels = [(i, 1, 0) for i in range(60)] + [(900 + i, 1, 1) for i in range(20)]
    train = [(900 + i, prose(700 + i, 40) + " scumbag", "s2") for i in range(20)]
    documents(spark, rows + train).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark.read.parquet(f"{tmp_path}/documents.parquet"), "size", "id", "th", "h", "_doc")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {300, 301, 302, *range(900, 920)} & set(after["toxicity"]) and set(range(60)) <= set(after["toxicity"])
    assert 3 in after["near_duplicates"] and not set(range(100, 105)) & set(after["near_duplicates"])
    assert after["suffix_dedup"][200].strip() == prose(300, 40) and set(range(60)) <= set(after["suffix_dedup"])
    assert set(after["mixing"]) <= set(after["suffix_dedup"])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert packed.count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
