"""Operators over odd rows and empty tables."""

import zlib

import numpy as np
import pytest

from ravelin.llm import decontam, histsort, hostrules, langid, licenses, packing, partenum, rans, warc
from ravelin.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"


def test_shards(odd, none):
    got = histsort.shards_by_bytes(odd).collect()
    assert len(got) == odd.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in odd.collect()}
    assert all(r.size == sizes[r.doc_id] for r in got)
    assert histsort.shards_by_bytes(none).collect() == []


def test_shard_bytes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = histsort.shards_by_bytes(docs).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 8 and got.max() - got.min() <= 2 * 33_048
    copies = spark.createDataFrame([(k, "the same text") for k in range(4000)], "doc_id long, text string")
    cut = histsort.shards_by_bytes(copies).toPandas().groupby("shard")["size"].sum()
    assert len(cut) == 8 and cut.max() - cut.min() <= 3 * 14


def test_tokens_round_trip(odd, none, spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    folder, table, manifest = rans.write_tokens(odd, path)
    got = sorted(rans.read_tokens(spark, folder, table, manifest).collect(), key=lambda r: r.start)
    rows = sorted((r for r in odd.collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    at = 0
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    for r, row in zip(got, rows, strict=True):
        ids = np.array(whole.encode(row.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder, table, manifest = rans.write_tokens(none, path)
    assert rans.read_tokens(spark, folder, table, manifest).collect() == []


def test_coder_finds_damage():
    ids = (np.random.default_rng(1).zipf(1.4, 100_000) % 40_000).astype(np.uint32)
    table = rans.Table.of(np.bincount(ids))
    data = rans.file_bytes(np.arange(2), np.array([60_000, 40_000]), ids, table)
    docs, counts, back = rans.read_file(data, table)
    assert (back == ids).all() and counts.tolist() == [60_000, 40_000]
    for place in (20, len(data) // 2, len(data) - 30):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            rans.read_file(bytes(broken), table)


def test_languages(odd, none, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()), vocabulary("piece_bpe_32k.model"), sample=60, rounds=2)
    got = langid.predict(docs.withColumn("held", langid.held_out()), model, keep=["doc_id", "lang", "held"]).where("held").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    rows = {r.doc_id: r for r in langid.predict(odd, model, keep=["doc_id"]).collect()}
    assert len(langid.predict(odd, model, keep=["doc_id"]).collect()) == odd.count()
    assert all((rows[k].lang_pred, rows[k].score) == ("und", 0.0) for k in (0, 1, 2, 50)) and rows[3].lang_pred != "und"
    assert langid.predict(none, model, keep=["doc_id"]).collect() == []
    empty = langid.fit(none, vocabulary("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(odd, empty, keep=["doc_id"]).collect()} == {"und"}


def test_all_segmentations_are_summed():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    p = np.array([[0.1], [0.2], [0.3], [0.25], [0.15], [1e-9]])
    lattice = langid.Lattice(["ab"], pieces)
    ways = 0.1 * 0.2 * 0.3 + 0.1 * 0.25 + 0.15 * 0.3
    assert lattice.forward(p)[0, 3, 0] == pytest.approx(ways)
    assert lattice.expected(p[:, 0], np.array([2.0]))[3] == pytest.approx(2 * 0.1 * 0.25 / ways)


def brute_groups(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]) or rows[a].doc_id == rows[b].doc_id:
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r.doc_id), r.doc_id)
    return [(r.doc_id, len(s), least[root(k)]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_groups(odd, none):
    rows = [r for r in odd.collect() if r.doc_id is not None]
    got = partenum.jaccard_groups(odd).collect()
    assert len(got) == odd.count()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(brute_groups(rows))
    assert partenum.jaccard_groups(none).collect() == []


def test_groups_of_near_copies(spark):
    import random

    rng = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 150, 600]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 14)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(own + ["shared tail of many texts in this little set of rows"] * rng.randrange(2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = partenum.jaccard_groups(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_groups(docs.collect()))


def test_warc(odd, none, spark):
    pages = odd.selectExpr("doc_id AS page_id", "source AS url", "CASE WHEN doc_id % 2 = 0 THEN repeat('<p>copy</p>', 200) ELSE text END AS html", "word", "lang AS text")
    folder, manifest = warc.write_warc(pages, range_bytes=2000, roll_bytes=500)
    got = warc.read_warc(folder, manifest).collect()
    rows = [r for r in pages.collect() if r.page_id is not None]
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((r.page_id, len((r.html or "").encode())) for r in rows)
    last = max(r.page_id for r in rows if r.page_id % 2 == 0)
    for r in got:
        revisit = r.page_id % 2 == 0 and r.page_id != last
        assert (r.record_type, r.refers_to) == (("revisit", last) if revisit else ("response", None))
    assert manifest.count() > 1
    again, manifest2 = warc.write_warc(pages.repartition(3), range_bytes=2000, roll_bytes=500)
    key = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert key(manifest) == key(manifest2)
    folder, manifest = warc.write_warc(none.selectExpr("doc_id AS page_id", "source AS url", "text AS html"))
    assert warc.read_warc(folder, manifest).collect() == []


def test_licenses(odd, none, spark):
    got = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert len(licenses.scan(odd).collect()) == odd.count()
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels, got[4].labels, got[4].score) == (10, 1, 0, 0, "mit", "mit", 1.0)
    assert (got[0].n_words, got[1].n_words, got[0].labels, got[0].first_word) == (0, 0, "", None)
    text = "x This work is licensed under the GNU General Public License, version 3. cc by nc cc by nc"
    r = licenses.scan(spark.createDataFrame([(1, text), (2, "licensed under the general version of things")], "doc_id long, text string")).collect()
    r = {x.doc_id: x for x in r}
    assert (r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels, r[1].labels) == (2, 13, 16, "cc-by-nc", "cc-by-nc,gpl-3")
    assert (r[2].labels, r[2].n_base) == ("", 0)
    shifted = "Permission is hereby granted free of charge to any person who is obtaining a copy of this software and associated documentation files"
    assert licenses.scan(spark.createDataFrame([(1, shifted)], "doc_id long, text string")).first().labels == "mit"
    assert licenses.scan(none).collect() == []


def test_rules(odd, none, spark):
    got = {r.doc_id: r for r in hostrules.judged(odd).collect()}
    assert len(hostrules.judged(odd).collect()) == odd.count()
    assert got[0].base_failed and got[50].base_failed and not got[5].base_failed and got[6].n_repeat_words == 45
    bad = spark.createDataFrame([(k, "few words", "bad") for k in range(95)] + [(k, " ".join(map(str, range(k, k + 30))), "bad" if k < 100 else "good") for k in range(95, 900)], "doc_id long, text string, source string")
    kept = {r.doc_id for r in hostrules.judged(bad).where("kept").collect()}
    assert kept == set(range(100, 900)) and {r.doc_id for r in hostrules.kept_rows(bad).collect()} == kept
    assert hostrules.judged(none).collect() == []
    assert hostrules.kept_rows(odd).columns == odd.columns


def test_packing(odd, none):
    path = vocabulary("byte_bpe_50k.json")
    got = packing.packed_documents(odd, path).toPandas()
    assert got.length.between(1, 1024).all()
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 1024
    long = got[got.doc_id == 5].sort_values("piece")
    assert (long.length[1:] == 1024).all() and long.start.tolist() == (long.length.cumsum() - long.length).tolist()
    assert set(got[got.doc_id.isin([0, 1, 50])].length) == {1}
    assert packing.packed_documents(none, path).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 1024, 400)
        where, offset, room = packing.best_fit(sizes)
        assert packing.lower_bound(np.bincount(sizes, minlength=1025)) <= len(room)
        assert (np.bincount(where, sizes) + room == 1024).all()
    assert packing.lower_bound(np.bincount([600] * 7, minlength=1025)) == 7
    assert packing.lower_bound(np.bincount([400] * 7, minlength=1025)) == 4


def test_exchange_saves_sequences(spark):
    rows = [(k, 0, 0, 700 if k % 2 else 324, 0) for k in range(2000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.packed(parts, partition_rows=100).select("sequence_id").distinct().count() == 1000
    found = packing.packed(parts, first_rows=50)
    assert found.select("sequence_id").distinct().count() == 1000 and found.count() == 2000
    assert {r[0] >> 56 for r in found.select("sequence_id").collect()} > {0}  # some were settled before the exchange, some after


def test_exchange_keeps_what_was_better(spark):
    rng = np.random.default_rng(7)
    rows = [(k, 0, 0, int(x), 0) for k, x in enumerate(rng.integers(200, 700, 3000))]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.packed(parts, partition_rows=400, first_rows=100).collect()
    assert sorted(r.doc_id for r in found) == list(range(3000))
    filled = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    whole = len(packing.best_fit(np.array([r[3] for r in rows]))[2])
    assert max(filled.values()) <= 1024 and len(filled) <= 1.02 * whole


def test_ranges_have_a_bound(spark):
    rows = spark.range(1000).selectExpr("id AS k", "0L AS t", "1 + id % 3 AS w")
    assert len(histsort.key_ranges(rows, "k", "t", "w", 10, most=7)) in (6, 7)
    assert len(histsort.key_ranges(rows, "k", "t", "w", 500)) == 4


def test_token_files_are_rolled(spark):
    path = vocabulary("word_bpe_49k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    folder, table, manifest = rans.write_tokens(docs, path, roll_ids=3000)
    files = manifest.orderBy("part", "seq").collect()
    assert len(files) > 5 and len({r.part for r in files}) == 1 and [r.seq for r in files] == list(range(len(files)))
    cut = sorted(map(tuple, rans.read_tokens(spark, folder, table, manifest).collect()))
    assert cut == sorted(map(tuple, rans.read_tokens(spark, *rans.write_tokens(docs, path)).collect()))


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "One"), (3, None), (4, ""), (None, "tie"), (5, "a b c d e f g h i j k")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.report(decontam.scan(odd, items)).collect()}
    assert (got[10].n_words, got[10].n_hit, got[10].n_items, got[10].contaminated) == (14, 11, 2, True)
    assert (got[11].n_hit, got[3].n_hit, got[3].n_items, got[0].n_hit) == (11, 1, 1, 0)
    # an item without an id hits words and is named nowhere
    assert (got[7].n_hit, got[7].n_items, got[7].contaminated) == (3, 0, True) and got[7].items_sha256 == got[0].items_sha256
    clean = decontam.cleaned(odd, items, drop_share=0.9)
    assert clean.columns == odd.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left[10].split() == ["l", "m", "n"] and 3 not in left and left[5] == {r.doc_id: r.text for r in odd.collect()}[5]
    assert decontam.scan(none, items).collect() == []
    assert {r.contaminated for r in decontam.report(decontam.scan(odd, items.where("false"))).collect()} == {False}


def test_decontamination_in_parts(odd, spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{j % 977}x{j}" for j in range(k, k + 12))) for k in range(0, 900, 5)], "item_id long, text string")
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    once = sorted(map(repr, decontam.report(decontam.scan(docs, items)).collect()))
    monkeypatch.setattr(decontam, "MOST_WINDOWS", 100)
    assert sorted(map(repr, decontam.report(decontam.scan(docs, items)).collect())) == once


def test_decontamination_in_parts_keeps_rows(odd, none, spark, monkeypatch):
    passage = lambda k: " ".join(f"p{k}x{j}" for j in range(30))
    free = lambda n: " ".join(f"free{j}" for j in range(n))
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "One"), (4, ""), (None, "tie"), *[(10 + k, passage(k)) for k in range(8)]], "item_id long, text string")
    rows = [(100 + k, f"{passage(k)} {free(20)} {passage(k + 1)} {free(20)}") for k in range(7)]
    rows += [(100, f"{free(50)} {passage(3)}"), (None, f"{passage(5)} {free(90)}"), (None, free(12)), (None, f"{free(40)} {passage(6)}")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = lambda df: sorted(map(repr, df.collect()))
    scanned, cut = seen(decontam.report(decontam.scan(docs, items))), seen(decontam.cleaned(docs, items))
    wide = seen(decontam.cleaned(odd, items, drop_share=0.9))
    # 60 of 100 words are passages, so these go; of what stays, no word of a passage is left
    assert len(scanned) == docs.count() and not any("p0x" in x or "doc_id=101" in x for x in cut)
    monkeypatch.setattr(decontam, "MOST_WINDOWS", 12)
    assert seen(decontam.report(decontam.scan(docs, items))) == scanned
    assert seen(decontam.cleaned(docs, items)) == cut
    assert seen(decontam.cleaned(odd, items, drop_share=0.9)) == wide
    assert decontam.scan(none, items).collect() == decontam.cleaned(none, items).collect() == []


def brute_links(rows):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = {r.doc_id: set() for r in rows}
    for a, x in enumerate(rows):
        for b, y in enumerate(rows):
            same = len(sets[a] & sets[b])
            if x.doc_id != y.doc_id and same and 100 * same >= 75 * len(sets[a] | sets[b]):
                near[x.doc_id].add(y.doc_id)
    return sorted((r.doc_id, len(near[r.doc_id])) for r in rows)


@pytest.mark.parametrize("block", [512, 4])
def test_all_links_are_counted(odd, spark, monkeypatch, block):
    import random

    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "COLUMNS", 64)
    rng = random.Random(7)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range((8, 60, 200)[family])]
        for copy in range(16):
            # near copies, cut to different lengths, each third one twice
            own = base[: len(base) - rng.randrange(1 + len(base) // 4)]
            if copy % 2:
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            rows += [(1000 + 100 * family + 2 * copy, " ".join(own))]
            rows += [(1001 + 100 * family + 2 * copy, " ".join(own))] if copy % 3 == 0 else []
    # ids with several texts, in one family and across two
    rows += [(1000, rows[30][1]), (1000, rows[31][1]), (1002, rows[5][1]), (1102, rows[50][1]), (7777, rows[3][1]), (7777, rows[40][1])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = partenum.jaccard_groups(docs).collect()
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == brute_links([r for r in docs.collect() if r.doc_id is not None])
