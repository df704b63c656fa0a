"""Whole queries against DuckDB where SQL can say the same, else against plain Python."""

import zlib

import duckdb
import numpy as np
import pytest

from ravelin.llm import htmltext, langid, licenses, packing, partenum, textops, warc
from ravelin.llm import queries as llm
from ravelin.llm.tokens import encoder

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = llm.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = con.sql(llm.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    rows = con.sql(f"SELECT {order} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(rows, key=repr)


def test_token_and_packing_queries_hold_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    whole, at = Tokenizer.from_file(llm.vocabulary("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in llm.op2_rans_tokens(spark, DATA).collect()}
    for d in docs:
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    whole = Tokenizer.from_file(llm.vocabulary("byte_bpe_50k.json"))
    rows = llm.op9_best_fit_packing(spark, DATA).collect()
    pieces, want = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}, {}
    for d in docs:
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d.doc_id, k] = (a, b - a, crc(ids[a:b]))
    assert pieces == want
    fill = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    total = sum(x[1] for x in want.values())
    assert max(fill.values()) <= 1024 and len(fill) <= -(-total // 1024) + 3


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_librarys_on_odd_strings(name):
    import random

    import pyarrow as pa

    rng = random.Random(3)
    letters = "abcABC xyz  \n\t'’sStTréÉüñ0123456789.,;:-_()[]{}<>|/\\\"!?£€ßﬁ日本語  İ😀"
    texts = [thue_morse(n, *x) for n in (1024, 2048, 4096, 8192) for x in ("ab", "ba")]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)] + [None, "", "'s 're <|endoftext|> x"]
    own, at = encoder(llm.vocabulary(name)), 0
    for first, end, ids, offsets in own.column(pa.array(texts)):
        for r in range(first, end):
            assert ids[offsets[r - first] : offsets[r - first + 1]].tolist() == own._ids(texts[r] or "").tolist()
            at += 1
    assert at == len(texts)


def test_a_known_piece_is_compared_by_letters(monkeypatch):
    import pyarrow as pa

    own = encoder(llm.vocabulary("byte_bpe_50k.json"))
    own._clear()
    monkeypatch.setattr(textops, "hashed", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64))
    for text in ("one", "two three", "one"):
        assert next(own.column(pa.array([text])))[2].tolist() == own._ids(text).tolist()
    own._clear()


def test_regular_strings_have_hashes_of_their_own():
    texts = [thue_morse(n, *x) for n in (8, 64, 255, 256, 257, 1024, 2048) for x in ("ab", "ba")] + ["", "a", "a\0", "a" * 8, "a" * 9]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    found = textops.span_hashes(data, ends - [len(t) for t in texts], ends, fold=False)
    assert len(set(found.tolist())) == len(texts)
    up = textops.span_hashes(np.frombuffer(b"AbC abc", np.uint8), np.array([0, 4]), np.array([3, 7]))
    assert up[0] == up[1]


def test_license_base_places(spark):
    import re

    def places(words, phrase):
        return [k for k in range(len(words)) if words[k : k + len(phrase)] == phrase]

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in llm.op6_diagonal_licenses(spark, DATA).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (docs[r.doc_id] or "").translate(fold))
        met = [(k, label) for label, phrase in licenses.PHRASES for k in places(words, phrase.split())]
        at = [k for k, _ in met]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(met), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in met})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_whole_license_texts_are_found(spark):
    rows = []
    for k, (label, text) in enumerate(licenses.TEXTS):
        words = text.split()
        changed = words[:20] + ["Some", "Name"] + words[20:60] + words[61:]
        rows += [(2 * k, "before it " + " ".join(changed) + " and after"), (2 * k + 1, " ".join(words[: len(words) // 3]))]
    rows += [(1000, "ordinary words without any license " * 50), (1001, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows + rows[:2], "doc_id long, text string"), phrases=[], templates=licenses.TEXTS).collect()}
    for k, (label, _) in enumerate(licenses.TEXTS):
        assert label in got[2 * k].labels.split(",") and got[2 * k].score > 0.8
        assert label not in got[2 * k + 1].labels.split(",")
    assert (got[1000].labels, got[1000].score, got[1001].n_words) == ("", 0.0, 0)


def test_edited_license_texts_are_found(spark):
    """Lines put in, cut out and replaced: what is left of a text is found while it is most of it, wherever the changes are."""
    import random

    rng, rows, wanted = random.Random(4), [], {}
    whole = [(label, text.split()) for label, text in licenses.TEXTS if len(text.split()) >= 100]
    for label, words in whole:
        for how in ("put", "cut", "changed", "twice"):
            for _ in range(4):
                own, line = list(words), [f"word{rng.randrange(900)}" for _ in range(8)]
                at = rng.randrange(10, len(own) - 18)
                own[at : at + {"put": 0, "cut": 8, "changed": 8, "twice": 0}[how]] = [] if how == "cut" else line
                if how == "twice":
                    at = rng.randrange(10, len(own) - 18)
                    own[at:at] = line[:2]
                wanted[len(rows)] = label
                rows.append((len(rows), "some text before. " + " ".join(own) + " and more behind"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=[], templates=licenses.TEXTS).collect()}
    met = sum(label in got[k].labels.split(",") for k, label in wanted.items())
    assert met >= 0.95 * len(wanted) and all(len(got[k].labels.split(",")) <= 2 for k in wanted)


def test_long_words_are_summed_over_as_a_whole():
    pieces = langid.Pieces({"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5})
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.2], [0.25, 0.1], [0.15, 0.3], [0.05, 0.2], [1e-9, 1e-9]])

    def ways(word, place=0):
        if place == len(word):
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, 4):
            piece = word[place : place + n]
            if len(piece) == n and (piece in pieces or n == 1):
                total = total + p[pieces.get(piece, 6)] * ways(word, place + n)
        return total

    for word in ("ab", "abab", "bababxab", "abababababab"):
        assert langid.long_forward(word, pieces, np.log(p)) == pytest.approx(np.log(ways("▁" + word)))
        lattice = langid.Lattice([word], pieces)
        assert np.exp(langid.long_forward(word, pieces, np.log(p))) == pytest.approx(lattice.forward(p)[0, lattice.size[0]])
        assert langid.long_expected(word, pieces, np.log(p[:, 0])) == pytest.approx(lattice.expected(p[:, 0], np.ones(1)))
    long = "ab" * 5000
    scorer = langid.Scorer(pieces, p)
    found = scorer.logs_of([long])
    assert np.isfinite(found).all() and (found < -1000).all()


def test_scores_of_a_whole_text_are_those_of_its_words():
    import pyarrow as pa

    pieces = langid.vocabulary(llm.vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    p = np.vstack([p, np.full((1, 2), 1e-9)])
    scorer = langid.Scorer(pieces, p)
    text = "Das ist ein Haus. Donaudampfschifffahrtsgesellschaftskapitän! das 123 ist"
    sums, n = scorer.texts(pa.array([text, None, "12 .."]))
    words = ["das", "ist", "ein", "haus", "donaudampfschifffahrtsgesellschaftskapitän", "das", "ist"]
    assert n.tolist() == [7, 0, 0]
    assert sums[0] == pytest.approx(sum(scorer.logs_of([w])[0] for w in words), rel=1e-5)


def test_signatures_meet_for_similar_sets():
    """Of every size: sets that differ in as many elements as a similarity of 0.75 allows share a signature."""
    rng = np.random.default_rng(8)
    counts = np.zeros(1 << partenum.SKETCH_BITS, np.uint32)
    ends = partenum.limits(counts)
    for size in (1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 60, 64, 65, 100, 255, 256, 257, 300, 700, 1024, 1100, 3000):
        for _ in range(12):
            a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
            gone = rng.integers(0, size // 7 + 1)
            more = rng.integers(0, size // 4 + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[: size - gone], rng.integers(1, 1 << 63, more, dtype=np.uint64))))
            same = len(np.intersect1d(a, b))
            if 4 * same < 3 * (len(a) + len(b) - same):
                continue
            found = [partenum.signatures(x, counts, ends) for x in (a, b)]
            assert set(found[0][0].tolist()) & set(found[1][0].tolist())


def test_tallies_bound_the_difference():
    rng = np.random.default_rng(9)
    for size in (3, 70, 400, 3000):
        a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[size // 8 :], rng.integers(1, 1 << 63, size // 5, dtype=np.uint64))))
        x, y = partenum.tally(a), partenum.tally(b)
        fewer = min(len(x), len(y))
        apart = np.abs(partenum.folded(x[None], fewer).astype(int) - partenum.folded(y[None], fewer).astype(int)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_archives_are_the_same_bytes_in_any_order(spark):
    import random

    rows = [(7, "https://x/a", f"<p>{'long ' * 300}{k % 3}</p>") for k in range(20)] + [(k, "https://x/a", "short" if k % 2 else None) for k in range(20)] + [(7, None, "short"), (7, None, "short")]
    sums, names = [], []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        folder, manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1 + seed), range_bytes=3000, roll_bytes=2000)
        sums.append(sorted((r.file, r.sha256, r.records) for r in manifest.collect()))
        from ravelin.llm.store import filesystem

        fs, root = filesystem(folder)
        ids = []
        for r in manifest.collect():
            with fs.open_input_stream(f"{root}/{r.file}", compression=None) as f:
                ids += [h["WARC-Record-ID"] for h, _ in warc.records(f)]
        names.append(ids)
    assert sums[0] == sums[1] and len(sums[0]) > 2
    assert all(len(set(x)) == len(x) == len(rows) for x in names)


@pytest.mark.parametrize("ids", [[*range(500), 10**12], [*range(500), -(2**62), 2**63 - 1, -(2**63)], [5] * 500 + list(range(20)), [3]])
def test_ranges_are_even_whatever_the_ids_are(spark, ids):
    from ravelin.llm import histsort

    rows = spark.createDataFrame([(k, n, 10) for n, k in enumerate(ids)], "k long, t long, w long").repartition(3)
    cuts = histsort.key_ranges(rows, "k", "t", "w", 200)
    part = cuts.of(np.array(ids, np.int64), np.arange(len(ids)))
    sizes = np.bincount(part)
    assert sizes.max() <= 21 and len(sizes) == len(cuts) == -(-len(ids) // 20)
    order = np.lexsort((np.arange(len(ids)), np.array(ids, np.int64)))
    assert (np.diff(part[order]) >= 0).all()


def test_extraction_is_measured_on_pages_that_were_not_trained_on(spark):
    """Blocks of held-out pages by the rule of their article and main elements, with these two tags hidden from the chain."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    chain = htmltext.fit(pages.where("page_id % 2 = 0"))
    hits = found = wanted = 0
    for r in pages.where("page_id % 2 = 1").collect():
        got = htmltext.examples(r.html or "", True)
        if got:
            labels = chain.decode(got[0])
            hits += sum(a and b for a, b in zip(labels, got[1], strict=True))
            found, wanted = found + sum(labels), wanted + sum(got[1])
    assert hits / found > 0.9 and hits / wanted > 0.9


STAGE_NAMES = ["quality_rules", "language_id", "ngram_jaccard_join", "benchmark_decontamination"]


@pytest.mark.parametrize("name", STAGE_NAMES)
def test_stages_take_odd_rows_and_any_names(spark, odd, none, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    clash = "_text text failed gone_host host pred posterior lang_pred score clean_text row_key items spans root n_links".split()
    wide = lambda df: df.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"'own' AS `{c}`" for c in clash if c != "text"])
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = wide(odd.select("doc_id", "text", "lang", "source", "n_chars").union(base.selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars")))
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns
    got = out.collect()
    assert 0 < len(got) <= docs.count() and all(r["score"] == "own" and r["_text"] == "own" for r in got)
    if name == "ngram_jaccard_join":
        ids = [r.doc_id for r in got if r.doc_id is not None]
        assert len(ids) == len(set(ids))
    assert stage(spark, wide(none.select("doc_id", "text", "lang", "source", "n_chars")), DATA).collect() == []


def test_packing_stage_takes_odd_rows(spark, odd, none):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    assert {r.doc_id for r in stage(spark, odd, DATA).collect()} == {r.doc_id for r in odd.collect()}
    assert stage(spark, none, DATA).collect() == []
    assert packing.CAPACITY == 1024
