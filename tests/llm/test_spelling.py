"""Spelling variants against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ravelin.llm import spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours(word, alphabet):
    cut = {word[:k] + word[k + 1 :] for k in range(len(word))}
    put = {word[:k] + a + word[k + j :] for k in range(len(word) + 1) for a in alphabet for j in (0, 1) if k + j <= len(word)}
    return (cut | put) - {word}


def brute(rows):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    alphabet, form, near = sorted(set("".join(n))), {}, {}
    for w in n:
        near[w] = [x for x in neighbours(w, alphabet) if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=repr) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_odd_rows(spark, odd, none):
    assert sorted(map(tuple, spelling.variants(odd).collect()), key=repr) == sorted(brute([(r.doc_id, r.text) for r in odd.collect()]), key=repr)
    assert spelling.variants(none).collect() == []
    long = "abcdefghij" * 150
    counts = {"colour": 40, "color": 20, "colors": 9, "colur": 3, "aaaaa": 5, "aaaaaa": 12, "Ñandú": 4, "ñandú": 8, "Straße": 3, "STRASSE": 3, "strasze": 6, "abcd": 99, "naïve×÷": 3, "ties": 9, "tiesa": 3, "tiesb": 6, "tiesc": 6, long: 3, long + "x": 7}
    docs = spark.createDataFrame([(k, f"{w}, 3", "c", 1, 2) for k, (w, n) in enumerate(counts.items()) for _ in range(n)] + [(5, None, None, None, None)], "doc_id long, text string, word string, n int, form int").repartition(3)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=repr) == sorted(want, key=repr)
    found = {w[0]: w for w in want}
    assert found["tiesa"][1] == "tiesb" and found[long][1] == long + "x"


def test_damage_follows_the_id(spark):
    rows = [(k, "wordish") for k in range(3000)] + [(None, "wordish wordish")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, spelling.variants(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr) and len(got) > 1


def test_all_candidates_come_once(monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 40)
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    for word in ("a", "aaaa", "abé", "bbaacc", "abcabcabcaa"):
        (same, codes), got = next(spelling.by_length(pa.array([word, word[::-1]]))), []
        for edit, row, place, letter, hashes in spelling.candidates(codes, alphabet):
            for r, p, a, h in zip(row.tolist(), place.tolist(), letter.tolist(), hashes):
                text = spelling.edited(same[r], edit, p, chr(alphabet[a]) if edit != "delete" else "")
                assert not text or spelling.word_hashes(np.array([[ord(c) for c in text]], np.uint32))[0] == h
                got.append((r, text))
        assert len(got) == len(set(got))
        for r in range(2):
            assert {t for k, t in got if k == r} == neighbours(same[r], "abcé")


def test_a_full_filter_only_lets_more_through(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "colour color colour colours colour") for k in range(9)], "doc_id long, text string")
    want = sorted(map(tuple, spelling.variants(docs).collect()), key=repr)
    monkeypatch.setattr(spelling, "MOST_BITS", 8)
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=repr) == want
