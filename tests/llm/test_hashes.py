"""Words that were made to meet under a known scramble are told apart, and words that do meet are compared."""

import numpy as np
import pyarrow as pa

from ravelin.llm import hostrules, langid, partenum, textops
from ravelin.llm.hashing import Letters

#: Equal under the scramble without a key that stood here before.
PAIR = ("trainingpipeline", "luatjwvvpm>67kh1")
_M = (1 << 64) - 1


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def made_pair(constant, first):
    """A second text of two blocks that met ``first`` under the old scramble with any multiplier: the second block is computed."""
    state = 16 * 0x9E3779B97F4A7C15 & _M
    a = int.from_bytes(first[:8], "little"), int.from_bytes(first[8:], "little")
    other = int.from_bytes(b"zzzzzzzz", "little")
    step = lambda s, b: _mix((s ^ b) * constant & _M)
    return b"zzzzzzzz" + (step(state, a[0]) ^ a[1] ^ step(state, other)).to_bytes(8, "little")


def test_made_pairs_are_told_apart():
    pairs = [tuple(x.encode() for x in PAIR)] + [(b"trainingpipeline", made_pair(c, b"trainingpipeline")) for c in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 3)]
    for key in (textops.OWN, textops.OPEN, textops.new_key()):
        for a, b in pairs:
            data = np.frombuffer(a + b, np.uint8)
            x, y = textops.span_hashes(data, np.array([0, 16]), np.array([16, 32]), fold=False, key=key)
            assert x != y


def test_keys_give_hashes_of_their_own():
    data = np.frombuffer(b"one two" + b"x" * 600, np.uint8)
    spans = np.array([0, 4, 0, 7, 7]), np.array([3, 7, 0, 307, 308])
    a, b = (textops.span_hashes(data, *spans, key=k) for k in (textops.new_key(), textops.new_key()))
    assert len({*a.tolist(), *b.tolist()}) == 10
    assert (textops.span_hashes(data, *spans, key=textops.OPEN) == textops.span_hashes(data, *spans, key=textops.OPEN)).all()


def test_siphash_of_known_words():
    def plain(word, key):
        v = [key[0] ^ 0x736F6D6570736575, key[1] ^ 0x646F72616E646F6D, key[0] ^ 0x6C7967656E657261, key[1] ^ 0x7465646279746573]
        turn = lambda x, by: (x << by | x >> 64 - by) & _M

        def round_():
            v[0], v[2] = v[0] + v[1] & _M, v[2] + v[3] & _M
            v[1], v[3], v[0] = turn(v[1], 13) ^ v[0], turn(v[3], 16) ^ v[2], turn(v[0], 32)
            v[2], v[0] = v[2] + v[1] & _M, v[0] + v[3] & _M
            v[1], v[3], v[2] = turn(v[1], 17) ^ v[2], turn(v[3], 21) ^ v[0], turn(v[2], 32)

        blocks = [int.from_bytes(word[k : k + 8], "little") for k in range(0, max(len(word), 1), 8)]
        for m in [*blocks, len(word)]:
            v[3] ^= m
            round_()
            v[0] ^= m
        v[2] ^= 0xFF
        for _ in range(3):
            round_()
        return v[0] ^ v[1] ^ v[2] ^ v[3]

    found = [b"", b"a", b"12345678", b"123456789", b"x" * 16, b"y" * 200]
    data, ends = np.frombuffer(b"".join(found), np.uint8), np.cumsum([len(w) for w in found])
    got = textops.span_hashes(data, ends - [len(w) for w in found], ends, fold=False, key=textops.OPEN)
    assert got.tolist() == [plain(w, textops.OPEN) for w in found]


def test_made_lines_and_words_are_not_repeated(spark):
    a, b = PAIR
    got = hostrules.text_counts(pa.array([f"{a}\n{b}", " ".join([a, "w", "x", "y", "z", b, "w", "x", "y", "z"])]))
    assert got["n_dup_lines"].tolist() == [0, 0] and got["n_repeat_words"].tolist() == [0, 0]
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} p q r s t"), (4, f"{b} p q r s t")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in partenum.jaccard_groups(docs).collect()}
    assert got == {k: (k, 0) for k in range(1, 5)}


def test_words_with_one_key_have_scores_of_their_own(monkeypatch):
    pieces = {p: k for k, p in enumerate(["▁", *"abcdefgh", "ab", "cd", "▁a"])}
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1), 2).T
    texts = pa.array(["ab cd gh ab", None, "gh", "cd abcdefgh", "ab", "hgfedcba" * 9])
    want = langid.Scorer(pieces, p).texts(texts)
    monkeypatch.setattr(textops, "hashed", lambda raw, starts, ends, key=None: np.full(len(starts), 7, np.uint64))
    got = langid.Scorer(pieces, p)
    for _ in range(2):
        found = got.texts(texts)
        assert np.allclose(found[0], want[0], rtol=1e-6) and (found[1] == want[1]).all()


def test_letters_are_compared():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"x" * 40]
    raw = textops.padded(np.frombuffer(b"".join(words), np.uint8))
    size = np.array([len(w) for w in words])
    starts, kept = np.cumsum(size) - size, Letters()
    kept.add(raw, starts, size)
    entry = np.arange(5)
    assert kept.differ(entry, raw, starts, size).tolist() == []
    assert kept.differ(np.array([1, 2, 3, 4, 0]), raw, starts, size).tolist() == [0, 1, 2, 3, 4]
    other = raw.copy()
    other[starts[3] + 8] = ord("j")
    assert kept.differ(entry, other, starts, size).tolist() == [3]
