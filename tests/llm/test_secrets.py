"""The secret scan against Python's patterns, and its models on strings they weren't trained on."""

import base64
import hashlib
import re

import pytest

from ravelin.llm import secrets
from ravelin.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return secrets.fit(secrets.samples(spark.read.parquet(f"{DATA}/documents.parquet")))


def ratio(run, table):
    return sum(table[ord(a) * 128 + ord(b)] for at in range(0, len(run), secrets.PIECE) for a, b in zip(run[at : at + secrets.PIECE], run[at + 1 : at + secrets.PIECE]))


def brute(text, table):
    text, base, own = text or "", [], []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, (pattern, fits) in enumerate([(assign, lambda m: len(m[2]) >= 8), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]):
        base += [(m.start(), k, m.end()) for m in pattern.finditer(text) if fits(m)]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if ratio(m[0], table) >= secrets.LEAST_RATIO and not any(a < m.end() and b > m.start() for a, _, b in base):
            own.append((m.start(), 3, m.end()))
    names = [",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x)) for x in (base, base + own)]
    return (*[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(names[0].encode()).hexdigest(), names[1])


def code(k, n=44):
    return base64.b64encode(hashlib.blake2b(str(k).encode()).digest()).decode()[:n]


ODD = [
    'token = "abcdefgh" TOKEN:short Passwd=\'x1234567\' api_key : A/b+c=d.e_f-g apikey==== secret',
    "token=passwd:longvalue1234 token=secret=abcdefgh passwordpassword:12345678 passſword:12345678 toKen:12345678",
    "AKIAABCDEFGHIJKL AKIAABCDEFGHIJK AKIAAKIAAKIAAKIAX xAKIA0000000000000 akiaabcdefghijklm",
    "0123456789abcdef0123456789abcdef 0123456789abcdef0123456789abcde 😀é 0123456789ABCDEF0123456789ABCDEFff00",
    "secret : abcdefgh secret  :  \"abcdefgh",
    f"😀 é {code(1)} end {code(2)}{code(3)} getElementByIdAndParseTheResult /usr/local/share/applications/default",
    f"key {code(4, 19)} {code(5, 20)}-{code(6, 3)} {hashlib.sha1(b'x').hexdigest().upper()}",
    "x" * 3000 + " " + "".join(code(k, 60) for k in range(100)) + " " + "deadbeef" * 4000 + " " + "token=" + "Zz9" * 9000,
    "=" * 40 + "\n" + "-" * 80 + "\n" + "1" * 30,
    "",
    None,
]


def test_places_of_odd_texts(spark, table, odd, none):
    docs = spark.createDataFrame([(k, x, 1, "s", "r") for k, x in enumerate(ODD)] * 2 + [(None, ODD[0], 1, "s", "r")], "doc_id long, text string, row int, kind string, spans string")
    got = secrets.scan(docs.repartition(3), table).collect()
    want = [(d, *brute(x, table)) for d, x in [*list(enumerate(ODD)) * 2, (None, ODD[0])]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, secrets.scan(odd, table).collect()), key=repr) == sorted(((r.doc_id, *brute(r.text, table)) for r in odd.collect()), key=repr)
    assert secrets.scan(none, table).collect() == []


def test_query_holds_every_place(spark, table):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = llm.op12_markov_secrets(spark, DATA).collect()
    assert len(got) == len(texts) and all(tuple(r)[1:] == brute(texts[r.doc_id], table) for r in got)


def test_models_tell_random_strings_from_identifiers(spark, table):
    random = [code(k, 24 + k % 30) for k in range(1000, 1500)] + [hashlib.md5(str(k).encode()).hexdigest()[:24] for k in range(200)]
    plain = "customerShippingAddressController get_default_locale_settings AbstractSingletonProxyFactoryBean MAXIMUM_UPLOAD_FILE_SIZE_LIMIT".split()
    plain += "content/articles/summer-holiday-pictures donaudampfschifffahrtsgesellschaft anticonstitutionnellement_francais".split()
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() for w in re.findall("[a-z]{9,}", r.text or "")})
    plain += ["_".join(words[k : k + 3]) for k in range(0, len(words) - 3, 3)] + ["".join(w.title() for w in words[k : k + 3]) for k in range(0, len(words) - 3, 3)]
    assert sum(ratio(x, table) >= secrets.LEAST_RATIO for x in random) >= 0.98 * len(random)
    assert sum(ratio(x, table) >= secrets.LEAST_RATIO for x in plain) <= 0.01 * len(plain)


def test_models_without_documents(spark, none):
    assert len(secrets.fit(secrets.samples(none))) == 128 * 128
