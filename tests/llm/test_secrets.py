import hashlib
import random
import re
import time

import pandas as pd
import pytest

from lodestack.llm import secrets as s

from ..conftest import SF

KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def naive(text):
    """The base patterns by a scan that tries every place in turn."""
    out, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    at = 0
    while at < len(text):
        key = next((k for k in KEYS if low.startswith(k, at)), None)
        m = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").match(text, at + len(key)) if key else None
        if m:
            if len(m[1]) >= 6:
                out.append((at, 0, m.end()))
            at = m.end()
        else:
            at += 1
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_base_spans_by_a_naive_scan(spark):
    rng = random.Random(4)
    parts = ["password", "TOKEN", "api_key", "ApiKey", "secret", "ſecret", "=", ":", " ", "'", '"', "abc123", "x", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "漢", "\n", "passwd="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    for t in texts:
        assert [(x.start, x.kind, x.end) for x in s.base_spans(t)] == naive(t), t
    df = spark.createDataFrame(list(enumerate(texts[-200:])), "doc_id long, text string")
    for r in s.scan(df).collect():
        want = naive(texts[-200:][r["doc_id"]])
        listed = ",".join(f"{s.KINDS[k]}:{b}:{e}" for b, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def found(text):
    return [text[x.start : x.end] for x in s.literal_spans(text)]


def test_assignments_and_constants():
    assert found('dbPassphrase = "k8J-2mQ.x91Zp"') == ["k8J-2mQ.x91Zp"]
    assert found('K = "Zx81kd92jd83hd7"\nclient_credential: K') == ["Zx81kd92jd83hd7"]
    assert found('A = "Zx81kd92"\nB = A\nauth_key = B + "jd83hd7Q"') == ["Zx81kd92", "jd83hd7Q"]
    assert found("<conn privateKey='Ab12Cd34Ef56' />") == ["Ab12Cd34Ef56"]
    assert found("aws: { accessKey: Ab12Cd34Ef56Gh78 }") == ["Ab12Cd34Ef56Gh78"]
    assert found("export MY_PWD=s3cr3tV4lue99") == ["s3cr3tV4lue99"]
    assert found('a = b\nb = a\npassword = a') == []
    for harmless in ('title = "Zx81kd92jd83hd7"', "passphrase = ${VAULT}", "pwd: changeme_now", "credential = None", 'pwd = "two words here"', "The key: to success", "if key == value"):
        assert found(harmless) == []


def test_constants_are_the_latest_above():
    assert found('k = "aB3dE5fG7hJ9"\npassword_x = k\nk = "zY8xW6vU4tS2"\nsecret_y = k') == ["aB3dE5fG7hJ9", "zY8xW6vU4tS2"]
    assert found('auth_key = later\nlater = "aB3dE5fG7hJ9"\nlater = "zY8xW6vU4tS2"') == ["aB3dE5fG7hJ9"]
    assert found('k = "aB3dE5fG7hJ9"\nk = k + "zY8x"\nmy_pwd = k') == ["aB3dE5fG7hJ9", "zY8x"]
    assert found("my_pwd = my_pwd") == []
    assert found('--db-passphrase="aB3dE5fG7hJ9"') == ["aB3dE5fG7hJ9"]


@pytest.mark.parametrize("n", [20, 1000, 20000])
def test_long_chains(n):
    lines = ['c0 = "aB3dE5fG7hJ9"', *[f"c{i} = c{i - 1}" for i in range(1, n)], f"auth_key = c{n - 1}"]
    assert found("\n".join(lines)) == ["aB3dE5fG7hJ9"]
    assert found("\n".join(reversed(lines))) == ["aB3dE5fG7hJ9"]


def test_joined_values_score_as_the_text_they_make():
    rng = random.Random(6)
    parts = ["x", "***", "aB3dE5fG", "${", "}", "<tag", ">", "{{", "$", "%", "name", "changeme", "-", "example", ".", " ", "é", "9"]
    for _ in range(3000):
        some = [rng.choice(parts) for _ in range(rng.randrange(1, 6))]
        whole, value = s.strength("".join(some)), s.joined([s.joined(some[:2]), *some[2:]])
        assert abs(s.strength(value) - whole) < 1e-12


@pytest.mark.parametrize(
    "made",
    [
        lambda n: "key: x " + "a" * (50 * n),
        lambda n: "key: " + "QUJD" * (12 * n),
        lambda n: "a.b-" * (12 * n) + ' key = "',
        lambda n: 'token = "' * n,
        lambda n: "key=" + "'a' + " * (5 * n),
        lambda n: "key = v\n" * (5 * n),
        lambda n: "password=abcdef123456 " * n,
        lambda n: "\n".join(['c0_0 = "aB3d"', "c0 = c0_0", *[f"c{i} = c{i - 1} + c{i - 1} + c{i - 1} + c{i - 1}" for i in range(1, n // 100)], f"auth_key = c{n // 100 - 1}"]),
    ],
    ids=["run", "base64", "dots", "quotes", "terms", "lines", "spans", "tree"],
)
def test_time_is_linear(made):
    """Eight times the text takes well under the 64 times of a quadratic search."""

    def seconds(n):
        text, best = made(n), []
        for _ in range(2):
            begun = time.process_time()
            s.find(text)
            best.append(time.process_time() - begun)
        return min(best)

    assert seconds(40_000) < 24 * max(seconds(5_000), 0.01)


def test_redaction():
    text = 'k = "Zx81kd92jd83hd7"\ndb_pwd = k\ntoken: abcdef123456 0123456789abcdef0123456789'
    out = s.redact(text)
    assert out == f'k = "{s.MASK}"\ndb_pwd = k\ntoken: {s.MASK} {s.MASK}'
    assert s.find(out)[1] == [x for x in s.find(out)[1] if x.kind == 0]
    assert s.redact("nothing here") == "nothing here"


def test_edges(spark, edge, empty):
    rows = s.scan(edge).collect()
    assert len(rows) == edge.count()
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert s.scan(empty).count() == 0
    out = s.redacted(edge)
    assert out.schema == edge.schema
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out.collect())) == sorted(map(key, edge.collect()))
    one = spark.createDataFrame([(1, "token=abcdef123456", 18)], "doc_id long, text string, n_chars long")
    assert tuple(s.redacted(one).first()) == (1, f"token={s.MASK}", 6 + len(s.MASK))
