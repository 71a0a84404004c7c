"""The ledger scan against a plain scan by the contract's patterns, increments, and the defined cases."""

import random
import re
from hashlib import sha256

from bookheat.llm import secrets
from bookheat.llm.common import table
from bookheat.llm.secrets_queries import op4_secret_scan
from bookheat.session import scratch_path

SF = "/root/testdata/sf0.01"
RULES = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    return [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in p.finditer(text or "") if ok(m)]


def test_patterns_on_hostile_texts():
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "ſecret", "toKen", ":", "=", " ", '"', "'", "abc", "12345678", "AKIA", "AKI", "A", "F0F0", "deadbeef" * 4, "é😀", "-", ".", "\n", "f" * 31, "g"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert [s for s in secrets.find(text) if s[1] < 3] == sorted(base(text)), text


def test_query(spark):
    got = {r.doc_id: r for r in op4_secret_scan(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    total = 0
    for d in docs:
        want = sorted(base(d.text))
        total += len(want)
        r = got[d.doc_id]
        said = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r.base_sha256 == sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert total


def test_increments(spark):
    ledger = scratch_path(spark, "ledger")
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean")], "doc_id long, text string")
    more = first.unionByName(spark.createDataFrame([(4, "clean"), (5, "secret: 123456789")], "doc_id long, text string"))
    assert secrets.findings(first, ledger).filter("size(spans) > 0").count() == 2
    assert secrets.read_ledger(first, ledger).count() == 2
    assert secrets.findings(more, ledger).filter("size(spans) > 0").count() == 3
    assert secrets.read_ledger(first, ledger).count() == 3
    secrets.findings(more, ledger, rule_version="next").count()
    assert secrets.read_ledger(first, ledger).count() == 6


def test_cases(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc+/=\n-----END RSA PRIVATE KEY-----"
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "y " * 200000 + "passwd = hunter2hunter2", None), (3, key, "x"), (4, "gh" + "p_" + "z" * 36, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    got = secrets.findings(docs).collect()
    assert len(got) == len(rows)
    assert sorted(len(r.spans) for r in got) == [0, 0, 0, 1, 1, 1]
    assert {s.kind for r in got for s in r.spans} == {"assign", "private_key", "code_host_token"}
    assert [r.text for r in secrets.redact(docs).collect() if r.doc_id == 3] == ["[PRIVATE_KEY]"]
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.findings(docs.limit(0)).count() == 0


def test_long_and_encrypted_key_blocks():
    long = "-----BEGIN PRIVATE KEY-----\n" + "MIIE+/=\n" * 9000 + "-----END PRIVATE KEY-----"
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\nMIIEabc\n-----END RSA PRIVATE KEY-----"
    keys = lambda t: [t[a:b] for a, k, b in secrets.find(t) if secrets.KINDS[k] == "private_key"]
    assert keys(f"a {long} b {locked} c") == [long, locked]
    empty = "-----BEGIN PRIVATE KEY----------END PRIVATE KEY-----"
    assert keys(empty + " then " + locked) == [locked] and keys("-----END PRIVATE KEY----- -----BEGIN PRIVATE KEY----- x") == []
    assert keys("-----BEGIN PRIVATE KEY-----" * 50000) == []
