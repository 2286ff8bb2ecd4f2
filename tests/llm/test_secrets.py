import random
import re

import pytest

from skimlight.llm import secrets
from skimlight.llm.queries import op6_secrets

from .helpers import empty, odd_documents, table, words

HEX = "9f86d081884c7d659a2feaa0c55ad015"
CASES = [
    ("password: hunter2hunter2", ["assign:0:24"]),
    ('API_KEY="abcdefghijkl" apikey=short', ["assign:0:21"]),
    ("token = 'abcdefghijklm'", ["assign:0:22"]),
    ("é passwd=secret:longlonglonglong", []),  # the first match takes the second keyword with it
    ("AKIAABCDEFGHIJKLMN AKIASHORT AKIAakia", ["access:0:18"]),
    (f"x{HEX}g {HEX[:15]}", ["hex:1:33"]),
    (f"secret={HEX}", ["assign:0:39", "hex:7:39"]),
    ("ſecret=abcdefghijklmnop", []),  # no ASCII letter
    ("secret-key: abcdefghijklmnop", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_base(text, want):
    assert secrets.join_spans(secrets.base_spans(text)).split(",") == (want or [""])


def plain(text):
    """The patterns as they are worded."""
    text, found = text or "", []
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (pattern, group, least) in enumerate([(assign, 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in sorted(found))


def test_random_texts():
    rng = random.Random(1)
    bits = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGH", "abcdef0123", "x.y-z", "é", "\n", "0" * 9, "token=", "="]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert secrets.join_spans(secrets.base_spans(text)) == plain(text), text


def found_in(text, novelty=None, least=0.7):
    spans = secrets.base_spans(text)
    novelty = novelty or secrets.Novelty()
    return [(s, e) for s, e in secrets.candidates(text, spans, 12, 64) if novelty(text[max(0, s - 256) : s] + text[e : e + 256], text[s:e]) >= least]


def test_novelty():
    random_key = "Zk3vQ9xT7mW2pLr8Bn5YcHd1"
    assert found_in(f"Authorization bearer {random_key} end") == [(21, 45)]
    assert found_in(f"{random_key} is the credential") == [(0, 24)]  # the word follows
    assert found_in(f"credential {random_key[:16]}.") == [(11, 27)]
    assert found_in(f"some other words {random_key} end") == []  # no sensitive context
    assert found_in("private key abcdefghijklmnopqrstuvwxyz0123456789") == []  # in the dictionary
    assert found_in(f"login {random_key} and login {random_key}") == []  # seen around
    assert found_in(f"secret = {random_key}") == []  # a base span has it
    assert found_in(f"login at https://{random_key}.example.com/{random_key}") == []  # a URL
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    assert found_in(f"session {jwt} sent") == [(8, 8 + len(jwt))]  # dots belong to it


def plain_candidates(text, taken, least=12, near=64):
    """All strings of the whole text, each looked at by itself."""
    out = []
    for m in secrets.CANDIDATE.finditer(text):
        s, e = m.span()
        own, word = m.group(), secrets.SENSITIVE
        if e - s >= least and re.search("[0-9]", own) and re.search("[A-Za-z]", own) and "//" not in own and "://" not in text[max(0, s - 8) : e]:
            touches = any(a < e and s < b for a, _, b in taken)
            if not touches and (word.search(text, max(0, s - near), s) or word.search(text, e, e + near)):
                out.append((s, e))
    return out


def test_random_candidates():
    rng = random.Random(2)
    bits = ["password", "bearer ", "key", " ", "  ", ".", "=", "AbC1dE2fG3hI4", "x" * 40, "http://", "é", "\n", "9a9b9c9d9e9f9g", " token= ", " the words go on and on for a while so that it ends ", "w " * 40]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        taken = secrets.base_spans(text)
        assert secrets.candidates(text, taken, 12, 64) == plain_candidates(text, taken), text


def planted(seed):
    """Sentences with a secret each, and others with names, versions, paths and words in the same surroundings."""
    rng = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choices(letters, k=n - 2)) + rng.choice("abc") + rng.choice("123")
    talk = lambda: words(rng, rng.randrange(5, 30))
    yes = [lambda k: f"Authorization: Bearer {k}", lambda k: f"the credential is {k}", lambda k: f"login with {k}", lambda k: f"{k} (private key)", lambda k: f"set pwd {k}", lambda k: f"cookie: sid={k}"]
    no = [
        "the private key file is configuration_v2", "session abcdefghijklmnop0123456789", "login to production_database1", "authorization in application/json2", "credential store localhost_0123",
        "see the token at https://www.example.com/path/to/page1", "key " + "a1" * 12, "passwords: access_token1 refresh_token2", "auth version 2024-01-02", "login name user_agent_1234",
    ]
    rows = []
    for i in range(200):
        k = key(rng.randrange(16, 40))
        text = f"{talk()}. {rng.choice(yes)(k)} {talk()}"
        rows.append((i, text, f"novel:{text.index(k)}:{text.index(k) + len(k)}"))
    return rows, [(1000 + i, f"{talk()}. {no[i % len(no)]} {talk()}") for i in range(200)]


def test_planted_secrets(spark):
    secret, other = planted(3)
    rows = [(i, t, "en", "s", 0) for i, t, *_ in [*secret, *other]]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(table(spark, rows)).collect()}
    hit = sum(want in got[i].split(",") for i, _, want in secret)
    wrong = sum("novel" in got[i] for i, _ in other)
    assert hit >= 0.95 * len(secret) and wrong <= 0.02 * len(other), (hit, wrong)


def test_identifiers_of_the_corpus(spark):
    """A name in many surroundings is no secret, one that only copies of a document hold is."""
    rng = random.Random(4)
    name, key = "Kx7Qm2Vz9Rt4Lp1Wd8", "Zr3Ty8Uq5Ns0Bv6Hc2"
    copy = f"{words(rng, 20)} session {key} {words(rng, 20)}"
    rows = [(i, f"{words(rng, 20)} session {name} {words(rng, 20)}", "en", "s", 0) for i in range(5)]
    rows += [(100 + i, copy, "en", "s", 0) for i in range(50)]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(table(spark, rows)).collect()}
    assert all(got[i] == "" for i in range(5)) and all("novel" in got[100 + i] for i in range(50))
    # without the dictionary the name is reported, too
    alone = {r.doc_id: r.spans for r in secrets.scan_secrets(table(spark, rows), dictionary_bytes=0).collect()}
    assert all("novel" in alone[i] for i in range(5))


@pytest.mark.parametrize("clashing", [False, True])
def test_operator(spark, clashing):
    rows = [*odd_documents(), (900, "x " * 50_000 + CASES[0][0], "en", "s", 0), (901, CASES[0][0], "en", "s", 0)]
    got = secrets.scan_secrets(table(spark, rows, clashing=clashing)).collect()
    assert sorted((str(r.doc_id), r.base) for r in got) == sorted((str(i), plain(t)) for i, t, *_ in rows)
    assert all(set(r.base.split(",")) <= set(r.spans.split(",")) or not r.base for r in got)
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in got}[900] == (1, 0, 0)
    assert secrets.scan_secrets(empty(spark)).collect() == []


def test_query_has_the_contract_columns(spark, tmp_path):
    table(spark, odd_documents()).write.parquet(str(tmp_path / "documents.parquet"))
    assert op6_secrets(spark, str(tmp_path)).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
