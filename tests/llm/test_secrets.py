import hashlib
import random
import re
import string

import pytest

from laneatlas.llm.secrets import TokenEfficiency, base_spans, find_secrets, is_digest, is_identifier, masked, scan

RANDOM = "q7Xv2LpZ9dKf3RtWb8Yn"


@pytest.fixture(scope="module")
def ratio():
    return TokenEfficiency().ratio


def loops(text):
    """The fixed patterns in one plain pass for each kind, matches that fail dropped afterwards."""
    out = []
    for kind, p, good in (
        ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        out += [(kind, m.start(), m.end()) for m in p.finditer(text) if good(m)]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


PIECES = ["token", "SECRET", "api_key", "apikey", "passwd", "ſecret", "toKen", ":", "=", " ", '"', "'", "abc", "deadbeef" * 3, "AKIA" + "Z9" * 8, "AKIA", "12", "é", "\n", "==", "ab12" * 6, ". "]


def test_base_spans_equal_plain_loops(corpus):
    rng = random.Random(5)
    for text in [*(t or "" for t in corpus.values()), *("".join(rng.choices(PIECES, k=30)) for _ in range(3000))]:
        assert sorted(base_spans(text)) == sorted(loops(text))


def test_a_failing_match_uses_up_its_text():
    assert base_spans("secret:token:abcdefgh") == [] and base_spans("token:abcdefgh") == [("assign", 0, 14)]


def test_random_strings_are_found_and_words_are_not(ratio, corpus):
    rng = random.Random(3)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in (20, 24, 32, 40, 64) for _ in range(60)]
    assert sum(any(s[0] == "random" for s in scan(f"see {k} there", ratio)[1]) for k in keys) >= 0.99 * len(keys)
    for word in ("internationalization", "user_account_balance_2024", "getElementByIdentifier", "550e8400-e29b-41d4-a716-446655440000", "4550997810720808", "2024-01-02T10:00:00Z", "https://example.org/some/path/of/words", "Donaudampfschifffahrtsgesellschaft", "A" * 40):
        assert [s for s in scan(word, ratio)[1] if s[0] == "random"] == [], word
    assert not [t for t in corpus.values() for s in scan(t or "", ratio)[1] if s[0] == "random"]


def test_digests_and_identifiers():
    for n in (32, 40, 64):
        digest = hashlib.sha512(b"x").hexdigest()[:n]
        assert is_digest(digest) and is_digest(digest.upper())
    assert not is_digest("a1" * 11) and is_digest(RANDOM, frozenset([RANDOM]))
    assert is_identifier("snake_case_name") and is_identifier("camelCaseName-12") and not is_identifier(RANDOM)


def test_spans_of_a_random_string_inside_an_assignment_are_not_named_twice(ratio):
    base, every = scan(f"password = {RANDOM} and {RANDOM}", ratio)
    assert base == [("assign", 0, 31)] and every == [("assign", 0, 31), ("random", 36, 56)]


def test_rows(spark, edges, ratio):
    rows = [*edges, (10, f"ü token: {RANDOM}"), (11, "A1b2" * 200_000), (None, RANDOM)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, spans int, n_hex string")
    got = sorted(map(tuple, find_secrets(df).collect()), key=str)
    want = []
    for i, t in rows:
        base, every = scan(t or "", ratio)
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert base == loops(t or "")
        want.append((i, *(sum(s[0] == k for s in every) for k in ("assign", "access", "hex", "random")), hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
    assert got == sorted(want, key=str)
    assert find_secrets(df.limit(0)).count() == 0


def test_masked(spark):
    df = spark.createDataFrame([(1, f"a token={'a1' * 15} b {RANDOM}"), (2, None), (3, "plain")], "doc_id long, text string")
    assert [r.text for r in masked(df).orderBy("doc_id").collect()] == ["a [secret] b [secret]", None, "plain"]
