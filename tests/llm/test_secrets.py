"""Secret scans: base spans against the plain patterns, lexed spans by example."""

import hashlib
import random
import re

import pytest

from labelloom.llm import queries, secrets


def base(text):
    """The base spans as the patterns are written, limits applied afterwards."""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_on_random_texts():
    r = random.Random(5)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "ſecret", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6",
             "deadbeef" * 4, "0123456789abcdef", "x", "Z9/+_.-", "\n", "é", "日本"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [s for s in secrets.scan(text) if s[0] != "lexed"] == base(text), repr(text)


@pytest.mark.parametrize(("text", "found"), [
    ('a = "Zx81kQ"\nb = \'p0L9vv\'\nDB_PASS = a + b', ["Zx81kQ", "p0L9vv"]),
    ('val = "Ab12Cd34Ef56"\nauth_data = val', ["Ab12Cd34Ef56"]),
    ('val = "Ab12Cd34Ef56"\nval = load()\nauth_data = val', []),
    ("signing-key => `Ab12Cd34Ef56Gh78`", ["Ab12Cd34Ef56Gh78"]),
    ("export PRIVATE_KEY=9fK2mQ7xR4tZ", ["9fK2mQ7xR4tZ"]),
    ('public_key = "Ab12Cd34Ef56Gh78"', []),
    ('credentials: "changeme"', []),
    ('pwd := "correct horse battery"', []),
    ('width = "Ab12Cd34Ef56Gh78"', []),
    ("The key: bring it home", []),
    ('client_credential = "unclosed', []),
])
def test_lexed_spans(text, found):
    assert [text[a:b] for k, a, b in secrets.scan(text) if k == "lexed"] == found


SECRET = "Ab12Cd34Ef56Gh78"


@pytest.mark.parametrize("text", [
    f'const signingKey: string = "{SECRET}";', f'private_key: str = "{SECRET}"', f'var authKey string = "{SECRET}"',
    f'let auth_credential: &str = "{SECRET}";', f'cfg["signing_key"] = "{SECRET}"', f"settings['auth']['signing-key'] = '{SECRET}'",
    f'signing_key = """{SECRET}"""', f"signing_key = \'\'\'{SECRET}\'\'\'", f'signing_key = ("{SECRET}")',
    f'signing_key = (\n    "{SECRET}"\n)', f'webhook_url = "https://hooks.net/{SECRET}"', f'AUTH_HEADER = "{SECRET}"',
    f'{{"signing_key": "{SECRET}"}}', f'static final String privateKey = "{SECRET}";', f'signing_key: Optional[str] = "{SECRET}"',
    'passphrase = "blorft gramble wexing Quoft9"',
])
def test_syntax_of_assignments(text):
    found = [text[a:b] for k, a, b in secrets.scan(text) if k == "lexed"]
    assert len(found) == 1 and (SECRET in found[0] or "gramble" in found[0]), found


@pytest.mark.parametrize(("text", "found"), [
    ('signing_key = "Ab12Cd34" + \\\n  "Ef56Gh78"', ["Ab12Cd34", "Ef56Gh78"]),
    ('signing_key = "Ab12Cd34"\n  + "Ef56Gh78"', ["Ab12Cd34", "Ef56Gh78"]),
    ('signing_key = ("Ab12Cd34"\n  "Ef56Gh78")', ["Ab12Cd34", "Ef56Gh78"]),
    ('half = "Ab12Cd34"\nsigning_key = (half +\n "Ef56Gh78")', ["Ab12Cd34", "Ef56Gh78"]),
    ('signing_key = "your-example-placeholder"', []), ('x = 1\nthe signing key string = nothing', []),
])
def test_sums_over_lines_and_placeholders(text, found):
    assert [text[a:b] for k, a, b in secrets.scan(text) if k == "lexed"] == found


def test_generated_sources():
    """Assignments written by templates: exactly the sensitive ones with a varied literal are found."""
    r = random.Random(8)
    forms = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "{n} := `{v}`", "export {n}={v}", 'const {n}: string = "{v}"', 'o["{n}"] = "{v}"',
             '{n} = ("{v}")', '{n} => "{v}"', 'var {n} string = "{v}"']
    hot, cold = ["signing_key", "db_pwd", "authCredential", "PRIVATE_KEY", "session-salt-bearer"], ["width", "title", "colour", "row_count"]
    for _ in range(300):
        lines, want = [], []
        for _ in range(r.randint(1, 8)):
            name, value = r.choice(hot + cold), "".join(r.choices("abcdefgHJKLMNP23456789", k=18)) + "Zz7"
            lines.append(r.choice(forms).format(n=name, v=value))
            want += [value] if name in hot else []
        text = "\n".join(lines)
        assert [text[a:b] for k, a, b in secrets.scan(text) if k == "lexed"] == want, text


def test_long_line_of_pairs_is_scanned_whole():
    text = "a: b " * 40_000 + 'auth_token_x = "Ab12Cd34Ef56Gh78"'
    assert [text[a:b] for k, a, b in secrets.scan(text) if k == "lexed"] == ["Ab12Cd34Ef56Gh78"]


def test_nulls_and_code_points(spark):
    rows = [(1, "日本😀 password=abcdefgh"), (2, None), (None, ""), (1, "日本😀 password=abcdefgh")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(docs).collect()), key=str)
    one = (1, [("assign", 4, 21)])
    assert got == sorted([one, one, (2, []), (None, [])], key=str)
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def test_query_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.base_sha256, r.n_assign + r.n_access + r.n_hex) == (digest, len(want))
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}
