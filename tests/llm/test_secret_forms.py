"""Each form of assignment that the secret lexer claims, and what the redaction leaves of it."""

import time

import pytest

from placefabric.llm.secret_scan import lexed_spans, redact

FORMS = [
    ('db_pwd = "Zx9Qw7rT5k"', ["Zx9Qw7rT5k"]),
    ("db_pwd: Zx9Qw7rT5k", ["Zx9Qw7rT5k"]),
    ('{"db_pwd": "Zx9Qw7rT5k"}', ["Zx9Qw7rT5k"]),
    ("'db_pwd' => 'Zx9Qw7rT5k'", ["Zx9Qw7rT5k"]),
    ('db_pwd := "Zx9Qw7rT5k"', ["Zx9Qw7rT5k"]),
    ("java -Ddb.pwd=Zx9Qw7rT5k -jar a.jar", ["Zx9Qw7rT5k"]),
    ('java "-Ddb.pwd=Zx9Qw7rT5k"', ["Zx9Qw7rT5k"]),
    ("run --client-credential=Zx9Qw7rT5k", ["Zx9Qw7rT5k"]),
    ("run -credential=Zx9Qw7rT5k", ["Zx9Qw7rT5k"]),
    ('db_pwd = "Zx9Q" "w7rT5k"', ["Zx9Q", "w7rT5k"]),
    ('db_pwd = "Zx9Q" + "w7rT5k"', ["Zx9Q", "w7rT5k"]),
    ('p="Xk39q"\ndb_pwd = p + "aB7qLm2Zt"', ["Xk39q", "aB7qLm2Zt"]),
    ('p="Xk39q"\ndb_pwd = p+"aB7qLm2Zt"', ["Xk39q", "aB7qLm2Zt"]),
    ('p = "Xk39qLm2Zt"\ndb_pwd = "aB7q" + p', ["Xk39qLm2Zt", "aB7q"]),
    ('p = "Xk39"\nq = "qLm2Zt"\ndb_pwd = p + q', ["Xk39", "qLm2Zt"]),
    ('p = "Xk39"\nq = p .. "qLm2Zt"\ndb_pwd = "${q}"', ["Xk39", "qLm2Zt"]),
    ("p = Xk39qLm2Zt\ndb_pwd = ${p}", ["Xk39qLm2Zt"]),
    ("p = 'Xk39qLm2Zt'\ndb_pwd = p", ["Xk39qLm2Zt"]),
    ('cred["pwd"] = "Zx9Qw7rT5k"', ["Zx9Qw7rT5k"]),
    ("cred['db_pwd']: 'Zx9Qw7rT5k'", ["Zx9Qw7rT5k"]),
    ('db_pwd = b"Zx9Qw7rT5kL"', ["Zx9Qw7rT5kL"]),
    ("db_pwd = rb'Zx9Qw7rT5kL'", ["Zx9Qw7rT5kL"]),
    ('p = "Xk39q"\ndb_pwd = f"${p}Zx9Qw7rT5kL"', ["Xk39q", "Zx9Qw7rT5kL"]),
    ("<password>Zx9Qw7rT5k</password>", ["Zx9Qw7rT5k"]),
    ('k = "' + "aB3dE6gH" * 4000 + '"\ndb_pwd = k + "Zx9Q"', ["aB3dE6gH" * 4000, "Zx9Q"]),
    ("a" * 90 + "_pwd = 'Zx9Qw7rT5k'", ["Zx9Qw7rT5k"]),
]


@pytest.mark.parametrize("text,secrets", FORMS)
def test_form(text, secrets):
    spans = lexed_spans(text)
    assert spans
    for x in secrets:
        at = text.index(x)
        assert any(a <= at and at + len(x) <= b for _, a, b in spans)


def test_redaction_leaves_nothing(spark):
    rows = redact(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(FORMS)], "doc_id long, text string")).collect()
    assert [(FORMS[r.doc_id][0], x) for r in rows for x in FORMS[r.doc_id][1] if x in r.text] == []


@pytest.mark.parametrize("text", ["p = 'x'\nn = p + 1", "pwd_len = p + q", "a-b=c", "x --pwd", "p='ab'\npwd = p + f(1)", "pwd = p('x')"])
def test_no_secret(text):
    assert lexed_spans(text) == []


def test_base64_is_not_a_sum():
    text = "p = 'ab'\ndb_pwd = p+Zx9Qw7rT5k="
    assert lexed_spans(text) == [("lexed", text.index("p+"), len(text))]


def test_doubling_constants_stay_small():
    assert lexed_spans("a = 'Xy7kLm9Q'\n" + "a = a + a\n" * 200) == []


def test_a_secret_of_many_constants_names_each_once():
    text = "a = 'Xy7kLm9Q'\n" + "a = a + a\n" * 3000 + "db_pwd = a\n" * 2
    assert len(lexed_spans(text)) == 3003


def test_long_code_takes_time_in_proportion():
    def seconds(lines):
        text = 'a = ""\n' + 'a = a + ""\n' * lines + "db_pwd = a + 'Zx9Qw7rT5k'\n" * (lines // 10)
        began = time.process_time()
        assert len(lexed_spans(text)) > lines
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 20 * seconds(4_000)
