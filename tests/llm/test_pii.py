"""Personal data: base spans against the plain patterns over whole texts, added spans on written examples."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from auctionstream.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = 0
        for place, digit in enumerate(map(int, reversed(digits))):
            total += digit if place % 2 == 0 else sum(map(int, str(2 * digit)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(kind, *m.span()) for kind, p in PLAIN.items() for m in re.finditer(p, text) if passes(kind, m.group())]


def base_of(text):
    return [(pii.KINDS[k], s, e) for k, s, e, is_base in pii.spans(text) if is_base]


PIECES = st.sampled_from([
    "a", "Z", "0", "9", "255", "256", "007", ".", "-", " ", "  ", "@", "+", "(", ")", "é", "漢", "\n", "_", "%", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "+1 (743) 555-3824", "x.y@z.org", "10.0.0.1", "://", "token: ", "IBAN ", "account no. ",
])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=24).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base_of(text) == brute(text)


@pytest.mark.parametrize("text, kind, found", [
    ("write to josé.pérez@beispiel.example now", "email", "josé.pérez@beispiel.example"),
    ("see https://user@host.example:8080/a?b=1).", "url", "https://user@host.example:8080/a?b=1"),
    ("IBAN: GB82 WEST 1234 5698 7654 32 and more", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("SSN 123-45-6789,", "account", "123-45-6789"), ("Account No. 12345678", "account", "12345678"),
    ('token = "24be64439e3e49cf46b2d7"###', "secret", "24be64439e3e49cf46b2d7"),
])
def test_added_spans(text, kind, found):
    at = text.index(found)
    assert (pii.KINDS.index(kind), at, at + len(found), False) in pii.spans(text)


@pytest.mark.parametrize("text", [
    "IBAN GB82 WEST 1234 5698 7654 33", "token of thanks", "password: unchanged words", "mytoken = 12345678", "a://b", "account of 1234 years", "x@y",
])
def test_what_does_not_validate_is_left(text):
    assert pii.spans(text) == []


def test_masked():
    assert pii.masked("mail josé.pérez@example.com, call +1 (743) 555-3824 12") == "mail <email>, call <phone>"
    assert pii.masked("") == "" and pii.masked("plain") == "plain"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email long").repartition(3)


LONG = "word 12 ab@cd.ef " * 20_000
ROWS = [(1, None, "s", 5), (2, "", None, None), (3, "é a@b.cd 10.1.2.3", "s", 1), (3, "é a@b.cd 10.1.2.3", "s", 1), (None, "+123456789", "x", 2), (4, LONG, "", 0)]


def test_scan_of_odd_rows(spark):
    found = sorted(((r.doc_id, len(r.spans)) for r in pii.scan(rows_of(spark, ROWS)).collect()), key=str)
    assert found == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (None, 1), (4, 20_000)], key=str)
    empty = rows_of(spark, ROWS).limit(0)
    assert pii.scan(empty).count() == 0 and pii.redacted(empty).count() == 0
    texts = {(r.doc_id, r.text, r.n_email) for r in pii.redacted(rows_of(spark, ROWS[:5])).collect()}
    assert texts == {(1, None, 5), (2, "", None), (3, "é <email> <ip>", 1), (None, "<phone>", 2)}


def test_query_equals_brute_force_on_the_whole_table(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = brute(texts[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, *_ in expected) for kind in pii.BASE_KINDS]
        listed = [":".join(map(str, x)) for x in expected]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row.spans.split(",")) | {""}
