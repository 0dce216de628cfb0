import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewise.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def base(spans):
    return [s for s in spans.split(",") if s and not s.startswith("term")]


def check(table):
    rows = pii.find(table).collect()
    texts = table.collect()
    want = sorted([(str(r.doc_id), ",".join(brute(r.text))) for r in texts])
    assert sorted([(str(r.doc_id), ",".join(base(r.spans))) for r in rows]) == want
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(base(r.spans)).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base(r.spans)) for k in PLAIN]


def test_documents_and_edge_cases(docs, edge_docs, no_docs):
    check(docs)
    check(edge_docs)
    assert pii.find(no_docs).count() == 0 and pii.sanitise(no_docs).count() == 0


PIECES = st.sampled_from(["a", "@", ".", "_", "b.c", "1", "23", "255", "256", "007", " ", "-", "+", "(", "é", "\n", "4111111111111111", "x@y.zz", "+1 234-567.89"])


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=120, max_size=200))
def test_base_finds_equal_plain_patterns(spark, texts):
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_very_long_runs(spark):
    check(spark.createDataFrame([(1, "5" * 30_000), (2, "a@" * 8_000 + "x@y.z " * 4_000), (3, "+1" * 9_000 + "1.2.3.4." * 5_000), (4, "a.b" * 20_000)], "doc_id long, text string"))


def test_disclosing_terms(spark):
    rows = [(i, f"call Zebrafinch about item{i} now\nreach +1 555 000 1111 Zebrafinch about case{'abcdefgh'[i]}x") for i in range(4)]
    rows += [(100 + i, f"nothing about word{i} now at all") for i in range(60)]
    rows += [(200 + i, "same words only here +1 555 000 2222 quokkas") for i in range(5)]  # one line and its copies
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(table).collect()}
    for i, text in rows[:4]:
        terms = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in found[i].split(",")) if k == "term"]
        assert "Zebrafinch" in terms and "about" not in terms and f"case{'abcdefgh'[i]}x" not in terms
    assert all("term" not in found[i] for i, _ in rows[4:])
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert clean[100] == rows[4][1] and "555" not in clean[0] and "[PHONE]" in clean[0]
    assert clean[0].count("Zebrafinch") == 1 and clean[200] == "same words only here [PHONE] quokkas"
