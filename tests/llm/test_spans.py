import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from agora.llm import pii, secrets

MODEL = secrets.train(secrets.labelled_samples())
TEXT = st.lists(st.sampled_from(["password", "ToKeN", "api_key", "apikey", " ", "  ", "=", ":", '"', "AKIA", "ABCD1234", "deadbeef00", "é", "\n", "a1", ".", "@", "+1", "(555)", "-", "12.", "300", "4111 1111 1111 1111", "999", "x.org"]), max_size=14).map("".join)


def secrets_by_pattern(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def personal_by_pattern(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits(m[0])))) % 10 == 0]
    return out + [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(TEXT)
def test_base_spans_are_those_of_the_patterns(t):
    data = t.encode()
    assert [s for s in secrets.in_points(data, secrets.find(data, MODEL)) if s[1] != "random"] == secrets_by_pattern(t)
    assert secrets.in_points(data, pii.find(data)) == personal_by_pattern(t)


def test_models_on_held_out_samples():
    held = secrets.labelled_samples(2000, seed=77)
    right = sum((secrets.score(s.encode(), MODEL) >= secrets.MARGIN) == bool(label) for s, label in held)
    assert right >= 0.97 * len(held)
    assert [s[1] for s in secrets.find(b"key 9fQz81LkWm0aXv73BtRy6 here", MODEL)] == ["random"] and not secrets.find(b"see build_member_profile_2024_final_report", MODEL)


def test_secret_scan_of_odd_rows(odd, none):
    got = secrets.scan(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan(none).count() == 0
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).where("text is null").count() == 2


def test_redaction(spark):
    df = spark.createDataFrame([("é token = abcdef1 x",), (None,)], "text string")
    assert [r.text for r in secrets.redact(df).collect()] == ["é [ASSIGN] x", None]


def test_terms_that_disclose(spark):
    docs = [(k, f"talk of zanzibar with ann@x.org and {w}") for k, w in enumerate(("one", "two", "three", "four"))] + [(k, "talk of and with one two three") for k in range(100, 300)] + [(50, "the zanzibar of nobody"), (51, None)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    for k in range(4):
        spans = got[k].spans.split(",")
        assert spans[0] == "email:22:31" and "term:8:16" in spans and got[k].n_email == 1
        assert got[k].base_sha256 == hashlib.sha256(b"email:22:31").hexdigest()
    assert got[50].spans == "" and got[120].spans == "" and got[51].spans == ""


def test_personal_data_in_odd_rows(odd, none):
    got = pii.scan(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" for r in got) and pii.scan(none).count() == 0
    assert pii.find(b"0" * 100_000) == [] and pii.find(b"a" * 100_000 + b"@") == []


def test_terms_of_entities_seen_once(spark):
    docs = [(1, "write to quagga at bob@y.org or call"), (2, "write or call at noon")] + [(k, "write to them at or call") for k in range(100, 300)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].spans == "email:19:28,term:9:15" and got[1].n_term == 1 and got[2].n_term == 0


def test_terms_on_the_given_table(spark):
    rows = pii.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.n_term for r in rows) > 0
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone > 0 for r in rows if r.n_term)


def test_sanitised_texts(spark, odd, none):
    far = " ".join(["talk"] * 20)
    docs = [(1, f"write to Quagga, at bob@y.org {far} quagga é quagga. of 10.1.2.3", "x"), (2, "write or call at noon", "y"), (3, None, "z"), (None, "call +1 (555) 555-0123", "v"), (2, "card 4111 1111 1111 1111", "w")]
    docs += [(k, "write to them at talk of call é", "u") for k in range(100, 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, clean string")
    got = {(r.doc_id, r.clean): r.text for r in pii.sanitise(df).collect()}
    assert got[1, "x"] == f"write to [TERM] at [EMAIL] {far} [TERM] é [TERM] of [IP]"
    assert got[2, "y"] == "write or call at noon" and got[3, "z"] is None and got[None, "v"] == "call [PHONE]" and got[2, "w"] == "[TERM] [CARD]"
    assert next(r.n_term for r in pii.scan(df).collect() if r.doc_id == 1) == 3
    assert pii.sanitise(odd).columns == odd.columns and sorted(map(str, pii.sanitise(odd).collect())) == sorted(map(str, odd.collect())) and pii.sanitise(none).count() == 0


def test_spans_are_what_sanitising_replaces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).select("doc_id", "text").collect()}
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        text, last = "", 0
        for kind, a, b in sorted(spans[r.doc_id], key=lambda x: (int(x[1]), pii.KINDS.index(x[0]))):
            if int(a) >= last:
                text += r.text[last : int(a)] + f"[{kind.upper()}]"
            last = max(last, int(b))
        assert clean[r.doc_id] == (None if r.text is None else text + r.text[last:])
        assert r.text is None or not pii.find(clean[r.doc_id].encode())
