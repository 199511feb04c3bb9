import base64
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secret_scan as s


def plain(text):
    """The base rules, as plainly as they can be written."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "API_KEY", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCD0123456789", "deadbeef01", "0123456789abcdef", "xyz_-./+", "é", "\n"]), max_size=12).map("".join))
def test_base_spans(text):
    base, spans = s.scan(text)
    assert base == plain(text)
    assert set(base) <= set(spans)


def test_random_strings_are_found_and_text_is_not():
    r = random.Random(1)
    found = 0
    for _ in range(100):
        key = base64.b64encode(r.randbytes(30)).decode()
        _, spans = s.scan(f"the value {key} is kept")
        found += any(k == 3 for _, k, _ in spans)
    assert found >= 90
    words = ["internationalisation", "Donaudampfschifffahrtsgesellschaft", "getElementByIdentifierName", "some_long_snake_case_identifier", "zzzzzzzzzzzzzzzzAAAAAAAAAAAAA1", "ABABABABABABABABABABababababab", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"]
    for w in words:
        assert s.scan(f"see {w} there") == ([], [])


def planted(seed, n=400):
    """Texts of invented words and identifiers; a third hold one key of some encoding and length, whose span is given."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ren", "sta", "en", "tion", "er", "Un", "be"]) for _ in range(r.randint(1, 4)))
    odd = lambda: r.choice([word().title() + word().title() + word().title() + word().title(), f"{word()}_{word()}_{word()}_{r.randint(1, 2030)}", f"{word()}/{word()}/{word()}-{r.randint(1, 99)}/{word()}", f"{word()}{word()}{word()}{r.randint(1, 99)}"])
    rows = []
    for k in range(n):
        words, span = [odd() if r.random() < 0.1 else word() for _ in range(r.randint(20, 200))], None
        if k % 3 == 0:
            raw = r.randbytes(r.choice([15, 20, 32, 48]))
            key = r.choice([base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), base64.b32encode(raw).decode().rstrip("="), raw.hex().upper(), "".join(r.choice(s._ALPHABETS[5][1]) for _ in range(len(raw)))])
            at = r.randrange(len(words))
            span = (len(" ".join(words[:at])) + (at > 0), len(key))
            words.insert(at, key)
        rows.append((k, " ".join(words), span))
    return rows


def test_recall_and_false_discoveries_over_a_table(spark):
    rows = planted(5)
    got = {r.doc_id: r for r in s.scan_documents(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")).collect()}
    hits = wrong = 0
    for k, _, span in rows:
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[k].spans.split(",") if x.startswith("random:")]
        assert len(spans) == got[k].n_random
        right = [x for x in spans if span and x == (span[0], span[0] + span[1])]
        hits, wrong = hits + bool(right), wrong + len(spans) - len(right)
    assert hits >= 0.9 * sum(span is not None for _, _, span in rows)
    assert wrong <= 0.02 * (hits + wrong)


def test_spans_equal_a_plain_rule(spark):
    """Candidates that overlap nothing, and the e-Benjamini-Hochberg rule over all of them, written out."""
    rows = [*planted(6, 60), (900, 'token = "abcdefghijklmnop" ' + "0123456789abcdef" * 2 + " Zx9Kq2Lw8Rt4Vb6Nm1Pc", None), (901, None, None)]
    each, m = [], 0
    for k, text, _ in rows:
        base = plain(text or "")
        for c in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text or ""):
            token = c[0].rstrip("=")
            if sum(bool(re.search(p, token)) for p in ("[a-z]", "[A-Z]", "[0-9]")) >= 2 and not any(a < c.end() and c.start() < b for a, _, b in base):
                letters = s.infer_alphabet(token)
                e = s.evidence(token, letters) if s.uniformity(token, letters) > s.UNIFORM_P else 0
                each.append((min(1000, int(e / 0.1)) if e > 0 else -1, k, c.start(), c.end()))
    each.sort(reverse=True)
    m, best = len(each), 0
    for k in range(1, m + 1):
        if each[k - 1][0] >= 0 and each[k - 1][0] * 0.1 >= s.math.log(m / (k * 0.01)):
            best = k
    want = {(k, a, b) for e, k, a, b in each if best and e >= each[best - 1][0]}
    got = s.scan_documents(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")).collect()
    found = {(r.doc_id, *map(int, x.split(":")[1:])) for r in got for x in r.spans.split(",") if x.startswith("random:")}
    assert found == want and len(want) > 10


def test_many_spans_take_time_in_proportion():
    import time

    def took(n):
        text = 'token = "abcdefghijklmnop1" Abcdefgh1jklmnopq_r ' * n
        began = time.perf_counter()
        s.scan(text)
        return time.perf_counter() - began

    took(50)
    assert took(8000) < 12 * took(2000)  # four times the text


def test_base_spans_of_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in s.scan_documents(docs).collect()}
    for r in docs.collect():
        base = plain(r.text or "")
        assert [got[r.doc_id][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, x, _ in base) for k in range(3)]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(s.written(base).encode()).hexdigest()


def test_battery():
    r = random.Random(2)
    letters = s._ALPHABETS[5][1]
    p = [s.uniformity("".join(r.choice(letters) for _ in range(40)), letters) for _ in range(300)]
    assert sum(x < 0.05 for x in p) < 45  # near its nominal level on random strings
    assert s.uniformity("ab" * 20, letters) < 1e-4 and s.uniformity("a" * 20 + "z" * 20, letters) < 1e-4
    short, long = ("".join(r.choice(letters) for _ in range(n)) for n in (20, 60))
    assert s.evidence(long, letters) > s.evidence(short, letters)


def test_rows(spark):
    text = 'é password = "abcdefghijkl" AKIA0123456789ABCD and 0123456789abcdef0'
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "x"), (4, "word " * 100_000 + "0123456789abcdef")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_hex long")
    got = s.scan_documents(df).collect()
    assert len(got) == 6 and got[0] == got[1]
    spans = s.written(plain(text))
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex, got[0].spans) == (1, 1, 1, spans)
    assert got[0].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert got[5].spans == "hex:500000:500016"
    assert s.scan_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
