import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.chat_template import FILTERS, Output, Template, TemplateError, Text, escape, escape_line, fold, parse, unescape

NASTY = st.lists(st.sampled_from(["<|", "|>", "<", "|", "\\", "\\p", "\\n", "\n", "<|end|>\n", "<|turn|>", "user", "é", "\\### Assistant: </turn> ok"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_escapes_are_reversible_and_hide_control_strings(text):
    for f in (escape, escape_line):
        assert unescape(f(text)) == text and "<|" not in f(text)
    assert "\n" not in escape_line(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), NASTY), NASTY), max_size=6), st.integers(1, 40))
def test_round_trip_of_any_conversation(turns, size):
    sink = chat._Pieces(1, size)
    Template().render(iter([{"role": r, "text": t} for r, t in turns]), sink)
    sink.leave(True)
    reader = chat.Reader()
    back = [x for _, _, start, text, a, b, _ in sink.full for x in reader.feed(text, start, list(zip(a, b, strict=True)))]
    assert back == turns
    loss = "".join(t for r, t in turns if r == "assistant")
    assert reader.digest()[2:4] == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def render(source, **values):
    return "".join(Template(source).render(values.pop("messages", []), **values).parts)


def test_language():
    m = [{"role": "a", "text": "x"}, {"role": "b", "text": "y"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m['role'] }}{% if not loop.last %},{% endif %}{% endfor %}", messages=m) == "1a,2b"
    assert render("{% if a == 1 and b != 'q' %}yes{% elif a > 3 %}big{% else %}no{% endif %}", a=5, b="w") == "big"
    assert render("{% set x = 'a' + 'b' ~ 3 %}{{ x | upper }} {{- ' z' | trim }}") == "AB3z"
    assert render("{{ missing }}{{ none }}{{ true }}{{ (1 + 2) }}{# note #}{{ 'q' in s }}{{ 'q' not in s }}", s="qr") == "true3truefalse"
    assert render("{{ rows[0].k | length }}", rows=[{"k": "four"}]) == "4"
    out = Template("ab{% generation %}{{ x }}{% endgeneration %}c").render([], x="éé")
    assert out.spans == [(2, 4)] and "".join(out.parts) == "abééc"


def test_sandbox():
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{% import os %}", "{% for x in y %}", "{{ 1 | eval }}", "{{ 'open }}", "{% endfor %}", "{% set not = 1 %}", "{{ a. }}", "{{ }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert render("{{ x.upper }}{{ x['y'] }}", x="text") == ""
    with pytest.raises(TemplateError):
        render("{% for x in y %}{% endfor %}", y="text")
    with pytest.raises(TemplateError):
        render("{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}")


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}e{% endif %}")) == [Text("aBCd")]
    assert isinstance(fold(parse("{{ x + 'a' }}"))[0], Output)
    assert fold(parse("{% if false or x %}y{% endif %}"))[0].arms[0][0].name == "x"
    assert "escape" in FILTERS


def test_table(spark):
    rows = [(2, 1, "assistant", "b <|end|>\n"), (2, 0, "user", None), (2, 0, "user", None), (3, None, None, "é"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "assistant", "long " * 400_000)]
    df = spark.createDataFrame([(*r, 4) for r in rows], "conv_id long, turn long, role string, text string, n_turns long").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        groups.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c])[1:5] == want
    pieces = chat.format_conversations(df, piece=10).where("conv_id = 2").collect()
    assert len(pieces) > 1 and "".join(p.text for p in sorted(pieces, key=lambda p: p.piece)).count("<|turn|>") == 3
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
