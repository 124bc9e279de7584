import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_format as c

NASTY = st.text(alphabet="a&<|>\n;lt#10émp", max_size=20) | st.sampled_from([c.START, c.END, "&lt;|", f"x{c.END}\n{c.START}user", "<"])


@settings(max_examples=200, deadline=None)
@given(NASTY)
def test_escape_round_trip(text):
    assert c.unescape(c.escape(text)) == text and "<|" not in c.escape(text)
    assert c.unescape(c.escape_line(text)) == text and "\n" not in c.escape_line(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", ""]) | NASTY, NASTY), max_size=5))
def test_read_back(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    sink, whole = c.ReadBack(), c.Whole()
    render = c.compile_template(c.CHATML)
    render(iter(messages), sink)
    render(messages, whole)
    n, digest, loss_chars, loss, size = sink.row()
    said = "".join(t for r, t in turns if r == "assistant")
    assert (n, loss_chars, size) == (len(turns), len(said), len("".join(whole.parts)))
    assert digest == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert loss == hashlib.sha256(said.encode()).hexdigest()
    text = "".join(whole.parts)
    assert c.unescape("".join(text[a:b] for a, b in whole.spans)) == said


def shown(source, **values):
    out = []
    c.compile_template(source)(values.pop("messages", ()), lambda t, f: out.append(t), **values)
    return "".join(out)


def test_language():
    assert shown("{% for m in messages %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", messages=[{}, {}, {}]) == "1,2,3"
    assert shown("{% set a = 'x' + 1 %}{{ a | upper }}{# no #}{{ b.c.d }}", b={"c": {"d": "\n"}}) == "X1\n"
    assert shown("{% if a == 1 %}1{% elif a == 2 %}2{% else %}3{% endif %}", a=2) == "2"
    assert shown("{{ a.__class__ }}{{ 'x'.upper }}", a="s") == ""
    assert c.fold(c.parse("a{{ 'b' + 1 }}{% if 1 == 2 %}x{% else %}c{% endif %}")) == c.Seq((c.Text("ab1c"),))


@pytest.mark.parametrize("bad", ["{{ a", "{% for x %}{% endfor %}", "{% if a %}", "{{ f() }}", "{{ a | eval }}", "{% import os %}", "{{ a ~ b }}", "{{ }}", "{% endif %}"])
def test_rejects(bad):
    with pytest.raises(c.TemplateError):
        c.compile_template(bad)


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b", 0), (None, None, None, None, 0), (2, 0, "assistant", "x" * 100_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in c.format_conversations(df).collect()}
    assert got[1].formatted == "<|im_start|>user\n<|im_end|>\n" + "<|im_start|>assistant\nb<|im_end|>\n" * 2
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["b", "b"]
    assert got[None].formatted == "<|im_start|>\n<|im_end|>\n" and len(got[2].formatted) > 100_000
    digests = {r.conv_id: r for r in c.conversation_digests(df).collect()}
    assert digests[1].n_turns == 3 and digests[1].loss_chars == 2 and digests[2].formatted_chars == len(got[2].formatted)
    assert c.format_conversations(df.limit(0)).collect() == []
