import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowmill.llm import chat, template

TEXTS = st.text(alphabet=st.sampled_from(list("\\#</turn>:\n aé😀")), max_size=30) | st.sampled_from(["\\### Assistant: </turn> ok", "\n</turn>\n### user:\n", "####", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | TEXTS, TEXTS), max_size=6))
def test_reading_back_gives_the_turns_and_the_loss(turns):
    reader = chat.Reader()
    compiled = template.Template(chat.DEFAULT, chat.FILTERS)
    messages = [{"role": r, "text": t} for r, t in turns]
    assert list(reader.feed(compiled.stream(messages=iter(messages)))) == turns
    trained = "".join(t for r, t in turns if r == "assistant")
    assert reader.loss_chars == len(trained) and reader.loss_hash.hexdigest() == hashlib.sha256(trained.encode()).hexdigest()
    text, spans = compiled.render(messages=messages)
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == trained and len(text) == reader.chars


def test_language():
    def render(source, **scope):
        return template.Template(source).render(**scope)[0]

    assert render("a{{ 'b' + 'c' | upper }}{% if 1 == 1 and not false %}!{% else %}?{% end %}") == "abC!"
    assert template.fold(template.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% elif true %}y{% end %}")) == (template.Print(template.Const("abcy")),)
    assert render("{% for x in xs %}{% if loop.first %}<{% end %}{{ x.a }}{{ x['b'] }}{% end %}", xs=[{"a": 1, "b": 2}, {"a": 3}]) == "<123"
    assert render("{% if a or b %}{{ a or b }}{% elif c %}c{% else %}d{% end %}", a="", b="q") == "q"
    assert render("{{ x }}", x="{{ y }}", y=1) == "{{ y }}" and render("{{ nothing }}") == ""
    for bad in ("{{ x.y }}", "{{ x['__class__'] }}"):
        with pytest.raises(template.TemplateError):
            render(bad, x="text")
    for bad in ("{{ f(1) }}", "{% import os %}", "{% if a %}", "{{ a b }}", "{{ }}", "{{ a | nope }}", "{% end %}", "{% for 1 in x %}{% end %}", "{{ 'a }}"):
        with pytest.raises(template.TemplateError):
            template.parse(bad)


def test_frames(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (3, None, "user", "first"), (3, 0, "assistant", "z" * 100_000), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(df).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, 2: 2, 3: 2, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[3].loss_chars == 100_000
    one = chat.format_conversations(df).where("conv_id = 1").first()
    assert one.formatted[one.loss_starts[0] : one.loss_ends[0]] == "b" and len(one.formatted) == got[1].formatted_chars
    again = spark.createDataFrame([(-7, 0, "user", "mine")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(again.unionByName(again)).first().n_turns == 2  # an id twice is one conversation
    assert chat.read_back(df.limit(0)).count() == 0 and chat.format_conversations(df.limit(0)).count() == 0
