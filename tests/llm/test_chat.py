import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histscore.llm import chat as C

TRICKY = "\\### Assistant: </turn> ok"
texts = st.text(alphabet=st.sampled_from(list("ab#</turn>\\: \n### \U0001f600")), max_size=30)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def as_pieces(segments):
    text, spans = "", []
    for s, marked in segments:
        if marked:
            spans.append((len(text), len(text) + len(s)))
        text += s
    return text, spans


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:#\\<", ""]) | texts, texts), max_size=5))
def test_round_trip(turns):
    piece = as_pieces(C.Template(C.TEMPLATE).render({"role": r, "text": t} for r, t in turns))
    back = list(C.read_turns([piece]))
    assert [(r, t) for r, t, _ in back] == turns
    masked = [m for r, t, m in back if r == "assistant"]
    assert masked == [[t] for r, t in turns if r == "assistant"]


def render(source, **env):
    return "".join(t for t, _ in C.Template(source).render(env.pop("messages", []), **env))


def test_language():
    rows = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m['text'] | upper }}{% if not loop.last %},{% endif %}{% endfor %}", messages=rows) == "1HI,2YO"
    assert render("{% set a = 'x' ~ (1 + 2) %}{{ a }}") == "x3"
    assert render("{% if x == 1 %}a{% elif x == 2 %}b{% else %}c{% endif %}", x=2) == "b"
    assert render("{{ 'a' in y and not false }}", y="abc") == "true"


def test_constants_fold():
    tree = C.fold(C.parse("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{{ 2 + 3 }}{% else %}{{ x }}{% endif %}e"))
    assert tree == [C.Text("abcd5e")]
    assert C.fold(C.parse("{% if x and (1 == 2) %}a{% endif %}"))[0].test.args[1] == C.Const(False)


@pytest.mark.parametrize(
    "bad",
    ["{% for m in messages %}", "{{ a b }}", "{{ m.__class__() }}", "{% import os %}", "{{ x | system }}", "{% endif %}", "{{ }}", "{% else %}"],
)
def test_rejected(bad):
    with pytest.raises(C.TemplateError):
        C.Template(bad)


def test_sandbox():
    for source in ("{{ x.__class__ }}", "{{ x['a'].b }}", "{{ unknown }}"):
        with pytest.raises(C.TemplateError):
            render(source, x="text")


def test_streams_with_one_row_ahead():
    seen = []

    def rows():
        for k in range(100):
            seen.append(k)
            yield {"role": "user", "text": str(k)}

    out = C.Template(C.TEMPLATE).render(rows())
    next(out)
    assert len(seen) <= 2


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        own = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in own if r == "assistant")
        chars = sum(4 + len(C.escape_role(r)) + 2 + len(C.escape(t)) + 8 for r, t in own)
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), chars)
    return out


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", TRICKY, 1), (1, 1, "assistant", TRICKY, 1), (1, 1, "assistant", "tie", 1), (1, 1, "assistant", "tie", 1),
        (2, None, None, None, 2), (2, 3, "assistant", None, 2), (2, 4, "assistant", "</turn>\n### user: x</turn>\n", 2),
        (None, 0, "sys\\:#<", "null conversation", 3), (None, 1, "assistant", "x" * 200_000, 3), (3, 0, "", "", 4),
    ] + [(9, k, "assistant" if k % 2 else "user", f"turn {k} ###", 5) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int").repartition(4)
    formatted = C.format_conversations(df)
    got = {r[0]: tuple(r)[1:] for r in C.conversation_digest(formatted).collect()}
    assert got == brute(rows)
    whole = formatted.filter("conv_id = 9").orderBy("piece").collect()
    assert [r.piece for r in whole] == list(range(3000))
    assert C.conversation_digest(C.format_conversations(df.limit(0))).count() == 0
