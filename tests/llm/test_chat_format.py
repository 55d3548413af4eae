import hashlib
import random

import pytest

from tsengine.llm import chat_format as c

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING"


def test_round_trip_of_any_text():
    r = random.Random(1)
    bits = ["\\", "### ", "</turn>", "</turn>\n", "#", "##", "<", ":", "\n", "a", "é", "user: ", "### assistant: ", "\\### "]
    render = c.compile_template(c.TEMPLATE, c.FILTERS)
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "a: b", "", "### "]), "".join(r.choice(bits) for _ in range(r.randrange(12)))) for _ in range(r.randrange(4))]
        text, spans = render({"messages": [{"role": a, "text": b} for a, b in turns]})
        assert c.read_back(text) == turns
        assert [c.unescape(text[a:b]) for a, b in spans] == [b for a, b in turns if a == "assistant"]


def test_language():
    f = {"up": lambda x: str(x).upper()}
    show = lambda t, **names: c.compile_template(t, f)(names)[0]
    assert show("{% for x in xs %}{% if x.n == 2 or x.n == 3 %}<{{ x.n }}>{% elif not x.n %}none{% else %}{{ x['s'] | up }}{% endif %}{% endfor %}", xs=[{"n": 2}, {"n": 0}, {"n": 9, "s": "é"}]) == "<2>noneÉ"
    assert show("{% set a = 'x' + 'y' %}{{ a }}{{ missing.entry }}{{ l[0] }}{{ l[5] }}", missing={}, l=[7]) == "xy7"
    assert c.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "é"}) == ("abéc", [(1, 3)])


def test_constants_are_folded():
    tree = c.fold(c.parse("{% if 'a' == 'a' %}x{{ 'b' | up }}{% else %}y{% endif %}{{ 'c' + 'd' }}{{ e }}"), {"up": str.upper})
    assert tree == (c.Emit(c.Const("xBcd")), c.Emit(c.Name("e")))


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ open }}", "{{ 'x'.upper }}", "{% include 'x' %}", "{{ a | nope }}", "{% for x in a %}", "{{ 1 +", "{{ a() }}", "{{ @ }}"])
def test_sandbox_and_errors(source):
    with pytest.raises(c.TemplateError):
        out = c.compile_template(source)({"a": 1})
        if source == "{{ 1 +":  # not closed: plain text
            raise c.TemplateError(out[0])


def brute(rows):
    by = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_conversations(small):
    rows = [(1, 1, "assistant", "b\n### x"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "é" * 200_000), (2, 0, "assistant", ""), (None, 0, "assistant", "x"), (None, 3, "system", "\\"), (3, 0, "a:b", "</turn>\n")]
    got = c.digest(small([(*r, "extra") for r in rows], SCHEMA + ", spans STRING")).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute(rows)
    assert [r.conv_id for r in c.digest(small([], SCHEMA)).collect()] == [-7]


def test_turns_join_to_the_conversation(spark, small):
    r = random.Random(3)
    texts = ["", None, "plain", "### user: x</turn>", "\\", "é😀", "a\nb", "long " * 300]
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1, 2, 3]), r.choice(["user", "assistant", "sys:tem", None]), r.choice(texts), "x") for _ in range(300)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}", "x") for i in range(5000)]
    df = small(rows, "conv_id LONG, turn LONG, role STRING, text STRING, start STRING")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        turns = c.format_turns(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {x.conv_id: x for x in c.format_chats(df).collect()}
    assert {x.conv_id for x in turns} == set(whole) and len(turns) == len(rows)
    for conv, chat in whole.items():
        mine = sorted((x for x in turns if x.conv_id == conv), key=lambda x: x.start)
        assert "".join(x.formatted for x in mine) == chat.formatted
        assert [tuple(s) for x in mine for s in x.spans] == [tuple(s) for s in chat.spans]
        assert all(x.start + len(x.formatted) == y.start for x, y in zip(mine, mine[1:], strict=False))


def test_templates_whose_turns_depend_on_each_other_are_refused(small):
    df = small([(1, 0, "user", "x")], "conv_id LONG, turn LONG, role STRING, text STRING")
    for template in ("start {% for m in messages %}{{ m.text }}{% endfor %}", "{% for m in messages %}{{ system }}{% endfor %}", "{% for m in messages %}{% set x = m.text %}{% endfor %}", "{% for m in messages %}{% for n in messages %}{{ n.text }}{% endfor %}{% endfor %}"):
        with pytest.raises(c.TemplateError):
            c.format_turns(df, template)
    assert c.format_turns(df, "{% for m in messages %}{% if m.role == 'user' %}{{ m.text }}!{% endif %}{% endfor %}").first().formatted == "x!"


def test_a_conversation_of_many_turns_is_a_stream(small):
    rows = small([(0, "")], "conv_id LONG, text STRING").selectExpr("explode(sequence(1, 200000)) AS i").selectExpr("7L AS conv_id", "CAST(i AS LONG) AS turn", "IF(i % 2 = 0, 'assistant', 'user') AS role", "repeat('words ', 20) AS text")
    got = {x.conv_id: x for x in c.digest(rows).collect()}
    assert got[7].n_turns == 200_000 and got[7].loss_chars == 100_000 * 120 and set(got) == {7, -7}
