import hashlib

from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm.chat import Incremental, digests, formatted, instruct, parse, render_turns

PARTS = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "[", "/", "INST]", "[TEXT]", "[/ROLE]", "<", "a", " ", "\n", "é"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]", "a\\"]), TEXT), max_size=6)
SCHEMA = "conv_id long, turn long, role string, text string, piece string"


@given(TURNS)
def test_round_trip(turns):
    assert parse(instruct(turns)) == turns
    whole, local, short = Incremental(instruct, None), Incremental(instruct, 1), Incremental(instruct, 1, 2)
    pieces = [whole.add(*t) for t in turns]
    assert pieces == [local.add(*t) for t in turns] == [short.add(*t) for t in turns]
    assert "".join(p for p, *_ in pieces) == instruct(turns)
    assert [parse(p) for p, *_ in pieces] == [[t] for t in turns]


def test_rewriting_templates_are_found(spark):
    def closing(turns):  # its end mark moves with every turn
        return "".join(f"{r}:{x};" for r, x in turns) + "END"

    rows = spark.createDataFrame([(1, k, "user", "hello", "") for k in range(3)], SCHEMA)
    got = render_turns(rows, template=closing, context=None).orderBy("pos").collect()
    assert [r.rewritten for r in got] == [3, 3, 3] and got[1].piece is None
    assert render_turns(rows).where("rewritten > 0").count() == 0


def test_old_history_that_is_rewritten_late(spark):
    def late(turns):  # drops the first turn's text once there are 60
        return "".join(f"{r}:{x if k or len(turns) < 60 else '-'};" for k, (r, x) in enumerate(turns))

    def local_late(turns):
        return late(turns)

    local_late.context = 1  # which is not true
    rows = spark.createDataFrame([(1, k, "user", f"hello {k}", "") for k in range(150)], SCHEMA)
    found = lambda template: sorted(r.pos for r in render_turns(rows, template=template).where("rewritten > 0").collect())
    assert found(late) == [59] and found(local_late)[0] == 59
    assert instruct.context == 1


def test_long_and_odd_conversations(spark):
    rows = [(5, k, "user" if k % 2 else "assistant", f"text {k} </s>", "p") for k in range(500)]
    rows += [(6, None, None, None, "p"), (6, 1, "assistant", None, "p"), (6, 1, "assistant", None, "p"), (None, 0, "tool", "x\\", "p")]
    got = {r.conv_id: r for r in digests(render_turns(spark.createDataFrame(rows[::-1], SCHEMA))).collect()}
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t, _ in rows[:500]).encode()).hexdigest()
    loss = "".join(t for _, _, r, t, _ in rows[:500] if r == "assistant")
    assert (got[5].n_turns, got[5].turns_sha256, got[5].loss_chars, got[5].loss_sha256) == (500, said, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[6].n_turns, got[6].loss_chars, got[None].n_turns) == (3, 0, 1)
    assert got[6].turns_sha256 == hashlib.sha256(b"\n\nassistant\n\nassistant\n\n").hexdigest()


def test_empty(spark):
    got = formatted(spark, spark.createDataFrame([], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-1, 2, 21)]
