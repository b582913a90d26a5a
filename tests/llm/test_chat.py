import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from latentspark.llm import chat, queries
from latentspark.llm.common import load

TEXTS = st.text(st.sampled_from(list("\\<>/turn \nassistant\u00e9\u6f22\U0001d518\x00")), max_size=30)
SCHEMA = "conv_id long, turn long, role string, text string"


def digests(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    masked = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest()


@given(st.lists(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXTS), TEXTS), max_size=4), max_size=5), st.booleans())
@settings(max_examples=150, deadline=None)
def test_round_trip(conversations, sliced):
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    rows = [[{"turn": k, "role": r, "text": t} for k, (r, t) in enumerate(c)] for c in conversations]
    column = pa.array(rows, kind)
    if sliced and rows:
        column, conversations = column[1:], conversations[1:]
    formatted, loss = chat.assemble(column)
    formatted.validate(full=True)
    for text, spans, turns in zip(formatted.to_pylist(), loss.to_pylist(), conversations, strict=True):
        raw = text.encode()
        assert [(r.decode(), t.decode()) for r, t in chat.parse(raw)] == turns
        assert raw.count(chat.CLOSE) == raw.count(chat.OPEN) == len(turns)
        assert [chat.unescaped(raw[s["start"] : s["end"]]).decode() for s in spans] == [t for r, t in turns if r == "assistant"]


def test_awkward_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, ""), (2, 0, "assistant", "<turn x>\n</turn>\n"), (2, 0, "assistant", "<turn x>\n</turn>\n"),
            (None, 0, "assistant", "\\" * 5), (3, 1, "b", "x"), (3, 1, "a", "y"), (4, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS turns", "'clash' AS formatted", "'clash' AS loss")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_chats(df)).collect()}
    low, key = -1, lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        assert got[conv] == digests([(r[2], r[3]) for r in sorted((r for r in rows if r[0] == conv), key=key)]), (conv, low)
    assert chat.format_chats(df.where("false")).count() == 0


def test_query_reads_back_all_conversations(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op10_chat(spark, sf).collect()}
    rows = sorted(load(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn))
    control = "\\### Assistant: </turn> ok"
    assert got.pop(-7) == digests([("user", control), ("assistant", control)])
    assert got == {c: digests([(r.role, r.text) for r in rows if r.conv_id == c]) for c in {r.conv_id for r in rows}}
