import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscan.llm import chat

ODD = st.text(alphabet=st.sampled_from(list("<>/s[]INSTROLE\\=é日 \n🙂")), max_size=30)
PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "INST]", "ok", "<\\s>", "[\\\\/INST]"]), max_size=8).map("".join)
TEXT = st.one_of(ODD, PIECES)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", None, ""]), TEXT), TEXT), max_size=6)
ENCODER = chat.Encoder(chat.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escapes_are_reversible_and_leave_no_control(text):
    assert chat.restore(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_turns_and_loss_come_back_from_the_output(turns):
    run = chat.format_run(turns, ENCODER)
    parsed = chat.parse(run.rendered)
    assert [p[:2] for p in parsed] == [(r, t) for r, t in turns]
    assert all(chat.restore(run.rendered[a:b]) == t for _, t, a, b in parsed)
    spans = np.array([p[2:] for p in parsed], np.int64).reshape(-1, 2)
    # which turns are learned follows from mask and offsets alone
    learned = chat.learned_spans(spans, run.offsets, run.mask)
    texts = chat.masked_texts(run.rendered, learned, run.offsets, run.mask)
    assert [chat.restore(t) for t in texts] == [t for r, t in turns if r == "assistant" and t]
    own = [p[2:] for p in parsed if p[0] == "assistant"]
    assert run.mask.tolist() == [any(a < e and s < b for s, e in own) for a, b in run.offsets]
    assert ENCODER.tokenizer.decode(run.ids.tolist(), skip_special_tokens=False) == run.rendered


def _rows(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "z") for r in rows],
        "conv_id long, turn long, role string, text string, n_turns int, rendered string",
    )


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN_CHARS", 40)
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "assistant", None),
        (2, 0, None, "x" * 100), (2, 1, "assistant", "y" * 100), (2, 2, "assistant", ""), (2, 3, "user", None),
        (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "user", "lost"),
        (4, 0, "assistant", "é🙂 " * 20_000),
    ]
    got = {r.conv_id: r for r in chat.digests(_rows(spark, rows)).collect()}
    order = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        order.setdefault(c, []).append((role, text or ""))
    assert set(got) == set(order)
    for c, turns in order.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        whole = chat.format_run(turns, ENCODER)
        assert got[c].formatted_chars == len(whole.rendered)
    runs = chat.formatted(_rows(spark, rows)).orderBy("conv_id", "run").collect()
    assert "".join(r.rendered for r in runs if r.conv_id == 2) == chat.format_run(order[2], ENCODER).rendered
    assert all(len(r.ids) == len(r.mask) == len(r.starts) == len(r.stops) for r in runs)
    assert chat.digests(_rows(spark, [])).count() == 0


def test_masks_of_touching_spans():
    offsets = np.array([(0, 2), (2, 5), (5, 5), (5, 9), (9, 10)])
    spans = np.array([(3, 5), (5, 5), (6, 9)])
    assert chat.loss_mask(spans, offsets).tolist() == [False, True, False, True, False]
    assert chat.masked_texts("0123456789", spans, offsets, chat.loss_mask(spans, offsets)) == ["34", "", "678"]
