import itertools

import numpy as np
import pytest

from fleetscan.llm import language


def _slow_viterbi(scores, switch):
    best = max(
        itertools.product(range(scores.shape[1]), repeat=len(scores)),
        key=lambda path: sum(scores[i, k] for i, k in enumerate(path))
        - switch * sum(a != b for a, b in zip(path, path[1:])),
    )
    return sum(scores[i, k] for i, k in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_finds_the_best_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 7, 5])
    scores = (-4 * rng.random((lengths.sum(), 3))).astype(np.float32)
    for switch in (0.5, 2.0, 50.0):
        labels, at = language.viterbi(scores, lengths, switch), 0
        for n in lengths:
            own, path = scores[at : at + n], labels[at : at + n]
            value = own[np.arange(n), path].sum() - switch * (path[1:] != path[:-1]).sum()
            assert value == pytest.approx(_slow_viterbi(own, switch), abs=1e-4)
            at += n


EN = "the cat is on the table and the dog is with them in the house that was there"
DE = "der hund ist nicht mit dem kind auf der straße und die katze schläft schon lange"
RU = "собака и кошка живут в этом доме вместе с детьми и никогда не ссорятся друг с другом"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, x) for t, x in ((EN, "en"), (DE, "de"), (RU, "ru")) for _ in range(20)]
    rows += [(None, "en"), (EN, None), ("", "de")]
    return language.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_of_mixed_text(spark, model):
    text = f"{EN}. {RU}! {DE}"
    df = spark.createDataFrame([(1, text, "x", 0.5)], "doc_id long, text string, lang_pred string, score double")
    row = language.identify(df, model).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "de"]
    assert [text[s.start : s.stop] for s in row.spans] == [EN, RU, DE]
    assert row.row.lang_pred == "x" and 0 < row.score < 1


def test_scripts_narrow_candidates(model):
    words = language.words_of("кошка table 猫")
    allowed = model.candidates[words.scripts]
    assert [model.languages[k] for k in np.flatnonzero(allowed[0])] == ["ru"]
    assert [model.languages[k] for k in np.flatnonzero(allowed[1])] == ["de", "en"]
    assert allowed[2].all()


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    rows = language.predicted(odd_docs).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        letters = r.doc_id not in (1, 2, 3, 13)
        assert (r.lang_pred == "en") == letters and (letters or r.lang_pred == "und")
        assert 0 <= r.score <= 1 and (r.doc_id is not None or r.held_out)
    assert language.predicted(no_docs).count() == 0
    nothing = odd_docs.withColumn("lang", odd_docs["node"].substr(9, 1))
    assert {r.lang_pred for r in language.identify(odd_docs, language.learn(nothing.filter("false"))).collect()} == {"und"}


def test_held_out_accuracy_and_kept_documents(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    got = language.predicted(docs).join(docs, "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert np.mean([a == b for a, b in got]) > 0.98
    kept = language.filtered(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
