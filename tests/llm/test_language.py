import random
import zlib

import pytest
from pyspark.sql import functions as F

from postmill.llm import language, queries
from postmill.llm.common import fold
from llm_tables import docs_table, messy_rows

PARTS = {"xa": "the ing ed th er on".split(), "xb": "der ung sch keit ein lich".split(), "xc": "ção não lha que inho".split()}


@pytest.fixture(scope="module")
def spoken(spark):
    draw, rows = random.Random(4), []
    for i in range(300):
        lang = list(PARTS)[i % 3]
        text = " ".join("".join(draw.choices(PARTS[lang], k=draw.randrange(1, 4))) for _ in range(20 + i % 40))
        rows.append((i, text, lang, "a"))
    return docs_table(spark, rows)


def test_held_out_rows(spoken):
    model = language.train(spoken, fold("doc_id", 3) != 1)
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    got = language.identify(spoken, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got) and model.languages == list(PARTS)


def test_same_model_on_every_run(spoken):
    learn = fold("doc_id", 3) != 1
    a, b = language.train(spoken, learn), language.train(spoken.repartition(6), learn)
    assert (a.logits == b.logits).all() and a.temperature == b.temperature


def test_messy_rows(messy, spoken, empty):
    model = language.train(spoken, F.lit(True))
    got = language.identify(messy, model).collect()
    assert len(got) == len(messy_rows())
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 4)) for r in got)
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(empty, model).collect() == []
    none = language.train(empty, F.lit(True))
    assert {r.lang_pred for r in language.identify(messy, none).collect()} == {"und"}


def test_pieces_change_nothing(monkeypatch):
    text = "Der Großteil, ÄÖÜ! 日本語 x1y2 " * 50
    whole = language.gram_counts(text)
    for piece in (1, 7, 100):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (language.gram_counts(text) == whole).all()


def test_letters():
    assert language.gram_counts("123 !? \n") is None
    assert language.gram_counts("") is None
    assert language.gram_counts("1 é") is not None
    # The last letter of a long text counts.
    assert language.gram_counts("1" * 600_000 + "z").sum() > 0


def test_query_on_held_out_documents(spark):
    """What the registered query says of documents it did not learn from."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op4_language(spark, sf).collect() if r.held_out]
    assert len(held) > 250
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the cat sat on the mat number {'abcdef'[i % 6]} and then it went", "en") for i in range(400)]
    rows += [(1000 + i, f"zxqv wvuq qqzx vvxz {'ghijk'[i % 5]} zzxq", "rare") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, F.lit(True), sample_rows=20)
    assert set(model.languages) == {"en", "rare"}
