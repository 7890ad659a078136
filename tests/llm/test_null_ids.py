import random

import pytest

from tessergraph.llm import substrings
from tests.llm.helpers import prose, words


@pytest.mark.parametrize("one_id", [None, 7])
def test_texts_of_one_id_are_judged_apart(spark, one_id):
    draw = random.Random(21)
    passage = prose(draw, 60)
    texts = [prose(draw, 400), f"{prose(draw, 300)} {passage} {prose(draw, 30)}", prose(draw, 25), prose(draw, 90), None, ""]
    rows = [(one_id, t) for t in texts] + [(one_id, texts[0]), (9, f"{passage} {prose(draw, 20)}"), (10, f"{texts[3]} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = substrings.cut_repeats(docs).collect()
    assert sorted((r.text or "") for r in cut if r.doc_id == one_id) == sorted((t or "") for i, t in rows if i == one_id)
    assert {r.doc_id: len(words(r.text)) for r in cut if r.doc_id in (9, 10)} == {9: 20, 10: 1}
    got = substrings.digests(docs).collect()
    assert len(got) == len(rows) and all(r.n_removed == 0 for r in got if r.doc_id == one_id)
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (9, 10)} == {9: 60, 10: 90}


def test_texts_of_no_id_share_a_passage_once(spark):
    draw = random.Random(22)
    passage = prose(draw, 80)
    docs = spark.createDataFrame([(None, f"{prose(draw, n)} {passage} {prose(draw, n)}") for n in (5, 50, 500)], "doc_id long, text string")
    got = [r.n_removed for r in substrings.digests(docs).collect()]
    assert sorted(got) == [0, 80, 80]
