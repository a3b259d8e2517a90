import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from parlance.llm import toxicity
from parlance.llm.common import held_out, view

LARGER = SMALL.replace("0.001", "0.1")


def features(*texts, words=("idiot",)):
    lexicon = toxicity.Lexicon(list(words), [2.0] * len(words))
    return [dict(zip(toxicity.FEATURES, row)) for row in toxicity.text_features(*view(pa.array(list(texts))), lexicon)]


def test_features():
    plain, near, far, sign, loud, empty = features(
        "one idiot here", "you total idiot", "you a b c d e f g idiot", "1d1ot !", "IDIOT!! NOW", "")
    assert plain["hits"] == np.log1p(1) and plain["hit_density"] == pytest.approx(1 / 3) and plain["near_person_density"] == 0
    assert near["near_person_density"] == pytest.approx(1 / 3) and far["near_person_density"] == 0
    assert sign["hit_density"] == 0 and sign["disguised_density"] > 0 and sign["inner_sign_share"] > 0
    assert loud["shouted_share"] == 1 and loud["exclamation_share"] > 0
    assert not any(empty.values())


def test_words_do_not_reach_into_the_next_text():
    a, b = features("say you", "idiot there")
    assert a["hit_density"] == 0 and b["near_person_density"] == 0


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    return model, toxicity.score(docs, model).join(labels, "doc_id").withColumn("out", held_out()).toPandas()


def test_held_out_quality(scored):
    _, df = scored
    out = df[df.out]
    rank = out.score.rank()
    yes = int(out.toxic.sum())
    auc = (rank[out.toxic == 1].sum() - yes * (yes + 1) / 2) / (yes * (len(out) - yes))
    hits = int(((out.predicted == 1) & (out.toxic == 1)).sum())
    assert auc > 0.97 and hits > 0.85 * yes and hits > 0.85 * int((out.predicted == 1).sum())
    assert ((out.score >= 0) & (out.score <= 1)).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_nulls_empties_and_repeats(spark, scored):
    model, _ = scored
    rows = [(1, None), (1, ""), (2, "x"), (2, "x"), (None, "y")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(20)], "doc_id long, text string")
    for labels, want in (([(i, 1) for i in range(20)], 1.0), ([], 0.0), ([(1, None)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {want}
