"""Disguises that the decoder of op1_toxicity must be shown."""

import pytest
from runlens.llm import toxicity


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = spark.createDataFrame([(-1, "you are an idiot and a stupid moron , she said to him . " * 400)], "doc_id long, text string")
    return toxicity.Decoder(toxicity.language_model(toxicity.trigrams(docs.union(plain))))


@pytest.mark.parametrize("text, word", [
    ("i d i o t.", "idiot"), ("i d i o t, go", "idiot"), ("m o r o n?", "moron"), ('he said "i d i o t"', "idiot"), ("i  d  i o   t", "idiot"), ("you id iot!", "idiot"),
    ("іdіоt", "idiot"), ("ssttuuppiidd", "stupid"), ("iiiddiottt", "idiot"),
])
def test_disguised(decoder, text, word):
    assert word in decoder.restored(text)


def test_no_reading_is_cut(decoder):
    """A reading whose beginning is dear among more than 24 states: against a decoder of plain recursion."""
    s = "*#%*ot"
    arcs = list(decoder.arcs(s))

    def least(i, p, q):
        if i == len(s):
            return decoder.costs[p][q][0] if q else 0.0, ""
        found = []
        for j, letters, more in arcs[i]:
            a, b = p, q
            for k in map(toxicity.code, letters):
                if k or b:
                    more += decoder.costs[a][b][k]
                    a, b = b, k
            rest, text = least(j, a, b)
            found.append((more + rest, letters + text))
        return min(found)
    assert decoder.read(s) == " ".join(least(0, 0, 0)[1].split())


def test_plain_text_stays(decoder):
    assert {"you", "are", "an", "idiot"} <= decoder.restored("you are an idiot") and decoder.restored("don't you") >= {"you"}
